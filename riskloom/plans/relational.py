"""Queries of joins, set operations, lookups and top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.functions.scalars import round_binary
from riskloom.operators import relations as R
from riskloom.plans.registry import query, table


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def ordered_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of a scan in time order, ties by key."""
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(100)


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000012' OR starts_with(c_name, 'Customer#00000001') ORDER BY c_name, c_custkey LIMIT 1")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A lookup by key or prefix; the first by name."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return c.where((F.col("c_name") == "Customer#000000012") | F.col("c_name").startswith("Customer#00000001")).orderBy("c_name", "c_custkey").limit(1)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def optional_predicates(spark: SparkSession, d: str) -> DataFrame:
    """A scan whose predicates apply only where they are given."""
    df = table(spark, d, "orders")
    for column, value in {"o_orderstatus": "F", "o_orderpriority": None}.items():
        if value:
            df = df.where(F.col(column) == value)
    return df.select("o_orderkey", "o_orderstatus")


@query("SELECT EXISTS (SELECT 1 FROM labels WHERE toxic = 1) AS has_toxic, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS has_negative")
def exists_probes(spark: SparkSession, d: str) -> DataFrame:
    """Existence probes."""
    a = table(spark, d, "labels").where("toxic = 1").limit(1).agg((F.count("*") > 0).alias("has_toxic"))
    b = table(spark, d, "orders").where("o_totalprice < 0").limit(1).agg((F.count("*") > 0).alias("has_negative"))
    return a.join(b)


@query("SELECT l_suppkey AS test_id, count(DISTINCT l_linenumber) AS n_lines FROM lineitem WHERE l_partkey = 7 AND l_linenumber IN (1, 2, 3, 4) GROUP BY 1")
def tests_covering(spark: SparkSession, d: str) -> DataFrame:
    """Tests that run given lines of a file, and how many of them."""
    want = spark.createDataFrame([(7, i) for i in range(1, 5)], "l_partkey long, l_linenumber int")
    return table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_suppkey").join(F.broadcast(want), ["l_partkey", "l_linenumber"]).groupBy(F.col("l_suppkey").alias("test_id")).agg(F.countDistinct("l_linenumber").alias("n_lines"))


@query("SELECT DISTINCT l_partkey AS file, l_linenumber AS line FROM lineitem")
def covered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Covered lines."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line")).distinct()


@query("SELECT o_custkey AS author, l_partkey AS file, o_orderdate AS at FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def commit_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of commits."""
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("author"), F.col("l_partkey").alias("file"), F.col("o_orderdate").alias("at"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def commits_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Commits that touch a file of a set, once each (left semi)."""
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""WITH i AS (SELECT p_partkey AS sym, p_size AS lo, p_size + (p_partkey % 7) AS hi, p_brand AS path FROM part), q AS (SELECT DISTINCT p_brand AS path, CAST(s AS INTEGER) AS line FROM part, (SELECT unnest(range(1, 51, 5)) AS s))
SELECT path, line, sym FROM (SELECT q.path, line, sym, row_number() OVER (PARTITION BY q.path, line ORDER BY hi - lo, sym DESC) AS rn FROM q JOIN i ON i.path = q.path AND line BETWEEN lo AND hi) WHERE rn = 1""")
def innermost_symbol(spark: SparkSession, d: str) -> DataFrame:
    """The shortest interval around each line, the last one on ties."""
    p = table(spark, d, "part")
    i = p.select(F.col("p_partkey").alias("sym"), F.col("p_size").alias("lo"), (F.col("p_size") + (F.col("p_partkey") % 7)).alias("hi"), F.col("p_brand").alias("path"))
    q = p.select(F.col("p_brand").alias("path")).distinct().select("path", F.explode(F.sequence(F.lit(1), F.lit(50), F.lit(5))).alias("line"))
    return R.innermost(q, i, "path", "line", "lo", "hi", "sym").select("path", "line", "sym")


@query("SELECT o_orderkey, coalesce(max(l_linestatus), 'UNCHECKED') AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'N' GROUP BY 1")
def claim_status(spark: SparkSession, d: str) -> DataFrame:
    """Every claim with its verdict or UNCHECKED."""
    v = table(spark, d, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.max("l_linestatus").alias("status"))
    return R.statuses(table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id")), v).withColumnRenamed("claim_id", "o_orderkey")


@query("SELECT DISTINCT l_partkey AS issue, l_suppkey AS pr FROM lineitem")
def issue_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of issues and changes, once each."""
    return R.link_pairs(table(spark, d, "lineitem").select("l_partkey", F.array("l_suppkey").alias("refs")), "l_partkey", "refs").select(F.col("l_partkey").alias("issue"), F.col("ref").alias("pr"))


@query("""WITH a AS (SELECT p_partkey AS caller, p_brand AS name, p_size % 5 AS hint FROM part), t AS (SELECT a.caller, b.p_partkey AS target, 0 AS tier FROM a JOIN part b ON b.p_brand = a.name AND b.p_size = a.hint AND b.p_partkey <> a.caller UNION ALL SELECT a.caller, b.p_partkey, 1 FROM a JOIN part b ON b.p_brand = a.name AND b.p_size = a.hint + 10 AND b.p_partkey <> a.caller),
m AS (SELECT *, min(tier) OVER (PARTITION BY caller) AS best FROM t), n AS (SELECT *, count(*) OVER (PARTITION BY caller) AS c FROM m WHERE tier = best)
SELECT caller, target, 1.0 / CAST(c AS DOUBLE) AS confidence FROM n WHERE c <= 3""")
def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The nearest tier of candidates, at most three, with equal confidence."""
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("caller"), F.col("p_brand").alias("name"), (F.col("p_size") % 5).alias("hint"))
    b = p.select(F.col("p_partkey").alias("target"), F.col("p_brand").alias("name"), "p_size")
    tier = lambda k: a.withColumn("p_size", F.col("hint") + k)
    return R.resolve_places([tier(0), tier(10)], b, ["name", "p_size"], "caller", "target")


@query("""WITH a AS (SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.v AS before, b.v AS after, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """What was added, removed or changed between two runs."""
    l = table(spark, d, "lineitem")  # noqa: E741
    side = lambda f: l.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_quantity").alias("v"))
    return R.compare(side("A"), side("R"), ["k"], "v")


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_returnflag = 'A' AND b.l_linestatus = 'F' AND b.l_linenumber = a.l_linenumber)")
def new_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures that the base does not have."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")  # noqa: E741
    base = l.where("l_returnflag = 'A' and l_linestatus = 'F'").select("l_partkey", "l_linenumber")
    return l.where("l_returnflag = 'R'").join(base, ["l_partkey", "l_linenumber"], "left_anti").select("l_orderkey", "l_partkey").distinct()


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey AS pr, o_orderkey AS run, o_totalprice AS price, coalesce(o_orderstatus <> 'O', true) AS stale FROM customer LEFT JOIN r ON o_custkey = c_custkey AND rn = 1""")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every change with its latest run, stale where that is missing or not current."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    last = R.latest_per(o, "o_custkey", "o_orderdate", "o_orderkey")
    return table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("pr"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("price"), F.coalesce(F.col("o_orderstatus") != "O", F.lit(True)).alias("stale"))


@query("SELECT a.doc_id, a.n_chars AS chars_a, b.toxic AS arm_b FROM documents a JOIN labels b ON a.doc_id = b.doc_id")
def paired_arms(spark: SparkSession, d: str) -> DataFrame:
    """Arms of two runs paired by id."""
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("chars_a")).join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("arm_b")), "doc_id")


@query("""WITH w AS (SELECT DISTINCT p_brand FROM part WHERE p_size <= 2 ORDER BY 1 LIMIT 2), h AS (SELECT DISTINCT o_custkey, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
SELECT o_custkey AS student FROM h JOIN w USING (p_brand) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM w)""")
def prerequisites_met(spark: SparkSession, d: str) -> DataFrame:
    """Relational division: who has every wanted item."""
    part = table(spark, d, "part")
    want = part.where("p_size <= 2").select("p_brand").distinct().orderBy("p_brand").limit(2)
    have = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("p_partkey") == F.col("l_partkey")).select("o_custkey", "p_brand")
    return R.divide(have, want, "o_custkey", "p_brand").select(F.col("o_custkey").alias("student"))


@query("SELECT a.o_custkey AS student, a.o_orderdate AS slot, a.o_orderkey AS one, b.o_orderkey AS two FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey")
def timetable_clashes(spark: SparkSession, d: str) -> DataFrame:
    """Two entries in one slot."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return o.join(o.withColumnRenamed("o_orderkey", "two"), ["o_custkey", "o_orderdate"]).where("o_orderkey < two").select(F.col("o_custkey").alias("student"), F.col("o_orderdate").alias("slot"), F.col("o_orderkey").alias("one"), "two")


@query("SELECT o_orderkey AS invoice, o_totalprice AS due, CAST(coalesce(sum(l_quantity), 0) AS DOUBLE) AS paid, max(l_shipdate) AS last_paid FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def invoice_balances(spark: SparkSession, d: str) -> DataFrame:
    """Invoices with the payments made."""
    paid = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("paid"), F.max("l_shipdate").alias("last_paid"))
    return table(spark, d, "orders").join(paid, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("invoice"), F.col("o_totalprice").alias("due"), F.coalesce("paid", F.lit(0.0)).alias("paid"), "last_paid")


@query("SELECT p_type AS target, p_partkey AS test FROM part WHERE p_type IN (SELECT DISTINCT p_type FROM part WHERE p_size = 1)")
def test_variants(spark: SparkSession, d: str) -> DataFrame:
    """Parameter variants of tests, by the key without parameters."""
    p = table(spark, d, "part")
    tests = p.select(F.concat("p_type", F.lit("["), F.col("p_partkey").cast("string"), F.lit("]")).alias("test_id"))
    found = R.variants(p.where("p_size = 1").select(F.col("p_type").alias("target")).distinct(), tests)
    return found.select("target", F.regexp_extract("test_id", r"\[(\d+)\]$", 1).cast("bigint").alias("test"))


@query("SELECT l_returnflag AS type, l_partkey AS target, min(l_orderkey) AS ord, count(DISTINCT l_suppkey) AS evidence FROM lineitem GROUP BY 1, 2")
def merged_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of one type and target merged, with everyone's evidence once."""
    c = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("ord"), F.lit("").alias("assertion"), F.array(F.col("l_suppkey").cast("string")).alias("evidence_ids"))
    return R.merge_claims(c).select("type", "target", "ord", F.size("evidence_ids").cast("bigint").alias("evidence"))


@query("SELECT p_partkey AS change, l_suppkey AS test FROM lineitem JOIN part ON p_partkey = l_partkey UNION SELECT p_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey + 1 JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0")
def impacted_tests(spark: SparkSession, d: str) -> DataFrame:
    """Of every part as a change, the tests that run it, or that run the part before it and fail."""
    ran = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("test")).distinct()
    part = table(spark, d, "part").select(F.col("p_partkey").alias("change"))
    failing = ran.join(table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("test")), "test", "left_semi")
    return ran.select(F.col("part").alias("change"), "test").unionByName(failing.select((F.col("part") + 1).alias("change"), "test")).join(part, "change", "left_semi").distinct()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def absorbed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose two ends both exist."""
    l = table(spark, d, "lineitem")  # noqa: E741
    s = table(spark, d, "supplier").where("s_nationkey < 5")
    p = table(spark, d, "part").where("p_size < 10")
    return l.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey AS run, 'new' AS kind FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' UNION ALL SELECT l_orderkey, 'legacy' FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')")
def merged_runs(spark: SparkSession, d: str) -> DataFrame:
    """U8: legacy runs join where their id is not seen."""
    new = table(spark, d, "orders").where("o_orderdate >= timestamp '1996-01-01'").select(F.col("o_orderkey").alias("run"), F.lit("new").alias("kind"))
    old = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run")).distinct().withColumn("kind", F.lit("legacy"))
    return new.unionByName(old.join(new, "run", "left_anti"))


@query("WITH x AS (SELECT l_partkey AS file, l_linenumber AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT *, n - row_number() OVER (PARTITION BY file ORDER BY n) AS g FROM x) SELECT file, min(n) AS low, max(n) AS high FROM g GROUP BY file, g")
def line_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive lines."""
    return R.islands(table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("n")), ["file"], "n")


@query("""WITH r AS (SELECT l_partkey, l_linenumber, l_orderkey, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey) AS k FROM lineitem), q AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY k, l_linenumber) AS rn FROM r)
SELECT l_partkey AS file, l_linenumber AS line, l_orderkey AS mutant FROM q WHERE rn <= 5""")
def mutant_sample(spark: SparkSession, d: str) -> DataFrame:
    """Mutants spread over lines, one of each line before a second of any."""
    l = table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey", "l_suppkey")  # noqa: E741
    return R.round_robin(l, "l_partkey", "l_linenumber", 5, "l_orderkey", "l_suppkey").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("mutant"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey, l_suppkey, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS p FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_orderkey AS o, CAST(l_suppkey AS VARCHAR) AS item, p, coalesce(nullif(abs(CAST(s_acctbal AS DOUBLE) / 100), 0), 0.5) AS c FROM l JOIN supplier ON s_suppkey = l_suppkey), r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY p, c, item) AS rn FROM t),
f(o, rn, used, kept) AS (SELECT DISTINCT o, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST([] AS VARCHAR[]) FROM r UNION ALL SELECT f.o, r.rn, CASE WHEN p = 0 OR used + c <= 120 THEN used + c ELSE used END, CASE WHEN p = 0 OR used + c <= 120 THEN list_append(kept, item) ELSE kept END FROM f JOIN r ON r.o = f.o AND r.rn = f.rn + 1)
SELECT o AS l_orderkey, round(used + 1e-7, 2) AS used, array_to_string(kept, ',') AS kept FROM f QUALIFY row_number() OVER (PARTITION BY o ORDER BY rn DESC) = 1""")
def selected_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests of each change by priority and cost, within a budget; what does not fit is skipped."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").groupBy("l_orderkey", "l_suppkey").agg(F.min(F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)).alias("priority"))
    s = table(spark, d, "supplier").select("s_suppkey", F.abs(F.col("s_acctbal") / 100).alias("t"))
    rows = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("l_suppkey").cast("string").alias("item"), "priority", F.coalesce(F.nullif("t", F.lit(0.0)), F.lit(0.5)).alias("cost"))
    return R.budget_prefix(rows, "l_orderkey", 120.0).select("l_orderkey", F.round(F.col("used") + 1e-7, 2).alias("used"), F.array_join("kept", ",").alias("kept"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_runs(spark: SparkSession, d: str) -> DataFrame:
    """The newest or largest rows, a fixed number."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE rn <= 3")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    """At most three rows of each group."""
    return R.top_per(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], 3, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("""WITH p AS (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1) SELECT * FROM p""")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by status, zero where there are none."""
    return R.fill_counts(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus"), ["k"], "o_orderstatus", ["O", "F", "P"])


@query("SELECT o_orderkey AS id, o_custkey AS author, 'orders' AS src FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, -1, 'new' FROM orders WHERE o_orderstatus = 'P'")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    """K2, K3: rows replaced by key."""
    o = table(spark, d, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.lit("orders").alias("src"))
    new = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.lit(-1).cast("bigint").alias("author"), F.lit("new").alias("src"))
    return R.upsert(old, new, ["id"])


@query("SELECT c_custkey, c_name FROM customer WHERE (contains(lower(c_name), '00012') OR contains(CAST(c_custkey AS VARCHAR), '12')) AND c_mktsegment = 'BUILDING'")
def search_rows(spark: SparkSession, d: str) -> DataFrame:
    """Substring search with an optional filter."""
    c = table(spark, d, "customer")
    return c.where((F.lower("c_name").contains("00012") | F.col("c_custkey").cast("string").contains("12")) & (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "c_name")


@query("SELECT c_custkey, CASE WHEN c_nationkey NOT BETWEEN 0 AND 24 THEN 'nation' WHEN c_acctbal < 0 THEN 'balance' WHEN NOT regexp_matches(c_name, '^Customer#[0-9]{9}$') THEN 'name' END AS fault FROM customer")
def validated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the first rule that they break."""
    fault = F.when(~F.col("c_nationkey").between(0, 24), "nation").when(F.col("c_acctbal") < 0, "balance").when(~F.col("c_name").rlike("^Customer#[0-9]{9}$"), "name")
    return table(spark, d, "customer").select("c_custkey", fault.alias("fault"))


@query("SELECT count(*) AS commits, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS fixes, round(sum(o_totalprice), 2) AS churn FROM orders")
def index_summary(spark: SparkSession, d: str) -> DataFrame:
    """A1: counts of the index."""
    return table(spark, d, "orders").agg(F.count("*").alias("commits"), F.count_if(F.col("o_orderstatus") == "F").alias("fixes"), F.round(F.sum("o_totalprice"), 2).alias("churn"))


@query("SELECT l_partkey AS unit, count(DISTINCT l_orderkey) AS fixes, count(DISTINCT l_suppkey) AS introducers FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def defect_summary(spark: SparkSession, d: str) -> DataFrame:
    """Distinct fixes and introducers of each unit."""
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("unit")).agg(F.countDistinct("l_orderkey").alias("fixes"), F.countDistinct("l_suppkey").alias("introducers"))


@query("SELECT l_orderkey AS change_id, CAST(count(*) FILTER (WHERE l_returnflag <> 'A') AS DOUBLE) / count(*) AS coverage, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'A') AS uncovered FROM lineitem GROUP BY 1")
def line_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of covered lines and the list of the rest."""
    bare = F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber"))))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("change_id")).agg((F.count_if(F.col("l_returnflag") != "A") / F.count("*")).alias("coverage"), F.when(F.size(bare) > 0, F.array_join(bare.cast("array<string>"), ",")).alias("uncovered"))


@query("SELECT l_orderkey AS run, CASE WHEN count(*) FILTER (WHERE l_linestatus = 'F' OR l_returnflag = 'R') = 0 THEN NULL ELSE round(CAST(count(*) FILTER (WHERE l_returnflag <> 'N' AND (l_linestatus = 'F' OR l_returnflag = 'R')) AS DOUBLE) / count(*) FILTER (WHERE l_linestatus = 'F' OR l_returnflag = 'R'), 4) END AS score FROM lineitem GROUP BY 1")
def mutation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Caught share of evaluated mutants; null without any."""
    done = (F.col("l_linestatus") == "F") | (F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.round(F.count_if(done & (F.col("l_returnflag") != "N")) / F.nullif(F.count_if(done), F.lit(0)), 4).alias("score"))


@query("SELECT l_orderkey AS run, CASE WHEN n = 0 THEN 0 ELSE round(CAST(r AS DOUBLE) / n, 4) END AS refuted_ratio, (n >= 2 AND CAST(r AS DOUBLE) / n > 0.5) AS retry FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)")
def refuted_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Refuted share of checked claims, and whether to try again."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count_if(F.col("l_returnflag").isin("A", "R")).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    ratio = F.col("r") / F.nullif("n", F.lit(0))
    return g.select("run", F.coalesce(F.round(ratio, 4), F.lit(0.0)).alias("refuted_ratio"), ((F.col("n") >= 2) & (F.coalesce(ratio, F.lit(0.0)) > 0.5)).alias("retry"))


@query("""WITH c AS (SELECT l_orderkey, l_partkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hit, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS ran FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN hit = 1 THEN 'VERIFIED' WHEN ran = 1 THEN 'REFUTED' ELSE 'UNVERIFIABLE' END AS status, count(*) AS n FROM c GROUP BY 1""")
def impact_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Claims of impact: verified, refuted or not verifiable."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("hit"), F.bool_or(F.col("l_linestatus") == "F").alias("ran"))
    return c.groupBy(F.when(F.col("hit"), "VERIFIED").when(F.col("ran"), "REFUTED").otherwise("UNVERIFIABLE").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS category, count(*) AS n, min(o_orderdate) AS first, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows by category."""
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("category")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("SELECT s_nationkey AS provider, count(*) AS calls, round(sum(s_acctbal), 2) AS tokens FROM supplier GROUP BY 1")
def usage_by_provider(spark: SparkSession, d: str) -> DataFrame:
    """Usage by provider."""
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("provider")).agg(F.count("*").alias("calls"), F.round(F.sum("s_acctbal"), 2).alias("tokens"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'P'), m AS (SELECT max(o_orderdate) AS ref FROM orders)
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS running, count(*) FILTER (WHERE o_orderstatus = 'F' AND rn = 1) AS blocked, count(*) FILTER (WHERE o_orderstatus = 'O' AND rn = 1) AS passed, count(*) FILTER (WHERE o_orderdate >= ref - INTERVAL 7 DAY) AS last_week FROM r, m""")
def overview(spark: SparkSession, d: str) -> DataFrame:
    """Roll-up of runs: running, decisions of the latest finished ones, finished in seven days."""
    o = table(spark, d, "orders")
    ref = o.agg(F.max("o_orderdate").alias("ref"), F.count_if(F.col("o_orderstatus") == "P").alias("running"))
    rn = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    done = o.where("o_orderstatus <> 'P'").withColumn("rn", rn).join(F.broadcast(ref))
    last = F.col("rn") == 1
    return done.agg(F.max("running").alias("running"), F.count_if(last & (F.col("o_orderstatus") == "F")).alias("blocked"), F.count_if(last & (F.col("o_orderstatus") == "O")).alias("passed"), F.count_if(F.col("o_orderdate") >= F.col("ref") - F.expr("INTERVAL 7 DAYS")).alias("last_week"))


@query("SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', CAST(l_quantity AS DOUBLE) / 8) AS DOUBLE) AS eighth, CAST(printf('%.1f', CAST(l_extendedprice AS DOUBLE) * CAST(l_discount AS DOUBLE)) AS DOUBLE) AS off FROM lineitem")
def rounded_values(spark: SparkSession, d: str) -> DataFrame:
    """M2: doubles rounded by their binary value, ties to even; every second quantity over eight is such a tie."""
    x = lambda c: F.col(c).cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", round_binary(x("l_quantity") / 8, 2).alias("eighth"), round_binary(x("l_extendedprice") * x("l_discount"), 1).alias("off"))
