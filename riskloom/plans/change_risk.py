"""Queries on changes: orders are changes, their lines are touched files, customers are authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.functions.scalars import entropy_share
from riskloom.operators import risk
from riskloom.operators.relations import dealt
from riskloom.plans.registry import query, table


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order with lines: its change features.

    First touches come from one window over (author, file); sizes are summed per file before the entropy.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    n = lines.count()
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), n, "o_orderkey")
    lines = dealt(lines, n, "l_orderkey")
    flag = lambda c: F.sum(c.cast("bigint"))
    files = lines.groupBy("l_orderkey", "l_partkey").agg(
        F.sum("l_quantity").alias("size"), F.count("*").alias("lines"), flag((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("failed"), flag(F.col("l_returnflag") == "A").alias("bare")
    )
    touched = dealt(files.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), n, "o_custkey", "l_partkey")
    first = F.min("o_orderdate").over(W.partitionBy("o_custkey", "l_partkey"))
    touched = dealt(touched.withColumn("prior", (first < F.col("o_orderdate")).cast("int")), n, "o_orderkey")
    total = F.sum("size").over(W.partitionBy("o_orderkey"))
    rows = touched.withColumn("part", entropy_share(F.col("size"), total)).groupBy("o_orderkey", "o_custkey", "o_orderdate").agg(
        F.sum("size").alias("churn"), F.count("*").alias("files_touched"), F.sum("part").alias("bits"), F.max("prior").alias("prior"), F.sum("failed").alias("failures"), F.sum("bare").alias("uncovered"), F.sum("lines").alias("lines")
    )
    return rows.select(
        "o_orderkey", "o_custkey", "o_orderdate", "churn", "files_touched", "failures", "uncovered", "lines",
        F.log1p("churn").alias("log_churn"), F.when(F.col("files_touched") > 1, F.col("bits") / F.log2(F.col("files_touched").cast("double"))).otherwise(0.0).alias("entropy"),
        (1 - F.col("prior")).alias("author_is_new"), ((F.col("lines") - F.col("uncovered")) / F.col("lines")).alias("changed_line_coverage"), F.col("uncovered").alias("uncovered_changed_lines"), F.col("failures").alias("verified_test_failures"),
    )


CHANGES_SQL = """
f AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS size, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS failed, count(*) FILTER (WHERE l_returnflag = 'A') AS bare FROM lineitem GROUP BY 1, 2),
t AS (SELECT o_orderkey, o_custkey, o_orderdate, size, lines, failed, bare, CASE WHEN min(o_orderdate) OVER (PARTITION BY o_custkey, l_partkey) < o_orderdate THEN 1 ELSE 0 END AS prior, sum(size) OVER (PARTITION BY o_orderkey) AS total FROM f JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT o_orderkey, o_custkey, o_orderdate, sum(size) AS churn, count(*) AS files_touched, sum(CASE WHEN size > 0 THEN -(size / total) * log2(size / total) ELSE 0 END) AS bits, max(prior) AS prior, CAST(sum(failed) AS BIGINT) AS failures, CAST(sum(bare) AS BIGINT) AS uncovered, CAST(sum(lines) AS BIGINT) AS lines FROM t GROUP BY 1, 2, 3),
x AS (SELECT *, ln(1 + churn) AS log_churn, CASE WHEN files_touched > 1 THEN bits / log2(files_touched) ELSE 0 END AS entropy, 1 - prior AS author_is_new, (lines - uncovered) / lines AS cov FROM c),
z AS (SELECT *, 1 / (1 + exp(-(-0.9 + 3.0 * failures + 0.18 * uncovered + 0.35 * log_churn + 0.4 * entropy + 0.25 * author_is_new + 0.8 * 0.5 - 1.4 * cov - 1.2))) AS p FROM x),
s AS (SELECT *, 1 / (1 + exp(-(1.3955752932259922 * ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) + 1.1307516776121225))) AS risk FROM z)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.with_defaults(changes(spark, sf_dir))
    return rows.withColumn("risk", risk.platt(risk.raw_score())).withColumn("decision", risk.decide(F.col("risk"), F.col("failures")))


@query(f"WITH {CHANGES_SQL} SELECT o_orderkey AS change_id, round(churn, 2) AS churn, files_touched, round(entropy, 4) AS entropy, CAST(author_is_new AS BIGINT) AS author_is_new, failures, round(risk, 4) AS risk, CASE WHEN failures > 0 OR risk >= 0.8672 THEN 'BLOCK' WHEN risk >= 0.4982 THEN 'CANARY' ELSE 'PASS' END AS decision FROM s")
def risk_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, risk and decision of every change."""
    return scored(spark, sf_dir).select(F.col("o_orderkey").alias("change_id"), F.round("churn", 2).alias("churn"), F.col("files_touched").cast("bigint").alias("files_touched"), F.round("entropy", 4).alias("entropy"), F.col("author_is_new").cast("bigint").alias("author_is_new"), "failures", F.round("risk", 4).alias("risk"), "decision")


@query(f"WITH {CHANGES_SQL} SELECT CASE WHEN failures > 0 OR risk >= 0.8672 THEN 'BLOCK' WHEN risk >= 0.4982 THEN 'CANARY' ELSE 'PASS' END AS decision, count(*) AS n, round(avg(risk), 4) AS mean_risk FROM s GROUP BY 1")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes and mean risk by decision."""
    return scored(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n"), F.round(F.avg("risk"), 4).alias("mean_risk"))


@query(f"""WITH {CHANGES_SQL}, l AS (SELECT o_orderkey AS change_id, unnest([3.0 * failures, 0.18 * uncovered, 0.35 * log_churn, 0.4 * entropy, 0.25 * author_is_new, 0.4, -1.4 * cov, -1.2]) AS v, unnest(['verified_test_failures', 'uncovered_changed_lines', 'log_churn', 'entropy', 'author_is_new', 'llm_risk', 'changed_line_coverage', 'mutation_score']) AS feature FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY abs(round(v, 6)) DESC, feature) AS place FROM l)
SELECT change_id, feature, round(v, 4) AS contribution, place FROM r WHERE place <= 3""")
def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest parts of every change's score."""
    rows = scored(spark, sf_dir).withColumnRenamed("o_orderkey", "change_id")
    return risk.contributions(rows, "change_id", top=3, digits=6).select("change_id", "feature", F.round("contribution", 4).alias("contribution"), F.col("place").cast("bigint").alias("place"))


@query("""WITH t AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderdate, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
h AS (SELECT *, lag(o_orderdate) OVER (PARTITION BY l_partkey ORDER BY o_orderdate, o_orderkey) AS last_touch FROM t)
SELECT o_orderkey AS change_id, round(coalesce(avg(date_diff('second', last_touch, o_orderdate) / 86400.0), 0), 4) AS age_days, count(last_touch) AS files_with_history FROM h GROUP BY 1""")
def code_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean days since the last touch of a change's files, over files with history."""
    t = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_custkey", "o_orderdate", "l_partkey").distinct()
    last = F.lag("o_orderdate").over(W.partitionBy("l_partkey").orderBy("o_orderdate", "o_orderkey"))
    days = (F.unix_timestamp("o_orderdate") - F.unix_timestamp("last_touch")) / 86400.0
    return t.withColumn("last_touch", last).groupBy(F.col("o_orderkey").alias("change_id")).agg(F.round(F.coalesce(F.avg(days), F.lit(0.0)), 4).alias("age_days"), F.count("last_touch").alias("files_with_history"))


@query("""WITH t AS (SELECT DISTINCT o_orderkey, o_orderdate, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey), m AS (SELECT max(o_orderdate) AS ref FROM orders)
SELECT l_partkey AS file, count(*) AS touches, count(*) FILTER (WHERE o_orderdate >= ref - INTERVAL 90 DAY) AS recent FROM t, m GROUP BY 1""")
def recent_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches of each file, and those within 90 days of the last change."""
    orders = table(spark, sf_dir, "orders")
    t = orders.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_orderdate", "l_partkey").distinct()
    ref = orders.agg(F.max("o_orderdate").alias("ref"))
    recent = F.col("o_orderdate") >= F.col("ref") - F.expr("INTERVAL 90 DAYS")
    return t.join(F.broadcast(ref)).groupBy(F.col("l_partkey").alias("file")).agg(F.count("*").alias("touches"), F.count_if(recent).alias("recent"))


@query(f"""WITH {CHANGES_SQL}, y AS (SELECT round(risk, 4) AS score, CASE WHEN failures > 0 THEN 1 ELSE 0 END AS label FROM s), u AS (SELECT DISTINCT score FROM y),
n AS (SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM y),
p AS (SELECT score, count(*) FILTER (WHERE label = 0) AS neg, count(*) FILTER (WHERE label = 1) AS pos FROM y GROUP BY 1),
q AS (SELECT score, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER (ORDER BY score DESC) AS tp FROM p)
SELECT round(least(max(CASE WHEN tp >= n1 - floor(n1 * (1 - CAST(0.9 AS DOUBLE))) THEN score END), min(CASE WHEN fp <= n0 * 0.05 THEN score END)), 4) AS canary, round(min(CASE WHEN fp <= n0 * 0.05 THEN score END), 4) AS block FROM q, n""")
def release_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that keep false blocks under 5 % and catch 90 % of failing changes."""
    rows = scored(spark, sf_dir).select(F.round("risk", 4).alias("score"), (F.col("failures") > 0).cast("int").alias("label"))
    return risk.thresholds(rows)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_returnflag, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
j AS (SELECT f.l_orderkey AS fix_id, f.l_partkey AS file, b.l_orderkey AS introducer, row_number() OVER (PARTITION BY f.l_orderkey, f.l_partkey ORDER BY b.l_shipdate DESC, b.l_orderkey) AS rn FROM (SELECT DISTINCT l_orderkey, l_partkey, o_orderdate FROM l WHERE l_returnflag = 'R') f JOIN l b ON b.l_partkey = f.l_partkey AND b.l_shipdate < f.o_orderdate AND b.l_orderkey <> f.l_orderkey)
SELECT fix_id, file, introducer FROM j WHERE rn = 1""")
def defect_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest earlier change of a fixed file is held to have introduced the defect.

    An as-of join without a self-join's blow-up: fixes and touches of a file are one stream in time order, and each fix
    looks back at the last touches by another change through two windows.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
    n = lines.count()
    lines, orders = dealt(lines, n, "l_orderkey"), dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), n, "o_orderkey")
    fixes = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct().join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("own"), F.col("l_partkey").alias("file"), F.col("o_orderdate").alias("at"), F.lit(None).cast("bigint").alias("by"), F.lit(0).alias("kind"))
    touches = lines.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.lit(None).cast("bigint").alias("own"), F.col("l_partkey").alias("file"), F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("by"), F.lit(1).alias("kind"))
    # equal touches of a change lie side by side and are one to the windows
    # fixes stand before touches of the same time, so that only earlier touches are seen; of equal times the least id comes last
    order = W.partitionBy("file").orderBy("at", "kind", F.desc("by")).rowsBetween(W.unboundedPreceding, -1)
    both = dealt(fixes.unionAll(touches), 2 * n, "file").withColumn("last", F.last("by", True).over(order))
    prior = W.partitionBy("file").orderBy("at", "kind", F.desc("by"))
    chain = both.withColumn("other", F.when(F.col("by").isNotNull() & (F.col("by") != F.col("last")), F.col("last")))
    # the last touch by a change other than the latest one, carried along for fixes that are themselves the latest
    chain = chain.withColumn("before", F.last(F.when(F.col("kind") == 1, F.struct(F.col("by").alias("b"), F.col("last").alias("l"))), True).over(order)).withColumn("second", F.last("other", True).over(prior.rowsBetween(W.unboundedPreceding, -1)))
    found = chain.where("kind = 0").select(F.col("own").alias("fix_id"), "file", F.when(F.col("last") != F.col("own"), F.col("last")).otherwise(F.col("second")).alias("introducer"))
    return found.where("introducer is not null")
