"""Queries of claim verification: orders are runs, parts are files, line numbers are lines, suppliers are tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import verification as V
from riskloom.plans.registry import query, table


def _facts(spark: SparkSession, d: str):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").cast("string").alias("test_id"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("q"))  # noqa: E741
    outcomes = l.where("l_linestatus = 'F'").groupBy("run_id", "test_id").agg(F.when(F.bool_or(F.col("q") > 45), "failed").otherwise("passed").alias("outcome"))
    hits = V.changed_hits(l.select("run_id", "file", "line", "test_id"), l.where("l_returnflag = 'R'").select("run_id", "file", "line"))
    return l, outcomes, hits


@query("""WITH o AS (SELECT l_orderkey AS r, l_suppkey AS t, bool_or(CAST(l_quantity AS INTEGER) > 45) AS bad FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), h AS (SELECT DISTINCT a.l_orderkey AS r, a.l_suppkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_linenumber = b.l_linenumber AND b.l_returnflag = 'R'),
k AS (SELECT DISTINCT l_orderkey AS r, l_suppkey AS t FROM lineitem WHERE l_discount > 0.09), c AS (SELECT DISTINCT l_orderkey AS r, l_suppkey AS t FROM lineitem)
SELECT c.r AS run_id, CAST(c.t AS VARCHAR) AS claim_id, CASE WHEN o.r IS NULL THEN 'UNVERIFIABLE' WHEN h.r IS NOT NULL OR o.bad OR k.r IS NOT NULL THEN 'VERIFIED' ELSE 'REFUTED' END AS status FROM c LEFT JOIN o USING (r, t) LEFT JOIN h USING (r, t) LEFT JOIN k USING (r, t)""")
def test_impact_status(spark: SparkSession, d: str) -> DataFrame:
    """Claims of impacted tests against execution, failures and killed mutants."""
    l, outcomes, hits = _facts(spark, d)
    claims = l.select("run_id", F.col("test_id").alias("claim_id"), F.col("test_id").alias("target")).distinct()
    kills = table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").cast("string").alias("test_id"), F.lit("m").alias("mutant"))
    return V.check_test_impact(claims, outcomes, hits, kills).select("run_id", "claim_id", "status")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS f FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS f FROM lineitem WHERE l_quantity > 10), h AS (SELECT DISTINCT a.l_orderkey AS r, a.l_suppkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_linenumber = b.l_linenumber AND b.l_returnflag = 'R'),
b AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS f FROM lineitem JOIN h ON l_orderkey = r AND l_suppkey = t)
SELECT c.r AS run_id, CAST(c.f AS VARCHAR) AS claim_id, CASE WHEN p.r IS NULL THEN 'REFUTED' WHEN b.r IS NOT NULL THEN 'VERIFIED' ELSE 'UNVERIFIABLE' END AS status FROM c LEFT JOIN p USING (r, f) LEFT JOIN b USING (r, f)""")
def module_impact_status(spark: SparkSession, d: str) -> DataFrame:
    """Claims of impacted modules against call paths and tests that run both sides."""
    l, _, hits = _facts(spark, d)
    claims = l.select("run_id", F.col("file").alias("claim_id"), F.col("file").alias("target")).distinct()
    return V.check_module_impact(claims, l.where("q > 10").select("run_id", F.col("file").alias("path")), l.select("run_id", "test_id", "file"), hits)


@query("""WITH u AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS f FROM lineitem), n AS (SELECT l_orderkey AS r, l_partkey AS f, bool_or(l_tax > 0.07) AS inc FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2), k AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS f FROM lineitem WHERE l_quantity > 20), x AS (SELECT DISTINCT l_orderkey AS r FROM lineitem WHERE l_linestatus = 'F' AND CAST(l_quantity AS INTEGER) > 45)
SELECT u.r AS run_id, CAST(u.f AS VARCHAR) AS claim_id, CASE WHEN n.r IS NULL THEN 'UNVERIFIABLE' WHEN k.r IS NOT NULL AND (x.r IS NOT NULL OR inc) THEN 'VERIFIED' ELSE 'REFUTED' END AS status FROM u LEFT JOIN n USING (r, f) LEFT JOIN k USING (r, f) LEFT JOIN x ON x.r = u.r""")
def api_break_status(spark: SparkSession, d: str) -> DataFrame:
    """Claims of broken interfaces against callers, failures and signatures."""
    l, outcomes, _ = _facts(spark, d)
    claims = l.select("run_id", F.col("file").alias("claim_id"), F.col("file").alias("target")).distinct()
    units = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").cast("string").alias("target")).agg(F.when(F.bool_or(F.col("l_tax") > 0.07), "removed").alias("incompatible"))
    callers = l.where("q > 20").select("run_id", F.col("file").alias("target"), F.col("test_id").alias("caller"))
    return V.check_api_break(claims, units, callers, outcomes)


@query("""WITH o AS (SELECT l_orderkey AS r, min(l_partkey) AS f FROM lineitem GROUP BY 1), c AS (SELECT r, f, r AS ref, r % 4 AS k FROM o),
j AS (SELECT c.*, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = ref + CASE WHEN k = 1 THEN 1000000 ELSE 0 END AND l_partkey = f) AS found FROM c)
SELECT r AS run_id, CAST(r AS VARCHAR) AS claim_id, CASE WHEN k = 2 THEN 'UNVERIFIABLE' WHEN NOT found THEN 'REFUTED' ELSE 'VERIFIED' END AS status FROM j""")
def history_link_status(spark: SparkSession, d: str) -> DataFrame:
    """Cited commits must exist and touch the file; without one a link is not verifiable."""
    l, _, _ = _facts(spark, d)
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.min("l_partkey").cast("string").alias("f"))
    k = F.col("run_id") % 4
    ref = F.when(k == 2, F.lit("issue:1")).otherwise(F.concat(F.lit("commit:"), (F.col("run_id") + F.when(k == 1, 1000000).otherwise(0)).cast("string")))
    claims = first.select("run_id", F.col("run_id").cast("string").alias("claim_id"), F.concat("f", F.lit("::f")).alias("target"), F.array(ref).alias("evidence_ids"))
    commits = l.select(F.col("run_id").cast("string").alias("sha"), F.col("file").alias("path")).distinct()
    none = spark.createDataFrame([], "path string, alias string")
    return V.check_history_link(claims, commits, spark.createDataFrame([("issue:1",)], "id string"), none, True).select("run_id", "claim_id", "status")


@query("""WITH h AS (SELECT DISTINCT a.l_orderkey AS r, a.l_suppkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_linenumber = b.l_linenumber AND b.l_returnflag = 'R'), s AS (SELECT l_orderkey AS r, l_suppkey AS t, min(l_linenumber) AS dist FROM lineitem GROUP BY 1, 2)
SELECT r AS run_id, 'test_impact' AS type, CAST(t AS VARCHAR) AS target, 'cov:' || t AS evidence FROM h UNION ALL SELECT r, 'test_impact', CAST(t AS VARCHAR), 'graph:calls:' || t FROM s ANTI JOIN h USING (r, t) WHERE dist <= 3""")
def rule_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims by coverage and by near call paths."""
    l, _, hits = _facts(spark, d)
    static = l.groupBy("run_id", "test_id").agg(F.min("line").alias("distance"))
    modules = spark.createDataFrame([], "run_id long, path string, evidence string")
    api = spark.createDataFrame([], "run_id long, target string, caller string")
    return V.impact_claims(hits, static, modules, api).select("run_id", "type", "target", F.col("evidence")[0].alias("evidence"))


@query("""WITH a AS (SELECT l_orderkey AS r, count(DISTINCT l_suppkey) AS i, count(DISTINCT l_linenumber) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), f AS (SELECT r, count(DISTINCT s) AS n FROM (SELECT l_orderkey AS r, l_partkey AS s FROM lineitem WHERE l_returnflag IN ('R', 'A')) GROUP BY 1), h AS (SELECT l_orderkey AS r, count(*) AS c, count(DISTINCT l_suppkey) AS u FROM lineitem GROUP BY 1)
SELECT h.r AS run_id, CAST(coalesce(f.n, 0) AS DOUBLE) AS szz_bug_fixes, CAST(coalesce(i, 0) AS DOUBLE) AS szz_introducers, CAST(coalesce(b, 0) AS DOUBLE) AS bug_issues, CAST(c AS DOUBLE) AS history_commits, CAST(u AS DOUBLE) AS history_authors FROM h LEFT JOIN a USING (r) LEFT JOIN f USING (r)""")
def history_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of a change's history."""
    l, _, _ = _facts(spark, d)
    links = l.where("l_returnflag = 'R'").select("run_id", F.col("file").alias("fix_sha"), F.col("test_id").alias("introducing_sha"), F.col("line").alias("issue"))
    history = l.select("run_id", F.col("line").cast("string").alias("unit"), F.col("file").alias("sha"), F.col("test_id").alias("author"), F.col("l_returnflag").isin("R", "A").alias("is_fix"))
    return V.history_features(links, history)


@query("SELECT o_orderkey, round(least(0.5 + least(o_totalprice / 1000 / 800, 1.0) * 0.2 + least((o_custkey % 15) / 12.0, 1.0) * 0.15 + 0.05, 1.0), 3) AS complexity FROM orders")
def llm_routes(spark: SparkSession, d: str) -> DataFrame:
    """Complexity of language-model tasks (cost routing only; no model is called)."""
    r = V.llm_route(F.lit(0.5), F.col("o_totalprice") / 1000, F.col("o_custkey") % 15, F.lit(6000))
    return table(spark, d, "orders").select("o_orderkey", r["complexity"].alias("complexity"))
