"""Impact of changes from parsed sources: a module and a test file for each part, which call one another along a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import impact as I
from riskloom.plans.registry import query, table


def project_sources(spark: SparkSession, d: str) -> DataFrame:
    """path, text: in module k function i calls function i - 1, and function 0 that of module k div 2; a test calls the last function."""
    k, n = "cast(p_partkey as string)", "p_size % 4"
    module = f"""concat('import os\\n', if(p_partkey > 0, concat('from pkg.p', cast(p_partkey div 2 as string), ' import w', cast(p_partkey div 2 as string), '_0\\n'), ''), array_join(transform(sequence(0, {n}), i -> concat(
      '\\n\\ndef w', {k}, '_', cast(i as string), '(amount):\\n    total = amount\\n    return ', if(i > 0, concat('w', {k}, '_', cast(i - 1 as string), '(total)'), if(p_partkey > 0, concat('w', cast(p_partkey div 2 as string), '_0(total)'), 'total')), '\\n')), ''))"""
    test = f"concat('from pkg.p', {k}, ' import w', {k}, '_', cast({n} as string), '\\n\\n\\ndef test_w', {k}, '():\\n    assert w', {k}, '_', cast({n} as string), '(1)\\n')"
    part = table(spark, d, "part")
    return part.select(F.expr(f"concat('pkg/p', {k}, '.py')").alias("path"), F.expr(module).alias("text")).unionAll(part.select(F.expr(f"concat('tests/test_p', {k}, '.py')"), F.expr(test)))


_GRAPH = """WITH RECURSIVE n AS (SELECT p_partkey AS k, p_size % 4 AS last, unnest(generate_series(0, p_size % 4)) AS i FROM part),
e AS (SELECT k, i, k AS tk, i - 1 AS ti FROM n WHERE i > 0 UNION ALL SELECT k, 0, k // 2, 0 FROM n WHERE i = 0 AND k > 0),
r AS (SELECT k AS uk, i AS ui, k, i, 0 AS distance FROM n UNION SELECT r.uk, r.ui, e.k, e.i, r.distance + 1 FROM r JOIN e ON e.tk = r.k AND e.ti = r.i WHERE r.distance < 4),
f AS (SELECT uk, ui, k, i, min(distance) AS distance FROM r GROUP BY ALL)"""


@query(_GRAPH + " SELECT 'sym:pkg/p' || uk || '.py::w' || uk || '_' || ui AS unit, 'tests/test_p' || f.k || '.py::test_w' || f.k AS test, CAST(distance + 1 AS INTEGER) AS distance FROM f JOIN n ON n.k = f.k AND n.i = f.i AND n.i = n.last WHERE distance < 4")
def static_tests(spark: SparkSession, d: str) -> DataFrame:
    """The tests that reach each function by calls, from sources that are parsed and linked."""
    nodes, edges = I.project(project_sources(spark, d))
    units = nodes.where("not is_test").select(F.lit(0).alias("run_id"), "id", "path")
    found = I.static_reach(nodes, edges, units).where("is_test")
    return found.select("unit", I.test_id().alias("test"), "distance")


@query(_GRAPH + """, hits AS (SELECT j.p_partkey AS j, c.p_partkey AS run FROM part j JOIN part c ON c.p_partkey = j.p_partkey OR (j.p_partkey % 3 = 0 AND c.p_partkey = j.p_partkey // 2 AND j.p_partkey > 0)),
t AS (SELECT uk AS run, f.k AS j, min(distance) + 1 AS distance FROM f JOIN n ON n.k = f.k AND n.i = f.i AND n.i = n.last WHERE ui = 0 AND distance < 4 GROUP BY ALL),
tests AS (SELECT run, j FROM hits UNION SELECT run, j FROM t WHERE distance <= 3),
m AS (SELECT DISTINCT uk AS run, k AS module FROM f WHERE ui = 0 AND distance BETWEEN 1 AND 4 AND k <> uk),
c AS (SELECT DISTINCT uk AS run FROM f WHERE ui = 0 AND distance = 1 AND uk % 4 = 1),
fails AS (SELECT run FROM tests WHERE j % 7 = 0 AND j % 5 <> 0 UNION SELECT run FROM hits WHERE j % 7 = 0 AND j % 5 <> 0)
SELECT run AS run_id, 'test_impact' AS type, 'tests/test_p' || j || '.py::test_w' || j AS target, CASE WHEN j % 5 = 0 THEN 'UNVERIFIABLE' WHEN j % 7 = 0 OR (run, j) IN (SELECT (h.run, h.j) FROM hits h) THEN 'VERIFIED' ELSE 'REFUTED' END AS status FROM tests
UNION ALL SELECT run, 'module_impact', 'pkg/p' || module || '.py', CASE WHEN (run, module) IN (SELECT (h.run, h.j) FROM hits h WHERE h.j % 5 <> 0) OR run IN (SELECT h.run FROM hits h WHERE h.j // 2 = m.module AND h.j % 3 = 0 AND h.j > 0 AND h.j % 5 <> 0) THEN 'VERIFIED' ELSE 'UNVERIFIABLE' END FROM m
UNION ALL SELECT run, 'api_break', 'sym:pkg/p' || run || '.py::w' || run || '_0', 'VERIFIED' FROM c""")
def project_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Claims about a change of function 0 of each module, from its lines, and their verdicts."""
    nodes, edges = I.project(project_sources(spark, d))
    part = table(spark, d, "part").select("p_partkey")
    k, path = F.col("p_partkey"), lambda c: F.concat(F.lit("pkg/p"), c.cast("string"), F.lit(".py"))
    line = nodes.where("qualname = concat('w', regexp_extract(path, '[0-9]+', 0), '_0') and not is_test").select("path", (F.col("start") + 1).alias("line"), F.regexp_extract("path", "[0-9]+", 0).cast("bigint").alias("p_partkey"))
    changed = line.select(k.alias("run_id"), "path", "line")
    name = lambda c: F.concat(F.lit("tests/test_p"), c.cast("string"), F.lit(".py::test_w"), c.cast("string"))
    covered = part.select(k, name(k).alias("test_id")).unionAll(part.where("p_partkey % 3 = 0 and p_partkey > 0").select(F.expr("p_partkey div 2"), name(k)))
    coverage = covered.join(line, "p_partkey").select("test_id", F.col("path").alias("file"), "line")
    # every run runs all tests that it may select, but for those that are left out everywhere
    units = I.changed_units(nodes, changed)
    reach = I.static_reach(nodes, edges, units).where("is_test and distance <= 3").select("run_id", I.test_id().alias("test_id"))
    ran = reach.unionByName(coverage.join(changed.withColumnRenamed("path", "file"), ["file", "line"]).select("run_id", "test_id")).distinct()
    number = F.regexp_extract("test_id", "[0-9]+", 0).cast("bigint")
    outcomes = ran.where(number % 5 != 0).select("run_id", "test_id", F.when(number % 7 == 0, "failed").otherwise("passed").alias("outcome"))
    signatures = units.where("run_id % 4 = 1").select("run_id", F.col("id").alias("unit"), F.lit("new required parameter(s): extra").alias("incompatible"))
    return I.verdicts(nodes, edges, changed, coverage, outcomes, signatures)
