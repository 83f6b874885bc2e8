"""Queries of code analysis: sources are made from the parts table, a module for each brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import code as C
from riskloom.functions import generate as G
from riskloom.plans.registry import query, table


def sources(spark: SparkSession, d: str) -> DataFrame:
    """path, text of a small module for each part."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("import os\n\ndef f"), k, F.lit("(a, b=1):\n    if a > b and a != 3:\n        return a + b\n    return None\n\nclass C"), k, F.lit(":\n    def m(self):\n        return f"), k, F.lit("(2)\n"))
    return table(spark, d, "part").select(F.concat(F.lit("pkg/p"), k, F.lit(".py")).alias("path"), text.alias("text"))


_P = "FROM part"


@query(f"SELECT 'pkg/p' || p_partkey || '.py' AS path, replace(q, '?', CAST(p_partkey AS VARCHAR)) AS qualname, kind, CAST(a AS INTEGER) AS \"start\", CAST(b AS INTEGER) AS \"end\" FROM (SELECT p_partkey {_P}), (VALUES ('f?', 'function', 3, 6), ('C?', 'class', 8, 10), ('C?.m', 'method', 9, 10)) t(q, kind, a, b)")
def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with their intervals."""
    return C.symbols_of(sources(spark, d)).select("path", "qualname", "kind", "start", "end")


@query(f"SELECT 'pkg/p' || p_partkey || '.py' AS path, replace(q, '?', CAST(p_partkey AS VARCHAR)) AS qualname, CAST(c AS INTEGER) AS complexity FROM (SELECT p_partkey {_P}), (VALUES ('f?', 3), ('C?.m', 1)) t(q, c)")
def code_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Cyclomatic complexity."""
    return C.complexity_of(sources(spark, d)).select("path", "qualname", "complexity")


@query(f"SELECT 'pkg/p' || p_partkey || '.py' AS path, kind, 'chunk:pkg/p' || p_partkey || '.py#L' || a || '-' || b AS id FROM (SELECT p_partkey {_P}), (VALUES ('module', 1, 1), ('function', 3, 6), ('class', 8, 8), ('method', 9, 10)) t(kind, a, b)")
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of functions, classes and what is left."""
    return C.chunks_of(sources(spark, d)).select("path", "kind", "id")


@query()
def code_mutants(spark: SparkSession, d: str) -> DataFrame:
    """Mutants by operator; sources of mutants have no SQL (tests hold them against hand-made ones)."""
    return C.mutants_of(sources(spark, d)).groupBy("operator").agg(F.count("*").alias("n"))


@query(f"SELECT 'd' || p_partkey AS id, 'p' || p_partkey || '.py' AS path, 'modified' AS status, '2' AS added, '2' AS removed {_P}")
def diff_files(spark: SparkSession, d: str) -> DataFrame:
    """Files and lines of unified diffs."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("diff --git a/p"), k, F.lit(".py b/p"), k, F.lit(".py\n--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n d\n"))
    diffs = table(spark, d, "part").select(F.concat(F.lit("d"), k).alias("id"), text.alias("text"))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return C.diffs_of(diffs).select("id", "path", "status", join("added_lines").alias("added"), join("removed_lines").alias("removed"))


def varied_sources(spark: SparkSession, d: str) -> DataFrame:
    """path, text of a module for each part: one to four functions whose branches, loops and numbers come from the part's size."""
    text = F.expr("""concat('import os\nimport re\n\nLIMIT = ', cast(p_size as string), '\n', array_join(transform(sequence(0, p_size % 4), i -> concat(
        '\n\ndef work_', cast(i as string), '(amount, rate=2):\n    total = amount * ', cast(p_size + 2 as string), '\n',
        repeat(concat('    if total > ', cast(p_size + i as string), ':\n        total = total - rate\n'), cast((i + p_size) % 3 as int)),
        if(i % 2 = 1, '    for step in range(3):\n        total += step\n', ''), '    return total\n')), ''),
        '\n\ndef test_work_0():\n    assert work_0(1) >= 0\n')""")
    return table(spark, d, "part").select(F.concat(F.lit("pkg/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


@query("SELECT 'pkg/p' || p_partkey || '.py' AS path, 'work_' || i AS qualname, CAST(1 + (i + p_size) % 3 + i % 2 AS INTEGER) AS complexity FROM (SELECT *, unnest(generate_series(0, p_size % 4)) AS i FROM part) UNION ALL SELECT 'pkg/p' || p_partkey || '.py', 'test_work_0', 2 FROM part")
def varied_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Cyclomatic complexity of functions that differ from module to module; an assertion counts as a branch."""
    return C.complexity_of(varied_sources(spark, d)).select("path", "qualname", "complexity")


@query()
def generated_changes(spark: SparkSession, d: str) -> DataFrame:
    """Labelled changes of every category that a module gives; syntax trees have no SQL, tests run what the changes make."""
    made = G.changes_of(varied_sources(spark, d))
    return made.select("path", "category", "kind", "unit", "label", "proven", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber AS path, 'C4' AS category, 'revert:' || left(sha256(CAST(l_orderkey AS VARCHAR)), 12) AS kind, 1 AS label, 'rate = ' || l_linenumber AS text FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <> CAST(l_quantity AS INTEGER)")
def regression_changes(spark: SparkSession, d: str) -> DataFrame:
    """Fixes taken back (C4); a returned line stands for a fix of its number to its quantity."""
    line = table(spark, d, "lineitem").where("l_returnflag <> 'N'")
    text = lambda c: F.concat(F.lit("rate = "), F.col(c).cast("int").cast("string"))
    fixes = line.select(F.sha2(F.col("l_orderkey").cast("string"), 256).alias("sha"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"), text("l_linenumber").alias("before"), text("l_quantity").alias("after"))
    return G.regressions(fixes)
