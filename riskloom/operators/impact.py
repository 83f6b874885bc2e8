"""From sources to verdicts: parsed modules become a graph, changed lines become units, claims and what execution says of them.

All changes are worked on together, keyed by run_id, over one project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.code import outlines_of
from riskloom.functions.scalars import is_test_path
from riskloom.operators import verification as V
from riskloom.operators.graph import cut, resolve_modules, structure_edges, walk
from riskloom.operators.relations import innermost

#: Steps of calls from a change to the tests and to the modules that it may reach, and kinds of edges that carry it.
TEST_DEPTH, MODULE_DEPTH, CARRY = 4, 4, ["calls", "inherits"]


def project(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sources (path, text), each module parsed once; both stored.

    nodes: id, path, qualname, name, kind, parent, start, end, signature, is_test; edges: src, dst, type, confidence.
    """
    parsed = cut(outlines_of(sources))
    symbols = parsed.select("path", F.explode("symbols").alias("s")).select("path", "s.*", is_test_path(F.col("path")).alias("is_test"))
    found = resolve_modules(parsed.select(F.col("path").alias("importer"), F.explode("imports").alias("i")).select("importer", "i.module", "i.level"), sources)
    ident = F.concat(F.lit("sym:"), F.col("path"), F.lit("::"), F.col("qualname"))
    nodes = symbols.select(ident.alias("id"), "path", "qualname", "name", "kind", "parent", "start", "end", "signature", "is_test")
    return nodes, cut(structure_edges(symbols, cut(found.select("importer", "path"))))


def changed_units(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """run_id, id, path of the innermost symbols that hold changed lines (run_id, path, line); lines outside all symbols change none."""
    points = changed.select("run_id", "path", "line").distinct()
    return innermost(points, nodes.select("id", "path", "start", "end"), "path", "line", "start", "end", "start").select("run_id", "id", "path").distinct()


def static_reach(nodes: DataFrame, edges: DataFrame, units: DataFrame, depth: int = TEST_DEPTH) -> DataFrame:
    """run_id, unit, node, distance, path, is_test: symbols that come to a changed unit by calls and inheritance, at their least distance.

    A unit of several runs is walked from once.
    """
    carried = edges.where(F.col("type").isin(CARRY))
    found = walk(carried, units.select(F.col("id").alias("seed")), depth, reverse=True, every=1)
    rows = found.join(nodes.select(F.col("id").alias("node"), "path", "is_test", "kind"), "node").where("kind <> 'class'")
    return rows.join(units.select("run_id", F.col("id").alias("seed")).distinct(), "seed").select("run_id", F.col("seed").alias("unit"), "node", "distance", "path", "is_test")


def test_id(path: str = "path", node: str = "node"):
    """path::name of a test's symbol, as runners name it."""
    return F.concat(F.col(path), F.lit("::"), F.replace(F.substring_index(node, "::", -1), F.lit("."), F.lit("::")))


def verdicts(nodes: DataFrame, edges: DataFrame, changed: DataFrame, coverage: DataFrame, outcomes: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """run_id, type, target, status of the claims that the rules make about each run, as execution settles them.

    changed: run_id, path, line; coverage: test_id, file, line (of the project before the change); outcomes: run_id, test_id, outcome of the
    tests that were run; signatures: run_id, unit (id), incompatible (why callers may break, else null) of changed signatures.
    """
    units = cut(changed_units(nodes, changed))
    lines = changed.select("run_id", F.col("path").alias("file"), "line").distinct()
    hits = cut(coverage.join(lines, ["file", "line"]).select("run_id", "test_id", "file", "line").distinct())
    reach = cut(static_reach(nodes, edges, units, max(TEST_DEPTH, MODULE_DEPTH)))
    near = reach.where("is_test").groupBy("run_id", test_id().alias("test_id")).agg(F.min("distance").alias("distance"))
    own = units.select("run_id", "path").distinct()
    modules = reach.where(~F.col("is_test") & (F.col("distance") <= MODULE_DEPTH)).join(own, ["run_id", "path"], "left_anti").select("run_id", "path", F.concat(F.lit("graph:calls:"), "node", F.lit("->"), "unit").alias("evidence"))
    callers = reach.where("distance = 1 and not is_test").select("run_id", F.col("unit").alias("target"), F.col("node").alias("caller"))
    broken = signatures.where("incompatible is not null").withColumnRenamed("unit", "target") if signatures is not None else units.select("run_id", F.col("id").alias("target"), F.lit(None).cast("string").alias("incompatible")).limit(0)
    claims = V.impact_claims(hits, near, modules, broken.join(callers, ["run_id", "target"]))
    claims = cut(claims.withColumn("claim_id", F.concat_ws("|", F.col("run_id").cast("string"), "type", "target")))
    none = hits.select("run_id", "test_id", F.col("file").alias("mutant")).limit(0)
    of = lambda kind: claims.where(F.col("type") == kind).select("run_id", "claim_id", "target")
    tests = V.check_test_impact(of("test_impact"), outcomes, hits, none)
    executed = coverage.select("test_id", "file").distinct().join(outcomes.select("run_id", "test_id").distinct(), "test_id").select("run_id", "test_id", "file")
    impacts = V.check_module_impact(of("module_impact"), modules, executed, hits)
    breaks = V.check_api_break(of("api_break"), broken, callers, outcomes)
    judged = tests.select("run_id", "claim_id", "status").unionByName(impacts).unionByName(breaks)
    return claims.join(judged, ["run_id", "claim_id"]).select("run_id", "type", "target", "status")
