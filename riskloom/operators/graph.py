"""Operators on property graphs: nodes and edges are two tables, walks are joins of a frontier with the edges.

A walk keeps the least distance to each node, so that cycles end; each level is one join and one anti-join, and every
few levels the state is written to the shared folder and read again. The depth of walks is bounded by the caller.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.operators.storage import stored


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a table in the shared folder."""
    return stored(df, "cut")


def neighbours(edges: DataFrame, seeds: DataFrame, types: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """seed, node, type of each edge at the seeds; parallel edges stay."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return e.select(F.col(a).alias("seed"), F.col(b).alias("node"), "type").join(seeds.select("seed"), "seed")


def walk(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False, every: int = 3) -> DataFrame:
    """seed, node, distance: what each seed reaches in at most `depth` steps, at its least distance; the seed itself is left out.

    edges: src, dst; seeds: seed. Seeds without edges have no rows. After `every` steps the front is stored: with 1 no step is done again.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = edges.select(F.col(a).alias("node"), F.col(b).alias("to")).distinct()
    e = cut(e) if every == 1 else e
    front = seeds.select("seed").distinct().withColumn("node", F.col("seed"))
    seen = front.withColumn("distance", F.lit(0))
    for k in range(1, depth + 1):
        front = front.join(e, "node").select("seed", F.col("to").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        if k % every == 0 and k < depth:
            front = cut(front)
            if front.isEmpty():
                break
        seen = seen.unionAll(front.withColumn("distance", F.lit(k)))
        if every > 1 and k % every == 0 and k < depth:
            seen = cut(seen)
    return seen.where("distance > 0")


def neighbourhood(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, distance around many seeds, forward walks and backward walks, directions never mixed; unknown seeds are ignored."""
    known = seeds.select("seed").join(nodes.select(F.col("id").alias("seed")), "seed", "left_semi")
    start = known.select(F.col("seed").alias("node"), F.lit(0).alias("distance"))
    both = walk(edges, known, depth).unionByName(walk(edges, known, depth, reverse=True)).select("node", "distance")
    return start.unionByName(both).groupBy("node").agg(F.min("distance").alias("distance"))


def shortest_path(edges: DataFrame, source, target, depth: int) -> DataFrame:
    """path (array of nodes), or no row if there is none within depth; of equal paths the least by its nodes."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    e = edges.select("src", "dst").distinct()
    front = spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.array(F.lit(source).cast(kind)).alias("path"))
    seen = front
    for _ in range(depth):
        step = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        front = step.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(front)
    return seen.where(F.col("node") == F.lit(target).cast(kind)).select("path").limit(1)


def closure(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """seed, node of all that a seed reaches, itself included, in at most `depth` steps if given; cycle-safe. It ends when nothing new is reached."""
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    seen = seeds.select("seed", F.col("seed").alias("node")).distinct()
    front = seen
    for _ in count() if depth is None else range(depth):
        front = cut(front.join(e, "node").select("seed", F.col("to").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def topological_layers(edges: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(layers, cyclic): node, layer by longest path from a root; and the nodes that stand on or behind a cycle.

    edges: src before dst. It ends when no node is ready; with a depth, after that many layers at most, what lies deeper being
    among the second.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    layers, left = None, nodes
    e = edges.select("src", "dst").distinct()
    for k in count() if depth is None else range(depth):
        blocked = e.join(left.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        ready = cut(left.join(blocked, "node", "left_anti"))
        if ready.isEmpty():
            break
        layer = ready.withColumn("layer", F.lit(k))
        layers = layer if layers is None else layers.unionByName(layer)
        left = cut(left.join(ready, "node", "left_anti"))
    if layers is None:
        layers = nodes.withColumn("layer", F.lit(0)).limit(0)
    return layers, left


def cycles(edges: DataFrame) -> DataFrame:
    """members (sorted), path: every simple cycle of a prerequisite graph once for each set of members.

    edges: src before dst. First what stands on no cycle goes, from both ends, until nothing more does. Then paths grow from
    their least node among the rest and close where they return to it. Paths end when they close or meet themselves, so the
    number of steps is bounded by the largest cycle; a graph with very many cycles has as many rows.
    """
    e = edges.select("src", "dst").distinct()
    while True:
        left = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        done = left.count() == e.count()
        e = left
        if done:
            break
    front = e.where("dst >= src").select(F.array("src").alias("path"), F.col("dst").alias("next"))
    found = None
    while not front.isEmpty():
        closed = front.where("next = path[0]").select(F.array_sort("path").alias("members"), "path")
        found = closed if found is None else found.unionByName(closed)
        grown = front.where("next > path[0] and not array_contains(path, next)").select(F.array_append("path", F.col("next")).alias("path"))
        front = cut(grown.join(e, F.element_at("path", -1) == F.col("src")).where("dst >= path[0]").select("path", F.col("dst").alias("next")))
    if found is None:
        found = front.select(F.array_sort("path").alias("members"), "path")
    return found.groupBy("members").agg(F.min("path").alias("path"))


def enclosing(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, symbol: the longest known prefix of each dotted name."""
    prefixes = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\."))), lambda k: F.array_join(F.slice(F.split("name", r"\."), 1, k), "."))).alias("symbol"))
    return prefixes.join(known.select(F.col("qualname").alias("symbol")).distinct(), "symbol", "left_semi").groupBy("name").agg(F.max_by("symbol", F.length("symbol")).alias("symbol"))


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """importer, module, path of imports: the first that exists of module.py, module/__init__.py and both under src/.

    imports: importer (path), module, level (0 for absolute).
    """
    folder = F.split(F.col("importer"), "/")
    base = F.array_join(F.slice(folder, 1, F.greatest(F.size(folder) - F.col("level"), F.lit(0))), "/")
    name = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    stem = F.when(F.col("level") > 0, F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(name, F.lit("")))).otherwise(name)
    tries = F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")), F.concat(F.lit("src/"), stem, F.lit(".py")), F.concat(F.lit("src/"), stem, F.lit("/__init__.py")))
    probes = imports.select("importer", "module", "level", F.posexplode(tries).alias("place", "path"))
    return probes.join(files.select("path").distinct(), "path", "left_semi").groupBy("importer", "module", "level").agg(F.min_by("path", "place").alias("path"))


def structure_edges(symbols: DataFrame, imports: DataFrame, limit: int = 3) -> DataFrame:
    """src, dst, type, confidence: contains, calls and inherits edges of symbols, imports edges of files.

    symbols: path, qualname, name, kind, parent, is_test, calls, bases. A call goes to an imported file's symbol, else
    one of its own file, else a sibling method, else to at most `limit` others that are no tests, 1/n each.
    """
    from riskloom.operators.relations import resolve_tiers

    ident = lambda p, q: F.concat(F.lit("sym:"), F.col(p), F.lit("::"), F.col(q))
    s = symbols.withColumn("id", ident("path", "qualname"))
    contains = s.select(F.when(F.col("parent").isNull(), F.concat(F.lit("file:"), F.col("path"))).otherwise(ident("path", "parent")).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("type"), F.lit(1.0).alias("confidence"))
    files = imports.select(F.concat(F.lit("file:"), F.col("importer")).alias("src"), F.concat(F.lit("file:"), F.col("path")).alias("dst"), F.lit("imports").alias("type"), F.lit(1.0).alias("confidence")).distinct()
    target = s.select(F.col("id").alias("target"), F.col("path").alias("tpath"), "name", F.col("parent").alias("tparent"), F.col("is_test").alias("ttest"))

    def resolved(column: str, kind: str) -> DataFrame:
        refs = s.select(F.col("id").alias("src"), "path", "parent", F.explode(column).alias("name")).distinct()
        via = imports.select(F.col("importer").alias("path"), F.col("path").alias("tpath")).distinct()
        near = refs.join(target.withColumn("path", F.col("tpath")), ["name", "path"]).where("src <> target")
        # of names that more files define than the limit and one allow, no far candidate can count
        few = target.where("not ttest").groupBy("name").agg(F.countDistinct("tpath").alias("n")).where(F.col("n") <= limit + 1).select("name")
        far = refs.join(target.join(few, "name", "left_semi"), "name").where("src <> target")
        tiers = [refs.join(via, "path").join(target, ["name", "tpath"]).where("src <> target"), near.where("tparent is null"), near.where("parent = tparent"), far.where("not ttest and path <> tpath")]
        return resolve_tiers(tiers, ["src", "name"], "target", limit).select("src", F.col("target").alias("dst"), F.lit(kind).alias("type"), "confidence")

    return contains.unionByName(files).unionByName(resolved("calls", "calls")).unionByName(resolved("bases", "inherits"))


def linked_history(items: DataFrame, known: DataFrame, limit: int = 12) -> DataFrame:
    """node, doc, place: history of each node: fixes, issues, introducers, then newest commits, issues, changes; once each, known only.

    items: node, doc, rank (0 fixes, 1 issues, 2 introducers, 3 commits, 4 issues of commits, 5 changes), ts.
    """
    k = items.join(known.select("doc"), "doc", "left_semi").groupBy("node", "doc").agg(F.min(F.struct("rank", (-F.unix_timestamp("ts")).alias("age"))).alias("o"))
    place = F.row_number().over(W.partitionBy("node").orderBy("o.rank", "o.age", "doc"))
    return k.withColumn("place", place).where(F.col("place") <= limit).select("node", "doc", "place")


def ego_network(edges: DataFrame, seed: str, commits: int = 6, tests: int = 12) -> DataFrame:
    """The edges around a node without contains, with at most so many commits and tests."""
    e = edges.where("type <> 'contains'").where((F.col("src") == seed) | (F.col("dst") == seed))
    kind = F.when(F.col("type").isin("modified_by", "changes"), "commit").when(F.col("type") == "tests", "test").otherwise("other")
    rn = F.row_number().over(W.partitionBy("kind").orderBy("src", "dst", "type"))
    ranked = e.withColumn("kind", kind).withColumn("_rn", rn)
    return ranked.where((F.col("kind") == "other") | ((F.col("kind") == "commit") & (F.col("_rn") <= commits)) | ((F.col("kind") == "test") & (F.col("_rn") <= tests))).drop("kind", "_rn")
