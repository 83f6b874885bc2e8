"""Queries of graph operators: parts, suppliers and nations are nodes; supply and co-supply are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import graph as G
from riskloom.plans.registry import query, table

#: A part is followed by parts of the same order: an edge from each line to the next of its order.
_E = "e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    a = l.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    return a.join(l.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst")), ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()


def _walk_sql(seed: str, depth: int, a: str = "src", b: str = "dst") -> str:
    return f"WITH RECURSIVE {_E}, w(seed, node, d) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE {seed} UNION SELECT seed, {b}, d + 1 FROM w JOIN e ON {a} = node WHERE d < {depth})"


@query(f"{_walk_sql('p_partkey % 50 = 0', 3)} SELECT seed, node, min(d) AS distance FROM w GROUP BY 1, 2 HAVING min(d) > 0")
def callees(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first search within three steps, the least distance, the start left out."""
    seeds = table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("seed"))
    return G.walk(edges(spark, d), seeds, 3).select("seed", "node", F.col("distance").cast("int").alias("distance"))


@query(f"{_walk_sql('p_partkey % 50 = 0', 2, 'dst', 'src')} SELECT seed, node, min(d) AS distance FROM w GROUP BY 1, 2 HAVING min(d) > 0")
def callers(spark: SparkSession, d: str) -> DataFrame:
    """The same against the edges: who reaches a node."""
    seeds = table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("seed"))
    return G.walk(edges(spark, d), seeds, 2, reverse=True).select("seed", "node", F.col("distance").cast("int").alias("distance"))


@query(f"WITH RECURSIVE {_E}, f(node, d) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 50 = 0 UNION SELECT dst, d + 1 FROM f JOIN e ON src = node WHERE d < 2), b(node, d) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 50 = 0 UNION SELECT src, d + 1 FROM b JOIN e ON dst = node WHERE d < 2) SELECT node, min(d) AS distance FROM (SELECT * FROM f UNION ALL SELECT * FROM b) GROUP BY 1")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Two hops around several seeds, directions not mixed; seed -1 is unknown and ignored."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    seeds = part.where("id % 50 = 0").select(F.col("id").alias("seed")).unionAll(spark.createDataFrame([(-1,)], "seed long"))
    return G.neighbourhood(edges(spark, d), part, seeds, 2).select("node", F.col("distance").cast("int").alias("distance"))


@query("WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS type FROM lineitem WHERE l_returnflag IN ('R', 'A')), s AS (SELECT p_partkey AS seed FROM part) SELECT seed, count(*) AS n_out, count(DISTINCT dst) AS n_distinct FROM e JOIN s ON src = seed GROUP BY 1")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of every part over edges of two types; parallel edges stay."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"))
    seeds = table(spark, d, "part").select(F.col("p_partkey").alias("seed"))
    return G.neighbours(e, seeds, ["R", "A"]).groupBy("seed").agg(F.count("*").alias("n_out"), F.countDistinct("node").alias("n_distinct"))


@query(f"WITH RECURSIVE {_E}, w(node, path) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)] UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN e ON src = node WHERE len(path) <= 3 AND NOT list_contains(path, dst)) SELECT CAST(min(len(path)) - 1 AS INTEGER) AS hops FROM w WHERE node = (SELECT max(node) FROM (SELECT DISTINCT node FROM w WHERE len(path) = 3))")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """Hops of a shortest path to the greatest node within two steps of the first."""
    e = edges(spark, d)
    near = G.walk(e, spark.createDataFrame([(1,)], "seed long"), 2)
    two = e.withColumnRenamed("src", "m").withColumnRenamed("dst", "t").join(e.where("src = 1").select(F.col("dst").alias("m")), "m").where("t <> 1")
    goal = two.agg(F.max("t")).first()[0] or near.agg(F.max("node")).first()[0]
    return G.shortest_path(e, 1, goal, 3).select((F.size("path") - 1).alias("hops"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'part' AS kind FROM part UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'nation' FROM nation UNION ALL SELECT coalesce(nullif(o_orderstatus, 'P'), '?') FROM orders) GROUP BY 1")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind; a missing kind is "?"."""
    one = lambda n: table(spark, d, n).select(F.lit(n).alias("kind"))
    o = table(spark, d, "orders").select(F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("?")).alias("kind"))
    return one("part").unionAll(one("supplier")).unionAll(one("nation")).unionAll(o).groupBy("kind").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE r AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1), w(seed, node) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT seed, dst FROM w JOIN r ON src = node) SELECT seed, node FROM w")
def path_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The transitive closure of renames."""
    p = table(spark, d, "part")
    r = p.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return G.closure(r, p.select(F.col("p_partkey").alias("seed")))


@query("WITH RECURSIVE r AS (SELECT p_partkey // 3 AS src, p_partkey AS dst FROM part WHERE p_partkey > 2), w(node, layer) AS (SELECT DISTINCT src, 0 FROM r WHERE src NOT IN (SELECT dst FROM r) UNION SELECT dst, layer + 1 FROM w JOIN r ON src = node) SELECT node, max(layer) AS layer FROM w GROUP BY 1")
def prerequisite_layers(spark: SparkSession, d: str) -> DataFrame:
    """Topological layers by longest path."""
    r = table(spark, d, "part").where("p_partkey > 2").select(F.expr("p_partkey div 3").alias("src"), F.col("p_partkey").alias("dst"))
    return G.topological_layers(r)[0].select("node", F.col("layer").cast("int").alias("layer"))


@query("SELECT c_custkey AS node, o_orderkey AS doc, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY rank, ts DESC, o_orderkey) AS INTEGER) AS place FROM (SELECT o_custkey AS c_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 2 ELSE 3 END AS rank, o_orderdate AS ts FROM orders WHERE o_totalprice > 50000) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY rank, ts DESC, o_orderkey) <= 12")
def linked_history(spark: SparkSession, d: str) -> DataFrame:
    """History of each node in order of kind and age, twelve at most."""
    o = table(spark, d, "orders")
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    items = o.select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("doc"), rank.alias("rank"), F.col("o_orderdate").alias("ts"))
    return G.linked_history(items, o.where("o_totalprice > 50000").select(F.col("o_orderkey").alias("doc")))


@query("WITH n AS (SELECT DISTINCT p_type AS name FROM part), x AS (SELECT name, array_to_string(string_split(name, ' ')[1:k], ' ') AS s FROM n, (SELECT unnest(range(1, 6)) AS k) WHERE k <= len(string_split(name, ' '))) SELECT name, max_by(s, length(s)) AS symbol FROM x WHERE length(s) <= 12 GROUP BY 1")
def enclosing_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The longest known prefix of a dotted name."""
    dotted = lambda c: F.replace(c, F.lit(" "), F.lit("."))
    n = table(spark, d, "part").select(dotted(F.col("p_type")).alias("name")).distinct()
    pre = n.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\."))), lambda k: F.array_join(F.slice(F.split("name", r"\."), 1, k), "."))).alias("qualname")).where(F.length("qualname") <= 12)
    back = lambda c: F.replace(F.col(c), F.lit("."), F.lit(" ")).alias(c)
    return G.enclosing(n, pre).select(back("name"), back("symbol"))


@query("SELECT 's' || CAST(s_suppkey AS VARCHAR) AS src, 'n' || CAST(s_nationkey AS VARCHAR) AS dst FROM supplier WHERE s_nationkey = 3")
def ego_network(spark: SparkSession, d: str) -> DataFrame:
    """The edges around a node."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"), F.lit("in").alias("type"))
    return G.ego_network(s, "n3").select("src", "dst")
