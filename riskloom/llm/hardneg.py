"""Hard-negative mining (operator 13): a distributed kNN join over a Voronoi partition of norm-augmented vectors.

Scores are inner products of integer vectors, floor(SCALE * x). A vector x gets one more component, sqrt(M^2 - |x|^2), M the largest
norm; an anchor q gets a zero. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x: the best scores are the nearest neighbours.

1. Pivots are a bounded sample of rows (those of least hash). Every row lies in the cell of its nearest pivot; anchors form
   groups by theirs, with the group's radius and norms as its bounds.
2. A first look at a part of a group's own cell gives every anchor a score that it will surely reach; the least one is
   the group's need. A candidate can score at most (|q|^2 + M^2 - (d - radius)^2) / 2 with a group whose pivot is at distance
   d, so it is sent to the groups alone whose need that reaches.
3. Tiles are a part of a group's anchors (ANCHORS at most) by a part of a cell's candidates (CELL at most): a cell or group that
   holds many rows is many tiles. Each joins exactly and gives its best few for each anchor; a last window picks among them.
The join runs twice: for positives (best of the same label), then for negatives (best of other labels within the band that
a positive's score sets, whose upper end spares groups from below as well).

Rows with a null id, label or vector, or null or non-finite components take no part. A shorter vector has zeros where longer
ones go on. Repeated rows are rows of their own: others of one another, and each an anchor if its id says so. Ties in score go by
smaller vec_id. Anchors without positives, positives without negatives in their band, and empty tables give no rows. Scores are
exact: in doubles where no sum can pass 2^53, else in Python integers; one beyond 64 bits is an error.
Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.llm.common import small, stored
from riskloom.llm.vectors import lists, mapped, matrix, tiled, usable

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 100, 5, 10, 30, 90
#: Anchors and candidates of a tile, pivots at most and anchors for each.
ANCHORS, CELL, PIVOTS, EACH = 256, 8192, 1024, 64
ROW = "uid bigint, vec_id bigint, label int, v array<double>"


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(y) for y in row] for row in x], dtype=object).reshape(x.shape)
    return whole(a).dot(whole(b).T).astype(np.int64)  # raises beyond 64 bits


class Cells:
    """Pivots with their added component, and bounds on scores by distance."""

    def __init__(self, pivots: np.ndarray, most: float) -> None:
        """most: the largest squared norm."""
        self.most, self.pivots = most, self.lifted(pivots, most)

    @staticmethod
    def lifted(x: np.ndarray, most: float) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))])

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """Of each row to each pivot."""
        x = np.column_stack([x, np.zeros(len(x))]) if anchors else self.lifted(x, self.most)
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * (x @ self.pivots.T), 0))

    def bounds(self, distance: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of a candidate at each pivot's distance with anchors of squared norms low to high; rounding counts."""
        slack = 1 + 1e-6 * (self.most + high)
        return (low + self.most - (distance + radius) ** 2) / 2 - slack, (high + self.most - np.maximum(distance - radius, 0) ** 2) / 2 + slack


def best(score: np.ndarray, allowed: np.ndarray, tie: np.ndarray, uid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """row, column of each row's k best allowed scores, best first; ties by `tie`, then uid."""
    lowest = np.iinfo(np.int64).min
    held = np.where(allowed, score, lowest)
    if held.shape[1] > k:
        floor = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k, None]
        allowed = allowed & (held >= floor)
    row, column = np.nonzero(allowed)
    order = np.lexsort((uid[column], tie[column], -held[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _join(anchors: DataFrame, cells: DataFrame, sizes: DataFrame, frame, bounds: dict[int, tuple], match: Callable, k: int, name: str) -> DataFrame:
    """a, p, score, uid, vec_id: for each anchor row a (and its place p) its k best candidates.

    anchors: grp, cell (of its pivot), uid, label, v, want array<bigint> (pairs of least and greatest score, one for each place);
    cells: ROW and cell; sizes: cell, parts; frame: broadcast Cells; bounds: by group its radius, least and greatest squared norm;
    match: from the labels of anchors and candidates to the pairs that may be.
    """
    schema = "a bigint, p int, score bigint, uid bigint, vec_id bigint"

    def meet(key: tuple, table: pa.Table) -> dict:
        own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
        uid, vec_id, label = (table.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
        v, want = matrix(table.column("v")), table.column("want").to_pylist()
        x, y = np.flatnonzero(own), np.flatnonzero(~own)
        out: dict[str, list] = {c: [] for c in ("a", "p", "score", "uid", "vec_id")}
        if len(x) and len(y):
            s = scores(v[x], v[y])
            may = match(label[x][:, None], label[y]) & (uid[x][:, None] != uid[y])
            for p in range(max(len(want[i]) for i in x) // 2):
                has = np.array([i for i, r in enumerate(x) if len(want[r]) > 2 * p])
                low, high = (np.array([want[x[i]][2 * p + e] for i in has], np.int64)[:, None] for e in (0, 1))
                row, column = best(s[has], may[has] & (s[has] >= low) & (s[has] <= high), vec_id[y], uid[y], k)
                for c, values in (("a", uid[x[has[row]]]), ("p", np.full(len(row), p)), ("score", s[has][row, column]), ("uid", uid[y[column]]), ("vec_id", vec_id[y[column]])):
                    out[c].append(values)
        return {c: np.concatenate(found) if found else [] for c, found in out.items()}

    def dealt(candidates: DataFrame, groups: DataFrame) -> DataFrame:
        """Tiles of candidates (ROW, grp, cell, part) and the anchors of their groups."""
        places = small(stored(candidates.select("grp", "cell", "part").distinct(), f"{name}-tiles"))
        own = groups.select("grp", "sub", "uid", F.lit(None).cast("bigint").alias("vec_id"), "label", "v", "want").join(places, "grp")
        subs = small(groups.select("grp", "sub").distinct())
        empty = F.array().cast("array<bigint>")
        columns = ["grp", "sub", "cell", "part", "own", "uid", "vec_id", "label", "v", "want"]
        both = own.withColumn("own", F.lit(True)).select(columns).unionAll(candidates.join(subs, "grp").withColumns({"own": F.lit(False), "want": empty}).select(columns))
        return tiled(both, ["grp", "sub", "cell", "part"], schema, meet)

    subs = anchors.groupBy("grp").agg(F.ceil(F.count("*") / ANCHORS).alias("subs"))  # a row a pivot
    groups = stored(anchors.join(F.broadcast(subs), "grp").withColumn("sub", F.pmod(F.xxhash64("uid", F.lit(3)), "subs")).drop("subs"), f"{name}-anchors")
    # first look: the first part of the pivot's own cell
    parts = cells.join(small(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("uid", F.lit(4)), "parts"))
    near = dealt(parts.where("part = 0").withColumn("grp", F.col("cell")).join(small(groups.select("grp").distinct()), "grp").select("uid", "vec_id", "label", "v", "grp", "cell", "part"), groups)
    reached = near.groupBy("a", "p").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)
    wants = groups.select("grp", F.col("uid").alias("a"), F.posexplode(F.expr("transform(sequence(0, size(want) div 2 - 1), i -> struct(want[2 * i] as low, want[2 * i + 1] as high))")).alias("p", "w"))
    need = wants.join(reached, ["a", "p"], "left").groupBy("grp").agg(F.min(F.coalesce("low", F.col("w.low"))).alias("low"), F.max("w.high").alias("high")).collect()  # a row a pivot
    table = {r.grp: (*bounds[r.grp], r.low, r.high) for r in need}
    if not table:
        return cells.sparkSession.createDataFrame([], schema)
    at = np.array(sorted(table))
    radius, least, greatest, low, high = (np.array([table[g][i] for g in at], float) for i in range(5))

    def sent(batch: pa.RecordBatch) -> dict:
        worst, top = frame.value.bounds(frame.value.distances(matrix(batch.column("v")), False)[:, at], radius, least, greatest)
        row, g = np.nonzero((top >= low) & (worst <= high))
        return {c: batch.column(c).take(pa.array(row)) for c in ("uid", "vec_id", "label", "v", "cell", "part")} | {"grp": at[g]}

    # the window that dealt the parts is over: rows go out with their part, a row for each group they may serve
    return dealt(mapped(parts.select("uid", "vec_id", "label", "v", "cell", "part"), ROW + ", cell int, part bigint, grp int", sent), groups)


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows: vec_id, embedding, label."""
    spark = rows.sparkSession
    good = usable(rows.where("vec_id is not null and label is not null"), "vec_id", "label")
    scaled = F.transform(F.col("v").cast("array<double>"), lambda x: F.when(F.abs(x * SCALE) < 2.0**52, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))  # beyond, doubles are whole
    whole = stored(good.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.col("label").cast("int").alias("label"), scaled.alias("v")), "whole-vectors")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    anchor = F.col("vec_id") % every == 0
    facts = whole.agg(F.count_if(anchor).alias("anchors"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("most")).first()
    if not facts["anchors"]:
        return spark.createDataFrame([], schema)
    k = max(8, min(PIVOTS, facts["anchors"] // EACH))
    pivots = matrix(whole.orderBy(F.xxhash64("vec_id"), "uid").limit(k).select("v").toArrow().column("v"))
    frame = spark.sparkContext.broadcast(Cells(pivots, facts["most"]))

    def placed(batch: pa.RecordBatch, anchors: bool) -> dict:
        v = matrix(batch.column("v"))
        apart = frame.value.distances(v, anchors)
        at = apart.argmin(axis=1)
        out = {c: batch.column(c) for c in ("uid", "vec_id", "label")}
        return out | {"v": lists(v), "cell": at, "distance": apart[np.arange(len(at)), at], "norm": (v * v).sum(1)}

    cells = stored(mapped(whole, ROW + ", cell int", lambda b: placed(b, False)), "cells")
    sizes = stored(cells.groupBy("cell").agg(F.ceil(F.count("*") / CELL).alias("parts")), "cell-sizes")
    anchors = stored(mapped(whole.where(anchor), ROW + ", cell int, distance double, norm double", lambda b: placed(b, True)).withColumnRenamed("cell", "grp"), "anchors")
    stats = anchors.groupBy("grp").agg(F.max("distance").alias("radius"), F.min("norm").alias("low"), F.max("norm").alias("high")).collect()  # a row a pivot
    bounds = {r.grp: (r.radius, r.low, r.high) for r in stats}

    any_score = F.array(F.lit(-(2**63)), F.lit(2**63 - 1))
    asked = anchors.select("grp", "uid", "label", "v", any_score.alias("want"))
    pairs = _join(asked, cells, sizes, frame, bounds, lambda a, b: a == b, positives, "positives")
    order = W.partitionBy("a").orderBy(F.desc("score"), "vec_id", "uid")
    pairs = stored(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).select("a", "rank", "score", "vec_id"), "positives")
    # 30 p <= 100 n <= 90 p, in whole numbers; a positive of a negative score has no such n
    ends = pairs.where("score >= 0").select("a", "rank", "score", "vec_id", F.expr(f"cast(ceil(cast(score as decimal(20,0)) * {LOW} / 100) as bigint)").alias("low"), F.expr(f"cast(floor(cast(score as decimal(20,0)) * {HIGH} / 100) as bigint)").alias("high"))
    held = ends.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high", "vec_id", "score"))).alias("ends"))  # a few for each anchor
    held = stored(anchors.select("grp", "uid", "vec_id", "label", "v").join(held, F.col("uid") == F.col("a")).drop("a"), "bands")
    asked = held.select("grp", "uid", "label", "v", F.flatten(F.transform("ends", lambda e: F.array(e["low"], e["high"]))).alias("want"))
    found = _join(asked, cells, sizes, frame, bounds, lambda a, b: a != b, negatives, "negatives")
    order = W.partitionBy("a", "p").orderBy(F.desc("score"), "vec_id", "uid")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).withColumnRenamed("vec_id", "negative_id")
    own = held.select("uid", F.col("vec_id").alias("anchor_id"), "ends").withColumnRenamed("uid", "a")
    pick = F.col("ends")[F.col("p")]
    return found.select("a", "p", "rank", "negative_id", "score").join(own, "a").select("anchor_id", pick["vec_id"].alias("positive_id"), "rank", "negative_id", pick["score"].alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (SELECT a, b, s FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b))::INTEGER AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
QUALIFY rank <= 10
"""
