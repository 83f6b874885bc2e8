"""Embedding near-dedup (operator 11): a subspace pigeonhole join of rotated unit vectors.

1. Equal vectors are one node with a count, so that copies cost nothing later.
2. Unit vectors are rotated to principal axes, which are dealt to blocks of about eight dimensions so that every block begins
   with one of the strongest. Vectors of cosine t are at squared distance 2 (1 - t); each block has a share of it as its budget, in
   proportion to its variance. Two vectors within the whole distance are within the budget of at least one block.
3. Range join of each block: a grid over its leading axes with cells of four radii. A vector is at home in one cell and visits
   those before it that its ball touches. A cell's residents meet all who are in it, in tiles of at most TILE by TILE vectors, so that
   a cell that holds many vectors is many tasks. In a tile, pairs within the block's budget are candidates.
4. Candidates are verified exactly, by the cosine of the vectors themselves. A pair counts in the first block whose
   budget it keeps, so that it counts once, for either end. Tiles give sums of links and a spanning forest, never pairs.
5. Forests become components by distributed union-find.

The axes are fitted on a bounded sample (SAMPLE vectors, those of least hash), as is the number of grid axes on the number of
nodes; both change the work only. The pigeonhole rule holds for any rotation and any budgets, so no link is lost.

Null vectors, zero vectors and those with null or non-finite components link with nothing: 0 links, a component of their own.
A shorter vector has zeros where longer ones go on. Rows repeated with one vec_id are vectors of their own that link. A null
vec_id is never a component's id nor kept, unless its row stands alone (component null). An empty table gives no rows.
Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import components, small, stored
from riskloom.llm.vectors import mapped, matrix, tiled, usable

THRESHOLD, BLOCK, TILE, SAMPLE, AXES = 0.95, 8, 8192, 4096, 4
#: What rounding may add to a squared distance of unit vectors.
SLACK = 1e-9
#: The same in single precision.
ROUGH = 1e-5
#: Bits of a cell's place on an axis.
PLACE = 15


class Blocks:
    """The rotation and, of each block, its budget and the grid of its leading axes."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float) -> None:
        """sample: unit vectors; n: how many vectors there are."""
        d = sample.shape[1]
        self.m = m = max(1, d // BLOCK)
        self.size = -(-d // m)
        values, axes = np.linalg.eigh(sample.T @ sample / max(len(sample), 1))
        order = np.argsort(-values)
        values, axes = np.append(values[order], np.zeros(m * self.size - d)), np.column_stack([axes[:, order], np.zeros((d, m * self.size - d))])
        dealt = np.concatenate([np.arange(m * self.size).reshape(self.size, m)[i][:: 1 if i % 2 == 0 else -1] for i in range(self.size)]).reshape(self.size, m).T
        values, self.axes = np.maximum(values[dealt], 0), axes[:, dealt.ravel()]
        spread = values.sum(1) + 1e-3 * values.sum() / m + 1e-12
        self.budget = (2 * (1 - threshold) + SLACK) * spread / spread.sum()
        self.width = 4 * np.sqrt(self.budget)
        cells = np.maximum(1, 4 * np.sqrt(values) / self.width[:, None])
        wanted = max(1, n / TILE)
        self.grid = [next((g for g in range(1, min(AXES, self.size) + 1) if cells[j, :g].prod() >= wanted), min(AXES, self.size)) for j in range(m)]

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        """Coordinates by block (n, m, size). einsum sums each row alike whatever the rows beside it, so that all tiles agree."""
        return np.einsum("ij,jk->ik", unit, self.axes).reshape(len(unit), self.m, self.size)

    def cells(self, rotated: np.ndarray) -> tuple[np.ndarray, ...]:
        """row, block, cell, home of the cells at home and of those visited: what the vector's ball touches, up to its home in number.

        Two vectors within a block's budget are in each other's cells, so that it is enough if one of them visits the other.
        """
        found = []
        for j in range(self.m):
            x, width, most = rotated[:, j, : self.grid[j]], self.width[j], self.budget[j] + SLACK
            place = np.floor(x / width).astype(np.int64)
            home = _packed(place)
            for step in np.ndindex(*(3,) * self.grid[j]):
                near = place + np.array(step) - 1
                apart = np.maximum(np.maximum(near * width - x, x - (near + 1) * width), 0)
                cell, own = _packed(near), all(s == 1 for s in step)
                row = np.flatnonzero(((apart**2).sum(1) <= most) & ((cell < home) | own))
                found.append((row, np.full(len(row), j), cell[row], np.full(len(row), own)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _packed(place: np.ndarray) -> np.ndarray:
    """One number for places on up to four axes."""
    out = np.zeros(len(place), np.int64)
    for column in place.T:
        out = (out << PLACE) | (column & ((1 << PLACE) - 1))
    return out


def unit(v: np.ndarray) -> np.ndarray:
    """Rows by their norm; scaled first, so that squares neither overflow nor vanish."""
    v = v.astype(float)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n nodes' components under links a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tile_links(blocks: Blocks, block: int, threshold: float, x: np.ndarray, y: np.ndarray, may: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y (vectors) of the links that count in a block: verified, and within no earlier block's budget.

    may: for a slice of x, by columns y, which pairs to look at; all without it. What single precision and a part of the axes rule out
    with room for rounding is not looked at again; what is left is decided in double precision.
    """
    ux, uy = unit(x), unit(y)
    rx, ry = ((u.astype(np.float32) @ blocks.axes.astype(np.float32)).reshape(len(u), blocks.m, blocks.size) for u in (ux, uy))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    bx, by = (np.ascontiguousarray(r[:, block]) for r in (rx, ry))
    others = [(block + k) % blocks.m for k in range(1, min(3, blocks.m))]
    ox, oy = (np.ascontiguousarray(r[:, others].reshape(len(r), -1)) for r in (rx, ry))
    ny, whole = (by * by).sum(1), np.float32(2 * (1 - threshold) + ROUGH)
    for at in range(0, len(bx), 256):
        part = bx[at : at + 256]
        apart = part @ (-2 * by.T)
        apart += (part * part).sum(1)[:, None]
        apart += ny
        near = apart <= np.float32(blocks.budget[block] + ROUGH)
        if may is not None:
            near &= may(slice(at, at + 256))
        i, j = np.divmod(np.flatnonzero(near), near.shape[1])
        i += at
        for k in range(0, len(i), 1 << 18):
            p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            left = ((ox[p] - oy[q]) ** 2).sum(1) <= whole
            p, q = p[left], q[left]
            for h in range(0, len(p), 1 << 15):
                a, b = p[h : h + (1 << 15)], q[h : h + (1 << 15)]
                good = (ux[a] * uy[b]).sum(1) >= threshold
                a, b = a[good], b[good]
                keeps = ((blocks.rotated(ux[a]) - blocks.rotated(uy[b])) ** 2).sum(2) <= blocks.budget
                good = keeps[:, block] & ~keeps[:, :block].any(1)
                found.append((a[good], b[good]))
    return (np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, n (of vectors of other nodes that are linked), root (of the tile's forest) of nodes (node, n, v), several rows a node."""
    spark = nodes.sparkSession
    total = nodes.count()
    if not total:
        return spark.createDataFrame([], "node bigint, n bigint, root bigint")
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").toArrow().column("v")
    blocks = spark.sparkContext.broadcast(Blocks(unit(matrix(sample)), total, threshold))

    def touched(batch: pa.RecordBatch, vectors: bool) -> dict:
        row, block, cell, home = blocks.value.cells(blocks.value.rotated(unit(matrix(batch.column("v")))))
        out = {"block": block, "cell": cell, "home": home}
        return out | ({c: batch.column(c).take(pa.array(row)) for c in ("node", "n", "v")} if vectors else {})

    schema = "block int, cell bigint, home boolean"
    counts = mapped(nodes, schema, lambda b: touched(b, False)).groupBy("block", "cell").agg(F.count("*").alias("all"), F.sum(F.col("home").cast("long")).alias("own"))
    counts = stored(counts.where("own > 0 and all > 1").select("block", "cell", F.ceil(F.col("own") / TILE).alias("rows"), F.ceil(F.col("all") / TILE).alias("columns")), "cells")
    rows = mapped(nodes, schema + f", node bigint, n bigint, v {nodes.schema['v'].dataType.simpleString()}", lambda b: touched(b, True)).join(small(counts), ["block", "cell"])
    # a resident is in a row of the cell's tiles and, like a visitor, in a column; a copy goes to each tile, one where they cross
    row, column = F.pmod(F.xxhash64("node", F.lit(1)), "rows"), F.pmod(F.xxhash64("node", F.lit(2)), "columns")
    place = lambda i, j: F.struct(i.alias("i"), j.alias("j"), (F.col("home") & (i == row)).alias("own"), (j == column).alias("other"), F.col("home").alias("home"))
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: place(i, column))
    across = F.filter(F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: place(row, j)), lambda t: F.col("home") & ~t["other"])
    rows = rows.select("block", "cell", "node", "n", "v", F.explode(F.concat(down, across)).alias("t")).select("block", "cell", "t.*", "node", "n", "v")

    def meet(key: tuple, table: pa.Table) -> dict:
        node, n, v = table.column("node").to_numpy(), table.column("n").to_numpy(), matrix(table.column("v"))
        home = table.column("home").to_numpy()
        x, y = (np.flatnonzero(table.column(c).to_numpy()) for c in ("own", "other"))
        # residents meet one another once, in order of node, and every visitor
        p, q = tile_links(blocks.value, key[0], threshold, v[x], v[y], lambda some: (node[x[some]][:, None] < node[y]) | ~home[y]) if len(x) and len(y) else (x[:0], y[:0])
        linked, place = np.unique(np.concatenate([node[x[p]], node[y[q]]]), return_inverse=True)
        sums = np.bincount(place, np.concatenate([n[y[q]], n[x[p]]]), len(linked)).astype(np.int64) if len(p) else np.zeros(0, np.int64)
        return {"node": linked, "n": sums, "root": linked[forest(place[: len(p)], place[len(p) :], len(linked))]}

    return tiled(rows, ["block", "cell", "i", "j"], "node bigint, n bigint, root bigint", meet)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of rows (vec_id, embedding)."""
    every = stored(rows.select("vec_id", "embedding", F.monotonically_increasing_id().alias("uid")), "vectors-read")
    good = usable(every, "vec_id", "uid").where(F.exists("v", lambda x: x != 0))
    nodes = stored(good.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = stored(links(nodes.select("node", "n", "v"), threshold), "vector-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    sums = found.groupBy("node").agg(F.sum("n").alias("others"))
    whole = nodes.drop("v").join(sums, "node", "left").join(roots, "node", "left").select("node", "low", "n", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "node").alias("root"))
    whole = whole.join(whole.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    known = good.join(nodes.select("v", "node"), "v").select("uid", "vec_id", "node").join(whole.select("node", (F.col("n") - 1 + F.col("others")).alias("n_links"), "component_id"), "node")
    alone = every.join(known.select("uid"), "uid", "left_anti").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = known.select("vec_id", "n_links", "component_id").unionAll(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON c.a = e.vec_id
"""
