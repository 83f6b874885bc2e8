"""Approximate nearest neighbours: an inverted file of cells with product-quantised residuals, for any number of queries.

Cells and codebooks are fitted on a bounded sample (SAMPLE vectors of least hash); every row is indexed. A query looks into its
nearest cells, ranks their rows by table look-ups (the inner product of unit vectors is that with the cell's centre plus one number
for each part of the code), and the best `depth` of all cells are ranked again by the vectors themselves. How many cells a query looks
into is chosen on the sample: the fewest with which its own neighbours are found at the recall asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from riskloom.operators.retrieval import best, cosine
from riskloom.operators.storage import stored
from riskloom.session import importable

_INT, _BINARY, _DOUBLE = IntegerType(), BinaryType(), DoubleType()
SAMPLE, PARTS, CODES, CHUNK, DEPTH = 20_000, 16, 256, 20_000, 300


def _rows(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k means of x by Lloyd's rounds; an empty mean moves to the row that is served worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        apart = (c * c).sum(1) - 2 * (x @ c.T)
        at = apart.argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        worst = np.argsort(-(apart[np.arange(len(x)), at] + (x * x).sum(1)))
        c[n == 0] = x[worst[: (n == 0).sum()]]
    return c


class Quantiser:
    """Cells, codebooks of the parts of residuals, and the number of cells to look into."""

    def __init__(self, sample: np.ndarray, cells: int, recall: float, k: int) -> None:
        d = sample.shape[1]
        self.parts = next(p for p in range(min(PARTS, d), 0, -1) if d % p == 0)
        self.cells = centres(sample, min(cells, len(sample)))
        rest = (sample - self.cells[self.nearest(sample)]).reshape(len(sample), self.parts, -1)
        self.books = np.stack([centres(rest[:, p], min(CODES, len(sample)), 8, p) for p in range(self.parts)])
        self.probes = self._probes(sample, recall, k)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.cells * self.cells).sum(1) - 2 * (x @ self.cells.T)).argmin(1)

    def order(self, q: np.ndarray) -> np.ndarray:
        return np.argsort((self.cells * self.cells).sum(1) - 2 * (q @ self.cells.T), axis=1, kind="stable")

    def _probes(self, sample: np.ndarray, recall: float, k: int) -> int:
        """The fewest cells that hold that share of the k nearest of 500 rows of the sample."""
        q = sample[:500]
        near = np.argsort(-(q @ sample.T), axis=1)[:, :k]
        place = np.argsort(self.order(q), axis=1)  # of each cell in a query's order
        needed = np.sort(np.take_along_axis(place, self.nearest(sample)[near], 1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """cell and code (a byte a part) of each row."""
        at = self.nearest(x)
        rest = (x - self.cells[at]).reshape(len(x), self.parts, -1)
        codes = [((b * b).sum(1) - 2 * (rest[:, p] @ b.T)).argmin(1) for p, b in enumerate(self.books)]
        return at, np.stack(codes, 1).astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """About q.x of the rows of a cell."""
        table = np.einsum("qpd,pcd->pqc", q.reshape(len(q), self.parts, -1), self.books)
        out = np.repeat((q @ self.cells[cell])[:, None], len(codes), 1)
        for p in range(self.parts):
            out += table[p][:, codes[:, p]]
        return out


def _mapped(rows: DataFrame, schema: StructType, step) -> DataFrame:
    importable(rows.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(step(batch), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


class Index:
    """cell, doc, code of all vectors, stored, with the quantiser that made them."""

    def __init__(self, vectors: DataFrame, cells: int | None = None, recall: float = 0.97, k: int = 10) -> None:
        """vectors: doc, v (of one length; null vectors are left out)."""
        spark = vectors.sparkSession
        self.vectors = vectors.where("v is not null")
        n = self.vectors.count()
        if not n:
            raise ValueError("an index needs vectors")
        sample = self.vectors.orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE).select("v").toArrow().column("v")
        quantiser = Quantiser(_rows(sample), cells or int(min(4096, max(8, n**0.5 / 4))), recall, k)
        self.quantiser, self.shared = quantiser, spark.sparkContext.broadcast(quantiser)
        self.doc = vectors.schema["doc"]
        shared = self.shared

        def coded(batch: pa.RecordBatch) -> list:
            cell, codes = shared.value.coded(_rows(batch.column("v")))
            return [cell, batch.column("doc"), [c.tobytes() for c in codes]]

        self.codes = stored(_mapped(self.vectors.select("doc", "v"), StructType([StructField("cell", _INT), self.doc, StructField("code", _BINARY)]), coded).repartition("cell", F.pmod(F.xxhash64("doc"), F.lit(4))).sortWithinPartitions("cell"), "cells")

    def search(self, queries: DataFrame, k: int = 10, depth: int = DEPTH, probes: int | None = None) -> DataFrame:
        """qid, doc, score (cosine), rank; queries: qid, q, any number of rows."""
        shared, probes = self.shared, probes or self.quantiser.probes
        qid, doc = queries.schema["qid"], self.doc

        def sent(batch: pa.RecordBatch) -> list:
            q = _rows(batch.column("q"))
            order = shared.value.order(q)[:, :probes]
            row = np.repeat(np.arange(len(q)), order.shape[1])
            return [order.ravel(), batch.column("qid").take(pa.array(row)), [q[i].tobytes() for i in row]]

        looks = _mapped(queries.where("q is not null").select("qid", "q"), StructType([StructField("cell", _INT), StructField("qid", qid.dataType), StructField("q", _BINARY)]), sent)
        chunks = self.codes.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))  # a row a cell
        rows = self.codes.join(F.broadcast(chunks), "cell").select("cell", F.pmod(F.xxhash64("doc"), "chunks").alias("chunk"), "doc", "code", F.lit(None).cast(qid.dataType).alias("qid"), F.lit(None).cast("binary").alias("q"))
        asks = looks.join(F.broadcast(chunks), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast(doc.dataType).alias("doc"), F.lit(None).cast("binary").alias("code"), "qid", "q")
        arrow = to_arrow_schema(out := StructType([StructField("qid", qid.dataType), StructField("doc", doc.dataType), StructField("guess", _DOUBLE)]))

        def meet(key: tuple, table: pa.Table) -> pa.Table:
            asked = np.array(table.column("q").is_valid())
            x, y = np.flatnonzero(asked), np.flatnonzero(~asked)
            if not len(x) or not len(y):
                return arrow.empty_table()
            codes = np.frombuffer(b"".join(table.column("code").take(pa.array(y)).to_pylist()), np.uint8).reshape(len(y), -1)
            q = np.frombuffer(b"".join(table.column("q").take(pa.array(x)).to_pylist()), np.float64).reshape(len(x), -1)
            found = []
            for at in range(0, len(x), 256):
                s = shared.value.scores(q[at : at + 256], key[0].as_py(), codes)
                top = np.argpartition(-s, min(depth, len(y)) - 1, axis=1)[:, :depth]
                found.append((np.repeat(x[at : at + 256], top.shape[1]), y[top.ravel()], np.take_along_axis(s, top, 1).ravel()))
            row, column, guess = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.Table.from_arrays([table.column("qid").take(pa.array(row)), table.column("doc").take(pa.array(column)), pa.array(guess)], schema=arrow)

        guesses = rows.unionByName(asks).groupBy("cell", "chunk").applyInArrow(meet, out)
        few = guesses.withColumn("_p", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("guess"), "doc"))).where(F.col("_p") <= depth).select("qid", "doc")
        exact = few.join(self.vectors.select("doc", "v"), "doc").join(queries.select("qid", "q"), "qid").select("qid", "doc", cosine(F.col("q"), F.col("v")).alias("score"))
        return best(exact, k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact (qid, doc) that was found."""
    both = exact.select("qid", "doc").join(found.select("qid", "doc").distinct().withColumn("_hit", F.lit(1)), ["qid", "doc"], "left").agg(F.count("_hit").alias("hits"), F.count("*").alias("n")).first()
    return both.hits / both.n if both.n else 1.0
