"""Boosted trees grown leaf by leaf: histograms of gradients are one aggregation for all open leaves of a tree.

Features are cut into bins once; rows of equal bins are one row, stored as bins, how many they are, the sum of their labels and margin, so
that what a tree reads grows with the combinations of bins that occur and not with the table. BLOCK of them are one row of the stored
table, their values one after another, for a tree reads them many times and Spark's rows cost more than the sums. A tree takes the leaf of largest gain next, whichever its
depth. A leaf's split asks for the histograms of its children: those of all open leaves are counted in one job, the
larger child's by subtraction, so that a tree costs about as many jobs as it is deep. What reaches the driver is a sum
for each open leaf, feature and bin. The model is a list of trees of plain lists, which the tasks follow in NumPy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.storage import stored
from riskloom.session import importable

#: Learning rate, leaves, rounds and least rows of a leaf of the reference's model; bins of a feature.
RATE, LEAVES, ROUNDS, LEAST, BINS = 0.05, 15, 200, 10, 32
#: Trees after which margins are written anew, least hessian of a leaf.
WRITE, LEAST_HESSIAN = 10, 1e-3
#: Rows of a block; rows whose sums are made at once.
BLOCK, AT_ONCE = 1024, 1 << 16


@dataclass
class Tree:
    """Nodes by number: feature (-1 for a leaf), last bin of the left child, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    last: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, last: int) -> tuple[int, int]:
        a, b = len(self.feature), len(self.feature) + 1
        for column, x in ((self.feature, -1), (self.last, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column += [x, x]
        self.feature[node], self.last[node], self.left[node], self.right[node] = feature, last, a, b
        return a, b

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.empty(len(bins), np.int64)
        columns = np.ascontiguousarray(bins.T)
        todo = [(0, np.arange(len(bins)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                at[rows] = node
            elif len(rows):
                left = columns[self.feature[node]].take(rows) <= self.last[node]
                todo += [(self.left[node], rows[left]), (self.right[node], rows[~left])]
        return at


@dataclass
class Model:
    """Trees over binned features: names, the upper edges of each feature's bins, the margin that all rows begin with."""

    names: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Bins of rows of features: how many edges lie below; a missing value is in the first bin."""
        return np.stack([np.searchsorted(np.array(e), np.where(np.isnan(values[:, i]), -np.inf, values[:, i])) for i, e in enumerate(self.edges)], 1).astype(np.uint8)

    def margins(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees[since:]:
            out += np.array(t.value)[t.leaves(bins)]
        return out

    def to_json(self) -> str:
        return json.dumps({"names": self.names, "edges": self.edges, "start": self.start, "trees": [vars(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Model:
        m = json.loads(text)
        return cls(m["names"], m["edges"], m["start"], [Tree(**t) for t in m["trees"]])


def best_split(h: np.ndarray, least: int) -> tuple[float, int, int] | None:
    """(gain, feature, last bin of the left child) of a leaf's histogram (features, bins, [g, h, n]); the first of equal gains."""
    left = np.cumsum(h, axis=1)[:, :-1]
    right = h.sum(axis=1, keepdims=True) - left
    ok = (left[..., 2] >= least) & (right[..., 2] >= least) & (left[..., 1] >= LEAST_HESSIAN) & (right[..., 1] >= LEAST_HESSIAN)
    square = lambda x: x[..., 0] ** 2 / np.maximum(x[..., 1], 1e-300)
    gain = np.where(ok, square(left) + square(right) - square(h.sum(axis=1, keepdims=True)), -np.inf)
    at = int(gain.argmax())
    f, last = divmod(at, gain.shape[1])
    return (float(gain[f, last]), f, last) if np.isfinite(gain[f, last]) and gain[f, last] > 1e-12 else None


def grown(histogram, leaves: int, least: int, rate: float) -> Tree:
    """A tree by best leaf first. histogram(tree, splits) gives the left and right child's histograms of each open leaf in
    splits (leaf: (feature, last bin)), or the root's without splits."""
    tree = Tree()
    hist = {0: histogram(tree, None)}
    found = {0: best_split(hist[0], least)}
    children: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    n = 1
    while n < leaves:
        able = [x for x, s in found.items() if s]
        if not able:
            break
        leaf = max(able, key=lambda x: (found[x][0], -x))
        if leaf not in children:
            # leaves that cannot be reached any more are not asked for
            ranked = sorted((x for x in able if x not in children), key=lambda x: -found[x][0])[: leaves - n]
            children |= histogram(tree, {x: found[x][1:] for x in ranked})
        a, b = tree.split(leaf, *found.pop(leaf)[1:])
        hist.pop(leaf)
        for child, h in zip((a, b), children.pop(leaf), strict=True):
            hist[child], found[child] = h, best_split(h, least)
        n += 1
    for leaf, h in hist.items():
        g, w = h[0, :, 0].sum(), h[0, :, 1].sum()
        tree.value[leaf] = float(-rate * g / w) if w > 0 else 0.0
    return tree


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return p - label, p * (1 - p)


def counted(bins: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, nodes: int, width: int, n: np.ndarray | None = None) -> np.ndarray:
    """(nodes, features, bins, 3): sums of gradients, hessians and rows (n of each, or one); rows of node -1 do not count."""
    keep = node >= 0
    bins, g, h, node, n = bins[keep], g[keep], h[keep], node[keep], None if n is None else n[keep]
    out = np.empty((nodes, bins.shape[1], width, 3))
    for f in range(bins.shape[1]):
        at = node * width + bins[:, f]
        for k, w in enumerate((g, h, n)):
            out[:, f, :, k] = np.bincount(at, w, nodes * width).reshape(nodes, width)
    return out


def blocks(values: np.ndarray) -> pa.Array:
    """The bytes of values (rows first), BLOCK rows in each item."""
    ends = np.append(np.arange(0, len(values), BLOCK), len(values)) * (values.nbytes // len(values))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])


def flat(column: pa.Array, kind: type) -> np.ndarray:
    """The values of blocks that follow each other, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)


def fit(rows: DataFrame, names: list[str], label: str, rounds: int = ROUNDS, leaves: int = LEAVES, rate: float = RATE, least: int = LEAST, bins: int = BINS, error: float = 0.001) -> Model:
    """A model of the label (0 or 1; nulls are left out) by the features named; missing features are in the first bin."""
    spark = rows.sparkSession
    importable(spark)
    data = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *(F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)))
    facts = data.agg(F.count("*").alias("n"), F.avg("y").alias("p")).first()
    if not facts.n or facts.p in (0.0, 1.0):
        return Model(names, [[0.0] for _ in names], -20.0 if not facts.n or facts.p == 0 else 20.0)
    cuts = data.approxQuantile([f"x{i}" for i in range(len(names))], [k / bins for k in range(1, bins)], error)
    model = Model(names, [sorted(set(c)) or [0.0] for c in cuts], float(np.log(facts.p / (1 - facts.p))))
    width = max(map(len, model.edges)) + 1

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))], 1)
            ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(len(names))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(model.binned(x).tobytes())])], names=["y", "bins"])

    kinds = {"bins": np.uint8, "n": float, "y": float, "margin": float}
    schema = ", ".join(f"{k} binary" for k in kinds)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = flat(b.column("bins"), np.uint8).reshape(b.num_rows, -1)
                columns = [x, b.column("n").to_numpy(), b.column("y").to_numpy(), np.full(len(x), model.start)]
                yield pa.RecordBatch.from_arrays([blocks(c) for c in columns], names=list(kinds))

    alike = data.mapInArrow(binned, "y double, bins binary").groupBy("bins").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("y"))
    held, since = stored(alike.mapInArrow(packed, schema), "binned"), 0

    def unpacked(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        bins, n, y, margin = (flat(b.column(k), kind) for k, kind in kinds.items())
        bins = bins.reshape(len(n), -1)
        for at in range(0, len(n), AT_ONCE):
            x = bins[at : at + AT_ONCE]
            yield x, n[at : at + AT_ONCE], y[at : at + AT_ONCE], margin[at : at + AT_ONCE] + model_now.value.margins(x, written)

    for _ in range(rounds):
        if len(model.trees) - since >= WRITE:
            model_now, written = spark.sparkContext.broadcast(model), since

            def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for columns in unpacked(b) if b.num_rows else ():
                        yield pa.RecordBatch.from_arrays([blocks(c) for c in columns], names=list(kinds))

            held, since = stored(held.mapInArrow(moved, schema), "binned"), len(model.trees)
        model_now, written = spark.sparkContext.broadcast(model), since

        def histogram(tree: Tree, splits: dict[int, tuple[int, int]] | None):
            """Each open leaf's left child and the leaf itself are counted; the right child is the difference."""
            asked = sorted(splits or {0: (0, 255)})

            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((2 * len(asked), len(names), width, 3))
                for x, n, y, margin in (u for b in batches if b.num_rows for u in unpacked(b)):
                    g, h = gradients(margin, y / n)
                    leaf = tree.leaves(x)
                    place = np.full(len(x), -1)
                    for k, node in enumerate(asked):
                        f, last = (splits or {0: (0, 255)})[node]
                        place[leaf == node] = 2 * k + (x[leaf == node, f] > last)
                    total += counted(x, n * g, n * h, place, len(total), width, n)
                at = np.flatnonzero(total[..., 2])
                flat = total.reshape(-1, 3)[at]
                yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(flat[:, k]) for k in range(3))], names=["at", "g", "h", "n"])

            sums = held.mapInArrow(part, "at bigint, g double, h double, n double").groupBy("at").agg(*(F.sum(c).alias(c) for c in "ghn")).toArrow()
            out = np.zeros((2 * len(asked), len(names), width, 3))
            for k, c in enumerate("ghn"):
                out.reshape(-1, 3)[sums.column("at").to_numpy(), k] = sums.column(c).to_numpy()
            return out[0] if splits is None else {node: (out[2 * k], out[2 * k + 1]) for k, node in enumerate(asked)}

        model.trees.append(grown(histogram, leaves, least, rate))
    return model


def scored(rows: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """rows with the model's probability; Arrow batches of the features alone go to Python."""
    importable(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
        return pa.array(1 / (1 + np.exp(-(shared.value.start + shared.value.margins(shared.value.binned(x))))))

    return rows.withColumn(name, probability(*(F.col(n).cast("double") for n in model.names)))
