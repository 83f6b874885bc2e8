"""MinHash near-dedup (operator 4): BagMinHash signatures over word shingles, banding, and verification by multiset overlap.

A text's shingles are its runs of five consecutive words (a text of fewer is one shingle), as a bag: a shingle that
stands w times has weight w. The weights are discretised at 0, 1, 2, 4, 8, ... Every shingle has an independent
Poisson process on each level below its weight; on the level that the weight cuts, only points under the weight count.
A point falls into one of SLOTS slots at its time; the least time of a slot names its value, so that two bags agree in
a slot with probability equal to their weighted Jaccard similarity. Times are drawn in rounds for all shingles of a
batch together, up to the time by which all slots of a text are filled.

Texts with equal words are one node. Bands of ROWS slots make buckets; every bucket links its members to its least
one, and each link is verified by the overlap of the two bags. Links become components; where a bucket's members are
still in several components, all its pairs across components are tried, in blocks, but for those whose parities prove
them to be under the threshold (common.linked). Buckets, links and components are tables; nothing is collected.

Words are those of common.words_of. Null and empty texts and texts without words are equal (no words) and form one
class. Repeated rows are copies. A class is named after its row of the least key (doc_id unless another column is named; a
null is last), of rows with one key the one read first. Very long texts are hashed whole; an empty table gives no rows.
All columns of the table are kept, whatever their names; only the text goes to Python.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import LONGS, across, crowded, likely, linked, map_arrow, small, stored, words_of

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def bags(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, owner) of several texts, sorted by owner and shingle; texts without words have none."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((h for w in words for h in map(_HASHES.__getitem__, w)), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(flat))
    left = ends[owner] - at  # words from here to the end of the text
    first = at - (ends - sizes)[owner]
    starts = np.flatnonzero((left >= WIDTH) | (first == 0))
    shingle = np.zeros(len(starts), np.uint64)
    for k in range(WIDTH):
        inside = left[starts] > k
        part = np.zeros(len(starts), np.uint64)
        part[inside] = mix(flat[starts[inside] + k] + _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        shingle = mix(shingle * _U(3) + part)
    owner = owner[starts]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    if not len(shingle):
        return shingle, np.zeros(0, np.int64), owner
    new = np.flatnonzero(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])]))
    return shingle[new], np.diff(np.concatenate([new, [len(shingle)]])), owner[new]


def signatures(shingle: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """The BagMinHash signature of each of n bags; bags without shingles have zeros."""
    out = np.zeros((n, slots), np.uint64)
    best = np.full(n * slots, np.inf)
    total = np.bincount(owner, weight, n)
    todo = np.flatnonzero(total)
    most = np.zeros(n)
    until = np.zeros(n)
    most[todo] = (np.log(slots) + 5) / total[todo]
    level = np.ceil(np.log2(weight)).astype(np.int64) if len(weight) else weight
    which = np.repeat(np.arange(len(weight)), level + 1)
    lev = np.arange(len(which)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    low = np.where(lev == 0, 0, 2.0 ** (lev - 1))
    width = np.where(lev == 0, 1, 2.0 ** np.maximum(lev - 1, 0))
    seeds = mix(shingle[which] + mix((lev + 1).astype(np.uint64)))
    doc, cut = owner[which], weight[which]
    while len(todo):
        chosen = np.zeros(n, bool)
        chosen[todo] = True
        live = np.flatnonzero(chosen[doc])
        seed, time, step = seeds[live], np.zeros(len(live)), _U(0)
        points, values, times = [], [], []
        while len(live):
            step += _U(1)
            seed = mix(seed + _U(0x9E3779B97F4A7C15))
            other = mix(seed ^ _U(0xD6E8FEB86659FD93))
            u = ((seed >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(u) / (width[live] * slots)
            on = time < most[doc[live]]
            live, seed, time, other = live[on], seed[on], time[on], other[on]
            slot = (other % _U(slots)).astype(np.int64)
            y = low[live] + width[live] * ((other >> _U(32)).astype(np.float64) * 2.0**-32)
            good = (y < cut[live]) & (time >= until[doc[live]])
            points.append(doc[live[good]] * slots + slot[good])
            values.append(seed[good])
            times.append(time[good])
        p, v, t = map(np.concatenate, (points, values, times))
        order = np.argsort(-t, kind="stable")
        p, v, t = p[order], v[order], t[order]
        got = np.full(n * slots, np.inf)
        value = np.zeros(n * slots, np.uint64)
        got[p], value[p] = t, v  # of several, the last one written is the earliest
        new = np.isinf(best) & ~np.isinf(got)
        best[new] = got[new]
        out.reshape(-1)[new] = value[new]
        until[todo] = most[todo]
        todo = todo[np.isinf(best.reshape(n, slots)[todo]).any(1)]
        most[todo] *= 2
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS))
    for k in range(ROWS):
        h = mix(h * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h.view(np.int64)


def parities(shingle: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The bits of each of n bags for common.possible: its weight, and 64 LONGS parities; a shingle of weight w is w elements."""
    which = np.repeat(np.arange(len(weight)), weight)
    copy = np.arange(len(which)) - np.repeat(np.cumsum(weight) - weight, weight)
    place = mix(shingle[which] ^ mix(copy.astype(np.uint64) + _U(1))) % _U(64 * LONGS)
    odd = np.bincount(owner[which] * (64 * LONGS) + place.astype(np.int64), minlength=n * 64 * LONGS) & 1
    total = np.bincount(owner, weight, n).astype(np.int64)
    return np.concatenate([total[:, None], np.packbits(odd.astype(np.uint8).reshape(n, -1), axis=1).view(np.int64)], axis=1)


def overlap(a: list[bytes], b: list[bytes]) -> float:
    """The weighted Jaccard similarity of two texts' bags; of two without words, 1."""
    shingle, weight, owner = bags([a, b])
    n = int((owner == 0).sum())
    if n == 0 or n == len(owner):
        return float(len(owner) == 0)
    _, i, j = np.intersect1d(shingle[:n], shingle[n:], assume_unique=True, return_indices=True)
    both = np.minimum(weight[:n][i], weight[n:][j]).sum()
    return float(both / (weight.sum() - both))


def signed(rows: DataFrame) -> DataFrame:
    """uid, key (a 128-bit hash of the words), bands, bits of every row of rows (uid, text); stored."""

    def make():
        def step(batch):
            out = {"uid": batch["uid"], "key": [], "bands": [], "bits": []}
            sizes, at = [len(t or "") for t in batch["text"]], 0
            while at < len(sizes):
                size, end = sizes[at], at + 1
                while end < len(sizes) and size + sizes[end] < 500_000:
                    size, end = size + sizes[end], end + 1
                words = [words_of(t) for t in batch["text"][at:end]]
                parts = bags(words)
                out["key"] += [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
                out["bands"] += [h.tolist() if w else [] for h, w in zip(band_hashes(signatures(*parts, len(words))), words, strict=True)]
                out["bits"] += parities(*parts, len(words)).tolist()
                at = end
            return out

        return step

    return stored(map_arrow(rows, ["uid", "text"], "uid bigint, key binary, bands array<bigint>, bits array<bigint>", make, rows=256), "signed")


def verified(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs of nodes whose bags overlap that much; texts: node, text."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def make():
        last: list = [None, None]

        def step(batch):
            out = {"a": [], "b": []}
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if a != last[0]:  # the pairs of a node stand together
                    last[:] = a, words_of(text_a)
                if overlap(last[1], words_of(text_b)) >= threshold:
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return step

    return map_arrow(both, ["a", "b", "text_a", "text_b"], "a bigint, b bigint", make, rows=64)


def link(rows: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """node, root of the nodes that a verified link joins; nodes: node (a uid), bands, bits; rows: uid, text."""
    crowd = crowded(nodes.select(F.explode("bands").alias("band"), "node"), "documents")
    bits = stored(nodes.select("node", "bits").join(small(crowd.select("node").distinct()), "node", "left_semi"), "documents-bits")
    texts = stored(rows.select(F.col("uid").alias("node"), "text").join(small(bits.select("node")), "node", "left_semi"), "documents-texts")
    verify = lambda pairs: verified(texts, likely(pairs, bits, threshold), threshold)
    settle = lambda members: verified(texts, across(members, bits, threshold), threshold)
    return linked(crowd, verify, settle, "documents")


def classes(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """uid, first (the uid of the class's first row), first_key, size of every row of rows (uid, key, text; stored)."""
    own = signed(rows.select("uid", "text"))
    keys = stored(own.groupBy("key").agg(F.min("uid").alias("node"), F.count("*").alias("n")), "documents-keys")
    nodes = own.select(F.col("uid").alias("node"), "bands", "bits").join(small(keys.select("node")), "node", "left_semi")
    roots = link(rows.select("uid", "text"), stored(nodes, "documents-nodes"), threshold)
    known = keys.join(roots, "node", "left").select(F.col("key").alias("words"), "n", F.coalesce("root", "node").alias("root"))
    several = known.groupBy("root").agg(F.sum("n").alias("size")).where("size > 1")
    of = stored(known.join(several, "root").select("words", "root", "size"), "documents-classes")
    member = stored(own.select("uid", F.col("key").alias("words")).join(small(of), "words").join(rows.select("uid", "key"), "uid").select("uid", "key", "root", "size"), "documents-members")
    first = member.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "uid")).alias("f"))
    found = member.join(first, "root").select("uid", F.col("f.uid").alias("first"), F.col("f.key").alias("first_key"), "size")
    alone = rows.select("uid", "key").join(small(member.select("uid")), "uid", "left_anti").select("uid", F.col("uid").alias("first"), F.col("key").alias("first_key"), F.lit(1).cast("bigint").alias("size"))
    return found.unionAll(alone)


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """doc_id, class_id (the key of the class's first row), class_size (rows) of every row of docs (doc_id, text)."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), "text"), "documents-rows")
    return rows.select("uid", F.col("key").alias("doc_id")).join(classes(rows, threshold), "uid").select("doc_id", F.col("first_key").alias("class_id"), F.col("size").alias("class_size"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """The first row of every class, in the columns of docs."""
    rows = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("uid")), "documents-rows")
    of = classes(rows.select("uid", F.col("doc")[key].alias("key"), F.col("doc.text").alias("text")), threshold)
    return rows.join(small(of.where("uid <> first").select("uid")), "uid", "left_anti").select("doc.*")
