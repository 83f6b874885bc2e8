"""BPE encoding and decoding (operator 7): speculate, verify, and merge only what fails.

A pre-token is first cut by greedy longest match. The cut is the exact BPE result if every token encodes to itself
and every two neighbours encode to themselves when joined; those facts are kept per token and per pair, and a batch
tests all its pairs as one sorted array. Pre-tokens with a failing pair go through exact merging by rank.

Null texts are empty; empty texts have no tokens; texts of any length are encoded whole; repeated rows give
repeated results; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import by_size, byte_symbols, map_arrow

#: Fixed pattern of this byte-level vocabulary's pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Codec:
    """Encodes and decodes with a byte-level BPE vocabulary file; 2 keep bounds the pre-tokens remembered."""

    def __init__(self, source: str, keep: int = 200_000):
        spec = json.loads(source)
        back = {c: b for b, c in byte_symbols().items()}
        raw = lambda s: bytes(back[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items() if t not in self.special}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.longest: dict[bytes, int] = {}
        for token in self.ids:
            self.longest[token[:2]] = max(len(token), self.longest.get(token[:2], 0))
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.keep, self.known, self.old = keep, {}, {}
        self.alone: dict[int, bool] = {}
        self.pairs, self.fine = np.empty(0, np.int64), np.empty(0, bool)  # sorted, and whether both tokens stand side by side

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the pair of lowest rank, leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            if (r := ranks.get((parts[i], parts[i + 1]))) is not None:
                heap.append((r, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := ranks.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if (p := before[i]) >= 0 and (r := ranks.get((parts[p], parts[i]))) is not None:
                heapq.heappush(heap, (r, p, parts[p], parts[i]))
        return [self.ids[parts[i]] for i in range(n) if alive[i]]

    def speculate(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ids, longest, out, at, n = self.ids, self.longest, [], 0, len(word)
        while at < n:
            for size in range(min(longest.get(word[at : at + 2], 1), n - at), 0, -1):
                if (i := ids.get(word[at : at + size])) is not None:
                    out.append(i)
                    at += size
                    break
        return out

    def stands(self, token: int) -> bool:
        if token not in self.alone:
            self.alone[token] = self.merge(self.bytes[token]) == [token]
        return self.alone[token]

    def learn(self, words: list[str]) -> None:
        """Encodes pre-tokens that are not yet known."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        guess = [self.speculate(w) for w in raw]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((i for g in guess for i in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(guess)), sizes)
        wrong = np.zeros(len(guess), bool)
        for t in np.unique(flat).tolist():
            if not self.stands(t):
                wrong[owner[flat == t]] = True
        inside = owner[:-1] == owner[1:]
        pairs = (flat[:-1] << 32 | flat[1:])[inside]
        seen = np.unique(pairs)
        at = np.searchsorted(self.pairs, seen)
        known = np.append(self.pairs, -1)[at] == seen
        new = seen[~known]
        if len(new):
            fine = np.fromiter((self.merge(self.bytes[a] + self.bytes[b]) == [a, b] for a, b in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist(), strict=True)), bool, len(new))
            if len(self.pairs) > 4 * self.keep:  # only this batch's pairs stay
                self.pairs, self.fine = self.pairs[at[known]], self.fine[at[known]]
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.fine = np.insert(self.pairs, place, new), np.insert(self.fine, place, fine)
        if len(pairs):
            wrong[owner[:-1][inside][~self.fine[np.searchsorted(self.pairs, pairs)]]] = True
        for i in np.flatnonzero(wrong).tolist():
            guess[i] = self.merge(raw[i])
        self.known.update((w, np.array(g, "<u4").tobytes()) for w, g in zip(words, guess, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = []
        for text in texts:
            if self.cut and any(s in text for s in self.special):
                pieces.append([self.special[p] if p in self.special else self.find(p) for p in self.cut(text)])
            else:
                pieces.append([self.find(text)])
        if len(self.known) > self.keep:  # what is used again moves over from the old words
            self.known, self.old = {}, self.known
        new = set().union(*(p for ps in pieces for p in ps if not isinstance(p, int))) - self.known.keys()
        if again := new & self.old.keys():
            self.known.update((w, self.old[w]) for w in again)
            new -= again
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [b"".join(np.uint32(p).astype("<u4").tobytes() if isinstance(p, int) else b"".join(map(get, p)) for p in ps) for ps in pieces]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(source: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(source)
    return _CODECS[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of keep, ids (binary, little-endian unsigned 32-bit) and decoded (string) of every row.

    vocabulary: a byte-level BPE file's path on the driver; its content is broadcast, and its size does not depend on the data.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        c = codec(source.value)

        def step(rows):
            ids = [x for part in by_size(rows[text]) for x in c.encode(part)]
            return {k: rows[k] for k in keep} | {"ids": ids, "decoded": [c.decode(x) for x in ids]}

        return step

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_arrow(docs, [*dict.fromkeys([*keep, text])], f"{kinds}, ids binary, decoded string", make, rows=256)


def encoded(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of keep and ids of every row, without decoding."""
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        c = codec(source.value)
        return lambda rows: {k: rows[k] for k in keep} | {"ids": [x for part in by_size(rows[text]) for x in c.encode(part)]}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_arrow(docs, [*dict.fromkeys([*keep, text])], f"{kinds}, ids binary", make, rows=256)


def encoded_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    out = encode_decode(docs, vocabulary)
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
