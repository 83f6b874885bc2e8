"""Token counts (operator 6): rank-synchronous merging of ragged arrays.

A batch's new pre-tokens are held as one flat array of symbols with the number of the pre-token that owns each. Every
round finds each pre-token's pair of lowest rank and merges all its places at once, in all pre-tokens together; what
has no pair left is counted. Counts of pre-tokens are remembered up to a bound.

Null texts are empty and have no tokens; texts of any length are counted whole; repeated rows give repeated results; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from riskloom.llm.bpe import read_vocabulary
from riskloom.llm.common import by_size, byte_symbols, map_arrow

#: Fixed pattern of this vocabulary's pre-tokens; what lies between them is dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NEVER = np.int64(1 << 62)


class Counter:
    def __init__(self, source: str, keep: int = 400_000):
        spec = json.loads(source)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.width = 1 + max(vocab.values())
        sym = byte_symbols()
        self.inner = np.array([vocab[sym[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[sym[b] + end] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.find = regex.compile(PATTERN).findall
        self.space = regex.compile(r"\s+").sub
        self.cut = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self.keep, self.known = keep, {}

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols left of each word after all merges."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sym = self.inner[flat]
        ends = starts + sizes - 1
        sym[ends] = self.last[flat[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        counts = np.zeros(len(words), np.int64)
        while len(sym):
            rank = np.full(len(sym), NEVER)
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            key = sym[inside] * self.width + sym[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[inside] = np.where(self.keys[at] == key, self.rank[at], NEVER)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lens = np.diff(np.concatenate([starts, [len(sym)]]))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NEVER
            if done.any():
                counts[owner[starts[done]]] = lens[done]
                live = np.repeat(~done, lens)
                sym, owner, rank, lowest, lens = sym[live], owner[live], rank[live], lowest[~done], lens[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(lowest, lens)
            where = np.arange(len(sym))
            back = np.maximum.accumulate(np.where(hit, -1, where))
            hit &= (where - back) % 2 == 1  # of overlapping places, every second
            left = np.flatnonzero(hit)
            sym[left] = self.made[rank[left]]
            gone = np.zeros(len(sym), bool)
            gone[left + 1] = True
            sym, owner = sym[~gone], owner[~gone]
        return counts

    def pre_tokens(self, text: str) -> tuple[int, list[str]]:
        """The number of special strings, and the pre-tokens of the rest."""
        parts = self.cut(text) if self.cut else [text]
        out = []
        for part in parts:
            plain = self.space(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()
            out += self.find(plain)
        return len(parts) - 1, out

    def count(self, texts: list[str]) -> list[int]:
        pieces = [self.pre_tokens(t) for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        new = list(set().union(*(p for _, p in pieces)) - self.known.keys())
        if new:
            self.known.update(zip(new, self.survivors([w.encode("utf-8", "surrogatepass") for w in new]).tolist(), strict=True))
        get = self.known.__getitem__
        return [n + sum(map(get, p)) for n, p in pieces]


_COUNTERS: dict[str, Counter] = {}


def counter(source: str) -> Counter:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(source)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs; vocabulary: the path of a BPE file with word ends."""
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        c = counter(source.value)

        def step(rows):
            n = [x for part in by_size(rows["text"]) for x in c.count(part)]
            return {"doc_id": rows["doc_id"], "n_bytes": [len((t or "").encode()) for t in rows["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return step

    return map_arrow(docs, ["doc_id", "text"], "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", make, rows=256)
