import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from riskloom.llm import collocations
from riskloom.llm.collocations import Bitmaps


def brute(rows, least, top=2000):
    """lang, rank, phrase, a, l, r, n, score, by plain counting."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        own = []
        for p, a in kept.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in kept.items()):
                continue
            s, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            own.append((-s, -a, " ".join(p).encode(), a, left, right))
        out += [(lang, i + 1, x[2].decode(), *x[3:], total[lang], -x[0]) for i, x in enumerate(sorted(own)[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = ["a", "b", "The", "of", "é", "œuf", "x\x00y", "über", "New", "York", "city", "　"]
    texts = [(rng.choice(["en", "de", "en", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randint(0, 80)))) for _ in range(120)]
    return [*texts, ("en", None), ("en", ""), (None, None), ("fr", " . ,;"), ("en", "new york city " * 400), ("de", "a" * 70_000 + " b"), *[("en", "New York city of of of")] * 90]


@pytest.mark.parametrize("slice_", [None, 512])
def test_against_brute_force(spark, monkeypatch, slice_):
    if slice_:  # workers fork from the driver's daemon, so that shard() is tried here as well
        monkeypatch.setattr(collocations, "SLICE", slice_)
    rows = corpus()
    docs = spark.createDataFrame([(lang, t, "x") for lang, t in rows], "lang string, text string, word string").repartition(5)
    got = sorted(map(tuple, collocations.collocations(docs, least=6).collect()))
    assert got == brute(rows, 6)
    assert {r[0] for r in got} >= {"en", "de", "und"}


def test_top_and_ties(spark):
    rows = [("en", "a b. c d. e f. g h i j. ")] * 8
    got = sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=8, top=3).collect()))
    assert got == brute(rows, 8, 3)
    assert [r[2] for r in got] == ["a b", "c d", "e f"]


def test_empty_table_and_no_words(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, " .!")], "lang string, text string")).collect() == []


def test_bitmaps_of_a_stream():
    rng = np.random.default_rng(1)
    stream = rng.integers(0, 4, 1000).astype(np.int32)
    want = Counter()
    for k in (2, 3, 4):
        want.update(tuple(stream[i : i + k].tolist()) for i in range(len(stream) - k + 1) if (stream[i : i + k] > 0).all())
    got = {tuple(s.tolist()): int(n) for k in (2, 3, 4) for symbols, counts in Bitmaps(stream).phrases(k) for s, n in zip(symbols, counts, strict=True)}
    assert got == dict(want)


def test_slices_keep_words_and_pieces(monkeypatch):
    text = b"one two three. four  five .six." * 50 + b"x" * 300 + b" end."
    whole = collocations.shard({b"en": [text]})
    monkeypatch.setattr(collocations, "SLICE", 64)
    parts = collocations.shard({b"en": [text]})
    assert whole[0].equals(parts[0]) and whole[1].tolist() == parts[1].tolist()


def test_shards_are_written_and_read_one_by_one(spark, monkeypatch):
    docs = spark.createDataFrame([(f"a{i} b c. d e{i}", "en") for i in range(40)], "text string, lang string").coalesce(1)
    shards, stored, held = collocations.shards, collocations.stored, {}
    monkeypatch.setattr(collocations, "shards", lambda d: shards(d, size=1))
    monkeypatch.setattr(collocations, "stored", lambda df, name, **options: held.setdefault(name, stored(df, name, **options)))
    collocations.phrase_counts(docs, least=2, longest=2)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in held["shards"].inputFiles()]
    assert [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)] == [1] * 40
