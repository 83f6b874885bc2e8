import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.text import token_terms, tokenize
from riskloom.operators import ann
from riskloom.operators import codesearch as S
from riskloom.operators.retrieval import best, dense_nearest, hashed_vector, top_products

PATTERNS = [r"ab+c", r"(foo|bar)baz", r"x[yz]w", r"(ab|cd)?ef+", r"\bdef\b", r"a.c", r"(?:abc|ab\d)def", r"(abc){2}", r"[a-f]oo", r"(foo|b)", r"é{3}n", r"(?=foo)fooba", r"ba(r|z|rb)az", r"^abc$", r"(?i)FOO", r"(foo(bar|baz)+|abcd)", r"a{0}bcd", r"\d+\.\d+"]


def test_every_matching_line_has_a_trigram_of_each_clause():
    rng = random.Random(2)
    parts = ["ab", "bc", "foo", "bar", "baz", "x", "y", "z", "w", "ef", "abc", "def", "é", "n", "1", ".", " ", "cd", "FOO", "bcd"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(20_000)]
    for p in PATTERNS:
        needs = S.clauses(p)
        assert all(len(g) == 3 for c in needs for g in c)
        for line in lines:
            if re.search(p, line):
                assert all(any(g in line for g in c) for c in needs), (p, line)
    assert S.clauses(r"(foo|bar)baz") and S.clauses(r"(abc){2}") and not S.clauses("a.c") and not S.clauses("(?i)FOO")


def test_search_equals_a_scan(spark):
    rng = random.Random(3)
    words = ["foo", "foobar", "barbaz", "abc", "abbc", "def", "xyw", "aaaa", "é", "ééén", "a'b", "a\\d", "1.5", "fooba", "don't"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 5))) for _ in range(150)] + [None, "", "\n\n", "foo"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, body string, line string")
    queries = [(f"r{i}", "regex", p) for i, p in enumerate(PATTERNS)] + [("l1", "literal", "aaa"), ("l2", "literal", "a'b"), ("l3", "literal", "fo"), ("l4", "literal", "foo foo"), ("l5", "literal", "a\\d"), ("w1", "word", "foo"), ("w2", "word", "bar"), ("w3", "word", "ab"), ("w4", "word", "don't")]
    got = sorted(map(tuple, S.search(S.index(docs, "id", "body"), S.lines_of(docs, "id", "body"), queries).collect()))
    want = []
    for q, mode, text in queries:
        hit = (lambda x, t=text: t in x) if mode == "literal" else re.compile(text if mode == "regex" else rf"\b{re.escape(text)}\b").search
        want += [(q, i, n + 1) for i, t in enumerate(texts) if t is not None for n, line in enumerate(t.split("\n")) if hit(line)]
    assert got == sorted(want)
    hits = S.first_hits(S.search(S.index(docs, "id", "body"), S.lines_of(docs, "id", "body"), [("w", "word", "foo")]), 7).collect()
    assert sorted((r.doc, r.line_no) for r in hits) == sorted(x[1:] for x in want if x[0] == "w1")[:7]
    assert S.search(S.index(docs.where("id < 0"), "id", "body"), S.lines_of(docs.where("id < 0"), "id", "body"), queries).collect() == []
    assert S.search(S.index(docs, "id", "body"), S.lines_of(docs, "id", "body"), []).collect() == []


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_the_inverted_file(spark, clustered):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32)) * (0.3 if clustered else 1.0) + (rng.normal(size=(40, 32))[rng.integers(40, size=3000)] if clustered else 0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None), (9998, [0.0] * 32)], "doc long, v array<double>").repartition(4)
    queries = rows.where("doc % 20 = 0").select(F.col("doc").alias("qid"), F.col("v").alias("q"))
    index = ann.Index(rows)
    found = index.search(queries)
    exact = dense_nearest(rows.where("v is not null"), queries, 10)
    r = ann.recall(found, exact)
    assert r >= 0.9, (r, index.quantiser.probes, len(index.quantiser.cells))
    if clustered:  # what the file spares
        assert index.quantiser.probes <= len(index.quantiser.cells) / 2
    assert found.where("rank = 1 and qid <> doc").count() == 0
    assert index.codes.count() == 3001
    with pytest.raises(ValueError):
        ann.Index(rows.where("v is null"))
    assert index.search(queries.where("qid < 0")).collect() == []


def test_top_products_equal_a_join_and_shuffle_no_pairs(spark):
    rng = random.Random(8)
    v = spark.createDataFrame([(d, t, float(rng.randint(-2, 3))) for d in range(300) for t in rng.sample("abcdefghij", 3)], "doc long, key string, x double")
    q = spark.createDataFrame([(i, t, float(rng.randint(-2, 2))) for i in range(25) for t in rng.sample("abcdefghijz", 2)] + [(99, "z", 1.0)], "qid int, key string, y double")
    pairs = v.join(q, "key").groupBy("qid", "doc").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    rows = lambda df: sorted((r.qid, r["rank"], r.doc, r.score + 0.0) for r in df.collect())
    for limit in (7, 1000):
        assert rows(top_products(v, q, 9, limit=limit)) == rows(best(pairs, 9))
        assert rows(top_products(v, q, 400, positive=True, limit=limit)) == rows(best(pairs.where("score > 0"), 400))
    plan = top_products(v, q, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [qid" not in plan


def test_trigrams_are_made_without_a_shuffle(spark):
    texts = ["abcabc\n\nab", "aaaaa", "é😀xé😀x\nabc", None, "", "\n"]
    rows = S.trigrams(spark.createDataFrame(list(enumerate(texts)), "id long, body string"), "id", "body")
    want = {}
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            for at in range(len(line) - 2):
                want.setdefault((line[at : at + 3], i, n + 1), []).append(at)
    assert {(r.gram, r.doc, r.line_no): r.places for r in rows.collect()} == want and rows.count() == len(want)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_hashed_vectors_are_made_where_the_texts_are(spark):
    rng = random.Random(5)
    parts = ["get", "HTTP", "Ses", "boxes", "ies", "flies", "running", "ed", "used", "only", "fly", "_", "__", "1", "42", "x", "The", "self", "classes", "cats", "ABc", "churches", "e", "s"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "é ß!", "one\n\ttwo", "running"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "of a repeated id")], "id long, body string").repartition(3)
    want, raws = {}, {}
    for r in docs.select("id", "body", tokenize(F.col("body")).alias("t")).collect():
        raws |= {raw: 1 for raw in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+", r.body or "")}
        for g in [*r.t, *(f"{a} {b}" for a, b in zip(r.t, r.t[1:]))]:
            h = zlib.crc32(g.encode())
            v = want.setdefault(r.id, {})
            v[h % 1024] = v.get(h % 1024, 0) + (-1 if h >= 1 << 31 else 1)
    rows = hashed_vector(docs, "id", "body")
    got = {(r.doc, r.idx): r.x for r in rows.collect()}
    damped = {d: {i: float(np.sign(x) * np.log1p(abs(x))) for i, x in v.items() if x} for d, v in want.items()}
    exact = {(d, i): x / np.sqrt(sum(y * y for y in v.values())) for d, v in damped.items() for i, x in v.items()}
    assert got.keys() == exact.keys() and max(abs(got[k] - exact[k]) for k in got) < 1e-12
    known = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", tokenize(F.col("raw")).alias("t")).collect()
    assert all(token_terms(r.raw) == r.t for r in known)
    plan = hashed_vector(docs, "id", "body")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ArrowEvalPython" in plan
