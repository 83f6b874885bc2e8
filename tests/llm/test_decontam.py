import hashlib
import random

from riskloom.llm.common import words_of
from riskloom.llm.decontam import alignments, anchors, build_index, clean, decontaminate, item_table, proximity_matches, stored


def brute(text, items, window=10):
    words, hit, ids = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        k = min(window, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in grams:
                ids.add(str(item))
                hit.update(range(i, i + k))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def check(spark, texts, items):
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, pos int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate(docs, bench).collect()), key=str)
    want = [(i, *brute(t, items)) for i, t in texts]
    assert got == sorted(want, key=str)
    kept = sorted((tuple(r) for r in clean(docs, bench).collect()), key=str)
    assert kept == sorted([(i, t, 7) for (i, t), w in zip(texts, want, strict=True) if not w[-1]], key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = ["a", "b", "Éa", "éa", "C", "c", "d9", "x-y", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 9, 10, 11, 14, 20]))) for i in range(12)] + [(50, None), (3, text(12)), (77, "Éa éa c d9")]
    texts = [(i, text(rng.randint(0, 40))) for i in range(60)]
    texts += [(100 + i, text(3) + " " + (items[i % 12][1] or "").upper() + ". " + text(4) + (items[(i + 5) % 12][1] or "")) for i in range(40)]
    texts += [(200, None), (201, ""), (5, texts[5][1]), (5, "other text"), (None, items[3][1]), (None, None)]
    check(spark, texts, items)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b")])
    check(spark, [(1, "a b"), (2, None)], [])


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta y gamma"), (3, "alpha" + " x" * 30 + " beta gamma"), (4, "alpha")], "doc_id long, text string")
    table = item_table(items, 10)
    terms = stored(table.selectExpr("explode(words) word").distinct().selectExpr("word", "monotonically_increasing_id() term"), "terms")
    index = build_index(docs, terms)
    places = anchors(index, table, terms)
    near = {r.doc_id for r in proximity_matches(index, places, 3).collect()}
    assert {1, 2} <= near and 4 not in near
    assert {r.doc_id for r in alignments(index, places).collect()} >= {1}


def test_long_texts_and_clashing_names(spark):
    rng = random.Random(8)
    item = " ".join(f"i{k}" for k in range(25))
    filler = lambda n: " ".join(rng.choice(["the", "of", "i1", "i2"]) for _ in range(n))
    texts = [(1, filler(30000) + " " + item + " " + filler(30000)), (2, filler(30000))]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in texts], "doc_id long, text string, pos int, words string, item_id string")
    bench = spark.createDataFrame([(1, item, 3, "w", 9), (1, item, 4, "v", 9)], "item_id long, text string, width int, words string, iid long")
    got = sorted(tuple(r) for r in decontaminate(docs, bench).collect())
    assert got == sorted((i, *brute(t, [(1, item)])) for i, t in texts)
    assert clean(docs, bench).columns == docs.columns
