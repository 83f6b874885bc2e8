import random
from collections import Counter

import numpy as np

from riskloom.llm.bagminhash import bags, deduplicated, link, near_duplicate_classes, overlap, signatures
from riskloom.llm.common import LONGS, possible, words_of


def bag(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    if not a or not b:
        return float(a == b)
    return sum((a & b).values()) / sum((a | b).values())


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    for _ in range(6):
        base = [rng.choice("abcdefg") + str(rng.randrange(9)) for _ in range(120)] * rng.choice([1, 3])
        other = [w if rng.random() > 0.04 else "zz" for w in base] + base[: rng.randrange(90)]
        a, b = " ".join(base), " ".join(other)
        s = signatures(*bags([words_of(a), words_of(b)]), 2, slots=4096)
        true = jaccard(bag(a), bag(b))
        assert abs(np.mean(s[0] == s[1]) - true) < 0.04
        assert abs(overlap(words_of(a), words_of(b)) - true) < 1e-12


def test_classes_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdehilnopé") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(rng.randint(1, 200))] for _ in range(40)]
    texts = []
    for _ in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [None, "", "...", "one two", "One  two!", "a " * 20000, "a " * 19990]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    b = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(b[i], b[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, uid long").repartition(5)
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicate_classes(docs).collect()}
    sizes = Counter(find(i) for i in range(len(texts)))
    wrong = [i for i in range(len(texts)) if got[i] != (find(i), sizes[find(i)])]
    assert wrong == []
    kept = deduplicated(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {find(i) for i in range(len(texts))}


def test_null_and_repeated_keys(spark):
    docs = spark.createDataFrame([(None, "same words here", "k"), (5, "Same words, here", "k"), (5, "same WORDS here", None)], "doc_id long, text string, key string")
    assert {(r.doc_id, r.class_id, r.class_size) for r in near_duplicate_classes(docs).collect()} == {(None, 5, 3), (5, 5, 3)}
    assert deduplicated(docs).count() == 1 and deduplicated(docs).columns == docs.columns


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, key string")
    assert near_duplicate_classes(docs).count() == 0 and deduplicated(docs).count() == 0


def roots_of(spark, texts, bands):
    """The root of each node, as link() finds it when node i has text i and bands i; the bits rule out nothing."""
    t = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    n = spark.createDataFrame([(i, [*b, *(1000 * i + k + 10**6 for k in range(25 - len(b)))], [100] + [0] * LONGS) for i, b in enumerate(bands)], "node long, bands array<long>, bits array<long>")
    got = {r.node: r.root for r in link(t, n, 0.8).collect()}
    return [got.get(i, i) for i in range(len(texts))]


def test_every_link_of_a_crowded_bucket_is_found(spark):
    texts = [" ".join(f"w{i // 2}x{k}" for k in range(100)) + " end" * (i % 2) for i in range(100)]
    assert roots_of(spark, texts, [[7]] * 100) == [i - i % 2 for i in range(100)]


def test_links_between_members_that_lead_no_component_are_found(spark):
    texts, bands = [], []
    for g in range(20):
        for place, own in ((0, 1), (1, 1), (3, 2), (2, 2)):  # a1, a2, b1, b2: only a2 and b2 are near
            texts.append(" ".join(f"g{g}w{k}" for k in range(8 * place, 8 * place + 100)))
            bands.append([10 * g, 10 * g + own])
    assert roots_of(spark, texts, bands) == [i - i % 4 for i in range(80)]


def test_the_filter_before_verification_passes_every_link(spark):
    from riskloom.llm.bagminhash import parities

    rng = random.Random(9)
    texts, links = [], []
    while len(links) < 1500:
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randint(20, 150))]
        other = list(base)
        for _ in range(max(1, len(base) // 50)):
            other[rng.randrange(len(other))] = "new"
        texts += [" ".join(base), " ".join(other)]
        links.append(0.8 <= jaccard(bag(texts[-2]), bag(texts[-1])))
    bits = parities(*bags([words_of(t) for t in texts]), len(texts)).tolist()
    rows = [(i, bits[2 * i], bits[2 * i + 1]) for i in range(len(links))]
    far = [(-1 - i, bits[2 * i], bits[2 * i + 3]) for i in range(99)]
    pairs = spark.createDataFrame(rows + far, "i long, x array<long>, y array<long>")
    pairs = pairs.select("i", *(pairs[c][k].alias(f"{n}{k}") for c, n in (("x", "a"), ("y", "b")) for k in range(LONGS + 1)))
    got = {r.i for r in pairs.where(possible(0.8)).collect()}
    assert sum(links) > 500 and all(i in got for i, link in enumerate(links) if link)
    assert not any(i < 0 for i in got)
