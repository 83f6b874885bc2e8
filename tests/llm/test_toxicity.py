import math
import random
import time

import numpy as np

from riskloom.llm import toxicity
from riskloom.llm.toxicity import fit_linear, keep_clean, label_model


def corpus(n, seed=1):
    rng = random.Random(seed)
    bad = ["zorgh", "blarkin", "blarkol", "blarkus", "idiot", "gnuff"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdeinost") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.2)
        for _ in range(2 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "src"))
        if rng.random() < 0.7:
            labels.append((i, 1, toxic if rng.random() > 0.01 else 1 - toxic))
        docs[-1] = (*docs[-1], toxic)
    return docs, labels


def test_held_out_accuracy_and_filter(spark):
    docs, labels = corpus(1500)
    d = spark.createDataFrame([(i, t, s) for i, t, s, _ in docs] + [(9001, None, None), (9002, "", ""), (None, "idiot blarkin", "x")], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    truth = {i: y for i, _, _, y in docs}
    held = [i for i in truth if got[i].held_out]
    assert 0.1 < len(held) / len(truth) < 0.3
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[9001].score == got[9002].score < 0.5 and got[None].predicted == 1
    kept = keep_clean(d, lab)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_no_labels_and_empty(spark):
    d = spark.createDataFrame([(1, "you stupid idiot"), (2, "a calm text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(d, none).collect()} == {1: 1, 2: 0}
    assert toxicity.toxicity(d.limit(0), none).count() == 0


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.3).astype(float)
    vote = lambda hit, miss: (rng.random(3000) < np.where(y > 0, hit, miss)).astype(float)
    weak, strong = vote(0.5, 0.4), vote(0.9, 0.05)
    votes = np.stack([weak, weak, weak, weak, strong, vote(0.8, 0.1)], axis=1)
    label = np.where(rng.random(3000) < 0.03, 1 - y, y)
    p, rate, mass = label_model(votes, label)
    assert mass[0] > 3 and mass[4] < 1.5
    assert ((p > 0.5) == y).mean() > 0.96 and rate[1, 4] > 0.8
    w, b = fit_linear(votes, p)
    assert w[4] > w[0] and b < 0


def plain_label_model(votes, label, rounds):
    """The model written out with loops over plain numbers."""
    rows = [[*v, y, 1 - y] for v, y in zip(votes, label, strict=True)]
    n, m = len(rows), len(rows[0])
    p, mass = [0.95 if y else 0.05 for y in label], [1.0] * m
    for k in range(rounds):
        prior = min(max(sum(p) / n, 1e-3), 1 - 1e-3)
        rate = [[min(max((sum((q if c else 1 - q) * r[j] for q, r in zip(p, rows, strict=True)) + 0.1) / (sum(q if c else 1 - q for q in p) + 0.2), 1e-4), 1 - 1e-4) for j in range(m)] for c in (0, 1)]
        if k >= 2:
            left = [[r[j] - (1 - q) * rate[0][j] - q * rate[1][j] for j in range(m)] for q, r in zip(p, rows, strict=True)]
            shared = [[sum(x[i] * x[j] for x in left) / n for j in range(m)] for i in range(m)]
            scale = [math.sqrt(shared[j][j]) + 1e-6 for j in range(m)]
            mass = [1 + sum(min(max(shared[i][j] / scale[i] / scale[j] - (i == j), 0), 1) for i in range(m)) for j in range(m)]
            mass[-2:] = [1.0, 1.0]
        new = []
        for r in rows:
            z = math.log(prior / (1 - prior))
            for j in range(m):
                z += (math.log(rate[1][j] / rate[0][j]) if r[j] else math.log((1 - rate[1][j]) / (1 - rate[0][j]))) / mass[j]
            new.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
        done, p = max(abs(a - b) for a, b in zip(p, new, strict=True)) < 1e-4, new
        if done:
            break
    return p


def test_label_model_and_fit_against_plain_versions():
    rng = random.Random(6)
    label = [int(rng.random() < 0.3) for _ in range(120)]
    votes = [[int(rng.random() < (0.7 if y else 0.1)), int(rng.random() < (0.4 if y else 0.2)), int(rng.random() < 0.5)] for y in label]
    given = [1 - y if rng.random() < 0.05 else y for y in label]
    p, _, _ = label_model(np.array(votes, float), np.array(given, float))
    assert np.allclose(p, plain_label_model(votes, given, 25), atol=1e-9)
    w, b = fit_linear(np.array(votes, float), p)
    q = [1 / (1 + math.exp(-(b + sum(x * y for x, y in zip(v, w, strict=True))))) for v in votes]
    grad = [sum((a - t) * v[j] for a, t, v in zip(q, p, votes, strict=True)) + 0.3 * w[j] for j in range(3)]  # at the least loss the gradient is zero
    assert max(map(abs, grad)) < 1e-3 and abs(sum(a - t for a, t in zip(q, p, strict=True)) + 1e-3 * b) < 1e-3


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 300_000, "ab" * 150_000 + "1", "!" * 300_000, "a b " * 100_000, "A" * 300_000):
        toxicity.fired(text, {b"zorgh": 0}, {b"blar": 1})
    assert time.time() - began < 5
    assert 2 + toxicity.PATTERNS.index("masked") in toxicity.fired("z0rgh", {b"zorgh": 0}, {b"blar": 1})


def test_repeated_rows_clashing_names_and_long_texts(spark):
    docs, labels = corpus(400, 3)
    rows = [(i, t, 0.5, True, "p") for i, t, _, _ in docs] + [(0, docs[0][1], None, None, None), (7000, "word " * 40000, 1.0, False, "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean, predicted string")
    lab = spark.createDataFrame(labels + labels[:50], "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.toxicity(d, lab).collect()]
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 0}) == 1
    assert keep_clean(d, lab).columns == d.columns
