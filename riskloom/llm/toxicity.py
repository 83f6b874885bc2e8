"""Toxicity (operator 1): weak supervision with a generative label model, then a linear classifier.

1. A sample of labelled rows (SAMPLE at most, those of least id hash, never of the held-out fold) gives the lexicon:
   words and word heads that stand in far more toxic than other texts. Each term is a voter, beside pattern voters
   (shouting, runs of marks, drawn-out letters, disguised lexicon terms) and a voter for clean prose.
2. The label model fits the voters' rates for each hidden class by expectation and maximisation, with the given label
   as one more fallible voter. From the posteriors it estimates which voters fire together beyond what the class
   explains, and divides the weight of each by its correlated mass, so that copies of one signal count once.
3. A ridge logistic model of the voters is trained on the posterior labels by Newton's method. It scores every text.

Labels, lang, source and doc_id are never inputs of a score. Texts are scored whole. Null and empty texts score like a
text in which nothing fires. Rows without a label, or with a null one, are not learned from. Without any toxic label,
only the fixed seed terms vote. Repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_arrow, passed, words_of

#: Labelled rows to learn from; what is collected to the driver stems from them alone.
SAMPLE = 20_000
#: Lengths of word heads; a head is a true beginning of a word.
HEADS = (4, 5)
#: Fixed seed terms: common English insults.
SEEDS = ["idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown", "bastard", "bitch", "asshole", "fuck", "shit", "retard", "whore", "vermin"]
_SHOUT = re.compile(r"(?:\b[A-Z]{3,}\b\W*){4,}")
_MARKS = re.compile(r"[!?]{3,}")
_DRAWN = re.compile(rb"([a-z])\1{2,}")
_RUNS = re.compile(rb"[a-z0-9@$!]+")
_MARKER = re.compile(rb"[0-9@$!]")
_SPACED = re.compile(rb"(?<![a-z])(?:[a-z][ .*_-]){3,}[a-z](?![a-z])")
_DECODE = bytes.maketrans(b"013457@$!", b"oieastasi")
PATTERNS = ["shout", "marks", "masked", "drawn", "seed", "any term", "two terms", "clean prose"]


@dataclass
class Model:
    terms: dict[bytes, int]  # voter numbers of words
    heads: dict[bytes, int]  # and of word heads
    weights: np.ndarray  # of terms and heads, then of PATTERNS
    bias: float


def _heads(words: set[bytes]) -> set[bytes]:
    return {w[:k] for k in HEADS for w in words if len(w) > k}


def fired(text: str | None, terms: dict[bytes, int], heads: dict[bytes, int]) -> list[int]:
    """The numbers of the voters that fire on a text; patterns follow the terms and heads."""
    n = len(terms) + len(heads)
    words = set(words_of(text))
    own = {terms[w] for w in words & terms.keys()}
    own |= {heads[h] for h in _heads(words) & heads.keys()}
    out = sorted(own)
    low = (text or "").encode("utf-8", "surrogatepass").lower()
    known = lambda w: w in terms or w in _SEEDS
    flags = [
        bool(text and _SHOUT.search(text)),
        bool(text and _MARKS.search(text)),
        any(known(w.translate(_DECODE)) and not known(w) for w in set(_RUNS.findall(low)) if _MARKER.search(w)) or any(known(re.sub(rb"[^a-z]", b"", m)) for m in _SPACED.findall(low)),
        any(known(_DRAWN.sub(rb"\1", w)) and not known(w) for w in words if _DRAWN.search(w)),
        not _SEEDS.isdisjoint(words),
        bool(own),
        len(own) > 1,
        len(words) >= 20 and not own,
    ]
    return out + [n + i for i, x in enumerate(flags) if x]


_SEEDS = frozenset(s.encode() for s in SEEDS)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """text, toxic of at most `bound` labelled rows outside the held-out fold, by least hash of the id."""
    own = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "toxic")


def lexicon(sample: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """The words and the word heads that mark toxic texts, most telling first: those that stand in a hundredth of the toxic texts
    (and four) at least, and in a tenth as many others at most. Equal texts count once."""

    def make():
        def step(rows):
            seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for text, toxic in zip(rows["text"], rows["toxic"], strict=True):
                words = set(words_of(text))
                seen[bool(toxic)].update(b"w" + w for w in words)
                seen[bool(toxic)].update(b"h" + h for h in _heads(words))
            terms = list(seen[True].keys() | seen[False].keys())
            return {"term": terms, "bad": [seen[True][t] for t in terms], "good": [seen[False][t] for t in terms]}

        return step

    sample = sample.dropDuplicates(["text", "toxic"])
    counts = map_arrow(sample, ["text", "toxic"], "term binary, bad bigint, good bigint", make, rows=4096)
    totals = sample.agg(F.sum("toxic"), F.count("*")).first()
    n_bad, n_good = totals[0] or 0, (totals[1] or 0) - (totals[0] or 0)
    if not n_bad:
        return [], []
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    sums = counts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    told = sums.where((F.col("bad") >= max(4, n_bad * 0.01)) & (F.col("good") <= F.col("bad") * 0.1)).withColumn("gain", odds * F.col("bad"))
    rows = [bytes(r.term) for r in told.orderBy(F.desc("gain"), "term").collect()]
    return [t[1:] for t in rows if t[:1] == b"w"], [t[1:] for t in rows if t[:1] == b"h"]


def label_model(votes: np.ndarray, label: np.ndarray, count: np.ndarray | None = None, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, rate of each voter by class, correlated mass of each voter).

    votes: rows x voters of 0 and 1; label: the given label of each row, a voter of its own; count: how often a row stands.
    """
    c = np.ones(len(votes)) if count is None else count.astype(np.float64)
    x = np.concatenate([votes, label[:, None], 1 - label[:, None]], axis=1).astype(np.float64)
    p = np.where(label > 0, 0.95, 0.05)
    mass = np.ones(x.shape[1])
    for k in range(rounds):
        prior = np.clip((c * p).sum() / c.sum(), 1e-3, 1 - 1e-3)
        of = np.stack([c * (1 - p), c * p])
        rate = np.clip((of @ x + 0.1) / (of.sum(1, keepdims=True) + 0.2), 1e-4, 1 - 1e-4)
        if k >= 2:  # what fires together beyond the class: conditional correlations of the voters
            mean = np.outer(1 - p, rate[0]) + np.outer(p, rate[1])
            left = (x - mean) * np.sqrt(c / c.sum())[:, None]
            shared = left.T @ left
            scale = np.sqrt(shared.diagonal()) + 1e-6
            mass = 1 + np.clip(shared / np.outer(scale, scale) - np.eye(x.shape[1]), 0, 1).sum(0)
            mass[-2:] = 1
        told = (np.log(rate[1]) - np.log(rate[0])) / mass
        quiet = (np.log1p(-rate[1]) - np.log1p(-rate[0])) / mass
        score = np.log(prior / (1 - prior)) + x @ told + (1 - x) @ quiet
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - p).max() < 1e-4:
            p = new
            break
        p = new
    return p, rate, mass


def fit_linear(x: np.ndarray, target: np.ndarray, count: np.ndarray | None = None, ridge: float = 0.3, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of soft targets, by Newton's method; count: how often a row stands."""
    c = np.ones(len(x)) if count is None else count.astype(np.float64)
    full = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    w = np.zeros(full.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        grad = full.T @ (c * (q - target)) + penalty * w
        hess = (full * (c * (q * (1 - q) + 1e-6))[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled(docs, labels)
    words, heads = lexicon(sample)
    terms, tops = {t: i for i, t in enumerate(words)}, {h: len(words) + i for i, h in enumerate(heads)}
    n = len(terms) + len(tops) + len(PATTERNS)

    def make():
        return lambda rows: {"votes": [fired(t, terms, tops) for t in rows["text"]], "toxic": rows["toxic"]}

    rows = map_arrow(sample, ["text", "toxic"], "votes array<int>, toxic int", make).collect() if words or heads else []
    if not rows:
        weights = np.zeros(n)
        weights[len(terms) + len(tops) + PATTERNS.index("seed")] = 4.0
        return Model(terms, tops, weights, -3.0)
    # rows that vote alike are one row with a count; sorted, so that sums don't depend on the order of arrival
    alike = sorted(Counter((tuple(r.votes), int(r.toxic > 0)) for r in rows).items())
    votes = np.zeros((len(alike), n), np.float32)
    for i, ((own, _), _) in enumerate(alike):
        votes[i, list(own)] = 1
    label, count = np.array([float(y) for (_, y), _ in alike]), np.array([k for _, k in alike])
    posterior, _, _ = label_model(votes, label, count)
    weights, bias = fit_linear(votes, posterior, count)
    return Model(terms, tops, weights, bias)


def scores(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The columns named and score, for every row of docs."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        w = m.weights.tolist()

        def one(text):
            z = m.bias + sum(w[i] for i in fired(text, m.terms, m.heads))
            return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))

        return lambda rows: {c: rows[c] for c in columns} | {"score": [one(t) for t in rows["text"]]}

    return map_arrow(docs, [*columns, *(["text"] if "text" not in columns else [])], f"{kinds}, score double", make)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scored = scores(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is under 0.5, in their columns."""
    model = train(docs, labels)
    return passed(docs, "text", lambda: _judge(model))


def _judge(model: Model):
    w = model.weights.tolist()
    return lambda text: model.bias + sum(w[i] for i in fired(text, model.terms, model.heads)) < 0
