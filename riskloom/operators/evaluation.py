"""Evaluation statistics over scored rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.operators.ordering import ranked, running
from riskloom.session import importable

#: Terms of a binomial tail that one row stands for until they are summed.
TAIL = 100_000


def bin_of(p: Column, bins: int = 10) -> Column:
    """The equal-width bin of a probability, the last one closed on the right."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def reliability(df: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """bin, lo, hi, count, mean_pred, frac_pos of the bins that have rows."""
    b = df.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("count"), F.avg(score).alias("mean_pred"), F.avg(F.col(label).cast("double")).alias("frac_pos"))
    return b.select("bin", (F.col("bin") / bins).alias("lo"), ((F.col("bin") + 1) / bins).alias("hi"), "count", "mean_pred", "frac_pos")


def calibration(df: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """One row brier, ece, n."""
    squares = df.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.sum(F.col(label).cast("double")).alias("y"), F.sum((F.col(score) - F.col(label)) ** 2).alias("b"))
    return squares.agg((F.sum("b") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def curve(df: DataFrame, score: str = "score", label: str = "label", group: list[str] | None = None) -> DataFrame:
    """group, score, tp, fp, n_pos, n_neg: counts at or above every distinct score.

    Rows are reduced to one for each distinct score before the running sum, so that the window sees scores, not rows.
    """
    keys = group or []
    per = df.groupBy(*keys, score).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) == 0).cast("bigint")).alias("neg"))
    if not keys:
        whole = df.agg(F.coalesce(F.sum((F.col(label) == 1).cast("bigint")), F.lit(0)).alias("n_pos"), F.coalesce(F.sum((F.col(label) == 0).cast("bigint")), F.lit(0)).alias("n_neg"))
        return running(per, [F.desc(score)], {"tp": "pos", "fp": "neg"}).join(F.broadcast(whole)).select(score, "pos", "neg", "tp", "fp", "n_pos", "n_neg")
    return _cumulated(per, keys, score)


def _cumulated(per: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Counts at or above every score of each group; per: a row for each group and score, with pos and neg."""
    own, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(F.desc(score))
    return per.select(*keys, score, "pos", "neg", F.sum("pos").over(order).alias("tp"), F.sum("neg").over(order).alias("fp"), F.sum("pos").over(own).alias("n_pos"), F.sum("neg").over(own).alias("n_neg"))


def ranking_scores(df: DataFrame, score: str = "score", label: str = "label", group: list[str] | None = None, max_fpr: float = 0.05) -> DataFrame:
    """group, roc_auc, pr_auc, recall_at_fpr: null where a class is missing.

    ROC AUC counts ties half; PR AUC is the sum of recall steps times precision.
    """
    return _ranked_scores(curve(df, score, label, group), group or [], max_fpr)


def _ranked_scores(c: DataFrame, keys: list[str], max_fpr: float = 0.05) -> DataFrame:
    fine = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / F.max(F.col("n_pos") * F.col("n_neg").cast("double"))
    ap = F.sum(F.col("pos") / F.col("n_pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    recall = F.coalesce(F.max(F.when(F.col("fp") <= F.col("n_neg") * max_fpr, F.col("tp") / F.col("n_pos"))), F.lit(0.0))
    return c.where(fine).groupBy(*keys).agg(auc.alias("roc_auc"), ap.alias("pr_auc"), recall.alias("recall_at_fpr"))


def set_scores(predicted: Column, actual: Column) -> Column:
    """precision, recall, f1 of two arrays as sets: nothing predicted is right only if nothing is there."""
    p, a = F.array_distinct(predicted), F.array_distinct(actual)
    hit = F.size(F.array_intersect(p, a))
    precision = F.when(F.size(p) == 0, F.when(F.size(a) == 0, 1.0).otherwise(0.0)).otherwise(hit / F.nullif(F.size(p), F.lit(0)))
    recall = F.when(F.size(a) == 0, 1.0).otherwise(hit / F.nullif(F.size(a), F.lit(0)))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), hit.alias("hit"))


def _log_factorial(n: Column) -> Column:
    """ln(n!): exact up to 20, beyond that Stirling's series, whose error is under 1e-12."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def mcnemar(pairs: DataFrame, a: str, b: str, group: list[str] | None = None) -> DataFrame:
    """group, only_a, only_b, p: the exact two-sided test of two methods' rightness on the same rows.

    The binomial tail is a sum over logarithms of factorials, term by term, dealt over the tasks by range.
    """
    keys = group or []
    n = pairs.groupBy(*keys).agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    total, low = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    parts = n.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), low, F.lit(TAIL).cast("bigint"))))
    terms = parts.withColumn("_i", F.explode(F.sequence("_from", F.least(low, F.col("_from") + TAIL - 1))))
    p = F.sum(F.exp(_log_factorial(total) - _log_factorial(F.col("_i")) - _log_factorial(total - F.col("_i")) - total * math.log(2.0)))
    return terms.groupBy(*keys, "only_a", "only_b").agg(F.least(2 * p, F.lit(1.0)).alias("p"))


def wilcoxon(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row n, w, z: signed ranks of the differences that are not 0 (average ranks on ties), normal approximation."""
    d = pairs.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0")
    per = d.groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("k"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    placed = running(per, [F.col("m")], {"upto": "k"}).withColumn("rank", F.col("upto") - F.col("k") + (F.col("k") + 1) / 2.0)
    s = placed.agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("wp"), F.sum(F.col("rank") * F.col("down")).alias("wm"), F.sum(F.col("k") ** 3 - F.col("k")).alias("ties"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select("n", F.least("wp", "wm").alias("w"), ((F.least("wp", "wm") - n * (n + 1) / 4) / sd).alias("z"))


def bootstrap(df: DataFrame, metric: str = "mean", score: str = "score", label: str = "label", replicas: int = 1000, seed: int = 4011) -> DataFrame:
    """low, high: the 2.5 % and 97.5 % points of a metric (mean of the label, roc_auc, pr_auc) over resamples.

    Equal rows are one cell first; a cell of k rows weighs Poisson(k) in a replica, so that the work follows the
    different scores. Replicas with a single class are skipped. The random numbers depend on the seed and the cell only.
    """
    cells = df.groupBy(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y")).agg(F.count("*").alias("k"))
    importable(df.sparkSession)
    schema = "r int, s double, y double, w bigint"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, y, k in zip(*(batch.column(c).to_pylist() for c in ("s", "y", "k")), strict=True):
                own = int.from_bytes(hashlib.sha256(f"{s!r} {y!r}".encode()).digest()[:8], "little")
                w = np.random.default_rng([seed, own]).poisson(k, replicas)
                r = np.flatnonzero(w)
                full = lambda x: pa.array(np.full(len(r), np.nan if x is None else x), pa.float64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), full(s), full(y), pa.array(w[r], pa.int64())], names=["r", "s", "y", "w"])

    drawn = cells.mapInArrow(draw, schema)
    if metric == "mean":
        values = drawn.groupBy("r").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("m"))
    else:
        per = drawn.groupBy("r", "s").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).alias("neg"))
        values = _ranked_scores(_cumulated(per, ["r"], "s"), ["r"]).select("r", F.col(metric).alias("m"))
    return values.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def time_split(df: DataFrame, *order: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """df with split: the oldest part trains, the next validates, the rest tests; bounds are truncated row counts."""
    total = df.agg(F.count("*").alias("_n"))
    rows = ranked(df, [F.col(c) for c in order], "_rn").join(F.broadcast(total))
    return rows.withColumn("split", F.when(F.col("_rn") <= F.floor(F.col("_n") * train), "train").when(F.col("_rn") <= F.floor(F.col("_n") * (train + validation)), "validation").otherwise("test")).drop("_n", "_rn")


def forward_chain(df: DataFrame, base: str, label: str | None = None) -> DataFrame:
    """fold, role and the rows: fold k tests base k, validates on base k-1 and trains on all before; the first two bases are never tested.

    With a label, folds whose training rows have a single class are left out. Bases (releases) are counted by their order,
    a global rank over range partitions; rows meet the folds that use them by an explode.
    """
    counts = df.groupBy(base).agg(F.count("*").alias("_n"), *([F.min(label).alias("_lo"), F.max(label).alias("_hi")] if label else []))
    bases = ranked(counts, [F.col(base)], "_k").withColumn("_k", F.col("_k") - 1)
    last = bases.agg(F.max("_k").alias("_last"))
    spread = bases.join(F.broadcast(last)).where("_last >= 2").withColumn("fold", F.explode(F.sequence(F.greatest("_k", F.lit(2)), F.greatest("_last", F.lit(2)))))
    role = F.when(F.col("_k") == F.col("fold"), "test").when(F.col("_k") == F.col("fold") - 1, "validation").otherwise("train")
    spread = spread.withColumn("role", role)
    if label:
        both = spread.where("role = 'train'").groupBy("fold").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).where("lo < hi").select("fold")
        spread = spread.join(both, "fold", "left_semi")
    return df.join(spread.select(base, "fold", "role"), base).select("fold", "role", *df.columns)


def leave_one_out(df: DataFrame, group: str, *order: str, train: float = 0.75) -> DataFrame:
    """fold, role and the rows: each group is tested once; of the others the oldest part trains and the rest validates.

    The groups (repositories) are few and named on the driver; each fold is one global order of the other rows.
    """
    folds = []
    for row in df.select(group).distinct().orderBy(group).collect():
        mine = F.col(group).eqNullSafe(F.lit(row[0]))
        rest = time_split(df.where(~mine), *order, train=train, validation=1 - train)
        rest = rest.withColumn("role", F.when(F.col("split") == "train", "train").otherwise("validation")).drop("split")
        folds.append(rest.unionByName(df.where(mine).withColumn("role", F.lit("test"))).withColumn("fold", F.lit(row[0])))
    return reduce(DataFrame.unionByName, folds).select("fold", "role", *df.columns)


def production_split(df: DataFrame, base: str) -> DataFrame:
    """df with role: the rows of the latest base calibrate and choose thresholds, all before them fit."""
    latest = df.agg(F.max(base).alias("_latest"))
    return df.join(F.broadcast(latest)).withColumn("role", F.when(F.col(base) == F.col("_latest"), "calibrate").otherwise("fit")).drop("_latest")


def gate_decision(tests_fail: Column, score: Column, block: Column, canary: Column) -> Column:
    """A verified failure blocks; else the score meets the thresholds."""
    return F.when((tests_fail > 0) | (score >= block), "BLOCK").when(score >= canary, "CANARY").otherwise("PASS")


def arms(rows: DataFrame, of: dict[str, tuple[Column, Column, Column, Column, bool]]) -> DataFrame:
    """method, score, block, canary, tests_fail, own and the columns of rows: the same rows under several methods, in one pass.

    of: by method its score, its block and canary thresholds, its failed tests (0 for methods that do not run them), and
    whether it honours verified failures (own). Rows without a score of a method are left out of it.
    """
    each = [F.struct(F.lit(m).alias("method"), s.cast("double").alias("score"), b.cast("double").alias("block"), c.cast("double").alias("canary"), t.cast("int").alias("tests_fail"), F.lit(own).alias("own")) for m, (s, b, c, t, own) in of.items()]
    gone = [c for c in rows.columns if c in ("method", "score", "block", "canary", "tests_fail", "own")]
    return rows.withColumn("_a", F.explode(F.array(*each))).drop(*gone).select("*", "_a.*").drop("_a").where("score is not null")


def gate_evaluation(preds: DataFrame, label: str = "label") -> DataFrame:
    """method, n, roc_auc, pr_auc, recall_at_fpr, brier, false_block_rate, block_recall, defective_passed of each method.

    preds: what arms() gives, with a label. Methods of their own block by decision, the others by their threshold alone.
    Scores of a method without one of the classes are null.
    """
    d = preds.withColumn("_d", gate_decision(F.col("tests_fail"), F.col("score"), F.col("block"), F.col("canary")))
    d = d.withColumn("_b", F.when(F.col("own"), F.col("_d") == "BLOCK").otherwise(F.col("score") >= F.col("block")).cast("double"))
    bad = F.col(label) == 1
    rates = d.groupBy("method").agg(F.count("*").alias("n"), F.avg((F.col("score") - F.col(label)) ** 2).alias("brier"), F.avg(F.when(~bad, F.col("_b"))).alias("false_block_rate"), F.avg(F.when(bad, F.col("_b"))).alias("block_recall"), F.count_if(bad & F.when(F.col("own"), F.col("_d") == "PASS").otherwise(F.col("score") < F.col("block"))).alias("defective_passed"))
    return rates.join(ranking_scores(preds, "score", label, ["method"]), "method", "left").select("method", "n", "roc_auc", "pr_auc", "recall_at_fpr", "brier", "false_block_rate", "block_recall", "defective_passed")


def against_reference(preds: DataFrame, key: str, reference: str, label: str = "label") -> DataFrame:
    """method, only_a, only_b, p: the exact test of each method's rightness against the reference method's, on the ids both have."""
    d = gate_decision(F.col("tests_fail"), F.col("score"), F.col("block"), F.col("canary"))
    right = preds.select("method", key, (F.when(F.col("own"), d == "BLOCK").otherwise(F.col("score") >= F.col("block")) == (F.col(label) == 1)).alias("right"))
    ours = right.where(F.col("method") == reference).select(key, F.col("right").alias("ours"))
    return mcnemar(right.where(F.col("method") != reference).join(ours, key), "ours", "right", ["method"])


def per_category(preds: DataFrame, category: str = "category", label: str = "label") -> DataFrame:
    """method, category, n, defective, PASS, CANARY, BLOCK."""
    d = gate_decision(F.col("tests_fail"), F.col("score"), F.col("block"), F.col("canary"))
    n = lambda x: F.count_if(F.col("_d") == x).alias(x)
    return preds.withColumn("_d", d).groupBy("method", category).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("defective"), n("PASS"), n("CANARY"), n("BLOCK"))


def twins(rows: DataFrame, key: str, suffix: str) -> DataFrame:
    """The rows whose key ends with the suffix, each beside the row of the key without it (its columns with _twin)."""
    own = rows.where(F.col(key).endswith(suffix)).withColumn("_twin", F.expr(f"left({key}, length({key}) - {len(suffix)})"))
    other = rows.select(F.col(key).alias("_twin"), *(F.col(c).alias(f"{c}_twin") for c in rows.columns if c != key))
    return own.join(other, "_twin").drop("_twin")


def paired_shift(rows: DataFrame, key: str, suffix: str, value: str) -> DataFrame:
    """One row pairs, shift: how far the value of attacked rows lies from that of their clean twins, on average."""
    return twins(rows.where(F.col(value).isNotNull()), key, suffix).agg(F.count("*").alias("pairs"), F.avg(F.col(value) - F.col(f"{value}_twin")).alias("shift"))


def differing(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, differ of the rows that both runs have: whether any of the columns is not the same; nulls are alike."""
    other = b.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))
    return a.select(key, *columns).join(other, key).select(key, (~same).alias("differ"))


def citation_scores(answers: DataFrame, gold: DataFrame, aliases: DataFrame) -> DataFrame:
    """item, category, correct, citation_precision, hallucinated of each answer.

    answers: item, category, refused, refusal_expected, citations (array); gold: item, gold; aliases: gold, alias. A citation
    matches if it equals a gold id, begins with it, is its alias, or is any commit where the gold id says "commit".
    Precision is null without citations; where a refusal is expected, refusing is right and answering is a hallucination.
    """
    wanted = gold.join(aliases, "gold", "left").select("item", "gold", "alias")
    cited = answers.select("item", F.explode(F.array_distinct("citations")).alias("c"))
    hit = F.col("c").startswith(F.when(F.col("gold") == "commit", "commit:").otherwise(F.col("gold"))) | F.coalesce(F.col("c") == F.col("alias"), F.lit(False))
    hits = cited.join(wanted, "item").where(hit).select("item", "c").distinct().groupBy("item").agg(F.count("*").alias("hits"))
    n = F.size(F.array_distinct("citations"))
    rows = answers.join(hits, "item", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    correct = F.when(F.col("refusal_expected"), F.col("refused")).otherwise(~F.col("refused") & (F.col("hits") > 0))
    return rows.select("item", "category", correct.alias("correct"), F.when(n > 0, F.col("hits") / F.nullif(n, F.lit(0))).alias("citation_precision"), (F.col("refusal_expected") & ~F.col("refused")).alias("hallucinated"))


def rate_summary(rows: DataFrame, group: str, rates: dict[str, tuple[str, str]]) -> DataFrame:
    """group, n and the named rates: sum of one column over the sum of another, null where that is 0."""
    each = [(F.sum(a).cast("double") / F.nullif(F.sum(b).cast("double"), F.lit(0.0))).alias(name) for name, (a, b) in rates.items()]
    return rows.groupBy(group).agg(F.count("*").alias("n"), *each)
