"""Queries of evaluation statistics: labels against scores made from the documents' lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.operators import evaluation as E
from riskloom.operators import risk as R
from riskloom.operators.ordering import percentiles
from riskloom.plans.registry import query, table

_S = "s AS (SELECT d.doc_id, lang, source, round(least(d.n_chars, 10000) / 10000.0, 3) AS score, quality AS label, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"
_C = f"WITH {_S}, p AS (SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM s GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS n1, sum(neg) OVER () AS n0 FROM p)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "lang", "source", F.round(F.least("n_chars", F.lit(10000)) / 10000.0, 3).alias("score"), F.col("quality").alias("label"), "toxic")


@query(f"{_C} SELECT round(sum(neg * (tp - pos / 2)) / max(n1 * n0), 4) AS roc_auc, round(sum(pos / n1 * tp / (tp + fp)), 4) AS pr_auc, round(coalesce(max(CASE WHEN fp <= n0 * 0.05 THEN tp / n1 END), 0), 4) AS recall_at_fpr FROM c")
def ranking_quality(spark: SparkSession, d: str) -> DataFrame:
    """ROC AUC, PR AUC and recall at 5 % false positives."""
    return E.ranking_scores(scored(spark, d)).select(*(F.round(c, 4).alias(c) for c in ("roc_auc", "pr_auc", "recall_at_fpr")))


@query(f"{_C} SELECT score, round(tp / n1, 4) AS tpr, round(fp / n0, 4) AS fpr, round(tp / (tp + fp), 4) AS prec FROM c")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    """B2: points of the ROC and PR curves."""
    c = E.curve(scored(spark, d))
    return c.select("score", F.round(F.col("tp") / F.col("n_pos"), 4).alias("tpr"), F.round(F.col("fp") / F.col("n_neg"), 4).alias("fpr"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 4).alias("prec"))


@query(f"WITH {_S} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS \"count\", round(avg(score), 4) AS mean_pred, round(avg(label), 4) AS frac_pos FROM s GROUP BY 1")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    """Reliability by ten equal bins."""
    return E.reliability(scored(spark, d)).select("bin", "count", F.round("mean_pred", 4).alias("mean_pred"), F.round("frac_pos", 4).alias("frac_pos"))


@query(f"WITH {_S}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, sum(score) AS s, sum(label) AS y, sum((score - label) * (score - label)) AS q FROM s GROUP BY 1) SELECT round(sum(q) / sum(n), 4) AS brier, round(sum(abs(s - y)) / sum(n), 4) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    """Brier score and expected calibration error."""
    return E.calibration(scored(spark, d)).select(F.round("brier", 4).alias("brier"), F.round("ece", 4).alias("ece"), "n")


@query(f"""WITH {_S}, p AS (SELECT lang, score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM s GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY lang ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY lang) AS n1, sum(neg) OVER (PARTITION BY lang) AS n0 FROM p)
SELECT lang AS method, round(sum(neg * (tp - pos / 2)) / max(n1 * n0), 4) AS roc_auc, round(sum(pos / n1 * tp / (tp + fp)), 4) AS pr_auc FROM c WHERE n1 > 0 AND n0 > 0 GROUP BY 1""")
def gate_table(spark: SparkSession, d: str) -> DataFrame:
    """B1: one row of scores for each method."""
    return E.ranking_scores(scored(spark, d), group=["lang"]).select(F.col("lang").alias("method"), F.round("roc_auc", 4).alias("roc_auc"), F.round("pr_auc", 4).alias("pr_auc"))


@query(f"""WITH {_S}, x AS (SELECT CAST(count(*) FILTER (WHERE (score >= 0.1) = (label = 1) AND NOT ((score >= 0.5) = (label = 1))) AS BIGINT) AS only_a, CAST(count(*) FILTER (WHERE NOT ((score >= 0.1) = (label = 1)) AND (score >= 0.5) = (label = 1)) AS BIGINT) AS only_b FROM s),
f AS (SELECT i, sum(CASE WHEN i > 0 THEN ln(i) ELSE 0 END) OVER (ORDER BY i) AS lf FROM (SELECT unnest(range(0, 200001)) AS i))
SELECT only_a, only_b, round(least(1, 2 * sum(exp(t.lf - a.lf - b.lf - (only_a + only_b) * ln(2.0)))), 6) AS p FROM x JOIN f t ON t.i = only_a + only_b JOIN f a ON a.i <= least(only_a, only_b) JOIN f b ON b.i = only_a + only_b - a.i GROUP BY 1, 2""")
def mcnemar_test(spark: SparkSession, d: str) -> DataFrame:
    """The exact McNemar test of two cut-offs on the same rows."""
    right = lambda t: (F.col("score") >= t) == (F.col("label") == 1)
    pairs = scored(spark, d).select(right(0.1).alias("a"), right(0.5).alias("b"))
    return E.mcnemar(pairs, "a", "b").withColumn("p", F.round("p", 6))


@query(f"""WITH {_S}, x AS (SELECT round(score - 0.2, 3) AS d FROM s), y AS (SELECT abs(d) AS m, count(*) AS k, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down FROM x WHERE d <> 0 GROUP BY 1),
r AS (SELECT *, sum(k) OVER (ORDER BY m) - k + (k + 1) / 2.0 AS rk FROM y), z AS (SELECT CAST(sum(k) AS BIGINT) AS n, sum(rk * up) AS wp, sum(rk * down) AS wm, sum(CAST(k AS DOUBLE) * k * k - k) AS ties FROM r)
SELECT n, CAST(least(wp, wm) AS DOUBLE) AS w, round((least(wp, wm) - n * (n + 1) / 4.0) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 4) AS z FROM z""")
def signed_rank_test(spark: SparkSession, d: str) -> DataFrame:
    """The Wilcoxon signed-rank statistic of paired values."""
    pairs = scored(spark, d).select(F.round(F.col("score") - 0.2, 3).alias("x"), F.lit(0.0).alias("y"))
    return E.wilcoxon(pairs, "x", "y").select("n", F.col("w").cast("double").alias("w"), F.round("z", 4).alias("z"))


@query()
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap intervals of both areas and of a mean, 1000 replicas; random, so without SQL (tests bound them)."""
    rows = scored(spark, d)
    one = lambda m: E.bootstrap(rows, m).select(F.lit(m).alias("metric"), "low", "high")
    return one("roc_auc").unionAll(one("pr_auc")).unionAll(one("mean"))


@query(f"""WITH {_S}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS rn, count(*) OVER () AS n FROM s) SELECT doc_id, CASE WHEN rn <= floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * (CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE))) THEN 'validation' ELSE 'test' END AS split FROM r""")
def time_split(spark: SparkSession, d: str) -> DataFrame:
    """The 60/20/20 split in order."""
    return E.time_split(scored(spark, d), "score", "doc_id").select("doc_id", "split")


@query(f"""WITH {_S}, b AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k FROM (SELECT DISTINCT source FROM s)), f AS (SELECT k AS fold FROM b WHERE k >= 2)
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN k = fold THEN 'test' WHEN k = fold - 1 THEN 'validation' ELSE 'train' END AS role, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM s JOIN b USING (source) JOIN f ON k <= fold GROUP BY 1, 2""")
def forward_chaining(spark: SparkSession, d: str) -> DataFrame:
    """Forward chaining over bases in order."""
    return E.forward_chain(scored(spark, d), "source").groupBy(F.col("fold").cast("int").alias("fold"), "role").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))


@query("""WITH a AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
j AS (SELECT a.l_orderkey, len(p) AS np, len(q) AS nq, len(list_intersect(p, q)) AS h FROM a JOIN b USING (l_orderkey))
SELECT l_orderkey AS change_id, round(h / np, 4) AS prec, round(h / nq, 4) AS recall, CASE WHEN h = 0 THEN 0 ELSE round(2.0 * h / (np + nq), 4) END AS f1 FROM j""")
def impact_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of sets of tests."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")  # noqa: E741
    a = l.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("p"))
    b = l.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("q"))
    s = a.join(b, "l_orderkey").select(F.col("l_orderkey").alias("change_id"), E.set_scores(F.col("p"), F.col("q")).alias("s"))
    return s.select("change_id", F.round("s.precision", 4).alias("prec"), F.round("s.recall", 4).alias("recall"), F.round("s.f1", 4).alias("f1"))


@query("""WITH a AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
j AS (SELECT coalesce(len(p), 0) AS np, len(q) AS nq, coalesce(len(list_intersect(p, q)), 0) AS h FROM b LEFT JOIN a USING (l_orderkey))
SELECT round(avg(CASE WHEN np = 0 THEN 0 ELSE h / np END), 4) AS macro_precision, round(avg(h / nq), 4) AS macro_recall, round(sum(h) / sum(np), 4) AS micro_precision, round(sum(h) / sum(nq), 4) AS micro_recall FROM j""")
def macro_micro(spark: SparkSession, d: str) -> DataFrame:
    """Macro and micro precision and recall over rows that have something to find."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")  # noqa: E741
    a = l.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("p"))
    b = l.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("q"))
    s = b.join(a, "l_orderkey", "left").withColumn("p", F.coalesce("p", F.array().cast("array<bigint>"))).select(E.set_scores(F.col("p"), F.col("q")).alias("s"), F.size("p").alias("np"), F.size("q").alias("nq"))
    return s.agg(F.round(F.avg("s.precision"), 4).alias("macro_precision"), F.round(F.avg("s.recall"), 4).alias("macro_recall"), F.round(F.sum("s.hit") / F.sum("np"), 4).alias("micro_precision"), F.round(F.sum("s.hit") / F.sum("nq"), 4).alias("micro_recall"))


@query("SELECT l_returnflag AS kind, round(CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) / count(*), 4) AS before, round(CAST(count(*) FILTER (WHERE l_linestatus = 'F' AND l_quantity > 25) AS DOUBLE) / nullif(count(*) FILTER (WHERE l_quantity > 25), 0), 4) AS after, round(1 - CAST(count(*) FILTER (WHERE l_linestatus = 'F' AND l_quantity > 25) AS DOUBLE) / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0), 4) AS recall_cost FROM lineitem GROUP BY 1")
def claim_precision(spark: SparkSession, d: str) -> DataFrame:
    """Precision of claims before and after verification, and the true claims lost."""
    true, kept = F.col("l_linestatus") == "F", F.col("l_quantity") > 25
    ratio = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 4)
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(ratio(true, F.lit(True)).alias("before"), ratio(true & kept, kept).alias("after"), F.round(1 - F.count_if(true & kept) / F.nullif(F.count_if(true), F.lit(0)), 4).alias("recall_cost"))


@query("SELECT l_returnflag AS attack, count(*) AS n, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END), 4) AS success, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 4) AS guarded FROM lineitem GROUP BY 1")
def robustness(spark: SparkSession, d: str) -> DataFrame:
    """Attack success and guard rate by attack."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("attack")).agg(F.count("*").alias("n"), share(F.col("l_linestatus") == "O").alias("success"), share(F.col("l_discount") > 0.05).alias("guarded"))


@query("SELECT event_type AS stage, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def efficiency(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median and 95th percentile (linear) of each stage."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), "value")
    means = rows.groupBy("stage").agg(F.round(F.avg("value"), 4).alias("mean"))
    p = percentiles(rows, "stage", "value", {"p50": 0.5, "p95": 0.95})
    return means.join(p, "stage", "left").select("stage", "mean", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query("SELECT CAST(floor(o_totalprice / 100000) AS BIGINT) AS rating, count(*) FILTER (WHERE o_orderstatus = 'F') AS bad, count(*) FILTER (WHERE o_orderstatus <> 'F') AS good FROM orders GROUP BY 1")
def rating_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Ratings by outcome."""
    return table(spark, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 100000).alias("rating")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("bad"), F.count_if(F.col("o_orderstatus") != "F").alias("good"))


@query("SELECT lang AS category, count(*) AS n, round(avg(CASE WHEN toxic = 1 THEN NULL ELSE quality END), 4) AS prec, round(avg(quality), 4) AS answered FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def qa_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means that skip nulls."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("toxic") != 1, F.col("quality"))), 4).alias("prec"), F.round(F.avg("quality"), 4).alias("answered"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem WHERE l_linestatus = 'F') SELECT l_returnflag AS category, l_orderkey, l_linenumber FROM r WHERE rn <= 50")
def category_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of every category, in order."""
    rn = F.row_number().over(W.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").where("l_linestatus = 'F'").withColumn("rn", rn).where("rn <= 50").select(F.col("l_returnflag").alias("category"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey AS task FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'")
def failed_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks with failures and no success."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), "l_returnflag")  # noqa: E741
    return l.where("l_returnflag = 'R'").select("task").subtract(l.where("l_returnflag = 'A'").select("task"))


@query("SELECT l_orderkey AS change_id, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS defective, count(DISTINCT l_suppkey) AS impacted FROM lineitem GROUP BY 1")
def oracle_labels(spark: SparkSession, d: str) -> DataFrame:
    """A change is defective if a test that passed before does not pass."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("change_id")).agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("defective"), F.countDistinct("l_suppkey").alias("impacted"))


@query(f"""WITH {_S}, p AS (SELECT lang, score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM s GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY lang ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY lang) AS n1, sum(neg) OVER (PARTITION BY lang) AS n0 FROM p),
k AS (SELECT lang AS family, sum(pos / n1 * tp / (tp + fp)) AS pr_auc FROM c WHERE n1 > 0 AND n0 > 0 GROUP BY 1) SELECT family, round(pr_auc, 4) AS pr_auc FROM k ORDER BY k.pr_auc DESC, family LIMIT 1""")
def best_family(spark: SparkSession, d: str) -> DataFrame:
    """The family with the highest area under the precision-recall curve."""
    areas = E.ranking_scores(scored(spark, d), group=["lang"]).withColumnRenamed("lang", "family")
    return R.best_family(areas).select("family", F.round("pr_auc", 4).alias("pr_auc"))


@query()
def platt_fit(spark: SparkSession, d: str) -> DataFrame:
    """V7: calibration by Newton's method; iterative, so without SQL (a test holds it against a direct fit)."""
    from riskloom.operators.risk import fit_platt

    a, b = fit_platt(scored(spark, d)) or (1.0, 0.0)
    return spark.createDataFrame([(float(a), float(b))], "a double, b double")


@query()
def isotonic_fit(spark: SparkSession, d: str) -> DataFrame:
    """V7: isotonic calibration; iterative, so without SQL."""
    from riskloom.operators.risk import fit_isotonic

    rows = scored(spark, d)
    out = fit_isotonic(rows).transform(rows.select("doc_id", F.col("score").cast("double").alias("score")))
    return out.select("doc_id", F.round(F.greatest(F.least("prediction", F.lit(0.999)), F.lit(0.001)), 6).alias("calibrated"))


@query()
def bounded_logistic(spark: SparkSession, d: str) -> DataFrame:
    """V5, V6: a class-balanced logistic model whose weights keep their signs; iterative, so without SQL."""
    from riskloom.operators.risk import fit_bounded_logistic

    rows = scored(spark, d).select("label", "score", F.col("toxic").cast("double").alias("bad"), (1 - F.col("score")).alias("rest"))
    m = fit_bounded_logistic(rows, ["score", "bad", "rest"], {"score": 1, "bad": -1})
    return spark.createDataFrame([(n, float(w)) for n, w in zip(["score", "bad", "rest"], m.coefficients.toArray(), strict=True)], "feature string, weight double")
