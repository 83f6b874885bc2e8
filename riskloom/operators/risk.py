"""Risk: feature vectors, logistic scoring, calibration, thresholds and the release policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.functions.scalars import logit, sigmoid
from riskloom.operators.evaluation import curve
from riskloom.operators.graph import cut

#: Features in order, with their group and default where it is not 0.
FEATURES = {
    "jit": ["log_churn", "files_touched", "change_units", "entropy", "author_is_new", "log_author_prior_commits", "log_code_age_days", "recent_churn", "complexity_delta", "max_complexity", "szz_defects", "touches_dependencies", "touches_config", "touches_ci", "signature_changes", "test_only", "docs_only", "tests_changed"],
    "verified": ["verified_test_failures", "changed_line_coverage", "uncovered_changed_lines", "mutation_score", "surviving_mutants", "verified_impacted_tests", "verified_impacted_modules", "verified_api_breaks", "verified_bug_links", "refuted_claim_ratio"],
    "llm": ["llm_risk"],
    "guard": ["injection_attempts"],
}
NAMES = [n for group in FEATURES.values() for n in group]
DEFAULTS = {n: 0.0 for n in NAMES} | {"changed_line_coverage": 1.0, "mutation_score": 1.0, "llm_risk": 0.5}
#: The direction in which a feature may move the risk of the constrained model; features left out are free.
DIRECTIONS = {
    "log_churn": 1, "files_touched": 1, "entropy": 1, "author_is_new": 1, "recent_churn": 1, "complexity_delta": 1, "max_complexity": 1, "szz_defects": 1, "touches_dependencies": 1,
    "touches_config": 1, "touches_ci": 1, "verified_test_failures": 1, "uncovered_changed_lines": 1, "surviving_mutants": 1, "verified_api_breaks": 1, "verified_bug_links": 1, "llm_risk": 1,
    "injection_attempts": 1, "verified_impacted_modules": 1, "signature_changes": 1, "change_units": 1, "refuted_claim_ratio": 1,
    "log_code_age_days": -1, "log_author_prior_commits": -1, "test_only": -1, "docs_only": -1, "tests_changed": -1, "changed_line_coverage": -1, "mutation_score": -1,
}
#: Expert weights, calibration and thresholds of the shipped model.
INTERCEPT = -0.9
WEIGHTS = {"verified_test_failures": 3.0, "uncovered_changed_lines": 0.18, "surviving_mutants": 0.45, "szz_defects": 0.55, "verified_bug_links": 0.35, "verified_api_breaks": 1.2, "log_churn": 0.35, "entropy": 0.4, "author_is_new": 0.25, "touches_dependencies": 0.9, "touches_ci": 0.6, "signature_changes": 0.4, "injection_attempts": 0.6, "llm_risk": 0.8, "changed_line_coverage": -1.4, "mutation_score": -1.2, "test_only": -1.8, "docs_only": -2.5}
PLATT = (1.3955752932259922, 1.1307516776121225)
CANARY, BLOCK = 0.4982, 0.8672


def groups() -> dict[str, list[str]]:
    """The feature lists of the baselines and ablations."""
    without = lambda *gone: [n for n in NAMES if n not in gone]
    return {"jit": FEATURES["jit"], "full": NAMES, "no_llm": without(*FEATURES["llm"]), "no_verification": without(*FEATURES["verified"]), "no_mutation": without("mutation_score", "surviving_mutants"), "no_history": without("szz_defects", "verified_bug_links")}


def with_defaults(df: DataFrame) -> DataFrame:
    """df with every feature as a double; a missing or null one has its default."""
    have = set(df.columns)
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(DEFAULTS[n])) if n in have else F.lit(DEFAULTS[n]) for n in NAMES})


#: What a verified claim of each type counts for.
CLAIM_FEATURES = {"test_impact": "verified_impacted_tests", "module_impact": "verified_impacted_modules", "api_break": "verified_api_breaks", "history_link": "verified_bug_links"}


def claim_features(claims: DataFrame, key: str) -> DataFrame:
    """key and the features from claims (key, type, status): verified ones by type, and the share of checked ones that is refuted."""
    fine, wrong = F.col("status") == "VERIFIED", F.col("status") == "REFUTED"
    counts = [F.count_if(fine & (F.col("type") == t)).cast("double").alias(n) for t, n in CLAIM_FEATURES.items()]
    ratio = F.round(F.count_if(wrong) / F.nullif(F.count_if(fine | wrong), F.lit(0)), 4)
    return claims.groupBy(key).agg(*counts, F.coalesce(ratio, F.lit(0.0)).alias("refuted_claim_ratio"))


def change_features(signals: DataFrame, key: str, verification: DataFrame | None = None, claims: DataFrame | None = None, ratings: DataFrame | None = None) -> DataFrame:
    """key and all features of every change, each with its default where nothing is known.

    signals: key and what history and diff say (author_prior_commits and code_age_days as they are, the other features of
    the first group by name, injection_attempts); verification: key, new_failures, changed_coverage, uncovered,
    mutation_score (null without mutants), survived; claims: key, type, status; ratings: key, llm_risk.
    """
    have = set(signals.columns)
    raw = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in have else F.lit(0.0)
    rows = signals.withColumns({"log_author_prior_commits": F.log1p(raw("author_prior_commits")), "log_code_age_days": F.log1p(F.greatest(raw("code_age_days"), F.lit(0.0)))})
    if verification is not None:
        v = verification.select(key, F.col("new_failures").alias("verified_test_failures"), F.round("changed_coverage", 4).alias("changed_line_coverage"), F.col("uncovered").alias("uncovered_changed_lines"), F.round("mutation_score", 4).alias("mutation_score"), F.col("survived").alias("surviving_mutants"))
        rows = rows.join(v, key, "left")
    if claims is not None:
        rows = rows.join(claim_features(claims, key), key, "left")
    if ratings is not None:
        rows = rows.join(ratings.select(key, "llm_risk"), key, "left")
    return with_defaults(rows).select(key, *NAMES)


def raw_score(weights: dict[str, float] = WEIGHTS, intercept: float = INTERCEPT, mean: dict[str, float] | None = None, scale: dict[str, float] | None = None) -> Column:
    """The logistic model's probability from feature columns; a scale of 0 counts as 1."""
    z = F.lit(intercept)
    for name, w in weights.items():
        z = z + F.lit(w) * (F.col(name) - (mean or {}).get(name, 0.0)) / ((scale or {}).get(name, 1.0) or 1.0)
    return sigmoid(z)


def platt(score: Column, a: float = PLATT[0], b: float = PLATT[1]) -> Column:
    return 1 / (1 + F.exp(-(F.lit(a) * logit(score) + F.lit(b))))


def decide(risk: Column, failures: Column, canary: float = CANARY, block: float = BLOCK) -> Column:
    return F.when(failures > 0, "BLOCK").when(risk >= block, "BLOCK").when(risk >= canary, "CANARY").otherwise("PASS")


def contributions(df: DataFrame, key: str, weights: dict[str, float] = WEIGHTS, top: int = 8, digits: int | None = None) -> DataFrame:
    """key, feature, contribution, place: the largest parts of each row's score by size, ties by feature; digits: sizes are compared rounded.

    A row's parts are few and are put in order inside the row: nothing is shuffled or sorted across rows.
    """
    part = lambda n, w: F.lit(w) * F.col(n)
    size = lambda v: F.abs(v if digits is None else F.round(v, digits))
    parts = F.array(*(F.struct((-size(part(n, w))).alias("o"), F.lit(n).alias("feature"), part(n, w).alias("contribution")) for n, w in weights.items()))
    long = df.select(key, F.posexplode(F.slice(F.array_sort(parts), 1, top)).alias("place", "p"))
    return long.select(key, "p.feature", "p.contribution", (F.col("place") + 1).alias("place"))


def explain(parts: DataFrame, key: str, least: float = 0.05, top: int = 3) -> DataFrame:
    """key, explanation: the strongest contributions in words."""
    told = parts.where(F.abs("contribution") >= least).where(F.col("place") <= top)
    text = F.concat(F.replace(F.col("feature"), F.lit("_"), F.lit(" ")), F.when(F.col("contribution") > 0, " raises risk").otherwise(" lowers risk"))
    return told.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]), "; ").alias("explanation"))


def thresholds(scored: DataFrame, score: str = "score", label: str = "label", max_false_block: float = 0.05, canary_recall: float = 0.9) -> DataFrame:
    """One row canary, block; 0.35 and 0.65 where a class is missing.

    Counts at or above each distinct score are running sums over a range-partitioned table.
    """
    cum = curve(scored, score, label)
    block = F.min(F.when(F.col("fp") <= F.col("n_neg") * max_false_block, F.col(score)))
    # the floor(0.1 n)-th defective score from below, 0-based: the largest score with at least n - that index positives at or above it
    index = F.floor(F.col("n_pos") * (1 - canary_recall))
    canary = F.max(F.when(F.col("tp") >= F.col("n_pos") - index, F.col(score)))
    one = cum.agg(block.alias("b"), canary.alias("c"), F.max("n_neg").alias("n0"), F.max("n_pos").alias("n1"))
    fine = (F.col("n0") > 0) & (F.col("n1") > 0)
    b = F.coalesce("b", F.lit(1.0))
    return one.select(F.when(fine, F.round(F.least("c", b), 4)).otherwise(0.35).alias("canary"), F.when(fine, F.round(F.least(b, F.lit(1.0)), 4)).otherwise(0.65).alias("block"))


def fit_platt(scored: DataFrame, score: str = "score", label: str = "label", rounds: int = 30) -> tuple[float, float] | None:
    """(a, b) by Newton's method, each round one aggregation; None with a single class."""
    rows = scored.select(logit(F.col(score)).alias("x"), F.col(label).cast("double").alias("y"))
    n = rows.agg(F.sum("y"), F.count("*")).first()
    if not n[0] or n[0] == n[1]:
        return None
    x = cut(rows.groupBy("x").agg(F.sum("y").alias("y"), F.count("*").alias("k")))  # rounds read a row for each different score
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
        gap, v = F.col("k") * p - F.col("y"), F.col("k") * p * (1 - p)
        g0, g1, h00, h01, h11 = x.agg(F.sum(gap), F.sum(gap * F.col("x")), F.sum(v), F.sum(v * F.col("x")), F.sum(v * F.col("x") * F.col("x"))).first()
        h00, h11, g1 = h00 + 1e-9, h11 + 1e-6, g1 + 1e-6 * a
        det = h00 * h11 - h01 * h01
        da, db = (h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def fit_isotonic(scored: DataFrame, score: str = "score", label: str = "label"):
    """An isotonic model with values held to [0.001, 0.999] by its caller; linear between its points."""
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=score, labelCol=label).fit(scored.select(F.col(score).cast("double"), F.col(label).cast("double")))


def fit_calibrator(scored: DataFrame, score: str = "score", label: str = "label", method: str = "auto"):
    """("isotonic", model) with 60 rows or more, ("platt", (a, b)) with fewer, None with one class."""
    n, kinds = scored.agg(F.count("*"), F.countDistinct(label)).first()
    if kinds < 2:
        return None
    if method == "isotonic" or (method == "auto" and n >= 60):
        return "isotonic", fit_isotonic(scored, score, label)
    return "platt", fit_platt(scored, score, label)


def fit_bounded_logistic(df: DataFrame, features: list[str], directions: dict[str, int], label: str = "label", l2: float = 1.0):
    """A class-balanced logistic model whose weights keep the signs asked for (+1: at least 0, -1: at most 0)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Matrices

    n, pos = df.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    weight = F.when(F.col(label) == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df.withColumn("_w", weight).withColumn("_y", F.col(label).cast("double")))
    low = [0.0 if directions.get(f) == 1 else float("-inf") for f in features]
    high = [0.0 if directions.get(f) == -1 else float("inf") for f in features]
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=l2 / n, standardization=False, maxIter=200, lowerBoundsOnCoefficients=Matrices.dense(1, len(features), low), upperBoundsOnCoefficients=Matrices.dense(1, len(features), high))
    return lr.fit(rows)


def fit_boosted(df: DataFrame, features: list[str], label: str = "label", rounds: int = 50):
    """Gradient-boosted trees; stands for the reference's boosted model, whose numbers it does not repeat."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df.withColumn("_y", F.col(label).cast("double")))
    return GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=rounds, maxDepth=4, seed=7).fit(rows)


def best_family(scores: DataFrame, family: str = "family", value: str = "pr_auc") -> DataFrame:
    """The model family with the highest value; the first by name on ties."""
    return scores.agg(F.min_by(family, F.struct(-F.col(value), F.col(family))).alias(family), F.max(value).alias(value))


def save_model(path: str, spark, weights: dict[str, float], intercept: float, calibration: tuple[float, float], canary: float, block: float, metadata: dict[str, str] | None = None) -> None:
    """The model as one row of JSON: plain numbers and names, nothing to unpickle."""
    row = (list(weights), [float(w) for w in weights.values()], float(intercept), [float(c) for c in calibration], float(canary), float(block), metadata or {})
    spark.createDataFrame([row], MODEL).coalesce(1).write.mode("overwrite").json(path)


MODEL = "feature_names array<string>, coef array<double>, intercept double, calibrator array<double>, canary double, block double, metadata map<string,string>"


def load_model(path: str, spark) -> dict:
    """The model as it was saved: weights by name, intercept, calibrator, canary, block, metadata."""
    row = spark.read.schema(MODEL).json(path).first()
    return {"weights": dict(zip(row.feature_names, row.coef, strict=True)), "intercept": row.intercept, "calibrator": tuple(row.calibrator), "canary": row.canary, "block": row.block, "metadata": dict(row.metadata or {})}


def model_card(weights: dict[str, float], spark) -> DataFrame:
    """feature, group, coefficient, direction of the model, one row each."""
    of = {n: g for g, names in FEATURES.items() for n in names}
    return spark.createDataFrame([(n, of[n], float(weights.get(n, 0.0))) for n in NAMES], "feature string, grp string, coefficient double").withColumn("direction", F.signum("coefficient").cast("int"))
