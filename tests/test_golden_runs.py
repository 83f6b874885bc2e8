from pyspark.sql import functions as F

from riskloom.operators import risk

#: Features of four recorded runs (zeros left out), and the risk and decision that were recorded.
RUNS = [
    ({"log_churn": 1.6094, "author_is_new": 1.0, "szz_defects": 1.0, "verified_bug_links": 1.0}, 0.3091, "PASS"),
    ({"log_churn": 1.6094, "author_is_new": 1.0, "mutation_score": 0.5, "surviving_mutants": 1.0, "refuted_claim_ratio": 0.3077}, 0.3554, "PASS"),
    ({"log_churn": 1.0986, "author_is_new": 1.0, "szz_defects": 2.0, "verified_test_failures": 1.0, "mutation_score": 0.3333, "surviving_mutants": 2.0, "verified_bug_links": 1.0}, 0.9981, "BLOCK"),
    ({"log_churn": 1.0986, "author_is_new": 1.0, "szz_defects": 1.0, "mutation_score": 0.25, "surviving_mutants": 3.0, "verified_bug_links": 1.0}, 0.8895, "BLOCK"),
]


def test_recorded_runs_score_the_same(spark):
    for features, want, decision in RUNS:
        row = risk.with_defaults(spark.range(1).select(*(F.lit(v).alias(k) for k, v in features.items())))
        got = row.withColumn("risk", risk.platt(risk.raw_score())).withColumn("d", risk.decide(F.col("risk"), F.col("verified_test_failures"))).first()
        assert (round(got.risk, 4), got.d) == (want, decision)


def test_explanations_name_the_strongest_parts(spark):
    row = risk.with_defaults(spark.createDataFrame([(1, 2.0, 1.0)], "id int, szz_defects double, verified_test_failures double"))
    parts = risk.contributions(row, "id")
    assert parts.where("place = 1").first().feature == "verified_test_failures"
    assert risk.explain(parts, "id").first().explanation.startswith("verified test failures raises risk")
