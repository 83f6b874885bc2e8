import math

from pyspark.sql import functions as F

from riskloom.operators import campus as C
from riskloom.operators import evaluation as E
from riskloom.operators import graph as G
from riskloom.operators import relations as R
from riskloom.operators import retrieval as Q
from riskloom.operators import risk
from riskloom.streaming import canary


def test_policy_and_defaults(spark):
    d = lambda r, f: spark.range(1).select(risk.decide(F.lit(r), F.lit(f), 0.3, 0.7).alias("x")).first().x
    assert [d(0.1, 0), d(0.5, 0), d(0.8, 0), d(0.05, 1)] == ["PASS", "CANARY", "BLOCK", "BLOCK"]
    row = risk.with_defaults(spark.range(1)).first()
    assert (row.mutation_score, row.changed_line_coverage, row.llm_risk, row.entropy) == (1.0, 1.0, 0.5, 0.0)
    assert len(risk.NAMES) == 30 and len(risk.groups()["jit"]) == 18


def test_thresholds_respect_their_budget(spark):
    rows = [(i / 200, int(i % 7 == 0 or i > 150)) for i in range(200)]
    df = spark.createDataFrame(rows, "score double, label int")
    t = risk.thresholds(df).first()
    benign = [s for s, y in rows if y == 0]
    bad = [s for s, y in rows if y == 1]
    assert sum(s >= t.block for s in benign) / len(benign) <= 0.05 and sum(s >= t.canary for s in bad) / len(bad) >= 0.9
    one = risk.thresholds(df.where("label = 0")).first()
    assert (one.canary, one.block) == (0.35, 0.65)


def test_bounded_logistic_keeps_signs(spark):
    rows = [(i % 2, float(i % 2) + (i % 5) * 0.1, float(-(i % 2)) + (i % 3) * 0.1) for i in range(120)]
    m = risk.fit_bounded_logistic(spark.createDataFrame(rows, "label int, a double, b double"), ["a", "b"], {"a": 1, "b": 1})
    a, b = m.coefficients.toArray()
    assert a > 0 and b == 0.0


def test_calibration_statistics(spark):
    df = lambda rows: spark.createDataFrame(rows, "label int, score double")
    assert E.calibration(df([(0, 0.0), (0, 0.0), (1, 1.0), (1, 1.0)])).first().brier == 0
    half = [(0, 0.5), (0, 0.5), (1, 0.5), (1, 0.5)]
    assert abs(E.calibration(df(half)).first().ece) < 1e-12
    assert abs(E.calibration(df([(y, 0.9) for y, _ in half])).first().ece - 0.4) < 1e-12
    assert E.reliability(df([(0, 0.2), (1, 1.0)]), bins=2).where("bin = 1").first().frac_pos == 1.0
    assert risk.fit_calibrator(df([(1, 0.3), (1, 0.4)])) is None
    s = E.ranking_scores(df([(0, 0.1), (1, 0.9), (0, 0.5), (1, 0.5)])).first()
    assert abs(s.roc_auc - 0.875) < 1e-12


def test_platt_recovers_parameters(spark):
    a, b = 1.7, -0.4
    rows = []
    for i in range(1, 60):
        s = i / 60
        p = 1 / (1 + math.exp(-(a * math.log(s / (1 - s)) + b)))
        rows += [(s, 1)] * round(1000 * p) + [(s, 0)] * round(1000 * (1 - p))
    fa, fb = risk.fit_platt(spark.createDataFrame(rows, "score double, label int"))
    assert abs(fa - a) < 0.02 and abs(fb - b) < 0.02


def test_set_scores_and_mcnemar(spark):
    f = lambda p, a: spark.createDataFrame([(p, a)], "p array<string>, a array<string>").select(E.set_scores(F.col("p"), F.col("a")).alias("s")).first().s
    assert f(["a", "b"], ["b", "c"]).f1 == 0.5 and f([], []).precision == 1.0 and f([], ["a"]).precision == 0.0
    same = spark.createDataFrame([(True, True)] * 5, "a boolean, b boolean")
    assert E.mcnemar(same, "a", "b").first().p == 1.0
    far = spark.createDataFrame([(True, False)] * 20, "a boolean, b boolean")
    assert E.mcnemar(far, "a", "b").first().p < 0.001


def test_forward_chaining_never_looks_ahead(spark):
    rows = E.forward_chain(spark.createDataFrame([(i % 4,) for i in range(20)], "base int"), "base").collect()
    assert {r.fold for r in rows if r.role == "test"} == {2, 3}
    assert all(r.base < r.fold for r in rows if r.role != "test")


def test_graph(spark):
    e = spark.createDataFrame([("test_gpa", "gpa", "calls"), ("gpa", "total", "calls"), ("tuition", "total", "calls"), ("late", "invoice", "inherits")], "src string, dst string, type string")
    up = {r.node: r.distance for r in G.walk(e, spark.createDataFrame([("total",)], "seed string"), 3, reverse=True).collect()}
    assert up == {"gpa": 1, "tuition": 1, "test_gpa": 2}
    assert G.shortest_path(e, "test_gpa", "total", 4).first().path == ["test_gpa", "gpa", "total"]
    assert G.shortest_path(e, "total", "gpa", 4).count() == 0
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (0, 1)], "src long, dst long")
    assert {r.node for r in G.closure(ring, spark.createDataFrame([(1,)], "seed long")).collect()} == {1, 2, 3}
    layers, cyclic = G.topological_layers(ring)
    assert {r.node for r in layers.collect()} == {0} and {r.node for r in cyclic.collect()} == {1, 2, 3}
    names = spark.createDataFrame([("Box.pack.fmt",)], "name string")
    assert G.enclosing(names, spark.createDataFrame([("Box",), ("Box.pack",)], "qualname string")).first().symbol == "Box.pack"
    files = spark.createDataFrame([("app/gpa.py",), ("src/lib/__init__.py",)], "path string")
    imps = spark.createDataFrame([("app/billing.py", "gpa", 1), ("app/billing.py", "lib", 0), ("app/x.py", "none", 0)], "importer string, module string, level int")
    assert {(r.module, r.path) for r in G.resolve_modules(imps, files).collect()} == {("gpa", "app/gpa.py"), ("lib", "src/lib/__init__.py")}


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "late fee grace period"), (2, "grade point average")], "id long, text string")
    q = spark.createDataFrame([(7, "grace period")], "id long, text string")
    terms = Q.postings(q, "id", "text").select(F.col("doc").alias("qid"), "term", F.col("tf").alias("n"))
    assert Q.bm25(Q.postings(docs, "id", "text"), terms, 5).first().doc == 1
    same = spark.createDataFrame([(1, "student credits"), (2, "student credits"), (3, "canary proxy")], "id long, text string")
    v = Q.hashed_vector(same, "id", "text", 256)
    near = {r.doc: r.score for r in Q.sparse_nearest(v, v.where("doc = 1"), 3).collect()}
    assert abs(near[1] - 1) < 1e-9 and abs(near[2] - 1) < 1e-9 and near.get(3, 0) < 0.9
    ranks = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (1, "a", "z", 3), (1, "b", "y", 1), (1, "b", "x", 2), (1, "c", "y", 1)], "qid int, source string, doc string, rank int")
    fused = Q.fuse(ranks).orderBy(F.desc("score"), "doc").collect()
    assert [r.doc for r in fused] == ["y", "x", "z"] and fused[0].sources == ["a", "b", "c"]


def test_relations(spark):
    points = spark.createDataFrame([("m", 18), ("m", 15), ("m", 2)], "path string, line int")
    spans = spark.createDataFrame([("m", 10, 30, "Store", 0), ("m", 17, 20, "Store.get", 1)], "path string, lo int, hi int, sym string, ord int")
    assert {r.line: r.sym for r in R.innermost(points, spans, "path", "line", "lo", "hi", "ord").collect()} == {18: "Store.get", 15: "Store"}
    tests = spark.createDataFrame([("t",), ("t[1]",), ("t2",)], "test_id string")
    assert {r.test_id for r in R.variants(spark.createDataFrame([("t",)], "target string"), tests).collect()} == {"t", "t[1]"}
    cost = spark.createDataFrame([(1, "a", 0, 50.0), (1, "b", 1, 40.0), (1, "c", 1, 45.0), (1, "d", 2, 9.0)], "k int, item string, priority int, cost double")
    assert R.budget_prefix(cost, "k", 100.0).first().kept == ["a", "b", "d"]
    have = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "k int, i string")
    assert [r.k for r in R.divide(have, spark.createDataFrame([("x",), ("y",)], "i string"), "k", "i").collect()] == [1]


def test_campus(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    letters = [one(C.letter(F.lit(s))) for s in (93.0, 92.99, 90.0, 85.0, 72.0, 60.0, 59.9, 0.0)]
    assert letters == ["A", "A-", "A-", "B", "C-", "D", "F", "F"]
    assert one(C.grace(F.lit(58.0))) == 60.0 and one(C.grace(F.lit(57.9))) == 57.9
    rows = spark.createDataFrame([("s", 3, "A"), ("s", 4, "B+"), ("s", 2, "W"), ("t", 3, None)], "student_id string, credits int, grade string")
    got = {r.student_id: float(r.gpa) for r in C.gpa(rows, "student_id").collect()}
    assert got == {"s": 3.6, "t": 0.0}
    rate = lambda d: float(one(C.late_fee_rate(F.to_date(F.lit("2024-01-01")), F.to_date(F.lit(d)))))
    assert [rate("2024-01-04"), rate("2024-01-05"), rate("2024-01-09"), rate("2024-06-01")] == [0.0, 0.02, 0.04, 0.10]


def test_canary(spark):
    snaps = spark.createDataFrame([("canary", 0.0, 100, 1, 5.0), ("canary", 1.0, 300, 5, 7.0)], "version string, t double, requests long, errors long, p95_ms double")
    r = canary.readings(snaps, ["version"]).first()
    assert (r.requests, r.errors, r.error_rate, r.p95_ms) == (200, 4, 0.02, 7.0)
    v = lambda n, rate, p95: spark.range(1).select(canary.verdict(F.lit(0.0), F.lit(10.0), F.lit(n), F.lit(rate), F.lit(p95)).alias("v")).first().v
    assert v(100, 0.0, 12.0).healthy and not v(100, 0.02, 12.0).healthy and v(100, 0.0, 100.0).breaches == ["p95"]
    assert v(3, 0.5, 12.0).healthy and v(3, 0.5, 12.0).inconclusive
    assert sum(canary.weighted_credit(100, 0.25)) == 25 and sum(canary.weighted_credit(1000, 0.1)) == 99
    i = spark.range(1, 1001).withColumnRenamed("id", "i")
    assert canary.route(i, 0.1).where("canary").count() == 100
    steps = [("a", 1, 0.1, True, True)] + [("a", k, 0.1, True, True) for k in range(2, 5)] + [("a", 5, 0.5, True, False), ("b", 1, 0.1, True, False), ("b", 2, 0.5, False, False)]
    out = {r.k: (r.outcome, r.steps) for r in canary.rollout(spark.createDataFrame(steps, "k string, ord int, weight double, healthy boolean, inconclusive boolean"), "k").collect()}
    assert out == {"a": ("promoted", 2), "b": ("rolled_back", 2)}


def test_nearest_vectors_of_more_queries_than_a_block(spark):
    v = spark.range(40).selectExpr("id as doc", "array(cast(id % 7 as double), cast(id % 5 as double), 1D) as v")
    q = v.selectExpr("doc as qid", "v as q")
    rows = lambda limit: sorted(tuple(r) for r in Q.dense_nearest(v, q, 3, limit).collect())
    assert len(rows(7)) == 120 and rows(7) == rows(100)


def test_long_chains_are_walked_to_their_end(spark):
    chain = spark.range(70).selectExpr("id as src", "id + 1 as dst").coalesce(1)
    assert G.closure(chain, spark.createDataFrame([(30,)], "seed long")).count() == 41
    layers, cyclic = G.topological_layers(chain)
    assert {r.node: r.layer for r in layers.collect()} == {i: i for i in range(71)} and cyclic.isEmpty()


def test_crowded_places_settle_a_tier_without_pairs(spark):
    targets = spark.createDataFrame([(f"t{i:03}", "x", 1) for i in range(300)] + [("a", "x", 2), ("b", "x", 2), ("c", "x", 2), ("d", "x", 2), ("a", "y", 1), ("b", "y", 1)], "target string, name string, place int")
    callers = spark.createDataFrame([("t007", "x"), ("q", "x"), ("a", "y"), ("z", "y"), ("d", "z")], "caller string, name string")
    tier = lambda k: callers.withColumn("place", F.lit(k))
    of = lambda *ks: R.resolve_places([tier(k) for k in ks], targets, ["name", "place"], "caller", "target")
    rows = lambda df: sorted((r.caller, r.target, round(r.confidence, 4)) for r in df.collect())
    assert rows(of(1, 2)) == [("a", "b", 1.0), ("z", "a", 0.5), ("z", "b", 0.5)]  # 300 candidates of x give none, and no later tier
    assert rows(of(2, 1)) == [("a", "b", 1.0), ("z", "a", 0.5), ("z", "b", 0.5)]  # four candidates are too many
    four = callers.unionByName(spark.createDataFrame([("c", "x")], callers.schema)).withColumn("place", F.lit(2))
    assert rows(R.resolve_places([four], targets, ["name", "place"], "caller", "target")) == [("c", "a", 0.3333), ("c", "b", 0.3333), ("c", "d", 0.3333)]


def test_tasks_grow_with_dealt_rows(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"))
    assert R.dealt(rows, 1000, "k") is rows
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    dealt = R.dealt(rows, 1000, "k")
    assert dealt.rdd.getNumPartitions() == 10
    assert dealt.groupBy("k").count().where("count = 20").count() == 50


def test_contributions_are_put_in_order_inside_the_row(spark):
    rows = spark.createDataFrame([(1, 0.5, -2.0, 0.5), (2, 0.0, 1.0, None)], "id int, b double, c double, a double")
    weights = {"b": 1.0, "c": -1.0, "a": 1.0}
    parts = risk.contributions(rows, "id", weights, top=2)
    assert not any(x in parts._jdf.queryExecution().optimizedPlan().toString() for x in ("Window", "Sort"))
    assert sorted((r.id, r.place, r.feature, r.contribution) for r in parts.where("id = 1").collect()) == [(1, 1, "c", 2.0), (1, 2, "a", 0.5)]
    near = spark.createDataFrame([(1, 0.5000000001, 0.5)], "id int, b double, a double")
    assert [r.feature for r in risk.contributions(near, "id", {"b": 1.0, "a": 1.0}, top=1, digits=6).collect()] == ["a"]


def test_ownership_in_many_tasks_is_the_same(spark, monkeypatch):
    from riskloom.operators import history as H

    changes = spark.range(40).select("id", F.concat(F.lit("A"), (F.col("id") % 3).cast("string")).alias("author"), F.timestamp_seconds(F.col("id") * 86400).alias("at"))
    touched = spark.range(120).select((F.col("id") % 40).alias("id"), (F.col("id") * 7 % 11).alias("file"))
    history = touched.join(changes, "id").select("file", F.col("id").cast("string").alias("sha"), F.lower("author").alias("author"), F.col("file").alias("churn"), "at")
    of = lambda: H.ownership(changes, touched, history, "id", days=9)
    want = sorted(map(tuple, of().collect()))
    monkeypatch.setattr(R, "TASK_ROWS", 12)
    many = of()
    assert "RepartitionByExpression" in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, many.collect())) == want and len(want) == 40
