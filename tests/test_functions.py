import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import table_functions as T
from riskloom.operators import trees


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (1 - y).sum())


def plain(x, y, edges, rounds, leaves, rate, least):
    """Margins of boosted trees by best leaf first, every split tried on the rows themselves."""
    b = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1)
    p = y.mean()
    margin = np.full(len(y), np.log(p / (1 - p)))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)

        def best(rows):
            found = (1e-12, None, None)
            whole = g[rows].sum() ** 2 / h[rows].sum()
            for f in range(x.shape[1]):
                for last in range(len(edges[f])):
                    left = b[rows, f] <= last
                    if min(left.sum(), (~left).sum()) < least:
                        continue
                    a, c = rows[left], rows[~left]
                    gain = g[a].sum() ** 2 / h[a].sum() + g[c].sum() ** 2 / h[c].sum() - whole
                    if gain > found[0] + 1e-9:
                        found = (gain, a, c)
            return found

        open_ = [(np.arange(len(y)), best(np.arange(len(y))))]
        while len(open_) < leaves and max(s[0] for _, s in open_) > 1e-12:
            k = max(range(len(open_)), key=lambda i: open_[i][1][0])
            _, (_, a, c) = open_.pop(k)
            open_ += [(a, best(a)), (c, best(c))]
        for rows, _ in open_:
            margin[rows] += -rate * g[rows].sum() / h[rows].sum()
    return margin


def test_trees_equal_plain_ones(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)).round(2)
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + rng.normal(size=500) * 0.4 > 0).astype(int)
    df = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "y int, a double, b double, c double").repartition(3)
    model = trees.fit(df.unionByName(df.limit(5).withColumn("y", F.lit(None).cast("int"))), ["a", "b", "c"], "y", rounds=3, leaves=7, rate=0.3, bins=8, error=0.0)
    rows = trees.scored(df, model).collect()
    got = np.array([r.score for r in rows])
    values, labels = np.array([[r.a, r.b, r.c] for r in rows]), np.array([r.y for r in rows])
    want = 1 / (1 + np.exp(-plain(values, labels, [np.array(e) for e in model.edges], 3, 7, 0.3, trees.LEAST)))
    assert all((np.array(t.feature) < 0).sum() <= 7 for t in model.trees)
    assert abs(auc(labels, got) - auc(labels, want)) < 0.01 and np.abs(got - want).max() < 1e-6
    again = trees.Model.from_json(model.to_json())
    assert np.allclose(again.margins(again.binned(values)), model.margins(model.binned(values)))


def test_trees_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None)], "y int, a double")
    assert [round(r.score) for r in trees.scored(df, trees.fit(df, ["a"], "y")).collect()] == [1, 1]
    assert trees.fit(df.where("y = 7"), ["a"], "y").trees == []
    many = spark.createDataFrame([(i % 2, None if i % 3 == 0 else float(i % 2)) for i in range(90)], "y int, a double")
    model = trees.fit(many, ["a"], "y", rounds=12, rate=0.3)  # margins are written anew on the way
    scores = {r.a: r.score for r in trees.scored(many, model).collect()}
    assert scores[1.0] > 0.8 and scores[0.0] == scores[None] < 0.3  # a missing value is in the first bin


def test_table_functions_in_sql(spark):
    T.register(spark)
    spark.createDataFrame([(1, "Red apple pie", 10, "apple pie recipe", 5), (1, "Red apple pie", 11, "a red apple pie", 5), (1, "Red apple pie", 12, None, 5), (2, "", 10, "x", 5), (2, "", 9, "y", 5)], "qid int, query string, doc int, text string, k int").createOrReplaceTempView("hits")
    run = lambda kind, k: sorted(map(tuple, spark.sql(f"SELECT qid, doc, round(score, 4), rank FROM reranked(TABLE(hits) PARTITION BY qid, kind => '{kind}', k => {k})").collect()))
    assert run("overlap", 2) == [(1, 10, 0.6667, 2), (1, 11, 1.0, 1), (2, 9, 0.0, 1), (2, 10, 0.0, 2)]
    assert [r[1] for r in run("tfidf", 1)] == [11, 9]
    spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", None), ("d", "two one two")], "id string, text string").createOrReplaceTempView("texts")
    got = {r.id: np.array(r.embedding) for r in spark.sql("SELECT * FROM embedded(TABLE(texts), kind => 'hashing', dim => 32)").collect()}
    assert abs(np.linalg.norm(got["a"]) - 1) < 1e-12 and not got["b"].any() and not got["c"].any() and not np.allclose(got["a"], got["d"])
    counts = {r.id: sum(r.embedding) for r in spark.sql("SELECT * FROM embedded(TABLE(texts), kind => 'counts', dim => 8)").collect()}
    assert counts == {"a": 3, "b": 0, "c": 0, "d": 3}
    spark.createDataFrame([(1, "test_impact", '{"ran": true, "hits": 2}'), (2, "test_impact", '{"ran": false}'), (3, "api_break", '{"compatible": false, "callers": 1}'), (4, "api_break", '{"compatible": true, "callers": 1}'), (5, "other", None), (6, "test_impact", '{"ran": true}')], "claim_id int, kind string, facts string").createOrReplaceTempView("claims")
    got = [r.status for r in spark.sql("SELECT * FROM checked(TABLE(claims) PARTITION BY kind) ORDER BY claim_id").collect()]
    assert got == ["VERIFIED", "UNVERIFIABLE", "VERIFIED", "REFUTED", "UNVERIFIABLE", "REFUTED"]


@pytest.mark.parametrize(
    "sql, what",
    [
        ("SELECT * FROM reranked(TABLE(hits2) PARTITION BY qid, kind => 'nope', k => 1)", "kind has to be one of overlap, tfidf"),
        ("SELECT * FROM reranked(TABLE(hits2) PARTITION BY qid, kind => 'tfidf', k => 0)", "k has to be a positive number"),
        ("SELECT * FROM reranked(TABLE(SELECT qid, doc FROM hits2) PARTITION BY qid, kind => 'tfidf', k => 1)", "no column query, text"),
        ("SELECT * FROM embedded(TABLE(SELECT qid AS id, doc AS text FROM hits2), kind => 'hashing', dim => 4)", "text is int, not string"),
    ],
)
def test_wrong_calls_are_errors_of_analysis(spark, sql, what):
    T.register(spark)
    spark.createDataFrame([], "qid int, query string, doc int, text string").createOrReplaceTempView("hits2")
    with pytest.raises(Exception, match=what):
        spark.sql(sql)


def test_trees_keep_rows_of_equal_bins_once(spark, monkeypatch):
    kept, own = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda df, name: kept.append(own(df, name)) or kept[-1])
    df = spark.range(4000).select((F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 4 + F.col("id") % 5 > 4).cast("int").alias("y"))
    model = trees.fit(df, ["a", "b"], "y", rounds=12, leaves=4, rate=0.3, error=0.0)
    held = [[np.concatenate([np.frombuffer(r[c]) for r in k.collect()]) for c in ("n", "y", "margin")] for k in kept]
    assert [len(n) for n, _, _ in held] == [12, 12]  # at first, and when margins are written anew
    assert all(n.sum() == 4000 and y.sum() == df.where("y = 1").count() for n, y, _ in held)
    assert len(set(held[0][2])) == 1 < len(set(held[1][2]))
    rows = trees.scored(df, model).collect()
    want = plain(np.array([[r.a, r.b] for r in rows]), np.array([r.y for r in rows]), [np.array(e) for e in model.edges], 12, 4, 0.3, trees.LEAST)
    assert np.abs(np.array([r.score for r in rows]) - 1 / (1 + np.exp(-want))).max() < 1e-6
