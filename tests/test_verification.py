from pyspark.sql import functions as F

from riskloom.operators import verification as V
from riskloom.operators.graph import structure_edges
from riskloom.operators.ordering import ranked, running


def test_checkers(spark):
    claims = spark.createDataFrame([("r", "c1", "t1"), ("r", "c2", "t2"), ("r", "c3", "t3"), ("r", "c4", "t4")], "run_id string, claim_id string, target string")
    outcomes = spark.createDataFrame([("r", "t1[a]", "passed"), ("r", "t2", "failed"), ("r", "t3", "passed")], "run_id string, test_id string, outcome string")
    hits = spark.createDataFrame([("r", "t1[a]", "f.py", 2)], "run_id string, test_id string, file string, line int")
    kills = spark.createDataFrame([], "run_id string, test_id string, mutant string")
    got = {r.claim_id: (r.status, r.evidence) for r in V.check_test_impact(claims, outcomes, hits, kills).collect()}
    assert got == {"c1": ("VERIFIED", ["exec:t1[a]->f.py#L2"]), "c2": ("VERIFIED", ["fail:t2"]), "c3": ("REFUTED", ["run:t3"]), "c4": ("UNVERIFIABLE", [])}


def test_history_links(spark):
    rows = [("r", "a", "new.py::f", ["commit:abc"]), ("r", "b", "new.py::f", ["commit:zzz"]), ("r", "c", "new.py::f", ["issue:9"]), ("r", "d", "new.py::f", ["commit:abc", "issue:9"])]
    claims = spark.createDataFrame(rows, "run_id string, claim_id string, target string, evidence_ids array<string>")
    commits = spark.createDataFrame([("abc", "old.py")], "sha string, path string")
    aliases = spark.createDataFrame([("new.py", "old.py")], "path string, alias string")
    none = spark.createDataFrame([], "id string")
    status = lambda tracker: {r.claim_id: r.status for r in V.check_history_link(claims, commits, none, aliases, tracker).collect()}
    assert status(False) == {"a": "VERIFIED", "b": "REFUTED", "c": "UNVERIFIABLE", "d": "VERIFIED"}
    assert status(True) == {"a": "VERIFIED", "b": "REFUTED", "c": "REFUTED", "d": "REFUTED"}


def test_evidence_resolution(spark):
    allowed = F.array(*map(F.lit, ["cov:t", "graph:calls:a->b"]))
    f = lambda c: spark.range(1).select(V.resolve_evidence(F.lit(c), allowed).alias("x")).first().x
    assert f("cov:t") == ["cov:t"] and f("module x.py: graph:calls:a->b") == ["graph:calls:a->b"] and f("t") == ["cov:t"] and f("nope") == []


def test_structure_edges(spark):
    rows = [
        ("app/gpa.py", "gpa", "gpa", "function", None, False, ["total"], []), ("app/credits.py", "total", "total", "function", None, False, [], []),
        ("app/b.py", "Invoice", "Invoice", "class", None, False, [], []), ("app/b.py", "Late", "Late", "class", None, False, [], ["Invoice"]),
        ("app/b.py", "Invoice.sum", "sum", "method", "Invoice", False, ["each"], []), ("app/b.py", "Invoice.each", "each", "method", "Invoice", False, [], []),
    ]
    symbols = spark.createDataFrame(rows, "path string, qualname string, name string, kind string, parent string, is_test boolean, calls array<string>, bases array<string>")
    imports = spark.createDataFrame([("app/gpa.py", "app/credits.py")], "importer string, path string")
    e = {(r.src, r.dst, r.type) for r in structure_edges(symbols, imports).collect()}
    assert ("sym:app/gpa.py::gpa", "sym:app/credits.py::total", "calls") in e and ("sym:app/b.py::Late", "sym:app/b.py::Invoice", "inherits") in e
    assert ("sym:app/b.py::Invoice.sum", "sym:app/b.py::Invoice.each", "calls") in e and ("file:app/gpa.py", "file:app/credits.py", "imports") in e
    assert ("sym:app/b.py::Invoice", "sym:app/b.py::Invoice.sum", "contains") in e


def test_global_order(spark):
    df = spark.range(0, 1000, 1, 7).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert all(r["rank"] == r.v + 1 for r in ranked(df, [F.col("v")]).collect())
    assert all(r.s == sum(range(r.v, 1000)) for r in running(df, [F.desc("v")], {"s": "v"}).collect())
