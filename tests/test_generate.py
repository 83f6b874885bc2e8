import ast

from riskloom.functions.generate import MAKERS, changes, changes_of, regressions

MODULE = '''import os
import re

LIMIT = 40


class Cart:
    def sum(self, items, rate=3):
        total = 0
        for x in items:
            total = total + x * 7
        if total > LIMIT and rate > 2:
            return total - rate
        return total


def fee(days, kind="é"):
    result = days * 25
    label = f"{result} days"
    return result, label


def half(a): return a / 2


def test_fee():
    assert fee(2)[0] == 50
'''


def run(text, call):
    env = {}
    exec(compile(text, "m", "exec"), env)  # texts made above by the code under test
    return eval(call, env)


def made(seeds=60):
    return [c for s in range(seeds) for c in changes("m.py", MODULE, str(s))]


def test_all_categories_and_kinds_come_up():
    got = made()
    assert {c["category"] for c in got} == set(MAKERS)
    kinds = {c["kind"].split(":")[0] for c in got}
    assert {"rename_local", "add_docstring", "reorder_imports", "name_constant", "mutation", "add_parameter", "change_constant", "add_comment", "repeat_test", "attack"} == kinds
    for c in got:
        ast.parse(c["text"])
        assert c["text"] != MODULE
        new, old = c["text"].split("\n"), MODULE.split("\n")
        assert all(new[n - 1] not in old or c["kind"] in ("repeat_test", "name_constant", "reorder_imports") for n in c["lines"]), c


def test_refactorings_are_proven_and_keep_behaviour():
    calls = ["Cart().sum([1, 2, 3])", "Cart().sum([9, 9], 5)", "fee(3)", "half(5)"]
    for c in made():
        if c["category"] == "C1":
            assert c["proven"] and c["label"] == 0
            assert [run(c["text"], x) for x in calls] == [run(MODULE, x) for x in calls], c["kind"]
        if c["category"] == "C6":
            assert c["label"] == 0 and [run(c["text"], x) for x in calls] == [run(MODULE, x) for x in calls]
    # an unproven one: the same edit that also changes a number
    from riskloom.functions.generate import Source, _proven

    assert not _proven("rename_local", "fee", Source("m", MODULE), MODULE.replace("days * 25", "days * 26"))


def test_parameters_and_constants():
    for c in made():
        if c["kind"] == "add_parameter:required":
            f = next(n for n in ast.walk(ast.parse(c["text"])) if isinstance(n, ast.FunctionDef) and any(a.arg == "extra" for a in n.args.args))
            assert [a.arg for a in f.args.args].index("extra") < len(f.args.args) - len(f.args.defaults) and c["label"] == 1
        if c["kind"] == "add_parameter:optional":
            assert run(c["text"], "half(5)") == 2.5 and c["label"] == 0
        if c["kind"] == "change_constant":
            assert run(c["text"], "LIMIT") != 40 and c["unit"] == "LIMIT"
        if c["category"] == "C7":
            assert "ignore previous instructions" in c["text"].split("\n")[c["lines"][0] - 1]


def test_seeds_and_odd_sources(spark):
    assert changes("m.py", MODULE, "1") == changes("m.py", MODULE, "1")
    assert len({c["text"] for c in made(30)}) > 20
    assert changes("m.py", None) == changes("m.py", "") == changes("m.py", "def f(:") == changes("m.py", "x = 1") == []
    assert {c["category"] for c in changes("m.py", "def f(): return 1")} <= {"FAULT", "C6"}
    rows = spark.createDataFrame([("a.py", MODULE), ("b.py", None), ("c.py", "def f(:"), ("a.py", MODULE)], "path string, text string").repartition(3)
    got = changes_of(rows, "5").collect()
    assert len(got) == 2 * len(changes("a.py", MODULE, "5")) and {r.path for r in got} == {"a.py"}
    assert sorted(r.text for r in got) == sorted(c["text"] for c in changes("a.py", MODULE, "5") * 2)
    fixes = spark.createDataFrame([("s1", "a", "x", "y"), ("s2", "a", None, "y"), ("s3", "a", "y", "y")], "sha string, path string, before string, after string")
    assert [(r.kind, r.text, r.label) for r in regressions(fixes).collect()] == [("revert:s1", "x", 1)]
    assert changes_of(rows.where("path = 'z'")).collect() == []


def test_copies_of_a_text_are_worked_on_once(monkeypatch):
    parsed = []
    real = ast.parse
    monkeypatch.setattr(ast, "parse", lambda *a, **k: parsed.append(1) or real(*a, **k))
    text = MODULE.replace("40", "41").replace("fee", "fare")  # no other test's
    first = [changes(f"a{i}.py", text) for i in range(30)]
    before = len(parsed)
    assert [changes(f"a{i}.py", text) for i in range(30)] == first
    assert len(parsed) - before <= 30  # name_constant reads its own text again; it was some thousands


def test_a_tuple_assignment_is_no_named_constant():
    text = "A, B = 1, 2\n" + MODULE
    assert any(c["kind"] == "name_constant" for s in range(40) for c in changes("m.py", text, str(s), ["C1"]))
