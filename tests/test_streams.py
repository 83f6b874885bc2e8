import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions.scalars import round_binary
from riskloom.operators import history as H
from riskloom.sources import formats
from riskloom.sources.readers import parse_commits
from riskloom.streaming import latency, resume
from riskloom.streaming import runs as R
from riskloom.streaming.router import credit_picks, routed

EVENT = "seq long, kind string, data string"


def loop(rows, timeout, mark):
    """Changes of every (repo, ref), by a plain loop over the sorted log up to the watermark."""
    out, state = [], {}
    for ms, seq, repo, ref, kind in sorted(r for r in rows if r[0] < mark):
        s = state.setdefault((repo, ref), {"n": 0, "status": None, "stop": False, "last": 0})
        say = lambda what, at=ms, by=seq: out.append((repo, ref, s["n"], by, at, what))  # noqa: B023, E731
        active = s["status"] in ("queued", "running")
        if active and ms - s["last"] >= timeout:
            say("interrupted", s["last"] + timeout, None)
            s["status"], active = "failed", False
        if kind == "submit" and active:
            say("deduplicated")
        elif kind == "submit":
            s.update(n=s["n"] + 1, status="queued", stop=False)
            say("queued")
        elif kind == "cancel":
            say("cancel_requested" if active else "not_cancellable")
            s["stop"] = s["stop"] or active
        elif kind == "fail" and active:
            s["status"] = "failed"
            say("failed")
        elif (kind, s["status"]) in (("start", "queued"), ("stage", "running")) and s["stop"]:
            s["status"] = "cancelled"
            say("cancelled")
        elif kind == "start" and s["status"] == "queued":
            s["status"] = "running"
            say("running")
        elif kind == "finish" and s["status"] == "running":
            s["status"] = "completed"
            say("completed")
        if s["status"] in ("queued", "running"):
            s["last"] = ms
    for (repo, ref), s in state.items():
        if s["status"] in ("queued", "running") and s["last"] + timeout < mark:
            out.append((repo, ref, s["n"], None, s["last"] + timeout, "interrupted"))
    return sorted(out, key=repr)


def run_changes(spark, log, out, state, timeout):
    stream = spark.readStream.schema("repo string, ref string, seq long, ms long, kind string").option("maxFilesPerTrigger", 1).json(log)
    stream = stream.select("repo", "ref", "seq", F.timestamp_millis("ms").alias("ts"), "kind")
    with R.typed_state(spark):
        R.submissions(stream, timeout, "100 seconds").writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()


def test_submissions_equal_a_loop_over_an_out_of_order_log_and_survive_a_restart(spark, tmp_path):
    rng = random.Random(4)
    base = 1_700_000_000_000
    rows = [(base + i * 3000 + rng.randint(0, 3) * 1000, i, f"r{rng.randint(0, 1)}", str(rng.randint(0, 3)), rng.choice(["submit", "submit", "start", "stage", "finish", "cancel", "fail", "other"])) for i in range(240)]
    rows.insert(8, (rows[7][0], 1000, *rows[7][2:4], "submit"))  # a tie in time
    rows += [(base + 1_500_000, 2000, "r9", "9", "submit")]  # a mark far ahead
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    (tmp_path / "log").mkdir()
    parts = [rows[i : i + 61] for i in range(0, len(rows), 61)]
    for half in (parts[:2], parts[2:]):  # files arrive, the stream ends; later it starts again from its checkpoint
        for part in half:
            shuffled = part[:]
            rng.shuffle(shuffled)
            (tmp_path / "log" / f"{part[0][1]:04}.json").write_text("".join(json.dumps(dict(zip(("ms", "seq", "repo", "ref", "kind"), r, strict=True))) + "\n" for r in shuffled))
        run_changes(spark, log, out, state, 40_000)
    got = sorted(((r.repo, r.ref, r.run, r.seq, r.ms, r.status) for r in spark.read.parquet(out).withColumn("ms", F.unix_millis("at")).collect()), key=repr)
    assert got == loop(rows, 40_000, max(r[0] for r in rows) - 100_000)
    assert {r[5] for r in got} == {"queued", "deduplicated", "running", "cancelled", "cancel_requested", "not_cancellable", "completed", "failed", "interrupted"}


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    log, table, state = tmp_path / "log", str(tmp_path / "table"), str(tmp_path / "state")
    log.mkdir()
    line = lambda i: json.dumps({"seq": i, "kind": "é", "data": {"n": i}}, ensure_ascii=False)
    (log / "a.jsonl").write_text("".join(line(i) + "\n" for i in range(50)) + line(50)[:9])  # the last line is torn
    go = lambda: resume.follow(spark, str(log), table, state, EVENT).awaitTermination()
    go()
    assert [r.seq for r in resume.since(spark, table, 46).collect()] == [47, 48, 49]
    with (log / "a.jsonl").open("a") as f:
        f.write(line(50)[9:] + "\n" + line(51) + "\n")
    (log / "b.jsonl").write_text(line(52) + "\n")
    go()
    go()
    assert [r.seq for r in resume.since(spark, table, -1).collect()] == list(range(53))
    assert resume.since(spark, table, 52).collect() == []


@pytest.mark.parametrize("split", ["7", "64", "1000000"])
def test_event_ranges_and_broken_lines(spark, tmp_path, split):
    formats.register(spark)
    read = lambda path: sorted(r.seq for r in spark.read.format("riskloom_events").schema(EVENT).option("splitBytes", split).load(str(path)).collect())
    good = tmp_path / "good.jsonl"
    good.write_text("\n" + "".join(json.dumps({"seq": i, "kind": None, "other": 1}) + "\n" + "\n" * (i % 3) for i in range(40)) + '{"seq": 99')
    assert read(good) == list(range(40))
    good.write_text('{"seq": 1}\n{"seq": 2}')
    assert read(good) == [1, 2]
    good.write_text("")
    assert read(good) == []
    for broken in ('{"seq": 1}\n{"seq": \n{"seq": 3}\n', '{"seq": 1}\n[2]\n', '{"seq": "x"}\n{"seq": 1}\n'):
        good.write_text(broken)
        with pytest.raises(Exception, match="broken event"):
            read(good)


@pytest.mark.parametrize("split", ["5", "90", "100000"])
def test_commit_and_blame_ranges(spark, tmp_path, split):
    formats.register(spark)
    log = tmp_path / "log"
    log.write_text("".join(f"sha{i}\x1fp1 p2\x1fÄnn\x1fa@b\x1f{i}\x1ffix #{i}: x\nbody\x1fEND\x1f\n3\t1\ta{i}.py\n-\t-\tb.bin\n\x1e\n" for i in range(9)))
    rows = spark.read.format("riskloom_commits").option("splitBytes", split).load(str(log))
    got = sorted((r.sha, r.author, r.additions, len(r.files)) for r in parse_commits(rows).collect())
    assert got == [(f"sha{i}", "Änn", 3, 2) for i in range(9)]
    shas = ["a" * 40, "b" * 40]
    text, seen = "", set()
    for i in range(12):
        sha = shas[i * 7 % 5 % 2]
        text += f"{sha} {i + 5} {i + 1}{' 1' if i % 2 else ''}\n"
        if sha not in seen:
            seen.add(sha)
            text += f"author Anna B.\nauthor-mail <x>\nauthor-time {100 if sha == shas[0] else 200}\nsummary author of it\nfilename src/{sha[0]}.py\n"
        text += f"\t{shas[0]} 1 {i}\n"
    (tmp_path / "blame").write_text(text)
    got = {r.line: (r.sha, r.path, r.author, r.author_time) for r in formats.blame_lines(spark, str(tmp_path / "blame"), splitBytes=split).collect()}
    want = {i + 1: ((s := shas[i * 7 % 5 % 2]), f"src/{s[0]}.py", "Anna B.", 100 if s == shas[0] else 200) for i in range(12)}
    assert got == want


def credit_loop(weights_and_requests):
    """Picks of a router by the plain rule; a number is a new weight, None a request."""
    weight, credit, out = 0.0, 0.0, []
    for x in weights_and_requests:
        if x is not None:
            weight, credit = max(0.0, min(1.0, x)), 0.0
            continue
        credit += weight
        out.append(credit >= 1.0)
        credit -= out[-1]
    return out


@pytest.mark.parametrize("weight", [0.0, 0.1, 0.3, 1 / 3, 0.999, 1.0, 1e-4, 0.7])
def test_credit_is_followed_float_by_float(weight):
    n = 30_000
    assert [i + 1 for i, p in enumerate(credit_loop([weight] + [None] * n)) if p] == list(credit_picks(weight, n))


def test_routers_in_any_order_of_rows(spark):
    rng = random.Random(6)
    rows = [(r, i, rng.choice([0.1, 0.3, 1.0, -2.0, 7.0, 0.0]) if rng.random() < 0.02 else None) for r in ("a", "b", None) for i in range(600)] + [("quiet", i, None) for i in range(3)]
    log = spark.createDataFrame(rng.sample(rows, len(rows)), "router string, at long, weight double").where("router is not null")
    got = {(r.router, r.at): r.canary for r in routed(log, ["router"], ["at"]).collect()}
    for name in ("a", "b", "quiet"):
        own = sorted((r for r in rows if r[0] == name), key=lambda r: r[1])
        assert [got[name, r[1]] for r in own if r[2] is None] == credit_loop([r[2] for r in own])
    assert routed(log.where("at < 0"), ["router"], ["at"]).collect() == []


def test_last_latencies_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(8)
    rows = [{"route": rng.choice("aab"), "us": rng.randint(0, 400), "id": i, "value": rng.random()} for i in range(600)]
    log, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")
    log.mkdir()
    for n in range(3):
        (log / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[n * 200 : n * 200 + 200]))
        with R.typed_state(spark):
            stream = spark.readStream.schema("route string, us long, id long, value double").json(str(log))
            q = latency.latest(stream, 50).writeStream.outputMode("update").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/batch={k}"))
            q.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        seen = rows[: n * 200 + 200]
        got = {r.route: (r.n, r.value) for r in latency.nearest_rank(spark.read.parquet(out), kept=50).collect()}
        for route in "ab":
            last = sorted((r["value"] for r in sorted((r for r in seen if r["route"] == route), key=lambda r: (r["us"], r["id"]))[-50:]))
            assert got[route] == (len(last), last[min(len(last) - 1, round(0.95 * (len(last) - 1)))])


def test_rounding_by_the_binary_value(spark):
    rng = random.Random(1)
    xs = [rng.uniform(-10, 10) for _ in range(3000)] + [rng.randint(-(10**6), 10**6) / 2 ** rng.randint(0, 12) for _ in range(3000)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(3000)]
    xs += [(rng.randint(-(10**5), 10**5) * 2 + 1) / 2 / 10 ** rng.randint(0, 5) for _ in range(3000)] + [0.0, -0.0, float("inf"), 1e308, 5e-324, 2.675, 0.5, 1.5, 2.5, -0.5, 2.0**52, 2.0**51 + 0.5, 499839699574617.25]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for n in (0, 1, 2, 4, 15):
        assert [r.x for r in df.select("x", round_binary(F.col("x"), n).alias("y")).collect() if repr(r.y) != repr(round(r.x, n))] == []


def test_ownership_against_a_plain_loop(spark):
    rng = random.Random(9)
    at = lambda d: f"2024-01-{1 + d % 28:02} 00:00:{d % 60:02}"
    history = [(f"f{rng.randint(0, 4)}", f"s{(s := rng.randint(0, 30))}", ["Ann", "bob", None][s % 3], rng.randint(1, 9), at(s)) for _ in range(80)]
    changes = [(i, ["ANN", "Bob", None][i % 3], at(rng.randint(0, 40))) for i in range(25)] + [(99, "ann", None)]
    touched = [(i, f"f{rng.randint(0, 5)}") for i, _, _ in changes for _ in range(rng.randint(0, 3))]
    df = lambda rows, ddl, c: spark.createDataFrame(rows, ddl).withColumn(c, F.to_timestamp(c))
    got = {r.change: r for r in H.ownership(df(changes, "change int, author string, at string", "at"), spark.createDataFrame(touched, "change int, file string"), df(history, "file string, sha string, author string, churn int, at string", "at"), "change", days=7).collect()}
    seconds = lambda t: datetime.datetime.fromisoformat(t).timestamp()
    for change, author, when in changes:
        files = {f for c, f in touched if c == change}
        past = [h for h in history if when and h[0] in files and seconds(h[4]) < seconds(when)]
        ages = [min(seconds(when) - seconds(h[4]) for h in past if h[0] == f) / 86400 for f in files if any(h[0] == f for h in past)]
        want = (len({h[1] for h in past if author and h[2] and h[2].lower() == author.lower()}), sum(h[3] for h in past if seconds(when) - seconds(h[4]) <= 7 * 86400), sum(ages) / len(ages) if ages else 0)
        r = got[change]
        assert (r.author_prior_commits, r.recent_churn) == want[:2] and abs(r.code_age_days - want[2]) < 1e-9 and r.author_is_new == (want[0] == 0)
