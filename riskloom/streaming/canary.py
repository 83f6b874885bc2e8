"""Canary analysis: counter deltas, objectives, step windows, routing and the rollout as a state machine.

The batch functions define the results; the streaming forms run the same projections over a stream of snapshots or
events, with watermarks for what arrives late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.session import importable

#: Objectives of a step, and how often a step without enough traffic is extended.
MAX_ERROR_RATE, MAX_DELTA, P95_RATIO, P95_SLACK, MIN_REQUESTS = 0.01, 0.005, 1.5, 50.0, 20
MAX_EXTENSIONS = 3


def readings(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, requests, errors, error_rate, p95_ms between consecutive snapshots; p95 is the later one's."""
    w = W.partitionBy(*keys).orderBy("t")
    d = snapshots.withColumn("_r", F.col("requests") - F.lag("requests").over(w)).withColumn("_e", F.col("errors") - F.lag("errors").over(w)).where("_r is not null")
    return d.select(*keys, "t", F.col("_r").alias("requests"), F.col("_e").alias("errors"), F.when(F.col("_r") != 0, F.round(F.col("_e") / F.nullif("_r", F.lit(0)), 4)).otherwise(0.0).alias("error_rate"), "p95_ms")


def verdict(stable_rate: Column, stable_p95: Column, requests: Column, rate: Column, p95: Column) -> Column:
    """struct(healthy, inconclusive, breaches); all comparisons are strict."""
    few = requests < MIN_REQUESTS
    breaches = F.array_compact(F.array(F.when(rate > MAX_ERROR_RATE, "error_rate"), F.when(rate > stable_rate + MAX_DELTA, "error_rate_delta"), F.when(p95 > stable_p95 * P95_RATIO + P95_SLACK, "p95")))
    return F.struct((few | (F.size(breaches) == 0)).alias("healthy"), few.alias("inconclusive"), F.when(few, F.array(F.lit("too_few_requests"))).otherwise(breaches).alias("breaches"))


def step_verdicts(windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, healthy, inconclusive, breaches; windows: keys, version (stable, canary), requests, errors, p95_ms."""
    of = lambda v, c: F.max(F.when(F.col("version") == v, F.col(c)))
    wide = windows.groupBy(*keys).agg(*(of(v, c).alias(f"{v}_{c}") for v in ("stable", "canary") for c in ("requests", "errors", "p95_ms")))
    rate = lambda v: F.coalesce(F.round(F.col(f"{v}_errors") / F.nullif(F.col(f"{v}_requests"), F.lit(0)), 4), F.lit(0.0))
    v = verdict(rate("stable"), F.coalesce("stable_p95_ms", F.lit(0.0)), F.coalesce("canary_requests", F.lit(0)), rate("canary"), F.coalesce("canary_p95_ms", F.lit(0.0)))
    return wide.select(*keys, v.alias("v")).select(*keys, "v.*")


def rollout(steps: DataFrame, key: str) -> DataFrame:
    """key, outcome, steps: fold of the step windows in order.

    steps: key, ord, weight, healthy, inconclusive. A step without enough traffic is extended at most three times and then
    passes; an unhealthy one rolls back. A rollout has few steps, so each is one array.
    """
    listed = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "weight", "healthy", "inconclusive"))).alias("l"))
    start = F.expr("struct(cast('rolling_out' as string) as outcome, 0 as extensions, 0 as n)")

    def step(a: Column, x: Column) -> Column:
        wait = x["inconclusive"] & (a["extensions"] < MAX_EXTENSIONS)
        return F.when(a["outcome"] != "rolling_out", a).when(wait, F.struct(a["outcome"].alias("outcome"), (a["extensions"] + 1).alias("extensions"), a["n"].alias("n"))).when(~x["healthy"], F.struct(F.lit("rolled_back").alias("outcome"), F.lit(0).alias("extensions"), (a["n"] + 1).alias("n"))).otherwise(F.struct(a["outcome"].alias("outcome"), F.lit(0).alias("extensions"), (a["n"] + 1).alias("n")))

    done = F.aggregate("l", start, step)
    return listed.select(key, done.alias("_done")).select(key, F.when(F.col("_done.outcome") == "rolling_out", "promoted").otherwise(F.col("_done.outcome")).alias("outcome"), F.col("_done.n").alias("steps"))


#: States of a rollout, and the least tolerance of the share that reaches the candidate.
ACTIVE = ["queued", "provisioning", "rolling_out", "paused"]
SHARE_FLOOR = 0.05


def share_tolerance(weight: Column, n: Column) -> Column:
    """How far the candidate's share may lie from its weight: three standard errors, or the floor."""
    return F.greatest(F.lit(SHARE_FLOOR), 3 * F.sqrt(F.greatest(weight * (1 - weight), F.lit(1e-9)) / F.greatest(n, F.lit(1))))


def early_stops(chunks: DataFrame, keys: list[str], step_seconds: float) -> DataFrame:
    """keys, t and the reading at which each step of a rollout ends.

    chunks: keys, t (seconds since the step began), healthy, inconclusive, and other columns; cumulative readings in
    order. A step ends at the first breach on enough traffic, else at its full length once there is enough traffic, and at
    1 + MAX_EXTENSIONS lengths in any case; without any of these at its last reading.
    """
    over = (~F.col("inconclusive") & ~F.col("healthy")) | ((F.col("t") >= step_seconds) & (~F.col("inconclusive") | (F.col("t") >= step_seconds * (1 + MAX_EXTENSIONS))))
    rest = [c for c in chunks.columns if c not in keys]
    ends = chunks.groupBy(*keys).agg(F.min(F.when(over, F.col("t"))).alias("_end"), F.max("t").alias("_last"))
    return chunks.join(ends, keys).where(F.col("t") == F.coalesce("_end", "_last")).select(*keys, *rest)


def deployments(events: DataFrame, key: str) -> DataFrame:
    """key, status, outcome, step, exposed_share: the fold of a deployment's events in order.

    events: key, ord, kind, weight, observed (the weight that the router reads back), stable_requests, candidate_requests,
    healthy, inconclusive, verified. Kinds: start (queued to provisioning), ready (to rolling_out), step, pause, resume,
    abort, error, done (the probe at full weight). A step whose weight was not applied, or whose share of requests does not
    match it, rolls back as failed; a breach rolls back; steps that are paused or over change nothing. An abort before any step and
    a rollback count as verified unless `verified` is false, which makes them failed. A deployment has few events, so each is one array.
    """
    fields = ["ord", "kind", "weight", "observed", "stable_requests", "candidate_requests", "healthy", "inconclusive", "verified"]
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_log"))
    start = F.expr("struct('queued' as status, cast(null as string) as outcome, 0 as step, 0L as candidate, 0L as total)")

    def step(a: Column, x: Column) -> Column:
        def to(status=None, outcome=None, more: int = 0, counted: bool = False) -> Column:
            new = lambda v, old: old if v is None else F.lit(v) if isinstance(v, str) else v
            c, n = F.coalesce(x["candidate_requests"], F.lit(0)).cast("bigint"), F.coalesce(x["stable_requests"], F.lit(0)).cast("bigint")
            return F.struct(new(status, a["status"]).alias("status"), new(outcome, a["outcome"]).alias("outcome"), (a["step"] + more).alias("step"), (a["candidate"] + (c if counted else 0)).alias("candidate"), (a["total"] + (c + n if counted else 0)).alias("total"))

        kind, status = x["kind"], a["status"]
        active, rolling = status.isin(ACTIVE), status == "rolling_out"
        safe = F.coalesce(x["verified"], F.lit(True))
        back = lambda outcome: to(F.when(safe, "rolled_back").otherwise("failed"), outcome, 1, True)
        n = F.coalesce(x["candidate_requests"], F.lit(0)) + F.coalesce(x["stable_requests"], F.lit(0))
        share = F.coalesce(x["candidate_requests"] / F.nullif(n, F.lit(0)), F.lit(0.0))
        routed = (x["candidate_requests"] > 0) & (F.abs(share - x["weight"]) <= share_tolerance(x["weight"], n))
        return (
            F.when(~active, a)
            .when(kind == "error", to("failed", "failed"))
            .when(kind == "abort", to(F.when(safe, "rolled_back").otherwise("failed"), "aborted"))
            .when((kind == "start") & (status == "queued"), to("provisioning"))
            .when((kind == "ready") & (status == "provisioning"), to("rolling_out"))
            .when((kind == "pause") & rolling, to("paused"))
            .when((kind == "resume") & (status == "paused"), to("rolling_out"))
            .when((kind == "step") & rolling & (F.abs(x["observed"] - x["weight"]) > 1e-9), back("failed"))
            .when((kind == "step") & rolling & ~F.coalesce(routed, F.lit(False)), back("failed"))
            .when((kind == "step") & rolling & ~x["inconclusive"] & ~x["healthy"], back("rolled_back"))
            .when((kind == "step") & rolling, to(more=1, counted=True))
            .when((kind == "done") & rolling, to(F.when(safe, "promoted").otherwise("failed"), F.when(safe, "promoted").otherwise("failed")))
            .otherwise(a)
        )

    done = listed.select(key, F.aggregate("_log", start, step).alias("_done"))
    share = F.coalesce(F.col("_done.candidate") / F.nullif(F.col("_done.total"), F.lit(0)), F.lit(0.0))
    return done.select(key, "_done.status", "_done.outcome", "_done.step", F.round(share, 4).alias("exposed_share"))


def route(requests: DataFrame, weight: float, order: str = "i") -> DataFrame:
    """requests with canary: smooth weighted routing by the closed form, request i (from 1) takes floor(i w) - floor((i - 1) w).

    Decimals make one in ten exact; weighted_credit() repeats a float credit instead.
    """
    w = F.lit(str(weight)).cast("decimal(9,6)")
    i = F.col(order).cast("decimal(18,0)")
    return requests.withColumn("canary", F.floor(i * w) > F.floor((i - 1) * w))


def weighted_credit(n: int, weight: float) -> list[bool]:
    """The picks of a router that adds the weight to a float credit and takes one when it reaches 1; sequential by nature."""
    credit, picks = 0.0, []
    for _ in range(n):
        credit += weight
        picks.append(credit >= 1.0)
        credit -= picks[-1]
    return picks


def stream_windows(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Requests, errors and mean latency of each version and tumbling window, from a stream (or a table) of events.

    events: ts, version, event_type, value. Rows later than the watermark are dropped, as streams must.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "version").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_ms")).select(F.col("window.start").alias("start"), "version", "requests", "errors", "mean_ms")


def unique_events(events: DataFrame) -> DataFrame:
    """A stream's events once each by run and sequence number."""
    return events.dropDuplicates(["run_id", "seq"])


def fold_stages(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State of one run: the last sequence number taken and the status of each stage; late or repeated events are skipped."""
    last, stages = state.get if state.exists else (0, "")
    known = dict(x.split("=", 1) for x in stages.split(";") if x)
    for frame in frames:
        for row in frame.sort_values("seq").itertuples():
            if row.seq > last:
                last = int(row.seq)
                known[row.stage] = row.status
    packed = ";".join(f"{k}={v}" for k, v in sorted(known.items()))
    state.update((last, packed))
    yield pd.DataFrame({"run_id": [key[0]], "last_seq": [last], "stages": [packed]})


def stage_states(events: DataFrame) -> DataFrame:
    """run_id, last_seq, stages, updated with every batch of a stream of run_id, seq, stage, status."""
    importable(events.sparkSession)
    return events.groupBy("run_id").applyInPandasWithState(fold_stages, "run_id string, last_seq long, stages string", "last_seq long, stages string", "update", "NoTimeout")


def latest_stages(events: DataFrame) -> DataFrame:
    """The batch twin of stage_states()."""
    last = events.groupBy("run_id", "stage").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
    return last.groupBy("run_id").agg(F.max("seq").alias("last_seq"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "stage", "status"))), ";").alias("stages"))
