"""Queries of the event log and of canary analysis: events are requests, one user in ten is on the canary."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.storage import exists, shared_folder
from riskloom.plans.registry import query, table
from riskloom.sources.sinks import prometheus
from riskloom.streaming import canary as C
from riskloom.streaming import latency as L
from riskloom.streaming import runs as R
from riskloom.streaming.resume import follow, since
from riskloom.streaming.router import routed

_W = "w AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CASE WHEN user_id % 10 = 0 THEN 'canary' ELSE 'stable' END AS version, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, quantile_cont(value, 0.95) AS p95_ms FROM events GROUP BY 1, 2)"


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", F.when(F.col("user_id") % 10 == 0, "canary").otherwise("stable").alias("version"))


@query(f"WITH {_W}, p AS (SELECT start, max(requests) FILTER (WHERE version = 'canary') AS c, round(max(errors) FILTER (WHERE version = 'canary') / CAST(max(requests) FILTER (WHERE version = 'canary') AS DOUBLE), 4) AS cr, max(p95_ms) FILTER (WHERE version = 'canary') AS cp, round(max(errors) FILTER (WHERE version = 'stable') / CAST(max(requests) FILTER (WHERE version = 'stable') AS DOUBLE), 4) AS sr, max(p95_ms) FILTER (WHERE version = 'stable') AS sp FROM w GROUP BY 1) SELECT start, coalesce(c, 0) < 20 AS inconclusive, coalesce(c, 0) < 20 OR NOT (coalesce(cr, 0) > 0.01 OR coalesce(cr, 0) > coalesce(sr, 0) + 0.005 OR coalesce(cp, 0) > coalesce(sp, 0) * 1.5 + 50) AS healthy FROM p")
def slo_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Objectives of the canary against the stable version, by tumbling window."""
    w = requests(spark, d).groupBy(F.window("ts", "1 day")["start"].alias("start"), "version").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.percentile("value", 0.95).alias("p95_ms"))
    return C.step_verdicts(w, ["start"]).select("start", "inconclusive", "healthy")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CASE WHEN user_id % 10 = 0 THEN 'canary' ELSE 'stable' END AS version, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 4) AS mean_ms FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same windows from a stream with a watermark, run to its end over the table's files."""
    where = f"{d}/events.parquet"
    schema = spark.read.parquet(where).schema
    return _drained(spark, C.stream_windows(_stream(spark, where, schema).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("version", F.when(F.col("user_id") % 10 == 0, "canary").otherwise("stable"))), "complete").withColumn("mean_ms", F.round("mean_ms", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, max(event_id) AS last_seq, count(DISTINCT event_type) AS n_stages FROM events GROUP BY 1")
def stage_states(spark: SparkSession, d: str) -> DataFrame:
    """Stages of each run folded from a stream; repeated events change nothing."""
    where = f"{d}/events.parquet"
    schema = spark.read.parquet(where).schema
    events = _stream(spark, where, schema).select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.lit("done").alias("status"))
    states = _drained(spark, C.stage_states(events), "update")
    last = states.groupBy("run_id").agg(F.max_by(F.struct("last_seq", "stages"), "last_seq").alias("s"))
    return last.select("run_id", "s.last_seq", F.size(F.split("s.stages", ";")).cast("bigint").alias("n_stages"))


def _stream(spark: SparkSession, where: str, schema) -> DataFrame:
    """A stream of a table that is one file or a folder of files."""
    folder, name = where.rsplit("/", 1)
    is_file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    one = exists(spark, where) and is_file.getFileStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)).isFile()
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if one else reader.parquet(where)


def _drained(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """The rows of a stream that is run until its input ends, written as tables batch by batch."""
    out, last = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", [0]

    def keep(batch: DataFrame, n: int) -> None:
        last[0] = n
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/batch={last[0]}") if mode == "complete" else spark.read.option("basePath", out).parquet(out).drop("batch")
    return rows


@query("SELECT event_id, floor(event_id * 0.1) > floor((event_id - 1) * 0.1) AS canary FROM (SELECT CAST(event_id AS DECIMAL(18,0)) AS e, event_id FROM events) WHERE event_id > 0")
def weighted_routing(spark: SparkSession, d: str) -> DataFrame:
    """Smooth weighted routing, one request in ten exactly."""
    return C.route(table(spark, d, "events").where("event_id > 0").select("event_id"), 0.1, "event_id").select("event_id", "canary")


@query("WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_type FROM events), f AS (SELECT user_id, min(ord) FILTER (WHERE event_type = 'error') AS bad, max(ord) AS n FROM s GROUP BY 1) SELECT user_id, CASE WHEN bad IS NULL THEN 'promoted' ELSE 'rolled_back' END AS outcome, CAST(coalesce(bad, n) AS INTEGER) AS steps FROM f")
def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Rollouts as a state machine over their steps."""
    from pyspark.sql.window import Window as W

    s = table(spark, d, "events").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"), F.lit(0.1).alias("weight"), (F.col("event_type") != "error").alias("healthy"), F.lit(False).alias("inconclusive"))
    return C.rollout(s, "user_id")


@query("WITH b AS (SELECT event_type AS route, CASE WHEN value <= 10 THEN 0 WHEN value <= 50 THEN 1 WHEN value <= 200 THEN 2 ELSE 3 END AS k FROM events), g AS (SELECT DISTINCT route, i FROM b, (VALUES (0), (1), (2), (3)) t(i)) SELECT g.route, CASE i WHEN 0 THEN '10' WHEN 1 THEN '50' WHEN 2 THEN '200' ELSE '+Inf' END AS le, count(*) FILTER (WHERE k <= i) AS \"count\" FROM g JOIN b ON g.route = b.route GROUP BY 1, 2")
def latency_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative latency buckets by route."""
    return prometheus(table(spark, d, "events").select(F.col("event_type").alias("route"), F.col("value").alias("ms")), "latency", [10, 50, 200]).select("route", "le", "count")


@query("SELECT event_id, ts FROM events WHERE event_id > 100 AND event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def activity_feed(spark: SparkSession, d: str) -> DataFrame:
    """The newest events after a sequence number (a capped feed by its nature)."""
    return table(spark, d, "events").where("event_id > 100 and event_type = 'error'").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("SELECT event_id, user_id, event_type, value, CAST(epoch_us(ts) AS BIGINT) AS us FROM events WHERE event_id > 100")
def resumed_log(spark: SparkSession, d: str) -> DataFrame:
    """An event log in two parts, followed by a stream that is stopped between them and started again; events after number 100."""
    base = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    half = F.pmod(F.xxhash64("user_id"), F.lit(2)) == 0
    for part in (half, ~half):
        rows.where(part).write.mode("append").json(f"{base}/lines")
        follow(spark, f"{base}/lines", f"{base}/table", f"{base}/state", "event_id long, user_id long, event_type string, value double, us long").awaitTermination()
    return since(spark, f"{base}/table", 100, "event_id")


#: What the kinds of events stand for in the log of submissions, the time after which a run counts as interrupted, and the lateness.
_KINDS = {"view": "submit", "click": "start", "signup": "stage", "purchase": "finish", "error": "cancel"}
_TIMEOUT_MS, _LATE_MS = 12 * 3600 * 1000, 3600 * 1000

_RUNS_SQL = f"""
WITH RECURSIVE m AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_type FROM events), mark AS (SELECT max(ms) - {_LATE_MS} AS mark FROM m),
e AS (SELECT user_id, event_id, ms, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM m, mark WHERE ms < mark),
f AS (
  SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS run, 'none' AS status, false AS stopping, 0::BIGINT AS last, NULL::BIGINT AS gone, NULL::BIGINT AS gone_run, NULL::VARCHAR AS said, NULL::BIGINT AS seq, NULL::BIGINT AS ms FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, i, new_run, new_status, CASE WHEN said = 'queued' THEN false ELSE stopping OR said = 'cancel_requested' END, CASE WHEN new_status IN ('queued', 'running') THEN ms ELSE last END, gone, run, said, event_id, ms FROM (
    SELECT *, CASE WHEN said = 'queued' THEN run + 1 ELSE run END AS new_run, CASE WHEN said IN ('queued', 'running', 'cancelled', 'completed') THEN said ELSE st END AS new_status FROM (
      SELECT *, CASE kind WHEN 'submit' THEN CASE WHEN active THEN 'deduplicated' ELSE 'queued' END WHEN 'cancel' THEN CASE WHEN active THEN 'cancel_requested' ELSE 'not_cancellable' END
          WHEN 'start' THEN CASE WHEN st = 'queued' THEN CASE WHEN stopping THEN 'cancelled' ELSE 'running' END END WHEN 'stage' THEN CASE WHEN st = 'running' AND stopping THEN 'cancelled' END
          WHEN 'finish' THEN CASE WHEN st = 'running' THEN 'completed' END END AS said FROM (
        SELECT *, st IN ('queued', 'running') AS active FROM (
          SELECT f.user_id, e.i, f.run, f.stopping, f.last, e.event_id, e.ms, e.kind, CASE WHEN f.status IN ('queued', 'running') AND e.ms - f.last >= {_TIMEOUT_MS} THEN f.last + {_TIMEOUT_MS} END AS gone, CASE WHEN f.status IN ('queued', 'running') AND e.ms - f.last >= {_TIMEOUT_MS} THEN 'failed' ELSE f.status END AS st
          FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))))
), ends AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1),
changes AS (
  SELECT user_id, run, seq, ms, said AS status FROM f WHERE said IS NOT NULL UNION ALL SELECT user_id, gone_run, NULL, gone, 'interrupted' FROM f WHERE gone IS NOT NULL
  UNION ALL SELECT user_id, run, NULL, last + {_TIMEOUT_MS}, 'interrupted' FROM ends, mark WHERE status IN ('queued', 'running') AND last + {_TIMEOUT_MS} < mark
) SELECT 'repo-' || (user_id % 40) AS repo, CAST(user_id AS VARCHAR) AS ref, run, seq, ms AS at_ms, status FROM changes
"""


@query(_RUNS_SQL)
def run_submissions(spark: SparkSession, d: str) -> DataFrame:
    """Submissions, cancellations and interrupted runs from a stream of events, kept in typed state with timers."""
    where = f"{d}/events.parquet"
    kind = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))[F.col("event_type")]
    log = _stream(spark, where, spark.read.parquet(where).schema).select(F.concat(F.lit("repo-"), F.col("user_id") % 40).alias("repo"), F.col("user_id").cast("string").alias("ref"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    with R.typed_state(spark):
        changes = _drained(spark, R.submissions(log, _TIMEOUT_MS), "append")
    return changes.select("repo", "ref", "run", "seq", F.unix_millis("at").alias("at_ms"), "status")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id % 3 AS router, epoch_us(ts) AS us, CASE WHEN event_type = 'signup' AND user_id % 5 = 0 THEN (user_id % 11) / 10.0::DOUBLE END AS weight FROM events),
r AS (SELECT *, count(weight) OVER (PARTITION BY router ORDER BY us, event_id) AS run FROM e), w AS (SELECT router, run, greatest(0, least(1, weight)) AS weight FROM r WHERE weight IS NOT NULL),
q AS (SELECT r.router, r.run, r.event_id, coalesce(w.weight, 0)::DOUBLE AS w, row_number() OVER (PARTITION BY r.router, r.run ORDER BY us, event_id) AS i FROM r LEFT JOIN w ON w.router = r.router AND w.run = r.run WHERE r.weight IS NULL),
s AS (SELECT router, run, 0::BIGINT AS i, 0::DOUBLE AS credit, 0::BIGINT AS event_id, false AS canary FROM (SELECT DISTINCT router, run FROM q)
  UNION ALL SELECT q.router, q.run, q.i, CASE WHEN s.credit + q.w >= 1 THEN s.credit + q.w - 1 ELSE s.credit + q.w END, q.event_id, s.credit + q.w >= 1 FROM s JOIN q ON q.router = s.router AND q.run = s.run AND q.i = s.i + 1)
SELECT event_id, router, canary FROM s WHERE i > 0""")
def credit_routing(spark: SparkSession, d: str) -> DataFrame:
    """Requests of three routers by their float credit, which each change of weight clears."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("router"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.when((F.col("event_type") == "signup") & (F.col("user_id") % 5 == 0), (F.col("user_id") % 11) / F.lit(10.0)).alias("weight"))
    return routed(e, ["router"], ["us", "event_id"]).select("event_id", "router", "canary")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events), k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM r WHERE age <= 2048) SELECT event_type AS route, n, value AS p95 FROM k WHERE i = least(n - 1, CAST(round_even(0.95 * (n - 1), 0) AS BIGINT))")
def streamed_p95(spark: SparkSession, d: str) -> DataFrame:
    """The 95th percentile of each route's last 2048 latencies, kept as a list in the state of a stream."""
    where = f"{d}/events.parquet"
    requests = _stream(spark, where, spark.read.parquet(where).schema).select(F.col("event_type").alias("route"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"), "value")
    with R.typed_state(spark):
        states = _drained(spark, L.latest(requests), "update")
    return L.nearest_rank(states).select("route", "n", F.col("value").alias("p95"))
