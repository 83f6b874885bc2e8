"""Queries of ordered and windowed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.operators.campus import trend
from riskloom.plans.registry import query, table
from riskloom.streaming.canary import readings


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def event_sequence(spark: SparkSession, d: str) -> DataFrame:
    """A dense sequence within each run."""
    return table(spark, d, "events").select("event_id", "user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("seq"))


@query("WITH c AS (SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS errors, row_number() OVER w AS requests, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), s AS (SELECT * FROM c WHERE requests % 10 = 0), r AS (SELECT user_id, requests AS t, requests - lag(requests) OVER w AS requests, errors - lag(errors) OVER w AS errors, value AS p95_ms FROM s WINDOW w AS (PARTITION BY user_id ORDER BY requests)) SELECT user_id, t, requests, errors, round(errors / CAST(requests AS DOUBLE), 4) AS error_rate, p95_ms FROM r WHERE requests IS NOT NULL")
def counter_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Requests, errors and error rate between consecutive snapshots of counters."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    c = table(spark, d, "events").select("user_id", F.sum((F.col("event_type") == "error").cast("bigint")).over(w).alias("errors"), F.count("*").over(w).alias("requests"), F.col("value").alias("p95_ms"))
    return readings(c.where("requests % 10 = 0").withColumn("t", F.col("requests")), ["user_id"])


@query("SELECT event_id, user_id, round(CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS DOUBLE) / count(*) OVER w, 6) AS exposed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def exposed_share(spark: SparkSession, d: str) -> DataFrame:
    """Running share of the traffic that a canary took."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.round(F.sum((F.col("event_type") == "purchase").cast("bigint")).over(w) / F.count("*").over(w), 6).alias("exposed"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events), k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM r WHERE age <= 2048) SELECT event_type, value AS p95 FROM k WHERE i = least(n - 1, CAST(round_even(0.95 * (n - 1), 0) AS BIGINT))")
def rolling_p95(spark: SparkSession, d: str) -> DataFrame:
    """The nearest-rank 95th percentile of the last 2048 rows; each type is first cut in 32 parts, which keep as many each."""
    age = lambda *by: F.row_number().over(W.partitionBy("event_type", *by).orderBy(F.desc("ts"), F.desc("event_id")))
    last = table(spark, d, "events").withColumn("part", F.pmod("event_id", F.lit(32))).withColumn("age", age("part")).where("age <= 2048")
    r = last.withColumn("age", age()).where("age <= 2048")
    k = r.select("event_type", "value", (F.row_number().over(W.partitionBy("event_type").orderBy("value")) - 1).alias("i"), F.count("*").over(W.partitionBy("event_type")).alias("n"))
    return k.where(F.col("i") == F.least(F.col("n") - 1, F.bround(0.95 * (F.col("n") - 1), 0).cast("bigint"))).select("event_type", F.col("value").alias("p95"))


@query("WITH b AS (SELECT o_orderkey AS id, o_orderdate AS ts, 0 AS phase FROM orders UNION ALL SELECT l_orderkey, l_shipdate, 1 FROM lineitem WHERE l_linenumber = 1) SELECT id, ts, phase, row_number() OVER (PARTITION BY id ORDER BY ts, phase) AS place FROM b")
def interleaved_trace(spark: SparkSession, d: str) -> DataFrame:
    """Starts and ends in time order, starts first on ties."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.lit(0).alias("phase"))
    b = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts"), F.lit(1).alias("phase"))
    return a.unionAll(b).select("id", "ts", "phase", F.row_number().over(W.partitionBy("id").orderBy("ts", "phase")).cast("bigint").alias("place"))


@query("WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2), r AS (SELECT *, v - lag(v) OVER (PARTITION BY o_custkey ORDER BY y) AS delta, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC) AS rn FROM y) SELECT o_custkey, CASE WHEN delta >= 1000 THEN 'improving' WHEN delta <= -1000 THEN 'declining' ELSE 'steady' END AS trend FROM r WHERE rn = 1")
def trends(spark: SparkSession, d: str) -> DataFrame:
    """The difference of the last two terms as a trend."""
    y = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    return trend(y, "o_custkey", "y", "v", 1000.0)


@query("SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """An addition to the reference: sessions with a gap of six hours."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    near = (F.col("ts") - F.lag("ts").over(w)) <= F.expr("INTERVAL 6 HOURS")
    s = table(spark, d, "events").withColumn("new", F.when(near, 0).otherwise(1)).withColumn("s", F.sum("new").over(w))
    return s.groupBy("user_id", "s").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("s")
