"""Sinks: tables, upserts, event logs, reports and metric texts."""

from __future__ import annotations

import json
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.functions.text import ASSIGNED_VALUE, REDACTED, SECRET_RULES, redact
from riskloom.operators.relations import replace_children, upsert


def load(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Truncate and load."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def swap(df: DataFrame, path: str, keep: int = 2) -> None:
    """Puts a new version of a table in place of the old one; readers (current()) see one or the other, never none.

    path is a folder of versions. A version is written whole beside the others; then a file that names it is renamed
    into place, numbered one higher than the last, and readers follow the highest number. If another writer has taken the
    number, the next one is tried. Versions but the last `keep` are removed.
    """
    spark = df.sparkSession
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    P = jvm.org.apache.hadoop.fs.Path
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/data-{name}")
    fs = P(path).getFileSystem(hadoop)
    ready = P(f"{path}/_ready-{name}")
    fs.create(ready).close()
    n = max((v for v, _ in _versions(spark, path)), default=0) + 1
    while fs.exists(P(f"{path}/_version-{n:012d}-{name}")) or any(v == n for v, _ in _versions(spark, path)):
        n += 1
    if not fs.rename(ready, P(f"{path}/_version-{n:012d}-{name}")):
        raise OSError(f"version {n} of {path} could not be put in place")
    for v, old in sorted(_versions(spark, path))[:-keep]:
        fs.delete(P(f"{path}/_version-{v:012d}-{old}"), False)
        fs.delete(P(f"{path}/data-{old}"), True)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, name) of the versions of a table that were put in place."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(hadoop)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return [(int(n.split("-")[1]), n.split("-")[2]) for n in names if n.startswith("_version-")]


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that swap() last put in place; a plain table of Parquet files is read as it is."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/data-{max(versions)[1]}" if versions else path)


def upsert_into(path: str, new: DataFrame, keys: list[str]) -> None:
    swap(upsert(current(new.sparkSession, path), new, keys), path)


def replace_children_in(path: str, new: DataFrame, parent: str) -> None:
    swap(replace_children(current(new.sparkSession, path), new, parent), path)


#: Limits of what an event keeps of its data, and key names whose text is never kept.
TEXT_LIMIT, ITEM_LIMIT, DEPTH_LIMIT = 4000, 500, 8
SENSITIVE_KEYS = ["token", "secret", "password", "passwd", "api_key", "apikey", "authorization", "credential"]


def _sensitive(key: Column) -> Column:
    return F.lower(key).rlike("|".join(SENSITIVE_KEYS))


def redacted(data: Column) -> Column:
    """A map of strings without secrets: values under sensitive names go, others lose secrets and what is over the limit."""
    return F.transform_values(data, lambda k, v: F.when(_sensitive(k), "[REDACTED]").otherwise(F.left(redact(v), F.lit(TEXT_LIMIT))))


def redacted_value(value, depth: int = 0):
    """A value of nested maps and lists without secrets: text under sensitive names goes, other text loses secrets and what is over
    the limit, lists keep their first items, and what lies too deep is cut off."""
    if depth > DEPTH_LIMIT:
        return "[truncated]"
    if isinstance(value, str):
        for pattern in _PATTERNS:
            value = pattern.sub(REDACTED, value)
        return _VALUE.sub(lambda m: m[1] + REDACTED + m[3], value)[:TEXT_LIMIT]
    if isinstance(value, dict):
        hidden = lambda k, v: isinstance(v, str) and any(s in k.lower() for s in SENSITIVE_KEYS)
        return {k: "[REDACTED]" if hidden(k, v) else redacted_value(v, depth + 1) for k, v in value.items()}
    return [redacted_value(v, depth + 1) for v in value[:ITEM_LIMIT]] if isinstance(value, list) else value


_PATTERNS, _VALUE = [re.compile(p) for p in SECRET_RULES.values()], re.compile(ASSIGNED_VALUE)


def redacted_json(data: Column) -> Column:
    """The same for a column of JSON texts of any nesting; what is no JSON counts as text. JSON of unknown depth has no counterpart
    among built-in functions, so it is an Arrow-batched function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return json.dumps(redacted_value(json.loads(text)), ensure_ascii=False)
            except ValueError:
                return redacted_value(text)

        return texts.map(one)

    return run(data)


def append_events(events: DataFrame, path: str) -> None:
    """Appends JSON lines; data is a map of strings and is redacted first."""
    events.withColumn("data", redacted(F.col("data"))).write.mode("append").json(path)


def stream_events(events: DataFrame, path: str, checkpoint: str):
    return events.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).start(path)


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def annotations(findings: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """key, body: a list in Markdown of the first findings of each change."""
    w = W.partitionBy(key).orderBy("path", "line", "message")
    top = findings.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    line = F.concat(F.lit("- `"), "path", F.lit(":"), F.col("line").cast("string"), F.lit("` "), "message")
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", line.alias("t")))), lambda x: x["t"]), "\n").alias("body"))


def request_comment(decisions: DataFrame, claims: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """key, body: the comment of a change in Markdown: decision and risk, reasons, then the strongest claims with their status.

    decisions: key, decision, risk, explanation; claims: key, ord, type, target, status.
    """
    w = W.partitionBy(key).orderBy("ord", "type", "target")
    top = claims.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    row = F.concat(F.lit("| "), "type", F.lit(" | `"), F.replace("target", F.lit("|"), F.lit("\\|")), F.lit("` | "), "status", F.lit(" |"))
    table = top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", row.alias("t")))), lambda x: x["t"]), "\n").alias("rows"))
    head = F.concat(F.lit("## "), "decision", F.lit(" (risk "), F.format_number("risk", 2), F.lit(")\n"), F.coalesce("explanation", F.lit("")))
    body = F.when(F.col("rows").isNull(), head).otherwise(F.concat(head, F.lit("\n\n| claim | target | status |\n|-|-|-|\n"), "rows"))
    return decisions.join(table, key, "left").select(key, body.alias("body"))


def check_runs(decisions: DataFrame, key: str) -> DataFrame:
    """key, conclusion, title: BLOCK fails a check run, CANARY leaves it neutral, PASS lets it succeed."""
    conclusion = F.when(F.col("decision") == "BLOCK", "failure").when(F.col("decision") == "CANARY", "neutral").otherwise("success")
    return decisions.select(key, conclusion.alias("conclusion"), F.concat("decision", F.lit(": risk "), F.format_number("risk", 2)).alias("title"))


def prometheus(latencies: DataFrame, name: str, bounds: list[float]) -> DataFrame:
    """route, le, count: cumulative buckets of a histogram, and the line of the text format; latencies: route, ms."""
    bucket = F.lit("+Inf")
    for b in sorted(bounds, reverse=True):
        bucket = F.when(F.col("ms") <= b, f"{b:g}").otherwise(bucket)
    spark = latencies.sparkSession
    les = spark.createDataFrame([(f"{b:g}", i) for i, b in enumerate(sorted(bounds))] + [("+Inf", len(bounds))], "le string, ord int")
    n = latencies.groupBy("route", bucket.alias("le")).agg(F.count("*").alias("n"))
    grid = latencies.select("route").distinct().join(F.broadcast(les))
    cum = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("route").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    rows = grid.join(n, ["route", "le"], "left").withColumn("count", cum)
    return rows.select("route", "le", "count", F.concat(F.lit(f'{name}_bucket{{route="'), "route", F.lit('",le="'), "le", F.lit('"} '), F.col("count").cast("string")).alias("text"))
