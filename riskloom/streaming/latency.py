"""The last latencies of each route as the state of a stream: a window of rows, not of time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from riskloom.session import importable

KEPT, PARTS = 2048, 8


class Latest(StatefulProcessor):
    """Keeps a key's newest rows by (us, id); older ones go as newer ones come, however late any of them arrives."""

    def __init__(self, kept: int) -> None:
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "us long, id long, value double")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.us, r.id, r.value) for r in rows]
        held = sorted([*(tuple(x) for x in self.rows.get()), *new] if self.rows.exists() else new, key=lambda r: r[:2])[-self.kept :]
        n = (self.seen.get()[0] if self.seen.exists() else 0) + len(new)
        self.rows.put(held)
        self.seen.update((n,))
        route, part = key
        yield Row(route=route, part=part, seen=n, rows=[Row(us=us, id=i, value=v) for us, i, v in held])

    def close(self) -> None:
        pass


def latest(requests: DataFrame, kept: int = KEPT) -> DataFrame:
    """route, part, seen, rows (us, id, value) of each part whose rows changed, from a stream of route, us, id, value.

    A route is dealt over PARTS parts by hash, each of which keeps the last `kept` rows, so that a busy route is no single
    task; the last `kept` of the route are among them. Has to be started under runs.typed_state().
    """
    importable(requests.sparkSession)
    parts = requests.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    return parts.groupBy("route", "part").transformWithState(statefulProcessor=Latest(kept), outputStructType="route string, part int, seen long, rows array<struct<us:long,id:long,value:double>>", outputMode="Update", timeMode="None")


def nearest_rank(states: DataFrame, q: float = 0.95, kept: int = KEPT) -> DataFrame:
    """route, n, value: the q-quantile (nearest rank, ties of the rank to even) of each route's last rows, from what latest() has put out."""
    last = states.groupBy("route", "part").agg(F.max_by("rows", "seen").alias("rows")).select("route", F.inline("rows"))
    newest = last.withColumn("_age", F.row_number().over(W.partitionBy("route").orderBy(F.desc("us"), F.desc("id")))).where(F.col("_age") <= kept)
    ranked = newest.select("route", "value", (F.row_number().over(W.partitionBy("route").orderBy("value")) - 1).alias("_i"), F.count("*").over(W.partitionBy("route")).alias("n"))
    return ranked.where(F.col("_i") == F.least(F.col("n") - 1, F.bround(q * (F.col("n") - 1), 0).cast("bigint"))).select("route", "n", "value")
