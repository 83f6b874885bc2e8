"""The weighted router: a float credit that grows by the weight with each request and pays for one canary request at 1.

A change of weight clears the credit, so that what a request gets depends on its weight and its number since the change alone.
The numbers come from running counts over the ordered log; the credit of each different weight is followed once, as far as its
longest run goes, and the picks meet the requests by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.graph import cut
from riskloom.operators.ordering import running
from riskloom.session import importable


def credit_picks(weight: float, n: int, credit: float = 0.0) -> Iterator[int]:
    """Numbers, from 1, of the requests that go to the canary. Between two picks the credit is a running sum of floats."""
    at = 0
    if weight <= 0:
        return
    while at < n:
        size = min(n - at, int((1 - credit) / weight) + 2)
        sums = np.add.accumulate(np.concatenate([[credit], np.full(size, weight)]))[1:]  # one addition after the other, as the router does
        over = int(np.argmax(sums >= 1.0)) if sums[-1] >= 1.0 else -1
        if over < 0:
            at, credit = at + size, float(sums[-1])
            continue
        at, credit = at + over + 1, float(sums[over]) - 1.0
        yield at


def routed(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The requests of a log with canary: rows with a weight set it (held to 0..1, credit cleared), rows without one are requests.

    log: key columns (a router each), order columns (no two rows of a router alike), weight (double; null for requests) and others.
    Before its first weight a router has weight 0.
    """
    rows = log.withColumn("_change", F.col("weight").isNotNull().cast("bigint")).withColumn("_request", 1 - F.col("_change"))
    rows = cut(running(rows, [F.col(c) for c in key + order], {"_changes": "_change", "_requests": "_request"}))
    # a run: the requests between two changes; runs are numbered over all routers, so that a router's first one may have no change
    start = rows.where("_change = 1").select(*key, "_changes", F.greatest(F.least("weight", F.lit(1.0)), F.lit(0.0)).alias("_w"), F.col("_requests").alias("_before"))
    asked = rows.where("_change = 0").drop("weight")
    runs = asked.join(start, [*key, "_changes"], "left").withColumn("_i", F.col("_requests") - F.col("_before"))
    longest = runs.where("_w > 0").groupBy("_w").agg(F.max("_i").alias("n"))
    importable(log.sparkSession)
    schema = pa.schema([("_w", pa.float64()), ("_i", pa.int64())])

    def picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, n in zip(batch.column("_w").to_pylist(), batch.column("n").to_pylist(), strict=True):
                part: list[int] = []
                for i in credit_picks(w, n):
                    part.append(i)
                    if len(part) == 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), w)), pa.array(part, pa.int64())], schema=schema)
                        part = []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), w)), pa.array(part, pa.int64())], schema=schema)

    chosen = longest.repartition("_w").mapInArrow(picks, "_w double, _i bigint").withColumn("canary", F.lit(True))
    out = runs.join(chosen, ["_w", "_i"], "left").withColumn("canary", F.coalesce("canary", F.lit(False)))
    return out.drop("_w", "_i", "_before", "_changes", "_requests", "_change", "_request")
