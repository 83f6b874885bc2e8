"""Global order without a single task: ranks and running sums over a range-partitioned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.operators.graph import cut


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with inclusive running sums in a global order: sums maps new columns to those that they add up.

    Rows are dealt by range of the order, each part is summed by itself, and the totals of the parts before it, one row
    a part, are added. The parts are checkpointed, so that a lost executor cannot deal them anew in another way.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = dealt.join(F.broadcast(offsets), "_part")
    return rows.withColumns({n: F.sum(c).over(inside) + F.col(f"_off_{n}") for n, c in sums.items()}).drop("_part", *(f"_off_{n}" for n in sums))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its place from 1 in a total order."""
    return running(df.withColumn("_one", F.lit(1).cast("bigint")), order, {name: "_one"}).drop("_one")


def percentiles(df: DataFrame, key: str, value: str, of: dict[str, float]) -> DataFrame:
    """key and the exact percentiles (linear between two values) named in `of`, for keys of any size; nulls do not count.

    Equal values are one row with a count; running sums over a range-partitioned table then give each value its places, so
    that no task holds the values of a key.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    rows = cut(running(per, [F.col(key), F.col(value)], {"_upto": "_n"}))
    whole = rows.groupBy(key).agg(F.sum("_n").alias("_all"), F.min(F.col("_upto") - F.col("_n")).alias("_start"))
    placed = rows.join(whole, key).withColumn("_low", F.col("_upto") - F.col("_n") - F.col("_start"))
    at = lambda i: F.max(F.when((F.col("_low") <= i) & (i < F.col("_low") + F.col("_n")), F.col(value).cast("double")))
    picks = []
    for name, p in of.items():
        place = F.lit(p) * (F.col("_all") - 1)
        picks += [at(F.floor(place)).alias(f"_{name}_a"), at(F.ceil(place)).alias(f"_{name}_b"), F.max(place - F.floor(place)).alias(f"_{name}_f")]
    out = placed.groupBy(key).agg(*picks)
    return out.select(key, *((F.col(f"_{n}_a") + (F.col(f"_{n}_b") - F.col(f"_{n}_a")) * F.col(f"_{n}_f")).alias(n) for n in of))
