"""Relational operators: intervals, latest rows, divisions, comparisons and links between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Rows that a task holds where rows are dealt by key for windows, joins and sums.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys over enough tasks for TASK_ROWS of `rows` each, so that a task's memory does not grow with the table.

    Where the session's shuffle partitions are as many, df as it is: the operator behind it shuffles as usual.
    """
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order; ties are the caller's to break."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def dense_cells(df: DataFrame, low: str, high: str, width: int) -> DataFrame:
    return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))


def innermost(points: DataFrame, intervals: DataFrame, on: str, point: str, low: str, high: str, order: str, last: bool = True, width: int = 64) -> DataFrame:
    """Each point with the shortest interval of its group that holds it.

    Of equal lengths the last by `order` wins, or the first. Both sides meet on the group and a cell of `width` places,
    so that a long file costs no nested loop; points outside every interval are left out.
    """
    cells = dense_cells(intervals, low, high, width)
    hits = points.withColumn("_cell", F.floor(F.col(point) / width)).join(cells, [on, "_cell"]).where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high)))
    ties = F.col(order).desc() if last else F.col(order).asc()
    keys = list(points.columns)
    return first_per(hits.drop("_cell"), keys, (F.col(high) - F.col(low)).asc(), ties)


def latest_per(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest row of each key, the greatest tie among equals, by one aggregation."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r")).select(key, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of several new ones the last by `order`, or the last read."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    rest = F.struct(*(F.col(c) for c in new.columns if c not in keys)) if len(new.columns) > len(keys) else F.lit(0)
    last = new.withColumn("_at", at).groupBy(*keys).agg(F.max_by(rest, "_at").alias("_r"))
    last = last.select(*keys, "_r.*") if len(new.columns) > len(keys) else last.select(*keys)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*new.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """The children of the parents in new, all replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def divide(have: DataFrame, want: DataFrame, key: str, item: str) -> DataFrame:
    """The keys of have that have every item of want (relational division); with no items, every key."""
    wanted = want.select(item).distinct()
    n = wanted.agg(F.count("*").alias("n_wanted"))
    held = have.select(key, item).distinct().join(wanted.withColumn("_w", F.lit(1)), item, "left")
    counted = held.groupBy(key).agg(F.count("_w").alias("n_held"))
    return counted.join(F.broadcast(n)).where("n_held = n_wanted").select(key)


def missing(have: DataFrame, want: DataFrame, key: str, item: str) -> DataFrame:
    """key, item: what each key of want lacks in have."""
    return want.select(key, item).distinct().join(have.select(key, item), [key, item], "left_anti")


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, before, after, change (added, removed, changed) of the rows that differ between two runs."""
    x = a.select(*keys, F.col(value).alias("before"), F.lit(1).alias("_a"))
    y = b.select(*keys, F.col(value).alias("after"), F.lit(1).alias("_b"))
    both = x.join(y, keys, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "before", "after", "change")


def link_pairs(left: DataFrame, key: str, refs: str) -> DataFrame:
    """key, ref of each reference in an array column, once."""
    return left.select(key, F.explode(refs).alias("ref")).distinct()


def islands(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    """keys, low, high of each run of consecutive numbers; repeated numbers count once."""
    d = df.select(*keys, n).distinct()
    group = F.col(n) - F.row_number().over(W.partitionBy(*keys).orderBy(n))
    return d.withColumn("_g", group).groupBy(*keys, "_g").agg(F.min(n).alias("low"), F.max(n).alias("high")).drop("_g")


def resolve_tiers(tiers: list[DataFrame], keys: list[str], target: str, limit: int = 3) -> DataFrame:
    """keys, target, confidence: candidates of the first tier that has any; none where that tier has more than `limit`; 1/n each."""
    rows = None
    for i, t in enumerate(tiers):
        t = t.select(*keys, target).distinct().withColumn("_tier", F.lit(i))
        rows = t if rows is None else rows.unionByName(t)
    own = W.partitionBy(*keys)
    best = rows.withColumn("_best", F.min("_tier").over(own)).where("_tier = _best")
    counted = best.withColumn("_n", F.count("*").over(own)).where(F.col("_n") <= limit)
    return counted.select(*keys, target, (1.0 / F.col("_n")).alias("confidence"))


def resolve_places(callers: list[DataFrame], targets: DataFrame, on: list[str], key: str, target: str, limit: int = 3) -> DataFrame:
    """key, target, confidence: candidates of the first tier that has any; none where that tier has more than `limit`; 1/n each.

    callers: by tier key and the columns `on`, equal in its candidates (targets: on, target); a caller is no candidate of its own.
    Places of more than limit + 1 targets have more than `limit` for every caller: they settle its tier by their count, without pairs.
    """
    places = targets.select(*on, target).distinct()
    counts = places.groupBy(*on).agg(F.count("*").alias("_n"))
    few, many = (counts.where(f"_n {sign} {limit + 1}").select(*on) for sign in ("<=", ">"))
    few = places.join(few, on)
    rows = None
    for i, c in enumerate(callers):
        c = c.select(key, *on)
        pairs = c.join(few, on).where(F.col(key) != F.col(target)).select(key, target).distinct()
        crowd = c.join(many, on).select(key, F.lit(None).cast(targets.schema[target].dataType).alias(target)).distinct()
        t = pairs.unionByName(crowd).withColumn("_tier", F.lit(i))
        rows = t if rows is None else rows.unionByName(t)
    own = W.partitionBy(key)
    best = rows.withColumn("_best", F.min("_tier").over(own)).where("_tier = _best")
    size = F.when(F.col(target).isNull(), limit + 1).otherwise(1)
    counted = best.withColumn("_n", F.sum(size).over(own)).where(F.col("_n") <= limit)
    return counted.select(key, target, (1.0 / F.col("_n")).alias("confidence"))


def merge_claims(claims: DataFrame) -> DataFrame:
    """One claim for each type and target: the first one's text, everyone's evidence; claims: ord, type, target, assertion, evidence_ids."""
    g = claims.groupBy("type", "target").agg(F.min("ord").alias("ord"), F.min_by("assertion", "ord").alias("assertion"), F.array_sort(F.collect_list(F.struct("ord", "evidence_ids"))).alias("_e"))
    return g.select("ord", "type", "target", "assertion", F.array_distinct(F.flatten(F.transform("_e", lambda x: x["evidence_ids"]))).alias("evidence_ids"))


def statuses(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claims with their status; UNCHECKED without a verdict."""
    return claims.join(verdicts.select("claim_id", "status"), "claim_id", "left").withColumn("status", F.coalesce("status", F.lit("UNCHECKED")))


def fill_counts(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """A count column for each value, zero where a key has none."""
    wide = df.groupBy(*keys).pivot(column, values).agg(F.count(F.lit(1)))
    return wide.na.fill(0, values)


def union_distinct(a: Column, b: Column) -> Column:
    """The items of two arrays in order, the first of equals kept."""
    return F.array_distinct(F.concat(a, b))


def variants(targets: DataFrame, tests: DataFrame) -> DataFrame:
    """target, test_id: tests that equal a target or are it with parameters."""
    keyed = tests.select("test_id", F.substring_index("test_id", "[", 1).alias("target"))
    plain = tests.select("test_id", F.col("test_id").alias("target"))
    return targets.select("target").join(keyed.union(plain).distinct(), "target").select("target", "test_id")


def budget_prefix(rows: DataFrame, key: str, budget: float) -> DataFrame:
    """Greedy choice in priority order within a budget of seconds: what does not fit is skipped, priority 0 is never dropped.

    rows: key, item, priority, cost. The choice depends on all earlier ones, so each key's candidates, which one change
    bounds, are folded in order as one array.
    """
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("priority", "cost", "item"))).alias("l"))
    start = F.expr("struct(cast(0 as double) as used, cast(array() as array<string>) as kept)")
    fits = lambda a, x: (x["priority"] == 0) | (a["used"] + x["cost"] <= budget)
    fold = F.aggregate("l", start, lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["cost"]).alias("used"), F.array_append(a["kept"], x["item"]).alias("kept"))).otherwise(a))
    return listed.select(key, fold.alias("f")).select(key, F.col("f.used").alias("used"), F.col("f.kept").alias("kept"))


def round_robin(rows: DataFrame, key: str, line: str, limit: int, *order: str) -> DataFrame:
    """At most `limit` rows of each key, one of every line before a second of any."""
    within = F.row_number().over(W.partitionBy(key, line).orderBy(*order))
    ranked = rows.withColumn("_round", within)
    return ranked.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy("_round", line))).where(F.col("_rn") <= limit).drop("_round", "_rn")


def set_print(df: DataFrame, key: str, item: str, digits: int = 16) -> DataFrame:
    """key, print: a digest of each key's items that does not depend on their order.

    Items are dealt by the first byte of their own digest; each part is digested in order, then the parts of a key.
    """
    part = F.left(F.sha2(item, 256), F.lit(2))
    parts = df.groupBy(key, part.alias("_b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "\n"), 256).alias("_h"))
    whole = F.array_join(F.array_sort(F.collect_list(F.concat("_b", "_h"))), "\n")
    return parts.groupBy(key).agg(F.left(F.sha2(whole, 256), F.lit(digits)).alias("print"))
