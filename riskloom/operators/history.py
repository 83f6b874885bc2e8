"""Defect history: which commits introduced what a fix repairs, and how changes stand to the history of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.operators.relations import dealt


def introducers(fixes: DataFrame, blame: DataFrame, known: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """fix_sha, introducing_sha, file, function, line, confidence, issue: blamed lines of each fix, once for each function.

    fixes: sha, issue (null without one); blame: fix_sha, file, line, function, sha, author_time, confidence (null counts as
    1) for the lines that a fix removes or surrounds; known: sha of the mined commits; issues: number, created_at. Lines
    written after the issue was reported did not cause it; a fix does not introduce its own defect. Of several lines of one
    function the most confident stays, the least line of equals.
    """
    f = fixes.select(F.col("sha").alias("fix_sha"), "issue")
    rows = blame.join(f, "fix_sha").where(F.col("sha") != F.col("fix_sha")).where(~F.col("sha").startswith("0000000"))
    if issues is not None:
        rows = rows.join(issues.select(F.col("number").alias("issue"), "created_at"), "issue", "left").where("created_at is null or author_time <= created_at")
    rows = rows.withColumnRenamed("sha", "introducing_sha").join(known.select(F.col("sha").alias("introducing_sha")).distinct(), "introducing_sha", "left_semi")
    rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    best = F.min_by(F.struct("line", "confidence", "issue"), F.struct(-F.col("confidence"), F.col("line")))
    return rows.groupBy("fix_sha", "introducing_sha", "file", "function").agg(best.alias("b")).select("fix_sha", "introducing_sha", "file", "function", "b.line", "b.confidence", "b.issue")


def defects_per_change(units: DataFrame, links: DataFrame, change: str) -> DataFrame:
    """change, szz_defects: fixes of each changed unit (file, function), distinct by unit, added up over the units of a change."""
    # a unit's fixes do not depend on the change: counted before the join, so that a unit meets one row
    fixes = links.groupBy("file", "function").agg(F.countDistinct("fix_sha").alias("n"))
    per = units.select(change, "file", "function").distinct().join(fixes, ["file", "function"], "left").na.fill(0, ["n"])
    return per.groupBy(change).agg(F.sum("n").alias("szz_defects"))


def ownership(changes: DataFrame, touched: DataFrame, history: DataFrame, change: str, days: int = 90) -> DataFrame:
    """change, author_prior_commits, recent_churn, code_age_days, author_is_new of every change.

    changes: change, author, at (the latest commit time); touched: change, file; history: file, sha, author, churn, at. Prior
    counts the author's earlier commits to the files (names in any case); recent adds the churn of the last `days` days; age is
    the mean over files with history of the days since their last touch, 0 without any.
    """
    day = 86_400_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    n = touched.count()
    c = dealt(changes.select(change, F.lower("author").alias("_who"), micros("at").alias("_t")), n, change)
    t = dealt(touched.select(change, "file"), n, change).distinct().join(c, change)
    h = history.select("file", "sha", F.lower("author").alias("_who"), "churn", micros("at").alias("_t")).where("_t is not null")
    # each file's touches and questions in order of time: sums over what lies before a question
    w = W.partitionBy("file").orderBy("_t")
    rows = t.select(change, "file", "_t", F.lit(None).cast(h.schema["churn"].dataType).alias("churn"), F.lit(None).cast("bigint").alias("_at")).unionByName(h.select(F.lit(None).cast(changes.schema[change].dataType).alias(change), "file", "_t", "churn", F.col("_t").alias("_at")))
    per = dealt(rows, 2 * n, "file").select(change, "_t", F.col("_at").isNull().alias("_asked"), F.max("_at").over(w.rangeBetween(W.unboundedPreceding, -1)).alias("_last"), F.sum("churn").over(w.rangeBetween(-days * day, -1)).alias("churn")).where("_asked and _last is not null")
    files = dealt(per, n, change).groupBy(change).agg(F.avg((F.col("_t") - F.col("_last")) / day).alias("code_age_days"), F.sum(F.coalesce("churn", F.lit(0))).alias("recent_churn"))
    # the author's own earlier commits: for one file a running count, for several a join of their own touches, since a commit counts once
    mine = t.where("_who is not null").withColumn("_files", F.count("*").over(W.partitionBy(change)))
    own = dealt(h.where("_who is not null").select("file", "_who", "sha", "_t"), n, "file", "_who").distinct()
    line = mine.where("_files = 1").select(change, "file", "_who", "_t", F.lit(0).alias("_one")).unionByName(own.select(F.lit(None).cast(changes.schema[change].dataType).alias(change), "file", "_who", "_t", F.lit(1).alias("_one")))
    counted = dealt(line, n, "file", "_who").withColumn("_n", F.sum("_one").over(W.partitionBy("file", "_who").orderBy("_t").rangeBetween(W.unboundedPreceding, -1))).where("_one = 0").select(change, F.col("_n").alias("author_prior_commits"))
    asked = dealt(mine.where("_files > 1"), n, "file", "_who").alias("m")
    joined = dealt(asked.join(own.alias("o"), ["file", "_who"]).where("o._t < m._t").select(change, "sha"), n, change).groupBy(change).agg(F.countDistinct("sha").alias("author_prior_commits"))
    prior = dealt(counted.unionByName(joined), n, change)
    out = c.select(change).join(files, change, "left").join(prior, change, "left").na.fill(0, ["code_age_days", "recent_churn", "author_prior_commits"])
    return out.withColumn("author_is_new", (F.col("author_prior_commits") == 0).cast("int"))
