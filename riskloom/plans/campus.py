"""Queries of the domain analytics: a small seeded campus, and the same rules on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import campus as C
from riskloom.operators.ordering import percentiles
from riskloom.plans.registry import query, table

#: The grade of an order line: by its quantity.
_G = "CASE CAST(l_quantity AS INTEGER) % 11 WHEN 0 THEN 'A' WHEN 1 THEN 'A-' WHEN 2 THEN 'B+' WHEN 3 THEN 'B' WHEN 4 THEN 'B-' WHEN 5 THEN 'C+' WHEN 6 THEN 'C' WHEN 7 THEN 'C-' WHEN 8 THEN 'D' WHEN 9 THEN 'F' ELSE 'W' END"
_PTS = "CASE grade WHEN 'A' THEN 4.0 WHEN 'A-' THEN 3.7 WHEN 'B+' THEN 3.3 WHEN 'B' THEN 3.0 WHEN 'B-' THEN 2.7 WHEN 'C+' THEN 2.3 WHEN 'C' THEN 2.0 WHEN 'C-' THEN 1.7 WHEN 'D' THEN 1.0 WHEN 'F' THEN 0.0 END"
_H = f"h AS (SELECT o_custkey AS student_id, l_partkey AS course, l_linenumber AS credits, year(o_orderdate) AS term, l_orderkey, {_G} AS grade FROM orders JOIN lineitem ON l_orderkey = o_orderkey), l AS (SELECT *, row_number() OVER (PARTITION BY student_id, course ORDER BY term DESC, l_orderkey DESC, credits DESC, grade DESC) AS rn FROM h)"


def history(spark: SparkSession, d: str) -> DataFrame:
    g = F.element_at(F.array(*map(F.lit, ["A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F", "W"])), F.col("l_quantity").cast("int") % 11 + 1)
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("student_id"), F.col("l_partkey").alias("course"), F.col("l_linenumber").alias("credits"), F.year("o_orderdate").alias("term"), "l_orderkey", g.alias("grade"))


@query(f"WITH {_H} SELECT student_id, course, term, grade FROM l WHERE rn = 1")
def effective_attempts(spark: SparkSession, d: str) -> DataFrame:
    """The latest attempt of every course."""
    return C.latest_attempts(history(spark, d), ["student_id", "course"], F.desc("term"), F.desc("l_orderkey"), F.desc("credits"), F.desc("grade")).select("student_id", "course", "term", "grade")


@query(f"WITH {_H}, q AS (SELECT student_id, CAST(sum(CAST(10 * {_PTS} AS BIGINT) * credits) AS BIGINT) AS p, CAST(sum(CASE WHEN grade <> 'W' THEN credits ELSE 0 END) AS BIGINT) AS c FROM l WHERE rn = 1 GROUP BY 1) SELECT student_id, c AS credits, CAST(CASE WHEN c = 0 THEN 0 ELSE floor((p * 100 * 2 + 10 * c) / (20 * c)) / 100.0 END AS DOUBLE) AS gpa FROM q")
def grade_averages(spark: SparkSession, d: str) -> DataFrame:
    """Credit-weighted averages in exact decimals, half up."""
    rows = C.latest_attempts(history(spark, d), ["student_id", "course"], F.desc("term"), F.desc("l_orderkey"), F.desc("credits"), F.desc("grade"))
    return C.gpa(rows, "student_id").select("student_id", F.col("credits").cast("bigint").alias("credits"), F.col("gpa").cast("double").alias("gpa"))


@query(f"WITH {_H} SELECT student_id, CAST(sum(CASE WHEN grade NOT IN ('F', 'W') THEN credits ELSE 0 END) AS BIGINT) AS earned, CAST(sum(CASE WHEN grade <> 'W' THEN credits ELSE 0 END) AS BIGINT) AS attempted FROM l WHERE rn = 1 GROUP BY 1")
def credit_totals(spark: SparkSession, d: str) -> DataFrame:
    """Credits earned and attempted."""
    rows = C.latest_attempts(history(spark, d), ["student_id", "course"], F.desc("term"), F.desc("l_orderkey"), F.desc("credits"), F.desc("grade"))
    return C.credits(rows, "student_id").select("student_id", "earned", "attempted")


@query("SELECT l_orderkey AS id, round(100.0 * count(*) FILTER (WHERE l_returnflag <> 'A') / count(*), 1) AS pct, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS excused FROM lineitem GROUP BY 1")
def attendance(spark: SparkSession, d: str) -> DataFrame:
    """Attendance in per cent."""
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_returnflag") != "A").alias("present"), (F.col("l_linestatus") == "F").alias("excused"))
    return C.attendance(r, "id").select("id", "pct", "excused")


@query("SELECT o_orderstatus AS section, round(avg(o_totalprice), 2) AS mean, round(median(o_totalprice), 2) AS median, round(max(o_totalprice), 2) AS highest, round(min(o_totalprice), 2) AS lowest, round(100.0 * count(*) FILTER (WHERE o_totalprice >= 60000) / count(*), 1) AS pass_rate FROM orders GROUP BY 1")
def result_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of results; medians without one task for each section."""
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("section"), F.col("o_totalprice").cast("double").alias("v"))
    rest = rows.groupBy("section").agg(F.round(F.avg("v"), 2).alias("mean"), F.round(F.max("v"), 2).alias("highest"), F.round(F.min("v"), 2).alias("lowest"), F.round(100.0 * F.count_if(F.col("v") >= 60000) / F.count("*"), 1).alias("pass_rate"))
    return rest.join(percentiles(rows, "section", "v", {"median": 0.5}), "section").select("section", "mean", F.round("median", 2).alias("median"), "highest", "lowest", "pass_rate")


@query("SELECT o_orderstatus AS section, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS enrolled FROM orders GROUP BY 1")
def section_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Enrolled rows of each section."""
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("section")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("enrolled"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS late, CAST(l_quantity AS BIGINT) * 100 AS amount FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN late <= 3 THEN 0 ELSE least(2 * ceil(late / 7.0), 10) END AS INTEGER) AS pct, CAST(CASE WHEN late <= 3 THEN amount ELSE amount * (100 + least(2 * ceil(late / 7.0), 10)) // 100 END AS BIGINT) AS payable FROM x")
def late_fees(spark: SparkSession, d: str) -> DataFrame:
    """M4: late fees by started weeks, capped, rounded down."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rate = C.late_fee_rate(F.to_date("o_orderdate"), F.to_date("l_shipdate"))
    return x.select("l_orderkey", "l_linenumber", (rate * 100).cast("int").alias("pct"), C.with_late_fee((F.col("l_quantity").cast("bigint") * 100).cast("decimal(12,2)"), rate).cast("bigint").alias("payable"))


@query("SELECT o_orderkey, CAST(floor(2500 * (o_orderkey % 20) * CASE WHEN o_custkey % 5 = 0 THEN 1.25 ELSE 1 END * (100 - (o_custkey % 4) * 25) / 100.0) + 2300 + CASE WHEN o_orderstatus = 'F' THEN 2000 ELSE 0 END AS BIGINT) AS fees FROM orders")
def term_fees(spark: SparkSession, d: str) -> DataFrame:
    """M5: tuition with surcharge and scholarship, and the fixed fees."""
    f = C.term_fees(F.col("o_orderkey") % 20, F.col("o_custkey") % 5 == 0, (F.col("o_custkey") % 4) * 25, F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").select("o_orderkey", f["total"].cast("bigint").alias("fees"))


@query("WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 101 AS DOUBLE) AS score FROM orders) SELECT o_orderkey, CASE WHEN v >= 93 THEN 'A' WHEN v >= 90 THEN 'A-' WHEN v >= 87 THEN 'B+' WHEN v >= 83 THEN 'B' WHEN v >= 80 THEN 'B-' WHEN v >= 77 THEN 'C+' WHEN v >= 73 THEN 'C' WHEN v >= 70 THEN 'C-' WHEN v >= 60 THEN 'D' ELSE 'F' END AS letter FROM (SELECT o_orderkey, CASE WHEN score >= 58 AND score < 60 THEN 60 ELSE score END AS v FROM s)")
def letter_grades(spark: SparkSession, d: str) -> DataFrame:
    """Letters of scores with grace just below the pass mark."""
    return table(spark, d, "orders").select("o_orderkey", C.letter(C.grace((F.col("o_orderkey") % 101).cast("double"))).alias("letter"))


@query("WITH s AS (SELECT o_orderkey, (o_orderkey % 41) / 10.0 AS cgpa, o_orderkey % 60 AS attempted, o_custkey % 3 = 0 AS before FROM orders) SELECT o_orderkey, CASE WHEN attempted < 8 OR cgpa >= 2.0 THEN 'good' WHEN before AND cgpa < 1.5 THEN 'dismissal' ELSE 'probation' END AS standing FROM s")
def standings(spark: SparkSession, d: str) -> DataFrame:
    """Academic standing."""
    return table(spark, d, "orders").select("o_orderkey", C.standing((F.col("o_orderkey") % 41) / 10.0, F.col("o_orderkey") % 60, F.col("o_custkey") % 3 == 0).alias("standing"))
