"""Domain analytics of a university: grades, credits, attendance, fees, standing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Fixed values of the domain's rules.
GRADE_POINTS = {"A": 4.0, "A-": 3.7, "B+": 3.3, "B": 3.0, "B-": 2.7, "C+": 2.3, "C": 2.0, "C-": 1.7, "D": 1.0, "F": 0.0}
NON_GPA = ["W", "I", "P"]
CUTOFFS = [(93.0, "A"), (90.0, "A-"), (87.0, "B+"), (83.0, "B"), (80.0, "B-"), (77.0, "C+"), (73.0, "C"), (70.0, "C-"), (60.0, "D")]
PASS_MARK, MAX_GRACE = 60.0, 2.0
TUITION_PER_CREDIT, REGISTRATION_FEE, LIBRARY_FEE, LAB_FEE = 2500, 1500, 800, 2000
FULL_TIME, NORMAL_MAX, HONOURS_MAX, PROBATION_MAX = 12, 20, 24, 16
HONOURS_CGPA, PROBATION_CGPA, DISMISSAL_CGPA, DEANS_GPA, STANDING_CREDITS = 3.5, 2.0, 1.5, 3.7, 8
MIN_ATTENDANCE, MAX_CONDONED = 75.0, 10.0


def points(grade: Column) -> Column:
    """Grade points as exact decimals; null for what does not count."""
    out = F.lit(None).cast("decimal(3,1)")
    for g, p in GRADE_POINTS.items():
        out = F.when(grade == g, F.lit(str(p)).cast("decimal(3,1)")).otherwise(out)
    return out


def passing(grade: Column) -> Column:
    return F.coalesce(grade.isin([g for g in GRADE_POINTS if g != "F"] + ["P"]), F.lit(False))


def valid_grade(grade: Column) -> Column:
    """The grade in its normal form, or null if there is no such grade."""
    g = F.upper(F.trim(grade))
    return F.when(g.isin([*GRADE_POINTS, *NON_GPA]), g)


def letter(score: Column) -> Column:
    out = F.lit("F")
    for low, name in reversed(CUTOFFS):
        out = F.when(score >= low, name).otherwise(out)
    return out


def grace(score: Column, most: float = MAX_GRACE) -> Column:
    return F.when((score >= PASS_MARK - most) & (score < PASS_MARK), PASS_MARK).otherwise(score)


def weighted_score(marks: Column, weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of a map of marks; null where one is missing or out of range."""
    weights = weights or {"internal": 0.4, "final": 0.6}
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    total = F.lit(0.0)
    for name, w in weights.items():
        m = F.try_element_at(marks, F.lit(name))
        total = total + F.when(m.between(0, 100), m * w)
    return F.round(total, 2)


def latest_attempts(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The latest graded attempt of every course, and all ungraded ones."""
    graded = rows.where("grade is not null").withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    return graded.unionByName(rows.where("grade is null"))


def gpa(rows: DataFrame, key: str) -> DataFrame:
    """key, credits, points, gpa (decimal, half up, 0 without credits); rows: key, credits, grade."""
    p = points(F.col("grade"))
    g = rows.groupBy(key).agg(F.coalesce(F.sum(F.when(p.isNotNull(), F.col("credits"))), F.lit(0)).cast("decimal(12,0)").alias("credits"), F.coalesce(F.sum(p * F.col("credits").cast("decimal(6,0)")), F.lit(0)).cast("decimal(20,1)").alias("points"))
    return g.withColumn("gpa", F.when(F.col("credits") == 0, F.lit(0).cast("decimal(6,2)")).otherwise(F.round((F.col("points") / F.nullif("credits", F.lit(0).cast("decimal(12,0)"))).cast("decimal(30,12)"), 2).cast("decimal(6,2)")))


def trend(values: DataFrame, key: str, order: str, value: str, step: float = 0.2) -> DataFrame:
    """key, trend of the last two values in order."""
    w = W.partitionBy(key)
    last = values.withColumn("_d", F.col(value) - F.lag(value).over(w.orderBy(order))).withColumn("_rn", F.row_number().over(w.orderBy(F.desc(order)))).where("_rn = 1")
    return last.select(key, F.when(F.col("_d") >= step, "improving").when(F.col("_d") <= -step, "declining").otherwise("steady").alias("trend"))


def credits(rows: DataFrame, key: str) -> DataFrame:
    """key, earned, attempted, in_progress: of passed, of counting and of ungraded rows."""
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("credits"))), F.lit(0)).cast("bigint")
    return rows.groupBy(key).agg(of(passing(F.col("grade"))).alias("earned"), of(points(F.col("grade")).isNotNull()).alias("attempted"), of(F.col("grade").isNull()).alias("in_progress"))


def attendance(rows: DataFrame, key: str) -> DataFrame:
    """key, pct, condoned, excused, eligible; rows: key, present, excused."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if("present").alias("p"), F.count_if(~F.col("present") & F.col("excused")).alias("excused"))
    pct = F.round(100.0 * F.col("p") / F.col("n"), 1)
    condoned = F.round(F.least(pct + F.least(100.0 * F.col("excused") / F.col("n"), F.lit(MAX_CONDONED)), F.lit(100.0)), 1)
    return g.select(key, pct.alias("pct"), condoned.alias("condoned"), "excused", (condoned >= MIN_ATTENDANCE).alias("eligible"))


def late_fee_rate(due: Column, paid: Column) -> Column:
    days = F.datediff(paid, due)
    return F.when(days <= 3, F.lit("0.00").cast("decimal(4,2)")).otherwise(F.least(F.ceil(days / 7) * F.lit("0.02").cast("decimal(4,2)"), F.lit("0.10").cast("decimal(4,2)"))).cast("decimal(4,2)")


def with_late_fee(amount: Column, rate: Column) -> Column:
    return F.floor(amount * (F.lit("1.00").cast("decimal(4,2)") + rate))


def term_fees(credits_: Column, international: Column, scholarship: Column, lab: Column) -> Column:
    """struct(tuition, registration, library, lab, total): scholarships on tuition only, tuition rounded down."""
    plain = (credits_ * TUITION_PER_CREDIT).cast("decimal(14,2)")
    full = F.when(international, plain * F.lit("1.25").cast("decimal(4,2)")).otherwise(plain)
    tuition = F.floor(full.cast("decimal(16,4)") * (100 - scholarship).cast("decimal(5,0)") / 100)
    fee = F.when(lab, LAB_FEE).otherwise(0)
    return F.struct(tuition.alias("tuition"), F.lit(REGISTRATION_FEE).alias("registration"), F.lit(LIBRARY_FEE).alias("library"), fee.alias("lab"), (tuition + REGISTRATION_FEE + LIBRARY_FEE + fee).alias("total"))


def standing(cgpa: Column, attempted: Column, on_probation: Column) -> Column:
    return F.when((attempted < STANDING_CREDITS) | (cgpa >= PROBATION_CGPA), "good").when(on_probation & (cgpa < DISMISSAL_CGPA), "dismissal").otherwise("probation")


def deans_list(term_gpa: Column, term_credits: Column) -> Column:
    return (term_gpa >= DEANS_GPA) & (term_credits >= FULL_TIME)


def load_limit(cgpa: Column, on_probation: Column) -> Column:
    return F.when(on_probation | ((cgpa > 0) & (cgpa < PROBATION_CGPA)), PROBATION_MAX).when(cgpa >= HONOURS_CGPA, HONOURS_MAX).otherwise(NORMAL_MAX)


def may_graduate(earned: Column, required: Column, missing_core: Column, cgpa: Column) -> Column:
    return (earned >= required) & (F.size(missing_core) == 0) & (cgpa >= PROBATION_CGPA)


def missing_prerequisites(passed: DataFrame, courses: DataFrame, wants: DataFrame) -> DataFrame:
    """student_id, code, prerequisite: what students lack for the courses they want."""
    need = wants.join(courses.select("code", F.explode("prerequisites").alias("prerequisite")), "code")
    return need.join(passed.select("student_id", F.col("code").alias("prerequisite")), ["student_id", "prerequisite"], "left_anti").select("student_id", "code", "prerequisite")
