"""Queries that call table functions from SQL, and the model of boosted trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import table_functions as T
from riskloom.operators import trees
from riskloom.operators.storage import stored
from riskloom.plans.registry import query, table


@query(r"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS w FROM conversations), f AS (SELECT conv_id, min(turn) AS turn FROM t GROUP BY 1), q AS (SELECT t.conv_id, t.w FROM t JOIN f USING (conv_id, turn)),
s AS (SELECT t.conv_id AS qid, t.turn AS doc, CASE WHEN len(q.w) = 0 THEN 0.0 ELSE len(list_intersect(q.w, t.w)) / CAST(len(q.w) AS DOUBLE) END AS score FROM t JOIN q USING (conv_id) JOIN f ON f.conv_id = t.conv_id AND f.turn <> t.turn)
SELECT qid, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""")
def reranked_turns(spark: SparkSession, d: str) -> DataFrame:
    """SURVEY 2.16, R4: the later turns of each conversation by the words that they share with its first, by a table function in SQL."""
    T.register(spark)
    t = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    first = t.groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), "turn").alias("f"))
    t.join(first, "conv_id").where("turn <> f.turn").select(F.col("conv_id").alias("qid"), F.col("f.text").alias("query"), F.col("turn").alias("doc"), "text").createOrReplaceTempView("turns_to_rank")
    return spark.sql("SELECT qid, doc, round(score, 6) AS score, rank FROM reranked(TABLE(SELECT * FROM turns_to_rank) PARTITION BY qid, kind => 'overlap', k => 3)")


@query("""SELECT l_orderkey * 10 + l_linenumber AS claim_id, CASE l_linenumber % 3 WHEN 0 THEN 'api_break' WHEN 1 THEN 'test_impact' ELSE 'rationale' END AS kind,
CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN l_returnflag = 'N' THEN 'UNVERIFIABLE' WHEN l_returnflag = 'R' AND l_quantity > 10 THEN 'VERIFIED' ELSE 'REFUTED' END WHEN 1 THEN CASE WHEN l_linestatus <> 'F' THEN 'UNVERIFIABLE' WHEN l_quantity > 25 OR l_returnflag = 'R' THEN 'VERIFIED' ELSE 'REFUTED' END ELSE 'UNVERIFIABLE' END AS status FROM lineitem""")
def checked_claims(spark: SparkSession, d: str) -> DataFrame:
    """SURVEY 2.16, V12, V14: claims by the checker that is registered under their kind, in SQL."""
    T.register(spark)
    line = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "api_break").when(F.col("l_linenumber") % 3 == 1, "test_impact").otherwise("rationale")
    test = F.struct((F.col("l_linestatus") == "F").alias("ran"), F.greatest(F.col("l_quantity").cast("int") - 25, F.lit(0)).alias("hits"), (F.col("l_returnflag") == "R").alias("newly_failing"))
    api = F.struct(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") != "R").alias("compatible"), F.greatest(F.col("l_quantity").cast("int") - 10, F.lit(0)).alias("callers"))
    facts = F.when(F.col("l_linenumber") % 3 == 0, F.to_json(api)).otherwise(F.to_json(test))
    line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), kind.alias("kind"), facts.alias("facts")).createOrReplaceTempView("claims_to_check")
    return spark.sql("SELECT claim_id, kind, status FROM checked(TABLE(SELECT * FROM claims_to_check))")


@query()
def boosted_risk(spark: SparkSession, d: str) -> DataFrame:
    """V6: probabilities of boosted trees grown leaf by leaf, fitted on four fifths of the orders and given for all; a model, so without
    SQL: tests hold the trees against plain ones."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    per = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("lines"), F.avg(F.col("l_discount").cast("double")).alias("discount"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"), F.max(F.datediff("l_shipdate", F.lit("1992-01-01"))).cast("double").alias("shipped"), (F.count_if(F.col("l_returnflag") == "R") > 0).cast("int").alias("returned"))
    rows = orders.select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double").alias("ordered")).join(per, "o_orderkey")
    rows = stored(rows, "orders-lines")  # read for the cuts, for the bins and for the scores
    names = ["price", "ordered", "lines", "discount", "quantity", "shipped"]
    model = trees.fit(rows.withColumn("y", F.when(F.pmod(F.crc32(F.col("o_orderkey").cast("string")), F.lit(5)) != 0, F.col("returned"))), names, "y", rounds=6, rate=0.2)
    return trees.scored(rows, model, "risk").select(F.col("o_orderkey").alias("change_id"), F.round("risk", 6).alias("risk"))
