"""Benchmark decontamination (operator 2), native: a positional inverted index of the training text.

The index holds the postings (document, position) of every word that occurs in a test item, as a table in the shared
folder. Each window of a test item has its words ranked by their number of postings; the lists of the rarest two,
shifted by their places in the item, are intersected into alignments (document, item, diagonal). An alignment is
compared word by word, so the matches are exact. Every window goes through the index; no list is cut.

A document is known by its id and a hash of its text, so repeated rows repeat results and rows that share an id do
not mix. Null texts have no words and stay with zeros. Items without words are no items; items shorter than a window
are one window. An empty benchmark or an empty table give zeros or no rows. Very long texts are indexed whole; of words
equally rare the one that stands first in the item counts as rarer. Other columns of both tables are not read, whatever
their names; items that repeat count once, equal item ids with different texts together.
Test sets are broadcast only while small (BROADCAST rows); beyond that the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.llm.common import UPPER, small, sql_words, stored

#: Words before A-Z become a-z.
RAW_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Stands for a null id inside the joins; results depend on the text alone, so that a row which has this id loses nothing.
NO_ID = -(1 << 63)
#: Stands for the end of a text; no word has this character.
END = "\x00"


def known_id():
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")


def item_table(items: DataFrame, window: int, text: str = "text", key: str = "item_id") -> DataFrame:
    """item_id, words, width of the items with words; stored."""
    rows = items.select(F.col(key).alias("item_id"), sql_words(F.col(text)).alias("words")).distinct().where(F.size("words") > 0)
    return stored(rows.withColumn("width", F.least(F.size("words"), F.lit(window))).withColumn("iid", F.monotonically_increasing_id()), "items")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The stored index: own (the id), doc_id (the id or NO_ID), th (hash of the text), pos, term; one row more for each text, term -1 at its end.

    vocabulary: word, term. Words meet on their lower case and are then held against the A-Z rule.
    """
    low = vocabulary.select(F.lower("word").alias("low"), F.col("word").alias("known"), "term")
    low = low.unionAll(docs.sparkSession.createDataFrame([(END, END, -1)], "low string, known string, term bigint"))
    text = F.coalesce("text", F.lit(""))
    tokens = docs.select(F.col("doc_id").alias("own"), known_id(), F.xxhash64("text").alias("th"), F.posexplode(F.concat(F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), F.array(F.lit(END)))).alias("pos", "word"))
    tokens = tokens.withColumn("low", F.lower("word"))
    rows = tokens.join(small(low), "low").where((F.col("word") == F.col("known")) | (F.translate("word", UPPER, UPPER.lower()) == F.col("known")))
    return stored(rows.select("own", "doc_id", "th", "pos", "term"), "postings")


def anchors(index: DataFrame, items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """iid, pair, term, ipos, rank (1 or 2), width: the places of the rarest and the second rarest word of each window; stored.

    pair names the two places, so that windows with the same two share a row each. A window with a term that the index
    lacks has none; a window of one word has rank 1 only.
    """
    places = items.select("iid", "width", F.size("words").alias("n"), F.posexplode("words").alias("ipos", "word")).join(vocabulary, "word").drop("word")
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    known = places.join(df, "term", "left")
    starts = F.sequence(F.greatest(F.col("ipos") - F.col("width") + 1, F.lit(0)), F.least("ipos", F.col("n") - F.col("width")))
    windows = known.select("iid", "width", "ipos", "term", F.col("df"), F.explode(starts).alias("start"))
    whole = W.partitionBy("iid", "start")
    ranked = windows.withColumn("have", F.count("df").over(whole)).withColumn("rank", F.row_number().over(whole.orderBy("df", "ipos"))).where("have = width and rank <= 2")
    pair = F.concat_ws("-", F.min("ipos").over(whole.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.max("ipos").over(whole.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    ranked = ranked.withColumn("pair", F.xxhash64("iid", pair)).withColumn("rank", F.when(F.col("ipos") == F.min("ipos").over(whole), 1).otherwise(2))
    return stored(ranked.select("iid", "pair", "term", "ipos", "rank", "width").distinct(), "anchors")


def alignments(index: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, th, iid, diag (position less place in the item) where the rarest and the second rarest word of a window agree."""
    lists = index.where("term >= 0").join(small(places), "term").select("doc_id", "th", "iid", "pair", (F.col("pos") - F.col("ipos")).alias("diag"), "rank", "width")
    both = lists.groupBy("doc_id", "th", "iid", "pair", "diag").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.min("width").alias("width"))
    return both.where("low < high or width = 1").select("doc_id", "th", "iid", "diag").distinct()


def proximity_matches(index: DataFrame, places: DataFrame, slop: int = 5) -> DataFrame:
    """doc_id, th, iid where the rarest and the second rarest word of a window stand at most `slop` words from their places to each other.

    Diagonals are dealt to cells of slop + 1, and neighbouring cells meet, so a frequent word meets only what is near it.
    """
    cell = F.floor(F.col("diag") / (slop + 1))
    of = lambda rank: index.where("term >= 0").join(small(places.where(f"rank = {rank}")), "term").select("doc_id", "th", "iid", (F.col("pos") - F.col("ipos")).alias("diag")).distinct()
    one = of(1).withColumn("cell", cell)
    two = of(2).withColumnRenamed("diag", "other").withColumn("cell", F.explode(F.array(*(F.floor(F.col("other") / (slop + 1)) + d for d in (-1, 0, 1)))))
    near = one.join(two, ["doc_id", "th", "iid", "cell"]).where(F.abs(F.col("diag") - F.col("other")) <= slop)
    return near.select("doc_id", "th", "iid").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, th, item_id, spans: the runs (start, end) of document words, width at least, that equal consecutive item words."""
    wanted = found.select("doc_id", "th").distinct()
    texts = docs.select(known_id(), F.xxhash64("text").alias("th"), "text").join(small(wanted), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    texts = texts.select("doc_id", "th", sql_words(F.col("text")).alias("dwords"))
    aligned = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("iid", "diag")).alias("found"))
    pairs = texts.join(aligned, ["doc_id", "th"]).select("doc_id", "th", "dwords", F.explode("found").alias("f")).select("doc_id", "th", "dwords", "f.*")
    pairs = pairs.join(small(items.withColumnRenamed("words", "iwords")), "iid")
    shift = F.greatest("diag", F.lit(0))
    length = F.least(F.size("dwords") - shift, F.size("iwords") - (shift - F.col("diag")))
    pairs = pairs.withColumn("shift", shift).withColumn("length", length).where("length > 0")
    pairs = pairs.withColumn("same", F.zip_with(F.slice("dwords", F.col("shift") + 1, F.col("length")), F.slice("iwords", F.col("shift") - F.col("diag") + 1, F.col("length")), lambda a, b: a == b))
    breaks = F.expr("concat(array(-1), filter(transform(same, (x, i) -> if(x, null, i)), i -> i is not null), array(size(same)))")
    pairs = pairs.withColumn("breaks", breaks)
    runs = F.expr("filter(transform(breaks, (b, i) -> struct(if(i = 0, 0, breaks[i - 1] + 1) + shift as s, b + shift as e)), r -> r.e - r.s >= width)")
    return pairs.select("doc_id", "th", "item_id", runs.alias("spans")).where(F.size("spans") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs without a window of the benchmark, in their columns."""
    matches = matched(docs, benchmark, window)[1].select(F.col("doc_id").alias("own"), "th").distinct()
    rows = docs.select(F.struct("*").alias("row"), known_id().alias("own"), F.xxhash64("text").alias("th"))
    return rows.join(small(stored(matches, "contaminated")), ["own", "th"], "left_anti").select("row.*")


def matched(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(index, matches): the stored index of docs and the rows of phrase_matches()."""
    items = item_table(benchmark, window)
    vocabulary = stored(items.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    index = build_index(docs, vocabulary)
    found = stored(alignments(index, anchors(index, items, vocabulary)), "alignments")
    return index, phrase_matches(docs, items, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs (doc_id, text) against benchmark (item_id, text)."""
    index, matches = matched(docs, benchmark, window)
    hits = matches.groupBy("doc_id", "th").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    union = F.expr("aggregate(spans, struct(0 as n, 0 as e), (a, x) -> struct(a.n + greatest(x.e - greatest(x.s, a.e), 0) as n, greatest(a.e, x.e) as e), a -> cast(a.n as bigint))")
    hits = hits.select("doc_id", "th", union.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ",").alias("items"))
    texts = index.where("term = -1").select("own", "doc_id", "th", F.col("pos").cast("bigint").alias("n_words"))
    return texts.join(hits, ["doc_id", "th"], "left").select(
        F.col("own").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


#: The same rows in DuckDB: every window against every run of words.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM d, ks WHERE len(w) >= k),
m AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
