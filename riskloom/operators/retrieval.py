"""Retrieval: BM25, hashed vectors, nearest neighbours, TF-IDF reranking and rank fusion, for many queries at once.

Postings are a table (doc, term, tf, len); a query is a table too (qid, term, n). Only the postings of query terms meet the
queries. Top rows come from window ranks by query, so that nothing is collected. An index is stored under a name made
from its texts, and used again as long as they are the same.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from riskloom.functions.text import TOKEN, cited, find_all, injections, token_terms, tokenize
from riskloom.operators.graph import cut
from riskloom.operators.storage import exists, shared_folder, stored
from riskloom.session import importable

K1, B, RRF_K = 1.2, 0.75, 60
#: Rows up to which a dictionary of tokens, or the hits of all queries, are broadcast.
DICTIONARY, FEW = 1_000_000, 300_000


def token_counts(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, term, n of the tokens of every text that has any.

    Each different raw token is split and stemmed once; texts meet this dictionary by a join. Where the dictionary can be broadcast,
    texts are dealt by their keys and tokens stay in their task; else tokens are shuffled to the dictionary.
    """
    tokens = lambda d: d.select(*keys, F.explode(find_all(F.coalesce(F.col(text), F.lit("")), TOKEN)).alias("_raw"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, for a little text is much work
    words = cut(tokens(docs).select("_raw").distinct().repartition(parts, "_raw").select("_raw", F.explode(tokenize(F.col("_raw"))).alias("term")).groupBy("_raw", "term").agg(F.count("*").alias("_m")))
    if words.limit(DICTIONARY + 1).count() <= DICTIONARY:
        return tokens(docs.repartition(parts, *keys)).join(F.broadcast(words), "_raw").groupBy(*keys, "term").agg(F.sum("_m").alias("n"))
    raw = tokens(docs).groupBy(*keys, "_raw").agg(F.count("*").alias("_n"))
    return raw.join(words, "_raw").groupBy(*keys, "term").agg(F.sum(F.col("_n") * F.col("_m")).alias("n"))


def raw_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, raws: the different raw tokens of every text that has any, with spaces between them; parted in Arrow batches, since a match
    costs a pattern in the JVM several objects."""
    importable(docs.sparkSession)
    schema = StructType([docs.schema[key], StructField("raws", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TOKEN).findall
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                raws = [" ".join(set(find(t))) if t else "" for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), pa.array(raws, arrow.field(1).type)], schema=arrow)

    return docs.select(key, text).mapInArrow(run, schema).where("raws <> ''")


def shared_terms(claims: DataFrame, sources: DataFrame, claim: str, source: str, text: str, least: float = 0.0) -> DataFrame:
    """claim, source, h, n of the pairs that share a term: how many, and how many different ones the claim has, where h / n is `least`
    at least. Null keys have no pairs.

    Texts of sources are parted once; each different raw token is split and stemmed once, and only those with a term of some claim meet
    the texts. Hits are dealt by source, so that its pairs are counted where they arise: in NumPy if the claims' terms are FEW, else by joins.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, for a few hits become many pairs
    q = token_counts(claims.where(F.col(claim).isNotNull()), [claim], text).select(claim, F.col("term").alias("_w"))
    q = stored(q.join(q.groupBy(claim).agg(F.count("*").alias("n")), claim), "claim-terms")
    few = q.limit(FEW + 1).count() <= FEW
    small = lambda df: F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
    held = stored(raw_tokens(sources.where(F.col(source).isNotNull()), source, text), "raw-tokens").select(source, F.explode(F.split("raws", " ")).alias("_raw"))
    words = held.select("_raw").distinct().repartition(parts, "_raw").select("_raw", F.explode(tokenize(F.col("_raw"))).alias("_w"))
    known = stored(words.join(small(q.select("_w").distinct()), "_w", "left_semi").distinct(), "known-tokens")
    hits = held.join(small(known), "_raw").select(source, "_w").repartition(parts, source)
    if not few:
        pairs = hits.distinct().join(q, "_w").groupBy(claim, source, "n").agg(F.count("*").alias("h"))
        return pairs.where(F.col("h") / F.col("n") >= least).select(claim, source, "h", "n")
    terms = q.sort("_w").toArrow()
    shared = spark.sparkContext.broadcast((terms.column("_w").combine_chunks().dictionary_encode(), terms.column(claim).combine_chunks().dictionary_encode(), terms.column("n").to_numpy()))
    schema = StructType([claims.schema[claim], sources.schema[source], StructField("h", LongType()), StructField("n", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c, n = shared.value
        of = c.indices.to_numpy()  # the claims of the terms, term by term
        degree = np.bincount(w.indices.to_numpy(), minlength=len(w.dictionary))
        begin = np.cumsum(degree) - degree
        wide = len(c.dictionary)
        size = np.zeros(wide, np.int64)
        size[of] = n
        step = max(1, (1 << 22) // max(wide, len(of), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                lists = b.column(1)
                term = pc.index_in(pc.list_flatten(lists), w.dictionary).to_numpy()
                times = degree[term]
                ends = np.cumsum(times)
                place = np.arange(times.sum()) + np.repeat(begin[term] - ends + times, times)
                row = np.repeat(pc.list_parent_indices(lists).to_numpy(), times)
                h = np.bincount(row * wide + of[place], minlength=b.num_rows * wide)
                hit = np.flatnonzero(h)
                hit = hit[h[hit] / size[hit % wide] >= least]
                columns = [c.dictionary.take(pa.array(hit % wide)), b.column(0).take(pa.array(hit // wide)), pa.array(h[hit]), pa.array(size[hit % wide])]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return hits.groupBy(source).agg(F.collect_set("_w").alias("ws")).mapInArrow(run, schema)


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, term, tf, len (the tokens of the document)."""
    terms = token_counts(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), ["doc"], "text")
    return terms.select("doc", "term", F.col("n").alias("tf"), F.sum("n").over(W.partitionBy("doc")).alias("len"))


def text_print(docs: DataFrame, doc: str, text: str) -> str:
    """A name for a set of texts that does not depend on their order."""
    h = F.xxhash64(F.col(doc).cast("string"), text)
    a = docs.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("x")).first()
    return hashlib.sha256(f"{a.n} {a.s} {a.x}".encode()).hexdigest()[:24]


def saved_index(docs: DataFrame, doc: str, text: str, kind: str = "postings", make: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """The index of these texts from the shared folder; it is made (postings, unless another way is given) where it is not there."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/index-{kind}-{text_print(docs, doc, text)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        (make or postings)(docs, doc, text).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bm25(index: DataFrame, queries: DataFrame, k: int, n_docs: int | None = None) -> DataFrame:
    """qid, doc, score, rank of the best k documents of each query with a positive score, ties by doc.

    index: doc, term, tf, len; queries: qid, term, n (a repeated term counts repeatedly; unknown ones not at all). The
    average length is over documents with tokens unless n_docs says how many there are.
    """
    total = index.groupBy("doc").agg(F.first("len").alias("len")).agg(F.sum("len").alias("s"), (F.lit(n_docs) if n_docs is not None else F.count("*")).alias("n_docs"))
    total = total.select("n_docs", (F.col("s") / F.col("n_docs")).alias("avg"))
    df = index.join(queries.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    terms = queries.join(df, "term").join(F.broadcast(total)).withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = F.when(F.col("avg") > 0, K1 * (1 - B + B * F.col("len") / F.col("avg"))).otherwise(K1)
    weighed = index.join(F.broadcast(total)).select("doc", F.col("term").alias("key"), (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("x"))
    return top_products(weighed, terms.select("qid", F.col("term").alias("key"), (F.col("n") * F.col("idf")).alias("y")), k, positive=True)


def top_products(vectors: DataFrame, queries: DataFrame, k: int, positive: bool = False, limit: int = 1_000) -> DataFrame:
    """qid, doc, score, rank of the best k documents of each query by the sum of x * y over the keys that both have.

    vectors: doc, key, x; queries: qid, key, y; positive leaves out scores of 0 and less, documents without a common key are always left
    out. Queries are dealt by hash into blocks of about `limit`. A block goes to every task as one matrix; of the vectors the entries under
    its keys are shuffled once, by document, and k rows a batch and query come out, so that no pair of document and query is shuffled.
    """
    spark = vectors.sparkSession
    importable(spark)
    blocks = max(1, -(-queries.select("qid").distinct().count() // limit))
    parts = [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) for b in range(blocks)]
    schema = StructType([StructField("qid", queries.schema["qid"].dataType), StructField("doc", vectors.schema["doc"].dataType), StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def near(part: DataFrame) -> DataFrame:
        rows = part.groupBy("qid", "key").agg(F.sum("y").cast("double").alias("y")).collect()
        if not rows:
            return spark.createDataFrame([], schema)
        keys, qids = ({v: i for i, v in enumerate(dict.fromkeys(r[c] for r in rows))} for c in ("key", "qid"))
        weights, asked = np.zeros((len(keys), len(qids))), np.zeros((len(keys), len(qids)), np.float32)
        for r in rows:
            weights[keys[r.key], qids[r.qid]], asked[keys[r.key], qids[r.qid]] = r.y, 1
        shared = spark.sparkContext.broadcast((list(qids), weights, None if positive else asked))
        numbers = spark.createDataFrame(list(keys.items()), StructType([StructField("key", vectors.schema["key"].dataType), StructField("number", IntegerType())]))
        held = vectors.join(F.broadcast(numbers), "key").where("x is not null").select("doc", F.struct("number", F.col("x").cast("double").alias("x")).alias("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, w, met = shared.value
            names, width = pa.array(names, arrow.field("qid").type), len(w)
            step = max(256, min(4096, (1 << 22) // width))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    own = batch.slice(at, step)
                    own = own.take(pc.sort_indices(own.column("doc")))  # of equals the least document comes first
                    v, n = own.column("v"), own.num_rows
                    place = np.repeat(np.arange(n), pc.list_value_length(v).to_numpy()) * width + v.flatten().field("number").to_numpy()
                    scores = np.bincount(place, v.flatten().field("x").to_numpy(), n * width).reshape(n, width) @ w
                    order = -np.round(scores, 9)
                    if met is None:
                        order[scores <= 0] = np.inf
                    elif (scores == 0).any():
                        order[(np.bincount(place, minlength=n * width) > 0).astype(np.float32).reshape(n, width) @ met == 0] = np.inf
                    top = np.argsort(order, axis=0, kind="stable")[:k]
                    kept = np.isfinite(np.take_along_axis(order, top, 0))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.nonzero(kept)[1])), own.column("doc").take(pa.array(top[kept])), pa.array(np.take_along_axis(scores, top, 0)[kept])], schema=arrow)

        dealt = held.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc")  # stated, for products are more work than their bytes tell
        return dealt.groupBy("doc").agg(F.collect_list("v").alias("v")).mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, (best(near(part), k) for part in parts))


def terms_of(index: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (qid, doc; stored) with the index rows of their documents; a few hits go to the index, not the index to them."""
    return index.join(F.broadcast(hits) if hits.limit(FEW + 1).count() <= FEW else hits, "doc")


def best(scores: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The first k rows of each query by score (to so many digits, that sums in another order tie alike) and doc."""
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", digits).desc(), "doc"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


class TermHashes(dict):
    """By raw token, the CRC-32 and the bytes behind a space of each of its terms, remembered up to a bound."""

    def __missing__(self, raw: str) -> list[tuple[int, bytes]]:
        if len(self) > 150_000:
            self.clear()
        t = self[raw] = [(zlib.crc32(w), b" " + w) for w in map(str.encode, token_terms(raw))]
        return t


_HASHES = TermHashes()


def hashed_vector(docs: DataFrame, doc: str, text: str, dim: int = 1024) -> DataFrame:
    """doc, idx, x: sparse unit vectors of tokens and token pairs; index crc32 mod dim, sign from bit 31, log-damped.

    Texts become places and sums in Arrow batches, which are dealt by document once; a raw token is split and stemmed once a worker.
    """
    spark = docs.sparkSession
    importable(spark)

    @F.arrow_udf("array<struct<idx:int,v:double>>")
    def placed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = re.compile(TOKEN).findall
        for batch in texts:
            ends, places, sums = [0], [np.zeros(0, np.int64)], [np.zeros(0)]
            for at in range(0, len(batch), 512):
                for own in batch.slice(at, 512).to_pylist():
                    t = [x for raw in find(own or "") for x in _HASHES[raw]]
                    h = np.array([c for c, _ in t] + [zlib.crc32(b, c) for (c, _), (_, b) in pairwise(t)], np.int64)
                    v = np.bincount(h % dim, np.where(h >= 1 << 31, -1.0, 1.0), dim)
                    places.append(np.flatnonzero(v))
                    sums.append(v[places[-1]])
                    ends.append(ends[-1] + len(places[-1]))
            entries = pa.StructArray.from_arrays([pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(sums))], ["idx", "v"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)

    made = docs.select(F.col(doc).alias("doc"), placed(F.col(text)).alias("e")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc")
    # the outer kind of explode: for the other one Spark adds a filter that makes the array twice
    entries = made.select("doc", F.explode_outer("e").alias("e")).where("e is not null")
    sums = entries.groupBy("doc", F.col("e.idx").alias("idx")).agg(F.sum("e.v").alias("v"))
    damped = sums.where("v <> 0").withColumn("v", F.signum("v") * F.log1p(F.abs("v")))
    return damped.withColumn("x", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("doc")))).select("doc", "idx", "x")


def sparse_nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, doc, score, rank by dot product of sparse vectors; queries: doc (as qid), idx, x."""
    q = queries.select(F.col("doc").alias("qid"), F.col("idx").alias("key"), F.col("x").alias("y"))
    return top_products(vectors.select("doc", F.col("idx").alias("key"), "x"), q, k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def dense_nearest(vectors: DataFrame, queries: DataFrame, k: int, limit: int = 10_000) -> DataFrame:
    """qid, doc, score, rank: exact nearest neighbours of a stated query set by cosine.

    vectors: doc, v; queries: qid, q. A query set of more than `limit` rows is dealt by hash into blocks of about `limit`
    rows. A block's queries go to every task as one matrix, which meets each batch of vectors in one product; a
    task keeps its own best k of every query (ties by doc), so that k rows a task and query reach the shuffle.
    """
    blocks = max(1, -(-queries.count() // limit))
    parts = [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) for b in range(blocks)]
    importable(vectors.sparkSession)
    schema = StructType([StructField("qid", queries.schema["qid"].dataType), StructField("doc", vectors.schema["doc"].dataType), StructField("score", DoubleType())])

    def near(part: DataFrame) -> DataFrame:
        rows = part.select("qid", "q").collect()
        if not rows:
            return vectors.sparkSession.createDataFrame([], schema)
        shared = vectors.sparkSession.sparkContext.broadcast(([r.qid for r in rows], _unit(np.array([r.q for r in rows], np.float64))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            docs: list = [[] for _ in qids]
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    own = batch.slice(at, 1024)
                    names = own.column("doc").to_pylist()
                    scores = q @ _unit(np.array(own.column("v").to_pylist(), np.float64)).T
                    few = min(k, len(names))
                    least = np.partition(scores, len(names) - few, axis=1)[:, len(names) - few] - 1e-9
                    for i, j in zip(*np.nonzero(scores >= least[:, None]), strict=True):
                        docs[i].append((-round(float(scores[i, j]), 9), names[j], float(scores[i, j])))
                    docs = [sorted(d)[:k] for d in docs]
            rows = [(qid, d[1], d[2]) for qid, own in zip(qids, docs, strict=True) for d in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(to_arrow_schema(schema))], schema=to_arrow_schema(schema))

        return vectors.select("doc", "v").mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, (best(near(part), k) for part in parts))


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    n = np.linalg.norm(m, axis=1, keepdims=True) if len(m) else np.ones((0, 1))
    return m / np.where(n > 0, n, 1)


def fuse(rankings: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """qid, doc, score, sources of reciprocal rank fusion; rankings: qid, source, doc, rank. Weights are 1 unless given."""
    w = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in (weights or {"": 1.0}).items() for x in kv)), F.col("source")), F.lit(1.0))
    firsts = rankings.groupBy("qid", "source", "doc").agg(F.min("rank").alias("rank"))
    dense = firsts.withColumn("rank", F.row_number().over(W.partitionBy("qid", "source").orderBy("rank", "doc")))
    return dense.groupBy("qid", "doc").agg(F.sum(w / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def rerank(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid, doc, score: TF-IDF cosine fitted on each query and its own candidates.

    queries: qid, term, n; candidates: qid, doc, term, tf. Sublinear tf, smooth idf, unit length.
    """
    texts = candidates.select("qid", F.col("doc").cast("string").alias("member"), "term", F.col("tf").alias("n")).unionByName(queries.select("qid", F.lit("?").alias("member"), "term", "n"))
    size = texts.groupBy("qid").agg(F.countDistinct("member").alias("size"))
    df = texts.groupBy("qid", "term").agg(F.count("*").alias("df"))
    x = texts.join(df, ["qid", "term"]).join(size, "qid").withColumn("x", (1 + F.log(F.col("n").cast("double"))) * (F.log((1 + F.col("size")) / (1 + F.col("df"))) + 1))
    x = x.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("qid", "member"))))
    q = x.where("member = '?'").select("qid", "term", F.col("x").alias("y"))
    score = x.where("member <> '?'").join(q, ["qid", "term"]).groupBy("qid", F.col("member").alias("doc")).agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    every = candidates.select("qid", F.col("doc").cast("string").alias("doc")).distinct()
    return every.join(score, ["qid", "doc"], "left").na.fill(0.0, ["score"])


def minmax(score: Column, by: str = "qid") -> Column:
    """Scores of a query scaled to 0..1; 0.5 where all are equal."""
    w = W.partitionBy(by)
    span = F.max(score).over(w) - F.min(score).over(w)
    return F.when(span > 0, (score - F.min(score).over(w)) / span).otherwise(0.5)


#: The rankings of each mode, and what an answer needs.
MODES = {"lexical": ["search", "bm25"], "dense": ["dense"], "graph": ["graph"], "hybrid": ["graph", "search", "bm25", "dense"]}
MIN_SUPPORT, REPLY_BOOST, LEAST_SENTENCE = 0.34, 0.25, 20
REFUSAL = "I can't find that in this repository."
INJECTION_REFUSAL = "I can only answer questions about this repository's code and history."
NO_TERMS = ["why", "what", "where", "when", "how", "does", "code", "function"]
LOCATION_QUESTION = r"(?i)^\s*(where|which (code|modules?|functions?)|what (calls|uses|depends))\b"


def hybrid(fused: DataFrame, reranked: DataFrame, k: int) -> DataFrame:
    """qid, doc, score, rank: half the scaled fusion score and half the scaled reranking score, ties by fusion rank.

    fused: qid, doc, score, rank; reranked: qid, doc, score.
    """
    both = fused.select("qid", F.col("doc").cast("string").alias("doc"), F.col("score").alias("f"), F.col("rank").alias("place")).join(reranked.select("qid", "doc", F.col("score").alias("r")), ["qid", "doc"])
    blend = both.select("qid", "doc", "place", (0.5 * minmax(F.round("f", 12)) + 0.5 * minmax(F.round("r", 12))).alias("score"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "place"))
    return blend.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "doc", F.round("score", 4).alias("score"), "rank")


def retrieve(rankings: dict[str, DataFrame], queries: DataFrame, index: DataFrame, k: int = 10, mode: str = "hybrid") -> DataFrame:
    """qid, doc, score, rank, sources of the k best documents by the rankings of a mode.

    rankings: by name (graph, search, bm25, dense) qid, doc, rank; those that are not there are left out. Each counts as far
    as a pool of 3 k places (20 at least); the fused pool is reranked against the query. A mode without rankings is an error.
    """
    pool = max(3 * k, 20)
    named = [rankings[n].select("qid", F.lit(n).alias("source"), "doc", "rank").where(F.col("rank") <= pool) for n in MODES[mode] if n in rankings]
    fused = cut(best(fuse(reduce(DataFrame.unionByName, named)), pool))
    terms = terms_of(index.select("doc", "term", "tf"), fused.select("qid", "doc"))
    every = fused.select("qid", F.col("doc").cast("string").alias("doc"), "sources")
    scores = rerank(queries, terms)
    blank = every.join(scores, ["qid", "doc"], "left").select("qid", "doc", F.coalesce("score", F.lit(0.0)).alias("score"))
    return hybrid(fused, blank, k).join(every, ["qid", "doc"])


def graph_ranking(distances: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, doc, rank: the chunks of the nodes around a query's seeds, nearest first; distances: qid, node, distance; chunks: node, doc."""
    near = distances.join(chunks, "node").groupBy("qid", "doc").agg(F.min(F.struct("distance", "node")).alias("o"))
    return near.select("qid", "doc", F.row_number().over(W.partitionBy("qid").orderBy("o", "doc")).alias("rank"))


def question_terms(question: Column) -> Column:
    """The tokens by which a question is grounded: longer than two letters, no question words."""
    return F.filter(F.array_distinct(tokenize(question)), lambda t: (F.length(t) > 2) & ~t.isin(NO_TERMS))


def support_of(terms: Column, text: Column) -> Column:
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.array_intersect(terms, tokenize(text))) / F.nullif(F.size(terms), F.lit(0)))


def best_statement(text: Column, terms: Column) -> Column:
    """The sentence that has most of the terms, from the second line on; replies ("name: ...", from the third line) get a boost.

    File and function lines, questions and short sentences are left out; of equals the first; null if nothing scores.
    """
    lines = F.slice(F.split(text, "\n"), 2, 1 << 30)
    reply = lambda line: F.exists(F.array(F.left(line, F.lit(40))), lambda h: h.contains(": "))
    of = lambda line, i: F.transform(F.split(line, r"(?<=[.!?])\s+"), lambda s: F.struct(F.trim(s).alias("s"), i.alias("i")))
    prose = F.transform(lines, lambda line, i: F.when(line.startswith("files:") | line.startswith("functions:"), F.expr("cast(array() as array<struct<s:string,i:int>>)")).otherwise(of(line, i)))
    kept = F.filter(F.flatten(prose), lambda x: (F.length(x["s"]) >= LEAST_SENTENCE) & ~x["s"].endswith("?"))
    boost = lambda x: F.when((x["i"] >= 1) & reply(x["s"]), REPLY_BOOST).otherwise(0.0)
    scored = F.transform(kept, lambda x, k: F.struct((support_of(terms, x["s"]) + boost(x)).alias("score"), (-k).alias("k"), x["s"].alias("s")))
    top = F.array_max(scored)
    return F.when(top["score"] > 0, top["s"])


def answers(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """qid, answer, citations, refused, support of every question.

    questions: qid, question; contexts: qid, doc, kind (code or else), text, rank. A context grounds a question if it has
    the share MIN_SUPPORT of its terms. A number in the question that no grounding context has refuses it, as does a
    prompt injection. Questions for a place name up to three pieces of code; others quote the best statements of the first three
    histories and name the first code, application before tests.
    """
    q = questions.select("qid", "question", question_terms(F.col("question")).alias("terms"), find_all(F.col("question"), r"\b\d{2,}\b").alias("numbers"), (F.size(injections(F.col("question"))) > 0).alias("injected"))
    c = q.join(contexts, "qid").withColumn("share", support_of(F.col("terms"), F.col("text"))).where(F.col("share") >= MIN_SUPPORT)
    c = c.withColumn("numbered", F.exists("numbers", lambda n: F.col("text").contains(n)))
    code = F.col("kind") == "code"
    place = F.row_number().over(W.partitionBy("qid", code).orderBy(F.when(code, F.col("doc").contains("chunk:tests/").cast("int")).otherwise(0), "rank", "doc"))
    c = c.withColumn("place", place).withColumn("any_number", F.max("numbered").over(W.partitionBy("qid"))).withColumn("top", F.max("share").over(W.partitionBy("qid")))
    head = F.replace(F.substring_index("text", "\n", 1), F.lit("# file: "), F.lit(""))
    cite = lambda x: F.concat(x, F.lit(" ["), "doc", F.lit("]"))
    quote = F.when(~code, cite(best_statement(F.col("text"), F.col("terms")))).when(F.col("place") == 1, F.concat(F.lit("The relevant code is "), cite(head), F.lit(".")))
    parts = c.where("place <= 3").select("qid", "any_number", "top", F.struct(code.alias("last"), "place", quote.alias("quote"), F.when(code, cite(head)).alias("spot"), "doc").alias("p"))
    g = parts.groupBy("qid").agg(F.array_sort(F.collect_list("p")).alias("p"), F.max("any_number").alias("any_number"), F.max("top").alias("top"))  # six parts at most
    spots = F.array_compact(F.transform("p", lambda x: x["spot"]))
    quotes = F.array_distinct(F.array_compact(F.transform("p", lambda x: x["quote"])))
    located = F.col("question").rlike(LOCATION_QUESTION) & (F.size(spots) > 0)
    text = F.when(located, F.concat(F.lit("See "), F.array_join(spots, "; "), F.lit("."))).otherwise(F.nullif(F.array_join(quotes, " "), F.lit("")))
    fine = ~F.col("injected") & ((F.size("numbers") == 0) | F.coalesce("any_number", F.lit(False)))
    out = q.join(g, "qid", "left").withColumn("text", F.when(fine, text))
    answer = F.coalesce("text", F.when(F.col("injected"), INJECTION_REFUSAL).otherwise(REFUSAL))
    return out.select("qid", answer.alias("answer"), F.array_sort(F.array_distinct(F.when(F.col("text").isNotNull(), cited(F.col("text"))).otherwise(F.array().cast("array<string>")))).alias("citations"), F.col("text").isNull().alias("refused"), F.coalesce("top", F.lit(0.0)).alias("support"))


#: Fixed value: files and functions that a commit's document names.
NAMED = 12


def commit_documents(commits: DataFrame) -> DataFrame:
    """id, kind, ref, title, text of commits (sha, author, message, files: array of paths, functions: array of names)."""
    short = F.left("sha", F.lit(10))
    named = lambda c: F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, NAMED), ", ")
    text = F.concat(F.lit("commit "), short, F.lit(" by "), "author", F.lit("\n"), "message", F.lit("\nfiles: "), named("files"), F.lit("\nfunctions: "), named("functions"))
    return commits.select(F.concat(F.lit("commit:"), short).alias("id"), F.lit("commit").alias("kind"), F.col("sha").alias("ref"), F.substring_index("message", "\n", 1).alias("title"), text.alias("text"))


def _thread(replies: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(replies, F.expr("cast(array() as array<struct<author:string,body:string>>)")), lambda x: F.concat(x["author"], F.lit(": "), x["body"])), "\n")


def issue_documents(issues: DataFrame) -> DataFrame:
    """The same of issues (number, title, body, labels: array, comments: array of author, body)."""
    text = F.concat(F.lit("issue #"), F.col("number").cast("string"), F.lit(" ["), F.array_join("labels", ", "), F.lit("] "), "title", F.lit("\n"), "body", F.lit("\n"), _thread(F.col("comments")))
    return issues.select(F.concat(F.lit("issue:"), F.col("number").cast("string")).alias("id"), F.lit("issue").alias("kind"), F.col("number").cast("string").alias("ref"), "title", text.alias("text"))


def request_documents(requests: DataFrame) -> DataFrame:
    """The same of pull requests (number, title, body, reviews: array of author, body)."""
    text = F.concat(F.lit("pull request #"), F.col("number").cast("string"), F.lit(" "), "title", F.lit("\n"), "body", F.lit("\n"), _thread(F.col("reviews")))
    return requests.select(F.concat(F.lit("pr:"), F.col("number").cast("string")).alias("id"), F.lit("pr").alias("kind"), F.col("number").cast("string").alias("ref"), "title", text.alias("text"))
