"""Indexed code search: a stored positional trigram index of lines; literal, word and regular-expression queries.

The index has a row for each trigram and line with the places at which it stands. A literal's hits follow from places alone: the
line has all its trigrams at their offsets from one start. A regular expression becomes clauses, each a set of trigrams of which
every matching line has one; only lines that meet all clauses are held against the expression. A query without a trigram
(short, case-blind or made of wildcards) reads all lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from riskloom.operators.retrieval import saved_index
from riskloom.session import importable

GRAM, BUCKETS = 3, 64
#: Characters of the texts that are put in order at a time, rows of a batch.
SLICE, ROWS = 1 << 20, 1 << 16
#: Strings that a part of an expression may stand for before only its trigrams are kept, characters of a class that count as strings.
STRINGS, CLASS = 32, 8

Clause = frozenset[str]


def lines_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line_no (from 1), line."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("n", "line")).select("doc", (F.col("n") + 1).cast("bigint").alias("line_no"), "line")


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(BUCKETS)).cast("int")


def trigrams(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """gram, doc, line_no, places (from 0), bucket; made where the texts are, some texts after the other, each by gram: nothing is shuffled."""
    importable(docs.sparkSession)
    schema = StructType([StructField("gram", StringType()), StructField("doc", docs.schema[doc].dataType), StructField("line_no", LongType()), StructField("places", ArrayType(IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = held = 0
            texts = batch.column("text").to_pylist()
            for i, t in enumerate(texts):
                held += len(t)
                if held >= SLICE or i + 1 == len(texts):
                    yield from _postings(texts[start : i + 1], batch.column("doc").slice(start, i + 1 - start), arrow)
                    start, held = i + 1, 0

    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(run, schema).withColumn("bucket", _bucket(F.col("gram")))


def _postings(texts: list[str], docs: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of some texts in order of gram, document and line."""
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = codes == 10
    at = np.flatnonzero(~(ends[:-2] | ends[1:-1] | ends[2:]))
    if not len(at):
        return
    line = np.concatenate([[0], np.cumsum(ends)[:-1]])  # of each character
    begins = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    lines = np.array([t.count("\n") + 1 for t in texts])
    owner, number = np.repeat(np.arange(len(texts)), lines), np.arange(lines.sum()) - np.repeat(np.cumsum(lines) - lines, lines) + 1
    key = codes[at] << 42 | codes[at + 1] << 21 | codes[at + 2]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    own = line[at]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]))
    places = (at - begins[own]).astype(np.int32)
    grams, which = np.unique(key[first], return_inverse=True)
    spelt = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    spelt = pa.array([spelt[i : i + GRAM] for i in range(0, len(spelt), GRAM)])
    for a in range(0, len(first), ROWS):
        part, stop = own[first[a : a + ROWS]], np.append(first, len(at))[a : a + ROWS + 1]
        each = pa.ListArray.from_arrays(pa.array(stop - stop[0], pa.int32()), pa.array(places[stop[0] : stop[-1]])).cast(schema.field("places").type)
        yield pa.RecordBatch.from_arrays([spelt.take(pa.array(which[a : a + ROWS])), docs.take(pa.array(owner[part])), pa.array(number[part], pa.int64()), each], schema=schema)


def index(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """The stored index of these texts; made where it is not there."""
    return saved_index(docs, doc, text, "trigrams", trigrams)


def _grams(s: str) -> list[str]:
    return [s[i : i + GRAM] for i in range(len(s) - GRAM + 1)]


def _needs(strings: set[str]) -> list[Clause]:
    """Clauses of a part that is one of these strings: each string has its own trigram at a place that all have."""
    least = min(map(len, strings))
    return [frozenset(s[i : i + GRAM] for s in strings) for i in range(least - GRAM + 1)]


def _node(op, arg) -> tuple[set[str] | None, list[Clause]]:
    """(strings that a part stands for, or None, and what it needs)."""
    if op is sre.LITERAL:
        return {chr(arg)}, []
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, []  # no width; what they ask for beyond that is left to the check of the line
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x))
            elif kind is sre.RANGE and x[1] - x[0] < CLASS:
                chars |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None, []
        return (chars, []) if 0 < len(chars) <= CLASS else (None, [])
    if op is sre.SUBPATTERN:
        return (None, []) if arg[1] & re.IGNORECASE else _sequence(arg[3])
    if op is sre.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in each) and len(strings := set().union(*(s for s, _ in each))) <= STRINGS:
            return strings, []
        best = [min(_needs(s) if s is not None else c, key=len, default=None) for s, c in each]
        return None, [] if None in best else [frozenset().union(*best)]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, body = arg
        strings, needs = _sequence(body)
        if (low, high) == (1, 1):
            return strings, needs
        if strings is not None and low == 0 and high == 1:
            return strings | {""}, []
        if strings is not None and low == high and len(strings) ** low <= STRINGS and low <= STRINGS:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, []
        return None, (needs if strings is None else _needs(strings)) if low else []
    return None, []


def _sequence(nodes) -> tuple[set[str] | None, list[Clause]]:
    whole, now, needs = True, {""}, []
    for op, arg in nodes:
        strings, more = _node(op, arg)
        needs += more
        if strings is not None and len(strings) * len(now) <= STRINGS:
            now = {a + b for a in now for b in strings}
            continue
        whole = False
        needs += _needs(now)
        now = strings if strings is not None else {""}
    return (now, []) if whole else (None, needs + _needs(now))


def clauses(pattern: str) -> list[Clause]:
    """Sets of trigrams of which every line that a regular expression matches has one each; none means that any line may match."""
    tree = parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        return []
    strings, needs = _sequence(tree)
    return list(dict.fromkeys(_needs(strings) if strings is not None else needs))


def search(index: DataFrame, lines: DataFrame, queries: Iterable[tuple[str, str, str]]) -> DataFrame:
    """qid, doc, line_no of all lines that a query hits; queries: (qid, mode, text), mode literal, word or regex, a stated list.

    index: what index() gives of the texts of lines (doc, line_no, line). Regular expressions are Java's; line by line.
    """
    spark = lines.sparkSession
    queries = list(queries)
    pattern = {q: text if mode == "regex" else rf"\b{re.escape(text)}\b" for q, mode, text in queries if mode != "literal"}
    placed = [(q, g, i, len(_grams(text))) for q, mode, text in queries if mode != "regex" for i, g in enumerate(_grams(text))]
    asked = [(q, g, i, len(cs)) for q, mode, text in queries if mode == "regex" and (cs := clauses(text)) for i, c in enumerate(cs) for g in sorted(c)]
    blind = [(q, mode, text) for q, mode, text in queries if q not in {x[0] for x in placed + asked}]
    grams = sorted({x[1] for x in placed + asked})
    out = []
    if grams:
        wanted = index.where(F.col("bucket").isin(sorted({r.b for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket(F.col("g")).alias("b")).collect()})) & F.col("gram").isin(grams))
    if placed:  # all trigrams at their offsets from one start
        terms = spark.createDataFrame(placed, "qid string, gram string, offset int, n int")
        starts = wanted.join(F.broadcast(terms), "gram").select("qid", "doc", "line_no", "n", F.explode("places").alias("at"), "offset").where("at >= offset")
        hits = starts.groupBy("qid", "doc", "line_no", "n", F.expr("at - offset").alias("start")).agg(F.count("*").alias("k")).where("k = n").select("qid", "doc", "line_no").distinct()
        out.append(_checked(hits, lines, {q: p for q, p in pattern.items() if q in {x[0] for x in placed}}))
    if asked:
        terms = spark.createDataFrame(asked, "qid string, gram string, clause int, n int")
        met = wanted.join(F.broadcast(terms), "gram").groupBy("qid", "doc", "line_no", "n").agg(F.size(F.collect_set("clause")).alias("k"))  # a query has few clauses
        out.append(_checked(met.where("k = n").select("qid", "doc", "line_no"), lines, {q: p for q, p in pattern.items() if q in {x[0] for x in asked}}))
    for q, mode, text in blind:
        hit = F.col("line").contains(text) if mode == "literal" else F.col("line").rlike(pattern[q])
        out.append(lines.where(hit).select(F.lit(q).alias("qid"), "doc", "line_no"))
    first, *rest = out or [spark.createDataFrame([], lines.select(F.lit("").alias("qid"), "doc", "line_no").schema)]
    for more in rest:
        first = first.unionAll(more)
    return first


def _checked(hits: DataFrame, lines: DataFrame, pattern: dict[str, str]) -> DataFrame:
    """The hits whose line has the query's pattern; a query without one passes as it is."""
    if not pattern:
        return hits
    texts = hits.where(F.col("qid").isin(list(pattern))).join(lines, ["doc", "line_no"])
    good = texts.where(" or ".join(f"(qid = {_quoted(q)} and line rlike {_quoted(p)})" for q, p in pattern.items())).select("qid", "doc", "line_no")
    return hits.where(~F.col("qid").isin(list(pattern))).unionAll(good)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def first_hits(hits: DataFrame, limit: int = 200) -> DataFrame:
    """The first hits of each query in order of document and line; a document is cut to as many before they meet."""
    from pyspark.sql.window import Window as W

    place = lambda *by: F.row_number().over(W.partitionBy("qid", *by).orderBy("doc", "line_no"))
    few = hits.withColumn("_p", place(F.pmod(F.xxhash64("doc"), F.lit(64)))).where(F.col("_p") <= limit)
    return few.withColumn("_p", place()).where(F.col("_p") <= limit).drop("_p")
