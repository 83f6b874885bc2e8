"""Table functions for SQL, by registered names: embedders, rerankers and checkers.

    register(spark)
    SELECT * FROM embedded(TABLE(docs), kind => 'hashing', dim => 64)                            -- docs: id, text
    SELECT * FROM reranked(TABLE(hits) PARTITION BY qid, kind => 'tfidf', k => 5)               -- hits: qid, query, doc, text
    SELECT * FROM checked(TABLE(claims) PARTITION BY kind)                                       -- claims: claim_id, kind, facts

A new kind is a function in one of the dictionaries EMBEDDERS, RERANKERS and CHECKERS. Kinds, columns and numbers are looked at when a
query is analysed, so that a wrong one is an error before anything runs. A partition of `reranked` is a question with its
candidates, which are few; `checked` takes its rows one by one, whatever the size of a partition.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from riskloom.session import importable

WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def hashed(text: str | None, dim: int) -> list[float]:
    """Words and pairs of words at place crc32 mod dim, sign from bit 31, log-damped, of length 1."""
    w = words(text)
    v = [0.0] * dim
    for gram in (*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))):
        h = zlib.crc32(gram.encode())
        v[h % dim] += -1.0 if h >> 31 else 1.0
    v = [math.copysign(math.log1p(abs(x)), x) for x in v]
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


def counted(text: str | None, dim: int) -> list[float]:
    """Counts of words at place crc32 mod dim."""
    v = [0.0] * dim
    for w in words(text):
        v[zlib.crc32(w.encode()) % dim] += 1.0
    return v


def overlap(query: str | None, texts: list[str | None]) -> list[float]:
    """The share of the query's different words that a text has."""
    q = set(words(query))
    return [len(q & set(words(t))) / len(q) if q else 0.0 for t in texts]


def tfidf(query: str | None, texts: list[str | None]) -> list[float]:
    """Cosine of damped, idf-weighted words; fitted on the query and its candidates alone."""
    bags = [Counter(words(t)) for t in (query, *texts)]
    n = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + c)) + 1 for w, c in n.items()}
    rows = [{w: (1 + math.log(c)) * idf[w] for w, c in b.items()} for b in bags]
    norm = [math.sqrt(sum(x * x for x in r.values())) for r in rows]
    return [sum(x * r.get(w, 0.0) for w, x in rows[0].items()) / (norm[0] * m) if norm[0] and m else 0.0 for r, m in zip(rows[1:], norm[1:], strict=True)]


def test_impact(facts: dict) -> str:
    """A test that was run is impacted if it hits the change or newly fails."""
    if not facts.get("ran"):
        return "UNVERIFIABLE"
    return "VERIFIED" if facts.get("hits", 0) > 0 or facts.get("newly_failing") else "REFUTED"


def api_break(facts: dict) -> str:
    """A break needs a caller and an incompatible change."""
    if facts.get("compatible") is None:
        return "UNVERIFIABLE"
    return "VERIFIED" if not facts["compatible"] and facts.get("callers", 0) > 0 else "REFUTED"


EMBEDDERS: dict[str, Callable[[str | None, int], list[float]]] = {"hashing": hashed, "counts": counted}
RERANKERS: dict[str, Callable[[str | None, list[str | None]], list[float]]] = {"overlap": overlap, "tfidf": tfidf}
CHECKERS: dict[str, Callable[[dict], str]] = {"test_impact": test_impact, "api_break": api_break}


def _columns(table: AnalyzeArgument, wanted: dict[str, str]) -> StructType:
    """The table's schema, if it has the columns; else an error that names those missing."""
    if not table.isTable:
        raise ValueError("the first argument has to be a table")
    missing = [c for c in wanted if c not in table.dataType.names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    wrong = [f"{c} is {table.dataType[c].dataType.simpleString()}, not {t}" for c, t in wanted.items() if t and table.dataType[c].dataType.simpleString() != t]
    if wrong:
        raise ValueError("; ".join(wrong))
    return table.dataType


def _constant(argument: AnalyzeArgument, name: str, allowed: Callable[[object], bool], what: str):
    if not argument.isConstantExpression or not allowed(argument.value):
        raise ValueError(f"{name} has to be {what}")
    return argument.value


def _known(argument: AnalyzeArgument, kinds: dict) -> None:
    _constant(argument, "kind", lambda v: v in kinds, f"one of {', '.join(sorted(kinds))}")


@udtf
class Embedded:
    """id, embedding of each row of a table with id and text."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, kind: AnalyzeArgument, dim: AnalyzeArgument) -> AnalyzeResult:
        table = _columns(rows, {"id": "", "text": "string"})
        _known(kind, EMBEDDERS)
        _constant(dim, "dim", lambda v: isinstance(v, int) and v > 0, "a positive number")
        return AnalyzeResult(StructType().add("id", table["id"].dataType).add("embedding", ArrayType(DoubleType())))

    def eval(self, rows: Row, kind: str, dim: int) -> Iterator[tuple]:
        yield rows["id"], EMBEDDERS[kind](rows["text"], dim)


@udtf
class Reranked:
    """qid, doc, score, rank of the best k candidates of each partition of a table with qid, query, doc and text; ties by doc."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, kind: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        table = _columns(rows, {"qid": "", "query": "string", "doc": "", "text": "string"})
        _known(kind, RERANKERS)
        _constant(k, "k", lambda v: isinstance(v, int) and v > 0, "a positive number")
        return AnalyzeResult(StructType().add("qid", table["qid"].dataType).add("doc", table["doc"].dataType).add("score", DoubleType()).add("rank", IntegerType()))

    def __init__(self) -> None:
        self.rows: list[Row] = []

    def eval(self, rows: Row, kind: str, k: int) -> None:
        self.rows.append(rows)
        self.kind, self.k = kind, k

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            scores = RERANKERS[self.kind](self.rows[0]["query"], [r["text"] for r in self.rows])
            order = sorted(zip(scores, self.rows, strict=True), key=lambda x: (-round(x[0], 9), x[1]["doc"]))
            for i, (score, r) in enumerate(order[: self.k]):
                yield r["qid"], r["doc"], float(score), i + 1


@udtf
class Checked:
    """claim_id, kind, status of claims with facts (JSON); a kind without a checker is UNVERIFIABLE."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        table = _columns(rows, {"claim_id": "", "kind": "string", "facts": "string"})
        return AnalyzeResult(StructType().add("claim_id", table["claim_id"].dataType).add("kind", StringType()).add("status", StringType()))

    def eval(self, rows: Row) -> Iterator[tuple]:
        checker = CHECKERS.get(rows["kind"])
        yield rows["claim_id"], rows["kind"], checker(json.loads(rows["facts"] or "{}")) if checker else "UNVERIFIABLE"


def register(spark: SparkSession) -> None:
    """Makes embedded, reranked and checked known to a session's SQL."""
    importable(spark)
    for name, function in (("embedded", Embedded), ("reranked", Reranked), ("checked", Checked)):
        spark.udtf.register(name, function)
