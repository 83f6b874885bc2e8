"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, encoding. Each stage is written and reread.

Stages take documents in any order and with repeated rows (copies, to them), read the columns of documents by name, and give an empty
table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bagminhash, bpe, decontam, linededup, toxicity
from riskloom.llm.common import stored
from riskloom.llm.registered import table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.

    Null and empty texts are scored like any other and stay; a score is of a text, so that equal texts go or stay together.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are equal or nearly so, across all documents, the first stays; the documents stay.

    First is the least doc_id, then the line's place. Null texts stay null, a document all of whose lines go keeps an empty text;
    blank lines are never repeats.
    """
    return linededup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are nearly equal, the first stays.

    First is the least doc_id. Texts without words (null and empty ones) are equal to one another: one of them stays.
    """
    return bagminhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none and stay; items without words mean nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids (little-endian unsigned 32-bit) of what is left.

    A null or empty text has no tokens and an empty value.
    """
    out = bpe.encoded(docs, vocabulary("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"))
    return out.select("doc_id", "lang", "source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: Of the stages, decontamination alone can be written in SQL; tests/llm hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
