"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskloom.operators.storage import stored
from riskloom.session import importable

#: Fixed pattern: a word is a run of characters outside these ASCII ranges, after A-Z became a-z.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words over UTF-8 bytes: every byte of a non-ASCII character is 0x80 or more.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8; bytes.lower() changes A-Z only."""
    return WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def sql_words(text: Column) -> Column:
    """The words of a text as a JVM-side array; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(WORD_CLASS), F.lit(0))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Rows up to which a set of ids, or a side that stems from a test set, is broadcast (about 20 MB).
BROADCAST = 300_000


def small(df: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Rows of an Arrow batch; texts are long, and a batch is held by the JVM and by Python at once.
BATCH = "1000"


def text_batches(df: DataFrame) -> None:
    """Lets Python workers import the package, and gets them batches of BATCH rows unless the session says how many."""
    importable(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":  # Spark's default
        conf.set(name, BATCH)


def release() -> None:
    """Gives a worker's free memory back to the system, as workers wait for their next task beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], rows: int = 512) -> DataFrame:
    """Runs a function over Arrow batches of the columns named.

    make() is called once a task and returns the function, which maps {column: list} to {column: list}.
    Batches are cut to `rows` rows, so that a worker holds few texts at a time.
    """
    text_batches(df)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = step({name: part.column(name).to_pylist() for name in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        release()

    return df.select(*columns).mapInArrow(run, schema)


def passed(rows: DataFrame, text: str, make: Callable[[], Callable[[str | None], bool]], some: int = 512) -> DataFrame:
    """The rows whose text passes a test, with their columns as they are; make() is called once a task and returns the test.

    Only the text goes to Python, which sees `some` of a batch's texts at a time; the rows stay with the JVM.
    """
    text_batches(rows)

    @F.arrow_udf("boolean")
    def passes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        test = make()
        for batch in texts:
            yield pa.array([test(t) for at in range(0, len(batch), some) for t in batch.slice(at, some).to_pylist()], pa.bool_())
        release()

    return rows.where(passes(text))


def by_size(texts: list[str | None], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of consecutive texts of about `most` characters together; a null is an empty text."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def byte_symbols() -> dict[int, str]:
    """The printable character for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Links up to which one task takes a round of components() by itself (some MB); more are shuffled.
FEW = 300_000


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node long, root long), root the least node.

    Alternating large-star and small-star steps: each round relinks neighbours to the least node of a
    neighbourhood. It goes on until every node hangs on one root and no root hangs on another, after a number of rounds
    logarithmic in the diameter. Every round is a table in the shared folder. A node with many neighbours costs partial
    minima only, never a list in one task. FEW links or less are one partition, so that a round needs no shuffle.
    Self links are ignored; no edges give no rows.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-links")
    few = e.count() <= FEW
    while True:
        e = e.coalesce(1) if few else e
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionAll(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        loose = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or (ups = 1 and low = 0)")
        if loose.isEmpty():
            break
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{name}-links")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Members of a block; the members of a bucket meet in blocks, so that no task has a large bucket alone.
BLOCK = 2048


#: Longs of parities that the bits of a set have.
LONGS = 16


def possible(threshold: float, a: str = "a", b: str = "b", longs: int = LONGS) -> Column:
    """Whether the bits of two sets leave a similarity of the threshold possible; it never passes over a pair that has it.

    Bits: the size of a set (column a0, b0), then `longs` longs of parities (a1, b1 and so on), bit i of which counts the
    elements hashed to place i. Places with unequal parity have an element that only one set has, so that the sets differ
    in as many elements at least, and in as many as their sizes differ. Two sets of n elements together with similarity t
    differ in n (1 - t) / (1 + t).
    """
    places = " + ".join(f"bit_count({a}{k} ^ {b}{k})" for k in range(1, longs + 1))
    most = f"{(1 - threshold) / (1 + threshold)!r}D * ({a}0 + {b}0) + 1e-6D"
    return F.expr(f"abs({a}0 - {b}0) <= {most} and {places} <= {most}")


def _long(k: int) -> Column:
    """A long of bits, never null: the test of a pair is then short enough that the JVM compiles the method it stands in (8,000 bytes)."""
    return F.coalesce(F.col("bits")[k], F.lit(0).cast("bigint"))


def likely(pairs: DataFrame, bits: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b that possible() does not rule out; bits: node, bits."""
    side = lambda n: bits.select(F.col("node").alias(n), *(_long(k).alias(f"{n}{k}") for k in range(LONGS + 1)))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(possible(threshold)).select("a", "b")


def crowded(members: DataFrame, name: str) -> DataFrame:
    """band, node, low (the least node of the bucket) of the members (band, node; each once) of buckets with several nodes; stored.

    Members are dealt by band once, for the least nodes and for the join with them; a large bucket streams through its task.
    """
    members = members.repartition("band")
    buckets = members.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band", "low")
    return stored(members.join(buckets.hint("shuffle_hash"), "band").select("band", "node", "low"), f"{name}-buckets")


def across(rows: DataFrame, bits: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b of a bucket's members across components that possible() does not rule out, each once.

    rows: what linked() hands to settle; bits: node, bits. The members outside the largest component meet every member, in
    blocks that are dealt over the tasks. The join passes on only what its condition leaves: a pair of several buckets in the
    least of them, and no pair with the least member of a bucket, which was tried before.
    """
    own = rows.groupBy("node").agg(F.collect_list("band").alias("bands"))  # a node has as many bands as a signature at most
    rows = rows.where("node <> low").join(own.join(bits, "node"), "node")
    i, j = (F.ceil(F.col(c) / BLOCK) for c in ("n_rest", "n"))
    longs = lambda name: [_long(k).alias(f"{name}{k}") for k in range(LONGS + 1)]
    rest = rows.where("root <> main").select("band", "main", "node", "root", *longs("a"), "bands", F.pmod(F.xxhash64("node", F.lit("i")), i).alias("i"), F.explode(F.sequence(F.lit(0), j - 1)).alias("j"))
    every = rows.select("band", F.col("node").alias("head"), F.col("root").alias("other"), *longs("b"), F.col("bands").alias("head_bands"), F.pmod(F.xxhash64("node", F.lit("j")), j).alias("j"), F.explode(F.sequence(F.lit(0), i - 1)).alias("i"))
    apart = (F.col("root") != F.col("other")) & ((F.col("other") == F.col("main")) | (F.col("node") < F.col("head")))
    once = F.array_min(F.array_intersect("bands", "head_bands")) == F.col("band")
    # Spark doesn't know how often blocks go out, and would broadcast them
    pairs = rest.join(every.hint("merge"), ["band", "i", "j"]).where(apart & possible(threshold) & once)
    return pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))


#: Pairs for each member of open buckets up to which they are all compared at once; beyond that another centre is tried before.
PAIRS = 64


def linked(crowd: DataFrame, verify: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame], DataFrame], name: str, centres: int = 1) -> DataFrame:
    """node, root of the components of all verified links between nodes that share a band.

    crowd: what crowded() gives; verify: from pairs (a, b) to those that are links; settle: from the members of open buckets
    to links (a, b), at least one between any two components that a link within a bucket joins. Its rows have band, node,
    low, root, n (members of the bucket), n_rest (those outside its largest component), main (the root of that).
    First every bucket links its members to its least one (low): as many pairs as members. Then, where a bucket still holds
    several components, settle() compares all its members across components, whatever the size of the bucket. If those are
    many pairs, up to `centres` rounds go before it that link members to a centre drawn by hash; they change the work only,
    not the result: each pair that shares a band was tried, lies in one component or is proven to be no link.
    """
    edges = stored(verify(crowd.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()), f"{name}-edges")
    for turn in range(centres + 1):
        joined = components(edges, name)
        rows = crowd.join(joined, "node", "left").select("band", "node", "low", F.coalesce("root", "node").alias("root"))
        kinds = rows.groupBy("band", "root").agg(F.count("*").alias("k"))
        counts = kinds.groupBy("band").agg(F.count("*").alias("kinds"), F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("m")).where("kinds > 1 and n > 2").select("band", "n", (F.col("n") - F.col("m.k")).alias("n_rest"), F.col("m.root").alias("main"))
        rows = stored(rows.join(counts, "band"), f"{name}-open")
        members, pairs = rows.agg(F.count("*"), F.sum(F.col("n_rest").cast("double"))).first()
        if not members:
            return joined
        if turn < centres and pairs > PAIRS * members:
            order = F.xxhash64("node", F.lit(turn))
            middle = rows.groupBy("band").agg(F.min(F.struct(order.alias("o"), "node", "root")).alias("m")).select("band", F.col("m.node").alias("head"), F.col("m.root").alias("other"))
            found = verify(rows.join(middle, "band").where("root <> other").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct())
        else:
            found = settle(rows)
        edges = edges.unionAll(stored(found, f"{name}-edges"))
        if turn == centres or pairs <= PAIRS * members:
            return components(edges, name)
