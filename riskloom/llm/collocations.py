"""Phrase collocation mining (operator 12): position bitmaps of words, extended depth-first, summed over shards.

Texts (A-Z in lower case) part into pieces at sentence marks and line ends, pieces into words at spaces and tabs. A word of a
language is a symbol. A shard is a run of texts of a task: the different symbols, numbered, and their numbers at consecutive
positions, with an empty position after each piece. Shards are a table in the shared folder, so that texts are read once.

Each symbol of a shard has a compressed bitmap of its positions: the 32-position containers that hold it, with their bits. A
phrase's bitmap has the positions of its last word. A step shifts it by one position, into the next container where need be, and
ANDs it with the bitmaps of all symbols in the same containers; what is left are the bitmaps of the phrases that are a word
longer, their popcounts the shard's counts. Prefixes are taken range by range of symbols, each range to its full depth before
the next. Counts are summed over shards under the 64-bit hashes of the phrase's symbols; the table of words shows whether two
symbols share a hash, and then another seed is taken, so that a hash stands for one word.

A pass over the shards for each length: pairs of frequent words, then phrases whose shorter parts are all frequent. A phrase
that occurs `least` times has only parts that do. The passes know frequent words and phrases by bit tables of fixed size
(WORD_BITS, PHRASE_BITS) that are broadcast; a wrong bit costs work only, since sums over all shards decide.

Nulls: a null text is empty, a null language is `und`. Empty texts have no words; an empty table gives no rows. Repeated rows
count each time. A shard has whole texts, a very long one has a shard of its own (about four times its bytes in memory).
Ties are broken as the contract says: score, count, phrase in byte order. Only lang and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from riskloom.llm.common import UPPER, release, stored, text_batches

LEAST, LONGEST, TOP, SCALE, SHARE = 30, 4, 2000, 2_000_000, 80
#: Bytes of a shard's texts, bytes parted at a time, positions of a container, entries of a range of prefixes.
SHARD, SLICE, BITS, RANGE = 8 << 20, 2 << 20, 32, 1 << 18
#: Bits of the tables of frequent words (2 MB) and phrases (16 MB), and the bits between the places of two words' hashes.
WORD_BITS, PHRASE_BITS, SHIFT = 24, 27, 12
MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Sentence marks and line ends all become a full stop, tabs a space, A-Z become a-z.
PLAIN = bytes.maketrans(MARKS + b"\t" + UPPER.encode(), b"." * len(MARKS) + b" " + UPPER.lower().encode())
UNKNOWN = b"und"
#: Writer options: a row group for each shard. Parquet looks at its buffers after a hundred rows at first, and Spark reads a row group's
#: rows as one batch, so that a task would hold as many shards as its split of the texts gives.
ONE_ROW = {"parquet.block.row.count.limit": "1"}
#: A shard: its symbols with their counts, and their numbers by position (from 1; 0 is no word), as _planes() puts them.
SHARD_ROW = "words array<struct<lang: binary, word: binary, n: bigint>>, stream binary"


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of about SLICE bytes, cut beside a space or full stop."""
    start = 0
    while len(text) - start > SLICE:
        end = max(text.rfind(b" ", start, start + SLICE), text.rfind(b".", start, start + SLICE)) + 1
        if end <= start:
            end = min((x for x in (text.find(b" ", start), text.find(b".", start)) if x >= 0), default=len(text) - 1) + 1
        yield text[start:end]
        start = end
    yield text[start:]


def parted(text: bytes) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of a plain text, one after the other, and whether a token (word or full stop) is a word."""
    b = np.frombuffer(text, np.uint8)
    inside = (b != 32) & (b != 46)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    token = np.flatnonzero(begins | (b == 46))
    is_word = begins[token]
    letters = b[inside]
    offsets = np.empty(int(is_word.sum()) + 1, np.int32)
    offsets[:-1] = np.cumsum(inside, dtype=np.int32)[token[is_word]] - 1
    offsets[-1] = len(letters)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]), is_word


def shard(texts: dict[bytes, list[bytes]]) -> tuple[pa.StructArray, np.ndarray]:
    """(words, stream) of a shard as in SHARD_ROW, from plain texts by language."""
    known, stream, before = [], [], 0
    for lang, own in texts.items():
        parts = [parted(x) for x in _slices(b".".join(own) + b".")]
        coded = pa.chunked_array([w for w, _ in parts], pa.binary()).dictionary_encode().combine_chunks()
        is_word = np.concatenate([x for _, x in parts])
        numbers = np.zeros(len(is_word), np.int32)
        numbers[is_word] = coded.indices.to_numpy(zero_copy_only=False) + 1
        n = np.bincount(numbers, minlength=len(coded.dictionary) + 1)[1:]
        numbers[is_word] += before
        before += len(n)
        known.append(pa.StructArray.from_arrays([pa.repeat(pa.scalar(lang, pa.binary()), len(n)), coded.dictionary, pa.array(n, pa.int64())], names=["lang", "word", "n"]))
        stream.append(numbers)
    return pa.concat_arrays(known), np.concatenate(stream)


def _planes(stream: np.ndarray) -> bytes:
    """First the low bytes of all numbers, last the high ones, which are mostly zeros and so take little room when compressed."""
    return np.ascontiguousarray(stream.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _stream(planes: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """The shards of docs (lang, text), as SHARD_ROW."""
    text_batches(docs)
    schema = to_arrow_schema(StructType.fromDDL(SHARD_ROW))

    def row(texts: dict[bytes, list[bytes]]) -> pa.RecordBatch:
        words, stream = shard(texts)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words).cast(schema.field(0).type), pa.array([_planes(stream)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bytes, list[bytes]] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").cast(pa.binary()), batch.column("text").cast(pa.binary()), strict=True):
                if not (text := text.as_py()):
                    continue
                texts.setdefault(UNKNOWN if (lang := lang.as_py()) is None else lang, []).append(text.translate(PLAIN))
                held += len(text)
                if held >= size:
                    yield row(texts)
                    texts, held = {}, 0
                    release()
        if texts:
            yield row(texts)
        release()

    return docs.select("lang", "text").mapInArrow(run, SHARD_ROW)


class Bitmaps:
    """Compressed bitmaps of a shard's symbols; `words` and `masks` have a row of BITS slots for each container, the rest is by symbol."""

    def __init__(self, stream: np.ndarray) -> None:
        n = -(-len(stream) // BITS)
        wide = np.int64 if stream.max(initial=0) >> 26 else np.int32
        grid = np.zeros(n * BITS, wide)
        grid[: len(stream)] = stream
        grid = np.sort((grid.reshape(n, BITS) << 5) | np.arange(BITS, dtype=wide), axis=1)
        word = grid >> 5
        first = np.ones(word.shape, bool)
        first[:, 1:] = word[:, 1:] != word[:, :-1]
        starts = np.flatnonzero(first)
        mask = np.bitwise_or.reduceat((np.uint32(1) << (grid & 31).astype(np.uint32)).ravel(), starts) if n else np.zeros(0, np.uint32)
        symbol, container = word.ravel()[starts], (starts // BITS).astype(np.int32)
        slot = np.arange(len(starts), dtype=np.int32) - np.flatnonzero(starts % BITS == 0).astype(np.int32)[container]
        del grid, word, first, starts
        real = symbol > 0
        symbol, container, slot, mask = symbol[real], container[real], slot[real], mask[real]
        self.words, self.masks = np.zeros((n, BITS), np.int32), np.zeros((n, BITS), np.uint32)
        self.words[container, slot], self.masks[container, slot] = symbol, mask
        order = np.argsort(symbol, kind="stable")
        self.symbol, self.container, self.mask = symbol[order], container[order], mask[order]

    def step(self, prefix: np.ndarray, container: np.ndarray, mask: np.ndarray, block: int = 1 << 13) -> tuple[np.ndarray, ...]:
        """prefix, next symbol, container, mask of what is left of the prefixes' bitmaps, shifted by one, in each symbol's bitmap."""
        over = np.flatnonzero((mask >> 31 > 0) & (container + 1 < len(self.masks)))
        prefix, container = np.concatenate([prefix, prefix[over]]), np.concatenate([container, container[over] + 1])
        mask = np.concatenate([mask << np.uint32(1), np.ones(len(over), np.uint32)])
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(mask), block):
            c = container[at : at + block]
            both = np.take(self.masks, c, axis=0)
            both &= mask[at : at + block, None]
            hit = np.flatnonzero(both != 0)
            row = hit >> 5
            found.append((prefix[at : at + block][row], self.words[c[row], hit & 31], c[row], both.ravel()[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (prefix, np.zeros(0, np.int32), container, mask)

    def phrases(self, length: int, known: Callable[[list[np.ndarray]], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(symbols, counts) of the phrases of `length` words; symbols has a column a word.

        known(words) says which shorter phrases, given word by word, may be frequent; a phrase with another one in it is not counted.
        """
        if not len(self.symbol):
            return
        ends = [*np.flatnonzero(np.diff(self.symbol)) + 1, len(self.symbol)]
        start = 0
        for i, end in enumerate(ends):
            if end - start >= RANGE or i + 1 == len(ends):
                yield from self._deeper(self.symbol[start:end, None], np.arange(end - start), self.container[start:end], self.mask[start:end], length, known)
                start = end

    def _deeper(self, symbols: np.ndarray, prefix: np.ndarray, container: np.ndarray, mask: np.ndarray, length: int, known: Callable | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As phrases(), for the prefixes in the rows of `symbols`, to which the entries prefix, container, mask belong."""
        now = symbols.shape[1] + 1
        prefix, word, container, mask = self.step(prefix, container, mask)
        if now == 2:  # a prefix is an entry so far; by symbol it is one for all its containers
            prefix, symbols = symbols[prefix, 0], np.arange(int(self.symbol[-1]) + 1, dtype=np.int32)[:, None]
        if known is not None and len(word):  # the phrase itself, or what is left of it without its first word
            keep = known([*(symbols[prefix, i] for i in range(int(now == length), now - 1)), word])
            prefix, word, container, mask = prefix[keep], word[keep], container[keep], mask[keep]
        if not len(word):
            return
        width = int(word.max()) + 1
        key = prefix.astype(np.int64) * width + word
        order = np.argsort(key)
        key = key[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        longer = np.column_stack([symbols[key[starts] // width], key[starts] % width]).astype(np.int32)
        if now == length:
            yield longer, np.add.reduceat(np.bitwise_count(mask[order]), starts, dtype=np.int64)
        else:
            number = np.repeat(np.arange(len(starts)), np.diff([*starts, len(key)]))
            yield from self._deeper(longer, number, container[order], mask[order], length, known)


def bit_table(slots: DataFrame, bits: int) -> bytes:
    """A table of 2^bits bits with a one at each slot (column slot): at most 2^(bits - 6) rows reach the driver, whatever the input."""
    rows = slots.select(F.expr("shiftright(slot, 6)").alias("at"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << max(bits - 6, 0), np.int64)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return table.tobytes()


def _slot(phrase: str) -> Column:
    """The slot of a phrase (array of hashes) in the table of phrases: each hash gives other bits at another place."""
    return F.expr(f"aggregate(transform({phrase}, (h, i) -> shiftrightunsigned(h, {SHIFT} * i)), 0L, (a, x) -> a ^ x) & {(1 << PHRASE_BITS) - 1}L").alias("slot")


def _holds(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def _phrase_counts(hashed: DataFrame, words: bytes, phrases: bytes | None, length: int) -> DataFrame:
    """h1 to h<length>, n of each shard's phrases of so many words.

    hashed: h (array, the hashes of a shard's symbols), stream; words, phrases: bit tables of what may be frequent.
    """
    context = hashed.sparkSession.sparkContext
    words_b, phrases_b = context.broadcast(words), context.broadcast(phrases)
    ddl = ", ".join(f"h{i + 1} bigint" for i in range(length)) + ", n bigint"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def counts(h: np.ndarray, stream: np.ndarray) -> Iterator[list]:
        often = _holds(np.frombuffer(words_b.value, np.int64), h & ((1 << WORD_BITS) - 1))
        often[0] = False
        stream = np.where(often[stream], stream, 0)
        known = None
        if phrases_b.value is not None:
            table = np.frombuffer(phrases_b.value, np.int64)
            bits = [(h.view(np.uint64) >> np.uint64(SHIFT * i)).astype(np.int64) & ((1 << PHRASE_BITS) - 1) for i in range(length - 1)]
            known = lambda symbols: _holds(table, reduce(np.bitwise_xor, (b[x] for b, x in zip(bits, symbols, strict=False))))
        for symbols, n in Bitmaps(stream).phrases(length, known):
            yield [*(pa.array(h[symbols[:, i]]) for i in range(length)), pa.array(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, stream in zip(batch.column("h"), batch.column("stream"), strict=True):
                for columns in counts(np.concatenate([np.zeros(1, np.int64), h.values.to_numpy()]), _stream(stream.as_buffer())):
                    whole = pa.RecordBatch.from_arrays(columns, schema=schema)
                    yield from (whole.slice(at, 1 << 14) for at in range(0, whole.num_rows, 1 << 14))
                    del columns, whole
                release()

    return hashed.mapInArrow(run, ddl)


def _summed(each: DataFrame, length: int, least: int) -> DataFrame:
    """p (hashes of the words), a of the phrases that occur `least` times in all shards together."""
    names = [f"h{i + 1}" for i in range(length)]
    # a shard's phrases are summed already: another map of them before the shuffle would hold much and merge little
    return each.repartition(*names).groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= least).select(F.array(*names).alias("p"), "a")


@contextmanager
def _few_rows(spark: SparkSession, rows: int = 1) -> Iterator[None]:
    """Arrow batches of so many rows while an action runs: a shard is a row of many megabytes."""
    before = spark.conf.get(name := "spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(words, counts): h, lang, word, n of all words; p (array of hashes), a of all phrases of 1 to `longest` words that occur `least`
    times within pieces. Both stored."""
    table = stored(shards(docs), "shards", compression="zstd", **ONE_ROW)
    total = stored(table.select(F.explode("words").alias("w")).groupBy("w.lang", "w.word").agg(F.sum("w.n").alias("n")), "symbols")
    seed = 0
    while True:
        words = total.select(F.xxhash64(F.lit(seed), "lang", "word").alias("h"), F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word"), "n")
        if words.groupBy("h").count().where("count > 1").isEmpty():
            break
        seed += 1  # two words with one hash: all hashes anew
    hashed = table.select(F.transform("words", lambda w: F.xxhash64(F.lit(seed), w["lang"], w["word"])).alias("h"), "stream")
    often = words.where(F.col("n") >= least)
    known = bit_table(often.select((F.col("h").bitwiseAND(F.lit((1 << WORD_BITS) - 1))).alias("slot")), WORD_BITS)
    counts = often.select(F.array("h").alias("p"), F.col("n").alias("a"))
    shorter = None
    for length in range(2, longest + 1):
        held = None if shorter is None else bit_table(shorter.select(_slot("p")), PHRASE_BITS)
        with _few_rows(docs.sparkSession):
            found = stored(_summed(_phrase_counts(hashed, known, held, length), length, least), "phrases")
        shorter = found if shorter is None else shorter.unionAll(found)
        counts = counts.unionAll(found)
    return words, stored(counts, "counts")


def scored(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """p, a, l, r, score of the candidates that no longer one absorbs; counts: what phrase_counts() gives."""
    long = counts.where(F.size("p") > 1)
    cuts = long.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.expr("slice(p, 1, k)").alias("left"), F.expr("slice(p, k + 1, size(p))").alias("right"))
    cuts = cuts.join(counts.select(F.col("p").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("p").alias("right"), F.col("a").alias("r")), "right")
    exact = F.expr(f"cast((cast(a as decimal(19,0)) * cast({SCALE} as decimal(8,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    best = cuts.groupBy("p", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("m"))
    inner = counts.where(F.size("p") > 2).select("p", F.col("a").alias("whole")).select("whole", F.explode(F.expr("flatten(transform(sequence(2, size(p) - 1), n -> transform(sequence(1, size(p) - n + 1), i -> slice(p, i, n))))")).alias("p"))
    over = inner.groupBy("p").agg(F.max("whole").alias("whole"))
    absorbed = F.expr(f"100 * cast(whole as decimal(19,0)) >= {share} * cast(a as decimal(19,0))")
    return best.join(over, "p", "left").where(F.col("whole").isNull() | ~absorbed).select("p", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases."""
    words, counts = phrase_counts(docs, least, longest)
    rows = scored(counts).join(words.select("h", "lang"), F.col("p")[0] == F.col("h")).drop("h")
    # the best of each of 64 parts of a language, ties with the last one too, then the best of all
    part = W.partitionBy("lang", F.pmod(F.xxhash64("p"), F.lit(64))).orderBy(F.desc("score"), F.desc("a"))
    rows = stored(rows.withColumn("place", F.rank().over(part)).where(F.col("place") <= top).drop("place"), "best")
    spelt = rows.select("p", F.posexplode("p").alias("i", "h")).join(words.select("h", "word"), "h")
    spelt = spelt.groupBy("p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.join(spelt, "p").withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT lang, piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece_id,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), starts AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces WHERE len(w) > 0),
totals AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
counts AS (
  SELECT lang, p, count(*) AS a FROM (SELECT lang, w[i:i + k - 1] AS p, k, len(w) AS n, i FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k)) WHERE i + k - 1 <= n GROUP BY lang, p HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.p, c.a, k, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM counts WHERE len(p) > 1) c
  JOIN counts l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN counts r ON r.lang = c.lang AND r.p = c.p[k + 1:]
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, p[i:i + m - 1] AS p, a FROM (SELECT lang, p, a, m, unnest(generate_series(1, len(p) - m + 1)) AS i FROM (SELECT lang, p, a, unnest(generate_series(2, len(p) - 1)) AS m FROM counts WHERE len(p) > 2))
), over_phrases AS (SELECT lang, p, max(a) AS whole FROM inner_phrases GROUP BY lang, p)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, array_to_string(b.p, ' ')) AS rank, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, t.n, b.score
FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN over_phrases o ON o.lang = b.lang AND o.p = b.p
WHERE o.whole IS NULL OR 100 * o.whole::HUGEINT < 80 * b.a::HUGEINT
QUALIFY rank <= 2000
"""
