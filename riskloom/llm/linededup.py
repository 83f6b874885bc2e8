"""Line dedup (operator 10), native: fuzzy lines by MinHash over character shingles.

1. Lines become sketches where they are read. A shingle is 8 consecutive characters. Every shingle of a line is hashed, and
   the sketch has the least hash under each of 24 orders: order c puts the hash x at place x xor c, with 24 fixed c, so that
   the least hashes of two lines are one shingle's with probability equal to their resemblance. Minima are partial
   aggregates in generated code, over a row for eight shingles; equal lines meet in one sketch. Minima have 32 bits, bands
   48, so that less is shuffled: a band is made of four minima, and what meets by chance is compared like any candidate.
2. A sketch is a grid of 4 rows and 6 columns. Its bands are the columns and the two diagonals from the head of each column,
   18 bands of 4 minima. Lines that share a band are candidates: each bucket links its members to its least one.
   Of short lines (SHORT characters at most) minima pick the same few shingles again and would lose links. They have prefix
   keys beside the bands: of n shingles, in one order for all lines, the first n - ceil(0.8 n) + 1. Two short lines at 0.8 or more
   share one of these for certain. The order is by the number of short lines that have a shingle, rare ones first.
3. Candidates are held against each other with the exact Jaccard similarity of all their shingles.
4. Verified links become components by distributed union-find. Where a bucket's members are still in several components,
   all its pairs across components are tried, in blocks, but for those whose parities prove them to be under the
   threshold (common.linked). Every component keeps its first line.

Lines are what "\\n" parts. Blank lines (white space only) are never duplicates. Lines shorter than a shingle are one
shingle. Equal lines are one node, known by a 64-bit hash of the line. The first line of a component is that of the least
key (doc_id unless another column is named; a null is last), of those the one that stands first in its text; rows with one
key come in the order in which they are read. Null texts have no lines and stay null; an empty text has one blank line; very
long lines are sketched and compared whole; repeated rows are repeated lines; an empty table gives no rows. All columns
of the table are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import LONGS, across, crowded, likely, linked, small, stored

SHINGLE, ROWS, COLUMNS, THRESHOLD = 8, 4, 6, 0.8
#: Steps to the right from row to row of the grid: columns, diagonals, and diagonals the other way.
DIAGONALS = (0, 1, 5)
#: White space that a blank line may have.
SPACE = " \t\r\f\v "
#: Characters of a short line: bands lose more than one link in 300 under 46 shingles, whose partners at 0.8 have 56 at most.
SHORT = 56 + SHINGLE - 1
#: Shingles hashed in one row, characters of a piece of a long line.
TOGETHER, PIECE = 8, 4096
#: Bits of a band; of a prefix key's number of lines (more count as the largest) and of its shingle.
BAND, MANY, KEY = 48, 20, 43


def lines_of(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named, line_no and line of every line of docs (text) that is not blank; line_no from 0.

    Here and below arrays go to the outer kind of explode: for the other one Spark adds a filter on their size, which makes
    the array twice. None of them is empty; the null that a null text gives is no line.
    """
    return docs.select(*keep, F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")).where(F.trim(F.col("line"), F.lit(SPACE)) != "")


def _order(row: int, column: int) -> str:
    """The constant of an order: rows lie in different quarters of the hashes, so that they rarely pick one shingle twice."""
    place = (row << 62) + (column << 62) // COLUMNS + ((row * COLUMNS + column + 1) * 0x9E3779B97F4A7C15 & (1 << 58) - 1) >> 32
    return f"int({place - (1 << 32) if place >> 31 else place})"


def _band(*parts: Column) -> Column:
    """A band's number."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << BAND) - 1))


def sketches(lines: DataFrame) -> DataFrame:
    """h, bands of every different line of lines (line).

    Four bytes a character let any shingle be reached at once. A piece of a long line overlaps the next one by a shingle less a character.
    """
    wide = lines.select(F.xxhash64("line").alias("h"), F.coalesce(F.encode("line", "UTF-32"), F.lit(b"")).alias("wide"))
    cut = f"transform(sequence(0, octet_length(wide) div 4 - 1, {PIECE}), k -> substring(wide, 4 * k + 1, {4 * (PIECE + SHINGLE - 1)}))"
    pieces = wide.select("h", F.explode_outer(F.expr(f"if(octet_length(wide) <= {4 * PIECE}, array(wide), {cut})")).alias("b"))
    starts = pieces.select("h", "b", F.explode_outer(F.expr(f"sequence(0, greatest(octet_length(b) div 4 - {SHINGLE}, 0), {TOGETHER})")).alias("i"))
    first = f"hash(substring(b, 4 * i + 1, {4 * SHINGLE}))"
    each = [F.expr(f"if(octet_length(b) >= 4 * i + {4 * (j + SHINGLE)}, hash(substring(b, 4 * i + {4 * j + 1}, {4 * SHINGLE})), {first})" if j else first).alias(f"x{j}") for j in range(TOGETHER)]
    least = lambda c: F.expr(f"least({', '.join(f'x{j} ^ {c}' for j in range(TOGETHER))})")
    minima = starts.select("h", *each).groupBy("h").agg(*(F.min(least(_order(r, c))).alias(f"m{r}_{c}") for r in range(ROWS) for c in range(COLUMNS)))
    bands = [_band(F.lit(s * COLUMNS + c), *(f"m{r}_{(c + r * s) % COLUMNS}" for r in range(ROWS))) for s in DIAGONALS for c in range(COLUMNS)]
    return minima.select("h", F.array(*bands).alias("bands"))


def hashes(line: str) -> str:
    """SQL for the hashes of a line's shingles, each once; a line shorter than a shingle is one.

    array_distinct stands outside of the lambda, where code is generated for it, if this is a column of a select.
    """
    every = f"transform(sequence(1, octet_length(w) - {4 * SHINGLE - 1}, 4), i -> xxhash64(substring(w, i, {4 * SHINGLE})))"
    return f"array_distinct(transform(array(encode({line}, 'UTF-32')), w -> if(octet_length(w) < {4 * SHINGLE}, array(xxhash64(w)), {every}))[0])"


def parities(texts: DataFrame) -> DataFrame:
    """node, bits (for common.possible) of lines h, line, each once: how many shingles, and 64 LONGS parities."""
    one = texts.select("h", F.expr(hashes("line")).alias("s")).select("h", F.explode_outer("s").alias("x"))
    one = one.select("h", F.expr(f"shiftright(x, 6) & {LONGS - 1}").alias("place"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit"))
    longs = [F.bit_xor(F.expr(f"if(place = {k}, bit, 0L)")).alias(f"b{k}") for k in range(LONGS)]
    return one.groupBy("h").agg(F.count("*").alias("n"), *longs).select(F.col("h").alias("node"), F.array("n", *(f"b{k}" for k in range(LONGS))).alias("bits"))


def prefixes(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, band: the prefix keys of the different lines of lines (h, short) that are short; a shingle of one line alone is no key.

    A shingle's key is one number, by which keys are in order: the number of its lines, then a part of its hash. Shingles of one
    number are one key, for all lines alike, so that lines that share a shingle still share one of their first keys.
    """
    short = stored(lines.where("short is not null").select("h", "short").dropDuplicates(["h"]), "lines-short")
    each = short.select("h", F.expr(hashes("short")).alias("s")).select("h", F.explode_outer("s").alias("x"))
    key = F.expr(f"shiftleft(least(n, {(1 << MANY) - 1}), {KEY}) | (x & {(1 << KEY) - 1})")
    counts = each.groupBy("x").agg(F.count("*").alias("n")).hint("merge")  # Spark knows the size of the lines only, and would broadcast all their shingles
    ranked = each.join(counts, "x").groupBy("h").agg(F.sort_array(F.collect_list(key)).alias("s"))  # a short line has SHORT of them at most
    firsts = F.expr(f"slice(s, 1, size(s) - cast(ceil({threshold!r}D * size(s) - 1e-9D) as int) + 1)")
    return ranked.select(F.col("h").alias("node"), F.explode_outer(firsts).alias("k")).where(f"k >= {2 << KEY}").select("node", _band(F.lit(-1), F.col("k")).alias("band")).distinct()


def verified(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs (of line hashes) whose shingles have that Jaccard similarity; texts: h, line."""
    both = pairs.join(texts.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b").join(texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a")
    # a step for each select, so that hashes are made once and sets meet in generated code
    sets = both.select("a", "b", F.expr(hashes("line_a")).alias("x"), F.expr(hashes("line_b")).alias("y"))
    sizes = sets.select("a", "b", F.array(F.struct(F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))).alias("q"))
    return sizes.select("a", "b", F.explode_outer("q").alias("q")).where(F.col("q.i") / (F.col("q.n") - F.col("q.i")) >= threshold).select("a", "b")


def link(docs: DataFrame, lines: DataFrame, sketched: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, root of the line hashes that a verified link joins; lines: h, short; sketched: h, bands."""
    # the zeros of a band then stand beside those of the next row, which packs better
    members = sketched.select(F.col("h").alias("node"), F.explode_outer("bands").alias("band"))
    crowd = crowded(members.unionByName(prefixes(lines, threshold)), "lines")
    wanted = crowd.select(F.col("node").alias("h")).distinct()
    texts = stored(lines_of(docs).select(F.xxhash64("line").alias("h"), "line").join(small(wanted), "h", "left_semi").dropDuplicates(["h"]), "lines")
    bits = stored(parities(texts), "lines-bits")
    verify = lambda pairs: verified(texts, likely(pairs, bits, threshold), threshold)
    settle = lambda rows: verified(texts, across(rows, bits, threshold), threshold)
    return linked(crowd, verify, settle, "lines")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(lines, of): uid, key, line_no, h, short (the line, if it is) of every line of docs (uid, key, text), stored; and, of each h whose component has
    several lines, h, first_uid, first_key, first_line (the line that the component keeps); stored. Other passes over docs
    read texts only, so that uids need to stay the same in this one alone."""
    lines = stored(lines_of(docs, "uid", "key").select("uid", "key", "line_no", F.xxhash64("line").alias("h"), F.when(F.length("line") <= SHORT, F.col("line")).alias("short")), "lines-read")
    roots = link(docs, lines, sketches(lines_of(docs)), threshold)
    own = lines.groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("low"))
    heads = own.join(small(roots), own["h"] == roots["node"], "left").where("n > 1 or root is not null").select("h", "n", "low", F.coalesce("root", "h").alias("root"))
    heads = stored(heads, "lines-heads")  # lines that stand once and have no link are left out
    several = heads.groupBy("root").agg(F.sum("n").alias("n"), F.min("low").alias("low")).where("n > 1").select("root", "low")
    known = stored(heads.select("h", "root").join(several, "root"), "lines-known")
    first = lines.join(small(known), "h").where("key <=> low").groupBy("root").agg(F.min(F.struct("line_no", "uid")).alias("f"))
    return lines, stored(known.join(first, "root").select("h", F.col("f.uid").alias("first_uid"), F.col("low").alias("first_key"), F.col("f.line_no").alias("first_line")), "lines-first")


def with_uid(docs: DataFrame) -> DataFrame:
    """doc (all columns as one struct), uid; stored, so that a row's uid stays the same. Scans read the fields of doc that they need."""
    return stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("uid")), "rows")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """The rows of docs, in their columns, without the lines that repeat an earlier one; n_chars, if there, is counted anew."""
    names = docs.columns
    rows = with_uid(docs)
    lines, of = classes(rows.select("uid", F.col("doc")[key].alias("key"), F.col("doc.text").alias("text")), threshold)
    later = lines.join(small(of), "h").where("uid <> first_uid or line_no <> first_line")
    drop = stored(later.groupBy("uid").agg(F.collect_set("line_no").alias("gone")), "lines-gone")
    joined = rows.join(small(drop), "uid", "left").withColumn("whole", F.col("doc.text"))
    kept = F.expr("if(gone is null, whole, array_join(filter(split(whole, '\\n'), (x, i) -> not array_contains(gone, i)), '\\n'))")
    out = joined.select("doc", kept.alias("kept"))
    count = F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None
    return out.select(*(F.col("kept").alias(n) if n == "text" else F.when(F.col("kept").eqNullSafe(F.col("doc")["text"]), F.col("doc")[n]).otherwise(count).alias(n) if n == "n_chars" else F.col("doc")[n].alias(n) for n in names))


def line_classes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, line_no, class_doc, class_line (where the kept line of the component stands), kept: a row for every line that is not blank."""
    lines, of = classes(docs.select(F.col(key).alias("key"), "text", F.monotonically_increasing_id().alias("uid")))
    alone = F.col("first_line").isNull()
    first = lambda name, own: F.when(alone, F.col(own)).otherwise(F.col(name))
    kept = alone | ((F.col("uid") == F.col("first_uid")) & (F.col("line_no") == F.col("first_line")))
    return lines.join(small(of), "h", "left").select(F.col("key").alias("doc_id"), "line_no", first("first_key", "key").alias("class_doc"), first("first_line", "line_no").alias("class_line"), kept.alias("kept"))
