import random
import re

from pyspark.sql import functions as F

from riskloom.llm.common import LONGS, across
from riskloom.llm.linededup import deduplicated, line_classes, prefixes, sketches, verified


def sh(line, k=8):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def brute(texts):
    """(doc position, line number) of each line: the first of its component."""
    lines = [(d, n, x) for d, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n")) if x.strip()]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [sh(x) for _, _, x in lines]
    for i in range(len(lines)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter / (len(sets[i]) + len(sets[j]) - inter) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {lines[i][:2]: lines[find(i)][:2] for i in range(len(lines))}


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdehilnoprstuxü") for _ in range(rng.randint(2, 8)))
    base = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts = []
    for _ in range(80):
        lines = [rng.choice(base) for _ in range(rng.randint(1, 5))]
        for i, x in enumerate(lines):
            if rng.random() < 0.5 and len(x) > 20:
                at = rng.randrange(len(x) - 1)
                lines[i] = x[:at] + rng.choice("abcxyz") + x[at + rng.randint(0, 2) :]
        texts.append("\n".join(lines))
    return [*texts, None, "", "\n\n  \n", "short", "short", "a" * 30000, "a" * 30000 + "b"]


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "u") for i, t in enumerate(texts)], "doc_id long, text string, uid string").repartition(5)
    want = brute(texts)
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in line_classes(docs).collect()}
    assert got.keys() == want.keys()
    wrong = [k for k in want if got[k] != want[k]]
    assert wrong == []


def test_the_least_document_keeps_the_line_wherever_it_is_read(spark, tmp_path):
    """Spark reads large files first; the line that stays is still the one of document 1."""
    long = "\n".join(f"line {i} of the second document with words of its own {i * 7919}" for i in range(4000))
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string").coalesce(1)
    rows((1, "one and the same line of text")).write.parquet(f"{tmp_path}/d/part=1")
    rows((2, long + "\none and the same line of text"), (3, None), (0, "")).write.parquet(f"{tmp_path}/d/part=2")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = {(r.class_doc, r.class_line, r.kept) for r in line_classes(docs).where("doc_id = 1 or (doc_id = 2 and line_no = 4000)").collect()}
    assert got == {(1, 0, True), (1, 0, False)}
    assert {r.doc_id: r.text for r in deduplicated(docs).where("doc_id <> 2").collect()} == {0: "", 1: "one and the same line of text", 3: None}


def test_ties_and_null_keys(spark):
    docs = spark.createDataFrame([(None, "a line of some length"), (7, "x y\na line of some length"), (7, "x y\na line of some length")], "doc_id long, text string").coalesce(1)
    got = sorted((str(r.doc_id), r.line_no, r.class_doc, r.class_line, r.kept) for r in line_classes(docs).collect())
    assert got == [("7", 0, 7, 0, False), ("7", 0, 7, 0, True), ("7", 1, 7, 1, False), ("7", 1, 7, 1, True), ("None", 0, 7, 1, False)]


def test_deduplicated_keeps_rows_and_columns(spark):
    rows = [(1, "x y z one two\nkeep me here\n", "n", 5), (2, "x y z one two\nother line of words", "m", 6), (2, None, None, None), (3, "\n", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string, n_chars long").coalesce(1)
    got = sorted((tuple(r) for r in deduplicated(docs).collect()), key=str)
    assert got == sorted([(1, "x y z one two\nkeep me here\n", "n", 5), (2, "other line of words", "m", 19), (2, None, None, None), (3, "\n", "b", 1)], key=str)
    assert deduplicated(docs.limit(0)).count() == 0


WORDS = {
    "en": "the river market between morning people carry their old bread along every narrow street before winter comes again".split(),
    "fr": "la rivière marché entre matin les gens portent leur vieux pain dans toutes rues étroites avant que revienne".split(),
    "es": "el río mercado entre mañana la gente lleva su viejo pan en todas calles estrechas antes de que vuelva".split(),
    "de": "der Fluss Markt zwischen Morgen die Leute tragen ihr altes Brot durch alle engen Gassen bevor Winter wieder".split(),
    "bare": "tab set dog bed fog ear sea tin fin net rat gate stone rest latin".split(),
}


def near_copies(words, rng, n=120):
    """Pairs of lines of 97 to 200 characters, one with words replaced, of exact similarity 0.8 at least."""
    out = []
    while len(out) < n:
        made = lambda: rng.choice(words)[:: rng.choice((1, -1))] + rng.choice(words)[:3]
        a = [made() for _ in range(rng.randint(12, 20))]
        b = list(a)
        b[rng.randrange(len(b))] = made()
        x, y = " ".join(a), " ".join(b)
        i, u = len(sh(x) & sh(y)), len(sh(x) | sh(y))
        if 97 <= len(x) <= 200 and x != y and i / u >= 0.8:
            out.append((x, y))
    return out


def test_long_near_copies_are_found_in_every_language(spark):
    rng = random.Random(7)
    pairs = [(kind, p) for kind, words in WORDS.items() for p in near_copies(words, rng)]
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, (_, p) in enumerate(pairs)], "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in line_classes(docs).collect()}
    for kind in WORDS:
        own = [i for i, (k, _) in enumerate(pairs) if k == kind]
        assert sum(got[i, 0] == got[i, 1] for i in own) >= 0.98 * len(own), kind


def near_pair(rng, length, least, most):
    """Two lines of about so many characters whose similarity lies between least and most."""
    letters = "abcdefghijklmnopqrstuvwxyz 0123456789"
    while True:
        a = "".join(rng.choice(letters) for _ in range(length)).strip()
        b = list(a)
        for _ in range(rng.randint(1, 1 + length // 60)):
            at = rng.choice([0, len(b) - 1, rng.randrange(len(b))])
            b[at : at + rng.randint(0, 1)] = rng.choice(letters)
        b = "".join(b).strip()
        x, y = sh(a), sh(b)
        if a != b and least <= len(x & y) / len(x | y) <= most:
            return a, b


def test_short_lines_lose_no_link(spark):
    """Pairs at 0.8 to 0.88 by length of line; those of fewer than 46 shingles are found for certain."""
    rng = random.Random(11)
    lost = {}
    for length in (16, 20, 26, 40, 90, 200):
        pairs = [near_pair(rng, length, 0.8, 0.88 if length < 30 else 0.85) for _ in range(300)]
        docs = spark.createDataFrame([(2 * i + k, line) for i, p in enumerate(pairs) for k, line in enumerate(p)], "doc_id long, text string")
        kept = {r.doc_id: r.class_doc for r in line_classes(docs).collect()}
        lost[length] = sum(kept[2 * i] != kept[2 * i + 1] for i in range(len(pairs)))
    assert all(n == 0 for length, n in lost.items() if length <= 40), lost
    assert lost[90] <= 3 and lost[200] <= 3, lost


def test_numbered_short_lines_against_brute_force(spark):
    """Many lines that share most of their shingles: the frequent ones come last among the keys."""
    rng = random.Random(12)
    texts = ["\n".join(f"{rng.choice(['Item number', 'Line no.', 'of the other'])} {rng.randint(0, 99999)}{rng.choice(['', ' a', '.'])}" for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in line_classes(docs).collect()}
    assert got == brute(texts)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_is_shuffled_is_narrow(spark):
    """Minima are ints, bands and prefix keys have 48 bits; equal lines have equal bands, and near short lines share a key."""
    lines = spark.createDataFrame([("a line of some length, and more of it",), ("a line of some length, and more of it",), ("short line no. 1",), ("short line no. 12",)], "line string").coalesce(1)
    made = sketches(lines)
    assert len(set(re.findall(r"\bmin#\d+", planned(made)))) >= 24 and not re.search(r"\bmin#\d+L", planned(made))
    bands = {r.h: r.bands for r in made.collect()}
    assert len(bands) == 3 and all(0 <= b < 1 << 48 for x in bands.values() for b in x)
    keys = prefixes(lines.select(F.xxhash64("line").alias("h"), F.col("line").alias("short"))).collect()
    assert keys and all(0 <= r.band < 1 << 48 for r in keys)
    assert len(keys) == len(set(keys)) and max(sum(r.band == k.band for r in keys) for k in keys) == 2


def test_a_line_is_hashed_once_a_pair(spark):
    texts = spark.createDataFrame([(1, "a line of some length"), (2, "a line of some lengths"), (3, "another one of words")], "h long, line string")
    found = verified(texts, spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), 0.8)
    assert planned(found).count("encode(line") == 2
    assert [tuple(r) for r in found.collect()] == [(1, 2)]


def test_bits_of_a_pair_are_never_null(spark):
    """Else the test of a pair is too much code for the JVM to make it fast."""
    rows = spark.createDataFrame([(1, n, 1, n, 3, 2, 1) for n in (1, 2, 3)], "band long, node long, low long, root long, n long, n_rest long, main long")
    bits = spark.createDataFrame([(n, [9] + [7] * LONGS) for n in (1, 2, 3)], "node long, bits array<bigint>")
    pairs = across(rows, bits, 0.8)
    assert "coalesce(bits#" in planned(pairs)
    assert [tuple(r) for r in pairs.collect()] == [(2, 3)]


def test_no_rows_of_an_explode_are_broadcast(spark):
    """Spark sizes them as the table before it: 6 MB of short lines are 400 MB of shingles."""
    lines = spark.createDataFrame([("short line no. 1",), ("short line no. 12",)], "line string").select(F.xxhash64("line").alias("h"), F.col("line").alias("short"))
    keys = prefixes(lines)
    assert "SortMergeJoin" in planned(keys) and "BroadcastHashJoin" not in planned(keys)
    assert keys.count() > 0 and "BroadcastHashJoin" not in planned(keys)
    rows = spark.createDataFrame([(1, n, 1, n, 3, 2, 1) for n in (1, 2, 3)], "band long, node long, low long, root long, n long, n_rest long, main long")
    bits = spark.createDataFrame([(n, [9] + [7] * LONGS) for n in (1, 2, 3)], "node long, bits array<bigint>")
    join = re.search(r"(\w+) \[band#\d+L, i#\d+L, j#\d+L\]", planned(across(rows, bits, 0.8)))
    assert join[1] == "SortMergeJoin"
