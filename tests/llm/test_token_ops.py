import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from riskloom.llm import bpe, license, media, tokencount
from riskloom.llm.common import words_of

ALPHA = [chr(x) for x in [*range(0x250), *range(0x370, 0x400), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600, 0xAC00, 0x130, 0x3A3, 0x301]]


def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice(ALPHA) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    out += ["".join(rng.choice("aabbcdet '<>|.,\n\t  1") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    return [*out, "x<|endoftext|>y <|endoftext|>", "<|startoftext|>a", "", "a" * 5000, "ab" * 3000, "don't we'll I'M", "ΑΣ Σ σ", None, "same", "same"]


def test_bpe_equals_the_library(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(rows)], "doc_id long, text string, ids string")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in bpe.encoded_digests(docs, P.path("byte_bpe_50k.json")).collect():
        want = t.encode(rows[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_only_failing_words_are_merged():
    c = bpe.Codec(bpe.read_vocabulary(P.path("byte_bpe_50k.json")))
    word = b" tokenization"
    assert c.speculate(word) and b"".join(c.bytes[i] for i in c.merge(word)) == word


def test_counts_equal_the_library(spark):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in tokencount.token_counts(docs, P.path("word_bpe_49k.json"), limit=100).collect():
        n = len(t.encode(rows[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 100, len((rows[r.doc_id] or "").encode()))


def test_media_round_trip(spark):
    for text in ["", "a", "x" * 64, "é" * 1000, "y" * 70000]:
        data = media.padded(text)
        packed = media.pack(data)
        (track,) = media.inspect(packed)
        assert media.read_back(packed, track) == data and track.codec == "raw " and track.duration == len(data)
        assert track.keyframe_ranges()[0] == track.ranges()[0]
    assert media.inspect(b"") == [] and media.inspect(packed[:200]) == [] and media.inspect(b"\0\0\0\4abcd") == []
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "q"), (4, "q")], "doc_id long, text string")
    got = {r.doc_id: r for r in media.media_columns(docs).collect()}
    assert got[1][1:] == got[2][1:] and got[3][1:] == got[4][1:] and got[2].payload_bytes == 64
    assert media.media_columns(docs.limit(0)).count() == 0


def brute_phrases(text):
    words = [w.decode() for w in words_of(text)]
    out = []
    for phrase, label in license.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return out


def test_license_scan(spark):
    rng = random.Random(3)
    bits = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "the", "x", "Ünder", "CC-BY", "this", "program"]
    rows = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows += [None, "", "foo " + license.TEMPLATES[4][1].upper() + " bar", "Released under the MIT License.", "cc by " * 20000]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in license.license_scan(docs).collect()}
    for i, t in enumerate(rows):
        want = brute_phrases(t)
        starts = [s for s, _ in want]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words_of(t)), len(want), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in want})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[302].labels == "gpl" and got[302].score == 1.0 and got[303].labels == "mit"
    assert license.license_scan(docs.limit(0)).count() == 0


def matching_statistics(words, templates):
    """Of every place the longest run of words that ends there and stands in some template, by trying all of them."""
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [max((k for k in range(1, at + 2) if tuple(words[at - k + 1 : at + 1]) in runs), default=0) for at in range(len(words))]


def test_matching_statistics_against_brute_force():
    rng = random.Random(4)
    templates = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    automaton = license.Automaton(templates)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(rng.randint(0, 30))]
        got = {at: size for at, _, size in automaton.stream(words)}
        assert got == {at: n for at, n in enumerate(matching_statistics(words, templates)) if n > 1}


def test_whole_texts_are_told_apart():
    from riskloom.llm.licences import WHOLE

    _, whole = license.scanners()
    for label, text in WHOLE:
        (span,) = whole.spans(f"some words before {text} and after")
        assert whole.labels[span[2]] == label and span[3] == 1.0 and span[:2] == (3, 3 + len(words_of(text)))
    both = whole.spans(dict(WHOLE)["mit"] + " x " * 50 + dict(WHOLE)["bsd-3-clause"].replace("copyright holder nor", "authors nor"))
    assert [whole.labels[x[2]] for x in both] == ["mit", "bsd-3-clause"] and 0.95 < both[1][3] < 1
    assert whole.spans("the software is provided as is") == [] and license.scanners((("own", "one two three four"),))[1].spans("one two three four")


def test_media_digests_against_independent_ones(spark):
    texts = ["", "é" * 100, "a" * 64, "b" * 5000, "long " * 60000]
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in enumerate(texts)], "doc_id long, text string, feature binary, keyframe_ranges int")
    for r in media.media_columns(docs).collect():
        raw = texts[r.doc_id].encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        n = len(padded) // 64
        assert r.media_bytes > len(padded) and len(r.media_sha256) == 64 and len(r.keyframe_ranges) == -(-n // 16)
        assert {k.length for k in r.keyframe_ranges} == {64} and f"duration={len(padded)};samples={n};keyframes={len(r.keyframe_ranges)}" in r.feature


def test_fragmented_containers():
    pack = lambda *n: struct.pack(f">{len(n)}I", *n)
    moov = media.box(b"moov", media.box(b"trak", media.full(b"tkhd", pack(0, 0, 7)), media.box(b"mdia", media.full(b"mdhd", pack(0, 0, 1000, 0, 0)))), media.box(b"mvex", media.full(b"trex", pack(7, 1, 10, 2, 0x10000))))
    moof = lambda at: media.box(b"moof", media.box(b"traf", media.full(b"tfhd", pack(7)), media.full(b"trun", pack(3, at, 0, 4, 3, 3), flags=0x205)))
    data = moov + moof(len(moof(0)) + 8) + media.box(b"mdat", b"abcdefghij")
    (track,) = media.inspect(data)
    assert media.read_back(data, track) == b"abcdefghij" and track.duration == 30 and track.keyframe_ranges() == track.ranges()[:1]


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a text", b"i", "d", 5, True)], "doc_id long, text string, ids binary, decoded string, n_tokens int, over_limit boolean")
    count, code = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
    n = len(Tokenizer.from_file(code).encode("a text", add_special_tokens=False).ids)
    assert [(r.doc_id, r.n_tokens) for r in bpe.encoded_digests(docs, code).collect()] == [(1, n)]
    assert [len(r.ids) for r in bpe.encoded(docs, code, keep=("doc_id", "text")).collect()] == [4 * n]
    assert tokencount.token_counts(docs, count).first().n_bytes == 6
    assert bpe.encoded_digests(docs.limit(0), code).count() == 0 and tokencount.token_counts(docs.limit(0), count).count() == 0
    assert license.license_scan(docs.withColumnRenamed("ids", "labels")).count() == 1


def test_broken_containers_give_no_tracks():
    import random
    import struct

    b, full = media.box, media.full
    deep = b""
    for _ in range(1200):
        deep = b(b"moov", deep)
    trak = b(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 1)))
    stsz = lambda size, n: b(b"moov", b(b"trak", full(b"stsz", struct.pack(">II", size, n))))
    unknown = b(b"moov", trak) + b(b"moof", b(b"traf", full(b"tfhd", struct.pack(">I", 7))))
    early = b(b"moov", trak) + b(b"moof", b(b"traf", full(b"trun", struct.pack(">I", 1))))
    many = b(b"moov", trak) + b(b"moof", b(b"traf", full(b"tfhd", struct.pack(">I", 1)), full(b"trun", struct.pack(">I", 1 << 31))))
    for data in (deep, stsz(1, 0xFFFFFFFF), stsz(0, 0xFFFFFFFF), unknown, early, many):
        assert media.inspect(data) == []
    rng = random.Random(4)
    good = media.pack(media.padded("some text " * 400))
    assert len(media.inspect(good)) == 1
    for _ in range(3000):
        data = bytearray(good[: rng.choice([len(good), rng.randint(0, len(good))])])
        for _ in range(rng.randint(1, 8)):
            if data:
                at = rng.randrange(len(data) if rng.random() < 0.3 else min(len(data), 700))
                data[at] = rng.choice([0, 1, 255, rng.randrange(256)])
        assert isinstance(media.inspect(bytes(data)), list)
