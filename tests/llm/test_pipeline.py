import os
import random
import sys

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline

sys.path.insert(0, os.path.dirname(__file__))  # for the brute-force versions of the other tests


def write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(3, 8)))
    line = lambda n=15: " ".join(word() for _ in range(n))
    item = line(20)
    texts = {i: line(30) + "\n" + line(25) for i in range(60)}
    toxic = list(range(100, 130))
    texts |= {i: line(12) + " idiot moron " + line(8) for i in toxic}
    texts[200] = line(5) + " " + item + " " + line(5)
    shared = line(40)
    texts[300], texts[301] = shared + "\n" + line(), shared + "\n" + line()
    words = [word() for _ in range(400)]
    texts[400] = "\n".join(" ".join(words[k : k + 20]) for k in range(0, 400, 20))
    texts[401] = " ".join(words)  # the same words, in one line: line dedup leaves it, near-dedup takes it
    docs = [(i, t, "en", "s", len(t)) for i, t in sorted(texts.items())]
    write(spark, tmp_path, docs, [(i, 1, int(i in toxic)) for i in texts if i < 130], [(1, item)])
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(texts) - set(toxic) - {200, 401}
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert t.decode([int.from_bytes(out[301].ids[k : k + 4], "little") for k in range(0, len(out[301].ids), 4)]) == texts[301].split("\n")[1]
    assert out[300].n_tokens == len(t.encode(texts[300]).ids)


def plain_pipeline(rows, toxic, items):
    """doc_id and text of what the stages leave, one stage after the other by brute force; toxic: the scores' verdict by position."""
    from test_bagminhash import bag, jaccard
    from test_decontam import brute as benchmark_hits
    from test_linededup import brute as line_classes

    rows = sorted(((d, t) for (d, t), bad in zip(rows, toxic, strict=True) if not bad), key=lambda r: (r[0] is None, r[0] or 0))
    first = line_classes([t for _, t in rows])
    texts = [t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if first.get((i, n), (i, n)) == (i, n)) for i, (_, t) in enumerate(rows)]
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = [(rows[i][0], texts[i]) for i in range(len(texts)) if find(i) == i]
    return [(d, t) for d, t in kept if not benchmark_hits(t, items)[-1]]


def test_against_a_plain_version(spark, tmp_path):
    from riskloom.llm import toxicity

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdeghilmnoprstué") for _ in range(rng.randint(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    lines = [line(rng.randint(3, 30)) for _ in range(60)]
    item = line(14)
    rows = []
    for i in range(90):
        own = [rng.choice(lines) if rng.random() < 0.4 else line(rng.randint(2, 25)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.2:
            own.append(line(4) + " " + item + " " + line(3))
        if i % 9 == 0:
            own.append("you idiot moron " + line(6))
        rows.append((i, "\n".join(own)))
    for i in range(90, 110):
        text = rows[rng.randrange(80)][1].replace("\n", " ")
        rows.append((i, text + " " + word()))
    rows += [(200, None), (201, ""), (202, "\n \n"), (5, rows[5][1]), (300, "long " * 20000), (301, "long " * 20001)]
    docs = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
    labels = [(i, 1, int(i % 9 == 0)) for i in range(90)]
    write(spark, tmp_path, docs, labels, [(1, item), (2, None), (3, "")])
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    score = {(r.doc_id, r.text): r.score for r in toxicity.scores(d, toxicity.train(d, spark.read.parquet(f"{tmp_path}/labels.parquet")), ["doc_id", "text"]).collect()}
    toxic = [score[r] >= 0.5 for r in rows]
    assert 5 <= sum(toxic) <= 15
    want = plain_pipeline(rows, toxic, [(1, item), (2, None), (3, "")])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in out) == sorted((i, len(x), b"".join(k.to_bytes(4, "little") for k in x)) for i, x in ((i, t.encode(text or "").ids) for i, text in want))


def test_stages_keep_extra_columns_and_empty_tables(spark, tmp_path):
    rows = [(1, "some words of a text\nand more", "en", "s", 29, "a", 1, b"x"), (2, None, None, None, None, None, None, None), (2, "some words of a text\nother", "en", "s", 26, "b", 2, b"y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid string, row int, key binary")
    write(spark, tmp_path, [(1, "some words", "en", "s", 10)], [(1, 1, 0)], [(1, "not in there at all")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert out.count() == 3, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
