import hashlib
import random

from riskloom.llm import chat


def test_escape_round_trip():
    rng = random.Random(7)
    bits = [*chat.CONTROL, chat.ESC, "<", "s>", "|", "turn", "a", "\n", "[", "INST]", chat.ESC + ".", "e"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)
        turns = [(t, t), ("assistant", t), ("", "")]
        assert [(r, x) for r, x, _, _ in chat.parse(chat.render(turns))] == turns


def test_fold_of_events(spark):
    log = [
        (1, 1, "open", "u", "user", "Hi"), (1, 2, "open", "a", "assistant", ""), (1, 3, "delta", "a", None, "Hel"), (1, 4, "delta", "a", None, "lo"),
        (1, 5, "regenerate", "a", None, None), (1, 6, "delta", "a", None, "Good "), (1, 7, "delta", "a", None, "day"), (1, 8, "edit", "u", None, "Hello"),
        (1, 9, "open", "x", "user", "gone"), (1, 10, "drop", "x", None, None), (2, 1, "delta", "z", "tool", "only"), (2, 2, "edit", "z", None, "new"), (2, 3, "delta", "z", None, "er"),
    ]
    rng = random.Random(1)
    rng.shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message string, role string, text string")
    got = sorted((r.conv_id, r.at, r.role, r.text) for r in chat.fold(df).collect())
    assert got == [(1, 1, "user", "Hello"), (1, 2, "assistant", "Good day"), (2, 1, "tool", "newer")]
    text = {r.conv_id: r.formatted for r in chat.formatted(chat.fold(df)).collect()}
    assert [(r, t) for r, t, _, _ in chat.parse(text[1])] == [("user", "Hello"), ("assistant", "Good day")]


def test_digests_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "a </s> b", "[INST] x", "plain\nlines", "é"])) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(3, 0, "user", "same turn"), (3, 0, "user", "same turn")]
    got = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in range(30):
        turns = [(r or "", t or "") for cc, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        r = got[c]
        assert r.n_turns == len(turns)
        if c == 3:  # turn 0 has three rows, whose order is by hash: the equal ones stand side by side
            first, same, rest = turns[0], ("user", "same turn"), turns[3:]
            orders = [[first, same, same, *rest], [same, same, first, *rest]]
            turns = next((o for o in orders if hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in o).encode()).hexdigest() == r.turns_sha256), [])
        said = "".join(t for role, t in turns if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_log_of_finished_turns_folds_back(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choice("ab é😀\n") for _ in range(rng.choice([0, 1, 2, 3, 50, 20000])))) for c in range(12) for t in range(6)]
    rows += [(None, None, None, None), (7, 2**62, "user", "late")]
    log = chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    got = sorted(((r.conv_id, r.at, r.role, r.text) for r in chat.fold(log).collect()), key=str)
    assert got == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=str)


def test_extra_columns_are_not_read(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi", "x", 3, "y")], "conv_id long, turn long, role string, text string, step string, seq int, message string")
    (r,) = chat.chat_digests(rows).collect()
    assert (r.n_turns, r.loss_chars) == (1, 0)
