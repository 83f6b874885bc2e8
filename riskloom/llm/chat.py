"""Chat formatting (operator 3): event-sourced reconstruction, then rendering with a loss mask.

A log has the columns conv_id, seq, kind, message, role, text, and may have step. Kinds: open starts a message with its
role and text, delta appends its text, edit replaces the text, regenerate empties it for new deltas, drop removes the
message. Events fold by message in the order of seq and step (ties: kind, text); messages stand in a conversation by their
least seq. Finished turns become such a log (events_of): texts arrive in deltas, some after a draft that is regenerated or edited.

The fold is a native sort-and-aggregate over one message's events: the text of a message is what follows its last
edit or regenerate. Only the strings of one conversation meet in one row, since the output is one string.

Null texts and roles are empty. Rows that repeat are events that repeat. No events: no conversations. Messages
without open (only deltas) have the role of their first event. Null ids are a conversation of their own, null turns come
first. Turns with one number stand by a hash of role and text, repeated rows beside each other. Texts of any length are
folded and rendered whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_arrow, sha256_hex

#: Fixed control strings of this and other widespread chat templates; inside texts they are escaped.
CONTROL = ["<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TURN, END = "<|turn|>", "<|end|>"
#: The escape character; it is followed by e (itself), n (a line end in a role) or . (a break inside a control string).
ESC = "\x1a"
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(ESC + "(.)", re.S)
_FORM = re.compile(f"{re.escape(TURN)}([^\n]*)\n(.*?){re.escape(END)}\n", re.S)


def escape(text: str) -> str:
    """No control string is left in the result; unescape() gives the text back."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}{ESC}.{m[0][1:]}", text.replace(ESC, ESC + "e"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"e": ESC, "n": "\n", ".": ""}[m[1]], text) if ESC in text else text


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{TURN}{escape(role).replace(chr(10), ESC + 'n')}\n{escape(text)}{END}\n" for role, text in turns)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a rendered string; start and end are the content's places in it."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _FORM.finditer(formatted)]


def loss_spans(formatted: str, role: str = "assistant") -> list[tuple[int, int]]:
    """The character ranges that training takes a loss on."""
    return [(start, end) for r, _, start, end in parse(formatted) if r == role]


def fold(events: DataFrame) -> DataFrame:
    """conv_id, at, message, role, text of every message that a log leaves; at: its least seq."""
    step = F.col("step") if "step" in events.columns else F.lit(0).alias("step")
    e = events.select("conv_id", "message", "seq", step, F.lower("kind").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = F.array_sort(F.collect_list(F.struct("seq", "step", "kind", "role", "text")))
    folded = e.groupBy("conv_id", "message").agg(log.alias("log"))
    resets = F.filter(F.transform("log", lambda x, i: F.when(x["kind"].isin("edit", "regenerate", "open"), i)), lambda i: i.isNotNull())
    last = F.coalesce(F.try_element_at(resets, F.lit(-1)), F.lit(0))
    live = F.filter(F.slice("log", last + 1, F.size("log")), lambda x: x["kind"] != "regenerate")
    return folded.where(~F.exists("log", lambda x: x["kind"] == "drop")).select(
        "conv_id", F.col("log")[0]["seq"].alias("at"), "message", F.col("log")[0]["role"].alias("role"), F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text")
    )


def formatted(messages: DataFrame) -> DataFrame:
    """conv_id, formatted: the rendered string of every conversation's messages (conv_id, at, message, role, text)."""
    rendered = map_arrow(
        messages, ["conv_id", "at", "message", "role", "text"], "conv_id bigint, at bigint, message string, part string",
        lambda: lambda rows: {"conv_id": rows["conv_id"], "at": rows["at"], "message": rows["message"], "part": [render([(r or "", t or "")]) for r, t in zip(rows["role"], rows["text"], strict=True)]},
    )
    parts = F.array_sort(F.collect_list(F.struct("at", "message", "part")))
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("formatted"))


#: Deltas in which a finished text arrives.
DELTAS = 3


def events_of(turns: DataFrame) -> DataFrame:
    """The log of conversations with final turns, as a chat service would have written it.

    Every message opens empty and gets its text in DELTAS deltas. By a hash of the row, a third of the messages first get a
    draft that is regenerated, another third a draft that an edit replaces. A row that differs or repeats is a message of its own.
    """
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = rows.groupBy("conv_id", "seq", "role", "text").agg(F.count("*").cast("int").alias("n"))
    copies = repeated.select("conv_id", "seq", "role", "text", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    name = F.concat_ws("-", F.md5(F.to_json(F.struct("role", "text"))), F.col("copy").cast("string"), F.col("seq").cast("string"))
    event = lambda step, kind, text: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    n, empty = F.ceil(F.length("text") / DELTAS).cast("int"), F.lit("")
    deltas = [event(3 + k, "delta", F.substring("text", n * k + 1, n)) for k in range(DELTAS)]
    draft = event(1, "delta", F.concat(F.lit("draft "), F.left("text", n)))
    way = F.pmod(F.xxhash64("conv_id", "seq", "role", "text"), F.lit(3))
    log = F.when(way == 0, F.array(event(0, "open", empty), *deltas)).when(way == 1, F.array(event(0, "open", empty), draft, event(2, "regenerate", empty), *deltas)).otherwise(F.array(event(0, "open", empty), draft, event(2, "edit", F.col("text"))))
    return copies.select("conv_id", "seq", name.alias("message"), "role", F.explode(log).alias("x")).select("conv_id", "seq", "x.step", "x.kind", "message", "role", "x.text")


def chat_digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, read back from the rendered strings."""
    names = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def make():
        def one(text):
            back = parse(text)
            said = "".join(unescape(text[a:b]) for a, b in loss_spans(text))
            return len(back), sha256_hex("".join(f"{r}\n{t}\n" for r, t, _, _ in back).encode("utf-8", "surrogatepass")), len(said), sha256_hex(said.encode("utf-8", "surrogatepass")), len(text)

        def step(rows):
            cols = list(zip(*map(one, rows["formatted"]), strict=True)) or [()] * 5
            return dict(zip([p.split()[0] for p in names.split(", ")], [rows["conv_id"], *map(list, cols)], strict=True))

        return step

    return map_arrow(formatted(fold(events_of(turns))), ["conv_id", "formatted"], names, make)
