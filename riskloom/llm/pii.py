"""PII (operator 9), native: patterns propose spans, checksums confirm them, nearby words adjust a score.

Every kind has a pattern, a validator and context words. A text's matches of a pattern and the pieces between them
come from the same regular expression, so the running sum of their lengths gives each match's place in code points.
Validators: octets at most 255, Luhn for cards, digit counts for phones, mod-97 for account numbers (iban, at the longest of their ends that is valid); a national
number (ssn) stands only beside a context word. Patterns start at the head of a run of characters (or where the last
match ended) and use possessive loops, so a long run costs linear time and no stack.

Null texts and empty texts have no spans and score 0; texts are scanned whole; repeated rows give repeated results; an empty
table gives no rows; other columns are not read. A column of the table may have any name: the helper columns are dropped and only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    guard: str  # SQL over `text`: false where the pattern cannot match
    valid: str  # SQL over the matched text `x.t`
    context: str  # words that raise the score when they stand just before
    base: float
    needs_context: bool = False
    cut: str = "x.t"  # SQL over the matched text: the part of it that counts, null if none does


_DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
#: Luhn over the digits from the right: every second one doubled, nines cast out.
_LUHN = f"aggregate(split(reverse({_DIGITS}), ''), struct(0 as n, 0 as k), (a, c) -> struct(a.n + if(a.k % 2 = 0, ascii(c) - 48, if(ascii(c) > 52, 2 * (ascii(c) - 48) - 9, 2 * (ascii(c) - 48))) as n, a.k + 1 as k), a -> a.n % 10 = 0)"
_MOD97 = "aggregate(split(concat(substring(replace(p, ' ', ''), 5), left(replace(p, ' ', ''), 4)), ''), 0, (a, c) -> if(ascii(c) < 58, (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1"
#: Of the groups of an account number, as many from the left as make a valid one; capital words and numbers that follow it are no part.
_IBAN = f"get(filter(transform(sequence(size(split(x.t, ' ')), 1, -1), k -> array_join(slice(split(x.t, ' '), 1, k), ' ')), p -> length(replace(p, ' ', '')) between 15 and 34 and {_MOD97}), 0)"

#: Fixed patterns of the first four kinds, in the order of their listing; written with heads and possessive loops, they match the same places.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true", "mail|email|e-mail|contact|write|correo|courriel", 0.8),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text rlike '[0-9][.][0-9]'", r"x.t rlike '^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})([.]0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$'", "ip|host|server|address|adresse", 0.5),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"text rlike '[0-9](?:[ -]?[0-9]){15}'", f"length({_DIGITS}) between 16 and 19 and {_LUHN}", "card|visa|credit|karte|carte|tarjeta", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", f"length({_DIGITS}) between 8 and 15", "call|phone|tel|mobile|telefon", 0.6),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", r"text rlike '[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}'", "true", "iban|account|konto|compte|cuenta", 0.8, cut=_IBAN),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"text rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'", "not (x.t rlike '^(000|666|9..)-|-00-|-0000$')", "ssn|social|security", 0.4, True),
]
N_BASE = 4
#: Characters before a span in which context words count, and what they add.
NEAR, BONUS = 40, 0.2


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def spans(kind: Kind) -> Column:
    """The valid matches of a kind in the column `text`: array of (s, e, score), code points, end exclusive."""
    pattern = _quoted(kind.pattern)
    none = "cast(array() as array<struct<s:int,e:int,t:string>>)"
    placed = (
        f"aggregate(zip_with(split(text, {pattern}, -1), regexp_extract_all(text, {pattern}, 0), (p, m) -> struct(p, m)), struct(0 as at, {none} as out), "
        f"(a, x) -> struct(a.at + length(x.p) + coalesce(length(x.m), 0) as at, if(x.m is null, a.out, array_append(a.out, struct(a.at + length(x.p) as s, a.at + length(x.p) + length(x.m) as e, x.m as t))) as out), a -> a.out)"
    )
    near = f"lower(substring(text, greatest(x.s - {NEAR}, 0) + 1, least(x.s, {NEAR}))) rlike '(^|[^a-z])({kind.context})([^a-z]|$)'"
    if kind.cut != "x.t":
        placed = f"filter(transform(transform({placed}, x -> struct(x.s as s, {kind.cut} as t)), x -> struct(x.s as s, x.s + length(x.t) as e, x.t as t)), x -> x.t is not null)"
    keep = f"filter({placed}, x -> {kind.valid}{f' and {near}' if kind.needs_context else ''})"
    scored = f"transform({keep}, x -> struct(x.s as s, x.e as e, {kind.base}D + if({near}, {BONUS}D, 0D) as score))"
    return F.expr(f"case when {kind.guard} then {scored} else cast(array() as array<struct<s:int,e:int,score:double>>) end")


def find(docs: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """doc_id and one array of (s, e, score) for each kind, named like it."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", *(spans(k).alias(k.name) for k in kinds))


def _label(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))


def pii_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, score (the highest of a document's spans) of every row of docs."""
    def text(names: list[str]) -> Column:
        every = [F.transform(k, _label(k)) for k in names]
        return F.array_join(F.concat(*every), ",")

    names = [k.name for k in KINDS]
    scores = F.concat(*(F.transform(k, lambda x: x["score"]) for k in names))
    return find(docs).select(
        "doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in names[:N_BASE]), F.sha2(text(names[:N_BASE]), 256).alias("base_sha256"), text(names).alias("spans"), F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score")
    )


def _oracle() -> str:
    """The same rows in DuckDB, whose patterns have no look-behind: a boundary character is matched and counted off instead."""
    octet = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda j: CASE WHEN (length({digits}) - j) % 2 = 0 THEN CAST(substring({digits}, j, 1) AS INTEGER) WHEN CAST(substring({digits}, j, 1) AS INTEGER) > 4 THEN 2 * CAST(substring({digits}, j, 1) AS INTEGER) - 9 ELSE 2 * CAST(substring({digits}, j, 1) AS INTEGER) END)) % 10 = 0"
    turned = "replace(p, ' ', '')[5:] || replace(p, ' ', '')[1:4]"
    mod97 = f"list_reduce(list_transform(string_split({turned}, ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97, 0) = 1"
    rows = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", f"regexp_full_match(v, '{octet}([.]{octet}){{3}}')"),
        ("card", "[0-9](?:[ -]?[0-9])+", f"length({digits}) BETWEEN 16 AND 19 AND {luhn}"),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
        ("iban", "(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", "true"),
        ("ssn", "(?:^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}", "true"),
    ]
    found = " UNION ALL ".join(f"SELECT doc_id, t, '{name}' AS kind, {i} AS ord, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS s FROM d WHERE regexp_matches(t, '{p}')" for i, (name, p, _) in enumerate(rows))
    valid = " ".join(f"WHEN '{name}' THEN {rule}" for name, _, rule in rows)
    context = " ".join(f"WHEN '{k.name}' THEN regexp_matches(w, '(^|[^a-z])({k.context})([^a-z]|$)')" for k in KINDS)
    base = " ".join(f"WHEN '{k.name}' THEN {k.base}" for k in KINDS)
    n = ", ".join(f"count(kind) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in KINDS[:N_BASE])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
x AS (SELECT doc_id, t, kind, ord, m, s, unnest(range(1, len(m) + 1)) AS i FROM f),
y AS (SELECT doc_id, t, kind, ord, m[i] AS raw, list_sum(list_transform(s[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS p0 FROM x),
v AS (SELECT doc_id, t, kind, ord, CASE WHEN kind IN ('iban', 'ssn') THEN ltrim(regexp_replace(raw, '^[^A-Z0-9]', '')) ELSE raw END AS v, CAST(p0 + length(raw) AS BIGINT) AS e FROM y),
i AS (SELECT * REPLACE (list_filter(list_transform(range(len(string_split(v, ' ')) - CASE WHEN regexp_matches(substring(t, e + 1, 1), '[A-Za-z0-9]') THEN 1 ELSE 0 END, 0, -1), lambda k: array_to_string(string_split(v, ' ')[1:k], ' ')), lambda p: length(replace(p, ' ', '')) BETWEEN 15 AND 34 AND {mod97})[1] AS v), v AS whole FROM v WHERE kind = 'iban'),
v2 AS (SELECT doc_id, t, kind, ord, v, e FROM v WHERE kind <> 'iban' UNION ALL SELECT doc_id, t, kind, ord, v, e - length(whole) + length(v) FROM i WHERE v IS NOT NULL),
k AS (SELECT *, e - length(v) AS b, lower(substring(t, CAST(greatest(e - length(v) - {NEAR}, 0) + 1 AS BIGINT), CAST(least(e - length(v), {NEAR}) AS BIGINT))) AS w FROM v2 WHERE CASE kind {valid} END),
c AS (SELECT doc_id, kind, ord, b, e, CASE kind {context} END AS near, CAST(CASE kind {base} END AS DOUBLE) AS base FROM k),
g AS (SELECT doc_id, kind, ord, b, kind || ':' || b || ':' || e AS label, base + CASE WHEN near THEN CAST({BONUS} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM c WHERE kind <> 'ssn' OR near)
SELECT d.doc_id, {n}, sha256(coalesce(string_agg(label, ',' ORDER BY ord, b) FILTER (WHERE ord < {N_BASE}), '')) AS base_sha256, coalesce(string_agg(label, ',' ORDER BY ord, b), '') AS spans, coalesce(max(score), 0) AS score
FROM d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id
"""


ORACLE_SQL = _oracle()
