"""Column functions on text: identifiers, tokens, issue references, secrets, injections, citations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.scalars import text_entropy

#: Stop words, suffixes and patterns.
STOPWORDS = "a an and are as at be by for from if in into is it of on or that the this to was were will with def class return self cls none true false import pass else elif not".split()
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
ISSUE_REF = r"(?:(?<=\s)|(?<=\()|^)#(\d+)\b"
CLOSING_REF = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*:?\s+#(\d+)"
FIX_WORDS = r"(?i)\b(fix(?:e[sd]|ing)?|bug(?:fix)?|defect|regression|hotfix|patch(?:ed)?)\b"
SENTENCE_SPLIT = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"
CITATION = r"\[([^\[\]]+)\]"
COMMENT_OR_STRING = "(?sm)#.*$|\"\"\".*?\"\"\"|'''.*?'''|\"[^\"\\n]*\"|'[^'\\n]*'"
SECRET_RULES = {
    "aws-access-key": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    "github-token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "github-fine-grained": r"\bgithub_pat_[A-Za-z0-9_]{60,}\b",
    "slack-token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "google-api-key": r"\bAIza[0-9A-Za-z_\-]{35}\b",
    "groq-api-key": r"\bgsk_[A-Za-z0-9]{40,}\b",
    "openai-api-key": r"\bsk-(proj-)?[A-Za-z0-9_\-]{32,}\b",
    "stripe-secret": r"\b(sk|rk)_live_[0-9a-zA-Z]{20,}\b",
    "private-key": r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY( BLOCK)?-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
}
ASSIGNED_SECRET = r"""(?i)\b(password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret)\b\s*[:=]\s*["']([^"'\s]{12,})["']"""
#: The same with three groups: what stands before the value, the value's name, what stands after it.
ASSIGNED_VALUE = r"""(?i)(\b(?:password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret)\b\s*[:=]\s*["'])([^"'\s]{12,})(["'])"""
PLACEHOLDER = r"(?i)(example|placeholder|dummy|changeme|xxxx|your[_-]|<.*>|\$\{|os\.environ|getenv)"
INJECTION_RULES = [
    ("override", r"(?i)\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|above|earlier|all|system|your)\b[^.\n]{0,20}\b(instructions?|prompts?|rules?|guidelines?)"),
    ("role-hijack", r"(?i)\byou are (now|no longer)\b|\bact as (an?|the)\b|\bnew instructions?\s*:|\bsystem prompt\b"),
    ("verdict-steering", r"(?i)\b(ai|llm|bot|automated)[ -]?(reviewer|review|assistant|gate|checker)s?\b[^.\n]{0,40}\b(approve|pass|lgtm|merge|accept|ignore|skip)"),
    ("verdict-steering", r"(?i)\b(approve|mark|rate|score|classify)\b[^.\n]{0,30}\b(this|the)\b[^.\n]{0,20}\b(as )?(safe|low[- ]risk|pass(ed)?|approved)\b"),
    ("verdict-steering", r"(?i)\b(return|output|respond with|set)\b[^.\n]{0,20}\b(risk|decision|verdict|risk_rating)\b[^.\n]{0,20}\b(0(\.0+)?|low|pass|none)\b"),
    ("chat-markup", r"(?im)<\|?(im_start|im_end|system|endoftext)\|?>|\[/?INST\]|<</?SYS>>|^\s*###\s*(system|instruction)"),
    ("exfiltration", r"(?i)\b(print|reveal|show|repeat|leak)\b[^.\n]{0,30}\b(system prompt|your instructions|api key|secrets?|environment variables)\b"),
]
REMOVED, REDACTED = "[removed: suspected prompt injection]", "[REDACTED-SECRET]"


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def split_identifier(name: Column) -> Column:
    """camelCase and snake_case parts in lower case."""
    spaced = F.replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))
    return F.filter(F.split(F.lower(spaced), r"\s+"), lambda p: p != "")


def stem(word: Column) -> Column:
    """A light suffix stripper: words of four letters or fewer stay, the first suffix that leaves three letters goes."""
    n = F.length(word)
    cut = lambda k: F.left(word, n - k)
    sibilant = word.rlike("(ses|xes|zes|ches|shes)$")
    return (
        F.when(n <= 4, word)
        .when(word.endswith("ing") & (n >= 6), cut(3))
        .when(word.endswith("ies") & (n >= 6), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("ed") & (n >= 5), cut(2))
        .when(word.endswith("es") & (n >= 5), F.when(sibilant, cut(2)).otherwise(cut(1)))
        .when(word.endswith("ly") & (n >= 5), cut(2))
        .when(word.endswith("s"), cut(1))
        .otherwise(word)
    )


def tokenize(text: Column) -> Column:
    """Tokens of code and prose: identifiers of several parts whole, then their parts without stop words, stemmed."""
    stop = F.array(*(F.lit(w) for w in STOPWORDS))

    def of(raw: Column) -> Column:
        parts = split_identifier(raw)
        kept = F.transform(F.filter(parts, lambda p: ~F.array_contains(stop, p) & (F.length(p) > 1)), stem)
        return F.concat(F.when(F.size(parts) > 1, F.array(F.lower(raw))).otherwise(F.array().cast("array<string>")), kept)

    return F.flatten(F.transform(find_all(F.coalesce(text, F.lit("")), TOKEN), of))


def token_terms(raw: str) -> list[str]:
    """tokenize() of one raw token (TOKEN), in Python."""

    def stemmed(w: str) -> str:
        n = len(w)
        if n <= 4:
            return w
        if w.endswith("ing") and n >= 6:
            return w[:-3]
        if w.endswith("ies") and n >= 6:
            return w[:-3] + "y"
        if w.endswith(("ed", "ly")):
            return w[:-2]
        if w.endswith("es"):
            return w[:-2] if w.endswith(("ses", "xes", "zes", "ches", "shes")) else w[:-1]
        return w[:-1] if w.endswith("s") else w

    parts = re.sub("([a-z0-9])([A-Z])", r"\1 \2", raw).replace("_", " ").lower().split()
    return ([raw.lower()] if len(parts) > 1 else []) + [stemmed(p) for p in parts if p not in STOPWORDS and len(p) > 1]


def referenced_issues(message: Column) -> Column:
    return F.array_sort(F.array_distinct(find_all(message, ISSUE_REF, 1).cast("array<int>")))


def closing_issues(message: Column) -> Column:
    return F.array_sort(F.array_distinct(find_all(message, CLOSING_REF, 1).cast("array<int>")))


def subject(message: Column) -> Column:
    return F.element_at(F.split(F.trim(message), r"\R"), 1)


def classify_fix(message: Column, labels: Column | None = None) -> Column:
    """struct(is_fix, issues). labels: map of issue number to array of labels, or null without a tracker."""
    closes = closing_issues(message)
    words = F.coalesce(subject(message).rlike(FIX_WORDS), F.lit(False))
    none = F.array().cast("array<int>")
    plain = F.struct(words.alias("is_fix"), closes.alias("issues"))
    if labels is None:
        return plain
    bug = lambda n: F.coalesce(F.exists(F.try_element_at(labels, n), lambda x: F.lower(x).contains("bug")), F.lit(False))
    bugs = F.filter(closes, bug)
    tracked = F.coalesce(F.size(F.map_keys(labels)) > 0, F.lit(False))
    known = (F.size(closes) > 0) & F.forall(closes, lambda n: F.array_contains(F.map_keys(labels), n))
    return F.when(tracked & (F.size(bugs) > 0), F.struct(F.lit(True).alias("is_fix"), bugs.alias("issues"))).when(tracked & known, F.struct(F.lit(False).alias("is_fix"), none.alias("issues"))).otherwise(plain)


def secrets(text: Column) -> Column:
    """Array of (rule, preview) of every secret in a text."""
    rules = [F.transform(find_all(text, p), _finding(name)) for name, p in SECRET_RULES.items()]
    value = lambda m: F.regexp_extract(m, ASSIGNED_SECRET, 2)
    real = F.filter(find_all(text, ASSIGNED_SECRET), lambda m: ~value(m).rlike(PLACEHOLDER) & (text_entropy(value(m)) >= 3.5))
    assigned = F.transform(real, lambda m: F.struct(F.concat(F.lit("assigned-"), F.lower(F.regexp_extract(m, ASSIGNED_SECRET, 1))).alias("rule"), F.concat(F.left(value(m), F.lit(3)), F.lit("…")).alias("preview")))
    return F.concat(*rules, assigned)


def _finding(name: str):
    return lambda m: F.struct(F.lit(name).alias("rule"), F.concat(F.left(m, F.lit(4)), F.lit("…")).alias("preview"))


def redact(text: Column) -> Column:
    """The text with its secrets replaced; of an assignment only the value."""
    for pattern in SECRET_RULES.values():
        text = F.regexp_replace(text, pattern, REDACTED)
    return F.regexp_replace(text, ASSIGNED_VALUE, "$1" + REDACTED + "$3")


def injections(text: Column) -> Column:
    """Array of (kind, excerpt) of every suspected prompt injection."""
    hit = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), F.left(m, F.lit(80)).alias("excerpt"))
    return F.concat(*(F.transform(find_all(F.coalesce(text, F.lit("")), p), hit(kind)) for kind, p in INJECTION_RULES))


def code_injections(source: Column) -> Column:
    """The injections in the comments and strings of a source; a # runs to the end of the text, as the pattern has it."""
    return F.flatten(F.transform(comments_and_strings(F.coalesce(source, F.lit(""))), injections))


def neutralise(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for _, pattern in INJECTION_RULES:
        text = F.regexp_replace(text, pattern, REMOVED)
    return text


def comments_and_strings(source: Column) -> Column:
    return find_all(source, COMMENT_OR_STRING)


def cited(sentence: Column) -> Column:
    return F.flatten(F.transform(find_all(sentence, CITATION, 1), lambda g: F.transform(F.split(g, ","), lambda c: F.trim(c))))


def enforce_citations(text: Column, known: Column) -> Column:
    """struct(text, kept, removed): the sentences whose citations are all known, at least one each."""
    sentences = F.filter(F.transform(F.split(F.trim(text), SENTENCE_SPLIT), lambda s: F.trim(s)), lambda s: s != "")
    good = F.filter(sentences, lambda s: (F.size(cited(s)) > 0) & F.forall(cited(s), lambda c: F.array_contains(known, c)))
    return F.struct(F.array_join(good, " ").alias("text"), F.size(good).alias("kept"), (F.size(sentences) - F.size(good)).alias("removed"))


def decision_integrity(recorded: Column, expected: Column, text: Column) -> Column:
    """Severities: block where the decision is not the policy's, warn where the text names another one."""
    claimed = find_all(F.coalesce(text, F.lit("")), r"\b(PASS|CANARY|BLOCK)\b", 1)
    return F.array_compact(F.array(F.when(recorded != expected, "block"), F.when(F.exists(claimed, lambda c: c != expected), "warn")))


def support(claim: Column, source: Column) -> Column:
    """The share of a claim's tokens that its source has; 0 without tokens."""
    a, b = F.array_distinct(tokenize(claim)), F.array_distinct(tokenize(source))
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)))


def rationale_status(share: Column) -> Column:
    return F.when(share >= 0.6, "VERIFIED").when(share < 0.25, "REFUTED").otherwise("UNVERIFIABLE")


def json_in_prose(text: Column) -> Column:
    """The JSON of a fenced block, else between the outermost braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1)), F.lit(""))


def evidence_label(evidence: Column) -> Column:
    """The last part of a node id: without its path."""
    return F.substring_index(F.substring_index(evidence, "::", -1), "/", -1)


def parse_command(body: Column, name: str) -> Column:
    """struct(verb, argument) of the first line /name verb argument; nulls if there is none."""
    pattern = rf"(?im)^\s*/{name}\s+(\w+)[ \t]*(.*)$"
    verb = F.nullif(F.lower(F.regexp_extract(body, pattern, 1)), F.lit(""))
    return F.struct(verb.alias("verb"), F.when(verb.isNotNull(), F.trim(F.regexp_extract(body, pattern, 2))).alias("argument"))


def valid_ref(ref: Column) -> Column:
    return ref.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]{0,199}$") & ~ref.contains("..")


def repo_slug(url: Column) -> Column:
    """owner/name of a repository address, or null."""
    return F.nullif(F.regexp_replace(F.regexp_extract(url, r"^(?:https://[A-Za-z0-9.-]+/|git@[A-Za-z0-9.-]+:)?([A-Za-z0-9][A-Za-z0-9-]*/[A-Za-z0-9._-]+?)(?:\.git)?/?$", 1), r"\.git$", ""), F.lit(""))


def best_sentence(text: Column, question: Column) -> Column:
    """The sentence with the largest share of the question's tokens, the first of equals."""
    q = F.array_distinct(tokenize(question))
    s = F.filter(F.split(F.trim(text), SENTENCE_SPLIT), lambda x: F.trim(x) != "")
    scored = F.transform(s, lambda x, i: F.struct((F.size(F.array_intersect(q, F.array_distinct(tokenize(x)))) / F.nullif(F.size(q), F.lit(0))).alias("score"), (-i).alias("ord"), x.alias("sentence")))
    return F.array_max(scored)["sentence"]
