"""Queries of text functions and guards: documents and conversations are the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.functions import text as X
from riskloom.operators.relations import set_print
from riskloom.operators.retrieval import shared_terms, token_counts
from riskloom.plans.registry import query, table


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS BIGINT) AS n_raw FROM documents""")
def raw_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Raw tokens of every text."""
    return table(spark, d, "documents").select("doc_id", F.size(X.find_all(F.col("text"), X.TOKEN)).cast("bigint").alias("n_raw"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
TOKENS_SQL = rf"""
raw AS (SELECT {{key}} AS k, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS r FROM {{table}}),
sp AS (SELECT k, lower(r) AS low, list_filter(string_split(lower(replace(regexp_replace(r, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' ')), ' '), lambda x: x <> '') AS p FROM raw),
parts AS (SELECT k, unnest(p) AS w FROM sp),
st AS (SELECT k, CASE WHEN length(w) <= 4 THEN w WHEN w LIKE '%ing' AND length(w) >= 6 THEN w[:-4] WHEN w LIKE '%ies' AND length(w) >= 6 THEN w[:-4] || 'y' WHEN w LIKE '%ed' AND length(w) >= 5 THEN w[:-3] WHEN w LIKE '%es' AND length(w) >= 5 THEN CASE WHEN regexp_matches(w, '(ses|xes|zes|ches|shes)$') THEN w[:-3] ELSE w[:-2] END WHEN w LIKE '%ly' AND length(w) >= 5 THEN w[:-3] WHEN w LIKE '%s' THEN w[:-2] ELSE w END AS w FROM parts WHERE length(w) > 1 AND w NOT IN ({_STOP})),
tok AS (SELECT k, w FROM st UNION ALL SELECT k, low FROM sp WHERE len(p) > 1)
"""


@query(f"WITH {TOKENS_SQL.format(key='doc_id', table='documents')} SELECT k AS doc_id, count(*) AS n_tokens, count(DISTINCT w) AS n_distinct FROM tok GROUP BY 1")
def code_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers split, stop words dropped, parts stemmed."""
    t = token_counts(table(spark, d, "documents"), ["doc_id"], "text")
    return t.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"))


def planted(spark: SparkSession, d: str) -> DataFrame:
    """The documents, and a text with made-up secrets for each part."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("key = AKIA"), F.upper(F.lpad(k.cast("string"), 16, "Q")), F.lit(" and"), F.when(k % 3 == 0, F.concat(F.lit(" ghp_"), F.repeat(F.lit("a1B2"), 9))).otherwise(" none"), F.when(k % 4 == 0, ' password: "Zq8vXr2Lw9Kt"').when(k % 4 == 1, ' secret = "aaaaaaaaaaaaaa"').when(k % 4 == 2, ' api_key="example-Zq8vXr2Lw9"').otherwise(""))
    return table(spark, d, "documents").select("doc_id", "text").unionAll(table(spark, d, "part").select((-k).alias("doc_id"), text.alias("text")))


PLANTED_SQL = """SELECT doc_id, text FROM documents UNION ALL SELECT -p_partkey, 'key = AKIA' || upper(lpad(CAST(p_partkey AS VARCHAR), 16, 'Q')) || ' and' || CASE WHEN p_partkey % 3 = 0 THEN ' ghp_' || repeat('a1B2', 9) ELSE ' none' END || CASE p_partkey % 4 WHEN 0 THEN ' password: "Zq8vXr2Lw9Kt"' WHEN 1 THEN ' secret = "aaaaaaaaaaaaaa"' WHEN 2 THEN ' api_key="example-Zq8vXr2Lw9"' ELSE '' END FROM part"""
_REDACTED = "text"
for _rule in X.SECRET_RULES.values():
    _REDACTED = f"regexp_replace({_REDACTED}, '{_rule}', '{X.REDACTED}', 'g')"
_REDACTED = f"regexp_replace({_REDACTED}, '" + X.ASSIGNED_VALUE.replace("'", "''") + f"', '\\1{X.REDACTED}\\3', 'g')"


@query(f"WITH t AS ({PLANTED_SQL}), r AS (SELECT doc_id, text, {_REDACTED} AS redacted FROM t) SELECT doc_id, redacted FROM r WHERE redacted <> text")
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts with secrets, after all rules have replaced them."""
    rows = planted(spark, d).withColumn("redacted", X.redact(F.col("text")))
    return rows.where("redacted <> text").select("doc_id", "redacted")


@query(r"""SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?i)(^|[^A-Za-z])(the|und|que|des)([^A-Za-z]|$)')) AS hits FROM conversations GROUP BY 1""")
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """Rule hits by role."""
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"(?i)(^|[^A-Za-z])(the|und|que|des)([^A-Za-z]|$)")).alias("hits"))


@query(r"""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN 'Add ' ELSE 'Fix ' END || CASE WHEN c_custkey % 3 = 0 THEN 'closes #' || (c_custkey % 50) || ' ' ELSE '(#' || (c_custkey % 40) || ') ' END || c_mktsegment AS message FROM customer)
SELECT id, regexp_extract(message, '(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*:?\s+#([0-9]+)', 1) AS closes, regexp_matches(message, '(?i)\b(fix(?:e[sd]|ing)?|bug(?:fix)?|defect|regression|hotfix|patch(?:ed)?)\b') AS is_fix FROM c""")
def fix_messages(spark: SparkSession, d: str) -> DataFrame:
    """Closing references and fix words of messages."""
    k = F.col("c_custkey")
    message = F.concat(F.when(k % 4 == 1, "Add ").otherwise("Fix "), F.when(k % 3 == 0, F.concat(F.lit("closes #"), (k % 50).cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("(#"), (k % 40).cast("string"), F.lit(") "))), F.col("c_mktsegment"))
    c = table(spark, d, "customer").select(k.alias("id"), message.alias("message"))
    fix = X.classify_fix(F.col("message"))
    return c.select("id", F.array_join(fix["issues"].cast("array<string>"), ",").alias("closes"), fix["is_fix"].alias("is_fix"))


@query(r"""SELECT doc_id, CAST(len(list_filter(string_split_regex(trim(text, E' \n'), '[.!?]\s+'), lambda s: s <> '')) AS BIGINT) AS n_sentences FROM documents""")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every text."""
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split(F.trim(F.col("text"), F.lit(" \n")), r"[.!?]\s+"), lambda s: s != "")).cast("bigint").alias("n_sentences"))


@query(f"""WITH {TOKENS_SQL.format(key='item_id', table='benchmark')}, q AS (SELECT k, w FROM tok GROUP BY 1, 2), {TOKENS_SQL.format(key='doc_id', table="documents").replace('raw', 'raw2').replace('sp ', 'sp2 ').replace('FROM sp', 'FROM sp2').replace('parts', 'parts2').replace('st AS', 'st2 AS').replace('FROM st ', 'FROM st2 ').replace('tok AS', 'tok2 AS').replace('FROM sp22', 'FROM sp2')}, s AS (SELECT k, w FROM tok2 GROUP BY 1, 2), n AS (SELECT k, count(*) AS n FROM q GROUP BY 1)
SELECT q.k AS item_id, s.k AS doc_id, round(CAST(count(*) AS DOUBLE) / n, 4) AS share FROM q JOIN s ON q.w = s.w JOIN n ON n.k = q.k GROUP BY 1, 2, n HAVING CAST(count(*) AS DOUBLE) / n >= 0.25""")
def lexical_support(spark: SparkSession, d: str) -> DataFrame:
    """The share of a claim's tokens in each source, through a join on tokens."""
    claims = table(spark, d, "benchmark").select("item_id", "text")
    hits = shared_terms(claims, table(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id", "text", least=0.25)
    return hits.select("item_id", "doc_id", F.round(F.col("h") / F.col("n"), 4).alias("share"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_matches(url, '\.(md|rst|txt)$|(^|/)docs/') AS is_doc FROM pages""")
def path_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of paths and addresses."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.col("url").rlike(S.DOC_FILES).alias("is_doc"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')) AS n_meaningful FROM l GROUP BY 1""")
def meaningful_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are neither blank nor comments."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(S.meaningful(F.col("line"))).alias("n_meaningful"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) SELECT doc_id, n AS line_no FROM l WHERE regexp_matches(line, '\bthe\b') AND NOT regexp_matches(line, '^\s*(from\s+\S+\s+)?import\s') ORDER BY doc_id, n LIMIT 200""")
def code_search(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a word, in path order, 200 at most (a capped search by its nature)."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    hits = lines.where(F.col("line").rlike(r"\bthe\b") & ~F.col("line").rlike(r"^\s*(from\s+\S+\s+)?import\s"))
    return hits.select("doc_id", (F.col("n") + 1).cast("bigint").alias("line_no")).orderBy("doc_id", "line_no").limit(200)


@query("SELECT doc_id, greatest(CAST(floor(length(text) / 4.0) AS BIGINT), 1) AS tokens, CASE WHEN n_chars > 15000 THEN 'reject' WHEN n_chars > 2500 THEN 'truncate' ELSE 'ok' END AS verdict FROM documents")
def size_guard(spark: SparkSession, d: str) -> DataFrame:
    """Size limits and token estimates."""
    return table(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"), F.when(F.col("n_chars") > 15000, "reject").when(F.col("n_chars") > 2500, "truncate").otherwise("ok").alias("verdict"))


@query("WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c, length(text) AS n FROM benchmark), k AS (SELECT item_id, n, c, count(*) AS k FROM c WHERE c <> '' GROUP BY 1, 2, 3) SELECT item_id, round(-sum(CAST(k AS DOUBLE) / n * log2(CAST(k AS DOUBLE) / n)), 4) AS entropy FROM k GROUP BY 1")
def text_entropy(spark: SparkSession, d: str) -> DataFrame:
    """A5: character entropy in bits."""
    return table(spark, d, "benchmark").select("item_id", F.round(S.text_entropy(F.col("text")), 4).alias("entropy"))


@query("WITH b AS (SELECT source, left(sha256(CAST(doc_id AS VARCHAR)), 2) AS b, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS h FROM documents GROUP BY 1, 2) SELECT source, left(sha256(string_agg(b || h, chr(10) ORDER BY b)), 16) AS print FROM b GROUP BY 1")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Digests of sets of files that do not depend on their order, by way of 256 parts each."""
    ids = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("id"))
    return set_print(ids, "source", "id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_values(spark: SparkSession, d: str) -> DataFrame:
    """Values inside JSON columns, by variant."""
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
