"""Sources: commit logs, trackers, coverage contexts, test reports, event logs, source trees, settings."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import rename_side
from riskloom.functions.text import classify_fix
from riskloom.operators.storage import exists
from riskloom.schemas import schema

RECORD, FIELD = "\x1e", "\x1f"


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log whose records end with \\x1e and fields with \\x1f: sha, parents, author, email, seconds, message, END, numstat."""
    raw = spark.read.text(path, lineSep=RECORD).where(F.col("value").contains(FIELD))
    return parse_commits(raw)


def parse_commits(raw: DataFrame) -> DataFrame:
    """raw: value. Numstat lines without three parts are skipped; a binary file's dash counts 0."""
    head = F.split(F.substring_index("value", f"{FIELD}END{FIELD}", 1), FIELD, 6)
    stat = F.split(F.substring_index("value", f"{FIELD}END{FIELD}", -1), "\n")
    number = lambda c: F.coalesce(F.try_to_number(c, F.lit("999999999")).cast("int"), F.lit(0))
    parts = F.filter(F.transform(stat, lambda x: F.split(x, "\t")), lambda p: F.size(p) == 3)
    files = F.transform(parts, lambda p: F.struct(rename_side(p[2]).alias("path"), number(p[0]).alias("additions"), number(p[1]).alias("deletions"), F.when(p[2].contains(" => "), rename_side(p[2], new=False)).alias("renamed_from")))
    rows = raw.select(F.trim(head[0]).alias("sha"), F.filter(F.split(head[1], " "), lambda x: x != "").alias("parents"), head[5].alias("message"), head[2].alias("author"), head[3].alias("email"), F.timestamp_seconds(head[4].cast("long")).alias("ts"), files.alias("files"))
    sums = lambda c: F.aggregate(F.transform("files", lambda f: f[c]), F.lit(0), lambda a, x: a + x)
    fix = classify_fix(F.col("message"))
    return rows.withColumn("additions", sums("additions")).withColumn("deletions", sums("deletions")).withColumn("is_fix", fix["is_fix"]).withColumn("issues", fix["issues"])


def mine(commits: DataFrame, prefix: str = "") -> DataFrame:
    """Commits that are no merges and touch files under a prefix, which is cut off; oldest first."""
    inside = F.filter("files", lambda f: f["path"].startswith(prefix))
    cut = F.transform(inside, lambda f: F.struct(F.substring(f["path"], F.lit(len(prefix) + 1), F.length(f["path"])).alias("path"), f["additions"].alias("additions"), f["deletions"].alias("deletions"), f["renamed_from"].alias("renamed_from")))
    return commits.where(F.size("parents") < 2).withColumn("files", cut).where(F.size("files") > 0).orderBy("ts", "sha")


def tracker(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Issues or prs of a JSON array file with the table's schema; a missing file is an empty table."""
    return spark.read.schema(schema(kind)).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema(kind))


def coverage(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, imports) of file, line, context: (file, line, test_id) once each, the phase after | cut; lines without a context."""
    test = F.substring_index("context", "|", 1)
    named = contexts.where("context <> ''").select("file", "line", test.alias("test_id")).where("test_id <> ''").distinct()
    return named, contexts.where("context = ''").select("file", "line").distinct()


def test_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("test_id string, file string, duration double, outcome string").option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a JSON lines file; blank, broken and torn lines are dropped."""
    return spark.read.schema(schema(kind)).option("mode", "DROPMALFORMED").json(path)


def source_tree(spark: SparkSession, path: str, skip: list[str] | None = None) -> DataFrame:
    """path, text of the Python files under a folder, without skipped folders; line ends are \\n."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py").select(F.col("_metadata.file_path").alias("full"), "value")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/") + "/"
    rel = F.expr("substring(full, instr(full, root) + length(root))")
    rows = files.withColumn("root", F.lit(root)).select(rel.alias("path"), F.replace(F.col("value"), F.lit("\r\n"), F.lit("\n")).alias("text"))
    for folder in skip or [".git", "__pycache__", ".venv", "node_modules"]:
        rows = rows.where(~F.concat(F.lit("/"), "path").contains(f"/{folder}/"))
    return rows


def blame(rows: DataFrame) -> DataFrame:
    """sha, path, low, high of each run of lines that one commit last changed; rows: path, line, sha."""
    from riskloom.operators.relations import islands

    return islands(rows, ["path", "sha"], "line")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event log's files."""
    return spark.readStream.schema(schema("events")).json(path)


def settings(base: dict, repo: dict | None = None, overrides: dict | None = None, prefix: str = "RISKLOOM__", env: dict | None = None) -> dict:
    """Nested settings: base, then the repository's, then variables PREFIX A__B=value, then overrides; types follow the base."""

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(a.get(k), dict) and isinstance(v, dict) else v for k, v in b.items()}

    def typed(old, text: str):
        if isinstance(old, bool):
            return text.strip().lower() in ("1", "true", "yes", "on")
        if isinstance(old, (int, float)):
            return type(old)(text)
        return json.loads(text) if isinstance(old, list) else text

    out = merge(base, repo or {})
    for name, text in (os.environ if env is None else env).items():
        if name.startswith(prefix):
            keys = name[len(prefix) :].lower().split("__")
            old = out
            for k in keys:
                old = old.get(k) if isinstance(old, dict) else None
            tree = typed(old, text)
            for k in reversed(keys):
                tree = {k: tree}
            out = merge(out, tree)
    return merge(out, overrides or {})


def env_file(text: str) -> dict[str, str]:
    """Names and values of a .env text; comments, export and quotes are taken off."""
    out = {}
    for line in text.splitlines():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value.split(" #")[0].strip()
    return out


def latest_prompts(prompts: DataFrame, pinned: dict[str, int] | None = None) -> DataFrame:
    """name, version, text: the latest version of each prompt, unless pinned."""
    pins = prompts.sparkSession.createDataFrame(list((pinned or {}).items()), "name string, pin int")
    rows = prompts.join(pins, "name", "left").where("pin is null or version = pin")
    return rows.groupBy("name").agg(F.max_by(F.struct("version", "text"), "version").alias("p")).select("name", "p.*")
