"""Verification of claims: each checker is a set of joins between claims and what execution and the repository show.

Statuses: VERIFIED, REFUTED, UNVERIFIABLE. Claims of all changes are checked together, keyed by run_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import function_key

VERIFIED, REFUTED, UNVERIFIABLE = "VERIFIED", "REFUTED", "UNVERIFIABLE"


def changed_hits(coverage: DataFrame, changed: DataFrame) -> DataFrame:
    """run_id, test_id, file, line: the changed lines that tests execute."""
    return coverage.join(changed.select("run_id", "file", "line").distinct(), ["run_id", "file", "line"]).select("run_id", "test_id", "file", "line").distinct()


def check_test_impact(claims: DataFrame, outcomes: DataFrame, hits: DataFrame, kills: DataFrame) -> DataFrame:
    """run_id, claim_id, status, evidence: a test is impacted if a variant of it runs a changed line, fails, or kills a mutant.

    claims: run_id, claim_id, target; outcomes: run_id, test_id, outcome; kills: run_id, test_id, mutant. Tests that did
    not run leave their claims unverifiable.
    """
    ran = outcomes.select("run_id", "test_id", F.explode(F.array_distinct(F.array("test_id", function_key(F.col("test_id"))))).alias("target"), "outcome")
    executed = hits.groupBy("run_id", "test_id").agg(F.min(F.struct("file", "line")).alias("h")).select("run_id", "test_id", F.concat(F.lit("exec:"), "test_id", F.lit("->"), "h.file", F.lit("#L"), F.col("h.line").cast("string")).alias("x"))
    killed = kills.groupBy("run_id", "test_id").agg(F.concat(F.lit("kill:"), F.min("mutant")).alias("k"))
    facts = ran.join(executed, ["run_id", "test_id"], "left").join(killed, ["run_id", "test_id"], "left")
    fail = F.when(F.col("outcome").isin("failed", "error"), F.concat(F.lit("fail:"), "test_id"))
    per = facts.select("run_id", "target", "test_id", F.array_compact(F.array("x", fail, "k")).alias("e"))
    found = per.groupBy("run_id", "target").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("e")))).alias("e"), F.slice(F.array_sort(F.collect_set("test_id")), 1, 3).alias("ids"))
    out = claims.join(found, ["run_id", "target"], "left")
    status = F.when(F.col("ids").isNull(), UNVERIFIABLE).when(F.size("e") > 0, VERIFIED).otherwise(REFUTED)
    evidence = F.when(F.size("e") > 0, F.slice("e", 1, 6)).otherwise(F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda t: F.concat(F.lit("run:"), t)))
    return out.select("run_id", "claim_id", status.alias("status"), evidence.alias("evidence"))


def check_module_impact(claims: DataFrame, reached: DataFrame, executed: DataFrame, hits: DataFrame) -> DataFrame:
    """run_id, claim_id, status: no call path refutes; a path and a test that runs both the module and a changed line verifies.

    claims: run_id, claim_id, target (module path); reached: run_id, path (modules on call paths to the change);
    executed: run_id, test_id, file.
    """
    path = reached.select("run_id", F.col("path").alias("target")).distinct().withColumn("p", F.lit(1))
    both = executed.select("run_id", "test_id", F.col("file").alias("target")).join(hits.select("run_id", "test_id").distinct(), ["run_id", "test_id"]).select("run_id", "target").distinct().withColumn("b", F.lit(1))
    out = claims.join(path, ["run_id", "target"], "left").join(both, ["run_id", "target"], "left")
    return out.select("run_id", "claim_id", F.when(F.col("p").isNull(), REFUTED).when(F.col("b").isNotNull(), VERIFIED).otherwise(UNVERIFIABLE).alias("status"))


def check_api_break(claims: DataFrame, units: DataFrame, callers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """run_id, claim_id, status: callers and failing tests, or callers and an incompatible signature, verify.

    units: run_id, target, incompatible (text or null); callers: run_id, target, caller (no tests).
    """
    n = callers.groupBy("run_id", "target").agg(F.count("*").alias("n"))
    failing = outcomes.where(F.col("outcome").isin("failed", "error")).select("run_id").distinct().withColumn("f", F.lit(1))
    out = claims.join(units.select("run_id", "target", "incompatible", F.lit(1).alias("known")), ["run_id", "target"], "left").join(n, ["run_id", "target"], "left").join(failing, "run_id", "left")
    called = F.coalesce("n", F.lit(0)) > 0
    status = F.when(F.col("known").isNull(), UNVERIFIABLE).when(called & F.col("f").isNotNull(), VERIFIED).when(called & F.col("incompatible").isNotNull(), VERIFIED).otherwise(REFUTED)
    return out.select("run_id", "claim_id", status.alias("status"))


def check_history_link(claims: DataFrame, commits: DataFrame, records: DataFrame, aliases: DataFrame, has_tracker: bool) -> DataFrame:
    """run_id, claim_id, status, confirmed: every citation must exist, and commits must touch the file under any of its names.

    claims: run_id, claim_id, target, evidence_ids; commits: sha, path (touched files); records: id (issue:n, pr:n);
    aliases: path, alias. Without tracker data absent issues prove nothing; without a commit nothing ties the link to the code.
    """
    refs = claims.select("run_id", "claim_id", F.substring_index("target", "::", 1).alias("path"), F.explode_outer("evidence_ids").alias("ref"))
    names = refs.join(aliases, "path", "left").select("run_id", "claim_id", "ref", F.coalesce("alias", "path").alias("path")).unionByName(refs.select("run_id", "claim_id", "ref", "path")).distinct()
    cited = names.where("ref like 'commit:%'").withColumn("key", F.substring("ref", 8, 64))
    touched = commits.select(F.explode(F.array("sha", F.left("sha", F.lit(10)))).alias("key"), "path").distinct()
    good = cited.join(touched, ["key", "path"], "left_semi").select("run_id", "claim_id", "ref").distinct()
    known = refs.where("ref not like 'commit:%'").join(records.select(F.col("id").alias("ref")), "ref", "left_semi").select("run_id", "claim_id", "ref")
    ok = good.unionByName(known).distinct().withColumn("ok", F.lit(1))
    judged = refs.select("run_id", "claim_id", "ref").distinct().join(ok, ["run_id", "claim_id", "ref"], "left")
    commit = F.coalesce(F.col("ref").startswith("commit:"), F.lit(False))
    bad = F.col("ref").isNotNull() & F.col("ok").isNull() & (commit | F.lit(has_tracker))
    per = judged.groupBy("run_id", "claim_id").agg(F.bool_or(bad).alias("bad"), F.bool_or(commit & F.col("ok").isNotNull()).alias("tied"), F.array_sort(F.collect_set(F.when(F.col("ok").isNotNull(), F.col("ref")))).alias("confirmed"))
    status = F.when(F.col("bad"), REFUTED).when(~F.col("tied"), UNVERIFIABLE).otherwise(VERIFIED)
    return per.select("run_id", "claim_id", status.alias("status"), "confirmed")


def impact_claims(hits: DataFrame, static: DataFrame, modules: DataFrame, api: DataFrame, far: int = 3) -> DataFrame:
    """run_id, type, target, evidence: claims by rule.

    hits: run_id, test_id (tests that cover changed lines); static: run_id, test_id, distance; modules: run_id, path,
    evidence; api: run_id, target, caller. Covered tests are not claimed again for being reachable.
    """
    covered = hits.select("run_id", function_key(F.col("test_id")).alias("target")).distinct()
    one = covered.select("run_id", F.lit("test_impact").alias("type"), "target", F.array(F.concat(F.lit("cov:"), "target")).alias("evidence"))
    near = static.where(F.col("distance") <= far).select("run_id", function_key(F.col("test_id")).alias("target")).distinct().join(covered, ["run_id", "target"], "left_anti")
    two = near.select("run_id", F.lit("test_impact").alias("type"), "target", F.array(F.concat(F.lit("graph:calls:"), "target")).alias("evidence"))
    three = modules.groupBy("run_id", F.col("path").alias("target")).agg(F.slice(F.array_sort(F.collect_set("evidence")), 1, 4).alias("evidence")).select("run_id", F.lit("module_impact").alias("type"), "target", "evidence")
    calls = F.slice(F.array_sort(F.collect_set(F.concat(F.lit("graph:calls:"), "caller", F.lit("->"), "target"))), 1, 3)
    four = api.groupBy("run_id", "target").agg(calls.alias("c")).select("run_id", F.lit("api_break").alias("type"), "target", F.concat(F.array(F.concat(F.lit("sig:"), "target")), "c").alias("evidence"))
    return one.unionByName(two).unionByName(three).unionByName(four)


def history_features(links: DataFrame, history: DataFrame) -> DataFrame:
    """run_id, szz_bug_fixes, szz_introducers, bug_issues, history_commits, history_authors.

    links: run_id, fix_sha, introducing_sha, issue; history: run_id, unit, sha, author, is_fix.
    """
    a = links.groupBy("run_id").agg(F.collect_set("fix_sha").alias("fixes"), F.countDistinct("introducing_sha").alias("szz_introducers"), F.countDistinct("issue").alias("bug_issues"))
    b = history.groupBy("run_id").agg(F.collect_set(F.when(F.col("is_fix"), F.col("sha"))).alias("own"), F.count("*").alias("history_commits"), F.countDistinct("author").alias("history_authors"))
    none = F.array().cast("array<string>")
    both = a.join(b, "run_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double").alias(c)
    return both.select("run_id", F.size(F.array_union(F.coalesce("fixes", none), F.coalesce("own", none))).cast("double").alias("szz_bug_fixes"), zero("szz_introducers"), zero("bug_issues"), zero("history_commits"), zero("history_authors"))


def resolve_evidence(cited: Column, allowed: Column) -> Column:
    """The known ids that a citation means: itself, else ids among its words, else the id with a coverage prefix."""
    words = F.array_distinct(F.filter(F.split(cited, r"[\s,;()]+"), lambda w: F.array_contains(allowed, w)))
    prefixed = F.slice(F.filter(F.array(F.concat(F.lit("cov:"), cited), F.concat(F.lit("covsym:"), cited)), lambda w: F.array_contains(allowed, w)), 1, 1)
    return F.when(F.array_contains(allowed, cited), F.array(cited)).when(F.size(words) > 0, words).otherwise(prefixed)


def mutant_status(covered: Column, timeout: Column, broken: Column, killed: Column) -> Column:
    """survived without a covering test; else timeout, killed (by a broken collection or a test), survived."""
    return F.when(~covered, "survived").when(timeout, "timeout").when(broken | killed, "killed").otherwise("survived")


def llm_route(base: Column, diff_lines: Column, units: Column, tokens: Column, budget_left: Column | None = None) -> Column:
    """struct(complexity, tier): easy under 0.35, medium under 0.7, else hard; easy when the budget runs low."""
    score = F.round(F.least(base + F.least(diff_lines / 800, F.lit(1.0)) * 0.2 + F.least(units / 12, F.lit(1.0)) * 0.15 + F.least(tokens / 12000, F.lit(1.0)) * 0.1, F.lit(1.0)), 3)
    tier = F.when(score < 0.35, "easy").when(score < 0.7, "medium").otherwise("hard")
    if budget_left is not None:
        tier = F.when(budget_left < 8000, "easy").otherwise(tier)
    return F.struct(score.alias("complexity"), tier.alias("tier"))
