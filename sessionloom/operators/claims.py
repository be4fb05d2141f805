"""Claims of agents, the evidence for them, and the breaks between the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import hash_tokens, path_tokens, trimmed
from sessionloom.sources.shared import written

# The phrases of claims, English and Polish, in order; the first whose words stand in a line side by side decides.
CLAIMS = (
    ("no_blockers", ("no blocker", "no blockers", "zero blocker", "zero blockers", "bez blokerów", "bez blokerow")),
    ("blocked", ("blocked", "blocker", "blockers", "zablokowane")),
    ("ready_to_push", ("production ready", "ready to push", "ready to ship", "ready to merge", "gotowe do push", "gotowe do pusha", "można pushować", "mozna pushowac")),
    ("shippable", ("shippable", "ship it")),
    ("migrated", ("migration complete", "migrated")),
    ("installed", ("installed",)),
    ("implemented", ("wdrożone", "wdrozone")),
    ("documented", ("docs updated", "documented")),
    ("verified", ("verified", "działa", "dziala")),
    ("green", ("all green", "tests green", "green", "wszystko zielone", "testy zielone", "zielone")),
    ("tested", ("tests pass", "passing", "tested", "przetestowane", "testy przechodzą", "testy przechodza")),
    ("fixed", ("fixed", "naprawione", "naprawiłem", "naprawilem")),
    ("implemented", ("implemented", "shipped", "complete", "completed", "done", "zrobione", "gotowe")),
)
#: Applause: such claims need direct evidence.
HIGH_RISK = ("green", "ready_to_push", "shippable", "no_blockers")
#: Parts of a class of claims that meet evidence in tasks of their own.
PARTS = 32


def claim_type(line: Column) -> Column:
    """The first rule with a phrase among the words of the line; words are letters and digits, so incomplete is not complete."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(line), r"[^\p{IsAlphabetic}\p{N}]+", " "), F.lit(" "))
    found = None
    for name, phrases in CLAIMS:
        test = padded.rlike(" (?:" + "|".join(phrases) + ") ")
        found = F.when(test, name) if found is None else found.when(test, name)
    return found


def _first_line(message: Column) -> Column:
    return F.get(F.filter(F.transform(F.split(message, "\n"), trimmed), lambda x: x != ""), 0)


def claims(timeline: DataFrame) -> DataFrame:
    """One claim per reply whose first non-empty line makes one, with the commits and the files that it names."""
    replies = timeline.where(F.lower("role").isin("assistant", "agent", "model", "gemini")).withColumn("line", _first_line(F.col("message")))
    typed = replies.withColumn("claim_type", claim_type(F.col("line"))).where("line is not null and claim_type is not null")
    about = F.lower("line")
    tests = F.contains(about, F.lit("test")) | F.contains(about, F.lit("green")) | F.contains(about, F.lit("zielon"))
    return typed.select(
        F.concat(F.lit("k"), "source_seq").alias("id"), "project", "session_id", "ts", "source_seq", "claim_type", F.col("claim_type").isin(*HIGH_RISK).alias("high_risk"),
        "line", F.sha2("line", 256).alias("line_sha"), hash_tokens(F.col("line")).alias("hashes"), path_tokens(F.col("line")).alias("files"), tests.alias("about_tests"),
    )


def failing(excerpt: Column) -> Column:
    """Whether a line reports a test result and the word failed, in any case."""
    return F.exists(F.split(excerpt, "\n"), lambda x: F.contains(x, F.lit("test result:")) & F.contains(F.lower(x), F.lit("failed")))


def evidence(timeline: DataFrame, claims: DataFrame) -> DataFrame:
    """What users and the system report: test runs and commits, with the claim of the session that stands last before them."""
    test = F.contains("message", F.lit("test result:"))
    rows = timeline.where((F.col("frame_kind") != "agent_reply") & (test | F.startswith("message", F.lit("commit "))))
    kind = F.when(test, "test_run").otherwise("commit")
    line = F.when(test, F.get(F.filter(F.split("message", "\n"), lambda x: F.contains(x, F.lit("test result:"))), 0)).otherwise(_first_line(F.col("message")))
    found = rows.select(F.concat(F.lit("e"), "source_seq").alias("evidence_id"), "project", "session_id", "source_seq", kind.alias("kind"), trimmed(line).alias("excerpt"))
    both = found.select("session_id", "source_seq", "evidence_id", F.lit(None).cast("string").alias("id")).unionByName(claims.select("session_id", "source_seq", F.lit(None).cast("string").alias("evidence_id"), "id"))
    last = F.last("id", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("source_seq"))
    nearest = both.withColumn("claim_id", last).where("evidence_id is not null").select("evidence_id", "claim_id")
    commit = F.col("kind") == "commit"
    none = F.array().cast("array<string>")
    return found.join(nearest, "evidence_id").select(
        "evidence_id", "project", "kind", "claim_id", "excerpt", (~commit & failing(F.col("excerpt"))).alias("fails"),
        F.when(commit, hash_tokens(F.col("excerpt"))).otherwise(none).alias("hashes"), F.when(commit, path_tokens(F.col("excerpt"))).otherwise(none).alias("files"),
    )


def linked(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, evidence_id, direct, fails): the claim before it in the session, or a commit or a file that both name in a project.

    Claims that name the same are one class, evidence likewise, and classes meet by the exploded names. The pairs of the
    members of classes that met are the result and are made last, a class of claims in ``PARTS`` parts by id, so that no
    pair is shuffled and common names are many tasks.
    """
    names = lambda df: df.select("*", F.array_sort(F.array_distinct("hashes")).alias("h"), F.array_sort(F.array_distinct("files")).alias("f")).drop("hashes", "files")
    key = lambda: F.struct("project", "h", "f")
    ours, theirs = names(claims.select("id", "project", "hashes", "files")), names(evidence.select("evidence_id", "project", "claim_id", "fails", "hashes", "files"))
    named = F.concat(F.transform("h", lambda x: F.struct(F.lit("h").alias("k"), x.alias("x"))), F.transform("f", lambda x: F.struct(F.lit("f").alias("k"), x.alias("x"))))
    each = lambda df, name: df.select(key().alias(name)).distinct().select(name, f"{name}.*").select(name, "project", F.explode(named).alias("named"))
    met = written(each(ours, "a").join(each(theirs, "b"), ["project", "named"]).select("a", "b").distinct(), "met")
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    pairs = ours.select("id", key().alias("a"), part.alias("part")).join(met.select("a", "b", parts), ["a", "part"]).select("id", "b", "part")
    facts = theirs.select("evidence_id", "claim_id", "fails", key().alias("b"), parts)
    pairs = pairs.join(facts, ["b", "part"]).select("id", "evidence_id", F.coalesce(F.col("id") == F.col("claim_id"), F.lit(False)).alias("direct"), "fails")
    before = theirs.where("claim_id is not null").join(ours.select("id", key().alias("a")), F.col("claim_id") == F.col("id"), "left")
    own = before.withColumn("b", key()).join(met, ["a", "b"], "left_anti")
    return pairs.unionByName(own.select(F.col("claim_id").alias("id"), "evidence_id", F.lit(True).alias("direct"), "fails"))


def audited(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, project, status, text): the result of each claim that evidence matches, one at most.

    A failing test run fails a claim; otherwise what matches passes it, but a high-risk claim only by direct evidence.
    Test runs match all claims about tests in their project; these are counted by project, not joined pair by pair.
    """
    direct = evidence.where("claim_id is not null").groupBy(F.col("claim_id").alias("id")).agg(F.lit(True).alias("direct"), F.bool_or("fails").alias("fails"))
    sides = [direct]
    for of in ("hashes", "files"):  # what evidence says of a commit or a file is one row before claims meet it
        said = evidence.select("project", "fails", F.explode(of).alias("named")).groupBy("project", "named").agg(F.bool_or("fails").alias("fails"))
        ours = claims.select("id", "project", F.explode(of).alias("named"))
        sides.append(ours.join(said, ["project", "named"]).select("id", F.lit(False).alias("direct"), "fails"))
    of_claim = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy("id").agg(F.bool_or("direct").alias("direct"), F.bool_or("fails").alias("fails"))
    runs = evidence.where("kind = 'test_run'").groupBy("project").agg(F.bool_or("fails").alias("run_fails"), F.min(F.when(F.col("fails"), F.col("excerpt"))).alias("failure"))
    known = claims.join(of_claim, "id", "left").join(runs, "project", "left")
    run = F.col("about_tests") & F.col("run_fails").isNotNull()
    fails = F.coalesce("fails", F.lit(False)) | (run & F.col("run_fails"))
    matched = F.col("fails").isNotNull() | run
    direct = F.coalesce("direct", F.lit(False))
    status = F.when(fails, "fail").when(~F.col("high_risk") | direct, "pass")
    note = F.when(fails, "Audited against test run output (failing)").when(direct, "Audited and verified via matching direct evidence record").otherwise("Audited and verified via matching circumstantial evidence record")
    return known.where(matched).select(F.col("id").alias("claim_id"), "project", status.alias("status"), note.alias("text")).where("status is not null")


def artifacts(claims: DataFrame, repo_files: DataFrame) -> DataFrame:
    """(claim_id, project, status, text): for each file that a claim names whether ``repo_files`` (path) holds it."""
    named = claims.select(F.col("id").alias("claim_id"), "project", F.explode("files").alias("path"))
    there = repo_files.select("path", F.lit(True).alias("there")).distinct()
    known = named.join(there, "path", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    text = F.concat("path", F.when(F.col("there"), ": exists").otherwise(": NOT FOUND"), F.lit(" ls-level filesystem check, re-runnable"))
    return known.select("claim_id", "project", F.when(F.col("there"), "pass").otherwise("fail").alias("status"), text.alias("text"))


def verified(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claims with the numbers of their passing and failing results: verified, contradicted, partial, or unverified."""
    facts = results.groupBy(F.col("claim_id").alias("id")).agg(F.count_if(F.col("status") == "pass").alias("passes"), F.count_if(F.col("status") == "fail").alias("failures"))
    known = claims.join(facts, "id", "left").na.fill(0, ["passes", "failures"])
    p, f = F.col("passes"), F.col("failures")
    status = F.when((p == 0) & (f == 0), "unverified").when(f == 0, "verified").when(p == 0, "contradicted").otherwise("partial")
    return known.select("id", "project", "session_id", "ts", "claim_type", "high_risk", "passes", "failures", status.alias("status"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 3)


def orphans(intents: DataFrame, claims: DataFrame, results: DataFrame) -> DataFrame:
    """The ``intents`` (``project``, ``summary``) that no claim and no result of their project addresses.

    One addresses an intent if a word of at least three bytes of either holds one of the other, or one text the other.
    A word that holds another holds its first three characters, so words are joined by project and trigram; texts without
    such words are joined by project.
    """
    texts = claims.select("project", F.col("line").alias("text")).unionByName(results.select("project", "text")).distinct()
    ours = intents.select("project", "summary", F.explode(_words(F.col("summary"))).alias("w"))
    mine, theirs = ours.select("project", "w").distinct(), texts.select("project", F.explode(_words(F.col("text"))).alias("v")).distinct()
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: w.substr(i, F.lit(3))))
    holds = mine.withColumn("g", F.explode(grams(F.col("w")))).join(theirs.withColumn("g", F.substring("v", 1, 3)), ["project", "g"]).where(F.contains("w", F.col("v")))
    held = mine.withColumn("g", F.substring("w", 1, 3)).join(theirs.withColumn("g", F.explode(grams(F.col("v")))), ["project", "g"]).where(F.contains("v", F.col("w")))
    hit = holds.select("project", "w").unionByName(held.select("project", "w")).distinct()
    addressed = ours.join(hit, ["project", "w"]).select("project", "summary")
    bare = intents.where(F.size(_words(F.col("summary"))) == 0).select("project", "summary").distinct().join(texts, "project")
    low = lambda c: F.lower(c)
    addressed = addressed.unionByName(bare.where(F.contains(low("text"), low("summary")) | F.contains(low("summary"), low("text"))).select("project", "summary")).distinct()
    return intents.join(addressed, ["project", "summary"], "left_anti")


def fractures(verified: DataFrame, orphans: DataFrame) -> DataFrame:
    """Contradicted claims (critical if high risk, else high), unverified high-risk claims (medium), orphan intents (low)."""
    severity = F.when((F.col("status") == "contradicted") & F.col("high_risk"), "critical").when(F.col("status") == "contradicted", "high").when((F.col("status") == "unverified") & F.col("high_risk"), "medium")
    broken = verified.withColumn("severity", severity).where("severity is not null").select("id", "project", "session_id", "ts", "severity")
    lost = orphans.select(F.concat(F.lit("i"), "source_seq").alias("id"), "project", "session_id", "ts", F.lit("low").alias("severity"))
    return broken.unionByName(lost)


def clarify(fractures: DataFrame, most: int = 5) -> DataFrame:
    """What to ask first: the severest, the newest."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return fractures.orderBy(rank, F.desc_nulls_last("ts"), "id").limit(min(most, 5))
