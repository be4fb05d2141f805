"""Intents, decisions, tasks and outcomes found in the timeline, and what happens to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import byte_cut, compact, evidence_tokens, normalize_key, sentence_cut, severity, trimmed
from sessionloom.operators import linerules
from sessionloom.operators.search import garbled
from sessionloom.sources.shared import written

# Words that say nothing about what a record is about.
STOP_WORDS = (
    "fix", "fixed", "fixing", "ship", "shipped", "shipping", "implement", "implemented", "implementing", "add", "added", "adding", "test", "tests", "tested", "testing", "run", "running", "done", "completed",
    "complete", "finished", "finish", "working", "works", "success", "successfully", "fail", "failed", "with", "for", "and", "the", "a", "an", "in", "on", "at", "to", "of", "from", "by", "that", "this", "is",
    "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "as", "or",
    "napraw", "naprawione", "naprawiłem", "wdrożone", "wdrozone", "wdrożyłem", "dodaj", "dodane", "dodałem", "zrobione", "zrobiłem", "gotowe", "dziala", "działa", "test", "testy", "przetestowane", "uruchom",
    "uruchomione", "sukces", "porażka", "błąd", "bledu", "bledy", "błędy", "z", "do", "na", "w", "o", "i", "a", "lub", "dla", "przez", "pod", "po", "działające",
)
#: Bytes of a record's context.
CONTEXT_BYTES = 240
#: The labels that a summary loses, by its kind, one after the other.
LABELS = {"decision": ("[decision]", "decision:"), "outcome": ("[skill_outcome]", "outcome:", "validation:"), "intent": ("[intent]", "intent:", "question:", "why:"), "task": ()}


def clean_summary(kind: Column, line: Column) -> Column:
    """A line without the bullet and the labels of its kind, white space collapsed."""
    bare = trimmed(F.regexp_replace(trimmed(line), r"^- ", ""))
    found = bare
    for name, labels in LABELS.items():
        own = bare
        for label in labels:
            own = F.regexp_replace(own, "(?i)^" + linerules._either([label]) + r"[ \-:]*\s*", "")
        found = F.when(kind == name, own).otherwise(found) if labels else found
    return compact(found)


def context(before: Column, behind: Column) -> Column:
    """What stands around a line, joined; metadata and printed output are left out; null if that is nothing."""
    plain = lambda x: F.when(x.isNotNull() & ~linerules.is_source_metadata(trimmed(x)) & ~linerules.is_command_output(x), F.nullif(compact(x), F.lit("")))
    return F.nullif(F.concat_ws(" | ", plain(before), plain(behind)), F.lit(""))


def is_heading_context(text: Column) -> Column:
    """Whether all parts of a context are numbered headings of at most four words."""
    parts = F.transform(F.split(text, r"\|"), trimmed)
    return ~F.exists(parts, lambda p: ~p.rlike(r"^[0-9.)]*[0-9][0-9.)]*(?:\s+\S+){0,3}$"))


def candidates(timeline: DataFrame) -> DataFrame:
    """The lines that are decisions, intents, tasks or outcomes, with summary, context, evidence and confidence 1 to 5.

    Messages that the tool put in, runs of commit lines, metadata and printed output are left out. Checklist items are
    tasks. Replies and tools never give outcomes. An intent with neither context nor evidence must not read garbled.
    """
    tasks = int(timeline.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    timeline = timeline.repartition(tasks, "source_seq")  # a small file is one task, and its lines are much work
    user = F.lower("role") == "user"
    kept = ("project", "agent", "session_id", "ts", "source_seq", "day", "frame_kind", "role")
    rows = linerules.message_lines(timeline.where(~linerules.is_injected(F.col("role"), F.col("message"))), *kept)
    rows = rows.where(~linerules.in_commit_block()).withColumn("text", trimmed(F.col("line")))
    rows = rows.where((F.col("text") != "") & ~linerules.is_source_metadata(F.col("text")) & ~linerules.is_command_output(F.col("text")))
    mark, task = (F.regexp_extract("text", r"^[-*+]\s*\[([ xX])\]\s*(\S.*)$", k) for k in (1, 2))
    rows = linerules.once(rows, mark=mark, task=task, e=linerules.entry_type(F.col("text"), user))
    is_task = F.col("task") != ""
    rows = linerules.once(rows, kind=F.when(is_task, "task").otherwise(linerules.line_kind(F.col("text"), user, F.col("e"))))
    quiet = (F.col("frame_kind").isin("agent_reply", "tool_call") | F.startswith(F.lower("role"), F.lit("tool"))) & (F.col("kind") == "outcome")
    rows = rows.where(F.col("kind").isNotNull() & ~F.coalesce(quiet, F.lit(False)))
    full = F.when(is_task, compact(F.col("task"))).otherwise(clean_summary(F.col("kind"), F.col("text")))
    rows = linerules.once(rows, full=full, around=context(F.col("before"), F.col("behind"))).where((F.col("full") != "") & ~linerules.is_bare_heading(F.col("full")))
    said = F.when((normalize_key(F.col("around")) != normalize_key(F.col("full"))) & ~is_heading_context(F.col("around")), byte_cut(F.col("around"), CONTEXT_BYTES))
    rows = linerules.once(rows, context=said)
    rows = linerules.once(rows, evidence=evidence_tokens(F.concat_ws(" ", "full", "context")))
    bare = F.col("context").isNull() & (F.size("evidence") == 0)
    rows = rows.where(~((F.col("kind") == "intent") & bare & garbled(F.col("full"))))
    urgent = (F.col("kind") == "intent") & severity(F.col("full")).isNotNull()
    points = F.when(F.col("kind") == "intent", 2).otherwise(3) + F.col("context").isNotNull().cast("int") + (F.size("evidence") > 0).cast("int") + urgent.cast("int")
    own_type = F.when(user & ~is_task & (linerules.kind_of_type(F.col("e.type")) == F.col("kind")), F.col("e.type")).otherwise(F.col("kind"))
    state = F.when(F.col("mark") == " ", "open").when(F.lower("mark") == "x", "done")
    return rows.select(*kept[:6], "line_no", "kind", own_type.alias("type"), sentence_cut(F.col("full")).alias("summary"), F.least(F.lit(5), points).alias("confidence"), state.alias("state"), "context", "evidence")


def user_lines(timeline: DataFrame) -> DataFrame:
    """The typed lines of users, human or operators, that are no results or outcomes; of equal lines the first."""
    said = timeline.where(F.lower("role").isin("user", "human", "operator"))
    typed = linerules.message_lines(said, "source_seq", "session_id", "ts").withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    typed = linerules.once(typed, type=linerules.entry_type(F.col("line"), F.lit(True))["type"])
    typed = typed.where(F.col("type").isNotNull() & ~F.col("type").isin("result", "outcome"))
    first = F.struct("source_seq", "line_no", "type", "session_id", "ts")
    return typed.groupBy("line").agg(F.min(first).alias("f")).select("line", "f.source_seq", "f.type", "f.session_id", "f.ts")


def merged(candidates: DataFrame) -> DataFrame:
    """One record per (kind, project, normalised summary): best confidence, longest summary, the latest provenance."""
    key = normalize_key(F.col("summary"))
    latest = F.struct("ts", "confidence", "source_seq")
    return candidates.groupBy("kind", "project", key.alias("key")).agg(
        F.max("confidence").alias("confidence"),
        F.max_by("summary", F.struct(F.length("summary"), F.col("summary"))).alias("summary"),
        F.max_by("session_id", latest).alias("session_id"),
        F.max_by("agent", latest).alias("agent"),
        F.max("ts").alias("ts"),
        F.count("*").alias("evidence"),
    )


def open_tasks(candidates: DataFrame) -> DataFrame:
    """Tasks by normalised summary alone: the last event decides, and only open ones are left."""
    tasks = candidates.where(F.col("kind") == "task").withColumn("key", normalize_key(F.col("summary")))
    last = F.struct("ts", "source_seq")
    return tasks.groupBy("key").agg(F.max_by(F.coalesce("state", F.lit("open")), last).alias("state"), F.max("ts").alias("ts"), F.count("*").alias("events")).where("state = 'open'").drop("state")


def unresolved(candidates: DataFrame) -> DataFrame:
    """Intents of sessions without an outcome."""
    done = candidates.where("kind = 'outcome'").select("session_id").distinct()
    return candidates.where("kind = 'intent'").join(done, "session_id", "left_anti")


def significant_words(summary: Column) -> Column:
    """The sorted distinct words of two bytes and more that are no stop words; dashes and underscores belong to words."""
    words = F.split(F.lower(summary), r"[^\p{IsAlphabetic}\p{N}_-]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))))


def answered(candidates: DataFrame) -> DataFrame:
    """Intents with the outcome of their project that shares most words with them, the first of several.

    It must share half of the words of the shorter one, or all where these are two or less. Equal word sets are one row
    before anything is joined. Two sets are only met through one of the rarest words of the shorter one, of which so many
    are taken that a match must hold one of them; so a word that very many records have joins nothing. Where a record has
    no significant words, one text, letters and digits only, must hold the other.
    """
    rows = candidates.where(F.col("kind").isin("intent", "outcome")).select("project", "kind", "source_seq", significant_words(F.col("summary")).alias("words"), F.lower(F.regexp_replace("summary", r"[^\p{IsAlphabetic}\p{N}]", "")).alias("bare"))
    rows = written(rows, "records")
    plain = rows.where(F.size("words") > 0)
    sets = plain.groupBy("project", "kind", "words").agg(F.min("source_seq").alias("first"))
    each = sets.select("project", "kind", "first", "words", F.explode("words").alias("w"))
    often = each.groupBy("project", "w").agg(F.count("*").alias("n"))
    size = F.size("words")
    need = F.when(size <= 2, size).otherwise(F.ceil(size / 2))
    rank = F.row_number().over(Window.partitionBy("project", "kind", "words").orderBy("n", "w"))
    each = each.join(often, ["project", "w"]).withColumn("rare", rank <= size - need + 1)
    ours = each.where("kind = 'intent'").select("project", "w", F.col("words").alias("a"), F.col("rare").alias("ra"))
    theirs = each.where("kind = 'outcome'").select("project", "w", F.col("words").alias("b"), F.col("rare").alias("rb"), "first")
    met = lambda left, right, shorter: left.join(right, ["project", "w"]).where(shorter).select("project", "a", "b", "first")
    pairs = met(ours.where("ra"), theirs, F.size("a") <= F.size("b")).unionByName(met(ours, theirs.where("rb"), F.size("b") < F.size("a"))).distinct()
    least = F.least(F.size("a"), F.size("b"))
    share = F.size(F.array_intersect("a", "b")) / least
    pairs = pairs.withColumn("overlap", share).where(F.when(least <= 2, share >= 0.99).otherwise(share >= 0.5))
    best = pairs.groupBy("project", F.col("a").alias("words")).agg(F.max_by("first", F.struct("overlap", -F.col("first"))).alias("outcome_seq"), F.max("overlap").alias("overlap"))
    found = plain.where("kind = 'intent'").join(best, ["project", "words"]).select(F.col("source_seq").alias("intent_seq"), "outcome_seq", "overlap")

    texts = rows.where("bare <> ''").groupBy("project", "kind", "bare").agg(F.min("source_seq").alias("first"), F.min(F.size("words")).alias("n"))
    gram = lambda x: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: x.substr(i, k))))))
    inner = texts.select("project", "kind", "bare", "first", "n", F.substring("bare", 1, 3).alias("g"))
    outer = texts.select("project", "kind", "bare", "first", "n", gram(F.col("bare")).alias("g"))
    of = lambda df, kind, x: df.where(F.col("kind") == kind).select("project", "g", F.col("bare").alias(x), F.col("first").alias(f"{x}_first"), F.col("n").alias(f"{x}_n"))
    held = of(inner, "intent", "a").where("a_n = 0").join(of(outer, "outcome", "b"), ["project", "g"])
    held = held.unionByName(of(inner, "intent", "a").join(of(outer, "outcome", "b").where("b_n = 0"), ["project", "g"]))
    holds = of(outer, "intent", "a").where("a_n = 0").join(of(inner, "outcome", "b"), ["project", "g"])
    holds = holds.unionByName(of(outer, "intent", "a").join(of(inner, "outcome", "b").where("b_n = 0"), ["project", "g"]))
    within = held.where(F.contains("b", F.col("a"))).unionByName(holds.where(F.contains("a", F.col("b")))).groupBy("project", F.col("a").alias("bare")).agg(F.min("b_first").alias("outcome_seq"))
    bare = rows.where("kind = 'intent'").join(within, ["project", "bare"]).select(F.col("source_seq").alias("intent_seq"), "outcome_seq", F.lit(1.0).alias("overlap"))
    both = found.unionByName(bare)
    return both.groupBy("intent_seq").agg(F.max_by("outcome_seq", F.struct("overlap", -F.col("outcome_seq"))).alias("outcome_seq"), F.round(F.max("overlap"), 6).alias("overlap"))


def supersede(candidates: DataFrame) -> DataFrame:
    """Chains by (project, type, first five words): each entry with its successor; the last is active."""
    topic = F.array_join(F.slice(F.split(normalize_key(F.col("summary")), " "), 1, 5), " ")
    w = Window.partitionBy("project", "type", "topic").orderBy("ts", "source_seq")
    chain = candidates.withColumn("topic", topic).withColumn("next_seq", F.lead("source_seq").over(w))
    return chain.withColumn("status", F.when(F.col("next_seq").isNull(), "active").otherwise("superseded"))


def contradictions(entries: DataFrame) -> DataFrame:
    """(assumption, result, shared): results of a session that tell of a failure and share two words with an assumption of it.

    ``entries`` has session_id, id, type and title; they are joined by session and word.
    """
    words = F.explode(F.array_distinct(F.filter(F.split(normalize_key(F.col("title")), " "), lambda w: w != ""))).alias("w")
    failed = F.lower("title").rlike("fail|broken|wrong|error|invalid|rejected")
    a = entries.where("type = 'assumption'").select("session_id", F.col("id").alias("assumption"), words)
    b = entries.where((F.col("type") == "result") & failed).select("session_id", F.col("id").alias("result"), words)
    return a.join(b, ["session_id", "w"]).groupBy("assumption", "result").agg(F.count("*").alias("shared")).where("shared >= 2")


def insights(candidates: DataFrame, most: int = 3) -> DataFrame:
    """Decisions with the first so many outcomes of their session."""
    w = Window.partitionBy("session_id").orderBy("ts", "source_seq")
    candidates = written(candidates.where(F.col("kind").isin("decision", "outcome")).select("session_id", "source_seq", "ts", "kind"), "insights")  # lines are classified once
    firsts = candidates.where("kind = 'outcome'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return candidates.where("kind = 'decision'").select("session_id", F.col("source_seq").alias("decision_seq")).join(firsts.select("session_id", F.col("source_seq").alias("outcome_seq"), "n"), "session_id")


def daily(candidates: DataFrame) -> DataFrame:
    """Records of the same kind, agent, day and summary as one, with their count."""
    return candidates.groupBy("kind", "agent", "day", normalize_key(F.col("summary")).alias("key")).agg(F.count("*").alias("n"), F.min("source_seq").alias("first_seq"))


def display(records: DataFrame, limit: int) -> DataFrame:
    """Newest first, then by kind, confidence and summary."""
    rank = F.when(F.col("kind") == "decision", 0).when(F.col("kind") == "task", 1).when(F.col("kind") == "intent", 2).otherwise(3)
    return records.orderBy(F.desc("ts"), rank, F.desc("confidence"), "project", "summary").limit(limit)
