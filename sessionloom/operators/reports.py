"""Counts and summaries over timelines, chunks and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import estimate_tokens, title

#: Noise classes and the text that marks them.
NOISE = (("symbols", "***"), ("shouting", "!!"), ("table", " | "), ("ticks", "```"), ("rule", "---"), ("tag", "<"))


def sessions(timeline: DataFrame) -> DataFrame:
    """Per session: messages by role, first and last time, the first user line as title."""
    first_user = F.min_by(F.when(F.col("role") == "user", title(F.col("message"))), F.when(F.col("role") == "user", F.struct("ts", "source_seq")))
    return timeline.groupBy("agent", "session_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("agent_messages"), F.min("ts").alias("started"), F.max("ts").alias("ended"), first_user.alias("title"))


def store_index(chunks: DataFrame) -> DataFrame:
    """Per project and agent: chunks, days, the last day, tokens."""
    return chunks.groupBy("project", "agent").agg(F.count("*").alias("chunks"), F.countDistinct("day").alias("days"), F.max("day").alias("last_day"), F.sum(estimate_tokens(F.col("text"))).alias("tokens"))


def refs(chunks: DataFrame) -> DataFrame:
    """Per project: files, first and last day, the lexicographically last id, days with each agent."""
    return chunks.groupBy("project").agg(F.count("*").alias("files"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max("chunk_id").alias("latest"), F.countDistinct("agent", "day").alias("agent_days"))


def noise_classes(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(mark)), F.lit(name)) for name, mark in NOISE)))


def audit(chunks: DataFrame) -> DataFrame:
    """Files by project and noise class with totals of both levels, from one rollup."""
    rows = chunks.select("project", F.explode_outer(noise_classes(F.col("text"))).alias("class"))
    rolled = rows.withColumn("class", F.coalesce("class", F.lit("clean"))).rollup("project", "class").agg(F.count("*").alias("files"))
    return rolled.select(F.coalesce("project", F.lit("(all)")).alias("project"), F.coalesce("class", F.lit("(all)")).alias("class"), "files")


def dashboard(chunks: DataFrame) -> DataFrame:
    """Counts by project, by agent and by kind, from one pass of grouping sets."""
    found = chunks.groupingSets([["project"], ["agent"], ["kind"]], "project", "agent", "kind").agg(F.grouping_id().alias("g"), F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct("day").alias("days"))
    return found.select(F.when(F.col("g") == 3, "project").when(F.col("g") == 5, "agent").otherwise("kind").alias("facet"), F.coalesce("project", "agent", "kind").alias("value"), "files", "bytes", "days")


def usage_totals(usage: DataFrame) -> DataFrame:
    """Tokens of a session by what its counters mean: deltas add up, cumulative ones peak, of snapshots the last counts."""
    facts = usage.groupBy("session_id", "semantics").agg(F.sum("tokens").alias("added"), F.max("tokens").alias("peak"), F.max_by("tokens", F.struct("ts", "event_id")).alias("last"))
    return facts.select("session_id", "semantics", F.when(F.col("semantics") == "delta", F.col("added")).when(F.col("semantics") == "cumulative", F.col("peak")).otherwise(F.col("last")).alias("tokens"))


def lag_of_chunks(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: the newest session, the newest chunk, and how many sessions are newer than that."""
    newest = chunks.agg(F.max("day").alias("newest_chunk"))
    counted = sessions.crossJoin(F.broadcast(newest))  # newest is one row
    return counted.agg(F.max("ended").alias("newest_session"), F.max("newest_chunk").alias("newest_chunk"), F.count_if(F.date_format("ended", "yyyy-MM-dd") > F.col("newest_chunk")).alias("sessions_newer"))


def health(chunks: DataFrame, as_of: str) -> DataFrame:
    """Checks with their severity: empty bodies, noisy files, duplicate contents, age of the newest chunk in days."""
    facts = chunks.agg(F.count("*").alias("n"), F.count_if(F.trim("text") == "").alias("empty"), F.count_if(F.size(noise_classes(F.col("text"))) > 0).alias("noisy"), (F.count("*") - F.countDistinct(F.sha2("text", 256))).alias("repeats"), F.datediff(F.lit(as_of).cast("date"), F.max("day").cast("date")).cast("long").alias("age"))
    level = lambda x, warn, bad: F.when(x >= bad, "critical").when(x >= warn, "warning").otherwise("ok")
    share = lambda c: F.round(F.col(c) * 100.0 / F.greatest(F.col("n"), F.lit(1)), 4)
    checks = [("empty_bodies", share("empty"), 1, 10), ("noise", share("noisy"), 20, 50), ("duplicates", share("repeats"), 5, 25), ("freshness_days", F.col("age").cast("double"), 2, 3)]
    return facts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("check"), value.alias("value"), level(value, warn, bad).alias("severity")) for name, value, warn, bad in checks))))


def line_class(line: Column) -> Column:
    """signal, noise or neutral."""
    noise = F.lit(False)
    for _, mark in NOISE[:4]:
        noise = noise | F.contains(line, F.lit(mark))
    return F.when(noise, "noise").when(F.length(F.trim(line)) >= 40, "signal").otherwise("neutral")


def chunk_quality(chunks: DataFrame) -> DataFrame:
    """Score 0 to 10 of a chunk: signal density, less noise, plus volume; and its label."""
    rows = chunks.select("chunk_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("c", line_class(F.col("line")))
    facts = rows.groupBy("chunk_id").agg(F.count("*").alias("lines"), F.count_if(F.col("c") == "signal").alias("signal"), F.count_if(F.col("c") == "noise").alias("noise"))
    density, noise = F.col("signal") / F.col("lines"), F.col("noise") / F.col("lines")
    score = F.greatest(F.lit(0), F.least(F.lit(10), F.floor(density * 7 - noise * 4 + F.least(F.lit(3.0), F.col("signal") / 4) + 0.5))).cast("long")
    return facts.select("chunk_id", "lines", "signal", "noise", score.alias("score")).withColumn("label", F.when(F.col("score") >= 7, "high").when(F.col("score") >= 4, "medium").otherwise("low"))


def latency(per_query: DataFrame) -> DataFrame:
    """Mean and the value at index floor(0.95 n) of the sorted latencies (value)."""
    return per_query.agg(F.round(F.avg("value"), 6).alias("mean"), F.element_at(F.sort_array(F.collect_list("value")), (F.floor(F.lit(0.95) * F.count("*")) + 1).cast("int")).alias("p95"))
