"""Rows made from other rows: frontmatter, card bodies, evidence sections, sidecars, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import compact

FRAMES = ("user_msg", "agent_reply")


def frontmatter(text: Column, *keys: str) -> Column:
    """struct of the keys of a block between two ``---`` lines at the head; null where there is none."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    value = lambda k: F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{k}\s*:\s*(.*)$", 1)), F.lit(""))
    return F.struct(*(value(k).alias(k) for k in keys))


def body(text: Column) -> Column:
    """The text behind its frontmatter or its one-line bracket header."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", ""), r"\A\[[^\]\n]*\]\n", "")


def conversation(timeline: DataFrame, injected: tuple[str, ...] = ()) -> DataFrame:
    """User messages and replies, without user turns that begin with an injected marker."""
    rows = timeline.where(F.col("frame_kind").isin(*FRAMES) | (F.col("frame_kind").isNull() & F.col("role").isin("user", "assistant")))
    for marker in injected:
        rows = rows.where(~((F.col("role") == "user") & F.startswith("message", F.lit(marker))))
    return rows


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?(?:```|\z)", "")


def noise_free(text: Column) -> Column:
    """struct(text, dropped): without lines of digits and a space, input dumps and bare rules, and how many went."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(r"^\s*(?:\d+ (?!\.)|input: \{|---\s*$)"))
    return F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("dropped"))


def sections(timeline: DataFrame, labels: tuple[str, ...], most: int = 900) -> DataFrame:
    """(source_seq, label, text): the lines below each label line of a message, joined and cut."""
    rows = timeline.select("source_seq", F.posexplode(F.split("message", "\n")).alias("at", "line"))
    label = F.lit(None).cast("string")
    for name in labels:
        label = F.when(F.startswith("line", F.lit(name)), name).otherwise(label)
    w = Window.partitionBy("source_seq").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", label).withColumn("label", F.last("own", ignorenulls=True).over(w)).where("label is not null")
    line = F.when(F.col("own").isNotNull(), F.trim(F.expr("substring(line, length(own) + 1)"))).otherwise(F.col("line"))
    joined = F.array_join(F.col("l.line"), "\n")
    return rows.groupBy("source_seq", "label").agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("l")).select("source_seq", "label", F.left(joined, F.lit(most)).alias("text"))


def speaker(text: Column) -> Column:
    """The role of the first ``[HH:MM:SS] role:`` line."""
    return F.nullif(F.regexp_extract(text, r"(?m)^\[\d\d:\d\d:\d\d\] (\w+):", 1), F.lit(""))


def steering_terms(*columns: Column) -> Column:
    """Labelled metadata as search terms."""
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), r"[^0-9a-z]+"), lambda t: t != ""))


def resolve(refs: DataFrame, sessions: DataFrame) -> DataFrame:
    """(ref, session_id, tier, matches): the best tier of exact id (0), alias (1) and unique prefix (2); others are ambiguous."""
    exact = refs.join(sessions, F.col("ref") == F.col("session_id")).select("ref", "session_id", F.lit(0).alias("tier"))
    alias = refs.join(sessions, F.col("ref") == F.col("alias")).select("ref", "session_id", F.lit(1).alias("tier"))
    prefix = refs.where(F.length("ref") >= 2).join(sessions, F.startswith("session_id", F.col("ref"))).select("ref", "session_id", F.lit(2).alias("tier"))
    best = exact.unionByName(alias).unionByName(prefix).groupBy("ref", "tier").agg(F.min("session_id").alias("session_id"), F.countDistinct("session_id").alias("matches"))
    return best.groupBy("ref").agg(F.min_by(F.struct("session_id", "tier", "matches"), "tier").alias("b")).select("ref", F.when(F.col("b.matches") == 1, F.col("b.session_id")).alias("session_id"), F.col("b.tier").alias("tier"), F.col("b.matches").alias("matches"))


def excerpt(text: Column, size: int) -> Column:
    """struct(text, truncated)."""
    return F.struct(F.left(text, F.lit(size)).alias("text"), (F.length(text) > size).alias("truncated"))


def tags(text: Column, families: dict[str, tuple[str, ...]], most: int = 5) -> Column:
    """The names of the first families of which a word stands in the text."""
    found = []
    for name, keywords in families.items():
        test = F.lit(False)
        for k in keywords:
            test = test | F.contains(F.lower(text), F.lit(k))
        found.append(F.when(test, F.lit(name)))
    return F.slice(F.array_compact(F.array(*found)), 1, most)


def thesis_lines(chunks: DataFrame, least: int = 30, most: int = 200) -> DataFrame:
    """Distinct cleaned lines of chunks that say something: numbering and bullets gone, dumps left out."""
    line = compact(F.regexp_replace("line", r"^\s*(?:\d+[.)]|[-*+])\s+", ""))
    rows = chunks.select("chunk_id", F.explode(F.split("text", "\n")).alias("line")).select("chunk_id", line.alias("thesis"))
    return rows.where((F.length("thesis") >= least) & ~F.contains("thesis", F.lit(" | ")) & ~F.contains("thesis", F.lit("!!"))).select("chunk_id", F.left("thesis", F.lit(most)).alias("thesis")).distinct()
