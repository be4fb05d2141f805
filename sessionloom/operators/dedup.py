"""Duplicates of timeline rows, chunks and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import normalize_key


def first_of(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order, which must be total.

    The ordering columns make one struct, so the row comes from a pre-aggregated minimum instead of a sorted group.
    """
    rank = F.struct(*order)
    rest = F.struct(*df.columns)
    return df.groupBy(*[k.alias(f"_k{i}") if isinstance(k, Column) else F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(rest, rank).alias("_row")).select("_row.*")


def segment_first(timeline: DataFrame) -> DataFrame:
    """Adds ``segment_start``, the first ts of the row's (project, agent, session)."""
    starts = timeline.groupBy("project", "agent", "session_id").agg(F.min("ts").alias("segment_start"))
    return timeline.join(starts, ["project", "agent", "session_id"])


PROCESSING_ORDER = ["segment_start", "agent", "session_id", "ts", "source_seq"]


def exact(timeline: DataFrame) -> DataFrame:
    """Of equal (project, agent, second, message) the first in processing order; sessions do not matter."""
    rows = segment_first(timeline)
    return first_of(rows, ["project", "agent", F.unix_timestamp("ts"), "message"], PROCESSING_ORDER).drop("segment_start")


def overlap(timeline: DataFrame, seconds: int = 60) -> DataFrame:
    """Of equal (project, minute, message) the first in processing order, whatever the agent."""
    rows = segment_first(timeline)
    return first_of(rows, ["project", F.floor(F.unix_timestamp("ts") / seconds), "message"], PROCESSING_ORDER).drop("segment_start")


def unseen(timeline: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose (project, hash of message) is not in the persisted ``seen`` (bucket, hash)."""
    hashed = timeline.withColumn("hash", F.sha2("message", 256))
    return hashed.join(seen.select(F.col("bucket").alias("project"), "hash"), ["project", "hash"], "left_anti")


def short_repeats(timeline: DataFrame, most_bytes: int = 1000, within_ms: int = 2000) -> DataFrame:
    """Without short user rows that repeat the previous equal one of the session within the time; kept or not, that one counts."""
    body = F.trim("message")
    w = Window.partitionBy("agent", "session_id", F.trim("message")).orderBy("ts", "source_seq")
    short = (F.col("role") == "user") & (F.octet_length(body) <= most_bytes)
    gap = (F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(w)))
    candidates = timeline.where(short).withColumn("_gap", gap).where("_gap is null or _gap > " + str(within_ms)).drop("_gap")
    return candidates.unionByName(timeline.where(~short))


def repeats_as_stubs(timeline: DataFrame, least_lines: int = 8) -> DataFrame:
    """Later equal bodies of a session with many lines become a short reference to the first."""
    long_body = F.size(F.split("message", "\n")) >= least_lines
    w = Window.partitionBy("session_id", F.sha2("message", 256)).orderBy("ts", "source_seq")
    rows = timeline.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first("source_seq").over(w))
    stub = F.concat(F.lit("<dedup-ref: "), F.substring(F.sha2("message", 256), 1, 12), F.lit(" | first-seen: entry #"), F.col("_first"), F.lit(">"))
    repeated = long_body & (F.col("_n") > 1)
    return rows.withColumn("body", F.when(repeated, stub).otherwise(F.col("message"))).withColumn("collapsed", repeated).drop("_n", "_first")


def by_content(chunks: DataFrame) -> DataFrame:
    """One chunk for each content hash of a (project, day, kind, agent) leaf: the one with the least id."""
    return first_of(chunks.withColumn("sha", F.sha2("text", 256)), ["project", "day", "kind", "agent", "sha"], ["chunk_id"])


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def records(df: DataFrame) -> DataFrame:
    """Of records equal in kind, project and normalised summary the first in source order."""
    return first_of(df, ["kind", "project", normalize_key(F.col("summary"))], ["ts", "source_seq"])


def truncated_prefixes(df: DataFrame, mark: str = "…[truncated]") -> DataFrame:
    """Without truncated summaries that a longer whole one of the same kind and session begins with."""
    cut = F.col("summary").endswith(mark)
    whole = df.where(~cut).select(F.col("kind").alias("_kind"), F.col("session_id").alias("_session"), F.col("summary").alias("_whole"))
    stem = F.substring("summary", F.lit(1), F.length("summary") - len(mark))
    same = (F.col("kind") == F.col("_kind")) & (F.col("session_id") == F.col("_session"))
    return df.where(~cut).unionByName(df.where(cut).join(whole, same & F.startswith(F.col("_whole"), stem), "left_anti"))


def newest(df: DataFrame, bucket: str, order: str, most: int = 50_000) -> DataFrame:
    """At most so many rows of each bucket, those with the greatest ``order``."""
    w = Window.partitionBy(bucket).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def common_lines(results: DataFrame, share: float = 0.15, least_results: int = 5) -> DataFrame:
    """(result, line) without the lines that occur in at least that share of the results, if there are enough results."""
    total = results.agg(F.countDistinct("result").alias("total"))
    counts = results.groupBy("line").agg(F.countDistinct("result").alias("n"))
    common = counts.join(F.broadcast(total), (F.col("total") >= least_results) & (F.col("n") >= F.ceil(F.col("total") * share)))
    return results.join(common.select("line"), "line", "left_anti")
