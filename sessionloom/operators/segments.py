"""Runs, segments and sequence numbers over the timeline, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.measures import rounded_millis, whole

SESSION = ["agent", "session_id"]
ORDER = ["ts", "source_seq"]


def _runs(df: DataFrame, keys: list[str], order: list[str], changed: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_changed", changed.cast("int")).withColumn(name, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def by_identity(timeline: DataFrame, identity: str = "project") -> DataFrame:
    """``segment``: a new one where an identity appears that differs from the last one known; rows without inherit."""
    w = Window.partitionBy(*SESSION).orderBy(*ORDER)
    before = F.last(identity, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = timeline.withColumn("_before", before)
    changed = F.col(identity).isNotNull() & ~F.col(identity).eqNullSafe(F.col("_before"))
    return _runs(rows, SESSION, ORDER, changed, "segment").withColumn("identity", F.coalesce(identity, "_before")).drop("_before")


def frame_runs(timeline: DataFrame) -> DataFrame:
    """``run``: numbered within a session's day, a new one where frame_kind changes; null is a value of its own."""
    w = Window.partitionBy(*SESSION, "day").orderBy(*ORDER)
    rows = timeline.withColumn("_kind", F.lag("frame_kind").over(w)).withColumn("_at", F.row_number().over(w))
    return _runs(rows, [*SESSION, "day"], ORDER, (F.col("_at") == 1) | ~F.col("frame_kind").eqNullSafe(F.col("_kind")), "run").drop("_kind", "_at")


def numbered(timeline: DataFrame) -> DataFrame:
    """``turn_idx`` from zero without gaps, and ``seq`` within the day."""
    session = Window.partitionBy(*SESSION).orderBy(*ORDER)
    day = Window.partitionBy("project", "day").orderBy(*ORDER)
    return timeline.withColumn("turn_idx", F.row_number().over(session) - 1).withColumn("seq", F.row_number().over(day))


def intervals(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The ordinals of each key as (key, first, last) of unbroken ranges."""
    w = Window.partitionBy(key).orderBy(ordinal)
    rows = df.select(key, ordinal).distinct().withColumn("_group", F.col(ordinal) - F.row_number().over(w))
    return rows.groupBy(key, "_group").agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last")).drop("_group")


def gaps(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges that do not begin right behind the one before."""
    w = Window.partitionBy(key).orderBy("first")
    return ranges.withColumn("previous", F.lag("last").over(w)).where(F.col("first") != F.col("previous") + 1)


def islands(lines: DataFrame, keys: list[str], at: str, hit: Column, least: int = 2) -> DataFrame:
    """Lines of runs of at least ``least`` neighbouring hits."""
    w = Window.partitionBy(*keys).orderBy(at)
    rows = lines.where(hit).withColumn("_island", F.col(at) - F.row_number().over(w))
    size = F.count("*").over(Window.partitionBy(*keys, "_island"))
    return rows.withColumn("_size", size).where(F.col("_size") >= least).drop("_island", "_size")


def neighbours(timeline: DataFrame) -> DataFrame:
    """Each row with the message before and behind it."""
    w = Window.partitionBy(*SESSION).orderBy(*ORDER)
    return timeline.withColumn("before", F.lag("message").over(w)).withColumn("behind", F.lead("message").over(w))


def rolling_rate(df: DataFrame, key: str, seconds: int) -> DataFrame:
    """Rows of the key within the seconds up to each row's time, per second; times are rounded to milliseconds, then cut to seconds."""
    w = Window.partitionBy(key).orderBy(whole(rounded_millis(F.col("ts")), 1000)).rangeBetween(-seconds, 0)
    return df.withColumn("rate", F.count("*").over(w) / F.lit(float(seconds)))


def span_of(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Provenance of groups: frame_kind if it is one, else mixed; first and last source position; first session and cwd."""
    one = F.when(F.countDistinct("frame_kind") == 1, F.min("frame_kind")).otherwise("mixed")
    return windows.groupBy(*keys).agg(one.alias("frame_kind"), F.min("source_seq").alias("first_seq"), F.max("source_seq").alias("last_seq"), F.min_by("session_id", F.struct(*ORDER)).alias("first_session"), F.min_by("cwd", F.struct(*ORDER)).alias("first_cwd"), F.count("*").alias("n"))
