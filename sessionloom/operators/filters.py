"""Predicates on projects, days, watermarks and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_matches(project: Column, wanted: str) -> Column:
    """owner/repo exact, owner/ by owner, /repo by name, a bare word by either; never a substring; empty is no match."""
    owner, repo = F.lower(F.substring_index(project, "/", 1)), F.lower(F.substring_index(project, "/", -1))
    wanted = wanted.strip().lower()
    left, slash, right = wanted.partition("/")
    if not wanted or wanted == "/" or "/" in right:
        return F.lit(False)
    if slash and left and right:
        return (owner == left) & (repo == right)
    if slash:
        return owner == left if left else repo == right
    return (owner == wanted) | (repo == wanted)


def within_days(day: Column, wanted: str) -> Column:
    """``D``, ``A..B``, ``A..`` or ``..B``, ends included."""
    if ".." not in wanted:
        return day == wanted
    lo, _, hi = wanted.partition("..")
    return (day >= lo if lo else F.lit(True)) & (day <= hi if hi else F.lit(True))


def newer_than_watermark(timeline: DataFrame, watermarks: DataFrame, cutoff: Column, include_assistant: bool = True) -> DataFrame:
    """Rows from the cutoff on and strictly behind the watermark of their agent (source_key, last_processed), if it has one."""
    marks = watermarks.select(F.col("source_key").alias("agent"), "last_processed")
    rows = timeline.join(marks, "agent", "left").where((F.col("ts") >= cutoff) & (F.col("last_processed").isNull() | (F.col("ts") > F.col("last_processed"))))
    return rows.where(F.lit(include_assistant) | (F.col("role") == "user")).drop("last_processed")


def nested(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs (a, b) of directories of which one is the other or lies below it; joined by exploded ancestors."""
    upward = lambda path: F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda n: F.array_join(F.slice(F.split(path, "/"), 1, n), "/")))
    below = a.withColumn("_up", upward(F.col("a"))).join(b, F.col("_up") == F.col("b")).select("a", "b")
    over = b.withColumn("_up", upward(F.col("b"))).join(a, F.col("_up") == F.col("a")).select("a", "b")
    return below.unionByName(over).distinct()


def nests(a: Column, b: Column) -> Column:
    """Whether one path is the other or lies below it."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))


def self_echo(text: Column, pattern: str) -> Column:
    """Whether more than half of the non-empty lines match the tool's own pattern."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.size(F.filter(lines, lambda x: x.rlike(pattern))) * 2 > F.size(lines)


def message_kind(message: Column, markers: tuple[str, ...]) -> Column:
    """stub, summary, workflow (at least two markers) or conversation."""
    count = sum((F.contains(message, F.lit(m)).cast("int") for m in markers), F.lit(0))
    return F.when(F.startswith(message, F.lit("<dedup-ref:")), "stub").when(F.startswith(message, F.lit("This session is being continued")), "summary").when(count >= 2, "workflow").otherwise("conversation")
