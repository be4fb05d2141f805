"""Checks of turns, chunks and projections; findings are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_findings(turns: DataFrame) -> DataFrame:
    """(session_id, finding, n): gaps in turn_idx, hashes that do not fit, unknown roles, empty texts."""
    w = Window.partitionBy("session_id").orderBy("turn_idx")
    rows = turns.withColumn("_gap", F.col("turn_idx") != F.coalesce(F.lag("turn_idx").over(w) + 1, F.lit(0)))
    tests = {"gap": F.col("_gap"), "hash": F.sha2("text", 256) != F.col("text_hash"), "role": ~F.col("role").isin("user", "assistant", "system", "tool"), "empty": F.trim("text") == ""}
    facts = rows.groupBy("session_id").agg(*(F.count_if(test).alias(name) for name, test in tests.items()))
    return facts.select("session_id", F.inline(F.array(*(F.struct(F.lit(name).alias("finding"), F.col(name).alias("n")) for name in tests)))).where("n > 0")


def differences(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one side has, and which."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, list(keys), "left_anti").withColumn("only_in", F.lit("first")).unionByName(right.join(left, list(keys), "left_anti").withColumn("only_in", F.lit("second")))


def replaced(cards: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The cards with all those of the fresh ones' keys replaced by the fresh ones."""
    return cards.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def decision(indexed: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """One row: skip if both sides hold the same keys, insert if the index only lacks some, else rebuild."""
    d = differences(indexed, live, key).agg(F.count_if(F.col("only_in") == "first").alias("stale"), F.count_if(F.col("only_in") == "second").alias("missing"))
    return d.select("stale", "missing", F.when((F.col("stale") == 0) & (F.col("missing") == 0), "skip").when(F.col("stale") == 0, "insert").otherwise("rebuild").alias("mode"))


def worst(checks: DataFrame) -> DataFrame:
    """One row: the greatest severity of all checks."""
    order = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return checks.agg(F.max(order).alias("level")).select(F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("critical")), (F.coalesce("level", F.lit(0)) + 1).cast("int")).alias("readiness"))
