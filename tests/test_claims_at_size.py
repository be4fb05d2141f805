"""Joins of claims and evidence that must not pair rows before the result, and plans that classify lines once."""

from pyspark.sql import functions as F

from sessionloom.operators import claims, intents


def test_linked_makes_no_pairs_in_a_shuffle(spark):
    """classes of equal names meet; before, all pairs of a common file were shuffled and grouped."""
    made = spark.createDataFrame([(f"k{i}", "p", [], ["a/b.rs"] if i % 2 else ["a/c.rs", "a/b.rs"]) for i in range(30)] + [("k90", "q", ["abc1234"], [])], "id string, project string, hashes array<string>, files array<string>")
    facts = [(f"e{i}", "p", f"k{i}" if i % 3 else None, i % 5 == 0, [], ["a/c.rs"] if i % 2 else []) for i in range(30)] + [("e90", "q", None, True, ["abc1234"], []), ("e91", "q", "k1", False, [], [])]
    facts_frame = spark.createDataFrame(facts, "evidence_id string, project string, claim_id string, fails boolean, hashes array<string>, files array<string>")
    found = claims.linked(made, facts_frame)
    want = set()
    for c in made.collect():
        for e, project, claim, fails, hashes, files in facts:
            if claim == c["id"] or project == c["project"] and ({*hashes} & {*c["hashes"]} or {*files} & {*c["files"]}):
                want.add((c["id"], e, claim == c["id"], fails))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_a_small_file_are_many_tasks(spark):
    """F14 to F17: before, the lines of a small table were classified in its one task."""
    rows = spark.range(40, numPartitions=1).select(F.lit("p").alias("project"), F.lit("a").alias("agent"), F.lit("s").alias("session_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("source_seq"), F.lit("2024-01-01").alias("day"), F.lit("user_msg").alias("frame_kind"), F.lit("user").alias("role"), F.concat(F.lit("decision: keep parser "), "id").alias("message"))
    found = intents.candidates(rows)
    assert found.count() == 40
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
