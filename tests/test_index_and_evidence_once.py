"""F7, F8, F12, F13: postings are grouped within rows, chunks are a table; F10, F11: hits are folded once for all questions."""

from pyspark.sql import functions as F

from sessionloom.operators import evidence
from sessionloom.sources import postings
from sessionloom.sources.shared import new_path


def test_places_of_words(spark):
    chunks = spark.createDataFrame([("c1", "b a b b"), ("c2", "a"), ("c3", "")], "chunk_id string, text string")
    index = postings.build(chunks, new_path(spark, "index"))
    rows = {(r["id"], r["term"]): (r["tf"], r["at"], r["length"]) for r in index.table(spark, "postings").collect()}
    assert rows == {("c1", "b"): (3, [0, 2, 3], 4), ("c1", "a"): (1, [1], 4), ("c2", "a"): (1, [0], 1)}
    assert {r["id"] for r in index.table(spark, "chunks").collect()} == {"c1", "c2"}


def test_questions_share_their_hits(spark):
    rows = [(f"c{i}", "2024-01-01", "User intent:\nwhy a\nAgent answered:\nbecause parser", ["parser"], 50, None, "request", None) for i in range(3)]
    hits = spark.createDataFrame(rows, "chunk_id string, day string, body string, matches array<string>, base_score int, round_id string, anchor_kind string, family string")
    asked = ("why the parser", "status of parser")
    columns = ["query", "chunk_id", "evidence_score", "label", "reasons", *evidence.SECTIONS]
    each = evidence.scored(hits.withColumn("query", F.explode(F.array(*map(F.lit, asked))))).select(*columns)
    once = evidence.scored_for(hits, asked).select(*columns)
    assert sorted(map(str, once.collect())) == sorted(map(str, each.collect())) and once.count() == 6
