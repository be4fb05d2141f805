"""Published versions and the lexical index: writers that fail, drift of each kind, queries against a walk over the texts."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import cards
from sessionloom.sources import postings, versions
from sessionloom.sources.shared import new_path
from sessionloom.sources.versions import Drift


def made(spark, n, mark="a"):
    return spark.createDataFrame([(f"s{i % 3}", i, f"{mark} text {i}", "p", "alpha", "user_msg") for i in range(n)], "session_id string, source_seq long, message string, project string, agent string, frame_kind string").withColumn(
        "ts", F.timestamp_seconds("source_seq")
    )


def test_a_writer_that_fails_leaves_the_old_version(spark):
    root = new_path(spark, "projection")
    with pytest.raises(Drift, match="missing"):
        cards.read_published(spark, root)
    cards.publish(cards.cards(made(spark, 9)), root)
    broken = cards.cards(made(spark, 20)).withColumn("text", F.when(F.col("turn_idx") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        cards.publish(broken, root)
    found = cards.read_published(spark, root)
    assert (found.number, found.table(spark, "cards").count()) == (1, 9)
    cards.publish(cards.cards(made(spark, 12)), root)
    assert cards.read_published(spark, root).table(spark, "cards").count() == 12
    assert cards.read_published(spark, root, 1).table(spark, "cards").count() == 9
    cards.publish(cards.cards(made(spark, 0)), root)
    assert cards.read_published(spark, root).table(spark, "cards").count() == 0


def test_what_is_published_is_checked(spark):
    root = new_path(spark, "projection")
    first = cards.publish(cards.cards(made(spark, 9)), root)
    with pytest.raises(Drift) as twice:
        cards.publish(cards.cards(made(spark, 4)).unionByName(cards.cards(made(spark, 4))), root)
        cards.read_published(spark, root)
    assert twice.value.kind == "ids"
    cards.cards(made(spark, 1)).write.mode("append").parquet(first.path("cards"))
    with pytest.raises(Drift) as more:
        cards.read_published(spark, root, 1)
    assert more.value.kind == "tables"
    cards.cards(made(spark, 9, "b")).write.mode("overwrite").parquet(first.path("cards"))
    with pytest.raises(Drift) as other:
        cards.read_published(spark, root, 1)
    assert other.value.kind == "revision"
    assert versions.read(spark, root, 9) is None


def test_two_writers_of_a_number(spark, monkeypatch):
    root = new_path(spark, "projection")
    versions.publish(spark, root, {"t": spark.range(3)})
    monkeypatch.setattr(versions, "numbers", lambda *_: [])
    with pytest.raises(Drift, match="conflict"):
        versions.publish(spark, root, {"t": spark.range(4)})
    monkeypatch.undo()
    assert versions.read(spark, root).table(spark, "t").count() == 3


WORDS = ["load", "loads", "loading", "the", "of", "cache", "disk", "x1", "under_score"]


def corpus(spark, n=120, seed=3):
    draw = random.Random(seed)
    texts = [" ".join(draw.choice(WORDS) for _ in range(draw.choice([0, 1, 4, 12]))) for _ in range(n)] + ["", "The; of-THE"]
    return texts, spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")


@pytest.mark.parametrize(
    ("query", "holds"),
    [
        ("cache", lambda w, s: "cache" in w),
        ('"the of"', lambda w, s: " the of " in s),
        ('"of the of"', lambda w, s: " of the of " in s),
        ("cache disk", lambda w, s: "cache" in w or "disk" in w),
        ("cache AND disk OR x1", lambda w, s: ("cache" in w and "disk" in w) or "x1" in w),
        ("+cache -disk the", lambda w, s: "cache" in w and "disk" not in w),
        ("cache AND (disk OR NOT the)", lambda w, s: "cache" in w and "disk" in w and "the" not in w),  # as -the
        ("-the", lambda w, s: bool(w) and "the" not in w),
        ("under_score", lambda w, s: " under score " in s),
        ("absent", lambda w, s: False),
        ("", lambda w, s: False),
        ("!!", lambda w, s: False),
    ],
)
def test_grammar(spark, query, holds):
    texts, chunks = corpus(spark)
    index = postings.kept_index(spark, "grammar", chunks)
    found = {r["id"] for r in postings.matching(spark, index, postings.parse(query)).collect()}
    plain = lambda t: [w for w in t.lower().replace("_", " ").replace(";", " ").replace("-", " ").split()]
    assert found == {f"c{i}" for i, t in enumerate(texts) if holds(plain(t), f" {' '.join(plain(t))} ")}


@pytest.mark.parametrize("query", ["(a", "a)", "a AND", "NOT", '"open', "a OR"])
def test_queries_that_cannot_be_read(query):
    with pytest.raises(ValueError):
        postings.parse(query)


def test_stems_and_drift(spark):
    texts, chunks = corpus(spark)
    root = new_path(spark, "index")
    kind = lambda **facts: pytest.raises(Drift) if facts else None
    with pytest.raises(Drift) as missing:
        postings.checked(spark, root)
    postings.build(chunks, root, stem=True, facts={"model": "m1", "dimension": 64})
    found = postings.search(spark, postings.checked(spark, root, chunks, stem=True), "loads", 500)
    assert {r["id"] for r in found.collect()} == {f"c{i}" for i, t in enumerate(texts) if {"load", "loads", "loading"} & {*t.split()}}
    ranks = [r["rank"] for r in found.orderBy("rank").collect()]
    assert ranks == list(range(len(ranks)))
    seen = [missing.value.kind]
    for facts in ({"model": "m2"}, {"dimension": 32}, {"stem": False}):
        with kind(**facts) as drift:
            postings.checked(spark, root, **facts)
        seen.append(drift.value.kind)
    with pytest.raises(Drift) as source:
        postings.checked(spark, root, chunks.where("chunk_id <> 'c1'"))
    versions.publish(spark, root, {"totals": spark.range(1)}, {"generation": 1})
    with pytest.raises(Drift) as generation:
        postings.checked(spark, root)
    assert [*seen, source.value.kind, generation.value.kind] == ["missing", "model", "dimension", "stem", "source", "generation"]


def test_an_index_follows_its_files(spark, tmp_path):
    _, chunks = corpus(spark)
    path = f"file://{tmp_path}/chunks"
    chunks.write.parquet(path)
    one = postings.kept_index(spark, "files", spark.read.parquet(path))
    assert postings.kept_index(spark, "files", spark.read.parquet(path)) == one
    corpus(spark, 5, 9)[1].write.mode("append").parquet(path)
    two = postings.kept_index(spark, "files", spark.read.parquet(path))
    assert two.number == one.number + 1
    assert postings.totals(spark, two).first()["n"] == 122 + 7
