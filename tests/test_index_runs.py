"""F3 of round 4: the index is inverted in runs of bounded size, whose words are those of the columns; F2: queries share one pass; F1: texts are read once."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.operators.retrieval import terms_of
from sessionloom.sources import postings
from sessionloom.sources.shared import new_path

ODD = ["", " ", "÷ a÷b ×", "Àéÿ ÖŸ naïve Ünder", "x" * 40 + " " + "y" * 41 + " z", "Kelvin K ÅÅ ß ẞ Ω", "a-b_a\ta\n a", "日本 a本b \U0001f600c", "é" * 20 + " " + "é" * 21, "0 00 a0", "Ã ã Ã  à"]


def plain(text):
    return [w for w in re.split(r"[^0-9a-zà-öø-ÿ]+", text.lower()) if w and len(w.encode()) <= 40]


@pytest.mark.parametrize("run_bytes", [1, 30, 1 << 24])
def test_runs_hold_what_a_plain_walk_finds(monkeypatch, run_bytes):
    monkeypatch.setattr(postings, "RUN_BYTES", run_bytes)
    texts = ODD + ["b a b b", "a"]
    rows = pa.table({"id": [f"c{i}" for i in range(len(texts))], "text": [t.lower() + " " for t in texts]})
    runs = [r for r in postings._inverted(False)(rows.to_batches(max_chunksize=4)) if len(r)]
    found, df = {}, Counter()
    for run in runs:
        for r in run.to_pylist():
            found[r["id"], r["term"]] = (r["tf"], r["at"], r["length"])
            df[r["term"]] += r["in_run"] or 0
        terms = run.column("term").to_pylist()
        assert [t.encode() for t in terms] == sorted(t.encode() for t in terms)
    wanted = {}
    for i, t in enumerate(texts):
        words = plain(t)
        for w in words:
            at = [k for k, x in enumerate(words) if x == w]
            wanted[f"c{i}", w] = (len(at), at, len(words))
    assert found == wanted
    assert df == Counter(term for _, term in wanted)
    assert (len(runs) > 5) == (run_bytes < 1 << 20)


def test_words_are_those_of_the_column(spark):
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate([*ODD, None])], "chunk_id string, text string")
    index = postings.build(chunks, new_path(spark, "index"))
    found = {(r["id"], r["w"]) for r in index.table(spark, "postings").select("id", F.posexplode("at"), "term").selectExpr("id", "concat(col, ' ', term) as w").collect()}
    wanted = {(r["chunk_id"], r["w"]) for r in chunks.select("chunk_id", F.posexplode(terms_of(F.col("text")))).selectExpr("chunk_id", "concat(pos, ' ', col) as w").collect()}
    assert found == wanted
    assert index.table(spark, "totals").first()["n"] == len(ODD) + 1


def test_queries_share_one_pass(spark):
    texts = ["disk full", "the disk", "the cache", "warm cache", "", "full disk full disk"]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    index = postings.build(chunks, new_path(spark, "index"))
    asked = {"disk OR (NOT the)": {0, 1, 3, 5}, '"full disk"': {5}, '"disk full disk"': {5}, "-the": {0, 3, 5}, "+the -disk": {2}, "nothing": set(), "": set()}
    rows = postings.matching_each(spark, index, {q: postings.parse(q) for q in asked}).collect()
    assert {q: {int(r["id"][1:]) for r in rows if r["query"] == q} for q in asked} == asked
    assert {r["score"] for r in rows if r["query"] == "-the"} == {0.0}
    for q in asked:
        alone = {(r["id"], r["score"]) for r in postings.matching(spark, index, postings.parse(q)).collect()}
        assert alone == {(r["id"], r["score"]) for r in rows if r["query"] == q}


def test_texts_are_read_once(spark, tmp_path):
    path, read = f"file://{tmp_path}/chunks", spark.sparkContext.accumulator(0)
    spark.range(20).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("a b "), "id").alias("text")).write.parquet(path)

    def seen(text):
        read.add(1)
        return text

    index = postings.build(spark.read.parquet(path).withColumn("text", F.udf(seen, "string")("text")), new_path(spark, "index"))
    assert read.value == 20
    assert {name: told["rows"] for name, told in index.tables.items()} == {"postings": 60, "terms": 22, "chunks": 20, "totals": 1}
