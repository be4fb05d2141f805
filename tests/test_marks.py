"""Marks of sources advance only with their committed batches: a failed batch is replayed, sources in flight are held."""

import datetime as dt

import pytest

from sessionloom.streaming import ingest

SCHEMA = "agent string, ts timestamp, message string, in_flight boolean"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_failed_batch_is_replayed(spark, tmp_path):
    source, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def send(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(keep=lambda rows: rows):
        ingest.append_marked(spark.readStream.schema(SCHEMA).parquet(source), root, checkpoint, keep).awaitTermination()

    def seen():
        return sorted(r["message"] for r in ingest.committed(spark, root, "agent string, ts timestamp, message string").collect())

    def marked():
        return {r["source_key"]: r["last_processed"] for r in ingest.marks(spark, root).collect()}

    assert seen() == [] and marked() == {}
    send(("a", at(1), "a1", False), ("a", at(3), "a3 noise", False), ("b", at(2), "b2", False), ("b", at(5), "b5", True), (None, at(1), "n1", None), ("a", None, "a?", False))
    run(lambda rows: rows.where("message not like '%noise'"))
    assert seen() == ["a1", "a?", "n1"]
    assert marked() == {"a": at(3), "": at(1)}  # of the row that was filtered; b is held

    send(("a", at(3), "late", False), ("a", at(4), "a4", False), ("b", at(2), "b2", False), ("b", at(5), "b5", False))

    with pytest.raises(Exception):
        run(lambda rows: rows.where("raise_error('down') is not null"))
    assert seen() == ["a1", "a?", "n1"] and marked() == {"a": at(3), "": at(1)}

    # rows written, marks not: the batch does not count, and its replay leaves nothing twice
    spark.createDataFrame([("a", at(9), "left over")], "agent string, ts timestamp, message string").write.mode("overwrite").parquet(root + "/rows/batch=1")
    assert seen() == ["a1", "a?", "n1"]
    run()
    assert seen() == ["a1", "a4", "a?", "b2", "b5", "n1"]
    assert marked() == {"a": at(4), "b": at(5), "": at(1)}
    run()
    assert len(seen()) == 6
