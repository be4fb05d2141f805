"""Incremental ingestion of the timeline with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def without_repeats(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Drops rows whose (project, message) came within the time before; the state is bounded by the watermark."""
    keyed = stream.withColumn("message_sha", F.sha2("message", 256)).withWatermark("ts", late)
    return keyed.dropDuplicatesWithinWatermark(["project", "message_sha"])


def counts(stream: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows per agent in tumbling or sliding windows; rows later than the watermark are left out."""
    windowed = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "agent").agg(F.count("*").alias("n"))
    return windowed.select(F.col("w.start").alias("start"), "agent", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of an agent's rows without a longer gap."""
    grouped = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "agent").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "agent", "n")


def unseen_of_newest(stream: DataFrame, most: int = 50_000) -> DataFrame:
    """Rows whose message hash is not among the ``most`` newest of the project; the state is bounded by count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = dict.fromkeys(state.get[0]) if state.exists else {}
        for rows in batches:
            rows = rows.sort_values(["ts", "source_seq"])
            fresh = []
            for sha in rows["message_sha"]:
                fresh.append(sha not in kept)
                kept[sha] = None
                if len(kept) > most:
                    del kept[next(iter(kept))]
            yield rows.loc[fresh, ["project", "ts", "source_seq", "message_sha"]]
        state.update((list(kept),))

    keyed = stream.select("project", "ts", "source_seq", F.sha2("message", 256).alias("message_sha"))
    return keyed.groupBy("project").applyInPandasWithState(step, "project string, ts timestamp, source_seq long, message_sha string", "kept array<string>", "append", GroupStateTimeout.NoTimeout)


def append_new(stream: DataFrame, table_path: str, checkpoint: str):
    """Starts a query that appends each batch's rows that the table does not hold by (session_id, source_seq).

    A batch that is replayed after a failure, or again from a new checkpoint, appends nothing twice and deletes nothing.
    The offsets advance only when a batch has succeeded.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["session_id", "source_seq"])
        try:
            known = batch.sparkSession.read.schema(batch.schema).parquet(table_path).select("session_id", "source_seq")
        except AnalysisException as missing:  # the first batch ever
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            fresh = fresh.join(known, ["session_id", "source_seq"], "left_anti")
        fresh.write.mode("append").parquet(table_path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermarks(rows: DataFrame, skipped: DataFrame) -> DataFrame:
    """(source_key, last_processed) from the raw rows before any filter; sources with skipped units hold theirs."""
    held = skipped.where("skipped > 0").select(F.col("agent"))
    return rows.groupBy("agent").agg(F.max("ts").alias("last_processed")).join(held, "agent", "left_anti").select(F.col("agent").alias("source_key"), "last_processed")


def advanced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The later of both watermarks for each key; a watermark never goes back."""
    return old.unionByName(new).groupBy("source_key").agg(F.max("last_processed").alias("last_processed"))


def _table(spark, path: str, schema: str) -> DataFrame:
    """The Parquet table at a path; empty before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def marks(spark, root: str, before: int | None = None) -> DataFrame:
    """(source_key, last_processed) of the committed batches, or of those before a batch."""
    rows = _table(spark, f"{root}/marks", "source_key string, last_processed timestamp, batch long").where("source_key is not null")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("source_key").agg(F.max("last_processed").alias("last_processed"))


def committed(spark, root: str, schema: str) -> DataFrame:
    """The rows of the committed batches; a batch that failed midway is not seen."""
    done = _table(spark, f"{root}/marks", "source_key string, last_processed timestamp, batch long").select("batch").distinct()
    return _table(spark, f"{root}/rows", f"{schema}, batch long").join(F.broadcast(done), "batch", "left_semi").drop("batch")


def append_marked(stream: DataFrame, root: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows):
    """Appends a stream with agent, ts and in_flight to ``root``; the marks of its sources advance with its batches.

    A source with a row in flight is left out whole and its mark held, until it is sent again. Rows at or below their
    source's mark are ignored; rows without ts are kept and move no mark, those without agent are the source ``""``. Marks
    are of the rows as they come, before ``keep`` filters them. Rows are written below the number of their batch and its
    marks last, in one file: without them the batch does not count, and its replay replaces what it left.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("source_key", F.coalesce("agent", F.lit("")))
        held = keyed.where("in_flight").select("source_key").distinct()
        old = marks(spark, root, number)
        ready = keyed.join(held, "source_key", "left_anti").join(old, "source_key", "left")
        fresh = ready.where("last_processed is null or ts is null or ts > last_processed").drop("last_processed")
        keep(fresh).drop("source_key", "in_flight").write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        new = fresh.groupBy("source_key").agg(F.max("ts").alias("last_processed")).where("last_processed is not null")
        whole = advanced(old, new).unionByName(spark.createDataFrame([(None, None)], "source_key string, last_processed timestamp"))
        whole.coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
