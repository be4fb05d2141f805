"""Token-bounded windows over runs of messages, and the chunks made of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import byte_cut

TARGET, MOST, OVERLAP, PER_MESSAGE = 1500, 2500, 2, 20
MESSAGE_BYTES = 4000


def bounds(costs: list[int], target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """[start, end) windows: none above ``most`` but for a first message, closed at ``target``, the next begins ``overlap`` before."""
    start = 0
    while start < len(costs):
        end, total = start, 0
        while end < len(costs) and (end == start or total + costs[end] <= most):
            total += costs[end]
            end += 1
            if total >= target:
                break
        yield start, end
        if end >= len(costs):
            return
        start = max(start + 1, end - overlap)


KEYS = ["agent", "session_id", "day", "run"]
WINDOW = "agent string, session_id string, day string, run long, window long, first_seq long, last_seq long, tokens long, messages long, seqs array<long>"


def windows(runs: DataFrame) -> DataFrame:
    """(agent, session_id, day, run, window, first_seq, last_seq, tokens, messages, seqs) of runs as frame_runs gives them.

    Where a window ends depends on where the one before did, so the rows of a run are walked in order. They meet in one
    sorted partition and are read as a stream; only sizes and sequence numbers go there, not the texts. Empty messages
    are in no window.
    """
    cost = (F.ceil(F.octet_length("message") / 4) + PER_MESSAGE).cast("long")
    sizes = runs.where("message <> ''").select("agent", "session_id", "day", F.col("run").cast("long").alias("run"), "ts", "source_seq", cost.alias("cost"))
    names = [f.split()[0] for f in WINDOW.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int64()] * 6 + [pa.list_(pa.int64())]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, costs, seqs, found = None, [], [], []

        def close() -> None:
            for n, (a, b) in enumerate(bounds(costs)):
                found.append((*key, n, seqs[a], seqs[b - 1], sum(costs[a:b]), b - a, seqs[a:b]))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*KEYS, "source_seq", "cost")]
            for *own, seq, size in zip(*columns, strict=True):
                if own != key:
                    if key is not None:
                        close()
                    key, costs, seqs = own, [], []
                costs.append(size)
                seqs.append(seq)
            if len(found) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names)
                found = []
        if key is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names)

    return sizes.repartition(*KEYS).sortWithinPartitions(*KEYS, "ts", "source_seq").mapInArrow(walk, WINDOW)


def rendered(windows: DataFrame, timeline: DataFrame) -> DataFrame:
    """The windows with their text: ``[HH:MM:SS] role: message`` lines, each message cut at MESSAGE_BYTES with a mark.

    Their messages are joined by session and sequence number.
    """
    inside = windows.select(*KEYS, "window", F.posexplode("seqs").alias("at", "source_seq"))
    rows = inside.join(timeline.select("session_id", "source_seq", "ts", "role", "message"), ["session_id", "source_seq"])
    line = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), "role", F.lit(": "), byte_cut(F.col("message"), MESSAGE_BYTES))
    lines = rows.groupBy(*KEYS, "window").agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("l"))
    return lines.select(*KEYS, "window", F.array_join(F.col("l.line"), "\n").alias("text"))
