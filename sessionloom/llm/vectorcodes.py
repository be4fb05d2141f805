"""Product codes of integer vectors; the nearest entry of a codebook by annular norm pruning.

A vector is cut into equal parts, and a part is replaced by the number of the nearest of the entries of its codebook. By
the triangle inequality an entry whose norm differs from the part's by more than the best distance so far is no nearer. So
the entries are sorted by norm; a first guess gives a distance, two binary searches give the entries of the annulus that it
allows, edges included, and only these are compared, exactly. All numbers are integers, so every order of work gives the
same codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.shared import narrow_side, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that are compared at once, entries next to a part's norm that give the first guess, pairs of an annulus at once.
BLOCK, PROBES, PAIRS = 4096, 4, 1 << 18
#: Magnitudes up to which squared distances of a part are exact in 64 bits (for up to 64 dimensions a part).
LARGEST = 1 << 27


class Codebook:
    """The entries of one part, sorted by norm (ties by index)."""

    def __init__(self, entries: np.ndarray):
        self.squares = (entries * entries).sum(axis=1)
        self.order = np.argsort(self.squares, kind="stable")
        self.sorted, self.norms = entries[self.order], np.sqrt(self.squares[self.order].astype(np.float64))

    def annulus(self, norms: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to which place in the sorted entries the norm is within the root of ``best`` of these norms, inclusively."""
        reach = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (norms + reach) + 1e-9  # of rounded roots
        return np.searchsorted(self.norms, norms - reach - slack, "left"), np.searchsorted(self.norms, norms + reach + slack, "right")

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``points`` the index of the nearest entry, ties to the lower index, and the squared distance."""
        index, best = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
        for at in range(0, len(points), BLOCK):
            index[at : at + BLOCK], best[at : at + BLOCK] = self._block(points[at : at + BLOCK])
        return index, best

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms, k = np.sqrt((x * x).sum(axis=1).astype(np.float64)), len(self.sorted)
        middle = np.searchsorted(self.norms, norms)
        best = np.full(len(x), np.iinfo(np.int64).max)
        for step in range(-PROBES, PROBES):
            gap = x - self.sorted[np.clip(middle + step, 0, k - 1)]
            np.minimum(best, (gap * gap).sum(axis=1), out=best)
        low, high = self.annulus(norms, best)
        index = np.full(len(x), k)
        sizes, row = high - low, 0
        ends = np.cumsum(sizes)
        while row < len(x):
            to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS, "right")))
            own = np.repeat(np.arange(row, to), sizes[row:to])
            first = np.cumsum(sizes[row:to]) - sizes[row:to]
            place = np.arange(len(own)) - np.repeat(first - low[row:to], sizes[row:to])
            gap = x[own] - self.sorted[place]
            found = (gap * gap).sum(axis=1)
            least = np.minimum.reduceat(found, first)
            ties = np.where(found == np.repeat(least, sizes[row:to]), self.order[place], k)
            best[row:to], index[row:to] = least, np.minimum.reduceat(ties, first)
            row = to
        return index, best


def whole_vectors(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The rows whose vector has components, all finite, with these as ``_whole``: floor(scale * x)."""
    x = F.col(vector)
    sound = (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.where(F.coalesce(sound, F.lit(False))).withColumn("_whole", F.transform(x, lambda v: F.floor(v.cast("double") * scale)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), width)


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, position) of ``kept``, a table with ``vec_id`` and ``_whole``.

    They begin as the vectors of the least vec_ids, null last, ties by the vector. Each round every task assigns its parts
    and sums them up by entry; what reaches the driver is one row for each entry of each codebook. There are as many
    entries as rows where these are fewer.
    """
    largest = F.max(F.greatest(F.abs(F.array_max("_whole")), F.abs(F.array_min("_whole"))))
    width, most, wide = kept.agg(F.min(F.size("_whole")), F.max(F.size("_whole")), largest).first()
    if width is None:
        return np.zeros((parts, 0, 0), np.int64)
    if width != most or width % parts or width > 64 * parts or wide > LARGEST:
        raise ValueError(f"vectors need one length, a multiple of {parts} up to {64 * parts}, and components below {LARGEST / SCALE:g}")
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "_whole").select("_whole").limit(entries).toArrow()
    first = _matrix(rows.column(0), width).astype(np.int64).reshape(-1, parts, width // parts)
    books = np.ascontiguousarray(first.transpose(1, 0, 2))
    for _ in range(rounds):
        for part, entry, count, sums in _means(kept, books).collect():
            books[part, entry] = np.array(sums, dtype=object) // count
    return books


def _means(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, count and sums of the parts that are nearest to each entry."""
    parts, size, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        counts, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column("_whole"), parts * width).reshape(-1, parts, width)
            for p, book in enumerate(found):
                index, _ = book.nearest(x[:, p])
                counts[p] += np.bincount(index, minlength=size)
                np.add.at(sums[p], index, x[:, p])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "count", "sums"])

    each = kept.select("_whole").mapInArrow(summed, "part long, entry long, count long, sums array<long>")
    total = F.array(*(F.sum(F.col("sums")[i]) for i in range(width)))
    return each.groupBy("part", "entry").agg(F.sum("count").alias("count"), total.alias("sums"))


def assigned(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and label of each row of ``kept`` with its ``code`` and the ``error`` of the code."""
    parts, size, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        for batch in batches:
            x = _matrix(batch.column("_whole"), parts * width).reshape(-1, parts, width)
            near = [book.nearest(x[:, p]) for p, book in enumerate(found)]
            codes = np.stack([i for i, _ in near], axis=1).astype(np.uint8 if size <= 256 else ">u2")
            text = [row.tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(sum(d for _, d in near), pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.select("vec_id", "label", "_whole").mapInArrow(assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that has a sound vector.

    Rows whose vector is null, empty or holds null or non-finite components go. Repeated rows and ties of vec_id are rows of their
    own; a null vec_id stays, last of the candidates of the first codebooks; null labels are one label. Vectors of unequal
    length, of a length that is no multiple of four, or with components of 131,072 and more are an error. Other columns go;
    an empty table, or none with a sound vector, gives an empty result.
    """
    kept = whole_vectors(vectors.select("vec_id", "label", "embedding")).select("vec_id", "label", "_whole")
    kept = written(kept.withColumn("_whole", F.col("_whole").cast("array<long>")), "vectors")
    books = train(kept)
    coded = written(assigned(kept, books), "vector-codes")
    # a label that a third of the rows has is summed in parts; these sums are few unless labels are many
    sums = narrow_side(written(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors"))
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
