"""Quality by Bradley-Terry ranking: scores from preference pairs, cut at a quantile of the scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.shared import narrow_side, written
from sessionloom.llm.textarrays import BLOCK, SPACED, Words, blocks, pieces, text_bytes
from sessionloom.llm.training import all_labels, free_name, held_out

MODULUS, REMAINDER = 5, 0
#: The score at the quantile cut.
CUT = 0.3
#: Turns of the fit at most, and the largest slope at which it has converged.
STEPS = 60
SETTLED = 1e-4
RIDGE = 1e-3
#: Steps of scores that pairs are taken by, for each label at most.
MOST_STEPS = 1 << 14

_CLASSES = ("upper", "lower", "digit", "beyond", "space", "line", "stop", "symbol")
_KIND = np.full(256, 7, dtype=np.uint8)
_KIND[65:91] = 0
_KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[128:] = 3
_KIND[[32, 9, 11, 12, 13]] = 4
_KIND[10] = 5
_KIND[[44, 46, 39, 45, 58, 59, 40, 41, 34]] = 6
#: Sums over a text: bytes of each class, words, words equal to the one before, words with a symbol, words all in
#: capitals, the squares of word lengths, and words of one byte.
SUMS = len(_CLASSES) + 6


def _sums(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SUMS)."""
    n = len(offsets) - 1
    out = np.zeros((n, SUMS))
    kinds = _KIND[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out[:, :8] = np.bincount(owner * 8 + kinds, minlength=n * 8).reshape(n, 8)
    words = Words(data, offsets, SPACED)
    of = words.owner()
    if not len(of):
        return out
    hashes = words.hashes()[0]
    upto = np.zeros((2, len(data) + 1), dtype=np.int64)
    np.cumsum(kinds == 7, out=upto[0, 1:])
    np.cumsum(kinds == 0, out=upto[1, 1:])
    long = words.end - words.start
    symbols, capitals = upto[0][words.end] - upto[0][words.start], upto[1][words.end] - upto[1][words.start]
    same = np.zeros(len(of), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    for k, x in enumerate((np.ones(len(of)), same, symbols > 0, (capitals >= 2) & (capitals * 2 > long), np.minimum(long, 100.0) ** 2, long == 1)):
        out[:, 8 + k] = np.bincount(of, weights=x, minlength=n)
    return out


def features(column: pa.Array) -> np.ndarray:
    """(texts, features): shares and log-shares that do not depend on the language or the length."""
    data, offsets = text_bytes(column)
    sums = np.zeros((len(offsets) - 1, SUMS))
    for lo, hi in blocks(offsets):
        part = offsets[lo : hi + 1]
        own = data[part[0] : part[-1]]
        if hi - lo == 1 and len(own) > BLOCK:
            sums[lo] = sum(_sums(p, np.array([0, len(p)]))[0] for p in pieces(own))
        else:
            sums[lo:hi] = _sums(own, part - part[0])
    size, words = np.maximum(sums[:, :8].sum(axis=1), 1), np.maximum(sums[:, 8], 1)
    shares = np.column_stack([sums[:, :8] / size[:, None], sums[:, 9:12] / words[:, None], sums[:, 13] / words, np.sqrt(sums[:, 12] / words) / 10])
    return np.column_stack([shares, np.log(shares + 0.003)])


@dataclass
class Ranker:
    """Raw score: weights times standardised features. ``cut`` is the raw score that becomes CUT."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (_standard(x, self.mean, self.scale) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.cut) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, x): the features of every labelled document that is not held out, one row a doc_id; see ``all_labels``.

    Texts are not shuffled: of several of a doc_id the features of the one with the least SHA-256 are kept.
    """

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("digest"), lists], ["_id", "digest", "x"])

    usable = narrow_side(written(all_labels(labels, "quality", MODULUS, REMAINDER), "labels-quality"))
    own = docs.where(F.col("doc_id").isNotNull() & ~held_out(MODULUS, REMAINDER))
    own = own.select(F.col("doc_id").alias("_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    type_ = own.schema["_id"].dataType.simpleString()
    found = own.mapInArrow(featurise, f"_id {type_}, digest string, x array<double>").join(usable, F.col("_id") == F.col("_doc"))
    one = found.groupBy("_id").agg(F.min(F.struct("digest", "x")).alias("one"), F.first("_label").alias("label"))
    return written(one.select("label", F.col("one.x").alias("x")), "training-quality")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)


def _gridded(x: np.ndarray, bits: int) -> np.ndarray:
    """Multiples of 2**-bits; their sums are exact, so a model does not depend on the order of the rows."""
    return np.round(x * 2.0**bits) / 2.0**bits


def _moments(rows: DataFrame, width: int) -> dict[int, np.ndarray]:
    """For each label the number of rows, the sums of the features and those of their squares."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch), np.asarray(batch.column("label"))
            for label in np.unique(y):
                own = x[y == label]
                sums = np.concatenate([[len(own)], _gridded(own, 22).sum(axis=0), _gridded(own**2, 22).sum(axis=0)])
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), *(pa.array([v]) for v in sums)], ["label", *names])

    names = [f"m{k}" for k in range(2 * width + 1)]
    sums = rows.mapInArrow(add, "label int, " + ", ".join(f"{m} double" for m in names)).groupBy("label").agg(*(F.sum(m).alias(m) for m in names))
    return {r["label"]: np.array(r[1:], dtype=float) for r in sums.collect()}


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def _steps(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> dict[int, np.ndarray]:
    """For label 1 and 0 the rows (score, n, d, z..., dz...) of steps of scores: the middle of the step, the number of
    texts there, and the sums of their distances d from the middle, of their features, and of d times the features.
    """
    size = max(1 / 64, 12 * float(np.abs(w).sum()) / MOST_STEPS)
    names = [f"v{k}" for k in range(2 * len(w) + 2)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _gridded(_standard(_matrix(batch), mean, scale), 16)
            raw = (z * w).sum(axis=1)
            step = np.floor(raw / size).astype(np.int64)
            key, of = np.unique(step * 2 + np.asarray(batch.column("label")), return_inverse=True)
            d = raw - (step + 0.5) * size
            values = np.column_stack([np.ones(len(d)), _gridded(d, 24), z, _gridded(z * d[:, None], 24)])
            sums = [pa.array(np.bincount(of, weights=v, minlength=len(key))) for v in values.T]
            yield pa.RecordBatch.from_arrays([pa.array(key), *sums], ["key", *names])

    sums = rows.mapInArrow(add, "key long, " + ", ".join(f"{v} double" for v in names)).groupBy("key").agg(*(F.sum(v).alias(v) for v in names))
    found = np.array(sorted(tuple(r) for r in sums.collect()), dtype=float)
    label, found[:, 0] = found[:, 0] % 2, (found[:, 0] // 2 + 0.5) * size
    return {k: found[label == k] for k in (0, 1)}


def _pair_loss(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean logistic loss over all pairs of a preferred and another text, with the ridge, and its gradient.

    Pairs are taken by the steps of their scores, to the first order of the distances from the middles of these.
    """
    width, pairs = len(w), good[:, 1].sum() * bad[:, 1].sum()
    loss, toward, slope = 0.0, np.zeros(len(bad)), np.zeros(len(bad))
    g = np.zeros(width)
    for at in range(0, len(good), 256):
        c, n, d = good[at : at + 256, :3].T
        u = c[:, None] - bad[None, :, 0]
        p = 1 / (1 + np.exp(np.clip(u, -500, 500)))
        second = p * (1 - p)
        loss += float(n @ np.logaddexp(0, -u) @ bad[:, 1] - d @ p @ bad[:, 1] + n @ p @ bad[:, 2])
        g += (-p @ bad[:, 1] - second @ bad[:, 2]) @ good[at : at + 256, 3 : 3 + width] + (second @ bad[:, 1]) @ good[at : at + 256, 3 + width :]
        toward += -n @ p + d @ second
        slope += n @ second
    g -= toward @ bad[:, 3 : 3 + width] - slope @ bad[:, 3 + width :]
    return loss / pairs + RIDGE * float(w @ w) / 2, g / pairs + RIDGE * w


def _nth(scores: DataFrame, n: int) -> float:
    """The n-th least of ``raw``, exactly: its range is cut to 4,096 parts, and the part that holds it again."""
    low, high = scores.agg(F.min("raw"), F.max("raw")).first()
    while low < high:
        part = F.least(F.floor((F.col("raw") - low) / ((high - low) / 4096)), F.lit(4095))
        parts = scores.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high"))
        for r in sorted(parts.collect()):
            if n <= r["n"]:
                low, high = r["low"], r["high"]
                break
            n -= r["n"]
        scores = scores.where(F.col("raw").between(low, high))
    return low


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Bradley-Terry: the logistic loss of the difference of scores over all pairs of a preferred and another text.

    All labelled rows that are not held out count, and all their pairs: the driver gets sums for steps of the scores, at
    most MOST_STEPS a label, in each of at most STEPS turns of BFGS. The cut is the quantile of all training scores at the
    share of label 0, put in the middle of the gap there. Without both labels every text scores on one side: above the
    cut if only label 1 was seen or none, else below.
    """
    rows, width = _training_rows(docs, labels), features(pa.array([], pa.string())).shape[1]
    per = _moments(rows, width)
    n, sums, squares = np.split(sum(per.values(), np.zeros(2 * width + 1)), [1, width + 1])
    mean = sums / max(n[0], 1)
    scale = np.maximum(np.sqrt(np.maximum(squares / max(n[0], 1) - mean**2, 0)), 1e-3) if n[0] else np.ones(width)
    if 0 not in per or 1 not in per:
        return Ranker(mean, scale, np.zeros(width), -1.0 if 1 in per or 0 not in per else 1.0, 1.0)
    w = np.zeros(width)
    inverse, (loss, g) = np.eye(width), _pair_loss(*(_steps(rows, mean, scale, w)[k] for k in (1, 0)), w)
    size, learned = 1.0, False
    for _ in range(STEPS):
        if np.abs(g).max() < SETTLED:
            break
        move = -inverse @ g
        moved = w + size * move
        now, slope = _pair_loss(*(_steps(rows, mean, scale, moved)[k] for k in (1, 0)), moved)
        if now > loss + 1e-4 * size * float(g @ move):
            if size < 1e-4:
                break
            size /= 4
            continue
        s, y = moved - w, slope - g
        if s @ y > 1e-12:
            inverse = inverse if learned else np.eye(width) * (s @ y) / (y @ y)
            learned = True
            left = np.eye(width) - np.outer(s, y) / (s @ y)
            inverse = left @ inverse @ left.T + np.outer(s, s) / (s @ y)
        w, loss, g, size = moved, now, slope, 1.0
    model = Ranker(mean, scale, w, 0.0, 1.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(model.raw(_matrix(batch)))], ["label", "raw"])

    scores = written(rows.mapInArrow(score, "label int, raw double"), "scores-quality")
    at = int(np.clip(per[0][0], 1, n[0] - 1))
    low = _nth(scores, at)
    upto, above = scores.agg(F.count_if(F.col("raw") <= low), F.min(F.when(F.col("raw") > low, F.col("raw")))).first()
    near = F.round(F.col("raw") * 2.0**20) / 2.0**20
    good = scores.where("label = 1").agg(F.sum(near), F.sum(F.round(near * near * 2.0**20) / 2.0**20)).first()
    variance = good[1] / per[1][0] - (good[0] / per[1][0]) ** 2
    return Ranker(mean, scale, w, (low + (low if upto > at else above)) / 2, float(max(np.sqrt(max(variance, 0)), 1e-6)))


def scored(docs: DataFrame, model: Ranker, column: str = "quality_score") -> DataFrame:
    """All rows and columns of ``docs`` with a score (0 to 1) in ``column``, replacing a column of that name.

    A null text scores as an empty one.
    """
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(features(batch.column(at))))], [*batch.schema.names, column])

    return docs.mapInArrow(score, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= CUT) for every row of ``docs``.

    A null text scores as an empty one, a very long one is read in blocks; repeated rows and equal texts score alike; a
    null doc_id stays and is not held out. Of contradicting labels the greatest counts. Without labels of both kinds all
    texts score on one side of CUT, above it if there are none. An empty table gives an empty result.
    """
    found = scored(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", F.col("quality_score").alias("score"))
    return found.select("doc_id", held_out(MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least CUT; see ``quality`` for odd rows."""
    own = free_name(docs, "quality_score")
    return scored(docs, train(docs, labels), own).where(F.col(own) >= CUT).drop(own)
