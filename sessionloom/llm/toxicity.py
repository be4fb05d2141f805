"""Toxicity by a counterfactually regularised classifier.

Identity terms in the labelled sentences are swapped for other terms of their group, and the change of the score that this
makes is penalised, so that neutral mentions of a group do not score by themselves. As sentences with such terms may be
few, every labelled sentence is also taken with a term put at its end: with its label, so that chance could tie the term
to the label, and against the sentence with another term of the group and with none, so that the penalty unties it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.textarrays import ALPHANUMERIC, BLOCK, Words, blocks, pieces, text_bytes
from sessionloom.llm.training import SAMPLE_ROWS, free_name, held_out, labelled_sample

MODULUS, REMAINDER = 3, 1
CUT = 0.7
#: Hash space of the words and word beginnings, and how many of them a model may use.
SPACE = 1 << 20
TERMS = 512
PREFIXES = (0, 4, 5, 6)
LEAST_TEXTS = 3
LEAST_Z = 3.5
SWAP_PENALTY = 10.0
RIDGE = 2e-5
STEPS = 60
#: The step at which Newton's method has converged.
SETTLED = 1e-6

#: Groups of identity terms that may stand for one another.
IDENTITY_TERMS = (
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "foreigner", "refugee", "citizen"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
)


def swapped(text: str, shift: int = 1) -> str:
    """``text`` with each identity term replaced by the one ``shift`` places on in its group; others stay as they are."""
    step = {w: group[(i + shift) % len(group)] for group in IDENTITY_TERMS for i, w in enumerate(group)}
    out, word = [], []
    for c in text + " ":
        if c.isalpha():
            word.append(c)
            continue
        if word:
            own = "".join(word)
            out.append(step.get(own.lower(), own))
            word = []
        out.append(c)
    return "".join(out)[:-1]


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every word and every word beginning; a beginning counts only in words that are longer."""
    words = Words(data, offsets, ALPHANUMERIC)
    of, size = words.owner(), words.end - words.start
    texts, terms = [], []
    for k, h in zip(PREFIXES, words.hashes(*PREFIXES), strict=True):
        use = size > k
        texts.append(of[use])
        terms.append(((h[use] ^ np.uint64(k * 0x51ED270B)) % np.uint64(SPACE)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(terms)


def _whole_words(words: pa.Array) -> list[int]:
    """The terms that stand for these words themselves, not for their beginnings."""
    data, offsets = text_bytes(words)
    return (Words(data, offsets, ALPHANUMERIC).hashes()[0] % np.uint64(SPACE)).astype(np.int64).tolist()


def term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first and the end of the run, and (text, term) pairs of it; a long text comes in parts."""
    data, offsets = text_bytes(column)
    for lo, hi in blocks(offsets):
        part = offsets[lo : hi + 1]
        own = data[part[0] : part[-1]]
        if hi - lo == 1 and len(own) > BLOCK:
            for p in pieces(own, ALPHANUMERIC):
                yield (lo, hi, *_terms(p, np.array([0, len(p)])))
        else:
            yield (lo, hi, *_terms(own, part - part[0]))


@dataclass
class Classifier:
    """Logistic on log(1 + count) of the chosen terms; ``place`` maps a hashed term to its weight, or -1."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        z = np.full(len(column), self.bias)
        counts: dict[int, np.ndarray] = {}
        for lo, hi, of, terms in term_counts(column):
            at = self.place[terms]
            of, at = of[at >= 0], at[at >= 0]
            counts[lo] = counts.get(lo, 0) + np.bincount(of * len(self.weights) + at, minlength=(hi - lo) * len(self.weights)) if len(of) else counts.get(lo, np.zeros((hi - lo) * max(1, len(self.weights))))
            if len(self.weights):
                z[lo:hi] = self.bias + np.log1p(counts[lo].reshape(hi - lo, -1)) @ self.weights
            if lo + 1 < hi:
                del counts[lo]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def choose_terms(sample: DataFrame) -> tuple[list[int], int, int]:
    """The at most TERMS terms that most mark label 1, by the z of the difference of their shares of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SPACE), dtype=np.int32)
        for batch in batches:
            label = np.asarray(batch.column("label"))
            for lo, _, of, terms in term_counts(batch.column("text")):
                pair = np.unique(of * SPACE + terms)
                np.add.at(seen, (label[lo + pair // SPACE], pair % SPACE), 1)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at].astype(np.int64)), pa.array(seen[1, at].astype(np.int64))], ["term", "n0", "n1"])

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return [], n0, n1
    terms = sample.mapInArrow(count, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
    share = (F.col("c0") + F.col("c1") + 1) / (n0 + n1 + 2)
    z = (F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    best = terms.select("term", "c1", z.alias("z")).where((F.col("c1") >= LEAST_TEXTS) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "term").limit(TERMS)
    return sorted(r["term"] for r in best.collect()), n0, n1


def fit(x: np.ndarray | list[np.ndarray], y: np.ndarray, changes: np.ndarray | Iterable[np.ndarray], penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Logistic loss, plus ``penalty`` times the mean squared change of the score over the rows of ``changes``.

    Newton's method with halved steps; the loss is convex and the ridge makes its minimum unique.
    """
    n, width = len(y), next(_parts(x)).shape[1]
    w, b = np.zeros(width), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    gram, count = np.zeros((width, width)), 0
    for part in _parts(changes):
        gram += part.T @ part
        count += len(part)
    quadratic = RIDGE * np.eye(width) + 2 * penalty / max(1, count) * gram

    def loss(w: np.ndarray, b: float) -> float:
        z = np.clip(np.concatenate([part @ w for part in _parts(x)]) + b, -500, 500)
        return float(np.mean(np.logaddexp(0, z) - y * z) + w @ quadratic @ w / 2)

    now = loss(w, b)
    for _ in range(STEPS):
        g, h = np.append(quadratic @ w, 0.0), np.zeros((width + 1, width + 1))
        h[:width, :width] = quadratic
        at = 0
        for part in _parts(x):
            own = np.append(part, np.ones((len(part), 1)), axis=1)
            p = 1 / (1 + np.exp(-np.clip(part @ w + b, -500, 500)))
            g += own.T @ (p - y[at : at + len(part)]) / n
            h += own.T @ (own * (np.maximum(p * (1 - p), 1e-9) / n)[:, None])
            at += len(part)
        move = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-4 and loss(w - size * move[:-1], b - size * move[-1]) > now:
            size /= 2
        w, b = w - size * move[:-1], b - size * move[-1]
        now = loss(w, b)
        if np.abs(size * move).max() < SETTLED:
            break
    return w, b


def _parts(rows: np.ndarray | Iterable[np.ndarray], size: int = 2048) -> Iterator[np.ndarray]:
    """The rows of one or several arrays in parts, so that 64-bit temporaries stay small."""
    for array in [rows] if isinstance(rows, np.ndarray) else rows:
        for at in range(0, len(array), size):
            yield array[at : at + size].astype(np.float64)


def mentions(n: int, seed: int = 11) -> np.ndarray:
    """(n, 2): for each sentence the number of an identity term and of another one of its group."""
    draw = np.random.default_rng(seed)
    sizes = np.array([len(g) for g in IDENTITY_TERMS])
    group = draw.integers(0, len(sizes), n)
    one = draw.integers(0, sizes[group])
    other = (one + draw.integers(1, sizes[group])) % sizes[group]
    first = np.cumsum(sizes) - sizes
    return np.stack([first[group] + one, first[group] + other], axis=1)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, penalty: float = SWAP_PENALTY) -> Classifier:
    """Chooses the terms in one pass over the bounded sample and counts them in a second, before and after the swap.

    The identity terms are always among them. What reaches the driver is at most TERMS and these, counted in at most
    ``rows`` texts.
    """
    sample = labelled_sample(docs, labels, "toxic", MODULUS, REMAINDER, rows)
    chosen, n0, n1 = choose_terms(sample)
    place = np.full(SPACE, -1, dtype=np.int64)
    if chosen:
        terms = pa.array([t for group in IDENTITY_TERMS for t in group])
        chosen = sorted({*chosen, *_whole_words(terms)})
    place[chosen] = np.arange(len(chosen))
    if not chosen:
        return Classifier(place, np.zeros(0), float(np.log((n1 + 1) / (n0 + 1))) if n0 or n1 else -2.0)
    width = len(chosen)

    def chosen_counts(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), width), dtype=np.int32)
        for lo, _, of, terms in term_counts(column):
            at = place[terms]
            np.add.at(out, (lo + of[at >= 0], at[at >= 0]), 1)
        return out

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            counts = chosen_counts(texts)
            turned = chosen_counts(pa.array([swapped(t or "") for t in texts.to_pylist()], pa.string()))
            sparse = lambda m: ([np.flatnonzero(r).astype(np.int32) for r in m], [r[r > 0] for r in m])
            (i, n), (j, k) = sparse(counts), sparse(turned)
            lists = [pa.array(v, pa.list_(pa.int32())) for v in (i, n, j, k)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *lists], ["label", "i", "n", "j", "k"])

    found = sample.mapInArrow(featurise, "label int, i array<int>, n array<int>, j array<int>, k array<int>").toArrow()
    y = found.column("label").to_numpy()

    def dense(at: str, n: str) -> np.ndarray:
        at, n = found.column(at).combine_chunks(), found.column(n).combine_chunks()
        out = np.zeros((len(y), width), dtype=np.float32)
        row = np.repeat(np.arange(len(y)), np.diff(np.asarray(at.offsets)))
        out[row, np.asarray(at.flatten())] = np.log1p(np.asarray(n.flatten()))
        return out

    x, other = dense("i", "n"), dense("j", "k")
    order = np.lexsort((x @ np.sin(np.arange(width)), y))
    x, other, y = x[order], other[order], y[order]
    added = chosen_counts(terms).astype(np.float32)
    one, two = mentions(len(y)).T
    mention = lambda at, k: np.log1p(np.expm1(x[at]) + added[k[at]])
    spans = [slice(at, at + 2048) for at in range(0, len(y), 2048)]
    with_one = np.empty_like(x)
    for at in spans:
        with_one[at] = mention(at, one)

    def changes() -> Iterator[np.ndarray]:
        for at in spans:
            yield x[at] - other[at]
            yield with_one[at] - mention(at, two)
            yield with_one[at] - x[at]

    return Classifier(place, *fit([x, with_one], np.concatenate([y, y]), changes(), penalty))


def scored(docs: DataFrame, model: Classifier, column: str = "toxicity_score") -> DataFrame:
    """All rows and columns of ``docs`` with a score (0 to 1) in ``column``, replacing a column of that name.

    A null text scores as an empty one.
    """
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(batch.column(at)))], [*batch.schema.names, column])

    return docs.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= CUT) for every row of ``docs``.

    A null text scores as an empty one, a very long one is read in blocks; repeated rows and equal texts score alike; a
    null doc_id stays and is not held out. Of contradicting labels the greatest counts. Without labels of both kinds all
    texts score alike, under CUT if there are none. An empty table gives an empty result.
    """
    found = scored(docs.select("doc_id", "text"), train(docs, labels, rows)).select("doc_id", F.col("toxicity_score").alias("score"))
    return found.select("doc_id", held_out(MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def clean_only(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score under CUT; see ``toxicity`` for odd rows."""
    own = free_name(docs, "toxicity_score")
    return scored(docs, train(docs, labels, rows), own).where(F.col(own) < CUT).drop(own)
