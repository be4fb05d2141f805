"""The labelled rows of the classifiers: a bounded sample, or all."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("sessionloom.llm")

from sessionloom.llm import quality
from sessionloom.llm.training import labelled_sample


def test_repeated_rows_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(7, f"text {i % 3}") for i in range(50)] + [(i, f"other {i}") for i in range(100, 130)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] + [(i, i % 2) for i in range(100, 130)], "doc_id long, toxic int")
    only = labelled_sample(docs.where("doc_id = 7"), labels, "toxic", 3, 9, 10)
    assert only.count() == 1
    assert labelled_sample(docs, labels, "toxic", 3, 9, 10).count() == 10
    assert labelled_sample(docs, labels, "toxic", 3, 9, 100).count() == 31


def test_labels_of_absent_documents_use_up_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(2000)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    found = labelled_sample(docs, labels, "quality", 5, 9, 15).collect()
    assert len(found) == 15
    assert all(r["label"] == 1 for r in found)
    assert labelled_sample(docs.where("false"), labels, "quality", 5, 9).count() == 0
    assert labelled_sample(docs.withColumn("text", docs.text.substr(0, 0)), labels, "quality", 5, 9).count() == 20


def test_quality_is_fitted_on_all_rows_and_pairs(spark):
    """The statistics, weights and cut are those of a plain fit over all pairs of more rows than the sample held."""
    rng = np.random.default_rng(4)
    texts = [("a b " * int(rng.integers(2, 9)) + "! " * int(rng.integers(0, 6)) + "Cd7 " * int(rng.integers(0, 6))) for _ in range(15_500)]
    good = [int(rng.random() < 1 / (1 + np.exp(3 * t.count("!") - 2 * t.count("7")))) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(good)), "doc_id long, quality int")
    model = quality.train(docs, labels)
    use = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(len(texts))])
    x, y = quality.features(pa.array(texts))[use], np.array(good)[use]
    assert model.mean == pytest.approx(x.mean(axis=0), abs=1e-6)
    assert model.scale == pytest.approx(np.maximum(x.std(axis=0), 1e-3), abs=1e-5)
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    raw = z @ model.weights
    p = 1 / (1 + np.exp(raw[y == 1][:, None] - raw[y == 0][None]))
    slope = (p.mean(axis=0) @ z[y == 0] / (y == 0).sum() - p.mean(axis=1) @ z[y == 1] / (y == 1).sum()) + quality.RIDGE * model.weights
    assert np.abs(slope).max() < 3e-4
    ordered = np.sort(raw)
    at = int((y == 0).sum())
    assert model.cut == pytest.approx((ordered[at - 1] + ordered[at]) / 2, abs=1e-9)
    assert model.spread == pytest.approx(raw[y == 1].std(), abs=1e-4)
