"""The pipeline stage by stage on small tables, against brute force on each stage's own input."""

import collections

import pytest

pytest.importorskip("sessionloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F
from test_operators import labelled, leak_brute, near_brute, waterfill

from sessionloom.llm import quality, toxicity


def test_stages(spark, tmp_path):
    docs, labels = labelled(spark)
    items = [(0, docs.where("doc_id = 3").first()["text"]), (1, "nothing of this kind stands in any of the documents at all")]
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    sf, seen = str(tmp_path), [docs]
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/stage{at}")
        seen.append(spark.read.parquet(f"{tmp_path}/stage{at}"))
    assert all(s.columns == docs.columns for s in seen[1:-1])
    rows = [sorted(s.collect(), key=lambda r: (r["doc_id"], r["text"] or "")) for s in seen]
    ids = [[r["doc_id"] for r in s] for s in rows]
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality(docs, labels).collect()}
    assert ids[1] == [i for i in ids[0] if scores[i] == 1]
    toxic = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(seen[1], labels).collect()}
    assert ids[2] == [i for i in ids[1] if toxic[i] == 0]
    found = near_brute([r["text"] for r in rows[2]])
    assert ids[3] == [i for k, i in enumerate(ids[2]) if found[k][1] == k]
    leaks = leak_brute([r["text"] for r in rows[3]], items)
    assert ids[4] == [i for i, leak in zip(ids[3], leaks, strict=True) if not leak[1]]
    per = collections.defaultdict(int)
    for r in rows[4]:
        per[r["source"]] += len((r["text"] or "").split())
    order = [*sorted(s for s in per if s is not None), *([None] if None in per else [])]
    target = dict(zip(order, waterfill([per[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(per.values())), strict=True))
    copies = collections.Counter(ids[5])
    for r in rows[4]:
        rate = target[r["source"]] / per[r["source"]] if per[r["source"]] else 0
        assert copies[r["doc_id"]] in (int(rate + 1e-9), int(rate + 1e-9) + 1)
    assert seen[-1].where(F.col("mix_copy") < 1).count() == 0


def test_stages_of_odd_tables(spark, tmp_path):
    docs, labels = labelled(spark)
    docs, labels = docs.limit(30), labels.where("false")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for case, some in (("empty", docs.where("false")), ("nulls", docs.withColumn("text", F.lit(None).cast("string"))), ("plain", docs.withColumn("label", F.lit(1)))):
        sf = f"{tmp_path}/{case}"
        for name, df in (("documents", some), ("labels", labels), ("benchmark", benchmark)):
            df.write.parquet(f"{sf}/{name}.parquet")
        found = corpus_pipeline.run(spark, sf)
        assert set(some.columns) - {"target"} <= set(found.columns)
        assert (found.count() == 0) == (case != "plain")
