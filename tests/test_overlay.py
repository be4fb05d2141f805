"""Groups under vetoes against taking the edges one by one."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import overlay, retrieval


def one_by_one(edges):
    group = {i: {i} for a, b, *_ in edges for i in (a, b)}
    bad = {(min(a, b), max(a, b)) for a, b, _, veto in edges if veto}
    for a, b, _, veto in sorted(edges, key=lambda e: (-e[2], min(e[:2]), max(e[:2]))):
        x, y = group[a], group[b]
        if veto or x is y or any((min(i, j), max(i, j)) in bad for i in x for j in y):
            continue
        x |= y
        for i in y:
            group[i] = x
    return {i: min(g) for i, g in group.items()}


@pytest.mark.parametrize("seed", range(3))
def test_groups(spark, seed):
    draw = random.Random(seed)
    n = 40
    edges = [(a, b, draw.choice([0.82, 0.9, 0.95, draw.random()]), draw.random() < 0.2) for a in range(n) for b in range(a + 1, n) if draw.random() < (0.04, 0.1, 0.3)[seed]]
    found = overlay.merged_groups(spark.createDataFrame(edges, "a long, b long, similarity double, veto boolean")).collect()
    assert {r["id"]: r["group_id"] for r in found} == one_by_one(edges)


def test_no_edges(spark):
    assert overlay.merged_groups(spark.createDataFrame([], "a long, b long, similarity double, veto boolean")).count() == 0


def _copied(spark, copies=40):
    """Rows of six vectors, of which two pairs are similar, each many times over; (id, embedding, label)."""
    base = [[1.0, 0.0, 0.0], [0.9, 0.3, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.2, 0.9], [0.0, 0.0, 0.0]]
    return [(6 * k + i, v, 1 + (k == 1)) for k in range(copies) for i, v in enumerate(base)]


def test_similar_pairs_meet_by_classes(spark):
    """equal vectors are one class; before, the rows were compared, all with all."""
    rows = _copied(spark)
    frame = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    members, links = retrieval.near_classes(frame, "label", 0.82)
    assert links.count() == 2 * 2 + 5 and members.count() == len(rows)
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / ((sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5 or 1)
    want = {(a, b, round(cos(x, y), 6)) for a, x, s in rows for b, y, t in rows if a < b and s == t and round(cos(x, y), 6) >= 0.82}
    assert {tuple(r) for r in retrieval.pairs_within(frame, "label", 0.82).collect()} == want


def test_similar_pairs_over_many_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], 0) for i in range(35)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    whole = {tuple(r) for r in retrieval.pairs_within(frame, "label", 0.82).collect()}
    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 6)
    assert {tuple(r) for r in retrieval.pairs_within(frame, "label", 0.82).collect()} == whole and whole


def test_successors_by_classes_are_those_by_pairs(spark):
    """classes meet by their different times; before, every pair of copies was a row."""
    frame = spark.createDataFrame(_copied(spark, 15), "id long, embedding array<double>, label int")
    dated = frame.select("id", (frame.id % 4).alias("ts"))
    pairs = retrieval.pairs_within(frame, "label", 0.82).select("a", "b")
    members, links = retrieval.near_classes(frame, "label", 0.82)
    got = {r["id"]: (r["successor"], r["status"]) for r in overlay.succeeded_classes(dated, members, links).collect()}
    assert got == {r["id"]: (r["successor"], r["status"]) for r in overlay.succeeded(dated, pairs).collect()}
    linked = [(r["a"], r["b"]) for r in pairs.collect()]
    linked += [(b, a) for a, b in linked]
    for i in got:
        later = sorted((b % 4, b) for a, b in linked if a == i and b % 4 > i % 4)
        equal = any(a == i and b % 4 == i % 4 for a, b in linked)
        assert got[i] == ((later[0][1], "superseded") if later else (None, "disputed" if equal else "active"))


def test_groups_of_copies_in_few_turns(spark):
    """what one kind of thesis connects is a group; before, a hub with copies took as many turns as it has copies."""
    rows = [(i, "t", "it is rejected" if i % 9 == 0 else "so", v) for i, v, _ in _copied(spark, 60)]
    claims = spark.createDataFrame(rows, "id long, target string, thesis string, embedding array<double>").withColumn("ts", F.col("id"))
    got = {r["id"]: r["group_id"] for r in overlay.grouped(claims).collect()}
    key = lambda i: (i if i % 6 == 5 else (0, 0, 1, 2, 2)[i % 6], i % 9 == 0)
    first = {}
    for i in sorted(got):
        first.setdefault(key(i), i)
    assert got == {i: first[key(i)] for i in got}


def test_connected_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["group_id"] for r in overlay.connected(links).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {101: 100}
