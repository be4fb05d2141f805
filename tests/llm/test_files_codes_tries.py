"""Token files, vector codes and the prefix trie against brute force and round trips."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("sessionloom.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F

from sessionloom.llm import tokenfile, turntrie, vectorcodes
from sessionloom.llm.shared import new_path

WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
ALPHABET = ["a", "B", "é", "́", " ", "\t", "\n", "\x1c", "\x85", " ", "<|endoftext|>", "'s", "0", "Σ", "İ", "中", "🙂", "\x00", "</w>", "the", "'LL", "½"]


# 11


def library_ids(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]


def test_encoder_as_the_library(monkeypatch):
    draw = random.Random(1)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    monkeypatch.setattr(tokenfile, "STRETCH", 5)
    monkeypatch.setattr(tokenfile, "WORDS", 50)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):  # the second keeps white space, so whole texts are encoded
        encoder = tokenfile.Encoder(str(public_tokenizers.path(name)))
        assert encoder.by_word == (name[0] == "w")
        for text in texts if encoder.by_word else texts[:100]:
            assert np.frombuffer(b"".join(encoder.parts(text)), encoder.dtype).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("length", "rows"), [(4, 2), (16, 64)])
def test_shards_round_trip(tmp_path, length, rows):
    draw = np.random.default_rng(2)
    docs = [(None if i == 3 else i, draw.integers(0, 60_000, n).astype("<u2")) for i, n in enumerate([5, 0, 1, 40, 8, 8, 300, 3])]
    writer = tokenfile.ShardWriter(open(tmp_path / "s.arrow", "wb"), open(tmp_path / "s.docs.arrow", "wb"), np.dtype("<u2"), tokenfile.pa.int64(), length, rows)
    for doc_id, ids in docs:
        writer.add(doc_id, iter([ids[:2].tobytes(), ids[2:].tobytes()]))
    writer.close()
    shard = tokenfile.Shard.open(str(tmp_path / "s"))
    whole = np.concatenate([ids for _, ids in docs])
    assert shard.sequences == math.ceil(len(whole) / length)
    for i in range(shard.sequences):
        ids, mask = shard.sequence(i)
        real = whole[i * length : (i + 1) * length]
        assert not ids.flags.owndata  # a view of the mapped file
        assert ids[: len(real)].tolist() == real.tolist()
        assert mask.to_pylist() == [k < len(real) for k in range(length)]
    with pytest.raises(IndexError):
        shard.sequence(shard.sequences)
    assert [r["doc_id"] for r in shard.docs.read_all().to_pylist()] == [d for d, _ in docs]
    at = 0
    for row, (_, ids) in zip(shard.docs.read_all().to_pylist(), docs, strict=True):
        assert (row["start"], row["n_tokens"]) == (at, len(ids))
        assert [x for part in shard.span(at, len(ids)) for x in part.tolist()] == ids.tolist()
        at += len(ids)


def test_token_files(spark):
    draw = random.Random(4)
    texts = [None, "", " \n", "one", "Two words", "<|endoftext|> x", "same", "same", "word " * 30_000, "x" * 5000] + ["".join(draw.choice(ALPHABET) for _ in range(200)) for _ in range(60)]
    rows = [(i * 7 % 71, t, 1) for i, t in enumerate(texts)] + [(5, "again"), (5, "again"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 0)[:3] for r in rows], "doc_id long, text string, start long").repartition(5)
    found = sorted(tokenfile.token_files(docs, WORDS).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    want = collections.defaultdict(list)
    for (doc_id, text, *_), ids in zip(rows, library_ids([r[1] or "" for r in rows]), strict=True):
        want[doc_id].append((len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
    at, got = 0, collections.defaultdict(list)
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
        got[r["doc_id"]].append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert tokenfile.token_files(docs.where("false"), WORDS).count() == 0


def test_a_lost_shard_is_not_read(spark):
    folder = new_path(spark, "token-files")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    manifest = tokenfile.write_shards(docs, WORDS, folder).cache()
    fs, local = tokenfile.storage(folder)
    with fs.open_output_stream(f"{local}/half.arrow") as out:  # as a task leaves it that died while writing
        out.write(b"ARROW1")
    assert tokenfile.read_shards(manifest).count() == 40
    assert manifest.agg(F.sum("n_docs")).first()[0] == 40


# 12


def codes_brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], ""
    wide = len(kept[0][2]) // parts
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((gap(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = collections.defaultdict(list)
            for c in cut:
                own[near(p, c[p])[1]].append(c[p])
            new.append([[sum(x) // len(own[e]) for x in zip(*own[e], strict=True)] if e in own else books[p][e] for e in range(len(books[p]))])
        books = new
    out = []
    for (i, label, _), c in zip(kept, cut, strict=True):
        found = [near(p, c[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    per = collections.Counter()
    for _, label, _, error in out:
        per[label] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), code, error, per[label]) for i, label, code, error in out), sha


def test_nearest_is_exact():
    draw = np.random.default_rng(3)
    for spread in (2, 5, 1000):  # small spreads have many ties
        entries, points = (draw.integers(-spread, spread, (n, 6)) for n in (70, 900))
        index, best = vectorcodes.Codebook(entries).nearest(points)
        gaps = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert index.tolist() == gaps.argmin(axis=1).tolist()
        assert best.tolist() == gaps.min(axis=1).tolist()
    low, high = vectorcodes.Codebook(np.array([[3, 4], [0, 1], [6, 8]])).annulus(np.array([7.0]), np.array([4]))
    assert (low.tolist(), high.tolist()) == ([1], [2])  # the norm 5 on the edge is inside
    low, high = vectorcodes.Codebook(np.array([[3, 4], [0, 1], [6, 8]])).annulus(np.array([7.0]), np.array([9]))
    assert (low.tolist(), high.tolist()) == ([1], [3])


@pytest.mark.parametrize("n", [3, 400])
def test_vector_codes(spark, n):
    draw = random.Random(n)
    point = lambda: [draw.choice([-1, 0, 1]) * draw.random() for _ in range(8)]
    rows = [(i * 17 % n, draw.choice([None, 1, 2]), point()) for i in range(n)] + [(1, 1, [0.5] * 8)] * 4
    rows += [(900, 1, None), (901, 2, []), (902, 2, [float("nan")] * 8), (903, None, [float("-inf")] + [0.0] * 7), (904, None, [None] + [0.0] * 7), (None, None, point())]
    table = spark.createDataFrame([(i, v, label, 0) for i, label, v in rows], "vec_id long, embedding array<double>, label int, code int").repartition(4)
    found = vectorcodes.vector_codes(table).collect()
    want, sha = codes_brute(rows)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in found) == want
    assert {r["codebooks_sha256"] for r in found} == {sha}
    assert vectorcodes.vector_codes(table.where("vec_id = 900")).count() == 0
    with pytest.raises(ValueError, match="length"):
        vectorcodes.vector_codes(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], "vec_id long, embedding array<double>, label int"))


# 13


def trie_brute(rows):
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(ts)] for c, ts in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = (talks.get(c - c % 5, [])[:h] + own[h:]) if c % 5 else own
    nodes = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in nodes.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("heavy", "batch"), [(1, 3), (3, 1), (6, 10), (10**6, 10**6)])
def test_prefix_trie(spark, heavy, batch):
    draw = random.Random(heavy)
    texts = ["", "a", "b", "ü" * 5, None]
    rows = [(c, t, draw.choice(["user", "assistant", None]), draw.choice(texts)) for c in range(90) if c % 7 for t in range(draw.choice([1, 2, 5, 12]))]
    rows += [(c, t, "user", "copy") for c in range(200, 230) for t in range(3)] + [(205, 0, "user", "tie"), (205, 0, "user", "a tie"), (205, 0, "user", "tie"), (206, None, "user", "first"), (None, 1, "user", "x")]
    rows += [(300, t, "user", f"long {t}") for t in range(400)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(4)
    found = turntrie.prefix_trie(table, heavy, batch).collect()
    assert sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in found) == trie_brute(rows)


def test_prefix_trie_of_odd_tables(spark):
    table = spark.createDataFrame([(5, None, None, None), (6, 1, "user", "x")], "conv_id int, turn int, role string, text string")
    assert sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in turntrie.prefix_trie(table).collect()) == trie_brute([tuple(r) for r in table.collect()])
    assert turntrie.prefix_trie(table.where("conv_id = 5")).count() == 2
    assert turntrie.prefix_trie(table.where("false")).count() == 0
    assert turntrie.prefix_trie(table.withColumn("conv_id", F.lit(None).cast("long"))).count() == 0


def test_louds_bits():
    # roots 10 and 20; 10 has 11 and 12, 12 has 13
    keys = np.array([[13, 0], [20, 0], [10, 0], [12, 0], [11, 0]])
    above = np.array([[12, 0], [0, 0], [0, 0], [10, 0], [10, 0]])
    order, trie = turntrie.laid_out(np.array([0, 1, 0, 0, 0]), np.array([2, 5, 0, 1, 1]), keys, above)
    assert keys[order, 0].tolist() == [10, 20, 11, 12, 13]
    assert "".join("01"[b] for b in trie.bits.tolist()) == "11011000100"
    assert trie.children().tolist() == [2, 0, 0, 1, 0]
    assert trie.parents().tolist() == [-1, -1, 0, 0, 3]
    assert trie.summed(np.arange(1, 6)).tolist() == [13, 2, 3, 9, 5]
