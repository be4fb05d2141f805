"""MinHash near-duplicates by a chosen-path set similarity join.

Every set gets COORDINATES minhash values. A tree branches its nodes: a node picks BRANCHES coordinates by its own seed,
and each of its documents goes to one child per picked coordinate, the one of its value there. Two sets of similarity J
stay together in a child with probability 1 - (1 - J)**BRANCHES, and TREES independent trees bring the recall to target.

A node needs no more than the links that join its components. Where at most SMALL of its sets lie outside its largest
component, these are compared with all sets of the node, and the node is done. A larger node is compared with PIVOTS of
its sets, of components drawn by hash, and branches, so that unlike sets part. Sets that resemble most of their node do
not part by branching: where a share of DENSE resembles the pivots, the node is compared with further pivots as long as
these halve what lies outside, and then what lies outside is compared with the whole node. A large group of near copies so
falls together under its pivots. Dense nodes that share a set, which lie in several trees, are united first, so that the
group is compared once and not in each of them; and where most sets of a node of a later tree have been compared in one
node of the first, only the sets outside of that one are compared with the node. What is still large DEPTH levels down is compared exhaustively as well. However large a node is, its sets go to many tasks in parts of bounded size. Pairs that a
node of the first tree has compared are not compared again in other trees.

Comparing means: sizes within the threshold, one-bit sketches within MAX_BITS of each other, then the full shingle sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.components import components, merged, near_labels
from sessionloom.llm.shared import narrow_side, written
from sessionloom.llm.textarrays import blocks, mixed, shingle_sets, text_bytes, word_hashes

SHINGLE = 5
#: Similarity in per cent.
THRESHOLD = 75
COORDINATES = 128
#: Coordinates that trees may pick.
PICKED = 64
TREES = 6
BRANCHES = 2
#: Sets outside the largest component of a node that are compared with the whole node.
SMALL = 500
PIVOTS = 8
DEPTH = 8
#: The share of a node that must resemble its pivots or be its largest component for the node to be compared at once.
DENSE = 0.5
#: Sets, and shingles of them, of a node that one group compares with pivots or with the sets outside.
PART_SETS = 1024
PART_SHINGLES = 1 << 20
#: Sets of a node from which its size travels by broadcast; so few nodes have so many.
HOT = 1000
#: Differing bits of 128 that a pair at the threshold exceeds with a probability under 1e-9 (mean 16, deviation 3.7);
#: the trees themselves lose 6e-8.
MAX_BITS = 44

_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(8).integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bits_a long, bits_b long, nodes array<long>, mins binary"
#: What an entry of a node knows of its set; ``mark`` tells apart the texts of rows that share a doc_id.
ENTRY = "id long, mark long, n long, bits_a long, bits_b long, seen array<long>"
GROUP = ["node", "chunk", "part"]
FIELDS = ["id", "mark", "n", "bits_a", "bits_b", "seen"]

def _picks(nodes: np.ndarray) -> np.ndarray:
    """For each node BRANCHES different coordinates, drawn by the node's own hash."""
    first = mixed(nodes) % np.uint64(PICKED)
    step = mixed(nodes + np.uint64(1)) % np.uint64(PICKED - 1) + np.uint64(1)
    return np.stack([(first + np.uint64(j) * step) % np.uint64(PICKED) if j < 2 else mixed(nodes + np.uint64(j)) % np.uint64(PICKED) for j in range(BRANCHES)], axis=1).astype(np.int64)


def _children(nodes: np.ndarray, mins: np.ndarray) -> np.ndarray:
    """(rows, BRANCHES) ids of the children that rows with these minhash values go to."""
    picks = _picks(nodes)
    values = np.take_along_axis(mins, picks, axis=1).astype(np.uint64)
    return mixed(mixed(values * np.uint64(0x9E3779B97F4A7C15) + picks.astype(np.uint64)) + mixed(nodes)[:, None])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roots = mixed(np.arange(1, TREES + 1, dtype=np.uint64))
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in blocks(offsets):
            part = offsets[lo : hi + 1]
            hashes, first = word_hashes(data[part[0] : part[-1]], part - part[0])
            sets = shingle_sets(hashes, first, SHINGLE)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            has = np.flatnonzero(n)
            mins = np.zeros((len(has), COORDINATES), dtype=np.uint64)
            set_a, set_b = np.zeros(len(has), np.uint64), np.zeros(len(has), np.uint64)
            if len(has):
                values = np.concatenate([sets[i] for i in has])
                at = np.concatenate([[0], np.cumsum(n[has])[:-1]])
                for j in range(COORDINATES):
                    mins[:, j] = np.minimum.reduceat((values ^ _SHIFTS[j]) * _FACTORS[j], at)
                set_a, set_b = np.add.reduceat(mixed(values ^ np.uint64(0xA5A5)), at), np.add.reduceat(mixed(values ^ np.uint64(0x5A5A0000)), at)
            bits = np.packbits((mixed(mins) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64).reshape(-1, 2)
            kept = (mins[:, :PICKED] >> np.uint64(32)).astype(np.uint32)
            nodes = np.concatenate([_children(np.full(len(has), r, np.uint64), kept) for r in roots], axis=1) if len(has) else np.zeros((0, TREES * BRANCHES), np.uint64)
            where = np.full(hi - lo, -1)
            where[has] = np.arange(len(has))
            take = pa.array(where, mask=where < 0)
            per_set = [pa.array(x.view(np.int64)) for x in (set_a, set_b)] + [pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy())]
            lists = pa.ListArray.from_arrays(np.arange(0, nodes.size + 1, TREES * BRANCHES, dtype=np.int32), nodes.view(np.int64).ravel())
            raw = pa.array([r.tobytes() for r in kept], pa.binary())
            columns = [batch.column(0).slice(lo, hi - lo), pa.array(n), *(c.take(take) for c in (*per_set, lists, raw))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "bits_a", "bits_b", "nodes", "mins"])


def _mark(values: np.ndarray) -> np.ndarray:
    return mixed(values ^ np.uint64(0xA5A5)).sum(dtype=np.uint64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in blocks(offsets):
            part = offsets[lo : hi + 1]
            sets = shingle_sets(*word_hashes(data[part[0] : part[-1]], part - part[0]), SHINGLE)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets)
            marks = np.array([_mark(x) for x in sets], dtype=np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(ends, values.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(marks), lists], ["id", "mark", "set"])


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        mins = np.frombuffer(b"".join(batch.column("mins").to_pylist()), dtype=np.uint32).reshape(-1, PICKED)
        children = _children(np.asarray(batch.column("node")).view(np.uint64), mins)
        names = ["depth", *FIELDS]
        for j in range(BRANCHES):
            yield pa.RecordBatch.from_arrays([pa.array(children[:, j].copy().view(np.int64)), *(batch.column(c) for c in names)], ["node", *names])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of rows of one group; the rows come sorted by GROUP."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in GROUP], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[a])
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _gathered(tables: Iterator[pa.Table], rows: int = 5000) -> Iterator[pa.RecordBatch]:
    """Small tables put together."""
    held, n = [], 0
    for table in tables:
        if table.num_rows:
            held.append(table)
            n += table.num_rows
        if n >= rows:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def _padded(lists: pa.ListArray) -> list[np.ndarray]:
    """The first, second, ... of each list, 0 where there is none."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    starts, values = np.asarray(lists.offsets)[:-1], np.asarray(lists.values)
    out = []
    for k in range(int(sizes.max(initial=0))):
        column = np.zeros(len(sizes), dtype=np.int64)
        column[sizes > k] = values[starts[sizes > k] + k]
        out.append(column)
    return out


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each group that have a partner in another component which sizes and sketches do not rule out.

    Of the two one is short: a pivot, or a set outside the largest component. Pairs that were compared before are left out.
    """

    def of(group: pa.Table) -> pa.Table:
        col = lambda c: group.column(c).to_numpy()
        n, component, short = col("n"), col("component"), np.flatnonzero(col("short"))
        bits = (col(c).view(np.uint64) for c in ("bits_a", "bits_b"))
        differing = sum(np.bitwise_count(x[short][:, None] ^ x[None]).astype(np.int64) for x in bits)
        sizes = 100 * np.minimum(n[short][:, None], n[None]) >= THRESHOLD * np.maximum(n[short][:, None], n[None])
        alike = (differing <= MAX_BITS) & sizes & (component[short][:, None] != component[None])
        seen = _padded(group.column("seen").chunk(0))
        for x, y in itertools.product(seen, seen):
            alike &= (x[short][:, None] != y[None]) | (x[short][:, None] == 0)
        keep = alike.any(axis=0)
        keep[short] |= alike.any(axis=1)
        return group.select([*GROUP, "id", "mark", "component", "short"]).filter(pa.array(keep))

    yield from _gathered(map(of, _groups(batches)))


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group links that join its components where a short set is linked to another: each that is joined to the least one."""

    def of(group: pa.Table) -> pa.Table:
        lists = group.column("set").chunk(0)
        starts = np.asarray(lists.offsets)
        values = np.asarray(lists.values)[starts[0] : starts[-1]]
        starts, sizes = (starts - starts[0])[:-1], np.diff(starts)
        root = group.column("component").to_numpy().copy()
        known, place = np.unique(values, return_inverse=True)
        own = np.zeros(len(known), dtype=np.uint8)
        before = root.copy()
        for i in np.flatnonzero(group.column("short").to_numpy()):
            mine = place[starts[i] : starts[i] + sizes[i]]
            own[mine] = 1
            shared = np.add.reduceat(own[place], starts, dtype=np.int64)
            own[mine] = 0
            for j in np.flatnonzero((100 * shared >= THRESHOLD * (sizes[i] + sizes - shared)) & (root != root[i])):
                if root[j] != root[i]:
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
        moved = np.unique(before[before != root], return_index=True)[1] if (before != root).any() else np.zeros(0, np.int64)
        at = np.flatnonzero(before != root)[moved]
        return pa.table({"a": before[at], "b": root[at]})

    yield from _gathered(map(of, _groups(batches)))


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``entries`` with the component of each id: itself, or what earlier links say."""
    if labels is None:
        return entries.withColumn("component", F.col("id"))
    known = narrow_side(labels.select(F.col("id").alias("_id"), F.col("component").alias("_known")))
    return entries.join(known, F.col("id") == F.col("_id"), "left").select(*entries.columns, F.coalesce("_known", "id").alias("component"))


def _draw(turn: int, k: int, chosen: str) -> Column:
    """The least of this over a node's components draws one, and of the component the set with the least hash ``chosen``."""
    return F.xxhash64(F.lit(turn), F.lit(k), "component", chosen)


def _with_blocks(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``block``, and with its sets and shingles in place of those of the largest component."""
    large = nodes.where(F.col("members") - F.col("most") > SMALL).select("node")
    per = entries.select("node", "n", F.explode("seen").alias("_block")).join(narrow_side(large), "node").groupBy("node", "_block").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    best = written(per.groupBy("node").agg(F.max(F.struct("c", "_block", "s")).alias("best")), "neardup-blocks")
    better = F.coalesce(F.col("best.c") > F.col("most"), F.lit(False))
    use = {"block": F.when(better, F.col("best._block")), "most": F.when(better, F.col("best.c")).otherwise(F.col("most")), "of_largest": F.when(better, F.col("best.s")).otherwise(F.col("of_largest"))}
    return nodes.join(narrow_side(best), "node", "left").withColumns(use).drop("best")


def _mixed_nodes(entries: DataFrame, turn: int, blocks: bool) -> DataFrame:
    """The nodes with more than one component: sizes, the largest component, pivots of components drawn for this turn.

    ``block`` is a node of an earlier tree which has compared more of these sets than the largest component holds. With
    ``blocks`` it is looked for in nodes that are large without it.
    """
    per = entries.groupBy("node", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.min(F.xxhash64("id", "mark")).alias("set"), F.min("depth").alias("depth"), F.min("was").alias("was"))
    drawn = [F.min(_draw(turn, k, "set")).alias(f"pivot{k}") for k in range(PIVOTS)]
    nodes = per.groupBy("node").agg(
        F.count("*").alias("components"), F.sum("c").alias("members"), F.sum("s").alias("shingles"), F.max("c").alias("most"), F.max_by("component", "c").alias("largest"), F.max_by("s", "c").alias("of_largest"),
        F.min("depth").alias("depth"), F.min("was").alias("was"), *drawn,
    )
    nodes = nodes.where("components > 1").withColumn("block", F.lit(None).cast("long"))
    nodes = _with_blocks(entries, written(nodes, "neardup-mixed")) if blocks else nodes
    rest = F.col("members") - F.col("most")
    done = (rest <= SMALL) | (F.col("depth") >= DEPTH) | F.coalesce(2 * rest > F.col("was"), F.lit(False))
    mode = F.when(done, "all").otherwise("pivots")
    parts = F.greatest(F.ceil(F.col("members") / PART_SETS), F.ceil(F.col("shingles") / PART_SHINGLES), F.lit(1))
    chunks = F.when(done, F.greatest(F.ceil(rest / PART_SETS), F.ceil((F.col("shingles") - F.col("of_largest")) / PART_SHINGLES), F.lit(1))).otherwise(1)
    return nodes.select("node", "members", "depth", rest.alias("rest"), mode.alias("mode"), "largest", "block", F.array(*(f"pivot{k}" for k in range(PIVOTS))).alias("pivots"), parts.cast("int").alias("parts"), chunks.cast("int").alias("chunks"))


def _of_nodes(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``entries`` with what ``nodes`` says of theirs; others go. Nodes with many entries do not meet in one task."""
    hot = narrow_side(nodes.where(F.col("members") > HOT))
    rest = narrow_side(nodes.where(F.col("members") <= HOT))
    cool = entries.join(hot.select("node"), "node", "left_anti").join(rest, "node")
    return entries.join(hot, "node").unionByName(cool)


def _placed(entries: DataFrame, turn: int) -> DataFrame:
    """Each entry once for each group that it takes part in.

    A group is a part of a node with all its short sets, or with a chunk of them where these are many. Short are the
    pivots, or the sets outside the largest component or outside the block.
    """
    entries = entries.withColumn("set", F.xxhash64("id", "mark"))
    pivot = F.arrays_overlap("pivots", F.array(*(_draw(turn, k, "set") for k in range(PIVOTS))))
    outside = F.when(F.col("block").isNull(), F.col("component") != F.col("largest")).otherwise(~F.coalesce(F.array_contains("seen", F.col("block")), F.lit(False)))
    short = F.when(F.col("mode") == "all", outside).otherwise(pivot)
    part = F.pmod(F.xxhash64("id", "mark"), F.col("parts")).cast("int")
    chunk = F.pmod(F.xxhash64("mark", "id"), F.col("chunks")).cast("int")
    place = lambda c, p, s: F.struct(c.alias("chunk"), p.alias("part"), s.alias("short"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    among = F.when(short, F.transform(upto("parts"), lambda p: place(chunk, p, F.lit(True)))).otherwise(F.array())
    plain = F.transform(upto("chunks"), lambda c: place(c, part, F.lit(False)))
    places = F.when((F.col("parts") == 1) & (F.col("chunks") == 1), F.array(place(F.lit(0), F.lit(0), short))).otherwise(F.concat(among, plain))
    return entries.select("node", *FIELDS, "component", F.explode(places).alias("at")).select("*", "at.*").drop("at")


def _united(dense: DataFrame) -> DataFrame:
    """(node, depth, was, FIELDS): these entries, nodes that share a set as one.

    A node goes by its set that lies in most of these nodes, of such by the one with the least hash. A set lies in one
    node for each branch of each tree, so no more are united. What was outside the largest of them counts for all.
    """
    hub = written(dense.groupBy("id", "mark").agg(F.count("*").alias("shared")).where("shared > 1"), "neardup-hubs")
    own = dense.select("node", "id", "mark").join(narrow_side(hub), ["id", "mark"])
    named = own.groupBy("node").agg(F.max(F.struct("shared", F.xxhash64(F.lit("hub"), "id", "mark").alias("hub"))).alias("h"))
    named = narrow_side(written(named.select("node", F.col("h.hub").alias("hub")), "neardup-united"))
    moved = dense.join(named, "node", "left").withColumn("node", F.coalesce("hub", "node"))
    per = moved.groupBy("node").agg(F.min("depth").alias("depth"), F.max("rest").alias("was"))
    one = moved.drop("depth", "rest").dropDuplicates(["node", "id", "mark"])
    return one.join(narrow_side(written(per, "neardup-was")), "node").select("node", "depth", "was", *FIELDS)


def _node_links(docs: DataFrame, entries: DataFrame, turn: int, repeats: bool) -> tuple[DataFrame, DataFrame]:
    """(a, b), links that join the components of these nodes as far as their short sets reach; (node, near), how many
    of a node's sets may be linked to a short set. ``repeats`` tells that rows of ``docs`` are repeated.
    """
    sorted_groups = lambda df: df.repartition(*GROUP).sortWithinPartitions(*GROUP)
    kept = sorted_groups(_placed(entries, turn)).mapInArrow(_promising, "node long, chunk int, part int, id long, mark long, component long, short boolean")
    kept = written(kept, "neardup-kept")
    kept = narrow_side(kept)
    sets = docs.select("doc_id", "text").join(kept.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets, "id long, mark long, set array<long>")
    sets = sets.dropDuplicates(["id", "mark"]) if repeats else sets
    full = sets.join(kept, ["id", "mark"]).select(*GROUP, "id", "component", "short", "set")
    links = written(sorted_groups(full).mapInArrow(_spanning, "a long, b long"), "neardup-links")
    return links, kept.where("not short").groupBy("node").agg(F.count("*").alias("near"))


def _join_trees(docs: DataFrame, reps: DataFrame, edges: DataFrame | None, first: int, end: int, repeats: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """``edges`` and the links that the trees from ``first`` to before ``end`` add, and (id, mark, node), the roots'
    nodes that have been compared exhaustively. On the way ids count as joined as far as one step over the edges tells.
    """
    nodes = F.slice("nodes", first * BRANCHES + 1, (end - first) * BRANCHES)
    entries = reps.select(F.explode(nodes).alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("was"), *FIELDS)
    seen, labels = None, None if edges is None else near_labels(edges)
    for turn in itertools.count():
        entries = _labelled(entries, labels)
        nodes = written(_mixed_nodes(entries, turn, first > 0), "neardup-nodes")
        finished, large = nodes.agg(F.count_if(F.col("mode") == "all"), F.count_if(F.col("mode") == "pivots")).first()
        if not finished + large:
            return edges, seen
        entries = written(_of_nodes(entries.drop("depth"), nodes), "neardup-entries")
        links, near = _node_links(docs, entries, turn, repeats)
        if links.count():
            edges = merged(edges, links)
            labels = near_labels(edges)
        done = entries.where("mode = 'all' and depth = 0").select("id", "mark", "node")
        seen = done if seen is None else seen.unionByName(done)
        if not large:
            return edges, seen
        large = nodes.where("mode = 'pivots'").join(narrow_side(written(near, "neardup-near")), "node", "left")
        dense = F.coalesce("near", F.lit(0)) + F.col("members") - F.col("rest") >= DENSE * F.col("members")
        large = narrow_side(written(large.select("node", dense.alias("dense")), "neardup-large"))
        more = entries.where("mode = 'pivots'").join(large, "node")
        again = _united(written(more.where("dense").select("node", "depth", "rest", *FIELDS), "neardup-dense"))
        below = more.where("not dense").select("node", (F.col("depth") + 1).alias("depth"), *FIELDS)
        below = reps.select("id", "mark", "mins").join(narrow_side(below), ["id", "mark"]).mapInArrow(_branch, f"node long, depth int, {ENTRY}")
        entries = written(again.unionByName(below.withColumn("was", F.lit(None).cast("long"))), "neardup-below")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Null and empty texts have no shingles and are linked with nothing. A row with a null doc_id is returned with a null
    component and kept false; it links nothing. Rows that share a doc_id are one document to the links. Equal sets are
    one class from the start, represented by their least doc_id, so exact copies cost one row each. A very long text is
    read in blocks; its set is held by the tasks that compare it. An empty table gives an empty result.

    The first tree runs by itself: what it joins need not be compared in the others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(docs.mapInArrow(_sketches, SKETCH), "neardup-sketches")
    key = ["set_a", "set_b", "n_shingles"]
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = written(filled.groupBy(*key).agg(F.min("doc_id").alias("rep")), "neardup-classes")
    reps = filled.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    reps = reps.select(F.col("doc_id").alias("id"), F.col("set_a").alias("mark"), F.col("n_shingles").alias("n"), "bits_a", "bits_b", "nodes", "mins")
    reps = written(reps.withColumn("seen", F.array().cast("array<long>")), "neardup-reps")
    once = reps.select("id", "mark").distinct().count()
    if repeats := once < reps.count():
        reps = written(reps.dropDuplicates(["id", "mark"]), "neardup-reps")
    edges, seen = _join_trees(docs, reps, None, 0, 1, repeats)
    if seen is not None:
        seen = seen.groupBy("id", "mark").agg(F.array_sort(F.collect_set("node")).alias("seen"))
        reps = written(reps.drop("seen").join(seen, ["id", "mark"], "left"), "neardup-reps")
        edges, _ = _join_trees(docs, reps, edges, 1, TREES, repeats)
    rows = sketches.join(classes, key, "left")
    component = F.coalesce("rep", "doc_id")
    if edges is not None:
        labels = components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
        rows = rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        component = F.coalesce("component", "rep", "doc_id")
    out = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document is the least of its component.

    Rows without doc_id link nothing and stay. Repeated rows of a kept document all stay.
    """
    gone = narrow_side(written(near_duplicates(docs).where("doc_id is not null and not kept").select(F.col("doc_id").alias("_doc")).distinct(), "neardup-gone"))
    return docs.join(gone, docs["doc_id"] == gone["_doc"], "left_anti")
