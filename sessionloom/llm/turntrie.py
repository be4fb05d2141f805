"""A trie of conversations that share their first turns, one row a node.

A turn is known by two hashes and its bytes, and a prefix by the exclusive or of its turns' hashes, each hashed with its
place, so the keys of all prefixes of a conversation are one running aggregate. Equal conversations become one class
before anything else, and from then on a class is a weighted row. The nodes are the grouped prefixes of the classes.

What lies below a node is added up in three ways. Where one class alone is left, its remaining turns are a chain, and the
sums are running ones over that class. A node with more than ``HEAVY`` classes is heavy; there are few such nodes. The
tries that hang below them, each at most so large, are the shards: numpy lays the nodes of a shard out in level order as a
LOUDS bitvector with arrays of labels, reads the parents off the bits, and adds the levels up from the last to the first.
The heavy nodes get the sums of the shards below them and are then added up as a trie of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.shared import narrow_side, written

#: Turns are taken over from the first conversation of each BLOCK ids; how many is crc32 of the id, modulo SHARE.
BLOCK, SHARE = 5, 9
#: Classes below a node from which it is heavy, and rows of shards that are laid out at once, at least.
HEAVY = 2_000
BATCH = 50_000
KEY = ("depth", "k1", "k2")


@dataclass
class Louds:
    """A forest in level order. The bits hold, for a root above all and each node, a 1 for each child and then a 0."""

    bits: np.ndarray
    levels: np.ndarray  # where each level begins, and the end

    @classmethod
    def build(cls, parents: np.ndarray, levels: np.ndarray) -> Louds:
        """From the parent of each node in level order (-1: a root); children of a node stand together, in its order."""
        children = np.bincount(parents + 1, minlength=len(parents) + 1)
        bits = np.ones(len(parents) + len(children), dtype=bool)
        bits[np.cumsum(children + 1) - 1] = False
        return cls(bits, levels)

    def children(self) -> np.ndarray:
        """The number of children of each node: the distance of the zeros."""
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def parents(self) -> np.ndarray:
        """The parent of each node: how many zeros stand before its 1, less the root above all."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def summed(self, own: np.ndarray) -> np.ndarray:
        """For each node the sum of ``own`` over its subtree: backwards over the levels, each added to its parents."""
        total, parents = own.copy(), self.parents()
        for k in range(len(self.levels) - 2, 0, -1):
            span = slice(self.levels[k], self.levels[k + 1])
            np.add.at(total, parents[span], total[span])
        return total


def laid_out(shard: np.ndarray, depth: np.ndarray, keys: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, Louds]:
    """The order that puts nodes into level order, and the bits.

    A node is of a shard (a number), has a depth and a key (two numbers, unique in its shard and depth) and the key of its
    parent. In each shard those of the least depth are roots, and the parents of all others are there.
    """
    n = len(shard)
    first = np.full(shard.max() + 1 if n else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, shard, depth)
    level = depth - first[shard]
    columns = [np.concatenate(pair) for pair in ((keys[:, 1], above[:, 1]), (keys[:, 0], above[:, 0]), (depth, depth - 1), (shard, shard))]
    by = np.lexsort(columns)
    fresh = np.zeros(2 * n, dtype=bool)
    for column in columns:
        fresh[1:] |= np.diff(column[by]) != 0
    number = np.empty(2 * n, np.int64)
    number[by] = np.cumsum(fresh)
    row = np.full(2 * n, -1)
    row[number[:n]] = np.arange(n)
    parent = row[number[n:]]
    order, place, starts = np.argsort(level, kind="stable"), np.empty(n, np.int64), [0]
    for k in range(int(level.max()) + 1 if n else 0):
        span = slice(starts[-1], int(np.searchsorted(level[order], k, "right")))
        at = order[span]
        up = place[parent[at]] if k else np.zeros(len(at), np.int64)
        order[span] = at = at[np.lexsort((keys[at, 1], keys[at, 0], shard[at], up))]
        place[at] = np.arange(span.start, span.stop)
        starts.append(span.stop)
    roots = level[order] == 0
    return order, Louds.build(np.where(roots, -1, place[parent[order]]), np.array(starts))


NODE = "root_depth long, r1 long, r2 long, depth long, k1 long, k2 long, p1 long, p2 long, conv_id {0}, n_convs long, kids long, leaves long, saved long, ends string"
SUMS = "depth long, p1 long, p2 long, conv_id {0}, parent_conv_id {0}, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, top boolean"


def _rolled(nodes: pa.Table) -> pa.RecordBatch:
    """The sums of whole shards, sorted by shard."""
    column = {c: nodes.column(c).to_numpy() for c in nodes.column_names if c not in ("conv_id", "ends")}
    shard = np.zeros(len(nodes), np.int64)
    for c in ("root_depth", "r1", "r2"):
        shard[1:] |= np.diff(column[c]) != 0
    order, trie = laid_out(np.cumsum(shard), column["depth"], np.column_stack([column["k1"], column["k2"]]), np.column_stack([column["p1"], column["p2"]]))
    labels, parents = nodes.column("conv_id").combine_chunks().take(pa.array(order)), trie.parents()
    top = parents < 0
    own = {c: column[c][order] for c in column}
    found = [
        *(pa.array(own[c]) for c in ("depth", "p1", "p2")),
        labels,
        labels.take(pa.array(parents, mask=top)),
        pa.array(own["n_convs"]),
        pa.array(own["kids"] + trie.children()),
        pa.array(trie.summed(own["leaves"])),
        pa.array(trie.summed(own["saved"])),
        nodes.column("ends").combine_chunks().take(pa.array(order)),
        pa.array(top),
    ]
    return pa.RecordBatch.from_arrays(found, [x.split()[0] for x in SUMS.split(", ")])


def rolled_up(nodes: DataFrame, batch_rows: int = BATCH) -> DataFrame:
    """Children, leaves and saved bytes of nodes (NODE), each shard a trie of its own; ``top`` marks its root.

    Shards are dealt by their root, sorted, and laid out many at once; a task keeps ``batch_rows`` rows and one shard.
    """

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= batch_rows:
                table = pa.Table.from_batches(kept)
                roots = np.column_stack([table.column(c).to_numpy() for c in ("root_depth", "r1", "r2")])
                whole = int(np.flatnonzero((roots != roots[-1]).any(axis=1)).max(initial=-1)) + 1  # the last shard may go on
                if whole:
                    yield _rolled(table.slice(0, whole))
                kept = table.slice(whole).to_batches()
        if sum(b.num_rows for b in kept):
            yield _rolled(pa.Table.from_batches(kept))

    kind = nodes.schema["conv_id"].dataType.simpleString()
    dealt = nodes.select(*(F.col(x.split()[0]).cast(x.split()[1]) for x in NODE.format(kind).split(", "))).repartition("root_depth", "r1", "r2")
    return dealt.sortWithinPartitions("root_depth", "r1", "r2", "depth").mapInArrow(roll, SUMS.format(kind))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), h1 and h2 (hashes of role and text) and bytes of every turn with a conv_id.

    Turns are in the order of ``turn``, null first; equal ones by role, then text, which only these carry to the sort.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    hashes = {"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role"), "bytes": F.octet_length("text").cast("long")}
    ties = written(turns.groupBy("conv_id", "turn").count().where("count > 1").select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn")), "turn-ties")
    by = [F.asc_nulls_first("turn")]
    if ties.head(1):
        tied = (F.col("conv_id") == F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
        turns = turns.join(narrow_side(ties), tied, "left").withColumns({"_role": F.expr("if(_conv is null, null, role)"), "_text": F.expr("if(_conv is null, null, text)")})
        by += [F.col("_role"), F.col("_text")]
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*by)).cast("long")
    return turns.withColumns(hashes).drop("role", "text").select("conv_id", place.alias("place"), *hashes)


def taken_over(conv_id: Column | str = "conv_id") -> Column:
    """How many turns a conversation takes over: the unsigned CRC-32 of its decimal id modulo SHARE."""
    return F.crc32(F.col(conv_id).cast("string")) % SHARE


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """conv_id, source, place and the other columns of the turns of each rebuilt conversation, and a row of source -1 for each."""
    rest = turns.columns[2:]
    convs = turns.where("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("first"), taken_over().alias("taken"))
    heads = turns.where((F.col("place") < SHARE) & (F.col("conv_id") % BLOCK == 0)).withColumnRenamed("conv_id", "first")
    given = convs.where("conv_id != first and taken > 0").join(heads, "first").where("place <= taken").select("conv_id", F.lit(0).alias("source"), "place", *rest)
    own = turns.where((F.col("conv_id") % BLOCK == 0) | (F.col("place") > taken_over())).select("conv_id", F.lit(1).alias("source"), "place", *rest)
    roots = convs.select("conv_id", F.lit(-1).alias("source"), F.lit(0).cast("long").alias("place"), *(F.lit(0).cast("long").alias(c) for c in rest))
    return roots.unionByName(given).unionByName(own)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, key (k1, k2) and the parent's (p1, p2), bytes of the last turn, and whether it is the whole."""
    w = Window.partitionBy("conv_id").orderBy("source", "place")
    rows = rows.select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("depth"), "h1", "h2", "bytes", F.lead("source").over(w).isNull().alias("last"))
    own = rows.withColumns({"t1": F.expr("if(depth = 0, 0L, xxhash64(depth, h1, h2))"), "t2": F.expr("if(depth = 0, 0L, xxhash64(h2, depth, h1))")})
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = own.withColumns({"k1": F.bit_xor("t1").over(so_far), "k2": F.bit_xor("t2").over(so_far)})
    return keyed.select("conv_id", *KEY, F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), "bytes", "last")


def ends_of(whole: DataFrame) -> DataFrame:
    """Of each key (depth, k1, k2): its least conv_id, how many it has, and the SHA-256 of these, ascending, comma-joined.

    The ids of a key are sorted into one task and streamed through it; nothing but the digest's state is kept.
    """
    kind = whole.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, least, n, sha = None, None, 0, None
        for batch in batches:
            done = []
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
                if key == at:
                    n += 1
                    sha.update(b",%d" % conv)
                    continue
                if at is not None:
                    done.append((*at, least, n, sha.hexdigest()))
                at, least, n, sha = key, conv, 1, hashlib.sha256(b"%d" % conv)
            yield _batch(done)
        if at is not None:
            yield _batch([(*at, least, n, sha.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.int32() if kind == "int" else pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [*KEY, "rep", "members", "ends"])

    dealt = whole.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return dealt.mapInArrow(digest, f"depth long, k1 long, k2 long, rep {kind}, members long, ends string")


def prefix_trie(conversations: DataFrame, heavy_classes: int = HEAVY, batch_rows: int = BATCH) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations; see the module and the columns of the last line.

    Null roles and texts are empty ones; rows without conv_id belong to no conversation; a remainder has the sign of its
    id, as in SQL; equal turns of a conversation are ordered by role and text; repeated rows are turns of their own; other
    columns go; an empty table gives an empty result. The turns of one conversation are sorted into one task and streamed.
    """
    found = written(prefixes(rebuilt_turns(written(numbered_turns(conversations), "turns"))), "prefixes")
    classes = written(ends_of(found.where("last")), "classes")
    weights = classes.select(F.col("rep").alias("conv_id"), "members", "ends")
    paths = written(found.join(weights, "conv_id").withColumn("ends", F.expr("if(last, ends, null)")), "paths")
    same = {c: F.min(c).alias(c) for c in ("p1", "p2", "bytes", "conv_id")}  # the first three are the same for a key
    nodes = paths.groupBy(*KEY).agg(*same.values(), F.sum("members").alias("n_convs"), F.count("*").alias("classes"), F.max("ends").alias("ends"))
    nodes = written(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    heavy = nodes.where(F.col("classes") > heavy_classes)
    keys = narrow_side(written(heavy.select(*KEY, F.col("conv_id").alias("_conv")), "heavy"))

    # one class alone: its nodes are a chain, of which the top is a leaf of the trie above
    upwards = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    chain = nodes.where("classes = 1").withColumns({"top": F.lead("depth").over(upwards).isNull(), "saved": F.sum("saved").over(upwards.rowsBetween(Window.unboundedPreceding, 0))})
    chain = written(chain.withColumns({"kids": F.expr("if(ends is null, 1L, 0L)"), "leaves": F.lit(1).cast("long")}), "chains")
    below = chain.where("not top").withColumns({"parent_conv_id": F.col("conv_id"), "n_children": F.col("kids"), "n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")})

    # the tries below the heavy nodes, each known by its root
    roots = paths.join(keys, [*KEY], "left_anti").groupBy("conv_id").agg(F.min(F.struct(*KEY)).alias("root"))
    root = [F.col("root.depth").alias("root_depth"), F.col("root.k1").alias("r1"), F.col("root.k2").alias("r2")]
    none = {"kids": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long")}
    shared = nodes.where((F.col("classes") > 1) & (F.col("classes") <= heavy_classes)).withColumns(none)
    light = shared.unionByName(chain.where("top").drop("top")).join(roots, "conv_id").select("*", *root)
    light = written(rolled_up(light, batch_rows), "light-sums")

    # the heavy nodes, with the sums of the tries below them
    under = light.where("top and depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    under = under.agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("_saved"))
    above = heavy.join(under, [*KEY], "left").fillna(0, ["kids", "leaves", "_saved"]).withColumn("saved", F.col("saved") + F.col("_saved"))
    above = rolled_up(above.withColumns({c: F.lit(0).cast("long") for c in ("root_depth", "r1", "r2")}), batch_rows)
    parent = keys.select((F.col("depth") + 1).alias("_depth"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "_conv")
    light = light.join(parent, (F.col("depth") == F.col("_depth")) & (F.col("p1") == F.col("_k1")) & (F.col("p2") == F.col("_k2")) & F.col("top"), "left")
    light = light.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv"))

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = [df.select(*columns, F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")) for df in (below, light, above)]
    return whole[0].unionByName(whole[1]).unionByName(whole[2])
