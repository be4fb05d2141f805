"""Dense, lexical and fused retrieval, and the re-scoring of what it finds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.sources.shared import written

RRF_K = 60
K1, B = 1.2, 0.75
#: Different vectors of a target that a block holds, about; a task compares two blocks.
BLOCK_VECTORS = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero where either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def metadata_equal(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns all equal the wanted values; a null is no match."""
    for name, value in wanted.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows with their ``rank`` from 1."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, **filters) -> DataFrame:
    """Exact nearest neighbours by cosine; filters come before scores. Ties go to the least id."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    scored = metadata_equal(vectors, **filters).withColumn("score", F.round(cosine(F.col("embedding"), vector), 6))
    return top(scored.select("id", "score"), k, F.desc("score"), "id")


def terms_of(text: Column) -> Column:
    """Lower-cased alphanumeric words of at most 40 bytes."""
    return F.filter(F.split(F.lower(text), r"[^0-9a-zà-öø-ÿ]+"), lambda w: (w != "") & (F.octet_length(w) <= 40))


def bm25_part() -> Column:
    """What a term adds to the score of a chunk, from tf, length, df, n and mean."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))


def bm25(postings: DataFrame, frequencies: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """The best chunks by BM25 over the postings (id, term, tf, length) of a query's terms.

    ``frequencies`` has the document frequency of each of these terms; ``totals`` is one row: the number of chunks and
    their mean length.
    """
    rows = postings.join(F.broadcast(frequencies), "term").crossJoin(F.broadcast(totals))  # as many rows as the query has terms; one row
    return top(rows.groupBy("id").agg(F.round(F.sum(bm25_part()), 6).alias("score")), k, F.desc("score"), "id")


def fuse(lexical: DataFrame, dense: DataFrame, k: int = RRF_K, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over both lists."""
    a, b = lexical.select("id", F.col("rank").alias("lexical_rank")), dense.select("id", F.col("rank").alias("dense_rank"))
    part = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = a.join(b, "id", "full").withColumn("score", F.round(part("lexical_rank") + part("dense_rank"), 9))
    return top(both, limit, F.desc("score"), "id")


def _near_blocks(least: float):
    """Of a pair of blocks (c, at, unit, i, j) the pairs of classes (x, y) whose product is not below ``least``, a little spared for single precision."""

    def near(group: pa.Table) -> pa.Table:
        vectors, at, c = group.column("unit").to_pylist(), group.column("at").to_numpy(), group.column("c").to_numpy()
        unit = np.zeros((len(vectors), max((len(v) for v in vectors if v), default=0)), dtype=np.float32)
        for k, v in enumerate(vectors):
            unit[k, : len(v or ())] = v or ()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        ours, theirs = np.flatnonzero(at == i), np.flatnonzero(at == j)
        xs, ys = [], []
        for lo in range(0, len(ours), 512):
            some = ours[lo : lo + 512]
            x, y = np.nonzero(~(unit[some] @ unit[theirs].T < least - 1e-4))  # what is not a number stays, as in SQL
            xs.append(c[some[x]])
            ys.append(c[theirs[y]])
        x, y = np.concatenate(xs or [c[:0]]), np.concatenate(ys or [c[:0]])
        once = x < y if i == j else np.ones(len(x), dtype=bool)
        return pa.table({"x": x[once], "y": y[once]})

    return near


def near_classes(vectors: DataFrame, target: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, c), the class of each vector, and (x, y, similarity), the classes that are linked; x = y links the rows of a class.

    A class is the equal vectors of a target, so copies are one row to all that follows. The classes of a target are
    compared all with all, as no exact bound parts vectors of many dimensions: in blocks of ``BLOCK_VECTORS``, a pair of
    blocks a task, by products of matrices, which leave few pairs to the exact similarity.
    """
    rows = written(vectors.where(F.col("id").isNotNull() & F.col(target).isNotNull()).select("id", F.col(target).alias("t"), F.col("embedding").alias("e")), "vectors")
    classes = written(rows.groupBy("t", "e").agg(F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id()), "classes")
    members = written(rows.join(classes, (rows["t"] == classes["t"]) & rows["e"].eqNullSafe(classes["e"])).select("id", "c"), "members")
    norm = F.sqrt(dot(F.col("e"), F.col("e")))
    unit = F.transform("e", lambda x: F.coalesce(F.when(norm == 0, 0.0).otherwise(x.cast("double") / norm), F.lit(0.0)).cast("float"))
    blocks = classes.groupBy("t").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("blocks"))
    placed = classes.select("t", "c", unit.alias("unit")).join(blocks, "t").withColumn("at", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("at", k).alias("i"), F.greatest("at", k).alias("j")))
    dealt = placed.select("t", "c", "at", "unit", F.explode(pair).alias("pair")).select("t", "c", "at", "unit", "pair.i", "pair.j")
    near = dealt.groupBy("t", "i", "j").applyInArrow(_near_blocks(least), "x long, y long")
    near = near.unionByName(classes.where("n > 1").select(F.col("c").alias("x"), F.col("c").alias("y")))
    x, y = classes.select(F.col("c").alias("x"), F.col("e").alias("ex")), classes.select(F.col("c").alias("y"), F.col("e").alias("ey"))
    links = near.join(x, "x").join(y, "y").select("x", "y", F.round(cosine(F.col("ex"), F.col("ey")), 6).alias("similarity")).where(F.col("similarity") >= least)
    return members, written(links, "links")


def pairs_within(vectors: DataFrame, target: str, least: float) -> DataFrame:
    """(a, b, similarity) of vectors of the same target that are at least so similar."""
    members, links = near_classes(vectors, target, least)
    both = links.join(members.select(F.col("c").alias("x"), F.col("id").alias("p")), "x").join(members.select(F.col("c").alias("y"), F.col("id").alias("q")), "y")
    both = both.where(F.when(F.col("x") == F.col("y"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q")))
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def quality_score(hits: DataFrame, query: str, terms: Sequence[str]) -> DataFrame:
    """Re-scores hits (score, frame_kind, text) from 0 to 100 by visibility, the exact query, terms and substance."""
    text = F.lower("text")
    frame = F.when(F.col("frame_kind") == "user_msg", 6).when(F.col("frame_kind") == "agent_reply", 5).when(F.col("frame_kind").isNull(), 1).otherwise(-20)
    found = sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))
    per_term = F.when(found > 0, F.least(found * 3, F.lit(12))).otherwise(-15)
    low = F.when(F.length("text") < 40, -8).otherwise(0)
    informative = F.when((F.col("frame_kind") == "agent_reply") & (F.length("text") >= 400), 8).otherwise(0)
    total = F.col("score") + frame + F.when(F.contains(text, F.lit(query)), 12).otherwise(0) + per_term + low + informative
    return hits.withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(100.0), total.cast("double"))))


def visible(hits: DataFrame) -> DataFrame:
    """Without tool calls, thoughts and system notes."""
    return hits.where(F.col("frame_kind").isNull() | F.col("frame_kind").isin("user_msg", "agent_reply"))


def fuzzy(chunks: DataFrame, terms: Sequence[str], limit: int) -> DataFrame:
    """Substring search: the share of terms found as a score of 100, newest first on ties, the best of each session."""
    text = F.lower("text")
    found = sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))
    hits = chunks.withColumn("matched", found).where("matched > 0").withColumn("score", F.round(F.col("matched") * 100.0 / len(terms)).cast("long"))
    best = hits.groupBy("session_id").agg(F.max_by(F.struct("chunk_id", "project", "day", "score"), F.struct("score", "day", "chunk_id")).alias("h")).select("session_id", "h.*")
    return best.orderBy(F.desc("score"), F.desc("day"), F.desc("chunk_id")).limit(limit)


def recall_and_ndcg(ranked: DataFrame, gold: DataFrame, at: int = 5, depth: int = 10) -> DataFrame:
    """Per query (query, id, rank) against gold (query, id): recall at ``at`` and nDCG at ``depth`` with discounts log2(rank + 1)."""
    hit = ranked.join(gold.withColumn("_gold", F.lit(1)), ["query", "id"], "left").withColumn("_gold", F.coalesce("_gold", F.lit(0)))
    per = hit.groupBy("query").agg(F.sum(F.when(F.col("rank") <= at, F.col("_gold")).otherwise(0)).alias("found"), F.sum(F.when(F.col("rank") <= depth, F.col("_gold") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    size = gold.groupBy("query").agg(F.count("*").alias("size"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("size"), F.lit(depth)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))
    return size.join(per, "query", "left").select("query", F.round(F.coalesce(F.col("found") / F.col("size"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"))
