"""Mixing sources to target weights: repetition rates per source, then floor(rate) copies and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.shared import narrow_side, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights that the sources get in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2.0
#: The columns that a plan adds.
PLANNED = ("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")


def word_count(text: Column) -> Column:
    """Number of white-space separated words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(docs: DataFrame) -> DataFrame:
    """One row per source (null is a source): its size, and its index in code-point order with null last.

    The index comes from a range-partitioned sort and the row counts of its partitions, so no task sees all sources.
    """
    sums = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    ordered = written(sums.orderBy(F.col("source").asc_nulls_last()).select("*", F.monotonically_increasing_id().alias("_id")), "mix-sources")
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["part"]: r["n"] for r in ordered.groupBy(part.alias("part")).count().withColumnRenamed("count", "n").collect()}
    before, starts = 0, []
    for p in sorted(counts):
        starts += [F.lit(p), F.lit(before)]
        before += counts[p]
    start = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return ordered.select("source", "source_size", (start + at).cast("long").alias("source_index"))


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Adds ``weight``, ``target`` and ``rate``.

    All sources together get ``total_share`` times all words, by weight; a target stops at ``max_repeat`` times its
    source's size and the excess goes to the others by weight until none is above. The level (target per weight) only
    rises, so each round is one small aggregate and the driver sees two numbers of it.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_index") % len(weights) + 1).cast("int"))
    sources = written(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))), "mix-targets")
    total = total_share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        capped, free = sources.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        risen = (total - capped) / free if free else level
        if not risen > level * (1 + 1e-12):
            break
        level = risen
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return sources.select("source", "source_size", "source_index", "weight", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, key: Column, seed: int) -> Column:
    """floor(rate) plus one more where the key's MD5, read as a number in [0, 1), is under the fraction."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: float = MAX_REPEAT, seed: int = 17) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``, ``source`` and any others) with its size and its number of copies.

    A null or empty text has size 0. A null source is a source. Rows with equal doc_id get equal draws; rows without
    doc_id draw by their text. An empty table gives an empty result. Adds ``mix_size``, ``mix_source_size``,
    ``mix_target``, ``mix_rate`` and ``mix_copies``; input columns of these names are replaced. A very long text is
    counted whole; if it is most of its source, the source's taken words can miss the target by as much.
    """
    targets = source_targets(source_sizes(docs), weights, total_share, max_repeat)
    targets = narrow_side(written(targets.select(F.col("source").alias("_source"), "source_size", "target", "rate"), "mix-rates"))
    joined = docs.join(targets, docs["source"].eqNullSafe(targets["_source"]), "left")
    key = F.coalesce(docs["doc_id"].cast("string"), docs["text"], F.lit(""))
    added = (word_count(docs["text"]), targets["source_size"], targets["target"], targets["rate"], copies(targets["rate"], key, seed))
    return joined.select(*(docs[c] for c in docs.columns if c not in PLANNED), *(v.alias(k) for k, v in zip(PLANNED, added, strict=True)))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as its plan says, with ``mix_copy`` 1, 2, ...

    Columns of the plan's names and of that name are replaced or left out; all others stay. See ``mix_plan`` for odd rows.
    """
    plan = mix_plan(docs, **options).where("mix_copies > 0")
    kept = [c for c in docs.columns if c not in (*PLANNED, "mix_copy")]
    return plan.select(*kept, F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("mix_copy"))
