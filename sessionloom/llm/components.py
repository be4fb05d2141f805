"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.shared import narrow_side, written


def _least(links: DataFrame) -> DataFrame:
    """Each u with its least neighbour, or itself. A grouped minimum, so a node with very many links is pre-aggregated."""
    return narrow_side(written(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "link-ends"))


def _rows(links: DataFrame, *rows: tuple[str, str]) -> DataFrame:
    """(u, v) of each of these pairs of columns of each row, without loops."""
    return links.select(F.explode(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in rows))).alias("l")).select("l.*").where("u != v")


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of these."""
    return written(_rows(edges.join(_least(edges), "u"), ("v", "m"), ("u", "m")).distinct(), "links")


def merged(edges: DataFrame | None, links: DataFrame) -> DataFrame:
    """``edges`` (u, v), u > v, and further links (a, b) after one step: they connect what they did before."""
    fresh = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return _small(fresh if edges is None else edges.unionByName(fresh))


def near_labels(edges: DataFrame) -> DataFrame:
    """(id, component): a smaller id that the edges connect an id with. Ids of one component may still have several."""
    return written(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), "labels")


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in the links (a, b) the least id that it can reach. Loops until all are stars.

    A large step sends the larger neighbours of each node to the least node of its neighbourhood; a small step sends a
    node and its smaller neighbours there.
    """
    links = links.where("a is not null and b is not null and a != b")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = _rows(edges, ("u", "v"), ("v", "u"))
        large = written(_rows(both.join(_least(both), "u").where("v > u"), ("v", "m")), "links")
        edges = _small(large)
        ends = F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("end"), F.lit(0).alias("centre")), F.struct(F.col("v").alias("id"), F.lit(0).alias("end"), F.lit(1).alias("centre")))
        per = edges.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.sum("e.end").alias("n"), F.max("e.centre").alias("centre"))
        if not per.agg(F.count_if((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("centre") > 0)))).first()[0]:
            break  # each has one neighbour, and none of these has a smaller one
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
