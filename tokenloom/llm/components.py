"""Connected components of a table of links, without a driver in the middle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage


def _mark(edges: DataFrame) -> tuple:
    """Changes when the set of links does."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).head()
    return tuple(row)


def _nearest(pairs: DataFrame) -> DataFrame:
    """Per ``u`` the least of itself and its ``v``; combined before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m")
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``(u, v)`` that are not the least of their component.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its least
    neighbour, then its smaller ones.  The links end as stars around the least nodes.  A node with
    very many links costs one combined minimum and a join that adaptive execution splits.
    """
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stage(ordered.filter("u <> v").distinct(), "links")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = both.join(_nearest(both), "u").filter("v > u")
        edges = stage(
            larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large_star"
        )
        nearest = _nearest(edges)
        moved = edges.join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = nearest.select("u", F.col("m").alias("v"))
        edges = stage(moved.unionByName(kept).filter("u <> v").distinct(), "small_star")
        last, mark = mark, _mark(edges)
        if mark == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
