"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
    return tuple(row)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges(a, b)`` of longs.

    Each round links every node's larger neighbours, then its smaller ones, to its least
    neighbour; a round is a few aggregations and joins on the node, whose hubs the partial
    aggregation shrinks before the shuffle.  Every round ends in a written table, so a lost
    executor costs no lineage, and rounds grow with the logarithm of the longest chain.
    """
    now = materialize(_ordered(edges), "components")
    state = _digest(now)
    for _ in range(rounds):
        if not state[0]:
            break
        now = materialize(_small_star(_large_star(now)), "components")
        if state == (state := _digest(now)):
            break
    else:
        raise RuntimeError("components did not settle")
    both = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return both.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    either = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = either.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _ordered(either.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(joined.unionByName(least.select("a", F.col("m").alias("b"))))
