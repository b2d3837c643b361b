"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldweave.llm.common import discard, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Tie the larger (or the smaller and equal) neighbours of every node to its least neighbour.

    The least neighbour comes from a combining aggregate and goes back by a join, so a node with
    very many neighbours is never one task's group.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = pairs.join(least, "a")
    if larger:
        out = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.where(F.col("b") < F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionAll(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): for every node of ``edges`` (a, b) the least id it is joined to.

    Rounds run until the edges no longer change; their number grows with the logarithm of the
    longest path. Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        old, edges = edges, stored(_star(_both_ways(_star(_both_ways(edges), True)), False), "edges")
        discard(old)
        after = mark(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
