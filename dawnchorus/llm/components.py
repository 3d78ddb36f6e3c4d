"""Connected components of a large graph by alternating star contraction.

Every round joins and groups the edge table and writes it to the shared folder;
no component, link list or label set ever comes to the driver.  A vertex with very
many links is split by the adaptive skew join; its smallest neighbour is found by
partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.common import drop_table, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its larger neighbours on to the smallest vertex it knows."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .filter("hi <> lo").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs -> (id, component): the smallest id reachable.

    Only ids that have a link to another id appear and are not their component's
    smallest.  Null ends, loops and repeated edges are left out; an empty table
    gives an empty result.
    """
    current = materialize(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    before = None
    while True:
        state = current.agg(F.count(F.lit(1)).alias("n"),
                            F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("mark")).first()
        if state["n"] == 0 or state == before:
            return current.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
        before, last = state, current
        current = materialize(_small_star(_large_star(last)), "edges")
        drop_table(last)
