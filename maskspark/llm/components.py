"""Connected components by alternating stars, for links between any 64-bit ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex moves to the smallest one around it."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours move to the smallest of these."""
    least = links.groupBy("a").agg(F.min("b").alias("root"))
    moved = links.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionAll(least.select("a", F.col("root").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of links (a, b): root is the smallest vertex that links lead to.

    Each round is two aggregations and two joins, and is cut by a table in the shared folder; the number of rounds grows
    with the logarithm of the longest chain. Nothing but a count and a checksum comes to the driver. Links of a vertex to
    itself, repeated links and either direction are allowed; rows with nulls are no links. No links: no rows.
    """
    spark = links.sparkSession
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = materialize(now, "links")
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        after, after_path = materialize(_small_star(_large_star(now)), "links")
        discard(spark, path)
        now, path = after, after_path
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("vertex"), F.col("b").alias("root"))).distinct()
