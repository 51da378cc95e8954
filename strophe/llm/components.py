"""Connected components by alternating stars, in DataFrame operations only.

``large``: every node passes its least neighbour to its larger neighbours; ``small``: every node passes
its least neighbour to its smaller ones and to itself. Both keep the components and together shrink each
to a star around its least node. Least neighbours are found by an aggregation that combines before the
shuffle, and come back by an equi-join that the optimizer may split, so a node with very many
neighbours never lies in one task. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) and the least of each u's partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_least(both).withColumn("m", F.least("m", "u"))
    return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    near = _with_least(down)
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.select("u", F.col("m").alias("v")).union(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached) for every node on an edge (u, v).

    Nulls and loops are no edges. Ends when a round changes nothing, however many rounds that takes.
    """
    spark = edges.sparkSession
    now, path = materialize(small_star(edges.select("u", "v").where("u <> v")), "edges")
    mark = _mark(now)
    while mark[0]:
        after, after_path = materialize(small_star(large_star(now)), "edges")
        seen, mark = mark, _mark(after)
        discard(spark, path)
        now, path = after, after_path
        if mark == seen:
            break
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)


def _mark(edges: DataFrame) -> tuple:
    """A digest of a set of edges that does not depend on their order."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first()
    return row[0], row[1], row[2]
