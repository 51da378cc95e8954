"""Places of rows in a total order, and running totals along it, without a key's rows lying in one task.

``in_order`` sorts by ranges of the whole order, so a key with very many rows is cut over many partitions;
``places`` then numbers each key's rows with the counts of (key, partition) alone. ``running`` sums in two
steps, within blocks of ``BLOCK`` places and over the totals of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of one key that one task sums at most.
BLOCK = 4096
#: monotonically_increasing_id holds the partition above this many bits.
_PART_BITS = 33


def in_order(rows: DataFrame, by: Sequence[str], tag: str) -> DataFrame:
    """rows, written in ascending order of by (nulls first), with ``at``, which grows along that order.

    Equal rows are dealt over partitions by where they were read, so very many of them don't stay together.
    """
    order = [*by, "__read"]
    dealt = rows.withColumn("__read", F.spark_partition_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.drop("__read").withColumn("at", F.monotonically_increasing_id()), tag)[0]


def part_of(at: str = "at") -> Column:
    return F.shiftright(F.col(at), _PART_BITS)


def spans(ordered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, part, first (least at), before (rows of the key in earlier parts), total (rows of the key)."""
    counted = ordered.groupBy(*keys, part_of().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # a key has as many rows here as partitions hold it
    own = Window.partitionBy(*keys)
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*keys, "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(own).alias("total"))


def places(ordered: DataFrame, keys: Sequence[str], spanned: DataFrame | None = None) -> DataFrame:
    """ordered with the columns of spans but part, and idx: the row's place among its key's rows, from 0.

    keys may not be null. The join is by key and partition, so no key of it has more rows than a partition.
    """
    met = ordered.withColumn("part", part_of()).join(spans(ordered, keys) if spanned is None else spanned, [*keys, "part"])
    return met.withColumn("idx", F.col("before") + F.col("at") - F.col("first")).drop("part", "first", "before")


def running(rows: DataFrame, keys: Sequence[str], place: str, totals: dict[str, Callable[[Column | str], Column]]) -> DataFrame:
    """rows with each column of totals replaced by its running aggregate (sum, bit_xor) up to and with the row.

    place numbers a key's rows from 0 or 1, without large gaps.
    """
    blocked = rows.withColumn("__block", F.floor(F.col(place) / BLOCK).cast("long"))
    sums = blocked.groupBy(*keys, "__block").agg(*[f(c).alias(f"__{c}") for c, f in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, "__block", *[F.coalesce(f(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c, f in totals.items()])
    within = Window.partitionBy(*keys, "__block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({c: f(c).over(within) for c, f in totals.items()})
    met = local.join(bases, [*keys, "__block"])
    both = {c: F.col(c).bitwiseXOR(F.col(f"__{c}")) if f is F.bit_xor else F.col(c) + F.col(f"__{c}") for c, f in totals.items()}
    return met.withColumns(both).drop("__block", *[f"__{c}" for c in totals])
