"""Operators over frames keyed by take and ordered by frame: predicates, windows, islands.

Every function keeps one partitioning, by take, so a chain of them needs one exchange.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


#: Rows of one task where a step holds its share in memory.
TASK_ROWS = 250_000


def task_shares(spark: SparkSession, total: int) -> int:
    """Parts of a shuffle of total rows that give a task TASK_ROWS, and no fewer than the session has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))


def take_order() -> WindowSpec:
    """Frames of a take in order."""
    return Window.partitionBy("take_id").orderBy("frame_idx")


def tonal(clarity: float = 0.5, snr: float = 12.0, second: float = 6.0) -> Column:
    good = (F.col("hz") > 0) & (F.col("clarity") >= clarity) & (F.col("snr_db") >= snr) & (F.col("peak_to_second_db") >= second)
    return F.coalesce(good, F.lit(False))


def with_gate(frames: DataFrame, floor_db: Column | float, onset: float = 12.0, sustain: float = 6.0, absolute: float = -70.0) -> DataFrame:
    """Adds voiced: on at floor + onset, held down to floor + sustain, off at once where candidate is false.

    The floor may differ from frame to frame; a null floor is below everything. With onset below sustain a
    frame's state depends on the one before at every step, so takes are scanned in order instead.
    """
    floor = F.coalesce(floor_db if isinstance(floor_db, Column) else F.lit(float(floor_db)), F.lit(float("-inf")))
    high, low = F.greatest(F.lit(absolute), floor + onset), F.greatest(F.lit(absolute), floor + sustain)
    level = F.col("band_rms_db")
    if onset >= sustain:
        turn = F.when(~F.col("candidate") | (level < low), False).when(level >= high, True)
        return frames.withColumn("voiced", F.coalesce(F.last(turn, ignorenulls=True).over(take_order()), F.lit(False)))

    def scan(take: pd.DataFrame) -> pd.DataFrame:
        take = take.sort_values("frame_idx")
        on, out = False, []
        for candidate, above, held in zip(take["candidate"], take["__high"], take["__low"]):
            on = bool(candidate and (held if on else above))
            out.append(on)
        return take.drop(columns=["__high", "__low"]).assign(voiced=out)

    marked = frames.withColumns({"__high": F.coalesce(level >= high, F.lit(False)), "__low": F.coalesce(level >= low, F.lit(False))})
    schema = StructType([*frames.schema.fields, StructField("voiced", BooleanType())])
    return marked.groupBy("take_id").applyInPandas(scan, schema)


def runs(frames: DataFrame, flag: str, least: int) -> DataFrame:
    """take_id, start_idx, end_idx, n of maximal stretches of frames with the flag, least frames at least."""
    kept = frames.where(flag).withColumn("island", F.col("frame_idx") - F.row_number().over(take_order()))
    spans = kept.groupBy("take_id", "island").agg(F.min("frame_idx").alias("start_idx"), F.max("frame_idx").alias("end_idx"), F.count(F.lit(1)).alias("n"))
    return spans.where(F.col("n") >= least).drop("island")


def sliding_median(x: str, by: list[str], order: str, half: int) -> Column:
    """The median over 2 half + 1 neighbours, fewer at the ends; nulls do not count."""
    near = F.sort_array(F.collect_list(x).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)))
    n = F.size(near)
    return F.when(n > 0, (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2)


def tail_median(x: str, by: list[str], order: str, most: int) -> Column:
    """The median of the last most values up to and with a row; nulls do not count."""
    last = F.sort_array(F.collect_list(x).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-(most - 1), 0)))
    n = F.size(last)
    return F.when(n > 0, (F.get(last, F.floor((n - 1) / 2).cast("int")) + F.get(last, F.floor(n / 2).cast("int"))) / 2)


def recently(flag: str, at: str, within: float) -> Column:
    """Whether the flag was true at a frame, or at one no longer than within before it."""
    last = F.last(F.when(F.col(flag), F.col(at)), ignorenulls=True).over(take_order().rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.col(at) - last <= within, F.lit(False))


def slope(x: str, period: float) -> Column:
    """Central difference a second, one-sided at a take's ends."""
    before, after = F.lag(x).over(take_order()), F.lead(x).over(take_order())
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * period)).when(after.isNotNull(), (after - F.col(x)) / period).when(before.isNotNull(), (F.col(x) - before) / period)


def centre(frames: DataFrame, x: str, width: int) -> DataFrame:
    """Adds centre: the midpoint of the least-spread window of width frames that holds the frame, earliest on ties."""
    ahead = take_order().rowsBetween(0, width - 1)
    low, high = F.min(x).over(ahead), F.max(x).over(ahead)
    full = F.count(F.lit(1)).over(ahead) == width
    marked = frames.withColumn("spread", F.when(full, F.struct((high - low).alias("spread"), F.col("frame_idx").alias("at"), ((high + low) / 2).alias("mid"))))
    back = take_order().rowsBetween(-(width - 1), 0)
    return marked.withColumn("centre", F.min("spread").over(back).getField("mid")).drop("spread")


def sessions(rows: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """Adds session: a number within the key that grows where more than gap lies between two rows."""
    own = Window.partitionBy(key).orderBy(time)
    new = F.when(F.col(time) - F.lag(time).over(own) > gap, 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(own)).drop("__new")


def rank_percentile(values: Column, p: float) -> Column:
    """Rounded nearest rank of collected values."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(p * (F.size(ordered) - 1) + 0.5).cast("int"))


def ewma(order: str, x: str, alpha: float = 0.25) -> Column:
    """Exponentially weighted mean in the given order; the first observation sets it."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"))))
    return F.aggregate(rows, F.lit(None).cast("double"), lambda a, r: F.coalesce(a + alpha * (r["x"] - a), r["x"]))


def spread(spans: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Adds bucket, one row for each stretch of width that a span [start, end) touches; empty spans touch none."""
    buckets = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    return spans.where(F.col(start) < F.col(end)).withColumn("bucket", F.explode(buckets))


def met(rows: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: float = 16.0, how: str = "inner") -> DataFrame:
    """Rows joined with the spans [start, end) of their key that hold their time: an equi-join on the key
    and the bucket of time, so that a long take is compared bucket by bucket and a hot one can be split."""
    own = spread(spans.withColumnsRenamed({key: "__key", start: "__start", end: "__end"}), "__start", "__end", width)
    inside = (F.col(key) == F.col("__key")) & (F.floor(F.col(at) / width) == F.col("bucket")) & (F.col(at) >= F.col("__start")) & (F.col(at) < F.col("__end"))
    return rows.join(own, inside, how)


def within(rows: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, how: str = "left_semi", width: float = 16.0) -> DataFrame:
    """Rows whose time lies in (left_semi) or outside (left_anti) every span [start, end) of their key."""
    return met(rows, spans.select(key, start, end), key, at, start, end, width, how)


def as_of(rows: DataFrame, changes: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Adds the value of the last change at or before each row, by one sorted union and no range join."""
    names = rows.columns
    both = rows.withColumns({"__side": F.lit(1), value: F.lit(None).cast(changes.schema[value].dataType)}).unionByName(changes.select(key, at, value).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    last = F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "__side"))
    return both.withColumn("__last", last).where("__side = 1").select(*names, F.col("__last").alias(value))
