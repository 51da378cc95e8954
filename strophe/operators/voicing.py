"""The adaptive floor of a take and what is voiced above it, as window plans: one exchange by take.

``nearest_percentile`` is a percentile over the evidence near each frame, widened to a quota. Evidence rows are
numbered; of q of them in a row, those from the (s+1)th on are the nearest to frame i as soon as the places
of the sth and of the (s+q)th add up to less than 2i, ties going to the left. These sums grow with s, so the
widened stretch of every frame is one as-of lookup in them, and the percentiles of all stretches are one
ordered window of q rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Voicing
from . import frames as fr

# Fixed values of the reference.
LEAST_EVIDENCE, SEED_PERCENTILE = 8, 50.0
_FIRST = -(1 << 40)


def _ranked(values: Column, percent: float) -> Column:
    return fr.rank_percentile(values, percent / 100)


def nearest_percentile(frames: DataFrame, level: str, evidence: Column, half: int, quota: int, percent: float, name: str) -> DataFrame:
    """frames (take_id, frame_idx, level) with name: the percentile of the level over the evidence frames within half
    of each frame, or over the quota nearest ones where those are fewer, the left one first on ties.

    Null in takes of fewer than LEAST_EVIDENCE evidence frames; takes of fewer than quota use all they have.
    """
    take = Window.partitionBy("take_id")
    near = take.orderBy("frame_idx").rangeBetween(-half, half)
    marked = frames.withColumn("__level", F.when(evidence, F.col(level)))
    known = marked.withColumns({"__all": F.count("__level").over(take), "__near": F.count("__level").over(near), "__own": _ranked(F.collect_list("__level").over(near), percent)})
    # the order of evidence alone: frames without it are a part of their own
    some = Window.partitionBy("take_id", F.col("__level").isNotNull()).orderBy("frame_idx")
    stretch = _ranked(F.collect_list("__level").over(some.rowsBetween(0, quota - 1)), percent)
    last, before = F.lead("frame_idx", quota - 1).over(some), F.lag("frame_idx", 1).over(some)
    # the first stretch holds until the sum of the places before and at the end of a later one is passed
    since = F.when(F.col("__level").isNotNull(), F.when(before.isNull(), F.lit(_FIRST)).otherwise(before + last)).cast("long")
    both = known.withColumns({"__since": since, "__stretch": stretch})
    # a frame gives a row that asks and, if a stretch starts there, one that tells: a union would work out all before it twice
    asks = F.struct((2 * F.col("frame_idx").cast("long") - 1).alias("twice"), F.lit(1).alias("side"), F.lit(None).cast(frames.schema[level].dataType).alias("wide"))
    tells = F.struct(F.col("__since").alias("twice"), F.lit(0).alias("side"), F.col("__stretch").alias("wide"))
    rows = both.withColumn("__row", F.explode(F.when(F.col("__since").isNull(), F.array(asks)).otherwise(F.array(asks, tells)))).drop("__since", "__stretch")
    wide = F.last("__row.wide", ignorenulls=True).over(take.orderBy("__row.twice", "__row.side"))
    met = rows.withColumn("__wide", wide).where("__row.side = 1")
    value = F.when(F.col("__all") >= LEAST_EVIDENCE, F.when(F.col("__near") >= quota, F.col("__own")).otherwise(F.col("__wide")))
    return met.select(*frames.columns, value.alias(name))


def with_floor(frames: DataFrame, settings: Voicing = Voicing(), window: int = 281, tonal: str = "tonal", level: str = "band_rms_db") -> DataFrame:
    """Adds seed_db, background (quiet frames without a tone) and floor_db, from tonal; window is the floor's in frames."""
    half = max(1, window // 2)
    seeded = nearest_percentile(frames, level, ~F.col(tonal), half, window, SEED_PERCENTILE, "seed_db")
    quiet = ~F.col(tonal) & F.coalesce(F.col(level) <= F.col("seed_db") + settings.background_above_db, F.lit(False))
    return nearest_percentile(seeded.withColumn("background", quiet), level, F.col("background"), half, LEAST_EVIDENCE, settings.floor_percentile, "floor_db")


def voiced(frames: DataFrame, settings: Voicing = Voicing(), period: float = 512 / 48000) -> DataFrame:
    """Frames (take_id, frame_idx, t_sec, hz and the measures) with tonal, candidate, floor_db and voiced."""
    window = max(1, int(settings.floor_window_sec / period + 0.5))
    own = frames.withColumn("tonal", fr.tonal(settings.min_clarity, settings.min_snr_db, settings.min_second_db))
    floored = with_floor(own, settings, window).withColumn("candidate", F.col("tonal") & (F.col("t_sec") >= settings.warmup_sec))
    return fr.with_gate(floored, F.col("floor_db"), settings.onset_db, settings.sustain_db, settings.absolute_floor_db)
