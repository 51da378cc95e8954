"""Framing and spectra of sample blocks, and what is read off a spectrum's bins.

``power_spectrum`` transforms Arrow batches with numpy; ``bins`` and ``measures`` are plans of expressions and windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analysis import CLIP, LEAST_AMPLITUDE, MOST_DB, Plan


def frame_starts(samples: str, window: int, hop: int) -> Column:
    """A column of the first samples (from 0) of all full windows."""
    last = F.size(samples) - window
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(hop))).otherwise(F.array().cast("array<int>"))


def framed(blocks: DataFrame, window: int, hop: int) -> DataFrame:
    """take_id, frame_idx, samples of all full windows of a block."""
    at = blocks.select("take_id", "samples", F.posexplode(frame_starts("samples", window, hop)).alias("frame_idx", "at"))
    return at.select("take_id", "frame_idx", F.slice("samples", F.col("at") + 1, F.lit(window)).alias("samples"))


def power_spectrum(blocks: DataFrame) -> DataFrame:
    """take_id, bin, power of each block: the squared modulus of its real transform. Null and empty blocks have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]).tolist():  # blocks of one length are one matrix
                at = pa.array(np.flatnonzero(sizes == size))
                blocks_of = b.column(1).take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                power = np.abs(np.fft.rfft(blocks_of, axis=1)) ** 2
                take = b.column(0).take(at).take(pa.array(np.repeat(np.arange(len(power)), power.shape[1])))
                yield pa.RecordBatch.from_arrays([take, pa.array(np.tile(np.arange(power.shape[1]), len(power)), pa.int32()), pa.array(power.reshape(-1))], ["take_id", "bin", "power"])

    return blocks.select("take_id", "samples").mapInArrow(run, "take_id long, bin int, power double")


def bins(blocks: DataFrame, plan: Plan, window: int, remove_dc: bool = True) -> DataFrame:
    """take_id, bin, power, clipped of blocks (take_id, samples) of window samples, made by expressions: the discrete
    transform of the windowed samples, bin by bin. Null blocks and blocks of another length have none."""
    x = F.transform("samples", lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
    product = lambda a, b: F.zip_with(a, b, lambda p, q: p * q)
    own = blocks.where(F.size("samples") == window).select("take_id", x.alias("x"), F.exists(x, lambda v: F.abs(v) >= CLIP).alias("clipped"))
    mean = total(F.col("x")) / window if remove_dc else F.lit(0.0)
    centred = own.withColumn("mean", mean).withColumn("x", F.transform("x", lambda v: v - F.col("mean")))
    shaped = centred.select("take_id", "clipped", product(F.col("x"), numbers(plan.window)).alias("x"))
    turns = numbers(2 * np.pi * np.arange(plan.size) / plan.size)
    # a bin's angles are the turns of one circle, k places apart
    at = lambda k: F.transform("x", lambda v, i: F.struct(v.alias("v"), F.get(turns, ((k * i) % plan.size).cast("int")).alias("t")))
    power = F.transform(F.sequence(F.lit(0), F.lit(plan.size // 2)), lambda k: F.pow(total(F.transform(at(k), lambda e: e["v"] * F.cos(e["t"]))), F.lit(2.0)) + F.pow(total(F.transform(at(k), lambda e: e["v"] * F.sin(e["t"]))), F.lit(2.0)))
    return shaped.select("take_id", "clipped", F.posexplode(power).alias("bin", "power"))


def _ratio_db(a: Column, b: Column) -> Column:
    floor = F.lit(LEAST_AMPLITUDE**2)
    return F.greatest(F.lit(-MOST_DB), F.least(F.lit(MOST_DB), 10 * F.log10(F.greatest(a, floor) / F.greatest(b, floor))))


def _level_db(power: Column) -> Column:
    return 20 * F.log10(F.greatest(F.sqrt(power), F.lit(LEAST_AMPLITUDE)))


def measures(spectra: DataFrame, plan: Plan, rate: int, sub_octave_db: float = 6.0) -> DataFrame:
    """take_id, hz (null: none, or a peak at the band's edge), clarity, snr_db, peak_to_second_db, band_rms_db,
    broadband_rms_db, clipped of spectra (take_id, bin, power, clipped): one exchange, by take.

    The strongest bin of the band is refined by a parabola through its neighbours. A bin about an octave below that is nearly as strong
    takes its place. The second peak is the strongest bin away from the first and from its second and third
    harmonic. Of equally strong bins the lowest counts.
    """
    take = Window.partitionBy("take_id")
    order = take.orderBy("bin")
    b, p = F.col("bin"), F.col("power")
    band = (b >= plan.low) & (b <= plan.high)
    log = lambda c: F.log(F.greatest(c, F.lit(LEAST_AMPLITUDE**2)))
    left, right = F.coalesce(F.lag("power").over(order), p), F.coalesce(F.lead("power").over(order), p)
    bend = log(left) - 2 * log(p) + log(right)
    vertex = F.when(bend < 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (log(left) - log(right)) / bend))).otherwise(0.0)
    one = spectra.withColumns({"refined": b + vertex, "strong": F.struct(p.alias("power"), (-b).alias("place"))}).withColumn("strong", F.struct("strong.*", "refined"))
    top = lambda c: F.max(F.when(c, F.col("strong"))).over(take)
    whole = F.sum(F.when((b > 0) & (b < plan.size // 2), 2 * p).otherwise(p)).over(take)
    first = one.withColumns({"peak": top(band), "inside": F.sum(F.when(band, p)).over(take), "whole": whole, "median": F.median(F.when(band, p)).over(take)})
    middle = F.floor(F.col("peak.refined") / 2 + 0.5)
    near = (F.abs(b - middle) <= plan.lobe) & (b > plan.low) & (b < plan.high) & (p > 0)
    second = first.withColumn("half", top(near))
    edge = (F.col("peak.place") == -plan.low) | (F.col("peak.place") == -plan.high)
    lower = ~edge & F.col("half").isNotNull() & F.coalesce(_ratio_db(F.col("peak.power"), F.col("half.power")) <= sub_octave_db, F.lit(False))
    third = second.withColumns({"edge": edge, "best": F.when(lower, F.col("half")).otherwise(F.col("peak"))})
    away = F.abs(b + F.col("best.place"))
    apart = plan.lobe + 2
    masked = band & (away > apart)
    for harmonic in (2, 3):
        masked = masked & (F.abs(b - harmonic * F.col("best.refined")) > apart)
    sums = third.groupBy("take_id").agg(
        F.first("best").alias("best"), F.first("edge").alias("edge"), F.first("inside").alias("inside"), F.first("whole").alias("whole"), F.first("median").alias("median"), F.first("clipped").alias("clipped"),
        F.sum(F.when(band & (away <= plan.lobe), p)).alias("lobe"), F.coalesce(F.max(F.when(masked, p)), F.lit(0.0)).alias("second"),
    )
    heard = F.col("best.power") > 0
    scale = plan.size * plan.energy
    silent = lambda c: F.when(heard, c).otherwise(0.0)
    return sums.select(
        "take_id", F.when(heard & ~F.col("edge"), F.col("best.refined") * rate / plan.size).alias("hz"), silent(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide("lobe", "inside")))).alias("clarity"),
        silent(_ratio_db(F.col("best.power"), F.col("median"))).alias("snr_db"), silent(_ratio_db(F.col("best.power"), F.col("second"))).alias("peak_to_second_db"),
        _level_db(2 * F.col("inside") / scale).alias("band_rms_db"), _level_db(F.col("whole") / scale).alias("broadband_rms_db"), "clipped",
    )
