"""Frames to notes: floor, gate, smoothing, movement, drafts, merges and tuning as one chain of plans over all takes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.pitch import half_up, note_name
from . import frames as fr
from .drafts import drafts
from .merging import dropouts, join_to_fixpoint, kept, measure, resolve_short, wobbles
from .movement import in_runs, with_movement
from .voicing import voiced

_KEPT = ["take_id", "frame_idx", "t_sec", "clarity", "snr_db", "band_rms_db", "clipped", "floor_db", "voiced"]


def prepared(frames: DataFrame, rate: int, config: Config = Config()) -> DataFrame:
    """All frames with floor_db and voiced and, in voiced runs, run, place, smooth, centre and what moves."""
    period = config.analysis.hop / rate
    midi = F.when(F.col("hz") > 0, 69 + 12 * F.log2(F.col("hz") / config.tuning.a4_hz))
    own = kept(voiced(frames, config.voicing, period).withColumn("midi", midi), "voiced")
    runs = in_runs(own, config.smoothing.min_run)
    smooth = fr.sliding_median("midi", ["take_id", "run"], "place", config.smoothing.median_filter // 2)
    runs = kept(runs.select("take_id", "frame_idx", "run", "place", smooth.alias("smooth")), "runs")
    moved = with_movement(runs, "smooth", period, config.segment)
    return kept(own.select(*_KEPT).join(moved, ["take_id", "frame_idx"], "left").fillna(False, ["transitional", "oscillating", "stepped"]), "prepared")


def tuning(notes: DataFrame, config: Config, period: float) -> DataFrame:
    """take_id, tuning_offset_cents: the weighted circular mean of the cents beside the nearest note; 0 for few or scattered ones."""
    t = config.tuning
    weight = (F.col("end_idx") - F.col("start_idx") + 1) * F.lit(period)
    angle = 2 * F.pi() * (F.col("pitch") - half_up(F.col("pitch")))
    sums = notes.groupBy("take_id").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"), F.sum(weight * F.cos(angle)).alias("c"), F.sum(weight * F.sin(angle)).alias("s"))
    cents = F.atan2("s", "c") / (2 * F.pi()) * 100
    folded = F.when(cents >= 50, cents - 100).otherwise(cents)
    held = F.greatest(F.lit(-t.max_offset_cents), F.least(F.lit(t.max_offset_cents), folded))
    sure = F.lit(t.automatic) & (F.col("n") >= t.min_notes) & (F.col("w") > 0) & (F.hypot("c", "s") / F.col("w") >= t.min_concentration)
    return sums.select("take_id", F.when(sure, held).otherwise(0.0).alias("tuning_offset_cents"))


def transcribe(frames: DataFrame, rate: int, config: Config = Config()) -> DataFrame:
    """The notes of every take's frames (take_id, frame_idx, t_sec, hz, the measures, clipped); a take without notes gives no row."""
    return heard(prepared(frames, rate, config), rate, config)


def heard(ready: DataFrame, rate: int, config: Config) -> DataFrame:
    """The notes of prepared frames."""
    period = config.analysis.hop / rate
    runs = ready.where("run is not null")
    spans = kept(measure(drafts(runs, "smooth", config.segment), ready, config), "measured")
    spans = join_to_fixpoint(spans, ready, config, period, wobbles)
    spans = join_to_fixpoint(spans, ready, config, period, dropouts)
    spans = resolve_short(spans, ready, config, period)
    spans = kept(join_to_fixpoint(spans, ready, config, period, dropouts), "notes")
    tuned = spans.join(tuning(spans, config, period), "take_id")
    order = Window.partitionBy("take_id").orderBy("start_idx")
    pitch = F.col("pitch") - F.col("tuning_offset_cents") / 100
    start, end = F.greatest(F.lit(0.0), F.col("low_sec") - F.lit(period / 2)), F.col("high_sec") + F.lit(period / 2)
    out = tuned.withColumns({"note_idx": F.row_number().over(order) - 1, "midi": half_up(pitch).cast("int"), "start_sec": start, "end_sec": end})
    return out.select(
        "take_id", "note_idx", "midi", note_name(F.col("midi")).alias("note_name"), ((pitch - F.col("midi")) * 100).alias("cents_offset"), "start_sec", "end_sec", (F.col("end_sec") - F.col("start_sec")).alias("duration_sec"),
        (config.tuning.a4_hz * F.pow(F.lit(2.0), (F.col("pitch") - 69) / 12)).alias("pitch_hz"), "confidence", F.greatest(F.lit(0.0), F.col("start_sec") - F.coalesce(F.lag("end_sec").over(order), F.lit(0.0))).alias("gap_before_sec"),
        F.col("glided").alias("glided_in"), (F.col("reach") > config.segment.tolerance_cents / 100).alias("drifted"), "clipped", "tuning_offset_cents",
    )


def _before_drafts(config: Config) -> Config:
    """config without what only drafts and later steps read: those that are equal so far share their prepared frames."""
    return replace(config, segment=replace(config.segment, tolerance_cents=0.0, drift_cap=0.0))


def sweep(frames: DataFrame, rate: int, configs: dict[str, Config]) -> DataFrame:
    """Notes of every take under every configuration, with config_id; frames are prepared once for configurations that differ
    in tolerance and drift only, and from the drafts on each configuration is a chain of its own."""
    if not configs:
        raise ValueError("no configurations to sweep")
    ready: list[tuple[Config, DataFrame]] = []
    for c in map(_before_drafts, configs.values()):
        if c not in [known for known, _ in ready]:
            ready.append((c, prepared(frames, rate, c)))
    own = lambda c: next(df for known, df in ready if known == _before_drafts(c))
    parts = [heard(own(c), rate, c).select(F.lit(name).alias("config_id"), "*") for name, c in configs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
