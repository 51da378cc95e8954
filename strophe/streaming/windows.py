"""Event-time windows over frames: figures of each stretch of time, runs that end after a gap.

The same plans serve tables and streams. On a stream the watermark tells how late a row may be: a window
gives its row once the watermark has passed its end, its state goes then, and rows that come later still
are left out. On a table late is ignored and nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import rank_percentile, tonal

MEASURES = ("clarity", "snr_db", "band_rms_db")


def event_time(ntz: str = "ts") -> Column:
    """A timestamp without a zone as one that is counted from 1970 in UTC, whatever the session's zone."""
    return F.concat(F.col(ntz).cast("string"), F.lit("Z")).cast("timestamp")


def _watermarked(rows: DataFrame, at: str, late: str | None) -> DataFrame:
    return rows.withWatermark(at, late) if late and rows.isStreaming else rows


def _micros(at: Column) -> Column:
    return F.unix_micros(at)


def window_statistics(frames: DataFrame, width: str = "1 second", at: str = "at", late: str | None = None) -> DataFrame:
    """take_id, start_us, n_frames, n_tonal, the medians of the tonal pitch and of each measure, for every window that holds a frame.

    Medians are rounded nearest ranks. A window collects its own frames only: what one take has in width.
    """
    sure = (F.col("hz").isNotNull() & (F.col("clarity") >= 0.5) & (F.col("snr_db") >= 12)).alias("sure")
    rows = _watermarked(frames, at, late)
    grouped = rows.groupBy("take_id", F.window(at, width).alias("w"))
    medians = [rank_percentile(F.collect_list(c), 0.5).alias(f"median_{c}") for c in MEASURES]
    pitch = rank_percentile(F.collect_list(F.when(sure, F.col("hz"))), 0.5).alias("median_hz")
    out = grouped.agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(sure).alias("n_tonal"), pitch, *medians)
    return out.select("take_id", _micros(F.col("w.start")).alias("start_us"), "n_frames", "n_tonal", "median_hz", *[f"median_{c}" for c in MEASURES])


def session_runs(frames: DataFrame, gap: str = "16 milliseconds", least: int = 3, at: str = "at", late: str | None = None) -> DataFrame:
    """take_id, first_us, last_us, n of the runs of tonal frames, of least frames at least, that no more than gap parts.

    With frames at an even pace and a gap of one and a half of it, a frame that is not tonal parts them as well.
    """
    kept = _watermarked(frames, at, late).where(tonal())
    spans = kept.groupBy("take_id", F.session_window(at, gap).alias("w")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    return spans.where(F.col("n") >= least).select("take_id", _micros(F.col("first")).alias("first_us"), _micros(F.col("last")).alias("last_us"), "n")
