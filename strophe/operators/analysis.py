"""Samples to pitch frames: framing, spectrum and the measures of each frame, for whole batches of windows.

The kernels take a matrix of windows, one a row; Spark moves the blocks as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import Analysis

FRAMES = "take_id string, frame_idx int, t_sec double, hz double, clarity double, snr_db double, peak_to_second_db double, band_rms_db double, broadband_rms_db double, clipped boolean"

# Full scale for clipping, share of the rate that the band may reach, floors and clamp of levels.
CLIP, BAND_SHARE, LEAST_AMPLITUDE, MOST_DB = 0.98, 0.4, 1e-12, 120.0


@dataclass(frozen=True)
class Plan:
    """What depends on rate and settings only: sizes, window and bins of the band."""

    window: np.ndarray
    size: int
    low: int
    high: int
    lobe: int
    energy: float


@lru_cache(maxsize=16)
def plan(rate: int, settings: Analysis) -> Plan:
    if not isinstance(settings.window, int) or settings.window < 8:
        raise ValueError(f"the window is an integer of 8 or more, not {settings.window}")
    if not isinstance(settings.hop, int) or settings.hop < 1:
        raise ValueError(f"the hop is a positive integer, not {settings.hop}")
    if not settings.zero_pad >= 1:
        raise ValueError(f"zero_pad is 1 or more, not {settings.zero_pad}")
    size = 1 << int(np.ceil(np.log2(np.floor(settings.window * settings.zero_pad + 0.5))))
    top = min(settings.high_hz, BAND_SHARE * rate)
    per_bin = rate / size
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(settings.window) / settings.window)
    low = max(1, int(np.ceil(min(settings.low_hz, top) / per_bin)))
    high = min(size // 2 - 1, int(np.floor(top / per_bin)))
    lobe = max(1, int(np.floor(2 * size / settings.window + 0.5)))
    return Plan(hann, size, low, high, lobe, float(np.sum(hann**2)))


def _ratio_db(a, b) -> np.ndarray:
    floor = LEAST_AMPLITUDE**2
    return np.clip(10 * np.log10(np.maximum(a, floor) / np.maximum(b, floor)), -MOST_DB, MOST_DB)


def _level_db(power) -> np.ndarray:
    return 20 * np.log10(np.maximum(np.sqrt(power), LEAST_AMPLITUDE))


def vertex(power: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offset of the vertex of a parabola through the log power around bin at; 0 where it does not bend down."""
    rows = np.arange(len(at))
    left, mid, right = (np.log(np.maximum(power[rows, np.clip(at + d, 0, power.shape[1] - 1)], LEAST_AMPLITUDE**2)) for d in (-1, 0, 1))
    bend = left - 2 * mid + right
    with np.errstate(divide="ignore", invalid="ignore"):
        offset = 0.5 * (left - right) / bend
    return np.where(bend < 0, np.clip(offset, -0.5, 0.5), 0.0)


def measure(windows: np.ndarray, rate: int, settings: Analysis) -> dict[str, np.ndarray]:
    """hz (NaN for none) and the measures of every window. A window of the wrong length is an error."""
    p = plan(rate, settings)
    x = np.asarray(windows, dtype=np.float64)
    if x.ndim != 2 or x.shape[1] != settings.window:
        raise ValueError(f"windows have {settings.window} samples, not {x.shape[-1]}")
    clipped = (np.abs(x) >= CLIP).any(axis=1)
    mean = x.mean(axis=1, keepdims=True) if settings.remove_dc else 0.0
    power = np.abs(np.fft.rfft((x - mean) * p.window, p.size)) ** 2
    rows = np.arange(len(x))
    band = power[:, p.low : p.high + 1]
    inside = band.sum(axis=1)
    whole = 2 * power[:, 1:-1].sum(axis=1) + power[:, 0] + power[:, -1]
    scale = p.size * p.energy
    out = {"band_rms_db": _level_db(2 * inside / scale), "broadband_rms_db": _level_db(whole / scale), "clipped": clipped}
    silent = {"hz": np.full(len(x), np.nan), "clarity": np.zeros(len(x)), "snr_db": np.zeros(len(x)), "peak_to_second_db": np.zeros(len(x))}
    if p.high - p.low < 2 or not len(x):
        return out | silent

    peak = p.low + band.argmax(axis=1)
    best = power[rows, peak]
    edge = (peak == p.low) | (peak == p.high)
    refined = peak + vertex(power, peak)

    # a peak an octave below that is nearly as strong is the fundamental
    bins = np.arange(power.shape[1])
    middle = np.floor(refined / 2 + 0.5)[:, None]
    near = (np.abs(bins - middle) <= p.lobe) & (bins > p.low) & (bins < p.high)
    lower = np.where(near, power, 0.0)
    half = lower.argmax(axis=1)
    half_power = lower[rows, half]
    take = ~edge & (half_power > 0) & (_ratio_db(best, half_power) <= settings.sub_octave_db)
    peak, best = np.where(take, half, peak), np.where(take, half_power, best)
    refined = np.where(take, half + vertex(power, half), refined)

    in_band = (bins >= p.low) & (bins <= p.high)
    away = np.abs(bins - peak[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        clarity = np.clip(np.where((away <= p.lobe) & in_band, power, 0.0).sum(axis=1) / inside, 0, 1)
    apart = p.lobe + 2
    masked = in_band & (away > apart)
    for harmonic in (2, 3):
        masked = masked & (np.abs(bins - harmonic * refined[:, None]) > apart)
    second = np.where(masked, power, 0.0).max(axis=1)
    heard = best > 0
    found = {
        "hz": np.where(edge, np.nan, refined * rate / p.size),
        "clarity": clarity,
        "snr_db": _ratio_db(best, np.median(band, axis=1)),
        "peak_to_second_db": _ratio_db(best, second),
    }
    return out | {k: np.where(heard, v, silent[k]) for k, v in found.items()}


def windows_of(samples: np.ndarray, settings: Analysis) -> np.ndarray:
    """All full windows of the samples, a hop apart; none where there are too few samples."""
    if len(samples) < settings.window:
        return np.empty((0, settings.window))
    return np.lib.stride_tricks.sliding_window_view(samples, settings.window)[:: settings.hop]


def frames_of(samples: np.ndarray, rate: int, settings: Analysis, first: int = 0, batch: int = 256) -> pd.DataFrame:
    """Frames of samples whose first window is frame number first; t_sec is the middle of the window."""
    own = windows_of(np.asarray(samples, dtype=np.float64), settings)
    parts = [measure(own[i : i + batch], rate, settings) for i in range(0, len(own), batch)] or [measure(own, rate, settings)]
    idx = np.arange(first, first + len(own))
    table = pd.DataFrame({k: np.concatenate([q[k] for q in parts]) for k in parts[0]})
    table.insert(0, "frame_idx", idx.astype("int32"))
    table.insert(1, "t_sec", (idx * settings.hop + settings.window / 2) / rate)
    return table


#: Fixed value: the longest take in seconds.
MOST_SEC = 60.0


class Tracker:
    """Frames of a stream of blocks; the same frames whatever the blocks' sizes. Carries less than a window."""

    def __init__(self, rate: int, settings: Analysis = Analysis(), tail: np.ndarray | None = None, first: int = 0, skip: int = 0):
        plan(rate, settings)
        self.rate, self.settings = rate, settings
        self.tail = np.empty(0) if tail is None else np.asarray(tail, dtype=np.float64)
        self.first, self.skip = first, skip

    def push(self, block: np.ndarray) -> pd.DataFrame:
        have = np.concatenate([self.tail, np.asarray(block, dtype=np.float64)])
        dropped = min(self.skip, len(have))  # hops longer than a window leave samples between windows
        have, self.skip = have[dropped:], self.skip - dropped
        out = frames_of(have, self.rate, self.settings, self.first)
        used = len(out) * self.settings.hop
        self.first += len(out)
        self.skip += max(0, used - len(have))
        self.tail = have[used:]
        return out


def analyse(audio: DataFrame, settings: Analysis = Analysis()) -> DataFrame:
    """Frames of blocks (take_id, sample_rate, start_sample, samples): blocks of a take are joined in order.

    One exchange by take. A take ends at MOST_SEC (11.5 MB), whatever its rows say, so it fits a task; rows
    of a take must share one rate. Null samples and missing blocks read as silence; rows without a start, or
    with one outside the take, are not read; hz is null where there is no peak.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows, take = rows.sort_values("start_sample", kind="stable"), rows["take_id"].iloc[0]
        rate = int(rows["sample_rate"].iloc[0])
        most = int(MOST_SEC * rate)
        rows = rows[rows["start_sample"].between(0, most - 1)]
        ends = rows["start_sample"] + rows["samples"].map(lambda s: 0 if s is None else len(s))
        samples = np.zeros(min(most, int(ends.max())) if len(rows) else 0)
        for start, block in zip(rows["start_sample"].astype(int), rows["samples"], strict=True):
            if block is not None:
                own = np.nan_to_num(np.asarray(block, dtype=np.float64))[: most - start]
                samples[start : start + len(own)] = own
        out = frames_of(samples, rate, settings)
        out.insert(0, "take_id", take)
        return out

    return audio.select("take_id", "sample_rate", "start_sample", "samples").groupBy("take_id").applyInPandas(one, FRAMES)


def analyse_windows(blocks: DataFrame, settings: Analysis = Analysis()) -> DataFrame:
    """Frames of rows that each hold one full window (take_id, frame_idx, sample_rate, samples): no exchange."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for rate, own in rows.groupby("sample_rate", sort=False):
                found = pd.DataFrame(measure(np.stack(own["samples"].to_numpy()), int(rate), settings))
                found.insert(0, "take_id", own["take_id"].to_numpy())
                found.insert(1, "frame_idx", own["frame_idx"].to_numpy())
                found.insert(2, "t_sec", (found["frame_idx"] * settings.hop + settings.window / 2) / rate)
                yield found[[c.split()[0] for c in FRAMES.split(", ")]]

    return blocks.select("take_id", "frame_idx", "sample_rate", "samples").mapInPandas(run, FRAMES)
