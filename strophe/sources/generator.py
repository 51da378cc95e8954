"""Signals with known notes: the ground truth of tests, and noise from a seeded generator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

AUDIO = "take_id string, sample_rate int, block_no long, start_sample long, samples array<float>"


def uniforms(seed: int) -> Iterator[float]:
    """The mulberry32 generator: uniform numbers in [0, 1)."""
    mask = 0xFFFFFFFF
    state = seed & mask
    while True:
        state = (state + 0x6D2B79F5) & mask
        x = ((state ^ (state >> 15)) * (state | 1)) & mask
        x ^= (x + (((x ^ (x >> 7)) * (x | 61)) & mask)) & mask
        yield (x ^ (x >> 14)) / 4294967296


@dataclass(frozen=True)
class Tone:
    """One note: its pitch and length, and how it departs from a steady tone."""

    midi: float
    seconds: float
    gap: float = 0.0
    hz: float | None = None
    detune: float = 0.0
    vibrato: float = 0.0
    vibrato_hz: float = 5.0
    glide_in: float = 0.0
    glide_ms: float = 0.0
    drift: float = 0.0
    amplitude: float = 0.5


def _places(seconds: float, rate: int) -> int:
    return int(np.floor(seconds * rate + 0.5))


def tone(note: Tone, rate: int, a4: float = 440.0, edge_ms: float = 10.0) -> np.ndarray:
    """Samples of a note. Its phase is the integral of its frequency, so bends make no clicks."""
    n = _places(note.seconds, rate)
    if n <= 0:
        return np.zeros(0)
    i = np.arange(n)
    cents = note.detune + note.vibrato * np.sin(2 * np.pi * note.vibrato_hz * i / rate) + note.drift * i / max(1, n - 1)
    glide = _places(note.glide_ms / 1000, rate)
    if glide:
        cents = cents + note.glide_in * np.clip(1 - i / glide, 0, None)
    base = note.hz if note.hz is not None else a4 * 2 ** ((note.midi - 69) / 12)
    step = 2 * np.pi * base * 2 ** (cents / 1200) / rate
    edge = min(_places(edge_ms / 1000, rate), n // 2)
    gain = np.ones(n)
    if edge:
        ramp = 0.5 - 0.5 * np.cos(np.pi * np.arange(edge) / edge)
        gain[:edge], gain[n - edge :] = ramp, ramp[::-1]
    return note.amplitude * gain * np.sin(np.cumsum(step) - step)


def melody(notes: list[Tone], rate: int = 48000, lead: float = 0.0, tail: float = 0.0, a4: float = 440.0) -> tuple[np.ndarray, list[tuple[float, float, float]]]:
    """Samples of notes one after the other, and (midi, start, end) of each."""
    parts, truth = [np.zeros(_places(lead, rate))], []
    at = len(parts[0])
    for note in notes:
        own = tone(note, rate, a4)
        truth.append((note.midi, at / rate, (at + len(own)) / rate))
        parts += [own, np.zeros(_places(note.gap, rate))]
        at += len(own) + len(parts[-1])
    return np.concatenate([*parts, np.zeros(_places(tail, rate))]), truth


def noise(n: int, seed: int, rms_db: float, pink: bool = False) -> np.ndarray:
    """White or pink noise at a level; normal numbers by Box and Muller, pink by Kellet's filter."""
    draw = uniforms(seed)
    flat = np.fromiter(draw, float, count=2 * n).reshape(n, 2)
    x = np.sqrt(-2 * np.log(np.maximum(flat[:, 0], 1e-12))) * np.cos(2 * np.pi * flat[:, 1])
    if pink:
        # Poles and gains of the filter.
        poles = np.array([0.99886, 0.99332, 0.96900, 0.86650, 0.55000, -0.7616])
        gains = np.array([0.0555179, 0.0750759, 0.1538520, 0.3104856, 0.5329522, -0.0168980])
        state, before, out = np.zeros(6), 0.0, np.empty(n)
        for k, w in enumerate(x):
            state = poles * state + gains * w
            out[k] = state.sum() + before + w * 0.5362
            before = w * 0.115926
        x = out
    level = np.sqrt(np.mean(x**2)) if n else 1.0
    return x * (10 ** (rms_db / 20) / level)


def steady(n: int, hz: float, rate: int, rms_db: float) -> np.ndarray:
    """A sine at a level."""
    return 10 ** (rms_db / 20) * np.sqrt(2) * np.sin(2 * np.pi * hz / rate * np.arange(n))


def saw(n: int, hz: float, rate: int, rms_db: float) -> np.ndarray:
    """A sawtooth at a level, of the harmonics below half the rate only."""
    partials = np.arange(1, max(1, int(rate / 2 // hz) - 1) + 1)
    x = sum(np.sin(2 * np.pi * hz * k / rate * np.arange(n)) / k for k in partials)
    level = np.sqrt(np.mean(x**2)) if n else 0.0
    return x * (10 ** (rms_db / 20) / (level or 1.0))


def as_blocks(take_id: str, samples: np.ndarray, rate: int, block: int = 65536) -> pd.DataFrame:
    """The samples as rows of blocks; an empty take has no rows."""
    starts = range(0, len(samples), block)
    return pd.DataFrame({"take_id": take_id, "sample_rate": rate, "block_no": range(len(starts)), "start_sample": list(starts), "samples": [np.asarray(samples[s : s + block], dtype="float32").tolist() for s in starts]})


def generate(notes: DataFrame, rate: int = 48000, lead: float = 0.0, tail: float = 0.0) -> DataFrame:
    """Audio blocks of rows (take_id, pos, midi, dur_sec, gap_sec): one signal a take."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        samples, _ = melody([Tone(m, d, g) for m, d, g in zip(rows["midi"], rows["dur_sec"], rows["gap_sec"], strict=True)], rate, lead, tail)
        return as_blocks(rows["take_id"].iloc[0], samples, rate)

    return notes.select("take_id", "pos", "midi", "dur_sec", "gap_sec").groupBy("take_id").applyInPandas(one, AUDIO)
