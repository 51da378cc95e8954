"""Pitch, level and scoring scalars as column expressions. Nothing here leaves whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sharps from C, reference pitch, verdict bounds in cents.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
A4_HZ = 440.0
CLEAN_BELOW, OFF_BELOW = 30, 70


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def six(x: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def hz_to_midi(hz: Column, a4: float = A4_HZ) -> Column:
    """Fractional MIDI number; null for frequencies that are not positive."""
    return F.when(hz > 0, F.lit(69.0) + F.lit(12.0) * F.log2(hz / F.lit(a4)))


def midi_to_hz(midi: Column, a4: float = A4_HZ) -> Column:
    return F.lit(a4) * F.pow(F.lit(2.0), (midi - 69) / F.lit(12.0))


def nearest_note(midi: Column) -> Column:
    return half_up(midi).cast("int")


def cents_from(midi: Column, note: Column) -> Column:
    return (midi - note) * 100


def pitch_class(note: Column) -> Column:
    return F.pmod(note, F.lit(12))


def octave(note: Column) -> Column:
    return (F.floor(note / F.lit(12)) - 1).cast("int")


def note_name(note: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    return F.concat(F.element_at(names, (pitch_class(note) + 1).cast("int")), octave(note).cast("string"))


def a4_from_cents(cents: Column, a4: float = A4_HZ) -> Column:
    return F.lit(a4) * F.pow(F.lit(2.0), cents / F.lit(1200.0))


def amplitude_to_db(x: Column) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(x, F.lit(1e-12)))


def ratio_to_db(ratio: Column) -> Column:
    """Power ratio in dB, held between -120 and 120."""
    safe = F.when(ratio > 0, F.lit(10.0) * F.log10(ratio)).otherwise(F.lit(-120.0))
    return F.greatest(F.lit(-120.0), F.least(F.lit(120.0), safe))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def verdict(cents: Column) -> Column:
    """clean, off or wrong by the size of the error; missing where there is none."""
    size = F.abs(cents)
    return F.when(cents.isNull(), "missing").when(size < CLEAN_BELOW, "clean").when(size < OFF_BELOW, "off").otherwise("wrong")
