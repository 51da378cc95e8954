"""Seeded uniform numbers as column expressions: the kth draw of a seed, whatever was drawn before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
# Fixed values of the mulberry32 generator.
STEP, SHIFTS = 0x6D2B79F5, (15, 7, 14)


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers of 32 bits; no step of it leaves 64."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF))
    return (low + high * 65536).bitwiseAND(F.lit(_MASK))


def uniform(seed: Column, k: Column | int) -> Column:
    """Draw k (from 1) of a whole seed, in [0, 1)."""
    number = F.lit(k) if isinstance(k, int) else k
    start = (seed.cast("long").bitwiseAND(F.lit(_MASK)) + (number.cast("long") * F.lit(STEP)).bitwiseAND(F.lit(_MASK))).bitwiseAND(F.lit(_MASK))

    def first(a: Column) -> Column:
        return _times(a.bitwiseXOR(F.shiftrightunsigned(a, SHIFTS[0])), a.bitwiseOR(F.lit(1)))

    def second(x: Column) -> Column:
        more = _times(x.bitwiseXOR(F.shiftrightunsigned(x, SHIFTS[1])), x.bitwiseOR(F.lit(61)))
        return x.bitwiseXOR((x + more).bitwiseAND(F.lit(_MASK)))

    value = F.array(start)
    for stage in (first, second, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, SHIFTS[2]))):
        value = F.transform(value, stage)  # each stage names what it is given, so it is made once
    return F.get(value, F.lit(0)) / F.lit(4294967296.0)
