"""Edit cost of two sequences in the engine: the substitution-and-gap recurrence as nested folds over arrays.

It suits short sequences; the full aligner, under transposition and side by side, is in ``attempts``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .attempts import CLEAN, GAP, MOST_SUBSTITUTION, SATURATION

#: Substitution is free up to this many semitones.
FREE = CLEAN / 100


def substitution_cost(difference: Column) -> Column:
    return F.least(F.lit(MOST_SUBSTITUTION), F.greatest(F.lit(0.0), (F.abs(difference) - FREE) / (SATURATION - FREE) * MOST_SUBSTITUTION))


def alignment_cost(left: Column, right: Column) -> Column:
    """Least cost of turning one array of pitches into the other, both in order, at no transposition."""
    first = F.transform(F.concat(F.array(F.lit(0.0)), F.transform(right, lambda x, i: (i + 1) * F.lit(GAP))), lambda x: x.cast("double"))

    def row(above: Column, pitch: Column) -> Column:
        start = F.array((F.element_at(above, 1) + GAP).cast("double"))

        def cell(done: Column, j: Column) -> Column:
            pair = F.get(above, j) + substitution_cost(pitch - F.get(right, j))
            return F.concat(done, F.array(F.least(pair, F.get(above, j + 1) + GAP, F.element_at(done, -1) + GAP)))

        columns = F.when(F.size(right) > 0, F.sequence(F.lit(0), F.size(right) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(columns, start, cell)

    return F.element_at(F.aggregate(left, first, row), -1)
