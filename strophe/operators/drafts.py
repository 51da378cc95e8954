"""Drafts of notes: one fold over each run that opens, settles and closes them.

The state holds the draft under way (where it began, where its pitch settled, the last accepted pitches and how
far their median has moved), the frames that wait to be told apart, and the drafts that are closed. A run is
as long as a take at most, and so is its state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Segment
from .movement import run_rows

_DRAFT = "struct<low:int,high:int,settled:int,reach:double>"
_STATE = {"start": "int", "settled": "int", "known": "array<double>", "least": "double", "most": "double", "waiting": "array<int>", "closed": f"array<{_DRAFT}>"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def middle(values: Column) -> Column:
    """The median of an array without nulls, null of an empty one."""
    n = F.size(values)
    return let(F.sort_array(values), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _last(values: Column, most: int) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - most + 1), F.lit(most))


def draft_spans(x: Column, transitional: Column, stepped: Column, settings: Segment) -> Column:
    """Drafts (low, high: places, settled: the place of the first settled pitch or -1, reach of the reference) of a run's arrays."""
    tolerance, confirm, memory = settings.tolerance_cents / 100, settings.confirm_frames, settings.reference_median
    no_places, no_pitches, nothing = F.array().cast("array<int>"), F.array().cast("array<double>"), F.lit(None).cast("double")
    pitches = lambda places: F.transform(places, lambda p: F.get(x, p))

    def state(old: Column | None = None, **new: Column) -> Column:
        return F.struct(*[(new[c] if c in new else old[c]).cast(t).alias(c) for c, t in _STATE.items()])

    def closed(now: Column, end: Column) -> Column:
        reach = F.coalesce(now["most"] - now["least"], F.lit(0.0))
        one = F.struct(now["start"].alias("low"), end.cast("int").alias("high"), now["settled"].alias("settled"), reach.alias("reach"))
        return F.when(end >= now["start"], F.concat(now["closed"], F.array(one))).otherwise(now["closed"])

    def block_of(waiting: Column) -> Column:
        """The waiting places that settle a pitch: the last ones lie together, and those before them near their median."""
        tail = pitches(_last(waiting, confirm))
        near = let(middle(tail), lambda m: let(F.array_max(F.filter(F.transform(waiting, lambda p, k: F.when(F.abs(F.get(x, p) - m) > tolerance, k)), lambda k: k.isNotNull())), lambda far: F.slice(waiting, F.coalesce(far + 2, F.lit(1)), F.size(waiting))))
        together = (F.size(waiting) >= confirm) & (F.array_max(tail) - F.array_min(tail) <= tolerance)
        return F.when(together, near).otherwise(no_places)

    def settled_at(now: Column, start: Column, block: Column, done: Column) -> Column:
        return let(_last(pitches(block), memory), lambda known: let(middle(known), lambda m: state(now, start=start, settled=F.get(block, F.lit(0)), known=known, least=m, most=m, waiting=no_places, closed=done)))

    def step(now: Column, i: Column) -> Column:
        here, moving = F.get(x, i), F.get(transitional, i)
        fresh = state(start=i, settled=F.lit(-1), known=no_pitches, least=nothing, most=nothing, waiting=F.when(moving, no_places).otherwise(F.array(i)), closed=closed(now, i - 1))
        longer = F.concat(now["waiting"], F.array(i))
        unsettled = let(block_of(longer), lambda block: F.when(F.size(block) > 0, settled_at(now, now["start"], block, now["closed"])).otherwise(state(now, waiting=longer)))

        def inside() -> Column:
            ahead = middle(_last(F.concat(now["known"], F.array(here)), memory))
            slid = state(start=i, settled=i, known=F.array(here), least=here, most=here, waiting=no_places, closed=closed(now, i - 1))
            more = let(_last(F.concat(now["known"], pitches(now["waiting"]), F.array(here)), memory), lambda known: let(middle(known), lambda m: state(now, known=known, least=F.least(now["least"], m), most=F.greatest(now["most"], m), waiting=no_places)))
            return let(ahead, lambda a: F.when(F.greatest(now["most"], a) - F.least(now["least"], a) > settings.drift_cap, slid).otherwise(more))

        def outside(block: Column) -> Column:
            first = F.get(block, F.lit(0))
            still = F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(first - 1, F.lit(0))), lambda k: ~F.get(transitional, k) & (k < first)))
            onset = F.greatest(now["start"] + 1, F.coalesce(still + 1, F.lit(0)))
            return let(onset, lambda at: settled_at(now, at, block, closed(now, at - 1)))

        apart = let(block_of(longer), lambda block: F.when(F.size(block) > 0, outside(block)).otherwise(state(now, waiting=longer)))
        settled = F.when(F.abs(here - middle(now["known"])) <= tolerance, inside()).otherwise(apart)
        return F.when(F.get(stepped, i) & (i > now["start"]), fresh).when(moving, state(now, waiting=no_places)).when(now["settled"] < 0, unsettled).otherwise(settled)

    begin = state(start=F.lit(0), settled=F.lit(-1), known=no_pitches, least=nothing, most=nothing, waiting=no_places, closed=F.array().cast(f"array<{_DRAFT}>"))
    return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), begin, step, lambda now: closed(now, F.size(x) - 1))


def drafts(frames: DataFrame, x: str, settings: Segment = Segment()) -> DataFrame:
    """take_id, start_idx, end_idx, settled_idx (-1: never), glided, reach of the drafts of frames in runs with their movement."""
    rows = run_rows(frames, x, "transitional", "stepped")
    found = rows.select("take_id", "run", F.explode(draft_spans(F.col(x), F.col("transitional"), F.col("stepped"), settings)).alias("d"))
    settled = F.when(F.col("d.settled") >= 0, F.col("run") + F.col("d.settled")).otherwise(F.lit(-1))
    return found.select("take_id", (F.col("run") + F.col("d.low")).alias("start_idx"), (F.col("run") + F.col("d.high")).alias("end_idx"), settled.alias("settled_idx"), (F.col("d.settled") > F.col("d.low")).alias("glided"), F.col("d.reach").alias("reach"))
