"""Movement within voiced runs: legs, transitions and oscillations, the centre and its steps.

A run is a row with the arrays of its frames. Legs are a fold over such an array: the state holds the place, the leg under way
and those found. Legs then are a table: what a leg is depends on the legs before and after it, and what it
marks comes back to the frames by an interval join. Places are counted from a run's first frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Segment
from . import frames as fr

# Fixed values of the reference.
PROGRESS, REVERSAL, STALL_SEC = 0.05, 0.6, 0.08
OPPOSITE_FRAMES, OPPOSITE_SHARE = 3, 0.5
CENTRE_SEC, STEP_SEMITONES, PLATEAU_SEC = 0.3, 0.6, 0.12

_LEG = "struct<a:int,e:int,d:double>"


@dataclass(frozen=True)
class Pace:
    """Widths in frames of the given period."""

    period: float

    def frames(self, seconds: float, least: int) -> int:
        return max(least, int(seconds / self.period + 0.5))

    @property
    def stall(self) -> int:
        return self.frames(STALL_SEC, 2)

    @property
    def centre(self) -> int:
        return self.frames(CENTRE_SEC, 3)

    @property
    def plateau(self) -> int:
        return self.frames(PLATEAU_SEC, 1)


def in_runs(frames: DataFrame, least: int, flag: str = "voiced") -> DataFrame:
    """The flagged frames of runs of least frames at least, with run (its first frame) and place."""
    kept = frames.where(flag).withColumn("__island", F.col("frame_idx") - F.row_number().over(fr.take_order()))
    own = Window.partitionBy("take_id", "__island")
    sized = kept.withColumns({"run": F.min("frame_idx").over(own), "__n": F.count(F.lit(1)).over(own)})
    return sized.where(F.col("__n") >= least).withColumn("place", (F.col("frame_idx") - F.col("run")).cast("int")).drop("__island", "__n")


def with_centre(frames: DataFrame, x: str, width: int, places: float | None = None) -> DataFrame:
    """Adds centre within each run (take_id, run, place): the middle of the least-spread window that holds the frame,
    the earliest on ties; of a run shorter than a window the middle of all of it.

    With places, a window that is later by so many places must be narrower by more than one unit of x to be taken.
    """
    run = Window.partitionBy("take_id", "run")
    ahead, back = run.orderBy("place").rowsBetween(0, width - 1), run.orderBy("place").rowsBetween(-(width - 1), 0)
    low, high = F.min(x).over(ahead), F.max(x).over(ahead)
    full = F.count(F.lit(1)).over(ahead) == width
    spread = high - low if places is None else (high - low) * places + F.col("place")
    window = F.when(full, F.struct(spread.alias("spread"), F.col("place").alias("at"), ((high + low) / 2).alias("mid")))
    least = F.min("__window").over(back).getField("mid")
    whole = (F.min(x).over(run) + F.max(x).over(run)) / 2
    return frames.withColumn("__window", window).withColumn("centre", F.coalesce(least, whole)).drop("__window")


def slopes(x: Column, period: float) -> Column:
    """Central differences a second of an array, one-sided at its ends; 0 of a single value."""
    n = F.size(x)

    def at(v: Column, i: Column) -> Column:
        after, before = F.least(i + 1, n - 1), F.greatest(i - 1, F.lit(0))
        return F.coalesce(F.try_divide(F.get(x, after) - F.get(x, before), (after - before) * F.lit(period)), F.lit(0.0))

    return F.transform(x, at)


def legs(x: Column, slope: Column, least_slope: float, stall: int) -> Column:
    """Legs (a, e: first and last place, d: distance) of an array: from a place before the first slope of least_slope
    to the last extreme, ended by a turn back or a stall. The next leg is looked for after the extreme.

    The fold's steps are as many as the scan can take: each leg looks ahead of its end by a stall at most.
    """
    n = F.size(x)
    none = F.array().cast(f"array<{_LEG}>")
    start = F.struct(F.lit(0).alias("p"), F.lit(-1).alias("s"), F.lit(0).alias("b"), F.lit(0.0).alias("sign"), F.lit(0.0).alias("top"), F.lit(0).alias("e"), none.alias("found"))

    def state(old: Column, **new: Column) -> Column:
        return F.struct(*[new.get(c, old[c]).cast(t).alias(c) for c, t in (("p", "int"), ("s", "int"), ("b", "int"), ("sign", "double"), ("top", "double"), ("e", "int"), ("found", f"array<{_LEG}>"))])

    def step(now: Column, _: Column) -> Column:
        p = now["p"]
        here, rise = F.get(x, p), F.get(slope, p)
        back = F.greatest(p - 1, F.lit(0))
        begun = state(now, s=back, b=p, sign=F.signum(rise), top=F.get(x, back), e=back, p=back + 1)
        ahead = (here - now["top"]) * now["sign"]
        leg = F.struct(now["s"].alias("a"), now["e"].alias("e"), (F.get(x, now["e"]) - F.get(x, now["s"])).alias("d"))
        ended = state(now, s=F.lit(-1), p=F.greatest(now["e"], now["b"]) + 1, found=F.when(now["e"] > now["s"], F.concat(now["found"], F.array(leg))).otherwise(now["found"]))
        idle = F.when(p >= n - 1, now).when(F.abs(rise) < least_slope, state(now, p=p + 1)).otherwise(begun)
        under_way = F.when(p >= n, ended).when(ahead > PROGRESS, state(now, top=here, e=p, p=p + 1)).when((-ahead > REVERSAL) | (p - now["e"] > stall), ended).otherwise(state(now, p=p + 1))
        return F.when(now["s"] < 0, idle).otherwise(under_way)

    return F.aggregate(F.sequence(F.lit(1), n * (stall + 6) + 2), start, step, lambda done: done["found"])


def run_rows(frames: DataFrame, *columns: str) -> DataFrame:
    """take_id, run and the array of each column over the run's places: a row a run, as long as a take at most."""
    ordered = F.array_sort(F.collect_list(F.struct("place", *columns)))
    rows = frames.groupBy("take_id", "run").agg(ordered.alias("__all"))
    return rows.select("take_id", "run", *[F.col("__all").getField(c).alias(c) for c in columns])


def leg_table(runs: DataFrame, x: str, period: float, least_slope: float) -> DataFrame:
    """take_id, run, leg_no, a, e, d, rate (a second) of the legs of the array x of every run."""
    sloped = runs.withColumn("__slope", slopes(F.col(x), period))
    found = sloped.select("take_id", "run", F.posexplode(legs(F.col(x), F.col("__slope"), least_slope, Pace(period).stall)).alias("leg_no", "leg"))
    return found.select("take_id", "run", "leg_no", "leg.*", (F.abs("leg.d") / ((F.col("leg.e") - F.col("leg.a")) * F.lit(period))).alias("rate"))


def marked_spans(table: DataFrame, settings: Segment) -> DataFrame:
    """take_id, run, kind (transitional, oscillating), low, high (places, both included) of what legs mark.

    A leg that is long or fast counts as a transition, unless a neighbour takes at least half of it back at
    once: then it, and what lies between the two, oscillates.
    """
    own = Window.partitionBy("take_id", "run").orderBy("leg_no")
    leg = F.struct("a", "e", "d")
    both = table.withColumns({"before": F.lag(leg).over(own), "after": F.lead(leg).over(own)})
    moved = both.where((F.abs("d") >= settings.glide_min_semitones) | (F.col("rate") > settings.glide_slope))

    def undone(other: Column) -> Column:
        gap = F.greatest(F.col("a"), other["a"]) - F.least(F.col("e"), other["e"])
        return F.coalesce((F.col("d") * other["d"] < 0) & (F.abs(other["d"]) >= OPPOSITE_SHARE * F.abs("d")) & (gap <= OPPOSITE_FRAMES), F.lit(False))

    def between(other: Column) -> Column:
        return F.when(undone(other), F.struct(F.lit("oscillating").alias("kind"), F.least(F.col("e"), other["e"]).alias("low"), F.greatest(F.col("a"), other["a"]).alias("high")))

    before, after = F.col("before"), F.col("after")
    kind = F.when(undone(before) | undone(after), "oscillating").otherwise("transitional")
    spans = F.array_compact(F.array(F.struct(kind.alias("kind"), F.col("a").alias("low"), F.col("e").alias("high")), between(before), between(after)))
    return moved.select("take_id", "run", F.explode(spans).alias("s")).select("take_id", "run", "s.*")


def flagged(frames: DataFrame, spans: DataFrame, least_slope: float, slope: str = "slope") -> DataFrame:
    """frames (take_id, run, place, frame_idx, slope) with transitional and oscillating from spans, by an interval join."""
    intervals = spans.select("take_id", "kind", (F.col("run") + F.col("low")).alias("from"), (F.col("run") + F.col("high") + 1).alias("to"))
    hit = fr.met(frames.select("take_id", "frame_idx", slope), intervals, "take_id", "frame_idx", "from", "to", 64.0)
    kinds = hit.groupBy("take_id", "frame_idx").agg(F.bool_or((F.col("kind") == "transitional") & (F.abs(slope) >= least_slope)).alias("transitional"), F.bool_or(F.col("kind") == "oscillating").alias("oscillating"))
    met = frames.join(kinds, ["take_id", "frame_idx"], "left")
    return met.fillna(False, ["transitional", "oscillating"])


def step_places(runs: DataFrame, x: str, period: float, settings: Segment, plateau: int | None = None) -> DataFrame:
    """take_id, frame_idx of the frames at which the centre (array x) steps from one plateau to another: the steepest of
    a leg, the earliest on ties."""
    plateau = plateau or Pace(period).plateau
    sloped = runs.withColumn("__slope", slopes(F.col(x), period))
    found = sloped.withColumn("leg", F.explode(legs(F.col(x), F.col("__slope"), settings.glide_min_slope, Pace(period).stall)))
    a, e, d = F.col("leg.a"), F.col("leg.e"), F.abs("leg.d")
    rate = d / ((e - a) * F.lit(period))
    flat = lambda i, j: F.abs(F.get(x, i) - F.get(x, j)) <= STEP_SEMITONES / 2
    steps = found.where((d >= STEP_SEMITONES) & (rate >= settings.glide_slope) & (a >= plateau) & (e + plateau < F.size(x)) & flat(a - plateau, a) & flat(e + plateau, e))
    steepest = F.array_max(F.transform(F.sequence(a, e), lambda k: F.struct(F.abs(F.get("__slope", k)).alias("slope"), (-k).alias("k"))))
    return steps.select("take_id", (F.col("run") - steepest.getField("k")).alias("frame_idx"), F.lit(True).alias("stepped")).distinct()


def with_movement(frames: DataFrame, x: str, period: float, settings: Segment = Segment()) -> DataFrame:
    """Frames in runs with slope, centre, transitional, oscillating and stepped."""
    run = Window.partitionBy("take_id", "run").orderBy("place")
    before, after = F.lag(x).over(run), F.lead(x).over(run)
    slope = F.when(before.isNotNull() & after.isNotNull(), (after - before) / F.lit(2 * period)).when(after.isNotNull(), (after - F.col(x)) / F.lit(period)).when(before.isNotNull(), (F.col(x) - before) / F.lit(period)).otherwise(0.0)
    own = with_centre(frames.withColumn("slope", slope), x, Pace(period).centre)
    rows = run_rows(own, x, "centre")
    spans = marked_spans(leg_table(rows, x, period, settings.glide_min_slope), settings)
    met = flagged(own, spans, settings.glide_min_slope)
    return met.join(step_places(rows, "centre", period, settings), ["take_id", "frame_idx"], "left").fillna(False, ["stepped"])
