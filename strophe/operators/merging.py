"""Drafts to notes: measuring spans of frames, joining neighbours to a fixpoint, resolving short ones.

Spans are rows (take_id, start_idx, end_idx, settled_idx, glided, reach) and do not overlap. Each round measures what it has
changed anew and writes its spans, so a plan never grows with the rounds.

Joins go from left to right and a joined note is compared with its next neighbour before anything to
the left is looked at again. So a take joins one pair a round: the first at or after its cursor; when
there is none and it has joined any since the cursor last stood at the start, the cursor goes back there, else the take is
done. What can never be joined, whatever either side has grown to (by the frames between two spans alone), parts a take into
units. Units are independent, so rounds are as many as the longest unit needs; lone spans are done at once, and rounds
read the frames of open units only, which are written anew as soon as the open spans have halved.
No join of a round is a broadcast one: what rounds send to the driver would grow with their number.

Short notes are resolved shortest first. What happens to one hangs on its two neighbours alone and changes
those alone, and what is joined only grows. So every note that is shorter than all others within two places
is resolved in the same round, and the result is that of one after the other: nothing shorter can
reach its neighbours before it, as that would have to pass a note within two places, which is longer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.pitch import half_up
from ..streaming.run import shared_path
from . import frames as fr

# Fixed values of the reference.
WOBBLE_SPAN, WOBBLE_CENTRE = 4.0, 0.6
MASKED_SHARE = 0.8
TRIM = 64.0  # frames of one bucket of the interval joins

SPAN = ["take_id", "start_idx", "end_idx", "settled_idx", "glided", "reach"]
MEASURES = ["pitch", "confidence", "clipped", "loudness", "low_sec", "high_sec"]


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _inside(frames: DataFrame, spans: DataFrame, start: Column, stop: Column, *columns: str) -> DataFrame:
    """Frames with the span (start_idx and columns) that holds them, by a bucketed join; stop is exclusive."""
    own = spans.select(F.col("take_id"), F.col("start_idx").alias("of"), start.alias("from"), stop.alias("to"), *columns)
    return fr.met(frames, own.hint("merge"), "take_id", "frame_idx", "from", "to", TRIM)


def _cut(frames: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """The frames from the first to the last span of each group of a take, written anew; groups do not overlap."""
    bounds = spans.groupBy("take_id", by).agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"))
    return kept(_inside(frames, bounds, F.col("start_idx"), F.col("end_idx") + 1).select(*frames.columns), "cut")


def measure(spans: DataFrame, frames: DataFrame, config: Config) -> DataFrame:
    """spans with MEASURES; spans without a single pitched frame go.

    frames: take_id, frame_idx, t_sec, smooth, voiced, transitional, clarity, snr_db, band_rms_db, clipped.
    """
    s = config.segment
    met = _inside(frames, spans, F.col("start_idx"), F.col("end_idx") + 1, "settled_idx")
    one = Window.partitionBy("take_id", "of")
    pitched = F.col("smooth").isNotNull()
    usable = pitched & (F.col("frame_idx") >= F.greatest("settled_idx", "of")) & F.col("voiced") & ~F.col("transitional")
    rows = met.withColumns({"__usable": usable, "__n": F.count_if(usable).over(one), "__low": F.min("t_sec").over(one), "__high": F.max("t_sec").over(one)})
    rows = rows.withColumn("__chosen", F.when(F.col("__n") > 0, F.col("__usable")).otherwise(pitched))
    length = F.col("__high") - F.col("__low")
    late = F.col("__chosen") & ((length * 1000 <= s.attack_trim_min_ms) | (F.col("t_sec") >= F.col("__low") + s.attack_trim * length))
    rows = rows.withColumns({"__late": late, "__m": F.count_if(late).over(one)})
    x = lambda c: F.when(F.when(F.col("__m") > 0, F.col("__late")).otherwise(F.col("__chosen")), F.col(c))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    found = rows.groupBy("take_id", F.col("of").alias("start_idx")).agg(
        F.median(x("smooth")).alias("pitch"), unit(0.6 * F.avg(x("clarity")) + 0.4 * unit((F.avg(x("snr_db")) - 6) / 24)).alias("confidence"), F.bool_or(F.coalesce("clipped", F.lit(False))).alias("clipped"),
        F.median("band_rms_db").alias("loudness"), F.min("t_sec").alias("low_sec"), F.max("t_sec").alias("high_sec"),
    )
    return spans.select(*SPAN).join(found.where("pitch is not null").hint("merge"), ["take_id", "start_idx"])


def _neighbours(spans: DataFrame, *by: str) -> DataFrame:
    """Each span with the one after it (of its take and by) as ``next``."""
    order = Window.partitionBy("take_id", *by).orderBy("start_idx")
    return spans.withColumn("next", F.lead(F.struct("start_idx", "end_idx", "settled_idx", "reach", "pitch", "loudness")).over(order))


def gap_facts(pairs: DataFrame, frames: DataFrame, config: Config) -> DataFrame:
    """pairs (take_id, start_idx, end_idx, next, quiet) with silent (some frame between is truly so) and louder (the
    share of those at least as loud as quiet), null louder without a frame."""
    v = config.voicing
    need = F.greatest(F.lit(v.absolute_floor_db), F.coalesce(F.col("floor_db") + v.sustain_db, F.lit(float("-inf"))))
    met = _inside(frames.select("take_id", "frame_idx", "band_rms_db", "floor_db"), pairs, F.col("end_idx") + 1, F.col("next.start_idx"), "quiet")
    facts = met.groupBy("take_id", F.col("of").alias("start_idx")).agg(F.bool_or(F.col("band_rms_db") < need).alias("silent"), F.avg((F.col("band_rms_db") >= F.col("quiet")).cast("double")).alias("louder"))
    return pairs.join(facts.hint("merge"), ["take_id", "start_idx"], "left").fillna(False, ["silent"])


def _gap_ms(period: float) -> Column:
    return (F.col("next.start_idx") - F.col("end_idx") - 1) * period * 1000


def parted_by_dropouts(pairs: DataFrame, frames: DataFrame, config: Config, period: float) -> DataFrame:
    """take_id, start_idx of the spans that dropouts() may join with their next, whatever their pitch and loudness become."""
    s = config.segment
    near = pairs.where(_gap_ms(period) <= max(s.gap_merge_ms, s.masked_gap_ms)).withColumn("quiet", F.lit(0.0))
    return gap_facts(near, frames, config).where(~F.col("silent")).select("take_id", "start_idx")


def dropouts(pairs: DataFrame, frames: DataFrame, config: Config, period: float) -> DataFrame:
    """take_id, start_idx of the spans whose next is of the same rounded pitch and parted from it by a dropout only."""
    s = config.segment
    gap_ms = _gap_ms(period)
    near = pairs.where((half_up(F.col("pitch")) == half_up(F.col("next.pitch"))) & (gap_ms <= max(s.gap_merge_ms, s.masked_gap_ms))).withColumn("quiet", F.least("loudness", F.col("next.loudness")))
    known = gap_facts(near, frames, config)
    return known.where(~F.col("silent") & ((gap_ms <= s.gap_merge_ms) | ((gap_ms <= s.masked_gap_ms) & (F.col("louder") >= MASKED_SHARE)))).select("take_id", "start_idx")


def _moving_edges(near: DataFrame, frames: DataFrame) -> DataFrame:
    """take_id, start_idx of the spans (with next) between whose end and their next's start all frames move."""
    moving = F.coalesce(F.col("oscillating"), F.lit(False)) | F.coalesce(F.col("transitional"), F.lit(False))
    edge = _inside(frames.select("take_id", "frame_idx", moving.alias("moving")), near, F.col("end_idx"), F.col("next.start_idx") + 1)
    return edge.groupBy("take_id", F.col("of").alias("start_idx")).agg(F.bool_and("moving").alias("moving")).where("moving").select("take_id", "start_idx")


def parted_by_movement(pairs: DataFrame, frames: DataFrame, config: Config, period: float) -> DataFrame:
    """take_id, start_idx of the spans that wobbles() may join with their next, whatever their pitches become."""
    return _moving_edges(pairs.where(F.col("next.start_idx") - F.col("end_idx") <= 1), frames)


def wobbles(pairs: DataFrame, frames: DataFrame, config: Config, period: float) -> DataFrame:
    """take_id, start_idx of the spans that are one note with their next, whose pitch only swings about a centre.

    low and high are the pitches of what this pass has joined so far.
    """
    reach = F.greatest("high", F.col("next.pitch")) - F.least("low", F.col("next.pitch"))
    near = pairs.where((F.col("next.start_idx") - F.col("end_idx") <= 1) & (reach <= WOBBLE_SPAN))
    edge = _moving_edges(near, frames)
    onset = F.when(F.col("settled_idx") >= 0, F.col("settled_idx")).otherwise(F.col("start_idx"))
    centres = _inside(frames.select("take_id", "frame_idx", "centre"), near.join(edge.hint("merge"), ["take_id", "start_idx"]), onset, F.col("next.end_idx") + 1)
    return centres.groupBy("take_id", F.col("of").alias("start_idx")).agg((F.max("centre") - F.min("centre")).alias("swing")).where(F.coalesce(F.col("swing") <= WOBBLE_CENTRE, F.lit(True))).select("take_id", "start_idx")


#: What of a test hangs on the frames between two spans alone; another test has a take as its unit.
_MAY: dict[Callable, Callable] = {dropouts: parted_by_dropouts, wobbles: parted_by_movement}


def _units(spans: DataFrame, may: DataFrame) -> DataFrame:
    """Adds unit, the first span's start of those that may join one after the other, and members, its size."""
    order = Window.partitionBy("take_id").orderBy("start_idx")
    tied = spans.join(may.withColumn("__may", F.lit(True)).hint("merge"), ["take_id", "start_idx"], "left")
    opened = tied.withColumn("__first", F.when(F.coalesce(F.lag("__may").over(order), F.lit(False)), None).otherwise(F.col("start_idx")))
    named = opened.withColumn("unit", F.last("__first", ignorenulls=True).over(order)).drop("__may", "__first")
    return named.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("take_id", "unit")))


def join_to_fixpoint(spans: DataFrame, frames: DataFrame, config: Config, period: float, belong: Callable[[DataFrame, DataFrame, Config, float], DataFrame]) -> DataFrame:
    """Measured spans after passes from left to right that join neighbours which belong together, until one joins none."""
    fresh = {"cursor": F.lit(-1), "dirty": F.lit(False), "low": F.col("pitch"), "high": F.col("pitch")}
    every = spans.select(*SPAN, *MEASURES)
    if belong in _MAY:
        every = kept(every, "whole")
        pairs = _neighbours(every).where(F.col("next").isNotNull())
        every = _units(every, _MAY[belong](pairs, frames, config, period))
    else:
        every = every.withColumns({"unit": F.lit(0), "members": F.count(F.lit(1)).over(Window.partitionBy("take_id"))})
    every = kept(every, "units")
    done = [every.where("members = 1").select(*SPAN, *MEASURES)]
    now = every.where("members > 1").drop("members").withColumns(fresh)
    columns, unit, last = [*SPAN, *MEASURES, "cursor", "dirty", "low", "high", "unit"], Window.partitionBy("take_id", "unit"), None
    order = unit.orderBy("start_idx")
    while left := now.count():
        if last is None or 2 * left <= last:
            frames, last = _cut(frames, now, "unit"), left
        pairs = _neighbours(now, "unit").where(F.col("next").isNotNull() & (F.col("start_idx") >= F.col("cursor")))
        hit = belong(pairs, frames, config, period).select("take_id", "start_idx", F.lit(True).alias("hit"))
        first = now.join(hit.hint("merge"), ["take_id", "start_idx"], "left").withColumn("joins", F.min(F.when(F.col("hit"), F.col("start_idx"))).over(unit)).drop("hit")
        marked = first.withColumns({"gone": F.coalesce(F.lag("start_idx").over(order) == F.col("joins"), F.lit(False)), "next": F.lead(F.struct("end_idx", "reach", "pitch")).over(order)})
        marked = kept(marked, "marked")
        here = F.col("start_idx") == F.col("joins")
        grown = marked.where(here).select("take_id", "start_idx", F.col("next.end_idx").alias("end_idx"), "settled_idx", "glided", F.greatest("reach", F.col("next.reach")).alias("reach"))
        reached = marked.where(here).select("take_id", "start_idx", F.least("low", F.col("next.pitch")).alias("low"), F.greatest("high", F.col("next.pitch")).alias("high"), "unit")
        anew = measure(grown, frames, config).join(reached.hint("merge"), ["take_id", "start_idx"])
        joined = anew.withColumns({"cursor": F.col("start_idx"), "dirty": F.lit(True)}).select(*columns)
        others = marked.where("joins is not null and start_idx <> joins and not gone").withColumns({"cursor": F.col("joins"), "dirty": F.lit(True)}).select(*columns)
        again = marked.where("joins is null and dirty").withColumns(fresh).select(*columns)
        done.append(marked.where("joins is null and not dirty").select(*SPAN, *MEASURES))
        now = kept(joined.union(others).union(again), "spans")
    return _together(done, spans)


def _together(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.select(*SPAN, *MEASURES).where("false")
    for p in parts:
        out = out.union(p)
    return out


def resolve_short(spans: DataFrame, frames: DataFrame, config: Config, period: float) -> DataFrame:
    """Measured spans without short ones: each goes to the neighbour of the nearest pitch that it touches, or away."""
    s = config.segment
    now, done, last = kept(spans.select(*SPAN, *MEASURES), "spans"), [], None
    size = F.col("end_idx") - F.col("start_idx") + 1
    order = Window.partitionBy("take_id").orderBy("start_idx")
    short = size * period * 1000 < s.min_note_ms
    while True:
        rank = F.when(short, F.struct(size.alias("n"), F.col("start_idx").alias("at")))
        ranked = kept(now.withColumns({"rank": rank, "any": F.bool_or(short).over(Window.partitionBy("take_id"))}), "ranked")
        done.append(ranked.where("not any").select(*SPAN, *MEASURES))
        open_ = ranked.where("any")
        left = open_.count()
        if not left:
            return _together(done, spans)
        if last is None or 2 * left <= last:
            frames, last = _cut(frames, open_, "any"), left
        others = [F.lead("rank", k).over(order) for k in (1, 2)] + [F.lag("rank", k).over(order) for k in (1, 2)]
        acts = F.col("rank").isNotNull()
        for o in others:
            acts = acts & F.coalesce(F.col("rank") < o, F.lit(True))
        whole = F.struct("start_idx", "end_idx", "settled_idx", "glided", "reach", "pitch")
        marked = kept(open_.withColumns({"acts": acts, "before": F.lag(whole).over(order), "next": F.lead(whole).over(order)}), "shorts")

        def side(other: str, left: bool) -> DataFrame:
            """The acting spans that touch their neighbour on one side and are near it in pitch."""
            own = marked.where(F.col("acts") & F.col(other).isNotNull()).withColumn("apart", F.abs(F.col("pitch") - F.col(f"{other}.pitch"))).where(F.col("apart") <= 2 * s.tolerance_cents / 100)
            low, high = ("before.end_idx", "start_idx") if left else ("end_idx", "next.start_idx")
            frames_between = F.col(high) - F.col(low) - 1
            pairs = own.select("take_id", F.col("start_idx").alias("by"), "apart", F.col(low).alias("end_idx"), F.struct(F.col(high).alias("start_idx")).alias("next"), F.lit(0.0).alias("quiet"), frames_between.alias("between")).withColumn("start_idx", F.col("by"))
            facts = gap_facts(pairs, frames, config)
            return facts.where((F.col("between") <= 0) | ((F.col("between") * period * 1000 <= s.gap_merge_ms) & ~F.col("silent"))).select("take_id", "by", F.struct("apart", F.lit(0 if left else 1).alias("side")).alias("way"))

        ways = side("before", True).union(side("next", False)).groupBy("take_id", F.col("by").alias("start_idx")).agg(F.min("way").getField("side").alias("side"))
        solved = kept(marked.where("acts").select(*SPAN, "before", "next").join(ways.hint("merge"), ["take_id", "start_idx"], "left"), "solved")
        own = F.struct("start_idx", "end_idx", "settled_idx", "glided", "reach")
        a = F.when(F.col("side") == 0, F.struct(*[F.col(f"before.{c}").alias(c) for c in SPAN[1:]])).otherwise(own)
        b = F.when(F.col("side") == 0, own).otherwise(F.struct(*[F.col(f"next.{c}").alias(c) for c in SPAN[1:]]))
        both = solved.where("side is not null").select("take_id", a.alias("a"), b.alias("b"))
        settled = F.when(F.col("a.settled_idx") >= 0, F.col("a.settled_idx")).otherwise(F.col("b.settled_idx"))
        grown = both.select("take_id", F.col("a.start_idx").alias("start_idx"), F.col("b.end_idx").alias("end_idx"), settled.alias("settled_idx"), F.col("a.glided").alias("glided"), F.greatest("a.reach", "b.reach").alias("reach"))
        gone = solved.where("side is null").select("take_id", "start_idx").union(both.select("take_id", F.col("a.start_idx"))).union(both.select("take_id", F.col("b.start_idx")))
        rest = marked.select(*SPAN, *MEASURES).join(gone.hint("merge"), ["take_id", "start_idx"], "left_anti")
        now = kept(rest.select(*SPAN, *MEASURES).union(measure(grown, frames, config).select(*SPAN, *MEASURES)), "spans")
