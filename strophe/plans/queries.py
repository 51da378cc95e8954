"""Queries over the derived views, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pitch as P
from ..operators import align, frames, spectrum
from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"
_TONAL = "coalesce(hz > 0 and clarity >= 0.5 and snr_db >= 12 and peak_to_second_db >= 6, false)"
_PERIOD = 512 / 48000


def query(sql: str, *views: str, recursive: bool = False):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        whole = with_views(sql, *views) if views else sql
        ORACLE_SQL[f.__name__] = whole.replace("with ", "with recursive ", 1) if recursive else whole
        return f

    return register


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "frames_ev").withColumn("tonal", frames.tonal())


def _midi() -> F.Column:
    return P.hz_to_midi(F.col("hz"))


@query(f""" select take_id, frame_idx, round(69 + 12 * log2(hz / 440), 6) + 0.0 as midi, cast(floor(69 + 12 * log2(hz / 440) + 0.5) as int) as note,
        round((69 + 12 * log2(hz / 440) - floor(69 + 12 * log2(hz / 440) + 0.5)) * 100, 6) + 0.0 as cents,
        ({_NAMES})[cast(floor(69 + 12 * log2(hz / 440) + 0.5) as int) % 12 + 1] || cast(cast(floor(floor(69 + 12 * log2(hz / 440) + 0.5) / 12) as int) - 1 as varchar) as name,
        round(440 * pow(2, (floor(69 + 12 * log2(hz / 440) + 0.5) - 69) / 12), 6) + 0.0 as note_hz
        from frames_ev where hz is not null""", "frames_ev")
def pitch_scalars(spark, sf_dir):
    note = P.nearest_note(_midi())
    return _frames(spark, sf_dir).where("hz is not null").select("take_id", "frame_idx", P.six(_midi()).alias("midi"), note.alias("note"), P.six(P.cents_from(_midi(), note)).alias("cents"), P.note_name(note).alias("name"), P.six(P.midi_to_hz(note)).alias("note_hz"))


@query(""" select take_id, frame_idx, round(20 * log10(greatest(clarity, 1e-12)), 6) + 0.0 as amplitude_db,
        round(greatest(-120, least(120, case when clarity > 0 then 10 * log10(clarity / 0.25) else -120 end)), 6) + 0.0 as ratio_db,
        greatest(0.0, least(1.0, (band_rms_db + 70) / 64)) as meter from frames_ev""", "frames_ev")
def level_scalars(spark, sf_dir):
    return _frames(spark, sf_dir).select("take_id", "frame_idx", P.six(P.amplitude_to_db(F.col("clarity"))).alias("amplitude_db"), P.six(P.ratio_to_db(F.col("clarity") / 0.25)).alias("ratio_db"), P.clamp01((F.col("band_rms_db") + 70) / 64).alias("meter"))


@query(""" select seq_id, pos, case when abs(cents_offset) < 30 then 'clean' when abs(cents_offset) < 70 then 'off' else 'wrong' end as verdict,
        round(440 * pow(2, cents_offset / 1200), 6) + 0.0 as a4 from notes_li""", "notes_li")
def note_verdicts(spark, sf_dir):
    c = F.col("cents_offset")
    return view(spark, sf_dir, "notes_li").select("seq_id", "pos", P.verdict(c).alias("verdict"), P.six(P.a4_from_cents(c)).alias("a4"))


@query(f" select take_id, frame_idx, hz from frames_ev where {_TONAL}", "frames_ev")
def tonal_frames(spark, sf_dir):
    return _frames(spark, sf_dir).where("tonal").select("take_id", "frame_idx", "hz")


@query(" select take_id, frame_idx, round(69 + 12 * log2(hz / 440), 6) + 0.0 as midi from frames_ev where hz > 0 and clarity >= 0.5", "frames_ev")
def trail_points(spark, sf_dir):
    return _frames(spark, sf_dir).where("hz > 0 and clarity >= 0.5").select("take_id", "frame_idx", P.six(_midi()).alias("midi"))


_GATED = f"""g as (select *, coalesce(last_value(turn ignore nulls) over (partition by take_id order by frame_idx rows unbounded preceding), false) as voiced
    from (select *, case when not {_TONAL} or band_rms_db < -70 then false when band_rms_db >= -68 then true end as turn from frames_ev))"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.with_gate(_frames(spark, sf_dir).withColumn("candidate", F.col("tonal")), floor_db=-80.0)


@query(f", {_GATED} select take_id, frame_idx, voiced from g", "frames_ev")
def hysteresis_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("take_id", "frame_idx", "voiced")


_ISLANDS = "select take_id, min(frame_idx) as start_idx, max(frame_idx) as end_idx, count(*) as n from (select *, frame_idx - row_number() over (partition by take_id order by frame_idx) as island from {0} where {1}) group by take_id, island having count(*) >= {2}"


@query(f""", g as (select *, coalesce(last_value(turn ignore nulls) over (partition by take_id order by frame_idx rows unbounded preceding), false) as voiced
        from (select *, case when not {_TONAL} or band_rms_db < greatest(-70, -80 - frame_idx % 9 + 6) then false when band_rms_db >= greatest(-70, -80 - frame_idx % 9 + 12) then true end as turn from frames_ev)) select take_id, frame_idx, voiced from g""", "frames_ev")
def hysteresis_floors(spark, sf_dir):
    own = _frames(spark, sf_dir).withColumn("candidate", F.col("tonal"))
    return frames.with_gate(own, F.lit(-80.0) - F.col("frame_idx") % 9).select("take_id", "frame_idx", "voiced")


@query(" " + _ISLANDS.format("frames_ev", "clarity >= 0.25 and band_rms_db > -85", 3), "frames_ev")
def contiguous_runs(spark, sf_dir):
    return frames.runs(_frames(spark, sf_dir).withColumn("flag", F.expr("clarity >= 0.25 and band_rms_db > -85")), "flag", 3)


@query(f""", r as ({_ISLANDS.format("frames_ev", "coalesce(hz > 0, false) and clarity >= 0.25", 3)})
        select r.take_id, start_idx, end_idx, n, round(median(69 + 12 * log2(f.hz / 440)), 6) + 0.0 as midi from r join frames_ev f on f.take_id = r.take_id and f.frame_idx between start_idx and end_idx group by all""", "frames_ev")
def run_summary(spark, sf_dir):
    """Voiced runs and the median pitch of each: one exchange by take."""
    own = _frames(spark, sf_dir)
    kept = own.withColumn("flag", F.coalesce(F.expr("hz > 0 and clarity >= 0.25"), F.lit(False))).where("flag")
    island = kept.withColumn("island", F.col("frame_idx") - F.row_number().over(frames.take_order()))
    spans = island.groupBy("take_id", "island").agg(F.min("frame_idx").alias("start_idx"), F.max("frame_idx").alias("end_idx"), F.count(F.lit(1)).alias("n"), P.six(F.median(_midi())).alias("midi"))
    return spans.where("n >= 3").drop("island")


@query(" select take_id, frame_idx, median(hz) over (partition by take_id order by frame_idx rows between 2 preceding and 2 following) as smooth from frames_ev", "frames_ev")
def sliding_median(spark, sf_dir):
    return _frames(spark, sf_dir).select("take_id", "frame_idx", frames.sliding_median("hz", ["take_id"], "frame_idx", 2).alias("smooth"))


@query(""" select take_id, frame_idx, case when b is not null and a is not null then (a - b) / 4 when a is not null then (a - band_rms_db) / 2 when b is not null then (band_rms_db - b) / 2 end as slope
        from (select *, lag(band_rms_db) over w as b, lead(band_rms_db) over w as a from frames_ev window w as (partition by take_id order by frame_idx))""", "frames_ev")
def central_slope(spark, sf_dir):
    return _frames(spark, sf_dir).select("take_id", "frame_idx", frames.slope("band_rms_db", 2.0).alias("slope"))


@query(""", s as (select take_id, frame_idx as at, max(band_rms_db) over w - min(band_rms_db) over w as spread, (max(band_rms_db) over w + min(band_rms_db) over w) / 2 as mid, count(*) over w as c
            from frames_ev window w as (partition by take_id order by frame_idx rows between current row and 4 following))
        select f.take_id, f.frame_idx, arg_min(s.mid, s.spread * 1000000 + s.at) as centre from frames_ev f left join s on s.take_id = f.take_id and s.c = 5 and s.at between f.frame_idx - 4 and f.frame_idx group by all""", "frames_ev")
def least_spread_centre(spark, sf_dir):
    return frames.centre(_frames(spark, sf_dir), "band_rms_db", 5).select("take_id", "frame_idx", "centre")


@query(""" select seq_id, pos, midi - lag(midi) over w as step, coalesce(dur_sec < 0.7 * m, false) as short, coalesce(dur_sec > 1.5 * m, false) as long, min(midi) over e as low, max(midi) over e as high
        from (select *, median(dur_sec) over (partition by seq_id) as m from notes_li) window w as (partition by seq_id order by pos), e as (partition by seq_id order by pos rows unbounded preceding)""", "notes_li")
def note_windows(spark, sf_dir):
    own = Window.partitionBy("seq_id").orderBy("pos")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    m = F.median("dur_sec").over(Window.partitionBy("seq_id"))
    return view(spark, sf_dir, "notes_li").select("seq_id", "pos", (F.col("midi") - F.lag("midi").over(own)).alias("step"), (F.col("dur_sec") < 0.7 * m).alias("short"), (F.col("dur_sec") > 1.5 * m).alias("long"), F.min("midi").over(so_far).alias("low"), F.max("midi").over(so_far).alias("high"))


@query(" select take_id, frame_idx, last_value(hz ignore nulls) over (partition by take_id order by frame_idx rows between 3 preceding and current row) as held from frames_ev", "frames_ev")
def held_reading(spark, sf_dir):
    return _frames(spark, sf_dir).select("take_id", "frame_idx", F.last("hz", ignorenulls=True).over(frames.take_order().rowsBetween(-3, 0)).alias("held"))


@query(" select user_id, attempt_id, attempt_no from (select *, row_number() over (partition by user_id order by attempt_no desc) as r from attempts_o) where r <= 20", "attempts_o")
def newest_attempts(spark, sf_dir):
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("attempt_no")))
    return view(spark, sf_dir, "attempts_o").withColumn("r", newest).where("r <= 20").select("user_id", "attempt_id", "attempt_no")


@query(""", s as (select *, sum(case when frame_idx - prev > 2 then 1 else 0 end) over (partition by take_id order by frame_idx) as session from (select *, lag(frame_idx) over (partition by take_id order by frame_idx) as prev from frames_ev where clarity >= 0.5)),
        g as (select take_id, session, min(frame_idx) as start_idx, max(frame_idx) as end_idx, count(*) as n from s group by all)
        select take_id, start_idx, end_idx, n from (select *, row_number() over (partition by take_id order by end_idx - start_idx desc, start_idx) as r from g) where r = 1""", "frames_ev")
def longest_stretch(spark, sf_dir):
    kept = frames.sessions(_frames(spark, sf_dir).where("clarity >= 0.5"), "take_id", "frame_idx", 2)
    spans = kept.groupBy("take_id", "session").agg(F.min("frame_idx").alias("start_idx"), F.max("frame_idx").alias("end_idx"), F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct("start_idx", "end_idx", "n"), F.struct(F.col("end_idx") - F.col("start_idx"), -F.col("start_idx"))).alias("b")
    return spans.groupBy("take_id").agg(best).select("take_id", "b.*")


_SPANS = "n as (select take_id, frame_idx as start_t, frame_idx + 3 as end_t from frames_ev where frame_idx % 10 = 0)"


def _spans(own: DataFrame) -> DataFrame:
    return own.where("frame_idx % 10 = 0").select("take_id", F.col("frame_idx").alias("start_t"), (F.col("frame_idx") + 3).alias("end_t"))


@query(f", {_SPANS} select take_id, frame_idx from frames_ev f where not exists (select 1 from n where n.take_id = f.take_id and frame_idx >= start_t and frame_idx < end_t)", "frames_ev")
def frames_outside_notes(spark, sf_dir):
    own = _frames(spark, sf_dir)
    return frames.within(own, _spans(own), "take_id", "frame_idx", "start_t", "end_t", "left_anti").select("take_id", "frame_idx")


@query(f", {_SPANS} select take_id, frame_idx from frames_ev f where exists (select 1 from n where n.take_id = f.take_id and frame_idx >= start_t and frame_idx < end_t)", "frames_ev")
def frames_inside_notes(spark, sf_dir):
    own = _frames(spark, sf_dir)
    return frames.within(own, _spans(own), "take_id", "frame_idx", "start_t", "end_t").select("take_id", "frame_idx")


@query(f""", {_SPANS} select n.take_id, start_t, bool_or(clipped) as clipped, avg(clarity) as clarity, avg(snr_db) as snr, median(band_rms_db) as level,
        round(greatest(0.0, least(1.0, 0.6 * avg(clarity) + 0.4 * greatest(0.0, least(1.0, (avg(snr_db) - 6) / 24)))), 6) + 0.0 as confidence
        from n join frames_ev f on f.take_id = n.take_id and frame_idx >= start_t and frame_idx < end_t group by all""", "frames_ev")
def note_measures(spark, sf_dir):
    own = _frames(spark, sf_dir)
    met = frames.met(own, _spans(own), "take_id", "frame_idx", "start_t", "end_t").withColumn("start_t", F.col("__start"))
    confidence = P.clamp01(0.6 * F.avg("clarity") + 0.4 * P.clamp01((F.avg("snr_db") - 6) / 24))
    return met.groupBy("take_id", "start_t").agg(F.bool_or("clipped").alias("clipped"), F.avg("clarity").alias("clarity"), F.avg("snr_db").alias("snr"), F.median("band_rms_db").alias("level"), P.six(confidence).alias("confidence"))


@query(""" select f.take_id, f.frame_idx, c.level from (select take_id, frame_idx, band_rms_db from frames_ev where frame_idx % 7 <> 0) f
        asof join (select take_id, frame_idx, band_rms_db as level from frames_ev where frame_idx % 7 = 0) c on f.take_id = c.take_id and f.frame_idx >= c.frame_idx""", "frames_ev")
def as_of_level(spark, sf_dir):
    own = _frames(spark, sf_dir)
    changes = own.where("frame_idx % 7 = 0").select("take_id", "frame_idx", F.col("band_rms_db").alias("level"))
    return frames.as_of(own.where("frame_idx % 7 <> 0").select("take_id", "frame_idx"), changes, "take_id", "frame_idx", "level")


@query(""" select take_id, list_sort(list(band_rms_db))[cast(floor(0.2 * (count(*) - 1) + 0.5) as int) + 1] as p20, list_sort(list(band_rms_db))[cast(floor(0.9 * (count(*) - 1) + 0.5) as int) + 1] as p90,
        median(band_rms_db) as mid, quantile_cont(band_rms_db, 0.25) as q25, (quantile_cont(band_rms_db, 0.75) - quantile_cont(band_rms_db, 0.25)) / 2 as wobble from frames_ev group by take_id""", "frames_ev")
def level_quantiles(spark, sf_dir):
    x = F.collect_list("band_rms_db")
    q = F.percentile("band_rms_db", F.array(F.lit(0.25), F.lit(0.75)))
    return _frames(spark, sf_dir).groupBy("take_id").agg(frames.rank_percentile(x, 0.2).alias("p20"), frames.rank_percentile(x, 0.9).alias("p90"), F.median("band_rms_db").alias("mid"), F.get(q, 0).alias("q25"), ((F.get(q, 1) - F.get(q, 0)) / 2).alias("wobble"))


@query(f" select take_id, frame_idx // 10 as bucket, count(*) as n, count(*) filter (where {_TONAL}) as tonal, median(snr_db) as snr from frames_ev group by all", "frames_ev")
def bucket_statistics(spark, sf_dir):
    return _frames(spark, sf_dir).groupBy("take_id", F.expr("cast(frame_idx div 10 as int)").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if("tonal").alias("tonal"), F.median("snr_db").alias("snr"))


@query(""" select seq_id, round(atan2(sum(dur_sec * sin(2 * pi() * cents_offset / 100)), sum(dur_sec * cos(2 * pi() * cents_offset / 100))) / (2 * pi()) * 100, 4) + 0.0 as tuning,
        round(sqrt(pow(sum(dur_sec * sin(2 * pi() * cents_offset / 100)), 2) + pow(sum(dur_sec * cos(2 * pi() * cents_offset / 100)), 2)) / sum(dur_sec), 6) + 0.0 as resultant
        from notes_li group by seq_id having count(*) >= 4 and sqrt(pow(sum(dur_sec * sin(2 * pi() * cents_offset / 100)), 2) + pow(sum(dur_sec * cos(2 * pi() * cents_offset / 100)), 2)) / sum(dur_sec) >= 0.6""", "notes_li")
def circular_tuning(spark, sf_dir):
    angle = 2 * F.pi() * F.col("cents_offset") / 100
    w = F.col("dur_sec")
    sums = view(spark, sf_dir, "notes_li").groupBy("seq_id").agg(F.sum(w * F.sin(angle)).alias("s"), F.sum(w * F.cos(angle)).alias("c"), F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"))
    gated = sums.withColumn("r", F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")) / F.col("w")).where("n >= 4 and r >= 0.6")
    return gated.select("seq_id", (F.round(F.atan2("s", "c") / (2 * F.pi()) * 100, 4) + 0.0).alias("tuning"), P.six(F.col("r")).alias("resultant"))


@query(""" select attempt_id, case when count(*) filter (where w > 0) >= 2 then round(greatest(-60, least(60, sum(w * residual_cents) / nullif(sum(w), 0))), 6) + 0.0 else 0.0 end as offset_cents
        from (select *, greatest(0.0, 1 - abs(residual_cents) / 70) as w from slots_zip where residual_cents is not null) group by attempt_id""", "notes_li", "attempts_o", "slots_zip")
def reference_offset(spark, sf_dir):
    rows = view(spark, sf_dir, "slots_zip").where("residual_cents is not null").withColumn("w", F.greatest(F.lit(0.0), 1 - F.abs("residual_cents") / 70))
    mean = F.try_divide(F.sum(F.col("w") * F.col("residual_cents")), F.sum("w"))
    held = P.six(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), mean)))
    return rows.groupBy("attempt_id").agg(F.when(F.count_if(F.col("w") > 0) >= 2, held).otherwise(F.lit(0.0)).alias("offset_cents"))


@query(" select seq_id, round(avg(log2(dur_sec)), 6) + 0.0 as mean_log2, sum(dur_sec) as total, min(midi) as low, max(midi) as high, arg_max(midi, dur_sec * 1000 - pos) as longest from notes_li group by seq_id", "notes_li")
def note_aggregates(spark, sf_dir):
    return view(spark, sf_dir, "notes_li").groupBy("seq_id").agg(P.six(F.avg(F.log2("dur_sec"))).alias("mean_log2"), F.sum("dur_sec").alias("total"), F.min("midi").alias("low"), F.max("midi").alias("high"), F.max_by("midi", F.struct(F.col("dur_sec"), -F.col("pos"))).alias("longest"))


@query(""" select take_id, round(sum(clarity * pow(0.75, n - i) * (case when i = 1 then 1 else 0.25 end)), 6) + 0.0 as mean from (select *, row_number() over (partition by take_id order by frame_idx) as i, count(*) over (partition by take_id) as n from frames_ev) group by take_id""", "frames_ev")
def ewma_of_clarity(spark, sf_dir):
    return _frames(spark, sf_dir).groupBy("take_id").agg(P.six(frames.ewma("frame_idx", "clarity")).alias("mean"))


@query(""", a as (select user_id, step, attempt_no, count(*) filter (where verdict = 'wrong') / cast(count(*) filter (where verdict <> 'missing') as double) as x, count(*) as n from slots_zip where step is not null group by all having count(*) filter (where verdict <> 'missing') > 0),
        o as (select *, row_number() over (partition by user_id, step order by attempt_no) as i, count(*) over (partition by user_id, step) as k from a)
        select user_id, step, cast(sum(n) as bigint) as observed, round(sum(x * pow(0.75, k - i) * (case when i = 1 then 1 else 0.25 end)), 6) + 0.0 as wrong_rate from o group by user_id, step""", "notes_li", "attempts_o", "slots_zip")
def interval_ledger(spark, sf_dir):
    slots = view(spark, sf_dir, "slots_zip").where("step is not null")
    sung = F.count_if(F.col("verdict") != "missing")
    each = slots.groupBy("user_id", "step", "attempt_no").agg((F.count_if(F.col("verdict") == "wrong") / F.when(sung > 0, sung)).alias("x"), F.count(F.lit(1)).alias("n")).where("x is not null")
    return each.groupBy("user_id", "step").agg(F.sum("n").alias("observed"), P.six(frames.ewma("attempt_no", "x")).alias("wrong_rate"))


@query(""" select target_id, slot, count(*) filter (where verdict = 'clean') as clean, count(*) filter (where verdict = 'off') as "off", count(*) filter (where verdict = 'wrong') as wrong, count(*) filter (where verdict = 'missing') as missing,
        round(least(1.0, (count(*) filter (where verdict = 'wrong') + 0.7 * count(*) filter (where verdict = 'missing') + 0.35 * count(*) filter (where verdict = 'off')) / count(*)), 6) + 0.0 as trouble from slots_zip group by target_id, slot""", "notes_li", "attempts_o", "slots_zip")
def slot_tallies(spark, sf_dir):
    n = {v: F.count_if(F.col("verdict") == v) for v in ("clean", "off", "wrong", "missing")}
    trouble = F.least(F.lit(1.0), (n["wrong"] + 0.7 * n["missing"] + 0.35 * n["off"]) / F.count(F.lit(1)))
    return view(spark, sf_dir, "slots_zip").groupBy("target_id", "slot").agg(*[c.alias(v) for v, c in n.items()], P.six(trouble).alias("trouble"))


@query(""", a as (select seq_id, median(midi) as m from notes_li group by seq_id), c as (select a.seq_id, s.shift, (select count(*) from notes_li n where n.seq_id = a.seq_id and (n.midi + 12 * s.shift < 78 or n.midi + 12 * s.shift > 90)) as outside, abs(m + 12 * s.shift - 84) as far from a, (select unnest(range(-4, 5)) as shift) s)
        select seq_id, cast(shift as int) as shift from (select *, row_number() over (partition by seq_id order by outside, far, abs(shift)) as r from c) where r = 1""", "notes_li")
def octave_into_range(spark, sf_dir):
    notes = view(spark, sf_dir, "notes_li").select("seq_id", "midi")
    own = notes.repartition(frames.task_shares(spark, notes.count()), "seq_id").groupBy("seq_id").agg(F.sort_array(F.collect_list("midi")).alias("ms"))
    n = F.size("ms")
    m = (F.get("ms", F.floor((n - 1) / 2).cast("int")) + F.get("ms", F.floor(n / 2).cast("int"))) / 2
    outside = lambda shift: F.size(F.filter("ms", lambda x: (x + 12 * shift < 78) | (x + 12 * shift > 90)))
    key = lambda shift: F.struct(outside(shift).alias("o"), F.abs(m + 12 * shift - 84).alias("f"), F.lit(abs(shift)).alias("s"), F.lit(shift).alias("shift"))
    return own.select("seq_id", F.array_min(F.array(*[key(shift) for shift in range(-4, 5)])).getField("shift").alias("shift"))


@query(""", n as (select seq_id, string_agg(chr(cast(midi as int)), '' order by pos) as s from notes_li group by seq_id) select a.attempt_id, levenshtein(x.s, y.s) as distance from attempts_o a join n x on x.seq_id = a.target_id join n y on y.seq_id = a.attempt_id""", "notes_li", "attempts_o")
def note_edit_distance(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "midi"))), lambda r: F.char(r["midi"])), "")
    notes = view(spark, sf_dir, "notes_li").groupBy("seq_id").agg(text.alias("s"))
    attempts = view(spark, sf_dir, "attempts_o")
    target = notes.select(F.col("seq_id").alias("target_id"), F.col("s").alias("x"))
    own = notes.select(F.col("seq_id").alias("attempt_id"), F.col("s").alias("y"))
    return attempts.join(target, "target_id").join(own, "attempt_id").select("attempt_id", F.levenshtein("x", "y").cast("long").alias("distance"))


@query(""", n as (select seq_id, list(midi + cents_offset / 100 order by pos) as p from notes_li group by seq_id),
        j as (select a.attempt_id, x.p as t, y.p as s from attempts_o a join n x on x.seq_id = a.target_id join n y on y.seq_id = a.attempt_id)
        select attempt_id, round(list_reduce(list_transform(t, lambda v: [v]), lambda above, v: list_reduce(list_transform(range(len(s)), lambda j: [cast(j as double)]), lambda done, j: list_append(done,
            least(above[cast(j[1] as int) + 1] + least(1.5, greatest(0.0, (abs(v[1] - s[cast(j[1] as int) + 1]) - 0.3) / 1.7 * 1.5)), above[cast(j[1] as int) + 2] + 1.0, done[-1] + 1.0)), [above[1] + 1.0]),
            list_transform(range(len(s) + 1), lambda i: cast(i as double)))[-1], 6) + 0.0 as cost from j""", "notes_li", "attempts_o")
def alignment_costs(spark, sf_dir):
    pitches = F.transform(F.array_sort(F.collect_list(F.struct("pos", "midi", "cents_offset"))), lambda r: r["midi"] + r["cents_offset"] / 100)
    notes = view(spark, sf_dir, "notes_li").groupBy("seq_id").agg(pitches.alias("p"))
    target = notes.select(F.col("seq_id").alias("target_id"), F.col("p").alias("x"))
    own = notes.select(F.col("seq_id").alias("attempt_id"), F.col("p").alias("y"))
    return view(spark, sf_dir, "attempts_o").join(target, "target_id").join(own, "attempt_id").select("attempt_id", P.six(align.alignment_cost(F.col("x"), F.col("y"))).alias("cost"))


@query(""" select seq_id, pos, round(coalesce(sum(dur_sec + 0.08) over (partition by seq_id order by pos rows between unbounded preceding and 1 preceding), 0), 6) + 0.0 as start_sec, dur_sec from notes_li""", "notes_li")
def playback_layout(spark, sf_dir):
    before = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return view(spark, sf_dir, "notes_li").select("seq_id", "pos", P.six(F.coalesce(F.sum(F.col("dur_sec") + 0.08).over(before), F.lit(0.0))).alias("start_sec"), "dur_sec")


@query(""" select vec_id as take_id, cast(k as int) as bin, round(pow(sum(x * cos(2 * pi() * k * i / 64)), 2) + pow(sum(x * sin(2 * pi() * k * i / 64)), 2), 4) + 0.0 as power
        from (select vec_id, cast(unnest(embedding) as double) as x, unnest(range(64)) as i from embeddings), (select unnest(range(33)) as k) group by all""")
def power_spectra(spark, sf_dir):
    blocks = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("take_id"), F.col("embedding").alias("samples"))
    return spectrum.power_spectrum(blocks).select("take_id", "bin", (F.round("power", 4) + 0.0).alias("power"))


@query(" select vec_id as take_id, cast(k as int) as frame_idx, round(list_sum(list_transform(embedding[k * 8 + 1 : k * 8 + 32], lambda x: cast(x as double))), 4) + 0.0 as total from embeddings, (select unnest(range(5)) as k)")
def overlapping_frames(spark, sf_dir):
    blocks = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("take_id"), F.col("embedding").alias("samples"))
    total = F.aggregate("samples", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return spectrum.framed(blocks, 32, 8).select("take_id", F.col("frame_idx").cast("int").alias("frame_idx"), (F.round(total, 4) + 0.0).alias("total"))


@query(f""" select case when c.strict then 'strict' else 'loose' end as config, take_id, count(*) as n from frames_ev, (values (true, 0.5), (false, 0.25)) c(strict, least) where clarity >= c.least group by all""", "frames_ev")
def parameter_sweep(spark, sf_dir):
    configs = F.explode(F.array(F.struct(F.lit("strict").alias("config"), F.lit(0.5).alias("least")), F.struct(F.lit("loose").alias("config"), F.lit(0.25).alias("least"))))
    return _frames(spark, sf_dir).select("take_id", "clarity", configs.alias("c")).where("clarity >= c.least").groupBy(F.col("c.config").alias("config"), "take_id").agg(F.count(F.lit(1)).alias("n"))
