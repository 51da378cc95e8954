"""Queries over aligned attempts, melodies and their texts, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pitch as P
from ..functions import words as W
from ..operators import frames, melody, practice
from .queries import _frames, _midi, query
from .views import in_shares, view

_SLOTS = ("aligned_o", "extras_o")


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "aligned_o")


def _extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "extras_o")


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return practice.overlay(_slots(spark, sf_dir), _extras(spark, sf_dir))


def _nine(c: str):
    return F.round(c, 6) + F.lit(0.0)


# the ledger: an attempt's slots together first, then one step of each mean
_EACH = """e as (select user_id, step, attempt_no, count(*) filter (where verdict = 'clean') as clean, count(*) filter (where verdict = 'off') as "off",
            count(*) filter (where verdict = 'wrong') as wrong, count(*) filter (where verdict = 'missing') as missing, sum(abs(residual_cents)) filter (where verdict in ('clean', 'off')) as cents
            from (select *, target_midi - lag(target_midi) over (partition by attempt_id order by slot) as step from aligned_o) where step is not null group by all),
        r as (select user_id, step, attempt_no, wrong / cast(clean + "off" + wrong as double) as x from e where clean + "off" + wrong > 0),
        c as (select user_id, step, attempt_no, cents / (clean + "off") as x from e where clean + "off" > 0),
        rm as (select user_id, step, sum(x * pow(0.75, k - i) * (case when i = 1 then 1 else 0.25 end)) as m from (select *, row_number() over w as i, count(*) over (partition by user_id, step) as k from r window w as (partition by user_id, step order by attempt_no)) group by all),
        cm as (select user_id, step, sum(x * pow(0.75, k - i) * (case when i = 1 then 1 else 0.25 end)) as m from (select *, row_number() over w as i, count(*) over (partition by user_id, step) as k from c window w as (partition by user_id, step order by attempt_no)) group by all),
        ledger as (select e.user_id, e.step, cast(sum(clean) as bigint) as clean, cast(sum("off") as bigint) as "off", cast(sum(wrong) as bigint) as wrong, cast(sum(missing) as bigint) as missing,
            coalesce(any_value(rm.m), 0.0) as wrong_rate, coalesce(any_value(cm.m), 0.0) as abs_cents, cast(sum(clean + "off" + wrong) as bigint) as observations, cast(sum(clean + "off") as bigint) as cents_observations
            from e left join rm using (user_id, step) left join cm using (user_id, step) group by all),
        weak as (select *, wrong_rate + 0.5 * (case when cents_observations > 0 then least(1.0, abs_cents / 70) else 0.0 end) as weakness from ledger)"""


@query(f', {_EACH} select user_id, step, clean, "off", wrong, missing, observations, cents_observations, round(wrong_rate, 6) + 0.0 as wrong_rate, round(abs_cents, 6) + 0.0 as abs_cents from ledger', "aligned_o")
def practice_ledger(spark, sf_dir):
    ledger = practice.interval_ledger(_slots(spark, sf_dir))
    return ledger.select("user_id", "step", *practice.VERDICTS, "observations", "cents_observations", _nine("wrong_rate").alias("wrong_rate"), _nine("abs_cents").alias("abs_cents"))


@query(f', {_EACH} select user_id, step, clean, "off", wrong, missing, observations, cents_observations, round(wrong_rate, 6) + 0.0 as wrong_rate, round(abs_cents, 6) + 0.0 as abs_cents from ledger where user_id % 6 <> 0', "aligned_o")
def stats_round_trip(spark, sf_dir):
    """The ledgers as documents and back; those of another version are not read."""
    documents = practice.stats_documents(practice.interval_ledger(_slots(spark, sf_dir)), F.when(F.col("user_id") % 6 == 0, 2).otherwise(1))
    back = practice.read_stats(documents)
    return back.select("user_id", "step", *practice.VERDICTS, "observations", "cents_observations", _nine("wrong_rate").alias("wrong_rate"), _nine("abs_cents").alias("abs_cents"))


@query(f", {_EACH} select user_id, step, round(weakness, 6) + 0.0 as weakness, rank from (select *, row_number() over (partition by user_id order by round(weakness, 9) desc, observations desc, step) as rank from weak where observations >= 3) where rank <= 5", "aligned_o")
def weakest_intervals(spark, sf_dir):
    return practice.weakest(practice.interval_ledger(_slots(spark, sf_dir)), 3, 5).select("user_id", "step", _nine("weakness").alias("weakness"), F.col("rank").cast("long").alias("rank"))


_WEIGHTS = f"""{_EACH}, wt as (select u.user_id, s.step, (case when abs(s.step) <= 4 then 1.0 when abs(s.step) <= 7 then 0.4 else 0.15 end) * (1 + 3.0 / greatest(0.3, (13 - abs(s.step)) / 13.0::double) * coalesce(weakness, 0.0)) as weight
            from (select distinct user_id from attempts_o) u, (select unnest(range(-12, 13)) as step) s left join (select * from weak where observations >= 5) k on k.user_id = u.user_id and k.step = s.step where s.step <> 0)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = view(spark, sf_dir, "attempts_o").select("user_id").distinct()
    return practice.step_weights(users, practice.interval_ledger(_slots(spark, sf_dir)))


@query(f", {_WEIGHTS} select user_id, cast(step as int) as step, round(weight, 6) + 0.0 as weight from wt", "aligned_o", "attempts_o")
def step_weights(spark, sf_dir):
    return _weights(spark, sf_dir).select("user_id", "step", _nine("weight").alias("weight"))


@query(f""", {_WEIGHTS} select user_id, cast(coalesce(min(step) filter (where run > draw * total), max(step)) as int) as step
        from (select *, (user_id * 911 % 4096) / 4096.0::double as draw, sum(weight) over (partition by user_id order by step) as run, sum(weight) over (partition by user_id) as total from wt) group by user_id""", "aligned_o", "attempts_o")
def picked_step(spark, sf_dir):
    return practice.weighted_pick(_weights(spark, sf_dir), "user_id", "step", "weight", F.col("user_id") * 911 % 4096 / F.lit(4096.0))


# a target that changes its length: the fifth attempt on, each target is a note shorter
_SHORT = """v as (select * from (select *, max(slot) over (partition by attempt_id) as top from aligned_o) where attempt_no < 4 or slot < top or top = 0),
        l as (select target_id, attempt_id, attempt_no, count(*) as n from v group by all),
        s as (select *, sum(changed) over (partition by target_id order by attempt_no) as session from (select *, case when n <> lag(n) over (partition by target_id order by attempt_no) then 1 else 0 end as changed from l)),
        live as (select target_id, attempt_id, attempt_no from (select *, max(session) over (partition by target_id) as latest from s) where session = latest),
        t as (select v.target_id, v.slot, count(*) as attempts, count(*) filter (where verdict = 'clean') as clean, count(*) filter (where verdict = 'off') as "off", count(*) filter (where verdict = 'wrong') as wrong,
            count(*) filter (where verdict = 'missing') as missing from v join live using (attempt_id) group by all),
        u as (select *, wrong + missing as bad, least(1.0, (wrong + 0.7 * missing + 0.35 * "off") / cast(attempts as double)) as trouble from t)"""


def _shorter(slots: DataFrame) -> DataFrame:
    top = F.max("slot").over(Window.partitionBy("attempt_id"))
    return slots.withColumn("top", top).where("attempt_no < 4 or slot < top or top = 0")


def _shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shorter(_slots(spark, sf_dir))


@query(f', {_SHORT} select target_id, slot, attempts, clean, "off", wrong, missing, round(trouble, 6) + 0.0 as trouble from u', "aligned_o")
def target_tallies(spark, sf_dir):
    return practice.target_tallies(_shortened(spark, sf_dir)).select("target_id", "slot", "attempts", *practice.VERDICTS, _nine("trouble").alias("trouble"))


@query(f", {_SHORT} select target_id, slot, bad, row_number() over (partition by target_id order by round(trouble, 9) desc, bad desc, slot) as rank from u where attempts >= 2 and bad >= 2", "aligned_o")
def trouble_spots(spark, sf_dir):
    return practice.trouble_spots(practice.target_tallies(_shortened(spark, sf_dir))).select("target_id", "slot", "bad", F.col("rank").cast("long").alias("rank"))


_HISTORY = f"""{_SHORT}, h as (select v.target_id, v.attempt_no, string_agg(case when verdict = 'missing' then '-' else left(verdict, 1) end, '' order by slot) as verdicts from v join live using (attempt_id) group by all),
        aged as (select *, row_number() over (partition by target_id order by attempt_no desc) as age from h)"""


@query(f", {_HISTORY} select target_id, attempt_no, verdicts, age from aged where age <= 20", "aligned_o")
def attempt_history(spark, sf_dir):
    return practice.attempt_history(_shortened(spark, sf_dir)).select("target_id", "attempt_no", "verdicts", F.col("age").cast("long").alias("age"))


@query(f", {_HISTORY} select target_id, cast(sum(length(verdicts) - length(replace(verdicts, 'c', ''))) as bigint) as clean, cast(sum(length(verdicts)) as bigint) as slots from aged where age <= 6 group by target_id", "aligned_o")
def recent_history(spark, sf_dir):
    rows = practice.attempt_history(_shortened(spark, sf_dir), keep=6)
    return rows.groupBy("target_id").agg(F.sum(F.length("verdicts") - F.length(F.replace("verdicts", F.lit("c"), F.lit("")))).alias("clean"), F.sum(F.length("verdicts")).cast("long").alias("slots"))


_COUNTS = """k as (select user_id, attempt_id, attempt_no, target_id, count(*) filter (where verdict = 'clean') as clean, count(*) filter (where verdict = 'off') as "off", count(*) filter (where verdict = 'wrong') as wrong,
            count(*) filter (where verdict = 'missing') as missing from aligned_o group by all), x as (select attempt_id, count(*) as extra from extras_o group by all),
        n as (select k.*, coalesce(extra, 0) as extra from k left join x using (attempt_id))"""


@query(f""", {_COUNTS} select attempt_id, clean, "off", wrong, missing, extra, clean || ' of ' || (clean + "off" + wrong + missing) || ' note' || (case when clean + "off" + wrong + missing = 1 then '' else 's' end) || ' clean'
        || (case when "off" > 0 then ' · ' || "off" || ' a little off' else '' end) || (case when wrong > 0 then ' · ' || wrong || ' wrong' else '' end)
        || (case when missing > 0 then ' · ' || missing || ' missed' else '' end) || (case when extra > 0 then ' · ' || extra || ' extra' else '' end) as score from n""", *_SLOTS)
def attempt_scores(spark, sf_dir):
    counts = practice.counted(_slots(spark, sf_dir), _extras(spark, sf_dir))
    outcome = [*practice.VERDICTS, "extra"]
    return counts.select("attempt_id", *outcome, W.score(*[F.col(c) for c in outcome]).alias("score"))


@query(f""", {_COUNTS} select attempt_id, clean + "off" > 0 and wrong + missing + extra = 0 as got from n""", *_SLOTS)
def echo_success(spark, sf_dir):
    counts = practice.counted(_slots(spark, sf_dir), _extras(spark, sf_dir))
    return counts.select("attempt_id", ((F.col("clean") + F.col("off") > 0) & (F.col("wrong") + F.col("missing") + F.col("extra") == 0)).alias("got"))


@query(f""", {_COUNTS}, q as (select user_id, list(clean + "off" > 0 and wrong + missing + extra = 0 order by attempt_no) as got from n group by user_id)
        select user_id, list_reduce(list_prepend(3, list_transform(got, lambda g: case when g then 1 else -1 end)), lambda a, d: greatest(3, least(6, a + d))) as length from q""", *_SLOTS)
def echo_lengths(spark, sf_dir):
    return practice.echo_lengths(practice.counted(_slots(spark, sf_dir), _extras(spark, sf_dir)))


@query(""", h as (select take_id as user_id, frame_idx as place, clarity * 200 - 100 as median, snr_db - 10 as wobble, peak_to_second_db * 2 as drift from frames_ev),
        k as (select *, row_number() over (partition by user_id order by place) as i, count(*) over (partition by user_id) as n from h where not (abs(drift) >= 25 and abs(drift) > wobble))
        select user_id, count(*) as count, round(sum(median * pow(0.75, n - i) * (case when i = 1 then 1 else 0.25 end)), 6) + 0.0 as "offset", round(sum(greatest(0.0, wobble) * pow(0.75, n - i) * (case when i = 1 then 1 else 0.25 end)), 6) + 0.0 as wobble from k group by user_id""", "frames_ev")
def hold_averages(spark, sf_dir):
    holds = _frames(spark, sf_dir).select(F.col("take_id").alias("user_id"), F.col("frame_idx").alias("at"), (F.col("clarity") * 200 - 100).alias("median"), (F.col("snr_db") - 10).alias("wobble"), (F.col("peak_to_second_db") * 2).alias("drift"))
    return practice.hold_averages(holds).select("user_id", "count", _nine("offset").alias("offset"), _nine("wobble").alias("wobble"))


@query(f""" select take_id, frame_idx, case when abs(drift) >= 25 and abs(drift) > wobble then 'That one slid ' || (case when drift < 100 then cast(floor(drift + 0.5) as bigint) || ' cents sharp' end) || ' while you held it — aim for one pitch and keep the air behind it.'
        when wobble >= 25 then '{W.WANDERED}' when abs(median) >= 70 then '{W.AWAY}' when abs(median) >= 10 then '{W.CLOSE}' else '{W.RIGHT}' end as advice
        from (select take_id, frame_idx, clarity * 200 - 100 as median, snr_db - 10 as wobble, peak_to_second_db * 2 as drift from frames_ev)""", "frames_ev")
def hold_advice(spark, sf_dir):
    return _frames(spark, sf_dir).select("take_id", "frame_idx", W.hold_advice(F.col("clarity") * 200 - 100, F.col("snr_db") - 10, F.col("peak_to_second_db") * 2).alias("advice"))


_DISTANCE = """case when abs({0}) < 100 then cast(floor(abs({0}) + 0.5) as bigint) || ' cents ' || (case when {0} > 0 then 'sharp' else 'flat' end)
        when abs(abs({0}) / 100 - floor(abs({0}) / 100 + 0.5)) < 0.2 then case when floor(abs({0}) / 100 + 0.5) = 12 then 'an octave ' || (case when {0} > 0 then 'high' else 'low' end)
            else (case when floor(abs({0}) / 100 + 0.5) = 1 then 'a semitone ' else cast(floor(abs({0}) / 100 + 0.5) as bigint) || ' semitones ' end) || (case when {0} > 0 then 'sharp' else 'flat' end) end
        else cast(floor(abs({0}) + 0.5) as bigint) || ' cents ' || (case when {0} > 0 then 'sharp' else 'flat' end) end"""
_ORDINAL = """({0}) || (case when ({0}) % 100 between 11 and 13 then 'th' when ({0}) % 10 = 1 then 'st' when ({0}) % 10 = 2 then 'nd' when ({0}) % 10 = 3 then 'rd' else 'th' end)"""
_INTERVAL = """(case when abs({0}) = 0 then 'the same note' when abs({0}) < 12 then (['a semitone','a whole tone','a minor 3rd','a major 3rd','a 4th','a tritone','a 5th','a minor 6th','a major 6th','a minor 7th','a major 7th'])[abs({0})]
        else (case when abs({0}) // 12 = 1 then 'an octave' else (abs({0}) // 12) || ' octaves' end) || (case when abs({0}) % 12 = 0 then '' else ' and ' || (['a semitone','a whole tone','a minor 3rd','a major 3rd','a 4th','a tritone','a 5th','a minor 6th','a major 6th','a minor 7th','a major 7th'])[abs({0}) % 12] end) end)"""


@query(f""" select attempt_id, slot, {_ORDINAL.format("slot + 1")} as place, {_INTERVAL.format("sung_midi - target_midi")} as apart, {_DISTANCE.format("residual_cents")} as distance,
        (case when floor(residual_cents + 0.5) > 0 then '+' else '' end) || cast(floor(residual_cents + 0.5) as bigint) as cents,
        case when sung_midi = target_midi then 'You whistled it in the register it played in.' else 'You whistled it ' || {_INTERVAL.format("sung_midi - target_midi")} || (case when sung_midi > target_midi then ' below' else ' above' end) || ' what played — which is fine, the shape is what counts.' end as register
        from aligned_o where sung_midi is not null""", "aligned_o")
def slot_words(spark, sf_dir):
    apart, cents = F.col("sung_midi") - F.col("target_midi"), F.col("residual_cents")
    rows = _slots(spark, sf_dir).where("sung_midi is not null")
    return rows.select("attempt_id", "slot", W.ordinal(F.col("slot") + 1).alias("place"), W.interval(apart).alias("apart"), W.distance(cents).alias("distance"), W.signed_cents(cents).alias("cents"), W.register(apart, F.lit(False)).alias("register"))


@query(f""", f as (select attempt_id, min(slot) filter (where verdict = 'wrong') as w, min(slot) filter (where verdict = 'missing') as m, arg_max(slot, abs(residual_cents) * 100000 - slot) filter (where verdict = 'off') as o from aligned_o group by attempt_id),
        x as (select attempt_id, count(*) as extra from extras_o group by all),
        j as (select f.*, extra, (select residual_cents from aligned_o s where s.attempt_id = f.attempt_id and s.slot = f.w) as wc, (select residual_cents from aligned_o s where s.attempt_id = f.attempt_id and s.slot = f.o) as oc from f left join x using (attempt_id))
        select attempt_id, case when abs(abs(wc) - 1200) <= 50 then '{W.SLIPPED}' when w is not null then 'The ' || {_ORDINAL.format("w + 1")} || ' note came out ' || {_DISTANCE.format("wc")} || '.'
            when m is not null then 'The ' || {_ORDINAL.format("m + 1")} || ' note never arrived.' when o is not null then 'The ' || {_ORDINAL.format("o + 1")} || ' note came out ' || {_DISTANCE.format("oc")} || '.'
            when extra = 1 then 'There was one note in there the melody does not have.' when extra > 1 then 'There were ' || extra || ' notes in there the melody does not have.' else '{W.LANDED}' end as takeaway from j""", *_SLOTS)
def takeaways(spark, sf_dir):
    return practice.takeaways(_slots(spark, sf_dir), _extras(spark, sf_dir))


@query(" select attempt_id, coalesce(bool_or(verdict in ('clean', 'off')) and bool_or(verdict = 'wrong' and abs(abs(residual_cents) - 1200) <= 50), false) as slipped from aligned_o group by attempt_id", "aligned_o")
def register_slips(spark, sf_dir):
    return _slots(spark, sf_dir).groupBy("attempt_id").agg(practice.register_slipped().alias("slipped"))


_ITEMS = """i as (select *, row_number() over (partition by attempt_id order by place, late, attempt_idx) - 1 as index from (
            select attempt_id, slot as place, 0 as late, slot, attempt_idx, verdict as outcome, target_midi, sung_midi + cents_offset / 100 as heard_midi, residual_cents, start_sec, end_sec from aligned_o
            union all select attempt_id, after_slot, 1, null, attempt_idx, 'extra', null, sung_midi + cents_offset / 100, null, start_sec, end_sec from extras_o)),
        b as (select *, coalesce(last_value(end_sec ignore nulls) over (partition by attempt_id order by index rows between unbounded preceding and 1 preceding), 0.0) as before,
                max(start_sec) over (partition by attempt_id order by index rows between unbounded preceding and 1 preceding) is null as ahead,
                first_value(start_sec ignore nulls) over (partition by attempt_id order by index rows between 1 following and unbounded following) as nxt,
                count(start_sec) over (partition by attempt_id order by index) as island,
                coalesce(max(end_sec) over (partition by attempt_id), 0.0) as take_end, greatest(0.001, 0.5 * coalesce(median(end_sec - start_sec) over (partition by attempt_id), 0.2)) as slice from i),
        m as (select *, row_number() over (partition by attempt_id, island order by index) - 1 as k, count(*) over (partition by attempt_id, island) as c from b where start_sec is null),
        w as (select *, coalesce(nxt, take_end + c * slice) as after, c * slice as need from m),
        z as (select attempt_id, index, case when after - before >= need then before when ahead then after - need else greatest(0.0, (before + after) / 2 - need / 2) end as start, greatest(after - before, need) as width, k, c from w)"""


@query(f""", {_ITEMS} select i.attempt_id, i.index, i.slot, i.outcome, round(coalesce(start + width * k / c, start_sec), 6) + 0.0 as start_sec, round(coalesce(start + width * (k + 1) / c, end_sec), 6) + 0.0 as end_sec
        from i left join z on z.attempt_id = i.attempt_id and z.index = i.index""", *_SLOTS)
def overlay_items(spark, sf_dir):
    def made():
        items = _overlay(spark, sf_dir)
        return items.select("attempt_id", F.col("index").cast("long").alias("index"), "slot", "outcome", _nine("start_sec").alias("start_sec"), _nine("end_sec").alias("end_sec"))

    return in_shares(made, spark, sf_dir, "overlay")


@query(f", {_ITEMS} select attempt_id, index, outcome, slot + 1 as position, residual_cents as cents, case when outcome in ('wrong', 'extra') then cast(floor(heard_midi + 0.5) as int) end as name_midi from i", *_SLOTS)
def verdict_chips(spark, sf_dir):
    return in_shares(lambda: practice.chips(_overlay(spark, sf_dir)).withColumn("index", F.col("index").cast("long")), spark, sf_dir, "chips")


@query(""", e as (select attempt_id, min(p) as low, max(p) as high from (select attempt_id, cast(target_midi as double) as p from aligned_o union all select attempt_id, sung_midi + cents_offset / 100 from aligned_o where sung_midi is not null) group by all),
        r as (select attempt_id, floor(low) - 2 as low, ceil(high) + 2 as high from e)
        select attempt_id, cast(low - floor(greatest(0, 12 - (high - low)) / 2) as int) as low, cast(high + ceil(greatest(0, 12 - (high - low)) / 2) as int) as high from r""", "aligned_o")
def padded_ranges(spark, sf_dir):
    heard = F.col("sung_midi") + F.col("cents_offset") / 100
    ends = _slots(spark, sf_dir).groupBy("attempt_id").agg(F.min(F.least(F.col("target_midi").cast("double"), heard)).alias("a"), F.max(F.greatest(F.col("target_midi").cast("double"), heard)).alias("b"))
    low, high = practice.padded_range(F.col("a"), F.col("b"))
    return ends.select("attempt_id", low.alias("low"), high.alias("high"))


@query(""" select seq_id, pos, 7 * (cast(floor(midi / 12) as int) - 1) + ([0,0,1,1,2,3,3,4,4,5,5,6])[midi % 12 + 1] as step, midi % 12 in (1, 3, 6, 8, 10) as sharp,
        array_to_string(case when st - 30 <= -2 then range(-2, st - 31, -2) when st - 30 >= 10 then range(10, st - 29, 2) else [] end, ',') as ledgers, midi - 12 as lower
        from (select *, 7 * (cast(floor(midi / 12) as int) - 1) + ([0,0,1,1,2,3,3,4,4,5,5,6])[midi % 12 + 1] as st from notes_li)""", "notes_li")
def staff_positions(spark, sf_dir):
    m = F.col("midi")
    return view(spark, sf_dir, "notes_li").select("seq_id", "pos", W.staff_step(m).alias("step"), W.is_sharp(m).alias("sharp"), F.array_join(W.ledger_offsets(m).cast("array<string>"), ",").alias("ledgers"), W.transposed(m, F.lit(-1)).alias("lower"))


@query(""", m as (select seq_id, median(7 * (cast(floor(midi / 12) as int) - 1) + ([0,0,1,1,2,3,3,4,4,5,5,6])[midi % 12 + 1]) as m from notes_li group by seq_id)
        select seq_id, cast(arg_min(s, abs(m + 7 * s - 34) * 10 + abs(s)) as int) as shift from m, (values (0), (-1), (-2)) t(s) group by seq_id""", "notes_li")
def display_octaves(spark, sf_dir):
    return melody.display_octave(view(spark, sf_dir, "notes_li"))


@query(""", g as (select *, greatest(0.0, coalesce(start_sec - lag(end_sec) over (partition by seq_id order by pos), 0.0)) as gap from notes_timed),
        s as (select *, case when gap > 1 then 0.5 else gap end as wait, greatest(0.09, dur_sec) as sound from g)
        select seq_id, pos, midi + 12 as midi, round(sum(wait + sound) over (partition by seq_id order by pos) - sound, 6) + 0.0 as start_sec, sound as duration_sec from s""", "notes_timed")
def playback_schedule(spark, sf_dir):
    rows = melody.schedule(view(spark, sf_dir, "notes_timed"), 1)
    return rows.withColumn("start_sec", _nine("start_sec"))


@query(f""", g as (select *, coalesce(start_sec - lag(end_sec) over (partition by seq_id order by pos) > 0.18, false) as rest from notes_timed)
        select seq_id, string_agg((case when rest then '/ ' else '' end) || (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[midi % 12 + 1] || (cast(floor(midi / 12) as int) - 1), ' ' order by pos) as text from g group by seq_id""", "notes_timed")
def sequence_texts(spark, sf_dir):
    return melody.sequence_text(view(spark, sf_dir, "notes_timed"))


@query(" select seq_id, pos, start_sec - prev > 0.18 as rest from (select *, lag(end_sec) over (partition by seq_id order by pos) as prev from notes_timed) where pos > 0", "notes_timed")
def rests(spark, sf_dir):
    return melody.with_gaps(view(spark, sf_dir, "notes_timed")).where("pos > 0").select("seq_id", "pos", melody.rest_before(F.col("gap")).alias("rest"))


@query(""" select seq_id, pos, case when shift = 0 then midi else cast(floor(p + 0.5) as int) end as midi, round(case when shift = 0 then cents_offset else (p - floor(p + 0.5)) * 100 end, 4) + 0.0 as cents
        from (select *, midi + cents_offset / 100 + shift / 100.0::double as p from (select *, (seq_id * 2 + 1) % 41 - 20 as shift from notes_li))""", "notes_li")
def tuning_undone(spark, sf_dir):
    offset = (F.col("seq_id") * 2 + 1) % 41 - 20
    return melody.undo_tuning(view(spark, sf_dir, "notes_li"), offset).select("seq_id", "pos", "midi", (F.round("cents_offset", 4) + 0.0).alias("cents"))


@query(""", r as (select seq_id, min(midi) as low, max(midi) as high from notes_li group by seq_id), d as (select *, (low + high) / 2.0::double as c, greatest(12, least(24, high - low)) as s from r)
        select seq_id, case when high > low then cast(floor(c - s / 2.0 + 0.5) as int) else 78 end as low, case when high > low then cast(floor(c + s / 2.0 + 0.5) as int) else 90 end as high from d""", "notes_li")
def drill_ranges(spark, sf_dir):
    ends = view(spark, sf_dir, "notes_li").groupBy("seq_id").agg(F.min("midi").alias("a"), F.max("midi").alias("b"))
    low, high = melody.drill_range(F.col("a"), F.col("b"))
    return ends.select("seq_id", low.alias("low"), high.alias("high"))


@query(""" select seq_id, pos, cast(floor(pos / 3) as int) as row, 34 + pos % 3 * 30 + 15.0::double as x from notes_li""", "notes_li")
def staff_layout(spark, sf_dir):
    row, x = melody.staff_places(F.col("pos"), 140)
    return view(spark, sf_dir, "notes_li").select("seq_id", "pos", row.alias("row"), x.alias("x"))


@query(""", n as (select seq_id, count(*) as size from notes_li group by seq_id), d as (select seq_id, size, cast(seq_id % 3 as bigint) as a, greatest(size - seq_id % 2, 1) as b, seq_id % 9 - 1 as place, seq_id % 7 - 3 as octave, seq_id % 5 - 2 as d from n)
        select seq_id, case when place < 0 or place >= size then a when place <= (a + b - 1) / 2.0 then place else least(a, place) end as keep_from, case when place < 0 or place >= size then b when place <= (a + b - 1) / 2.0 then greatest(b, place + 1) else place + 1 end as keep_to,
            greatest(-3, least(3, octave + d)) as octave from d""", "notes_li")
def draft_edits(spark, sf_dir):
    n = view(spark, sf_dir, "notes_li").groupBy("seq_id").agg(F.count(F.lit(1)).alias("size"))
    seq = F.col("seq_id")
    first, last = melody.trimmed_to(seq % 3, F.greatest(F.col("size") - seq % 2, F.lit(1)), seq % 9 - 1, F.col("size"))
    return n.select("seq_id", first.alias("keep_from"), last.alias("keep_to"), melody.shifted(seq % 7 - 3, seq % 5 - 2).alias("octave"))


_CHORDS = """p as (select * from (select *, bool_or(channel <> 9) over (partition by file) as other from midi_li) where channel <> 9 or not other),
        a as (select file, track_idx, track_name, channel, list_reduce(list_transform(list(start_sec order by start_sec), lambda s: [s]), lambda g, s: case when s[1] - g[-1] <= 0.03 then g else list_concat(g, s) end) as onsets from p group by all),
        o as (select file, track_idx, track_name, channel, unnest(onsets) as onset, unnest(range(len(onsets))) as k from a),
        q as (select o.*, coalesce(lead(onset) over (partition by file, track_idx, channel order by k), 1e9) as nxt from o),
        g as (select q.file, q.track_idx, q.track_name, q.channel, k, onset, nxt, count(*) as size, max(p.midi) as midi, arg_min(p.end_sec, -p.midi * 1000000 + p.start_sec * 1000 + p.end_sec / 1000) as fin
            from q join p on p.file = q.file and p.track_idx = q.track_idx and p.channel = q.channel and p.start_sec >= onset and p.start_sec < nxt group by all),
        t as (select file, track_idx, track_name, channel, k, midi, size, greatest(0.05, least(fin, nxt) - onset) as dur from g),
        c as (select file, track_idx, track_name, channel, count(*) as n, count(*) filter (where size > 1) as chords from t group by all)"""


@query(f""", {_CHORDS}, v as (select *, count(*) over (partition by file, track_idx) as voices, row_number() over (partition by file, track_idx order by channel) as voice from c),
        d as (select file, track_idx, channel, sum(dur) as total from t where k < 64 group by all)
        select file, track_idx, channel, (case when track_name <> '' then track_name else 'Part ' || (track_idx + 1) end) || (case when voices > 1 then ' (voice ' || voice || ')' else '' end) as name, cast(least(64, n) as int) as n_notes, n > 64 as truncated,
            round(total, 6) + 0.0 as duration_sec, round(chords / cast(n as double), 6) + 0.0 as chord_fraction,
            case when chords / cast(n as double) >= 0.05 then 'More than one note at a time in ' || cast(floor(chords / cast(n as double) * 100 + 0.5) as bigint) || '% of this part — the app kept the highest each time.' end as warning
        from v join d using (file, track_idx, channel)""", "midi_li")
def midi_melodies(spark, sf_dir):
    made = melody.melodies(view(spark, sf_dir, "midi_li"))
    return made.select("file", "track_idx", "channel", "name", "n_notes", "truncated", _nine("duration_sec").alias("duration_sec"), _nine("chord_fraction").alias("chord_fraction"), W.chord_warning(F.col("chord_fraction")).alias("warning"))


@query(f", {_CHORDS} select file, track_idx, channel, cast(k as int) as pos, midi, round(dur, 6) + 0.0 as dur_sec from t", "midi_li")
def chord_tops(spark, sf_dir):
    voices = melody.collapse_chords(melody.pitched(view(spark, sf_dir, "midi_li")))
    return voices.select("file", "track_idx", "channel", F.posexplode("notes").alias("pos", "n")).select("file", "track_idx", "channel", "pos", F.col("n.midi").alias("midi"), (F.round("n.dur_sec", 6) + 0.0).alias("dur_sec"))


@query(""" select seq_id, case when total < 60 then printf('%.1f s', floor(total * 10 + 0.5) / 10) else cast(floor(total / 60) as bigint) || ':' || lpad(cast(cast(floor(total) as bigint) % 60 as varchar), 2, '0') end as duration,
        cast(floor(total / 60) as bigint) || ':' || lpad(cast(cast(floor(total) as bigint) % 60 as varchar), 2, '0') as clock from (select seq_id, sum(end_sec - start_sec) * 9 as total from notes_timed group by seq_id)""", "notes_timed")
def duration_texts(spark, sf_dir):
    total = view(spark, sf_dir, "notes_timed").groupBy("seq_id").agg((F.sum(F.col("end_sec") - F.col("start_sec")) * 9).alias("t"))
    return total.select("seq_id", W.duration(F.col("t")).alias("duration"), W.clock(F.col("t")).alias("clock"))


@query(""" select item_id, case when left(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 60) = '' then 'Untitled' else left(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 60) end as name from benchmark""")
def clean_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", W.clean_name(F.col("text"), "Untitled").alias("name"))


@query(""" select take_id, frame_idx, greatest(-1.0, least(1.0, c / 100)) * 50 as needle, case when hz is null then '—' when c >= 200 then '↑' when c <= -200 then '↓' else (case when floor(c + 0.5) > 0 then '+' else '' end) || cast(floor(c + 0.5) as bigint) || '¢' end as readout
        from (select *, clarity * 640 - 320 as c from frames_ev)""", "frames_ev")
def needle_readouts(spark, sf_dir):
    c = F.col("clarity") * 640 - 320
    return _frames(spark, sf_dir).select("take_id", "frame_idx", W.needle_percent(c, 100.0).alias("needle"), W.readout(F.when(F.col("hz").isNotNull(), c)).alias("readout"))


_METRICS = ["clarity", "snr_db", "peak_to_second_db", "band_rms_db"]
_POINTS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
_GROUPS = {"tonal": "hz is not null and peak_to_second_db >= 20 and clarity >= 0.6", "background": "peak_to_second_db < 10", "all": "true"}


@query(", m as (" + " union all ".join(f"select take_id, '{g}' as grp, '{m}' as metric, {m} as x from frames_ev where {w}" for g, w in _GROUPS.items() for m in _METRICS) + ") select take_id, grp, metric, count(*) as n, "
       + ", ".join(f"list_sort(list(x))[cast(floor({p} * (count(*) - 1) + 0.5) as int) + 1] as p{round(100 * p)}" for p in _POINTS) + " from m group by all", "frames_ev")
def metric_histogram(spark, sf_dir):
    """Overlapping groups of a take's frames, one row a metric; a take's frames bound what is collected."""
    groups = F.array_compact(F.array(*[F.when(F.expr(w), F.lit(g)) for g, w in _GROUPS.items()]))
    long = _frames(spark, sf_dir).select("take_id", F.explode(groups).alias("grp"), *_METRICS).unpivot(["take_id", "grp"], _METRICS, "metric", "x")
    x = F.collect_list("x")
    return long.groupBy("take_id", "grp", "metric").agg(F.count(F.lit(1)).alias("n"), *[frames.rank_percentile(x, p).alias(f"p{round(100 * p)}") for p in _POINTS])


_PAIR = """j as (select a.take_id, a.frame_idx, 1200 * log2(b.hz / a.hz) as cents from (select take_id, frame_idx, hz from frames_ev where hz > 0) a
        join (select take_id, frame_idx, hz * (1 + (event_id % 7 - 3) / 64.0::double) * (case when event_id % 11 = 0 then 2 else 1 end) as hz from frames_ev where clarity >= 0.25) b using (take_id, frame_idx))"""


@query(f""", {_PAIR}, s as (select take_id, list_sort(list(abs(cents))) as e, count(*) as n, count(*) filter (where abs(abs(cents) - 1200) <= 50) as octaves from j group by take_id)
        select take_id, n, octaves, """ + ", ".join(f"round(e[cast(floor({p} * (n - 1) + 0.5) as int) + 1], 6) + 0.0 as {name}" for p, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"), (1.0, "most"))) + " from s", "frames_ev")
def detector_errors(spark, sf_dir):
    """Two detectors on the same grid: an equi-join by frame, then the errors of each take."""
    own = _frames(spark, sf_dir)
    other = own.where("clarity >= 0.25").select("take_id", "frame_idx", (F.col("hz") * (1 + (F.col("event_id") % 7 - 3) / 64.0) * F.when(F.col("event_id") % 11 == 0, 2).otherwise(1)).alias("other"))
    met = own.where("hz > 0").join(other.where("other is not null"), ["take_id", "frame_idx"])
    size = F.abs(1200 * F.log2(F.col("other") / F.col("hz")))
    x = F.collect_list(size)
    points = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "most": 1.0}
    return met.groupBy("take_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(size - 1200) <= 50).alias("octaves"), *[P.six(frames.rank_percentile(x, p)).alias(c) for c, p in points.items()])


@query(""", r as (select *, sum(fresh) over (partition by take_id order by frame_idx) as run from (select take_id, frame_idx, note, case when note is not distinct from lag(note) over (partition by take_id order by frame_idx) then 0 else 1 end as fresh
            from (select take_id, frame_idx, case when hz > 0 and clarity >= 0.125 then cast(floor((69 + 12 * log2(hz / 440)) / 24) as int) end as note from frames_ev)))
        select take_id, note, min(frame_idx) as start_idx, count(*) as n from r where note is not null group by take_id, run, note having count(*) >= 3""", "frames_ev")
def named_runs(spark, sf_dir):
    note = F.floor(_midi() / 24).cast("int")
    return melody.named_runs(_frames(spark, sf_dir), note, F.expr("hz > 0 and clarity >= 0.125"), 3)


@query(""", t as (select a.attempt_id, n.pos, n.midi from attempts_o a join notes_li n on n.seq_id = a.target_id), s as (select a.attempt_id, n.pos, n.midi from attempts_o a join notes_li n on n.seq_id = a.attempt_id)
        select attempt_id, pos, t.midi as wanted, s.midi as sung from t full join s using (attempt_id, pos) where t.midi is distinct from s.midi""", "attempts_o", "notes_li")
def note_differences(spark, sf_dir):
    attempts, notes = view(spark, sf_dir, "attempts_o"), view(spark, sf_dir, "notes_li")
    side = lambda key, name: attempts.join(notes.select(F.col("seq_id").alias(key), "pos", F.col("midi").alias(name)), key).select("attempt_id", "pos", name)
    met = side("target_id", "wanted").join(side("attempt_id", "sung"), ["attempt_id", "pos"], "full")
    return met.where(~F.col("wanted").eqNullSafe(F.col("sung")))


@query(""", n as (select seq_id, count(*) as notes, sum(dur_sec) as total from notes_li group by seq_id) select a.user_id, a.attempt_id, a.target_id, n.notes, n.total from attempts_o a join n on n.seq_id = a.target_id
        where a.attempt_no = (select max(b.attempt_no) from attempts_o b where b.user_id = a.user_id)""", "attempts_o", "notes_li")
def latest_sessions(spark, sf_dir):
    latest = view(spark, sf_dir, "attempts_o").groupBy("user_id").agg(F.max_by(F.struct("attempt_id", "target_id"), "attempt_no").alias("a")).select("user_id", "a.*")
    library = view(spark, sf_dir, "notes_li").groupBy(F.col("seq_id").alias("target_id")).agg(F.count(F.lit(1)).alias("notes"), F.sum("dur_sec").alias("total"))
    return latest.join(library, "target_id").select("user_id", "attempt_id", "target_id", "notes", "total")


@query(f""", h as (select take_id as user_id, frame_idx as place, clarity * 200 - 100 as median, snr_db - 10 as wobble, peak_to_second_db * 2 as drift from frames_ev),
        k as (select *, row_number() over (partition by user_id order by place) as i, count(*) over (partition by user_id) as n from h where not (abs(drift) >= 25 and abs(drift) > wobble)),
        m as (select user_id, count(*) as c, sum(median * pow(0.75, n - i) * (case when i = 1 then 1 else 0.25 end)) as o, sum(greatest(0.0, wobble) * pow(0.75, n - i) * (case when i = 1 then 1 else 0.25 end)) as w from k group by user_id)
        select user_id, case when c < 3 then '' else 'Lately: ' || (case when abs(o) < 10 then 'sitting right on it' else 'running ' || {_DISTANCE.format("o")} end) || ', wobble ±' || cast(floor(w + 0.5) as bigint) || ' cents.' end as history from m""", "frames_ev")
def hold_history(spark, sf_dir):
    holds = _frames(spark, sf_dir).select(F.col("take_id").alias("user_id"), F.col("frame_idx").alias("at"), (F.col("clarity") * 200 - 100).alias("median"), (F.col("snr_db") - 10).alias("wobble"), (F.col("peak_to_second_db") * 2).alias("drift"))
    return practice.hold_averages(holds).select("user_id", W.hold_history(F.col("count"), F.col("offset"), F.col("wobble")).alias("history"))


@query(f""", {_COUNTS}, g as (select user_id, attempt_no, clean + "off" > 0 and wrong + missing + extra = 0 as got from n)
        select user_id, attempt_no, case when got and 3 + user_id % 4 < 6 then 'Got it — one more note next time.' when not got and user_id % 4 > 0 then 'Let us take one back off.' else 'Same length again.' end as ramp from g""", *_SLOTS)
def ramp_texts(spark, sf_dir):
    """What is said after each attempt at a phrase of three to six notes."""
    counts = practice.counted(_slots(spark, sf_dir), _extras(spark, sf_dir))
    before = F.lit(3) + F.col("user_id") % 4
    got = (F.col("clean") + F.col("off") > 0) & (F.col("wrong") + F.col("missing") + F.col("extra") == 0)
    after = F.greatest(F.lit(3), F.least(F.lit(6), before + F.when(got, 1).otherwise(-1)))
    return counts.select("user_id", "attempt_no", W.ramp(before, after).alias("ramp"))
