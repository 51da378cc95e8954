"""Queries over what hangs on order: transcription, sweeps, alignments under transposition, holds, walks, sound files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRESETS, preset
from ..functions import pitch as P
from ..operators import attempts, melody, notes, practice
from ..sources import documents
from ..sources.wav import decode_wav, encode_wav, mixed
from .practice import _COUNTS, _WEIGHTS, _extras, _slots, _weights
from .queries import _frames, _midi, query
from .views import in_shares, view

RATE = 48000
PERIOD = 512 / RATE


def _whistled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The takes as whistling: after 40 silent frames, notes of 22 frames with two silent ones before each, up
    in major thirds and down again."""
    own = _frames(spark, sf_dir).withColumn("frame_idx", F.col("frame_idx") + 40)
    takes = own.select("take_id").distinct().select("take_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("frame_idx"), F.lit(None).cast("double").alias("hz"), F.lit(0).cast("long").alias("event_id"))
    note = 72 + F.expr("4 * abs(((frame_idx - 40) div 24) % 4 - 2)")
    sound = (F.col("frame_idx") >= 40) & ((F.col("frame_idx") - 40) % 24 >= 2)
    level = lambda loud, low: F.when(sound, loud).otherwise(low)
    rows = own.select("take_id", "frame_idx", "hz", "event_id").unionByName(takes)
    return rows.select(
        F.col("take_id").cast("string").alias("take_id"), "frame_idx", (F.col("frame_idx") * PERIOD).alias("t_sec"), F.when(sound, P.midi_to_hz(note + (F.col("event_id") % 5 - 2) / 50)).alias("hz"),
        level(0.9, 0.2).alias("clarity"), level(30.0, 2.0).alias("snr_db"), level(25.0, 1.0).alias("peak_to_second_db"), level(-20.0, -75.0).alias("band_rms_db"), F.lit(False).alias("clipped"),
    )


_WHISTLED = f"""n as (select cast(take_id as varchar) as take_id, cast(row_number() over (partition by take_id order by place) - 1 as int) as note_idx, cast(72 + 4 * abs(place % 4 - 2) as int) as midi,
        (low - 0.5) * {PERIOD!r}::double as start_sec, (high + 0.5) * {PERIOD!r}::double as end_sec
        from (select take_id, frame_idx // 24 as place, min(frame_idx) + 40 as low, max(frame_idx) + 40 as high, count(*) as n from frames_ev where frame_idx % 24 >= 2 group by all) where n * {PERIOD!r} >= 0.08)"""


@query(f", {_WHISTLED} select take_id, note_idx, midi, round(start_sec, 6) + 0.0 as start_sec, round(end_sec, 6) + 0.0 as end_sec from n", "frames_ev")
def transcribed_notes(spark, sf_dir):
    """The notes of every take; SQL knows them because it knows how the takes were made."""
    found = notes.transcribe(_whistled(spark, sf_dir), RATE)
    return found.select("take_id", "note_idx", "midi", P.six(F.col("start_sec")).alias("start_sec"), P.six(F.col("end_sec")).alias("end_sec"))


@query(f", {_WHISTLED} select config_id, take_id, count(*) as notes, round(sum(end_sec - start_sec), 5) + 0.0 as total from n, (select unnest(['strict', 'normal', 'forgiving']) as config_id) group by all", "frames_ev")
def swept_notes(spark, sf_dir):
    """Notes of every take under every preset: on these takes they hear the same."""
    found = notes.sweep(_whistled(spark, sf_dir), RATE, {name: preset(name) for name in PRESETS})
    return found.groupBy("config_id", "take_id").agg(F.count(F.lit(1)).alias("notes"), (F.round(F.sum("duration_sec"), 5) + F.lit(0.0)).alias("total"))


def _attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", (F.col("midi") + F.col("cents_offset") / 100).alias("p"), "dur_sec")))
    each = view(spark, sf_dir, "notes_li").groupBy("seq_id").agg(ordered.alias("n"))
    notes = each.select("seq_id", F.transform("n", lambda x: x["p"]).alias("p"), F.transform("n", lambda x: x["dur_sec"]).alias("d"))
    wanted = notes.select(F.col("seq_id").alias("target_id"), F.col("p").alias("target"), F.col("d").alias("target_sec"))
    sung = notes.select(F.col("seq_id").alias("attempt_id"), F.col("p").alias("sung"), F.col("d").alias("sung_sec"))
    return view(spark, sf_dir, "attempts_o").join(wanted, "target_id").join(sung, "attempt_id")


# every transposition's table, by folds: rows are the target's notes, each the least costs by attempt prefix
_COST = """list_reduce(list_transform(range(len(t)), lambda j: [cast(j as double)]), lambda above, v: list_reduce(list_transform(range(len(s)), lambda i: [cast(i as double)]), lambda done, i: list_append(done, least(
            above[cast(i[1] as int) + 1] + least(1.5, greatest(0.0, (abs(s[cast(i[1] as int) + 1] + shift - t[cast(v[1] as int) + 1]) - 0.3) / 1.7 * 1.5))
                + 0.02 * least(1.0, 64.0 / greatest(1, least(len(s), len(t)))) * least(1.0, abs(log2(sd[cast(i[1] as int) + 1]) - log2(td[cast(v[1] as int) + 1]) - tempo)) + 0.25 * least(abs(shift), 12) / 12.0,
            above[cast(i[1] as int) + 2] + 1 + (case when i[1] + 1 < len(s) then 0.001 else 0.0 end), done[-1] + 1.0)), [above[1] + 1.001]), list_transform(range(len(s) + 1), lambda i: cast(i as double)))[-1]"""


@query(f""", n as (select seq_id, list(midi + cents_offset / 100 order by pos) as p, list(dur_sec order by pos) as d, median(midi + cents_offset / 100) as m, avg(log2(dur_sec)) as g from notes_li group by seq_id),
        j as (select a.attempt_id, x.p as t, y.p as s, x.d as td, y.d as sd, y.g - x.g as tempo, cast(floor(x.m - y.m + 0.5) as int) as centre from attempts_o a join n x on x.seq_id = a.target_id join n y on y.seq_id = a.attempt_id),
        k as (select *, centre + d as shift from j, (select unnest(range(-14, 15)) as d) union all select *, 99, 0 from j)
        select attempt_id, round(min({_COST}), 6) + 0.0 as cost from k group by attempt_id""", "notes_li", "attempts_o")
def searched_alignments(spark, sf_dir):
    """The least cost over all transpositions, with the priors of register and duration."""
    found = attempts.align_attempts(_attempted(spark, sf_dir))
    return found.where("slot = 0").select("attempt_id", P.six(F.col("searched_cost")).alias("cost"))


# the table of the best transposition, rows by target note, and the ways back from its end, cell by cell
_ROWS = """list_reduce(list_prepend([list_transform(range(len(s) + 1), lambda i: cast(i as double))], list_transform(range(len(t)), lambda j: [[cast(j as double)]])), lambda rows, v: list_append(rows,
            list_reduce(list_prepend([rows[-1][1] + 1.001], list_transform(range(len(s)), lambda i: [cast(i as double)])), lambda done, i: list_append(done, {cell}))))"""
_PAIR = """least(1.5, greatest(0.0, (abs(s[{i}] + shift - t[{j}]) - 0.3) / 1.7 * 1.5)) + 0.02 * least(1.0, 64.0 / greatest(1, least(len(s), len(t)))) * least(1.0, abs(log2(sd[{i}]) - log2(td[{j}]) - tempo)) + each"""
_LEFT = "rows[-1][cast(i[1] as int) + 2] + 1 + (case when i[1] + 1 < len(s) then 0.001 else 0.0 end)"
_CELL = f"""list_transform(list_transform([rows[-1][cast(i[1] as int) + 1] + {_PAIR.format(i="cast(i[1] as int) + 1", j="cast(v[1][1] as int) + 1")}], lambda p: case when done[-1] + 1.0 < p - 1e-9 then done[-1] + 1.0 else p end),
            lambda q: case when {_LEFT} < q - 1e-9 then {_LEFT} else q end)[1]"""
_WAYS = """{name} as (select attempt_id, len(s) as i, len(t) as j, 0 as k, null::bigint as a, null::bigint as b from {source}
            union all
            select attempt_id, case when way = 2 then i else i - 1 end, case when way = 1 then j else j - 1 end, k + 1, case when way <> 2 then i - 1 end, case when way <> 1 then j - 1 end
            from (select w.*, case when w.i = 0 then 2 when w.j = 0 then 1 when l < least_two - 1e-9 then 2 when u < p - 1e-9 then 1 else 0 end as way
                  from (select w.*, p, u, l, case when u < p - 1e-9 then u else p end as least_two
                        from (select w.*, c[w.j][w.i] + {pair} as p, c[w.j + 1][w.i] + 1.0 as u, c[w.j][w.i + 1] + 1 + (case when w.i < len(s) then 0.001 else 0.0 end) as l from {name} w join {source} using (attempt_id) where w.i > 0 or w.j > 0) w) w) w)"""


def _way(name: str, source: str) -> str:
    return _WAYS.format(name=name, source=source, pair=_PAIR.format(i="w.i", j="w.j"))


@query(f""", n as (select seq_id, list(midi + cents_offset / 100 order by pos) as p, list(dur_sec order by pos) as d, median(midi + cents_offset / 100) as m, avg(log2(dur_sec)) as g from notes_li group by seq_id),
        j as (select a.attempt_id, x.p as t, y.p as s, x.d as td, y.d as sd, y.g - x.g as tempo, cast(floor(x.m - y.m + 0.5) as int) as centre from attempts_o a join n x on x.seq_id = a.target_id join n y on y.seq_id = a.attempt_id),
        k as (select *, centre + d as shift, 2 * abs(d) + case when d < 0 then 0 else 1 end as ord from j, (select unnest(range(-14, 15)) as d) union all select *, 99, 0, 1000 from j),
        f as (select attempt_id, list_reduce(list({{'c': {_COST}, 'v': shift}} order by ord), lambda b, x: case when x.c < b.c - 1e-9 then x else b end).v as shift from k group by attempt_id),
        c1 as (select j.*, f.shift::double as shift, f.shift as whole, 0.25 * least(abs(f.shift), 12) / 12.0 as each from j join f using (attempt_id)), t1 as (select *, {_ROWS.format(cell=_CELL)} as c from c1),
        {_way("w1", "t1")},
        r as (select attempt_id, (s[a + 1] - t[b + 1] + shift) * 100 as r from w1 join t1 using (attempt_id) where a is not null and b is not null),
        o as (select attempt_id, case when count(*) filter (abs(r) < 70) >= 2 then greatest(-60, least(60, sum(greatest(0, 1 - abs(r) / 70) * r) / sum(greatest(0, 1 - abs(r) / 70)))) else 0.0 end as off from r group by attempt_id),
        c2 as (select c1.* replace (shift - coalesce(off, 0.0) / 100 as shift), coalesce(off, 0.0) as off from c1 left join o using (attempt_id)), t2 as (select *, {_ROWS.format(cell=_CELL)} as c from c2),
        {_way("w2", "t2")}
        select attempt_id, cast(b as int) as slot, cast(a as int) as attempt_idx, case when a is null then 'missing' when b is null then 'extra' when abs(res) < 30 then 'clean' when abs(res) < 70 then 'off' else 'wrong' end as verdict,
            case when b is null then cast(coalesce(after, -1) as int) end as after_slot, cast(whole as int) as transposition, round(res, 6) + 0.0 as residual_cents, round(c[-1][-1], 6) + 0.0 as cost
        from (select w2.*, t2.c, t2.whole, case when a is not null and b is not null then (s[a + 1] - t[b + 1] + shift) * 100 end as res, max(b) over (partition by attempt_id order by k desc rows unbounded preceding) as after from w2 join t2 using (attempt_id) where k > 0)""", "notes_li", "attempts_o", recursive=True)
def aligned_slots(spark, sf_dir):
    """Slots and extras of every attempt after the second pass, against the attempt's own reference."""
    found = attempts.align_attempts(_attempted(spark, sf_dir))
    return found.select("attempt_id", "slot", "attempt_idx", "verdict", "after_slot", "transposition", P.six(F.col("residual_cents")).alias("residual_cents"), P.six(F.col("cost")).alias("cost"))


@query(""", p as (select take_id, frame_idx / 64.0::double as t, 69 + 12 * log2(hz / 440) as midi from frames_ev where hz > 0 and clarity >= 0.25),
        s as (select *, sum(fresh) over (partition by take_id order by t) as part from (select *, case when t - lag(t) over (partition by take_id order by t) > 0.08 then 1 else 0 end as fresh from p)),
        g as (select take_id, part, count(*) as n, max(t) - min(t) as len, min(t) as t0 from s group by all),
        b as (select * from (select *, row_number() over (partition by take_id order by len desc, t0) as r from g) where r = 1 and n >= 3 and len >= 0.7),
        o as (select * from (select s.take_id, s.t, (s.midi - 72) * 100 as c, b.n, row_number() over (partition by s.take_id order by s.t) - 1 as i from s join b on b.take_id = s.take_id and b.part = s.part) where i >= floor(0.25 * n)),
        q as (select *, row_number() over (partition by take_id order by t) as k, count(*) over (partition by take_id) as f from o),
        a as (select take_id, any_value(f) as f, max(t) - min(t) as steady, median(c) as med, (quantile_cont(c, 0.75) - quantile_cont(c, 0.25)) / 2 as wobble, max(c) - min(c) as reach,
            median(c) filter (where k <= greatest(1, f // 4)) as early, median(c) filter (where k > f - greatest(1, f // 4)) as late from q group by take_id)
        select take_id, round(med, 4) + 0.0 as median_cents, round(wobble, 4) + 0.0 as wobble_cents, round(case when f > greatest(1, f // 4) then greatest(-reach, least(reach, (late - early) * f / (f - greatest(1, f // 4)))) else 0.0 end, 4) + 0.0 as drift_cents,
            steady as steady_sec, f as frames from a""", "frames_ev")
def hold_scores(spark, sf_dir):
    trail = _frames(spark, sf_dir).where("hz > 0 and clarity >= 0.25").select("take_id", (F.col("frame_idx") / 64.0).alias("t_sec"), _midi().alias("midi"), F.lit(72.0).alias("target"))
    four = lambda c: (F.round(c, 4) + 0.0).alias(c)
    return attempts.score_holds(trail).select("take_id", four("median_cents"), four("wobble_cents"), four("drift_cents"), "steady_sec", "frames")


@query(""" select vec_id as take_id, 44 + 2 * len(embedding) as n_bytes, cast(list_sum(list_transform(embedding, lambda x: greatest(-32768, least(32767, floor(cast(x as double) * 32768 + 0.5))))) as bigint) as total from embeddings""")
def wav_round_trip(spark, sf_dir):
    """Every block as a 16-bit sound file and back: bytes, and the sum of the samples as read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [encode_wav(np.array(x.as_py(), float), RATE) for x in b.column(1)]
            totals = [int(round(float(decode_wav(f)[0].sum()) * 32768)) for f in files]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(f) for f in files], pa.int64()), pa.array(totals, pa.int64())], ["take_id", "n_bytes", "total"])

    blocks = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("take_id"), "embedding")
    return blocks.mapInArrow(run, "take_id long, n_bytes long, total long")


@query(""" select vec_id as take_id, cast(k as int) as place, round((0.7071 * embedding[k + 1] + 0.7071 * embedding[k + 11] + embedding[k + 21] + 0.5 * embedding[k + 41] + 0.5 * embedding[k + 51]) / 3.4142::double, 5) + 0.0 as mixed
        from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as embedding from embeddings), (select unnest(range(10)) as k)""")
def surround_mix(spark, sf_dir):
    """Six channels of ten samples each to one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [mixed(list(np.array(x.as_py()[:60], float).reshape(6, 10))) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["take_id", "mono"])

    blocks = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("take_id"), "embedding")
    return blocks.mapInArrow(run, "take_id long, mono array<double>").select("take_id", F.posexplode("mono").alias("place", "m")).select("take_id", "place", (F.round("m", 5) + 0.0).alias("mixed"))


_FIXED = "printf('%.{1}f', floor({0} * 1{2} + 0.5) / 1{2})"


def _print(x: str, places: int) -> str:
    return _FIXED.format(x, places, "0" * places)


_LINE = " || ',' || ".join([_print("t", 4), f"coalesce({_print('hz', 3)}, '')", f"coalesce({_print('(69 + 12 * log2(hz / 440))', 4)}, '')", _print("clarity", 4), _print("snr_db", 2), _print("peak_to_second_db", 2), _print("band_rms_db", 2)])


@query(f" select take_id, frame_idx, {_LINE} as line from (select *, frame_idx / 64.0::double as t from frames_ev)", "frames_ev")
def frame_csv(spark, sf_dir):
    return documents.csv_lines(_frames(spark, sf_dir).withColumn("t_sec", F.col("frame_idx") / 64.0))


@query(" select take_id, frame_idx, hz, snr_db, band_rms_db from frames_ev where hz is not null", "frames_ev")
def frame_csv_read(spark, sf_dir):
    """The lines read back: frames without a pitch are gone."""
    lines = documents.csv_lines(_frames(spark, sf_dir).withColumn("t_sec", F.col("frame_idx") / 64.0))
    return documents.parsed_lines(lines).select("take_id", "frame_idx", "hz", "snr_db", "band_rms_db")


@query(""" select seq_id, count(*) as notes, sum(case when pos % 3 = 1 then 0.0 else dur_sec end) as total from notes_li where seq_id % 5 <> 0 and seq_id % 7 <> 0 and seq_id % 11 <> 0 group by seq_id""", "notes_li")
def salvaged_targets(spark, sf_dir):
    """Targets written as JSON, some of them damaged, and what can be read back."""
    note = F.struct("pos", F.col("midi").cast("string").alias("midi"), F.when(F.col("pos") % 3 == 1, -1.0).otherwise(F.col("dur_sec")).alias("durSec"))
    each = view(spark, sf_dir, "notes_li").groupBy("seq_id").agg(F.array_sort(F.collect_list(note)).alias("n"))
    midi = lambda x: F.when(F.col("seq_id") % 11 == 0, F.lit('"high"')).otherwise(x["midi"])
    notes = F.array_join(F.transform("n", lambda x: F.concat(F.lit('{"midi":'), midi(x), F.lit(',"durSec":'), x["durSec"].cast("string"), F.lit("}"))), ",")
    name = F.when(F.col("seq_id") % 5 == 0, "").otherwise(F.concat(F.lit("t"), F.col("seq_id").cast("string")))
    source = F.when(F.col("seq_id") % 7 == 0, "radio").otherwise("midi")
    text = F.concat(F.lit('{"id":"'), name, F.lit('","name":"a","source":"'), source, F.lit('","notes":['), notes, F.lit("]}"))
    rows = documents.salvaged_targets(each.select("seq_id", text.alias("json"))).where("target is not null")
    return rows.select("seq_id", F.size("target.notes").cast("long").alias("notes"), F.aggregate("target.notes", F.lit(0.0), lambda a, n: a + n["dur_sec"]).alias("total"))


@query(" select melody_id, cast(k as int) as pos, midi[k + 1] as midi, round(beats[k + 1]::double * 0.6::double, 6) as dur_sec from (values " + ", ".join(f"('{n}', {m}, {[float(x) for x in b]})" for n, (m, b) in documents.MELODIES.items()) + ") t(melody_id, midi, beats), (select unnest(range(15)) as k) where k < len(midi)")
def bundled_melodies(spark, sf_dir):
    return documents.bundled(spark).withColumn("dur_sec", F.round("dur_sec", 6))


@query(""", m as (select *, row_number() over w as r, lag(hz) over w as before from frames_ev window w as (partition by take_id order by frame_idx))
        select take_id, frame_idx, hz from (select *, row_number() over (partition by take_id order by frame_idx desc) as age from m where hz is not null or r = 1 or before is not null) where age <= 40""", "frames_ev")
def live_trail(spark, sf_dir):
    points = _frames(spark, sf_dir).select("take_id", "frame_idx", F.col("hz").alias("midi"))
    return melody.live_trail(points, 40).withColumnRenamed("midi", "hz")


@query(""", p as (select take_id, frame_idx, 69 + 12 * log2(hz / 440) as midi, clarity, snr_db, clarity >= 0.5 and snr_db >= 12 as sure from frames_ev where hz > 0),
        e as (select take_id, max(frame_idx) as fin, list_sort(list(midi) filter (where sure)) as s, list_sort(list(midi)) as a from p group by take_id),
        x as (select take_id, fin, case when len(coalesce(s, [])) > 20 then s else a end as x from e), b as (select take_id, fin, floor(x[cast(floor(0.02 * (len(x) - 1)) as int) + 1]) - 2 as low, ceil(x[cast(floor(0.98 * (len(x) - 1)) as int) + 1]) + 2 as high from x),
        c as (select take_id, cast(floor((high - midi) / (high - low) * 29 + 0.5) as int) as row, cast(floor(frame_idx / fin::double * 149 + 0.5) as int) as "column", case when sure then 2 when clarity >= 0.25 then 1 else 0 end as level from p join b using (take_id))
        select take_id, row, "column", (['.', '+', '#'])[max(level) + 1] as mark from c where row between 0 and 29 group by take_id, row, "column" """, "frames_ev")
def pitch_plot(spark, sf_dir):
    points = _frames(spark, sf_dir).where("hz > 0").select("take_id", F.col("frame_idx").cast("double").alias("t_sec"), _midi().alias("midi"), "clarity", "snr_db")
    return melody.plot_grid(points)


_IMUL = lambda a, b: f"(({a})::hugeint * ({b})) % 4294967296"
_DRAWS = f"""d1 as (select user_id, k, (user_id + k * 1831565813::hugeint) % 4294967296 as a from (select distinct user_id from attempts_o), (select unnest(range(1, 7)) as k)),
        d2 as (select user_id, k, cast({_IMUL("xor(a::bigint, a::bigint >> 15)", "a::bigint | 1")} as bigint) as x from d1), d3 as (select user_id, k, xor(x, cast((x + {_IMUL("xor(x, x >> 7)", "x | 61")}) % 4294967296 as bigint)) as x from d2),
        draws as (select user_id, list(xor(x, x >> 14) / 4294967296.0::double order by k) as u from d3 group by user_id)"""


@query(f""", {_WEIGHTS}, {_COUNTS}, {_DRAWS}, g as (select user_id, list(clean + "off" > 0 and wrong + missing + extra = 0 order by attempt_no) as got from n group by user_id),
        q as (select user_id, list_reduce(list_prepend(3, list_transform(got, lambda x: case when x then 1 else -1 end)), lambda a, d: greatest(3, least(6, a + d))) as length from g),
        p as (select wt.user_id, list(step order by step) as s, list(round(weight, 9) order by step) as w from wt group by wt.user_id),
        o as (select p.*, q.length, draws.u from p join q using (user_id) join draws using (user_id)),
        walk as (select user_id, 0 as pos, cast(floor(u[1] * 5) as int) + 82 as midi from o
                 union all
                 select user_id, pos + 1, midi + coalesce(ss[list_position(list_transform(runs, lambda r: r > draw * runs[-1]), true)], ss[-1])
                 from (select *, list_transform(range(1, len(ws) + 1), lambda i: list_reduce(ws[1:i], lambda a, b: a + b)) as runs
                       from (select walk.user_id, walk.pos, walk.midi, o.u[walk.pos + 2] as draw, list_filter(o.s, lambda x: walk.midi + x between 78 and 90) as ss,
                                    list_transform(list_filter(range(1, len(o.s) + 1), lambda i: walk.midi + o.s[i] between 78 and 90), lambda i: o.w[i]) as ws
                             from walk join o using (user_id) where walk.pos + 1 < o.length)))
        select user_id, cast(pos as int) as pos, cast(midi as int) as midi from walk""", "aligned_o", "extras_o", "attempts_o", recursive=True)
def echo_phrases(spark, sf_dir):
    """A phrase for each user, biased towards their weak intervals, as long as their ramp says."""

    def made():
        lengths = practice.echo_lengths(practice.counted(_slots(spark, sf_dir), _extras(spark, sf_dir)))
        weights = _weights(spark, sf_dir).withColumn("weight", F.round("weight", 9))
        return melody.echo_phrases(weights, lengths)

    return in_shares(made, spark, sf_dir, "echo")
