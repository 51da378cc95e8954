"""Queries over notes and takes as people read them: tables, names, hints, references, and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pitch as P
from ..functions import register
from ..functions import words as W
from ..operators import frames, melody
from .queries import _NAMES, _frames, query
from .views import view

_LPAD = lambda x, n: f"case when length({x}) < {n} then lpad({x}, {n}, ' ') else {x} end"
_TWO = lambda x: f"printf('%.2f', floor({x} * 100 + 0.5) / 100)"


@query(f""" select seq_id, pos, {_LPAD("cast(pos + 1 as varchar)", 3)} || ' | ' || {_LPAD(_TWO("start_sec"), 6)} || ' | ' || {_LPAD(_TWO("dur_sec"), 5)} || ' | ' || {_LPAD(f"(({_NAMES})[midi % 12 + 1] || cast(cast(floor(midi / 12) as int) - 1 as varchar))", 4)}
            || ' | ' || {_LPAD("cast(midi as varchar)", 4)} || ' | ' || {_LPAD("((case when cents_offset >= 0 then '+' else '' end) || cast(cast(cents_offset as bigint) as varchar))", 5)} || ' | ' || {_LPAD(_TWO("(pos % 5) / 4.0::double"), 4)}
            || ' | ' || {_LPAD("printf('%.1f', floor((440 + midi) * 10 + 0.5) / 10)", 6)} || ' | ' || (case when midi % 3 = 0 and pos % 2 = 0 then ' glidedIn,drifted' when midi % 3 = 0 then ' glidedIn' when pos % 2 = 0 then ' drifted' else '' end) as line from notes_timed""", "notes_timed")
def note_table(spark, sf_dir):
    own = view(spark, sf_dir, "notes_timed")
    flags = F.array_compact(F.array(F.when(F.expr("midi % 3 = 0"), "glidedIn"), F.when(F.expr("pos % 2 = 0"), "drifted")))
    line = W.note_line(F.col("pos") + 1, F.col("start_sec"), F.col("dur_sec"), P.note_name(F.col("midi")), F.col("midi"), F.col("cents_offset"), F.expr("(pos % 5) / 4D"), F.expr("440D + midi"), flags)
    return own.select("seq_id", "pos", line.alias("line"))


_MONTHS = "(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month(ts)]"


@query(f" select event_id, 'Recorded ' || day(ts) || ' ' || {_MONTHS} || ', ' || strftime(ts, '%H:%M') as name, 'whistle-' || strftime(ts, '%Y%m%d-%H%M%S') || '.wav' as file from events")
def take_names(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", W.default_name(F.col("ts")).alias("name"), W.file_name(F.col("ts")).alias("file"))


@query(" select seq_id, pos, median(cents_offset) over (partition by seq_id order by pos rows between 2 preceding and current row) as reference from notes_li", "notes_li")
def tail_medians(spark, sf_dir):
    return view(spark, sf_dir, "notes_li").select("seq_id", "pos", frames.tail_median("cents_offset", ["seq_id"], "pos", 3).alias("reference"))


@query(" select take_id, frame_idx, coalesce(frame_idx - last_value(case when clipped then frame_idx end ignore nulls) over (partition by take_id order by frame_idx rows unbounded preceding) <= 4, false) as hint from frames_ev", "frames_ev")
def clip_hints(spark, sf_dir):
    """A hint that stays for two seconds, at two frames a second."""
    return _frames(spark, sf_dir).select("take_id", "frame_idx", frames.recently("clipped", "frame_idx", 4).alias("hint"))


_IMUL = lambda a, b: f"(({a})::hugeint * ({b})) % 4294967296"


@query(f"""with recursive d1 as (select c_custkey as user_id, c_custkey % 9 as w, k, (c_custkey + k * 1831565813::hugeint) % 4294967296 as a from customer, (select unnest(range(1, 9)) as k)),
        d2 as (select user_id, w, k, cast({_IMUL("xor(a::bigint, a::bigint >> 15)", "a::bigint | 1")} as bigint) as x from d1), d3 as (select user_id, w, k, xor(x, cast((x + {_IMUL("xor(x, x >> 7)", "x | 61")}) % 4294967296 as bigint)) as x from d2),
        d as (select user_id, w, k, 79 + cast(floor(xor(x, x >> 14) / 4294967296.0::double * (w - 1)) as int) as drawn from d3),
        r as (select user_id, w, k, case when w > 2 then drawn else cast(floor((78 + 78 + w) / 2.0 + 0.5) as int) end as midi from d where k = 1
              union all select d.user_id, d.w, d.k, case when d.w <= 2 then cast(floor((78 + 78 + d.w) / 2.0 + 0.5) as int) when drawn <> midi then drawn when drawn + 1 <= 77 + d.w then drawn + 1 else drawn - 1 end from r join d on d.user_id = r.user_id and d.k = r.k + 1)
        select user_id, cast(k - 1 as int) as pos, midi from r""")
def hold_references(spark, sf_dir):
    """Eight notes to hold for every customer, in registers from 78 on of up to eight semitones."""
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    high = F.expr("78D + user_id % 9")
    return users.select("user_id", F.posexplode(melody.hold_references(F.col("user_id"), 8, F.lit(78.0), high)).alias("pos", "midi"))


@query(f""" select take_id, frame_idx, round(69 + 12 * log2(hz / 440), 6) + 0.0 as midi, ({_NAMES})[cast(floor(69 + 12 * log2(hz / 440) + 0.5) as int) % 12 + 1] || cast(cast(floor(floor(69 + 12 * log2(hz / 440) + 0.5) / 12) as int) - 1 as varchar) as name,
        round(20 * log10(greatest(clarity, 1e-12)), 6) + 0.0 as level, case when abs(snr_db * 3 - 60) < 30 then 'clean' when abs(snr_db * 3 - 60) < 70 then 'off' else 'wrong' end as verdict,
        round(1.5 * greatest(0, least(1, (abs(peak_to_second_db / 8) - 0.3) / 1.7)), 6) + 0.0 as cost, lines
        from frames_ev join (select p as spot, count(*) as lines from (select unnest(range(-8, 20)) as p), (select unnest(range(-20, 21)) as l) where (p <= -2 and l between p and -2 and l % 2 = 0) or (p >= 10 and l between 10 and p and l % 2 = 0) group by p) on spot = frame_idx % 28 - 8 where hz > 0""", "frames_ev")
def sql_functions(spark, sf_dir):
    """The registered functions in a SQL statement, the table function in a lateral join: frames that need ledger lines."""
    register.register(spark)
    rows = _frames(spark, sf_dir).where("hz > 0").withColumn("at", F.expr("cast(frame_idx % 28 - 8 as int)"))
    return spark.sql("""
        select take_id, frame_idx, round(strophe_hz_to_midi(hz), 6) + 0D as midi, strophe_note_name(strophe_nearest_note(strophe_hz_to_midi(hz))) as name, round(strophe_amplitude_db(clarity), 6) + 0D as level,
               strophe_verdict(snr_db * 3 - 60) as verdict, round(strophe_substitution(peak_to_second_db / 8), 6) + 0D as cost, count(line) as lines
        from {rows}, lateral strophe_ledger_lines(at) group by all""", rows=rows)
