"""Queries that run as streams to their end, each held against SQL over the whole tables, and their twins as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import practice
from ..streaming import folds, sessions, windows
from ..streaming.run import as_stream, closed, drained
from .practice import _COUNTS, _EACH, _SHORT, _SLOTS, _extras, _nine, _shortened, _slots
from .queries import _TONAL, query

WIDTH, GAP, LATE = "3 days", "12 hours", "1 hour"
_SURE = {"clarity": 1.0, "snr_db": 99.0, "peak_to_second_db": 99.0, "hz": 1.0}


def timed_frames(events: DataFrame) -> DataFrame:
    """Frames of events by their own time: the measures of the view frames_ev, without its numbers, so also of a stream."""
    number = lambda e: F.expr(f"cast({e} as double)")
    hz = F.when(F.col("event_type") != "error", number("400 + (event_id * 37) % 4096"))
    measures = {"clarity": "(event_id * 13) % 64", "snr_db": "(event_id * 7) % 40", "peak_to_second_db": "(event_id * 11) % 32", "band_rms_db": "(event_id * 29) % 64"}
    own = {c: number(e) for c, e in measures.items()}
    scaled = {**own, "clarity": own["clarity"] / 64, "band_rms_db": own["band_rms_db"] / 2 - 90}
    return events.select(F.col("user_id").alias("take_id"), windows.event_time().alias("at"), hz.alias("hz"), *[e.alias(c) for c, e in scaled.items()])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's file or files as a stream: a pattern, since a single file is no folder to a streaming source."""
    return spark.readStream.schema(_events(spark, sf_dir).schema).parquet(f"{sf_dir}/{{events.parquet}}")


def _live_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of frames that ends."""
    return closed(timed_frames(_event_stream(spark, sf_dir)), "at", LATE, **_SURE)


_NEAREST = lambda c: f"list_sort(list({c}))[cast(floor(0.5 * (count({c}) - 1) + 0.5) as int) + 1]"
_WINDOWS = f"""with f as (select user_id as take_id, epoch_us(ts) as us, case when event_type = 'error' then null else cast(400 + (event_id * 37) % 4096 as double) end as hz,
                cast((event_id * 13) % 64 as double) / 64 as clarity, cast((event_id * 7) % 40 as double) as snr_db, cast((event_id * 11) % 32 as double) as peak_to_second_db, cast((event_id * 29) % 64 as double) / 2 - 90 as band_rms_db from events)"""
_BUCKETS = f"""{_WINDOWS} select take_id, us // 259200000000 * 259200000000 as start_us, count(*) as n_frames, count(*) filter (hz is not null and clarity >= 0.5 and snr_db >= 12) as n_tonal,
        {_NEAREST("sure")} as median_hz, {_NEAREST("clarity")} as median_clarity, {_NEAREST("snr_db")} as median_snr_db, {_NEAREST("band_rms_db")} as median_band_rms_db
        from (select *, case when clarity >= 0.5 and snr_db >= 12 then hz end as sure from f) group by all"""
_SESSIONS = f"""{_WINDOWS}, s as (select *, sum(apart) over (partition by take_id order by us) as session from (select *, case when us - lag(us) over (partition by take_id order by us) > 43200000000 then 1 else 0 end as apart from f where {_TONAL}))
        select take_id, min(us) as first_us, max(us) as last_us, count(*) as n from s group by take_id, session having count(*) >= 3"""


@query(_BUCKETS)
def window_statistics(spark, sf_dir):
    return windows.window_statistics(timed_frames(_events(spark, sf_dir)), WIDTH)


@query(_BUCKETS)
def streamed_window_statistics(spark, sf_dir):
    return drained(windows.window_statistics(_live_frames(spark, sf_dir), WIDTH))[0]


@query(_SESSIONS)
def session_runs(spark, sf_dir):
    return windows.session_runs(timed_frames(_events(spark, sf_dir)), GAP)


@query(_SESSIONS)
def streamed_session_runs(spark, sf_dir):
    return drained(windows.session_runs(_live_frames(spark, sf_dir), GAP))[0]


def _rounded(ledger: DataFrame) -> DataFrame:
    return ledger.select("user_id", "step", *practice.VERDICTS, "observations", "cents_observations", _nine("wrong_rate").alias("wrong_rate"), _nine("abs_cents").alias("abs_cents"))


@query(f', {_EACH} select user_id, step, clean, "off", wrong, missing, observations, cents_observations, round(wrong_rate, 6) + 0.0 as wrong_rate, round(abs_cents, 6) + 0.0 as abs_cents from ledger', "aligned_o")
def streamed_ledger(spark, sf_dir):
    """Attempts in three micro-batches by their ids, so a user's attempts don't come in order."""
    stream = as_stream(folds.attempts(_slots(spark, sf_dir)), 3, "attempts", "attempt_id")
    return _rounded(folds.newest(drained(folds.stream_ledger(stream))[0], "user_id", "step"))


@query(f', {_SHORT} select target_id, slot, attempts, clean, "off", wrong, missing from u', "aligned_o")
def streamed_tallies(spark, sf_dir):
    stream = as_stream(folds.attempts(_shortened(spark, sf_dir)), 3, "attempts", "attempt_id")
    return folds.standing_tallies(drained(folds.stream_tallies(stream))[0])


@query(f""", {_COUNTS}, p as (select *, clean + "off" > 0 and wrong + missing + extra = 0 as got, cast((attempt_id * 37) % 200 - 100 as double) as m, cast((attempt_id * 13) % 60 - 10 as double) as w, attempt_id % 3 = 0 as slid from n),
        q as (select user_id, list(case when got then 1 else -1 end order by attempt_no) as got from p group by user_id),
        h as (select *, row_number() over (partition by user_id order by attempt_no) as i, count(*) over (partition by user_id) as k from p where not slid),
        a as (select user_id, count(*) as count, round(sum(m * pow(0.75, k - i) * (case when i = 1 then 1 else 0.25 end)), 6) + 0.0 as "offset", round(sum(greatest(0.0, w) * pow(0.75, k - i) * (case when i = 1 then 1 else 0.25 end)), 6) + 0.0 as wobble from h group by user_id)
        select user_id, list_reduce(list_prepend(3, got), lambda a, d: greatest(3, least(6, a + d))) as length, coalesce(count, 0) as count, "offset", wobble from q left join a using (user_id)""", *_SLOTS)
def streamed_progress(spark, sf_dir):
    """Each attempt is a phrase and a held note, whose figures its id gives; a third of the notes slid and are not counted."""
    counts = practice.counted(_slots(spark, sf_dir), _extras(spark, sf_dir))
    got = (F.col("clean") + F.col("off") > 0) & (F.col("wrong") + F.col("missing") + F.col("extra") == 0)
    note = F.struct(F.expr("cast((attempt_id * 37) % 200 - 100 as double)").alias("median"), F.expr("cast((attempt_id * 13) % 60 - 10 as double)").alias("wobble"))
    drift = F.when(F.expr("attempt_id % 3 = 0"), 100.0).otherwise(0.0)
    rows = counts.select("user_id", "attempt_id", "attempt_no", got.alias("got"), F.when(~W.drift_dominates(note["wobble"], drift), note).alias("held"))
    last = folds.newest(drained(folds.stream_progress(as_stream(rows, 3, "attempts", "attempt_id")))[0], "user_id")
    return last.select("user_id", "length", "count", _nine("offset").alias("offset"), _nine("wobble").alias("wobble"))


_MOST, _SEC = 6, 4 * 86400.0
_TRAILS = """, p as (select source_id, epoch_us(ts) as at_us, epoch_us(ts) // (604800000000 - source_id % 3 * 259200000000) as token, hz from points_ev),
        b as (select source_id, token, min(at_us) + 345600000000 as fin from p group by all),
        k as (select source_id, token, fin from (select *, lead(fin - 345600000000) over (partition by source_id order by token) as nxt from b) where nxt is null or nxt >= fin),
        m as (select p.*, row_number() over w as r, lag(hz) over w as before from p join k using (source_id, token) where at_us < fin window w as (partition by source_id, token order by at_us)),
        t as (select *, row_number() over (partition by source_id, token order by at_us desc) as age from m where hz is not null or r = 1 or before is not null)
        select source_id, token, row_number() over (partition by source_id, token order by at_us) - 1 as n, at_us, hz as midi from t where age <= 6"""


def _points(events: DataFrame) -> DataFrame:
    """Sessions of a week, of four days or of one, by source, each taken to last four days."""
    hz = F.when(~F.col("event_type").isin("error", "view"), F.expr("cast(400 + (event_id * 37) % 4096 as double)"))
    at = windows.event_time()
    token = F.floor(F.unix_micros(at) / (F.lit(604800000000) - F.col("user_id") % 3 * 259200000000))
    return events.select(F.col("user_id").alias("source_id"), token.alias("token"), at.alias("at"), hz.alias("midi"))


@query(_TRAILS, "points_ev")
def ended_trails(spark, sf_dir):
    return sessions.ended_trails(_points(_events(spark, sf_dir)), _MOST, _SEC)


@query(_TRAILS, "points_ev")
def streamed_trails(spark, sf_dir):
    return drained(sessions.stream_trails(closed(_points(_event_stream(spark, sf_dir)), "at", LATE, source_id=-1, token=0), _MOST, _SEC))[0]
