"""Streams against batches: late rows, any split, restarts, repeats, overtaken sessions."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strophe.operators import practice
from strophe.streaming import folds, run, sessions, windows

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
FRAME = "take_id long, at timestamp, hz double, clarity double, snr_db double, peak_to_second_db double, band_rms_db double"


def frame(take, sec, hz=440.0, clarity=0.9):
    return take, START + dt.timedelta(seconds=sec), hz, clarity, 20.0, 10.0, -30.0 - sec % 7


def fed(spark, path, schema, *files):
    """A stream that reads files, lists of rows, one after another."""
    import os

    path.mkdir(exist_ok=True)
    for k, rows in enumerate(files):
        target = path / f"{k}.json"
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(target) + ".d")
        part = next((path / f"{k}.json.d").glob("part-*"))
        os.replace(part, target)
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path / "*.json"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


END = (-1, dt.datetime(9000, 1, 1, tzinfo=dt.timezone.utc), 1.0, 1.0, 99.0, 99.0, 0.0)


def test_windows_close_and_late_rows_go(spark, tmp_path):
    first = [frame(1, s) for s in range(10)] + [frame(2, s, None if s % 2 else 880.0) for s in range(10)]
    second = [frame(1, 100)]
    third = [frame(2, 100)]  # the watermark of a batch holds rows back from the next but one on
    late = [frame(1, 5), frame(1, 96, 500.0), frame(2, 99)]  # it stands at 90 by then
    stream = fed(spark, tmp_path / "in", FRAME, first, second, third, late, [END])
    got, query = run.drained(windows.window_statistics(stream, "4 seconds", late="10 seconds"))
    kept = spark.createDataFrame([*first, *second, *third, *late[1:]], FRAME)
    assert rows_of(got) == rows_of(windows.window_statistics(kept, "4 seconds"))
    states = [p.stateOperators[0] for p in query.recentProgress]
    assert sum(s.numRowsDroppedByWatermark for s in states) == 1
    assert states[-1].numRowsTotal == 1  # only the window of the last row, at the end of time, is still open


def test_sessions_end_by_gap_and_late_rows_go(spark, tmp_path):
    first = [frame(1, s / 4) for s in range(8)] + [frame(1, 1.1, clarity=0.1)] + [frame(1, 5 + s / 4) for s in range(3)]
    second = [frame(1, 60)]
    late = [frame(1, 5.6), frame(1, 60.2), frame(1, 60.4)]
    stream = fed(spark, tmp_path / "in", FRAME, first, second, [frame(2, 60)], late, [END])
    got, query = run.drained(windows.session_runs(stream, "300 milliseconds", late="10 seconds"))
    us = lambda s: int((START.timestamp() + s) * 1e6)
    assert rows_of(got) == [(1, us(0), us(1.75), 8), (1, us(5), us(5.5), 3), (1, us(60), us(60.4), 3)]
    kept = spark.createDataFrame([*first, *second, *late[1:]], FRAME)
    assert rows_of(windows.session_runs(kept, "300 milliseconds")) == rows_of(got)
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in query.recentProgress) == 1


def test_event_time_has_no_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    table = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.000001' as ts")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # where this hour does not exist
        assert table.select(F.unix_micros(windows.event_time())).first()[0] == 1710037800000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


ATTEMPT = f"user_id long, attempt_id long, attempt_no int, target_id long, slots {folds.SLOTS}"


@pytest.fixture(scope="module")
def slots(spark):
    """Slots of two users' attempts; a target grows by a note on the way."""
    rows = []
    for user in (1, 2):
        for n in range(9):
            for slot in range(3 + (n > 4)):
                cents = float((user * 31 + n * 17 + slot * 53) % 160 - 80)
                verdict = "missing" if (n + slot) % 5 == 4 else "clean" if abs(cents) < 30 else "off" if abs(cents) < 70 else "wrong"
                rows.append((user, user * 100 + n, n, user + 50, slot, 60 + (slot * 4) % 7, None if verdict == "missing" else cents, verdict))
    return spark.createDataFrame(rows, "user_id long, attempt_id long, attempt_no int, target_id long, slot int, target_midi int, residual_cents double, verdict string").cache()


def six(df):
    return rows_of(df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long" if t == "int" else t).alias(c) for c, t in sorted(df.dtypes)]))


@pytest.mark.parametrize("split", [[18], [1] * 18, [7, 2, 9]])
def test_ledger_of_any_split(spark, slots, tmp_path, split):
    every = [tuple(r) for r in folds.attempts(slots).drop("extra").collect()]
    every = sorted(every, key=lambda r: (r[1] * 7919) % 1009)  # in no order
    parts, at = [], 0
    for n in split:
        parts.append(every[at : at + n])
        at += n
    stream = fed(spark, tmp_path / "in", ATTEMPT, *parts)
    got = folds.newest(run.drained(folds.stream_ledger(stream))[0], "user_id", "step")
    assert six(got) == six(practice.interval_ledger(slots).select(*got.columns))
    tallies = folds.standing_tallies(run.drained(folds.stream_tallies(stream))[0])
    assert six(tallies) == six(practice.target_tallies(slots).drop("trouble").select(*tallies.columns))


def test_ledger_restarts_and_ignores_repeats(spark, slots, tmp_path):
    every = sorted((tuple(r) for r in folds.attempts(slots).drop("extra").collect()), key=lambda r: r[1])
    nameless = [(None, 1, 0, 1, []), (3, 1, None, 1, [])]
    checkpoint, out = str(tmp_path / "state"), str(tmp_path / "out")
    stream = fed(spark, tmp_path / "in", ATTEMPT, every[:7] + nameless)
    run.drained(folds.stream_ledger(stream), checkpoint, out)
    # the query has ended; a new one takes its state over from the checkpoint, and gets some attempts again
    more = spark.createDataFrame(every[5:] + every[:3], ATTEMPT).coalesce(1)
    more.write.json(str(tmp_path / "more"))
    next((tmp_path / "more").glob("part-*")).rename(tmp_path / "in" / "1.json")
    got, query = run.drained(folds.stream_ledger(stream), checkpoint, out)
    assert query.recentProgress[0].batchId == 1
    ledger = folds.newest(got, "user_id", "step")
    assert six(ledger) == six(practice.interval_ledger(slots).select(*ledger.columns))
    more.write.json(str(tmp_path / "again"))
    next((tmp_path / "again").glob("part-*")).rename(tmp_path / "in" / "2.json")
    before = got.count()
    assert run.drained(folds.stream_ledger(stream), checkpoint, out)[0].count() == before


def test_progress_of_phrases_and_holds(spark, tmp_path):
    schema = "user_id long, attempt_no int, got boolean, held struct<median:double,wobble:double>"
    rows = [(1, n, None if n == 4 else n % 3 != 0, None if n % 2 else (n * 10.0 - 20, n - 3.0)) for n in range(8)]
    stream = fed(spark, tmp_path / "in", schema, rows[4:], rows[:4])
    got = folds.newest(run.drained(folds.stream_progress(stream))[0], "user_id").first()
    length, offset, wobble = 3, None, None
    for _, n, ok, held in rows:
        length = length if ok is None else max(3, min(6, length + (1 if ok else -1)))
        if held:
            offset = held[0] if offset is None else offset + 0.25 * (held[0] - offset)
            wobble = max(0.0, held[1]) if wobble is None else wobble + 0.25 * (max(0.0, held[1]) - wobble)
    assert (got.length, got["count"]) == (length, 4) and got.offset == pytest.approx(offset) and got.wobble == pytest.approx(wobble)


POINT = "source_id long, token long, at timestamp, midi double"


def point(source, token, sec, midi=70.0):
    return source, token, START + dt.timedelta(seconds=sec), midi


LAST = (-1, 0, END[1], None)


def test_trails_of_sessions(spark, tmp_path):
    taken = [point(1, 1, s, None if s % 4 in (1, 2) else 70.0 + s) for s in range(70)]  # ends at 60 by itself
    overtaken = [point(2, 5, s) for s in range(20)]
    newer = [point(2, 6, 20 + s, 80.0) for s in range(5)]
    stale = [point(2, 5, 30, 1.0), point(2, 5, 31, 1.0)]  # the older session goes on, and is not heard
    late_start = [point(1, 2, 75 + s, None) for s in range(4)]
    rows = [taken[:40] + overtaken, taken[40:] + newer, stale + late_start, [LAST]]
    stream = fed(spark, tmp_path / "in", POINT, *rows)
    timed = stream.withWatermark("at", "1 second")
    got, _ = run.drained(sessions.stream_trails(timed, most=25))
    batch = sessions.ended_trails(spark.createDataFrame([r for part in rows[:3] for r in part], POINT), most=25)
    assert rows_of(got) == rows_of(batch)
    assert {(r.source_id, r.token) for r in got.collect()} == {(1, 1), (1, 2), (2, 6)}
    assert got.where("source_id = 1 and token = 1").count() == 25 and got.where("token = 2").count() == 1


class Counted:
    """A state or a handle that counts its calls by name."""

    def __init__(self, calls, value=None, items=()):
        self.calls, self.value, self.items = calls, value, list(items)

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "update":
                self.value = args[0]
            elif name in ("put", "appendList"):
                self.items = ([] if name == "put" else self.items) + list(args[0])
            elif name == "clear":
                self.items = []
            return self.value if name == "get" and self.value is not None else iter(self.items) if name == "get" and self.items else bool(self.value or self.items) if name == "exists" else None

        return call


def test_a_batch_reads_and_writes_a_sources_state_once():
    calls = []
    own = sessions.LiveTrail(6, 60_000_000)
    own.handle, own.session, own.points = Counted(calls), Counted(calls), Counted(calls)
    rows = [(token, 1_000_000 * (100 * token + s), 70.0) for token in range(20) for s in range(80)]  # each take ends by itself but the last's
    rows = [r for r in rows if r[0] < 19 or r[1] < 1_000_000 * (1900 + 30)]
    got = list(own.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["token", "at_us", "midi"])]), None))
    assert sum(map(len, got)) == 19 * 6 and len(got) == 1
    assert sorted(calls) == ["appendList", "get", "registerTimer", "update"] or sorted(calls) == ["get", "put", "registerTimer", "update"]


def test_trails_restart(spark, tmp_path):
    first = [point(1, 1, s, 70.0 + s) for s in range(30)]
    second = [point(1, 1, s, 70.0 + s) for s in range(30, 65)]
    checkpoint, out = str(tmp_path / "state"), str(tmp_path / "out")
    stream = fed(spark, tmp_path / "in", POINT, first)
    timed = stream.withWatermark("at", "1 second")
    assert run.drained(sessions.stream_trails(timed), checkpoint, out)[0].count() == 0  # the take goes on
    for k, rows in enumerate((second, [LAST])):
        spark.createDataFrame(rows, POINT).coalesce(1).write.json(str(tmp_path / f"more{k}"))
        next((tmp_path / f"more{k}").glob("part-*")).rename(tmp_path / "in" / f"{k + 1}.json")
    got, _ = run.drained(sessions.stream_trails(timed), checkpoint, out)
    assert [tuple(r)[2:] for r in got.orderBy("n").collect()] == [(i, int((START.timestamp() + i) * 1e6), 70.0 + i) for i in range(60)]


def test_rings_keep_the_newest(spark, tmp_path):
    rows = [point(1, 1, s / 100, float(s)) for s in range(1000)]
    stream = fed(spark, tmp_path / "in", POINT, *[rows[i : i + 90] for i in range(0, 1000, 90)], [LAST])
    got, _ = run.drained(sessions.stream_trails(stream.withWatermark("at", "1 second"), most=50))
    assert [r.midi for r in got.orderBy("n").collect()] == [float(s) for s in range(950, 1000)]
