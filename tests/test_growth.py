"""What shows only on larger tables: long takes, many rounds, many users."""

import duckdb
import pyarrow.parquet as pq
import pytest
from test_core import rows, table

from strophe.plans import segments  # noqa: F401  its queries join those of core
from strophe.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["run_centres", "centre_steps"])
def test_centres_of_long_takes_equal_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql(f"create table events as select * replace (event_id + r * 1001 as event_id, user_id % 7 as user_id, ts + to_seconds(r) as ts) from '{SF}/events.parquet', (select unnest(range(4)) as r)")
    pq.write_table(con.sql("from events").to_arrow_table(), tmp_path / "events.parquet")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == table(con.sql(ORACLE_SQL[name]))


def test_alignments_hold_nulls_and_unequal_lengths_side_by_side(spark):
    """Every row of a batch as it is alone, whatever stands beside it; with as many array operations for 4,000 rows as for 40."""
    import numpy as np

    from strophe.operators import attempts

    draw = np.random.default_rng(3)
    made = []
    for k in range(40):
        n, m = k % 5, (k * 3) % 7
        sung, target = [float(60 + x) for x in draw.integers(0, 12, n)], [float(60 + x) for x in draw.integers(0, 12, m)]
        made.append((k, sung or None, target, [float(x) for x in draw.integers(0, 4, n)] if k % 2 else None, [float(x) for x in draw.integers(1, 5, m + k % 3 // 2)]))
    schema = "attempt_id long, sung array<double>, target array<double>, sung_sec array<double>, target_sec array<double>"
    wanted = set()
    for k, sung, target, a, b in made:
        one = attempts.align(sung or [], target, a if a else np.zeros(len(sung or [])), b if len(b) == len(target) else np.zeros(len(target)))
        wanted |= {(k, s["slot"], s["attempt"], s["verdict"], None, round(one["cost"], 9)) for s in one["slots"]} | {(k, None, e["attempt"], "extra", e["after"], round(one["cost"], 9)) for e in one["extras"]}
    got = attempts.align_attempts(spark.createDataFrame(made, schema).coalesce(1)).collect()
    assert {(r.attempt_id, r.slot, r.attempt_idx, r.verdict, r.after_slot, round(r.cost, 9)) for r in got} == wanted and len(got) == len(wanted)

    calls, fill = [], attempts._table
    attempts._table = lambda *given: calls.append(1) or fill(*given)
    try:
        rows = np.tile([60.0, 64.0, 67.0], (4000, 1))
        attempts.align_alike(rows, rows, attempts._durations(rows, rows))
    finally:
        attempts._table = fill
    assert len(calls) <= 3


def test_aligned_slots_come_from_arrays(spark):
    """The plan has one Arrow step and no fold by expressions, which took too long at size."""
    plan = QUERIES["aligned_slots"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(shifts" not in plan


def test_folds_touch_their_state_once_a_block(spark):
    """Round trips to the state server are as many as blocks of keys and micro-batches, not as attempts."""
    import json

    import pandas as pd

    from strophe.streaming import folds

    class Value:
        now, trips = None, 0

        def exists(self):
            return self.now is not None

        def get(self):
            self.trips += 1
            return self.now

        def update(self, value):
            self.trips += 1
            self.now = value

    class Handle:
        value = Value()

        def getValueState(self, name, schema):
            return self.value

    fold, handle = folds.IntervalLedger(), Handle()
    fold.init(handle)
    slots = [{"slot": k, "midi": 60 + k, "cents": 10.0, "verdict": "clean"} for k in range(3)]
    lines = [(user, json.dumps({"attempt_no": n, "slots": slots})) for n in (3, 1, 0, 2) for user in range(folds.BLOCK)]
    out = []
    for part in (lines[:100], lines[100:], lines[:64]):
        out += list(fold.handleInputRows((0,), iter([pd.DataFrame(part, columns=["key", "row"])]), None))
    last = pd.concat(out).sort_values("version").groupby("user_id").last()
    assert len(last) == folds.BLOCK and set(last["clean"]) == {8} and set(last["version"]) == {4}
    assert handle.value.trips <= 5


def test_a_library_makes_its_slots_once(spark):
    """The parts of a document read the kept slots; each used to join the tables anew."""
    from strophe.plans import shelves

    plan = shelves._documents(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "verdict" in plan


def test_pairs_of_one_take_join_in_the_same_round(spark, monkeypatch):
    """Rounds are as many as the longest chain of dropouts needs, not as the take has pairs; none sends a table to the driver."""
    from test_notes import PERIOD, bare, ends, spans

    from strophe.config import Config
    from strophe.operators import merging

    pair = [76.0] * 20 + [-1.0] + [76.0] * 20 + [None] * 3
    frames = bare(spark, pair * 8).selectExpr("* except (smooth, voiced)", "if(smooth > 0, smooth, null) as smooth", "coalesce(smooth > 0, false) as voiced")
    measured = merging.measure(spans(spark, *[(44 * k + a, 44 * k + a + 19, 44 * k + a) for k in range(8) for a in (0, 21)]), frames, Config())
    written, kept = [], merging.kept
    monkeypatch.setattr(merging, "kept", lambda df, tag: written.append((tag, df._jdf.queryExecution().executedPlan().toString())) or kept(df, tag))
    joined = merging.join_to_fixpoint(measured, frames, Config(), PERIOD, merging.dropouts)
    assert ends(joined) == [(44 * k, 44 * k + 40, 44 * k) for k in range(8)]
    assert len([tag for tag, _ in written if tag == "marked"]) <= 3
    assert not [tag for tag, plan in written if "Broadcast" in plan]


@pytest.mark.parametrize("name", ["overlay_items", "verdict_chips", "echo_phrases", "octave_into_range"])
def test_shares_of_tasks_are_bounded(spark, monkeypatch, name):
    """With smaller shares there are more tasks, with the same rows, and the session's setting stays."""
    from strophe.operators import frames
    from strophe.plans import kernels, practice  # noqa: F401

    plain = QUERIES[name](spark, SF)
    wanted = rows(plain.toPandas())
    monkeypatch.setattr(frames, "TASK_ROWS", 600)
    parts = []
    if name == "octave_into_range":
        parts.append(QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString())
        assert "RepartitionByExpression [seq_id" in parts[0] and parts[0].split("RepartitionByExpression")[1].splitlines()[0].rstrip().endswith("10")
    from strophe.plans import views

    kept = views.kept
    monkeypatch.setattr(views, "kept", lambda df, tag: parts.append(spark.conf.get("spark.sql.shuffle.partitions")) or kept(df, tag))
    assert rows(QUERIES[name](spark, SF).toPandas()) == wanted
    assert name == "octave_into_range" or parts == ["10"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_a_sweep_prepares_frames_once(spark, monkeypatch):
    """Presets differ in tolerance and drift only, which no step before the drafts reads; another voicing has frames of its own."""
    from strophe.config import PRESETS, Config, override, preset
    from strophe.operators import notes

    asked = []
    monkeypatch.setattr(notes, "prepared", lambda frames, rate, config: asked.append(config) or config)
    monkeypatch.setattr(notes, "heard", lambda ready, rate, config: spark.createDataFrame([(str(ready.voicing.onset_db), config.segment.drift_cap)], "onset string, drift double"))
    configs = {name: preset(name) for name in PRESETS} | {"loud": override(Config(), {"voicing.onset_db": 20.0})}
    found = {r.config_id: (float(r.onset), r.drift) for r in notes.sweep(None, 48000, configs).collect()}
    assert len(asked) == 2
    assert found == {name: (c.voicing.onset_db, c.segment.drift_cap) for name, c in configs.items()}


def test_a_floor_goes_through_its_frames_once(spark):
    from strophe.operators import voicing

    rows = [(t, i, float((i * 29 + t) % 64) - 90, i % 5 == 0) for t in range(2) for i in range(60)]
    frames = spark.createDataFrame(rows, "take_id long, frame_idx long, band_rms_db double, tonal boolean")
    floored = voicing.with_floor(frames, window=9)
    assert floored.count() == len(rows)
    assert floored._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
