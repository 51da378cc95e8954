"""The reference's operators: every query against its SQL, and the windowed forms against plain loops."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from strophe.plans import kernels, practice  # noqa: F401  they add their queries
from strophe.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def table(rel):
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: "null" if v is None or v != v else f"{float(v):.6f}" if type(v).__name__ in ("float", "Decimal") else str(v)
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    plain = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(plain(v) for v in r) for r in frame.select(*names).collect())
    assert (names, got) == table(duck.sql(ORACLE_SQL[name]))


def test_gate_equals_a_scan(spark):
    own = {(r.take_id, r.frame_idx): r for r in QUERIES["hysteresis_gate"](spark, SF).collect()}
    from strophe.plans.queries import _frames

    on, last = False, None
    for r in sorted(_frames(spark, SF).collect(), key=lambda r: (r.take_id, r.frame_idx)):
        on = on and r.take_id == last
        last = r.take_id
        on = bool(r.tonal) and r.band_rms_db >= (-70 if on else -68)
        assert own[r.take_id, r.frame_idx].voiced == on


def test_gate_below_its_sustain_is_scanned(spark):
    from pyspark.sql import functions as F

    from strophe.operators.frames import with_gate
    from strophe.plans.queries import _frames

    own = _frames(spark, SF).withColumn("candidate", F.col("tonal"))
    got = {(r.take_id, r.frame_idx): r.voiced for r in with_gate(own, F.lit(-80.0), onset=12.0, sustain=16.0).collect()}
    on, last = False, None
    for r in sorted(own.collect(), key=lambda r: (r.take_id, r.frame_idx)):
        on = on and r.take_id == last
        last = r.take_id
        on = bool(r.tonal) and r.band_rms_db >= (-64 if on else -68)
        assert got[r.take_id, r.frame_idx] == on


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
