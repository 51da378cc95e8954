"""Series, notes, attempts and slots derived from the driver's tables; the same SQL serves both engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.frames import task_shares
from ..operators.merging import kept

TABLES = ("events", "lineitem", "orders")

VIEWS = {
    "frames_ev": """
        select take_id, cast(row_number() over (partition by take_id order by ts, event_id) - 1 as int) as frame_idx, event_id,
               case when event_type = 'error' then cast(null as double) else cast(400 + (event_id * 37) % 4096 as double) end as hz,
               cast((event_id * 13) % 64 as double) / 64 as clarity, cast((event_id * 7) % 40 as double) as snr_db,
               cast((event_id * 11) % 32 as double) as peak_to_second_db, cast((event_id * 29) % 64 as double) / 2 - 90 as band_rms_db,
               event_type = 'signup' as clipped
        from (select user_id as take_id, * from events)""",
    "points_ev": """
        select user_id as source_id, event_id, ts, case when event_type in ('error', 'view') then cast(null as double) else cast(400 + (event_id * 37) % 4096 as double) end as hz
        from events""",
    "notes_li": """
        select seq_id, cast(row_number() over (partition by seq_id order by l_linenumber, l_partkey, l_suppkey) - 1 as int) as pos,
               cast(60 + cast(floor(l_quantity) as bigint) % 24 as int) as midi, cast(l_partkey % 100 - 50 as double) as cents_offset,
               cast(1 + l_suppkey % 8 as double) / 8 as dur_sec
        from (select l_orderkey as seq_id, * from lineitem)""",
    "attempts_o": """
        select user_id, o_orderkey as attempt_id, cast(row_number() over (partition by user_id order by o_orderdate, o_orderkey) - 1 as int) as attempt_no,
               first_value(o_orderkey) over (partition by user_id order by o_orderdate, o_orderkey) as target_id
        from (select o_custkey as user_id, * from orders)""",
    "slots_zip": """
        select a.user_id, a.attempt_id, a.attempt_no, a.target_id, t.pos as slot, t.midi as target_midi,
               t.midi - lag(t.midi) over (partition by a.attempt_id order by t.pos) as step, (s.midi - t.midi) * 100 + s.cents_offset as residual_cents,
               case when s.midi is null then 'missing' when abs((s.midi - t.midi) * 100 + s.cents_offset) < 30 then 'clean'
                    when abs((s.midi - t.midi) * 100 + s.cents_offset) < 70 then 'off' else 'wrong' end as verdict
        from attempts_o a join notes_li t on t.seq_id = a.target_id left join notes_li s on s.seq_id = a.attempt_id and s.pos = t.pos""",
    "notes_timed": """
        select seq_id, pos, midi, cents_offset, dur_sec, reached - dur_sec as start_sec, reached as end_sec
        from (select *, sum(dur_sec + gap) over (partition by seq_id order by pos rows unbounded preceding) as reached
              from (select *, case when pos = 0 then 0.0 else cast((midi * 5 + pos) % 12 as double) / 8 end as gap from notes_li))""",
    "aligned_o": """
        select a.user_id, a.attempt_id, a.attempt_no, a.target_id, t.pos as slot, t.midi as target_midi, s.pos as attempt_idx, s.midi as sung_midi, s.cents_offset,
               (s.midi - t.midi) * 100 + s.cents_offset as residual_cents, s.start_sec, s.end_sec,
               case when s.midi is null then 'missing' when abs((s.midi - t.midi) * 100 + s.cents_offset) < 30 then 'clean'
                    when abs((s.midi - t.midi) * 100 + s.cents_offset) < 70 then 'off' else 'wrong' end as verdict
        from attempts_o a join notes_li t on t.seq_id = a.target_id
             left join notes_timed s on s.seq_id = a.attempt_id and s.pos = t.pos and (s.pos + a.attempt_id) % 4 <> 0""",
    "extras_o": """
        select a.user_id, a.attempt_id, a.attempt_no, a.target_id, cast(least(s.pos, n.n) - 1 as int) as after_slot, s.pos as attempt_idx, s.midi as sung_midi, s.cents_offset, s.start_sec, s.end_sec
        from attempts_o a join notes_timed s on s.seq_id = a.attempt_id join (select seq_id, count(*) as n from notes_li group by seq_id) n on n.seq_id = a.target_id
        where (s.pos + a.attempt_id) % 4 = 0 or s.pos >= n.n""",
    "midi_li": """
        select cast(floor(l_orderkey / 16) as bigint) as file, cast(l_linenumber % 2 as int) as track_idx, case when l_linenumber % 2 = 1 then 'Flute' else '' end as track_name,
               cast(case when l_suppkey % 5 = 0 then 9 else l_suppkey % 2 end as int) as channel, cast(48 + cast(floor(l_quantity) as bigint) % 36 as int) as midi,
               cast(l_partkey % 96 as double) / 64 as start_sec, cast(l_partkey % 96 + 1 + l_suppkey % 32 as double) / 64 as end_sec
        from lineitem""",
}


def _needed(name: str, found: dict[str, str]) -> dict[str, str]:
    """name's view and those it reads, in an order that defines each before its use."""
    for other, sql in VIEWS.items():
        if other != name and re.search(rf"\b{other}\b", VIEWS[name]) and other not in found:
            _needed(other, found)
    return found | {name: found.setdefault(name, VIEWS[name])}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the session's catalog is left as it is."""
    parts: dict[str, str] = {}
    _needed(name, parts)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", " ".join(parts.values()))]
    tables = {t: f"select * from parquet.`{sf_dir}/{t}.parquet`" for t in used}
    return spark.sql("with " + ", ".join(f"{n} as ({sql})" for n, sql in (tables | parts).items()) + f" select * from {name}")


def with_views(sql: str, *names: str) -> str:
    """DuckDB's form of a query over the named views and those they read."""
    parts: dict[str, str] = {}
    for name in names:
        if name not in parts:
            _needed(name, parts)
    return "with " + ", ".join(f"{n} as ({own})" for n, own in parts.items()) + sql


_PARTS, _COALESCE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"


def in_shares(made: Callable[[], DataFrame], spark: SparkSession, sf_dir: str, tag: str) -> DataFrame:
    """What made gives over the notes, written and read again, by shuffles of as many parts as the notes need: a task's share,
    and what it holds or spills, does not grow with the tables. Where the session's parts are too few, Spark must not join
    small parts again, as it would until there are only as many as cores. The session's settings are as before afterwards."""
    before = {c: spark.conf.get(c) for c in (_PARTS, _COALESCE)}
    parts = str(task_shares(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()))
    if parts != before[_PARTS]:
        spark.conf.set(_PARTS, parts)
        spark.conf.set(_COALESCE, "false")
    try:
        return kept(made(), tag)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
