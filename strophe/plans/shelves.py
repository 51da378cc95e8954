"""Queries over whole practice documents: written to a library in one step, read back, sorted into good and bad."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import practice, shelf
from ..operators.merging import kept
from ..sources.blocks import local_path
from ..sources.library import read_library, write_library
from ..streaming.run import shared_path
from .practice import _EACH, _HISTORY, _SHORT, _nine, _shorter, _slots
from .queries import _frames, query

_HOLDS = """, h as (select take_id as user_id, frame_idx as place, clarity * 200 - 100 as median, snr_db - 10 as wobble, peak_to_second_db * 2 as drift from frames_ev),
        k as (select *, row_number() over (partition by user_id order by place) as i, count(*) over (partition by user_id) as n from h where not (abs(drift) >= 25 and abs(drift) > wobble))
        select user_id, count(*) as count, round(sum(median * pow(0.75, n - i) * (case when i = 1 then 1 else 0.25 end)), 6) + 0.0 as "offset", round(sum(greatest(0.0, wobble) * pow(0.75, n - i) * (case when i = 1 then 1 else 0.25 end)), 6) + 0.0 as wobble from k group by user_id"""


_USED = ["user_id", "attempt_id", "attempt_no", "target_id", "slot", "target_midi", "residual_cents", "verdict"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = kept(_slots(spark, sf_dir).select(*_USED), "slots")  # four parts of a document are made of them
    short = _shorter(slots)
    holds = _frames(spark, sf_dir).select(F.col("take_id").alias("user_id"), F.col("frame_idx").alias("at"), (F.col("clarity") * 200 - 100).alias("median"), (F.col("snr_db") - 10).alias("wobble"), (F.col("peak_to_second_db") * 2).alias("drift"))
    owners = slots.select("user_id", "target_id").distinct()
    short = kept(short, "short")
    return shelf.documents(practice.interval_ledger(slots), practice.target_tallies(short), practice.attempt_history(short).select("target_id", "attempt_no", "verdicts"), practice.hold_averages(holds), owners)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a library gives back of the documents of all users."""
    path = local_path(shared_path(spark, "library"))
    write_library(_documents(spark, sf_dir), path)
    return shelf.read_documents(read_library(spark, path))[0]


@query(f', {_EACH} select user_id, step, clean, "off", wrong, missing, observations, cents_observations, round(wrong_rate, 6) + 0.0 as wrong_rate, round(abs_cents, 6) + 0.0 as abs_cents from ledger', "aligned_o")
def library_ledger(spark, sf_dir):
    own = shelf.ledger_of(_entries(spark, sf_dir))
    return own.withColumns({c: _nine(c) for c in ("wrong_rate", "abs_cents")})


@query(f', {_SHORT} select target_id, slot, attempts, clean, "off", wrong, missing from u', "aligned_o")
def library_tallies(spark, sf_dir):
    return shelf.tallies_of(_entries(spark, sf_dir))


@query(f", {_HISTORY} select target_id, attempt_no, verdicts from aged where age <= 20", "aligned_o")
def library_history(spark, sf_dir):
    return shelf.history_of(_entries(spark, sf_dir))


@query(_HOLDS, "frames_ev")
def library_holds(spark, sf_dir):
    own = shelf.holds_of(_entries(spark, sf_dir))
    return own.withColumns({c: _nine(c) for c in ("offset", "wobble")})


# what a damaged shelf holds: a user's order makes a small document, some of which are bad in one way or another


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.expr("o_orderkey % 7").alias("way"), F.expr("o_custkey % 25 - 12").alias("step"), F.expr("o_orderkey % 5").alias("n"))
    entry = lambda n: f"""concat('{{"observations":', {n}, ',"clean":', {n}, ',"off":0,"wrong":0,"missing":-1,"centsObservations":"2","wrongRateEwma":1.5,"absCentsEwma":3}}')"""
    text = f"""case way when 0 then 'no json' when 1 then concat('{{"version":2,"intervals":{{"', step, '":', {entry("n")}, '}}}}')
        when 2 then concat('{{"version":1,"intervals":{{"', step, '":7,"x', step, '":', {entry("n")}, '}}}}')
        when 3 then concat('{{"version":1,"targets":{{"', key, '":{{"slots":[{{"clean":', n, ',"wrong":1}},null],"history":[{{"no":', n, ',"verdicts":"c-"}},5]}},"7":{{}}}}}}')
        when 4 then concat('{{"version":1,"holds":{{"count":', n, ',"offset":-2.5,"wobble":-1}}}}')
        else concat('{{"version":1,"intervals":{{"', step, '":', {entry("n")}, '}}}}') end"""
    return orders.select("key", F.expr(text).alias("document"))


@query("""with d as (select o_orderkey as key, o_orderkey % 7 as way, o_custkey % 25 - 12 as step, o_orderkey % 5 as n from orders)
        select key, 'interval' as kind, cast(step as varchar) as name, cast(null as bigint) as place, n as total, n as clean, 0 as wrong, 1.0::double as x, 3.0::double as y, 'missing,centsObservations,wrongRateEwma' as repaired from d where way >= 5
        union all select key, 'slot', cast(key as varchar), 0, n + 1, n, 1, null, null, 'off,missing' from d where way = 3
        union all select key, 'slot', cast(key as varchar), 1, 0, 0, 0, null, null, 'clean,off,wrong,missing' from d where way = 3
        union all select key, 'attempt', cast(key as varchar), 0, null, 0, 0, null, null, '' from d where way = 3
        union all select key, 'hold', 'holds', null, n, 0, 0, -2.5::double, 0.0::double, 'wobble' from d where way = 4 and n > 0""")
def salvaged_entries(spark, sf_dir):
    accepted, _ = shelf.read_documents(_damaged(spark, sf_dir))
    return accepted.select("key", "kind", "name", "place", "total", "clean", F.col("wrong").cast("int").alias("wrong"), "x", "y", F.array_join("repaired", ",").alias("repaired"))


@query("""with d as (select o_orderkey as key, o_orderkey % 7 as way, o_custkey % 25 - 12 as step, o_orderkey % 5 as n from orders)
        select key, '$' as place, case when way = 0 then 'no object' else 'another version' end as reason from d where way < 2
        union all select key, '$.intervals.' || step, 'no object' from d where way = 2
        union all select key, '$.intervals.x' || step, 'name is no whole number' from d where way = 2
        union all select key, '$.targets.' || key || '.history[1]', 'no object' from d where way = 3
        union all select key, '$.targets.7', 'no slots' from d where way = 3 and key <> 7
        union all select key, '$.holds', 'no holds' from d where way = 4 and n = 0""")
def quarantined_entries(spark, sf_dir):
    return shelf.read_documents(_damaged(spark, sf_dir))[1]
