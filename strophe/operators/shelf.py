"""Whole practice documents of users: intervals, targets with their slots and history, held notes.

``documents`` puts them together, one JSON text a user, and ``read_documents`` takes them apart again. Reading is
one parse whose rows go to one of two sides: what is accepted, perhaps repaired, and what is rejected, with the
place and the reason. A document of another version is rejected whole; a bad entry alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .practice import HISTORY, STATS_VERSION, VERDICTS

def _entries(rows: DataFrame, by: list[str], key: str, value: Column, name: str) -> DataFrame:
    """by, and the map of key (as text) to value under name."""
    pair = F.struct(F.col(key).cast("string").alias("k"), value.alias("v"))
    return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias(name))


def documents(ledger: DataFrame, tallies: DataFrame, history: DataFrame, holds: DataFrame, owners: DataFrame) -> DataFrame:
    """key (user_id), document: ledger, tallies and history as practice has them, holds, owners (user_id, target_id).

    A user's entries are gathered: a row for each interval, and for each slot and attempt of the targets kept.
    """
    stat = F.struct("observations", *VERDICTS, F.col("abs_cents").alias("absCentsEwma"), F.col("cents_observations").alias("centsObservations"), F.col("wrong_rate").alias("wrongRateEwma"))
    intervals = _entries(ledger, ["user_id"], "step", stat, "intervals")
    slots = tallies.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("slot", "attempts", *VERDICTS))).alias("slots"))
    newest_first = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("attempt_no").alias("no"), "verdicts"))))
    past = history.groupBy("target_id").agg(newest_first.alias("history"))
    targets = _entries(owners.join(slots, "target_id").join(past, "target_id", "left"), ["user_id"], "target_id", F.struct("slots", "history"), "targets")
    held = holds.select("user_id", F.struct("count", "offset", "wobble").alias("holds"))
    users = owners.select("user_id").union(ledger.select("user_id")).union(holds.select("user_id")).distinct()
    whole = users.join(intervals, "user_id", "left").join(targets, "user_id", "left").join(held, "user_id", "left")
    body = F.struct(F.lit(STATS_VERSION).alias("version"), "intervals", "targets", "holds")
    return whole.select(F.col("user_id").alias("key"), F.to_json(body).alias("document"))


_NUMBERS = "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"
_ENTRY = "array<struct<kind:string,name:string,place:bigint,value:variant>>"


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _number(v: Column, path: str) -> Column:
    """A number as JSON has it, not one within a text; else null."""
    own = _field(v, path)
    return F.when(F.schema_of_variant(own).rlike(_NUMBERS), F.try_variant_get(own, "$", "double"))


def _object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "map<string,variant>")


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _entry(kind: str, name: Column, place: Column | None, value: Column) -> Column:
    at = F.lit(None) if place is None else place
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), at.cast("long").alias("place"), value.alias("value"))


def read_documents(shelf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected) of documents (key, document), from one parse.

    entries: key, kind (interval, slot, attempt, hold), name (step or target), place (of a slot or attempt), total
    (attempts or observations), VERDICTS, aimed, at, x, y (the means), verdicts, repaired. Counts that are no numbers or negative
    are 0 and means are held to their ranges, and repaired names these fields. rejected: key, place (a path), reason. Every
    entry is on one side; a document without entries is on neither.
    """
    parsed = shelf.select("key", F.try_parse_json("document").alias("v"))
    version = _number(F.col("v"), "$.version")
    whole = F.when(_object(F.col("v")).isNull(), "no object").when(version.isNull() | (version != STATS_VERSION), "another version")
    none = F.array().cast(_ENTRY)

    def fields(path: str, kind: str) -> Column:
        return F.coalesce(F.transform(F.map_entries(_object(F.col("v"), path)), lambda e: _entry(kind, e["key"], None, e["value"])), none)

    hold = F.when(_field(F.col("v"), "$.holds").isNotNull() & ~F.is_variant_null(_field(F.col("v"), "$.holds")), F.array(_entry("hold", F.lit("holds"), None, _field(F.col("v"), "$.holds"))))
    top = F.concat(fields("$.intervals", "interval"), fields("$.targets", "target"), F.coalesce(hold, none))
    outer = parsed.withColumn("whole", whole).select("key", "whole", F.explode_outer(F.when(F.col("whole").isNull(), top)).alias("e")).select("key", "whole", "e.*")

    kind, name, value = F.col("kind"), F.col("name"), F.col("value")
    listed = lambda path, tag: F.coalesce(F.transform(_list(value, path), lambda item, i: _entry(tag, name, i, item)), none)
    good = (kind == "target") & _list(value, "$.slots").isNotNull()
    inner = F.when(good, F.concat(listed("$.slots", "slot"), listed("$.history", "attempt"))).otherwise(F.array(F.struct(kind, name, F.col("place"), value)))
    flat = outer.select("key", "whole", F.explode_outer(inner).alias("e")).select("key", "whole", "e.*")

    one = lambda *kinds: F.col("kind").isin(*kinds)
    has = _object(F.col("value")).isNotNull()
    number = lambda f: _number(F.col("value"), f"$.{f}")
    count = lambda f: F.floor(F.when(number(f) >= 0, number(f)).otherwise(0.0)).cast("long")
    bad_count = lambda f: F.when(F.coalesce(number(f) < 0, F.lit(True)), F.lit(f))
    total = F.when(one("interval"), count("observations")).when(one("slot"), F.expr("0L")).when(one("hold"), count("count"))
    x = F.when(one("interval"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(number("wrongRateEwma"), F.lit(0.0))))).when(one("hold"), F.coalesce(number("offset"), F.lit(0.0)))
    y = F.when(one("interval"), F.greatest(F.lit(0.0), F.coalesce(number("absCentsEwma"), F.lit(0.0)))).when(one("hold"), F.greatest(F.lit(0.0), F.coalesce(number("wobble"), F.lit(0.0))))
    own = {"interval": ["observations", *VERDICTS, "centsObservations", "wrongRateEwma", "absCentsEwma"], "slot": list(VERDICTS), "hold": ["wobble"], "attempt": []}
    repaired = F.array()
    for k in ("interval", "slot", "hold"):
        bad = F.array_compact(F.array(*[bad_count(f) for f in own[k]], *([F.when(number("wrongRateEwma") > 1, F.lit("wrongRateEwma"))] if k == "interval" else [])))
        repaired = F.when(one(k), bad).otherwise(repaired.cast("array<string>"))
    step = F.expr("try_cast(name as double)")
    reason = (
        F.when(F.col("whole").isNotNull(), F.col("whole"))
        .when(F.col("kind").isNull(), F.lit(None))
        .when(one("interval") & F.coalesce(step != F.floor(step), F.lit(True)), "name is no whole number")
        .when(one("interval", "target", "attempt", "hold") & ~has, "no object")
        .when(one("target"), "no slots")
        .when(one("attempt") & (F.col("place") >= HISTORY), "older than the newest")
        .when(one("hold") & (count("count") == 0), "no holds")
    )
    judged = flat.select(
        "key", "whole", "kind", "name", "place", reason.alias("reason"), total.alias("total"), *[count(v).alias(v) for v in VERDICTS], F.when(one("interval"), count("centsObservations")).alias("aimed"),
        F.when(one("attempt"), count("no")).alias("at"), x.alias("x"), y.alias("y"), F.when(one("attempt"), F.coalesce(F.try_variant_get(F.col("value"), "$.verdicts", "string"), F.lit(""))).alias("verdicts"), repaired.alias("repaired"),
    )
    within = F.concat(F.lit("$."), F.col("kind"), F.lit("s."), F.col("name"))
    item = lambda part: F.concat(F.lit("$.targets."), F.col("name"), F.lit(f".{part}["), F.col("place").cast("string"), F.lit("]"))
    path = F.when(F.col("whole").isNotNull(), "$").when(one("hold"), "$.holds").when(one("slot"), item("slots")).when(one("attempt"), item("history")).otherwise(within)
    accepted = judged.where("reason is null and kind is not null").drop("whole", "reason").withColumn("total", F.when(one("slot"), F.expr(" + ".join(VERDICTS))).otherwise(F.col("total")))
    return accepted, judged.where("reason is not null").select("key", path.alias("place"), "reason")


def ledger_of(entries: DataFrame) -> DataFrame:
    """user_id, step and the ledger's columns of accepted entries."""
    own = entries.where("kind = 'interval'")
    return own.select(F.col("key").alias("user_id"), F.col("name").cast("int").alias("step"), *VERDICTS, F.col("total").alias("observations"), F.col("aimed").alias("cents_observations"), F.col("x").alias("wrong_rate"), F.col("y").alias("abs_cents"))


def tallies_of(entries: DataFrame) -> DataFrame:
    """target_id, slot, attempts, counts of accepted entries."""
    return entries.where("kind = 'slot'").select(F.expr("try_cast(name as bigint)").alias("target_id"), F.col("place").cast("int").alias("slot"), F.col("total").alias("attempts"), *VERDICTS)


def history_of(entries: DataFrame) -> DataFrame:
    """target_id, attempt_no, verdicts of accepted entries."""
    return entries.where("kind = 'attempt'").select(F.expr("try_cast(name as bigint)").alias("target_id"), F.col("at").cast("int").alias("attempt_no"), "verdicts")


def holds_of(entries: DataFrame) -> DataFrame:
    """user_id, count, offset, wobble of accepted entries."""
    return entries.where("kind = 'hold'").select(F.col("key").alias("user_id"), F.col("total").alias("count"), F.col("x").alias("offset"), F.col("y").alias("wobble"))
