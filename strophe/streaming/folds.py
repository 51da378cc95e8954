"""Ledgers that grow attempt by attempt: ordered folds as stateful streams.

An attempt is one row (user_id, attempt_id, attempt_no, target_id, slots), numbered from 0 without gaps within
its key. Rows may come in any order, split over micro-batches in any way, and more than once: an attempt that is ahead waits
in state until those before it are folded, and one that was folded already changes nothing. Each key
gives out what it has changed, numbered by the attempts folded so far; ``newest`` keeps the last of these.
Rows without a key or a number are no attempts. State is each key's steps or slots and the attempts that wait, never an attempt's
history; a block of neighbouring keys has it as one JSON value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.practice import RAMP_HIGH, RAMP_LOW, VERDICTS

ALPHA = 0.25
#: Neighbouring keys whose states are one value; a power of two.
BLOCK = 64
SLOTS = "array<struct<slot:int,midi:int,cents:double,verdict:string>>"
LEDGER = f"user_id long, step int, {', '.join(f'{v} long' for v in VERDICTS)}, wrong_rate double, abs_cents double, observations long, cents_observations long, version long"
TALLIES = f"target_id long, slot int, attempts long, {', '.join(f'{v} long' for v in VERDICTS)}, since long, version long"
PROGRESS = "user_id long, length int, count long, offset double, wobble double, version long"


def attempts(slots: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """user_id, attempt_id, attempt_no, target_id, extra, slots: one row an attempt."""
    one = F.struct(F.col("slot").cast("int"), F.col("target_midi").cast("int").alias("midi"), F.col("residual_cents").cast("double").alias("cents"), "verdict")
    rows = slots.groupBy("user_id", "attempt_id", "attempt_no", "target_id").agg(F.array_sort(F.collect_list(one)).cast(SLOTS).alias("slots"))
    if extras is None:
        return rows.withColumn("extra", F.lit(0).cast("long"))
    n = extras.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("extra"))
    return rows.join(n, "attempt_id", "left").withColumn("extra", F.coalesce("extra", F.lit(0).cast("long")))


class OrderedFold(StatefulProcessor):
    """Hands the attempts of each key to ``fold`` in the order of their numbers, each once.

    The keys of a block (BLOCK neighbouring numbers) keep their states and waiting attempts in one value, read and
    written once for the block and micro-batch.
    """

    order = "attempt_no"
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.block = handle.getValueState("block", "keys string")

    def fresh(self) -> Any:
        """The state of a key before its first attempt, as JSON has it."""

    def fold(self, now: Any, row: dict[str, Any], changed: dict) -> None:
        """Takes one attempt into the state; changed gets what has to be given out."""

    def rows(self, key: int, now: Any, changed: dict, version: int) -> list[tuple]:
        """What changed, as rows."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.block.get()[0]) if self.block.exists() else {}
        met = set()
        for part in rows:
            for one, line in zip(part["key"].tolist(), part["row"].tolist()):
                own, row = kept.get(str(one)), json.loads(line)
                if own is None:
                    own = kept[str(one)] = {"due": 0, "ahead": {}, "now": self.fresh()}
                if row[self.order] >= own["due"]:
                    own["ahead"][str(row[self.order])] = row
                    met.add(one)
        out = []
        for one in sorted(met):
            own, changed = kept[str(one)], {}
            start = due = own["due"]
            while (row := own["ahead"].pop(str(due), None)) is not None:
                self.fold(own["now"], row, changed)
                due += 1
            own["due"] = due
            if due != start:
                out += self.rows(one, own["now"], changed, due)
        if met:
            self.block.update((json.dumps(kept),))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _mean(old: float | None, x: float) -> float:
    return x if old is None else old + ALPHA * (x - old)


class IntervalLedger(OrderedFold):
    """By user: counts of each directed interval, and the means of its wrong rate and aim, one step an attempt."""

    columns = _names(LEDGER)

    def fresh(self) -> dict:
        return {}

    def fold(self, now: dict, row: dict[str, Any], changed: dict) -> None:
        seen: dict[int, list] = {}
        before = None
        for s in row["slots"]:
            if before is not None:
                own = seen.setdefault(s["midi"] - before, [0, 0, 0, 0, 0.0])
                own[VERDICTS.index(s["verdict"])] += 1
                if s["verdict"] in ("clean", "off"):
                    own[4] += abs(s["cents"])
            before = s["midi"]
        for step, (clean, off, wrong, missing, cents) in seen.items():
            old = now.get(str(step)) or (0, 0, 0, 0, None, None)
            rate = _mean(old[4], wrong / (clean + off + wrong)) if clean + off + wrong else old[4]
            aim = _mean(old[5], cents / (clean + off)) if clean + off else old[5]
            now[str(step)] = changed[step] = (old[0] + clean, old[1] + off, old[2] + wrong, old[3] + missing, rate, aim)

    def rows(self, key: int, now: dict, changed: dict, version: int) -> list[tuple]:
        return [(key, step, clean, off, wrong, missing, rate or 0.0, aim or 0.0, clean + off + wrong, clean + off, version) for step, (clean, off, wrong, missing, rate, aim) in changed.items()]


class TargetTallies(OrderedFold):
    """By target: verdicts of each slot since the target last changed its length."""

    columns = _names(TALLIES)

    def fresh(self) -> dict:
        return {"length": None, "since": None, "slots": {}}

    def fold(self, now: dict, row: dict[str, Any], changed: dict) -> None:
        n = len(row["slots"])
        if now["length"] != n:
            changed.clear()  # what was counted was about another melody
            now |= {"length": n, "since": row[self.order], "slots": {}}
        for s in row["slots"]:
            old = now["slots"].get(str(s["slot"])) or (0,) * len(VERDICTS)
            now["slots"][str(s["slot"])] = changed[s["slot"]] = tuple(x + (v == s["verdict"]) for x, v in zip(old, VERDICTS))

    def rows(self, key: int, now: dict, changed: dict, version: int) -> list[tuple]:
        return [(key, slot, sum(counts), *counts, now["since"], version) for slot, counts in changed.items()]


class Progress(OrderedFold):
    """By user: the next phrase's length, and the averages of held notes that did not slide.

    A row holds ``got`` (whether the phrase was echoed; null: no phrase) and ``held`` (median, wobble; null: none).
    """

    columns = _names(PROGRESS)

    def fresh(self) -> dict:
        return {"length": RAMP_LOW, "count": 0, "offset": None, "wobble": None}

    def fold(self, now: dict, row: dict[str, Any], changed: dict) -> None:
        if row.get("got") is not None:
            now["length"] = max(RAMP_LOW, min(RAMP_HIGH, now["length"] + (1 if row["got"] else -1)))
        held = row.get("held")
        if held:
            now |= {"count": now["count"] + 1, "offset": _mean(now["offset"], held["median"]), "wobble": _mean(now["wobble"], max(0.0, held["wobble"]))}

    def rows(self, key: int, now: dict, changed: dict, version: int) -> list[tuple]:
        return [(key, now["length"], now["count"], now["offset"], now["wobble"], version)]


def _folded(rows: DataFrame, key: str, columns: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    own = rows.where(F.col(key).isNotNull() & F.col("attempt_no").isNotNull())
    lines = own.select(F.shiftright(F.col(key).cast("long"), BLOCK.bit_length() - 1).alias("block"), F.col(key).cast("long").alias("key"), F.to_json(F.struct(*columns)).alias("row"))
    return lines.groupBy("block").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def stream_ledger(stream: DataFrame) -> DataFrame:
    """Changes of every user's interval ledger, from a stream of attempts."""
    return _folded(stream, "user_id", ["attempt_no", "slots"], IntervalLedger(), LEDGER)


def stream_tallies(stream: DataFrame) -> DataFrame:
    """Changes of every target's tallies, from a stream of attempts numbered within their target."""
    return _folded(stream, "target_id", ["attempt_no", "slots"], TargetTallies(), TALLIES)


def stream_progress(stream: DataFrame) -> DataFrame:
    """Changes of every user's phrase length and held-note averages, from a stream (user_id, attempt_no, got, held)."""
    return _folded(stream, "user_id", ["attempt_no", "got", "held"], Progress(), PROGRESS)


def newest(log: DataFrame, *keys: str) -> DataFrame:
    """The last change of each key, without its version."""
    rest = [c for c in log.columns if c not in (*keys, "version")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*keys, "r.*")


def standing_tallies(log: DataFrame) -> DataFrame:
    """The last tallies of each slot, of those that count since the target's present length."""
    last = F.max("since").over(Window.partitionBy("target_id"))
    return newest(log, "target_id", "slot").withColumn("last", last).where("since = last").drop("since", "last")
