"""Live trails of recording sessions: a newer session overtakes an older one, a take ends by itself.

Points are rows (source_id, token, at, midi): a source's sessions have growing tokens, a null pitch is silence.
Runs of silence are one break, the newest ``most`` points stay, and a take ends ``most_sec`` after its
first point. A session's trail is given out when its take has ended: by the first row that shows it, or by a timer
once the watermark has passed. A session that a newer one overtakes before that gives out nothing, then or
later. Rows without a source or a token belong to none. Rows come in the order of their times, but for rows of one micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.melody import live_trail

MOST_POINTS = 6000
MOST_SEC = 60.0
TRAIL = "source_id long, token long, n long, at_us long, midi double"
TRAIL_COLUMNS = [c.split()[0] for c in TRAIL.split(", ")]


class LiveTrail(StatefulProcessor):
    """One source. A micro-batch reads and writes its state once: sessions that begin and end within it leave no points and no timer there."""

    def __init__(self, most: int, most_us: int) -> None:
        self.most, self.most_us = most, most_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "token long, end long, held long, silent boolean, open boolean")
        self.points = handle.getListState("points", "at_us long, midi double")

    def _take(self) -> list[tuple]:
        """The points in state, which is empty then."""
        stored = [tuple(p) for p in self.points.get()]
        self.points.clear()
        return stored

    def _given(self, key: Any, token: int, trail: list[tuple]) -> list[tuple]:
        return [(key[0], token, i, at, midi) for i, (at, midi) in enumerate(trail[-self.most :])]

    def _store(self, added: list[tuple], held: int) -> int:
        """Appends points; the list is cut to its newest only when it has grown to twice as many."""
        if held + len(added) > 2 * self.most:
            added = ((self._take() if held else []) + added)[-self.most :]
            self.points.put(added)
            return len(added)
        if added:
            self.points.appendList(added)
        return held + len(added)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        token, end, held, silent, open_ = before = self.session.get() or (None, 0, 0, False, False)
        timer = end // 1000 + 1 if open_ else None  # of the session that was open, while it is registered
        added: list[tuple] = []
        out: list[tuple] = []
        every = [row for part in rows for row in zip(part["token"].tolist(), part["at_us"].tolist(), part["midi"].tolist(), strict=True)]
        for t, at, midi in sorted(every, key=itemgetter(1)):
            if token is not None and t < token:
                continue  # of a session that was overtaken
            if open_ and at >= end:
                out += self._given(key, token, (self._take() if held else []) + added)
                added, open_, held = [], False, 0
            if token is None or t > token:
                if open_ and held:
                    self.points.clear()
                added = []
                token, end, held, silent, open_ = t, at + self.most_us, 0, False, True
            if not open_:
                continue  # the take has ended
            if midi is None or midi != midi:
                if silent:
                    continue
                added.append((at, None))
                silent = True
            else:
                added.append((at, float(midi)))
                silent = False
        held = self._store(added, held) if open_ else 0
        due = end // 1000 + 1 if open_ else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if (now := (token, end, held, silent, open_)) != before:
            self.session.update(now)
        if out:
            yield pd.DataFrame(out, columns=TRAIL_COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        token, end, held, _, open_ = self.session.get()
        if open_ and expiredTimerInfo.getExpiryTimeInMs() > end // 1000:
            trail = self._given(key, token, self._take() if held else [])
            self.session.update((token, end, 0, False, False))
            yield pd.DataFrame(trail, columns=TRAIL_COLUMNS)

    def close(self) -> None:
        pass


def stream_trails(stream: DataFrame, most: int = MOST_POINTS, most_sec: float = MOST_SEC) -> DataFrame:
    """Trails of the sessions of a watermarked stream (source_id, token, at, midi), each as its take ends."""
    # a null key would turn all keys of its batch into floats
    rows = stream.where("source_id is not null and token is not null").select("source_id", "token", F.unix_micros("at").alias("at_us"), F.col("midi").cast("double").alias("midi"))
    return rows.groupBy("source_id").transformWithStateInPandas(statefulProcessor=LiveTrail(most, int(most_sec * 1e6)), outputStructType=TRAIL, outputMode="Append", timeMode="EventTime")


def ended_trails(points: DataFrame, most: int = MOST_POINTS, most_sec: float = MOST_SEC) -> DataFrame:
    """The same trails of a table: sessions of each source that no newer one overtook before their end."""
    rows = points.where("source_id is not null and token is not null").select("source_id", "token", F.unix_micros("at").alias("at_us"), F.col("midi").cast("double").alias("midi"))
    began = rows.groupBy("source_id", "token").agg((F.min("at_us") + int(most_sec * 1e6)).alias("end"))
    by = Window.partitionBy("source_id").orderBy("token")
    later = F.lead(F.col("end") - int(most_sec * 1e6)).over(by)
    kept = began.withColumn("next", later).where("next is null or next >= end").select("source_id", "token", "end")
    own = rows.join(kept, ["source_id", "token"]).where("at_us < end")
    take = F.struct("source_id", "token").alias("take_id")
    trail = live_trail(own.select(take, F.col("at_us").alias("frame_idx"), "midi"), most)
    n = F.row_number().over(Window.partitionBy("take_id").orderBy("frame_idx")) - 1
    return trail.select("take_id.*", n.cast("long").alias("n"), F.col("frame_idx").alias("at_us"), "midi")
