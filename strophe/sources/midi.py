"""Standard MIDI files: notes of every track in seconds, with one tempo map for all tracks."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MIDI_NOTES = "file string, track_idx int, track_name string, channel int, midi int, start_sec double, end_sec double, error string"

# Fixed values of the format: most bytes of a file and of a number, the tempo before any change.
MOST_BYTES, NUMBER_BYTES, USUAL_TEMPO = 2 * 1024 * 1024, 4, 500_000


class MidiError(ValueError):
    """code: NOT_MIDI or DAMAGED."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of variable length and the place after it."""
    value = 0
    for k in range(NUMBER_BYTES):
        if at + k >= len(data):
            raise MidiError("DAMAGED", "a number is cut off")
        value = value << 7 | data[at + k] & 0x7F
        if data[at + k] < 0x80:
            return value, at + k + 1
    raise MidiError("DAMAGED", "a number of more than four bytes")


def _events(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tick, status, payload) of a track; a status of 0xFF has its kind as the payload's first byte."""
    at, tick, running = 0, 0, 0
    while at < len(data):
        delta, at = _number(data, at)
        tick += delta
        if at >= len(data):
            raise MidiError("DAMAGED", "an event is cut off")
        if data[at] >= 0x80:
            status, at = data[at], at + 1
        elif running:
            status = running
        else:
            raise MidiError("DAMAGED", "data without a status")
        if status >= 0xF0:
            running = 0
            kind = b""
            if status == 0xFF:
                kind, at = data[at : at + 1], at + 1
            if status not in (0xFF, 0xF0, 0xF7):
                raise MidiError("DAMAGED", "a message that no file holds")
            size, at = _number(data, at)
        else:
            running, kind = status, b""
            size = 1 if status & 0xE0 == 0xC0 else 2
        if at + size > len(data):
            raise MidiError("DAMAGED", "an event is cut off")
        if status < 0xF0 and max(data[at : at + size]) >= 0x80:
            raise MidiError("DAMAGED", "a status in the place of data")
        yield tick, status, kind + data[at : at + size]
        at += size


def read_track(data: bytes) -> tuple[str, list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """The track's name, notes (start tick, end tick, channel, midi) and tempo changes (tick, microseconds)."""
    name, notes, tempo, last = "", [], [], 0
    open_notes: dict[tuple[int, int], deque] = defaultdict(deque)
    for tick, status, body in _events(data):
        last = tick
        if status == 0xFF:
            if body[:1] == b"\x2f":
                break
            if body[:1] == b"\x03" and not name:
                name = body[1:].decode("utf-8", "replace").strip()
            elif body[:1] == b"\x51" and len(body) == 4 and any(body[1:]):
                tempo.append((tick, int.from_bytes(body[1:], "big")))
        elif status & 0xE0 == 0x80:
            key = status & 0x0F, body[0]
            if status & 0xF0 == 0x90 and body[1]:
                open_notes[key].append(tick)
            elif open_notes[key]:
                notes.append((open_notes[key].popleft(), tick, *key))
    notes += [(start, last, *key) for key, starts in open_notes.items() for start in starts]
    return name, sorted(notes, key=lambda n: (n[0], n[3])), tempo


class TempoMap:
    """Seconds of ticks: the last change at or before a tick holds; of changes at one tick the later given."""

    def __init__(self, division: int, changes: list[tuple[int, int]]):
        if division & 0x8000:
            self.fixed = 1.0 / ((256 - (division >> 8)) * (division & 0xFF) or 1)
            return
        self.fixed = None
        if not division:
            raise MidiError("DAMAGED", "a division of zero")
        latest = {0: USUAL_TEMPO} | dict(sorted(changes, key=lambda c: c[0]))
        self.ticks = sorted(latest)
        self.each = [latest[t] / 1e6 / division for t in self.ticks]
        self.seconds = [0.0]
        for k in range(1, len(self.ticks)):
            self.seconds.append(self.seconds[-1] + (self.ticks[k] - self.ticks[k - 1]) * self.each[k - 1])

    def at(self, tick: int) -> float:
        if self.fixed is not None:
            return tick * self.fixed
        k = bisect_right(self.ticks, tick) - 1
        return self.seconds[k] + (tick - self.ticks[k]) * self.each[k]


def parse_midi(data: bytes) -> list[tuple[int, str, int, int, float, float]]:
    """(track, name, channel, midi, start, end) of every note, by track and start."""
    if len(data) > MOST_BYTES:
        raise MidiError("DAMAGED", "more than 2 MB")
    if len(data) < 14 or data[:4] != b"MThd":
        raise MidiError("NOT_MIDI", "no MThd chunk")
    size, form, _, division = struct.unpack_from(">IHHH", data, 4)
    tracks, at = [], 8 + size
    while at + 8 <= len(data):
        length = struct.unpack_from(">I", data, at + 4)[0]
        if data[at : at + 4] == b"MTrk":
            if at + 8 + length > len(data):
                raise MidiError("DAMAGED", "a track is cut off")
            tracks.append(read_track(data[at + 8 : at + 8 + length]))
        at += 8 + length
    # of changes at one tick the first track's holds, so it comes last
    shared = TempoMap(division, [c for _, _, tempo in reversed(tracks) for c in tempo])
    out = []
    for k, (name, notes, tempo) in enumerate(tracks):
        own = TempoMap(division, tempo) if form == 2 else shared
        out += [(k, name, channel, midi, own.at(start), own.at(end)) for start, end, channel, midi in notes]
    return out


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    """Notes of the files under path. A file that cannot be read is one row with its error."""
    names = [c.split()[0] for c in MIDI_NOTES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(name, *note, None) for note in parse_midi(content)]
                except MidiError as e:
                    rows.append((name, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("track_idx", "channel", "midi")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, MIDI_NOTES)
