"""Frames to notes on signals whose notes are known: single cases, grids of shapes with budgets, melodies at random.

All signals are takes of one table, and one chain of plans hears them all.
"""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strophe.config import Analysis, Config, override
from strophe.operators import analysis, merging, notes
from strophe.sources import generator
from strophe.sources.generator import Tone, uniforms

RATE = 48000
PERIOD = 512 / RATE
MELODIES = [[88, 90, 88, 91, 88], [84, 86, 88, 89, 91], [88, 87, 88, 87, 88], [91, 89, 88, 86, 84], [88, 91, 88, 91, 88]]


def legato(pitches, cents, hz, seconds=0.4):
    return [Tone(m, seconds, vibrato=cents, vibrato_hz=hz) for m in pitches]


def random_melody(seed):
    """A melody of scooped notes, each another pitch than the one before."""
    draw = uniforms(seed)
    at, out = 84 + int(next(draw) * 6), []
    for _ in range(4 + int(next(draw) * 3)):
        out.append(Tone(at, 0.3 + next(draw) * 0.25, 0.08 + next(draw) * 0.12, glide_in=-round(80 + next(draw) * 180), glide_ms=round(80 + next(draw) * 170)))
        step = 1 + int(next(draw) * 5)
        moved = max(79, min(95, at + (step if next(draw) < 0.5 else -step)))
        at = moved if moved != at else at + 1
    return out


def masked(gap, seed=5):
    """Two notes of one pitch, and between them a burst louder than they are, in a quiet room."""
    n = int(RATE * (2.8 + gap))
    x = generator.noise(n, seed, -60.0)
    a, b = int(1.6 * RATE), int((1.6 + gap) * RATE)
    x[a:b] += generator.noise(n, seed + 1, -6.0)[a:b]
    for at in (1.0, 1.6 + gap):
        own = generator.tone(Tone(88, 0.6, amplitude=0.25), RATE)
        start = int(at * RATE)
        x[start : start + len(own)] += own
    return x


SCOOPS = {f"scoop-{c}-{ms}-{v}": [Tone(88, 0.5, glide_in=-c, glide_ms=ms, vibrato=v, vibrato_hz=5.5)] for c in (100, 150, 200, 250, 300) for ms in (80, 100, 120, 140, 160, 200) for v in (0, 20, 30, 40, 50)}
LEGATO = {f"legato-{k}-{c}-{hz}": legato(m, c, hz) for k, m in enumerate(MELODIES) for c in (40, 50, 60, 70, 80) for hz in (4, 4.5, 5, 5.5, 6)}
CENTRE = {f"centre-{c}-{hz}": legato([84, 86, 88, 90, 92, 94], c, hz, 0.35) for c in (50, 60, 70) for hz in (4.5, 5, 5.5)} | {f"centre-{c}": legato([84, 85, 86, 87, 88, 89], c, 5, 0.3) for c in (50, 60, 70, 80)}
FUZZ = {f"fuzz-{k}": random_melody(1000 + k) for k in range(60)}
CASES = {
    "melody": [Tone(m, 0.4, gap=0.1) for m in (76, 79, 83, 79, 76)],
    "tuned": [Tone(m, 0.5, detune=20) for m in (76, 79, 76, 81)],
    "vibrato": [Tone(80, 1.2, vibrato=60)],
    "wide": [Tone(88, 1.6, vibrato=200, vibrato_hz=4)],
    "drifting": [Tone(88, 1.2, detune=-60, drift=150)],
    "blip": [Tone(76, 0.5, gap=0.6), Tone(88, 0.06)],
    "slide": [Tone(84, 0.5), Tone(96, 0.6, glide_in=-1200, glide_ms=120)],
}
GAPS = [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.45, 0.5, 0.6, 0.8, 1.0]


def frames_of(takes):
    parts = []
    for name, x in takes.items():
        f = analysis.frames_of(x, RATE, Analysis())
        f.insert(0, "take_id", name)
        parts.append(f)
    return pd.concat(parts)


def table(spark, takes):
    return spark.createDataFrame(frames_of(takes)).withColumn("hz", F.when(~F.isnan("hz"), F.col("hz"))).repartition(4)


@pytest.fixture(scope="module")
def heard(spark):
    quiet = np.random.default_rng(3).normal(0, 10 ** (-75 / 20), RATE * 8)
    takes = {}
    for name, tones in (SCOOPS | LEGATO | CENTRE | FUZZ | CASES).items():
        lead = 0.5 if name in CASES else 0.4 if name in SCOOPS else 0.3
        x = generator.melody(tones, RATE, lead=lead, tail=lead)[0]
        takes[name] = x + quiet[: len(x)] if name in CASES else x
    takes |= {f"masked-{g}": masked(g) for g in GAPS} | {"silence": np.zeros(RATE), "hiss": generator.noise(RATE, 3, -25.0)}
    rows = notes.transcribe(table(spark, takes), RATE).toPandas().sort_values(["take_id", "note_idx"])
    return {name: rows[rows.take_id == name] for name in takes}


def wrong(heard, cases):
    return [name for name, tones in cases.items() if heard[name].midi.tolist() != [t.midi for t in tones]]


def test_melody(heard):
    got, truth = heard["melody"], generator.melody(CASES["melody"], RATE, lead=0.5)[1]
    assert got.midi.tolist() == [76, 79, 83, 79, 76] and got.note_name.tolist() == ["E5", "G5", "B5", "G5", "E5"]
    assert np.abs(got.start_sec - [t[1] for t in truth]).max() < 0.05 and np.abs(got.duration_sec - 0.4).max() < 0.06
    assert got.note_idx.tolist() == [0, 1, 2, 3, 4] and (got.confidence > 0.8).all() and got.cents_offset.abs().max() < 5
    assert got.gap_before_sec.iloc[0] == got.start_sec.iloc[0] and np.allclose(got.gap_before_sec.iloc[1:], got.start_sec.iloc[1:].to_numpy() - got.end_sec.iloc[:-1].to_numpy())


def test_tuning_is_taken_out(heard):
    got = heard["tuned"]
    assert got.midi.tolist() == [76, 79, 76, 81] and abs(got.tuning_offset_cents.iloc[0] - 20) < 2 and got.cents_offset.abs().max() < 3


def test_single_notes(heard):
    assert heard["vibrato"].midi.tolist() == [80] and heard["wide"].midi.tolist() == [88]
    assert heard["drifting"].midi.tolist() == [88] and heard["drifting"].drifted.tolist() == [True]
    assert heard["blip"].midi.tolist() == [76] and heard["slide"].midi.tolist() == [84, 96]
    assert len(heard["silence"]) == 0 and len(heard["hiss"]) == 0


def test_scoops_over_a_grid(heard):
    assert len(wrong(heard, SCOOPS)) <= 2, wrong(heard, SCOOPS)
    deep = heard["scoop-200-200-0"]
    assert deep.glided_in.tolist() == [True] and deep.cents_offset.abs().max() < 20


def test_legato_through_vibrato(heard):
    assert len(wrong(heard, LEGATO)) <= 5, wrong(heard, LEGATO)
    assert wrong(heard, CENTRE) == []


def test_random_melodies(heard):
    assert len(wrong(heard, FUZZ)) <= 1, wrong(heard, FUZZ)


def test_masked_gaps(heard):
    counts = {g: len(heard[f"masked-{g}"]) for g in GAPS}
    assert all(n == (1 if g <= 0.35 else 2) for g, n in counts.items()), counts


def test_settings_reach_the_plan(spark):
    frames = table(spark, {"far": masked(0.6), "low": generator.melody([Tone(88, 1.2, detune=-60, drift=150)], RATE, lead=0.5, tail=0.5)[0]})
    wide = override(Config(), {"segment.masked_gap_ms": 800.0})
    strict = override(Config(), {"segment.tolerance_cents": 40.0, "segment.drift_cap": 1.0})
    swept = notes.sweep(frames, RATE, {"wide": wide, "strict": strict}).toPandas()
    names = {k: g.sort_values("note_idx").midi.tolist() for k, g in swept.groupby(["config_id", "take_id"])}
    assert names["wide", "far"] == [88] and names["strict", "far"] == [88, 88]
    assert names["wide", "low"] == [88] and names["strict", "low"] == [88, 89]
    with pytest.raises(ValueError):
        notes.sweep(frames, RATE, {})
    assert notes.transcribe(frames.where("false"), RATE).count() == 0


def bare(spark, pitches, level=-20.0):
    """Prepared frames of one take at the given pitches (None: silence), as merging reads them."""
    rows = [("t", i, i * PERIOD, p, p is not None, False, False, 0.9, 30.0, level if p is not None else -75.0, False, None, p) for i, p in enumerate(pitches)]
    return spark.createDataFrame(rows, "take_id string, frame_idx int, t_sec double, smooth double, voiced boolean, transitional boolean, oscillating boolean, clarity double, snr_db double, band_rms_db double, clipped boolean, floor_db double, centre double")


def spans(spark, *rows):
    return spark.createDataFrame([("t", a, b, settled, False, 0.0) for a, b, settled in rows], "take_id string, start_idx int, end_idx int, settled_idx int, glided boolean, reach double")


def ends(df):
    return [(r.start_idx, r.end_idx, r.settled_idx) for r in df.orderBy("start_idx").collect()]


def test_dropouts_join_and_keep_the_first_notes_place(spark):
    frames = bare(spark, [None] * 40 + [76.0] * 30 + [76.0] * 3 + [76.0] * 30 + [None] * 3 + [76.0] * 20)
    measured = merging.measure(spans(spark, (40, 69, 45), (73, 102, 80), (106, 125, 106)), frames, Config())
    assert ends(merging.join_to_fixpoint(measured, frames, Config(), PERIOD, merging.dropouts)) == [(40, 102, 45), (106, 125, 106)]  # the second gap is silent


def test_passes_start_their_chains_anew(spark):
    frames = bare(spark, [76.0] * 130)
    measured = merging.measure(spans(spark, (40, 69, 40), (70, 99, 70), (100, 129, 100)), frames, Config()).withColumn("pitch", F.element_at(F.create_map(F.lit(40), F.lit(70.0), F.lit(70), F.lit(80.0), F.lit(100), F.lit(76.0)), F.col("start_idx")))
    seen = []

    def belong(pairs, *_):
        seen.append([(r.start_idx, r.low, r.high, r.next.start_idx) for r in pairs.orderBy("start_idx").collect()])
        return pairs.where("next.start_idx = 70").select("take_id", "start_idx")

    assert ends(merging.join_to_fixpoint(measured, frames, Config(), PERIOD, belong)) == [(40, 99, 40), (100, 129, 100)]
    # within the pass the chain holds 70 to 80; the next pass begins from the joined note's own pitch
    assert seen[1] == [(40, 70.0, 80.0, 100)] and seen[2] == [(40, 76.0, 76.0, 100)]


def short_truth(own, level, period=PERIOD):
    """Short notes resolved one after the other: lists (start, end, pitch); pitches do not change when joined."""
    own = [list(x) for x in own]
    while own:
        k = min(range(len(own)), key=lambda j: (own[j][1] - own[j][0], own[j][0]))
        if (own[k][1] - own[k][0] + 1) * period * 1000 >= 80:
            break
        near = []
        for j in (k - 1, k + 1):
            if 0 <= j < len(own):
                a, b = own[min(j, k)], own[max(j, k)]
                gap = range(a[1] + 1, b[0])
                if (not gap or (len(gap) * period * 1000 <= 60 and all(level[g] >= -70 for g in gap))) and abs(a[2] - b[2]) <= 1.2:
                    near.append((abs(a[2] - b[2]), j))
        if near:
            j = min(near)[1]
            a, b = own[min(j, k)], own[max(j, k)]
            own[min(j, k) : max(j, k) + 1] = [[a[0], b[1], float(np.median(pitches_of(own, a[0], b[1])))]]
        else:
            del own[k]
    return [(a, b) for a, b, _ in own]


PITCHES = {}


def pitches_of(own, a, b):
    return [PITCHES[i] for i in range(a, b + 1) if PITCHES[i] is not None]


def test_short_notes_one_after_the_other(spark):
    """Rounds of least notes give what the shortest-first order gives, chains and ties included."""
    draw = uniforms(7)
    takes, frames, truth = [], [], {}
    for t in range(25):
        at, own, pitch = 0, [], []
        for _ in range(12):
            size, gap = 1 + int(next(draw) * 10), int(next(draw) * 3)
            p = 76.0 + int(next(draw) * 5) * 0.5
            own.append((at, at + size - 1, p))
            pitch += [p] * size + [None] * gap
            at += size + gap
        level = [-20.0 if p is not None or next(draw) < 0.7 else -75.0 for p in pitch]
        PITCHES.clear()
        PITCHES.update(enumerate(pitch))
        truth[f"t{t}"] = short_truth(own, level)
        frames += [(f"t{t}", i, i * PERIOD, p, p is not None, False, 0.9, 30.0, level[i], False, None) for i, p in enumerate(pitch)]
        takes += [(f"t{t}", a, b, a, False, 0.0) for a, b, _ in own]
    f = spark.createDataFrame(frames, "take_id string, frame_idx int, t_sec double, smooth double, voiced boolean, transitional boolean, clarity double, snr_db double, band_rms_db double, clipped boolean, floor_db double")
    config = override(Config(), {"segment.attack_trim": 0.0})  # a joined note is then the median of all its frames
    s = spark.createDataFrame(takes, "take_id string, start_idx int, end_idx int, settled_idx int, glided boolean, reach double")
    got = merging.resolve_short(merging.measure(s, f, config), f, config, PERIOD).collect()
    found = {t: sorted((r.start_idx, r.end_idx) for r in got if r.take_id == t) for t in truth}
    assert found == truth and sum(map(len, truth.values())) < len(takes)
