"""Merges of notes, MIDI files, alignments, phrases, caches and headers on hand-made cases."""

import struct
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strophe.config import Analysis, Config
from strophe.functions import draws
from strophe.operators import alignment, analysis, attempts, melody, practice, spectrum
from strophe.sources import documents, midi, wav
from strophe.sources.generator import uniforms

def track(*events):
    body = b"".join(events)
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, 480) + b"MTrk" + struct.pack(">I", len(body)) + body


def test_midi_files_out_of_step_are_damaged():
    on, off = b"\x00\x90\x45\x40", b"\x83\x60\x80\x45\x40"
    assert midi.parse_midi(track(on, off))[0][2:] == (0, 69, 0.0, 0.5)
    for bad in (b"\x00\x90\x45\xc8", b"\x00\xb0\x80\x00", b"\x00\xf3\x01", b"\x00\xf8", b"\x00\x90\x45", b"\x00\x45\x40"):
        with pytest.raises(midi.MidiError, match="DAMAGED"):
            midi.parse_midi(track(bad))


def test_a_tempo_of_nothing_is_ignored():
    none, slow = b"\x00\xff\x51\x03\x00\x00\x00", b"\x00\xff\x51\x03\x0f\x42\x40"
    on, off = b"\x00\x90\x45\x40", b"\x83\x60\x80\x45\x40"
    assert midi.parse_midi(track(none, on, off))[0][5] == 0.5
    assert midi.parse_midi(track(slow, none, on, off))[0][5] == 1.0
    two = track(b"\x00\x90\x48\x40", b"\x00\x90\x40\x40", b"\x10\x80\x48\x40", b"\x10\x80\x40\x40")
    assert [n[3] for n in midi.parse_midi(two)] == [64, 72]


def plain_cost(a, t, sung, wanted, shift):
    n, m = len(a), len(t)
    tempo = np.mean(np.log2(sung)) - np.mean(np.log2(wanted))
    table = {(0, 0): 0.0}
    for i, j in product(range(n + 1), range(m + 1)):
        ways = []
        if i and j:
            sub = 1.5 * min(1, max(0, (abs(a[i - 1] + shift - t[j - 1]) - 0.3) / 1.7))
            time = 0.02 * min(1, abs(np.log2(sung[i - 1]) - np.log2(wanted[j - 1]) - tempo))
            ways.append(table[i - 1, j - 1] + sub + time + 0.25 * min(abs(shift), 12) / 12)
        if i:
            ways.append(table[i - 1, j] + 1)
        if j:
            ways.append(table[i, j - 1] + 1 + (0.001 if i < n else 0))
        if ways:
            table[i, j] = min(ways)
    return table[n, m]


def test_alignments_equal_a_plain_loop():
    draw = np.random.default_rng(8)
    for _ in range(60):
        n, m = draw.integers(1, 6, 2)
        a, t = draw.integers(60, 90, n) + draw.normal(0, 0.3, n), draw.integers(60, 90, m).astype(float)
        sung, wanted = draw.choice([0.25, 0.5, 1.0], n), draw.choice([0.25, 0.5, 1.0], m)
        centre = int(np.floor(np.median(t) - np.median(a) + 0.5))
        want = min(plain_cost(a, t, sung, wanted, s) for s in {0, *range(centre - 14, centre + 15)})
        assert abs(attempts.align(a, t, sung, wanted)["searched_cost"] - want) < 1e-9


def test_the_cheapest_explanation_costs_no_more_than_any_other():
    t = [76.0, 79.0, 83.0, 79.0, 76.0]
    assert attempts.align(t, t)["cost"] == 0
    for k in range(5):  # a dropped note costs a gap, a semitone's slip no more than a substitution
        assert attempts.align(t[:k] + t[k + 1 :], t)["cost"] <= attempts.GAP + attempts.EARLY_GAP + 1e-9
        assert attempts.align([*t[:k], t[k] + 1, *t[k + 1 :]], t)["cost"] <= attempts.MOST_SUBSTITUTION


def phrase(weights, seed, length, low=78, high=90):
    """The walk, step by step."""
    draws, inner = uniforms(seed), max(1, (high - low) // 3)
    out = [low + (high - low - inner) // 2 + int(next(draws) * (inner + 1))]
    while len(out) < max(3, min(6, length)):
        ways = [(s, w) for s, w in sorted(weights.items()) if w > 0 and low <= out[-1] + s <= high]
        draw, run = next(draws) * sum(w for _, w in ways), 0.0
        for s, w in ways:
            run += w
            if run > draw:
                break
        out.append(out[-1] + s)
    return out


def test_phrases_are_the_walk_step_by_step(spark):
    even = {s: float(s != 3) for s in range(-12, 13) if s}
    often = {**even, 7: 50.0}
    rows = [(seed, s, w) for seed in range(400) for s, w in (even if seed < 200 else often).items()]
    lengths = [(seed, seed % 9) for seed in range(400)]
    got = melody.echo_phrases(spark.createDataFrame(rows, "user_id long, step int, weight double"), spark.createDataFrame(lengths, "user_id long, length int")).collect()
    notes = {seed: [r.midi for r in sorted((r for r in got if r.user_id == seed), key=lambda r: r.pos)] for seed in range(400)}
    assert notes == {seed: phrase(even if seed < 200 else often, seed, n) for seed, n in lengths}
    assert all(3 <= len(x) <= 6 and min(x) >= 78 and max(x) <= 90 and 3 not in np.diff(x) for x in notes.values())
    steps = [d for seed in range(200, 400) for d in np.diff(notes[seed])]
    assert steps.count(7) > len(steps) / 4


def test_draws_are_those_of_the_generator(spark):
    seeds = [0, 1, 7, 2**31, 2**32 - 1, -5]
    got = {r.s: list(r.u) for r in spark.createDataFrame([(s,) for s in seeds], "s long").select("s", F.array(*[draws.uniform(F.col("s"), k) for k in range(1, 6)]).alias("u")).collect()}
    for s in seeds:
        own = uniforms(s)
        assert got[s] == [next(own) for _ in range(5)]


def test_measures_of_bins_are_those_of_blocks(spark):
    settings = Analysis(window=64, zero_pad=2, hop=64, low_hz=1500.0, high_hz=18000.0)
    draw, t = np.random.default_rng(4), np.arange(64) / 48000
    rows = [np.sin(2 * np.pi * hz * t) * a + draw.normal(0, 0.01, 64) for hz in (1500, 2600, 5000, 9000, 17900) for a in (0.3, 0.99)]
    rows += [0.2 * np.sin(2 * np.pi * 3000 * t) + 0.3 * np.sin(2 * np.pi * 6000 * t), np.zeros(64), np.full(64, 0.5), *draw.normal(0, 0.2, (20, 64))]
    blocks = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rows)] + [(900, [0.0] * 3), (901, None)], "take_id long, samples array<double>")
    plan = analysis.plan(48000, settings)
    got = {r.take_id: r for r in spectrum.measures(spectrum.bins(blocks, plan, 64), plan, 48000).collect()}
    want = analysis.measure(np.array(rows), 48000, settings)
    assert set(got) == set(range(len(rows)))
    for k in range(len(rows)):
        assert (got[k].hz is None) == bool(np.isnan(want["hz"][k])) and got[k].clipped == want["clipped"][k], k
        assert got[k].hz is None or got[k].hz == pytest.approx(want["hz"][k])
        for c in ("clarity", "snr_db", "peak_to_second_db", "band_rms_db", "broadband_rms_db"):
            if k != 11 and k != 12:  # silence: what is left of it is rounding
                assert got[k][c] == pytest.approx(want[c][k], abs=1e-6), (k, c)


def test_alignments_in_the_engine_are_those_of_the_arrays(spark):
    draw, rows = np.random.default_rng(5), []
    for k in range(150):
        target = [float(x) for x in draw.integers(60, 84, int(draw.integers(0, 7)))]
        sung = [x + float(draw.choice([0, 0, 0, 0.25, 0.5, 1, 12])) for x in target if draw.random() < 0.85]
        if draw.random() < 0.4:
            sung.insert(int(draw.integers(0, len(sung) + 1)), float(draw.integers(60, 84)))
        sung = [x - float(draw.choice([0, 5, 12])) for x in sung]
        rows.append((k, sung, target, [float(x) for x in draw.choice([0.125, 0.25, 0.5, 1.0], len(sung))], [float(x) for x in draw.choice([0.125, 0.25, 0.5, 0.0], len(target))]))
    rows += [(200, None, [76.0], None, None), (201, [76.0, 83.0], [76.0, 83.0], None, [1.0]), (202, [], [], None, None), (203, [70.0], None, None, None)]
    table = spark.createDataFrame(rows, "attempt_id long, sung array<double>, target array<double>, sung_sec array<double>, target_sec array<double>").repartition(4)
    six = lambda v: None if v is None else round(v, 6) + 0.0 if isinstance(v, float) else v
    both = [sorted(([six(v) for v in r] for r in made(table).collect()), key=str) for made in (alignment.align_attempts, attempts.align_attempts)]
    assert both[0] == both[1] and {r[5] for r in both[0]} == {"clean", "off", "wrong", "missing", "extra"}


def test_a_changed_length_starts_over(spark):
    rows = [(1, a, a, 9, s, 60, 0.0, "wrong" if a < 3 else "clean") for a in range(5) for s in range(3 if a < 3 else 2)]
    slots = spark.createDataFrame(rows, "user_id long, attempt_id long, attempt_no int, target_id long, slot int, target_midi int, residual_cents double, verdict string")
    got = {r.slot: (r.attempts, r.clean, r.wrong) for r in practice.target_tallies(slots).collect()}
    assert got == {0: (2, 2, 0), 1: (2, 2, 0)}
    assert [(r.attempt_no, r.verdicts) for r in practice.attempt_history(slots).orderBy("attempt_no").collect()] == [(3, "cc"), (4, "cc")]


def test_the_ledger_takes_one_step_an_attempt(spark):
    names = "user_id long, attempt_id long, attempt_no int, target_id long, slot int, target_midi int, residual_cents double, verdict string"
    heard = {0: ["clean", "wrong", "off"], 1: ["clean", "missing", "clean"], 2: ["clean", "missing", "missing"]}
    cents = {"clean": 10.0, "off": -50.0, "wrong": 300.0, "missing": None}
    rows = [(1, a, a, 9, s, 60 + 2 * s, cents[v], v) for a, vs in heard.items() for s, v in enumerate(vs)]
    (r,) = practice.interval_ledger(spark.createDataFrame(rows, names)).collect()
    assert (r.step, r.clean, r.off, r.wrong, r.missing, r.observations, r.cents_observations) == (2, 1, 1, 1, 3, 3, 2)
    assert abs(r.wrong_rate - (0.5 + 0.25 * (0 - 0.5))) < 1e-12 and abs(r.abs_cents - (50 + 0.25 * (10 - 50))) < 1e-12


def test_chords_hang_on_their_first_onset(spark):
    rows = [(0, 0, "", 0, m, s, e) for m, s, e in [(60, 0.0, 1.0), (64, 0.02, 0.5), (67, 0.04, 0.9), (62, 2.0, 3.0)]]
    notes = spark.createDataFrame(rows, "file int, track_idx int, track_name string, channel int, midi int, start_sec double, end_sec double")
    (r,) = melody.collapse_chords(notes).collect()
    assert [(n.midi, round(n.dur_sec, 3)) for n in r.notes] == [(64, 0.05), (67, 0.86), (62, 1.0)] and abs(r.chord_fraction - 1 / 3) < 1e-12


def test_caches_name_what_differs(spark, tmp_path):
    frames = spark.range(5).select(F.lit("t").alias("take_id"), "id")
    path = f"file://{tmp_path}/cache"
    documents.write_cache(frames, path, Analysis())
    assert documents.read_cache(spark, path, Analysis()).count() == 5
    from dataclasses import fields, replace

    name = next(f.name for f in fields(Analysis) if isinstance(getattr(Analysis(), f.name), int))
    other = replace(Analysis(), **{name: getattr(Analysis(), name) + 1})
    with pytest.raises(documents.CacheMismatch, match=name):
        documents.read_cache(spark, path, other)
    assert documents.differences({"a": 1, "b": 2}, {"b": 3, "c": 4}) == ["analysis.a 1 → (absent)", "analysis.b 2 → 3", "analysis.c (absent) → 4"]


def test_frames_csv_by_header(spark, tmp_path):
    (tmp_path / "f.csv").write_text("hz,t,clarity\n440.000,0.0,0.9\n,0.1,0.2\nabc,0.2,0.5\n")
    assert [tuple(r) for r in documents.read_frames_csv(spark, f"file://{tmp_path}/f.csv").collect()] == [(0.0, 440.0, 0.9)]


def test_headers_of_sound_files():
    head = wav.encode_wav(np.zeros(4), 48000)
    assert documents.byte_limit(head) == min(32 << 20, (512 << 20) * 96000 // (48000 * 8))
    rate = struct.pack(">HQ", 16383 + 15, 48000 << 48)
    aiff = b"FORM" + struct.pack(">I", 0) + b"AIFFCOMM" + struct.pack(">IHIH", 18, 2, 10, 16) + rate
    assert documents.byte_limit(aiff) == min(32 << 20, (512 << 20) * 192000 // (48000 * 12))
    for bad in (b"", b"ID3" + bytes(20), head[:20], b"RIFF" + head[4:20] + b"\x02\x00" + head[22:]):
        assert documents.byte_limit(bad) is None
    with pytest.raises(documents.UnsupportedAudio):
        documents.require_uncompressed(b"OggS" + bytes(60))


def test_mix_and_cap():
    six = [np.full(3, float(k)) for k in range(6)]
    assert np.allclose(wav.mixed(six), (0.7071 + 2 + 0.5 * 4 + 0.5 * 5) / 3.4142)
    assert np.allclose(wav.mixed([np.array([1.0, 3.0]), np.array([3.0])]), [2.0]) and len(wav.mixed([])) == 0
    assert len(wav.capped(np.zeros(100), 1, 60.0)) == 60


def test_supersaw():
    cents = melody.supersaw_cents()
    assert cents == [-x for x in reversed(cents)] and cents[0] == -25 and cents[3] == 0 and abs(cents[5] - 25 * (2 / 3) ** 1.5) < 1e-12
    assert melody.supersaw_cents(0) == [] and melody.supersaw_cents(2) == [-25.0, 25.0]


def test_levels_of_added_sounds():
    from strophe.sources import generator

    for x in (generator.saw(48000, 220.0, 48000, -30.0), generator.steady(48000, 50.0, 48000, -30.0)):
        assert abs(20 * np.log10(np.sqrt(np.mean(x**2))) + 30) < 0.01
    power = np.abs(np.fft.rfft(generator.saw(48000, 1000.0, 48000, 0.0)))
    assert power[23001:].max() < 1e-6 * power[1000] and abs(power[2000] / power[1000] - 0.5) < 1e-6


def test_hostile_statistics(spark):
    rows = [(1, '{"version":1,"intervals":{"2":{"observations":3.7,"clean":-4,"wrongRateEwma":7},"x":{"clean":1},"3":null,"-5":{}}}'), (2, '{"version":9,"intervals":{"2":{"clean":1}}}'), (3, "no json"), (4, None), (5, "[]"), (6, '{"intervals":{}}')]
    got = practice.read_stats(spark.createDataFrame(rows, "user_id long, json string")).collect()
    assert sorted((r.user_id, r.step, r.observations, r.clean, r.wrong_rate) for r in got) == [(1, -5, 0, 0, 0.0), (1, 2, 3, 0, 1.0)]
