"""Frames of signals with known pitches; files there and back; alignment and held notes."""

import struct

import numpy as np
import pytest

from strophe.config import Analysis, Config, override, parse_setting, preset
from strophe.operators import analysis, attempts
from strophe.sources import generator, midi, wav
from strophe.sources.generator import Tone

RATE = 48000


@pytest.mark.parametrize("midi_no", [72, 81, 90, 98])
def test_pitch_of_frames(midi_no):
    samples, _ = generator.melody([Tone(midi_no, 0.5, detune=17)], RATE)
    f = analysis.frames_of(samples, RATE, Analysis()).iloc[4:-4]
    cents = np.abs((69 + 12 * np.log2(f.hz / 440) - midi_no) * 100 - 17)
    assert cents.median() < 0.5 and cents.max() < 5
    assert (f.clarity > 0.9).all() and not f.clipped.any()
    assert np.abs(f.band_rms_db - (20 * np.log10(0.5 / np.sqrt(2)))).max() < 0.05


def test_no_frames():
    assert len(analysis.frames_of(np.zeros(100), RATE, Analysis())) == 0


def test_blocks_of_any_size_give_the_same_frames():
    samples, _ = generator.melody([Tone(76, 0.3), Tone(83, 0.3)], RATE)
    for hop in (512, 3000):
        settings = Analysis(hop=hop)
        want = analysis.frames_of(samples, RATE, settings)
        for size in (128, 1000, 7777):
            tracker = analysis.Tracker(RATE, settings)
            got = [p for k in range(0, len(samples), size) if len(p := tracker.push(samples[k : k + size]))]
            assert np.concatenate([p.frame_idx for p in got]).tolist() == want.frame_idx.tolist()
            assert np.allclose(np.concatenate([p.hz for p in got]), want.hz, equal_nan=True)


def test_settings():
    assert parse_setting("segment.confirm_frames=9") == ("segment.confirm_frames", 9)
    assert override(Config(), dict([parse_setting("voicing.onset_db=4")])).voicing.onset_db == 4
    for bad in ("segment.nothing=1", "x", "analysis.remove_dc=1", "tuning.a4_hz=nan"):
        with pytest.raises(ValueError):
            parse_setting(bad)
    with pytest.raises(ValueError):
        preset("loud")
    with pytest.raises(ValueError):
        analysis.plan(RATE, Analysis(window=4))


def test_wav_there_and_back(spark, tmp_path):
    x = np.array([0.0, 0.5, -0.5, 1.0, -1.0])
    for scale in ("symmetric", "asymmetric"):
        got, rate = wav.decode_wav(wav.encode_wav(x, 22050, scale))
        assert rate == 22050 and np.abs(got - x).max() < 1e-4
    head = b"RIFF\0\0\0\0WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0"
    stereo = head + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 48000, 6, 24) + b"data" + struct.pack("<I", 0)
    got, _ = wav.decode_wav(stereo + b"\x00\x00\x40" + b"\x00\x00\xc0" + b"\x00\x00\x20" * 2)
    assert got.tolist() == [0.0, 0.25]
    for bad in (b"", head, b"RIFF\0\0\0\0WAVE" + b"data" + struct.pack("<I", 0)):
        with pytest.raises(wav.WavError):
            wav.decode_wav(bad)
    (tmp_path / "a.wav").write_bytes(wav.encode_wav(x, 8000))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    rows = sorted(wav.read_wav(spark, str(tmp_path)).collect(), key=lambda r: r.take_id)
    assert len(rows[0].samples) == 5 and rows[0].error is None and rows[1].error == "not RIFF/WAVE"


def midi_file(*tracks, form=1, division=480):
    return b"MThd" + struct.pack(">IHHH", 6, form, len(tracks), division) + b"".join(b"MTrk" + struct.pack(">I", len(t)) + t for t in tracks)


def test_midi(spark, tmp_path):
    tempo = b"\x00\xff\x51\x03\x07\xa1\x20" + b"\x83\x60\xff\x51\x03\x0f\x42\x40" + b"\x00\xff\x2f\x00"
    notes = b"\x00\xff\x03\x03Lead"[:7] + b"\x00\x90\x3c\x40" + b"\x83\x60\x3c\x00" + b"\x00\x3e\x40" + b"\x83\x60\x80\x3e\x00" + b"\x00\x90\x40\x40" + b"\x83\x60\xff\x2f\x00"
    whole = midi_file(tempo, notes)
    got = midi.parse_midi(whole)
    assert [(n[0], n[3], n[4], n[5]) for n in got] == [(1, 60, 0.0, 0.5), (1, 62, 0.5, 1.5), (1, 64, 1.5, 2.5)]
    with pytest.raises(midi.MidiError, match="NOT_MIDI"):
        midi.parse_midi(b"nothing")
    with pytest.raises(midi.MidiError, match="DAMAGED"):
        midi.parse_midi(whole[:-3])
    (tmp_path / "a.mid").write_bytes(whole)
    (tmp_path / "b.mid").write_bytes(b"nothing")
    rows = midi.read_midi(spark, str(tmp_path)).collect()
    assert sorted(r.midi for r in rows if r.error is None) == [60, 62, 64] and sum(r.error is not None for r in rows) == 1


def test_generator_numbers():
    draw = generator.uniforms(1)
    assert [next(draw) for _ in range(2)] == pytest.approx([0.6270739405881613, 0.002735721180215478])
    for pink in (False, True):
        assert 20 * np.log10(np.sqrt(np.mean(generator.noise(2000, 7, -30, pink) ** 2))) == pytest.approx(-30)


def test_alignment(spark):
    target = [76, 79, 83, 79, 76]
    same = attempts.align(target, target)
    assert same["transposition"] == 0 and same["cost"] == 0 and [s["verdict"] for s in same["slots"]] == ["clean"] * 5
    octave = attempts.align([x - 12 for x in target], target)
    assert octave["transposition"] == 12 and [s["verdict"] for s in octave["slots"]] == ["clean"] * 5
    short = attempts.align([76, 79, 79, 76], target)
    assert [s["verdict"] for s in short["slots"]] == ["clean", "clean", "missing", "clean", "clean"]
    longer = attempts.align([76, 79, 90, 83, 79, 76], target)
    assert [(e["attempt"], e["after"]) for e in longer["extras"]] == [(2, 1)]
    wrong = attempts.align([76, 79, 85, 79, 76], target)
    assert wrong["slots"][2]["verdict"] == "wrong"
    sharp = attempts.align([x + 0.25 for x in target], target)
    assert sharp["offset_cents"] == pytest.approx(25) and all(s["verdict"] == "clean" for s in sharp["slots"])
    assert attempts.align([], target)["cost"] == 5 and attempts.align([], [])["slots"] == []
    assert attempts.substitution(2.0) + attempts.prior(12) + attempts.DURATION < 2 * attempts.GAP
    rows = spark.createDataFrame([(1, [76.0, 83.0], [76.0, 83.0], None, None), (2, None, [76.0], None, None)], "attempt_id long, sung array<double>, target array<double>, sung_sec array<double>, target_sec array<double>")
    assert sorted((r.attempt_id, r.slot, r.verdict) for r in attempts.align_attempts(rows).collect()) == [(1, 0, "clean"), (1, 1, "clean"), (2, 0, "missing")]


def test_held_notes(spark):
    t = np.arange(200) * 0.01
    broken = np.where((np.arange(200) > 60) & (np.arange(200) < 80), np.nan, 80.0)
    takes = {"even": (t, 80.1 + 0 * t), "rising": (t, 80 + t / 10), "short": (t[:50], 80 + 0 * t[:50]), "broken": (t, broken), "few": (np.array([0.0, 0.9]), np.array([80.0, 80.0])), "tie": (np.r_[t[:80], 1 + t[:80]], np.r_[80 + 0 * t[:80], 81 + 0 * t[:80]])}
    rows = [(k, float(a), None if np.isnan(m) else float(m), 80.0) for k, (ts, ms) in takes.items() for a, m in zip(ts, ms)]
    got = {r.take_id: r for r in attempts.score_holds(spark.createDataFrame(rows, "take_id string, t_sec double, midi double, target double")).collect()}
    assert set(got) == {"even", "rising", "broken", "tie"}
    assert got["even"].median_cents == pytest.approx(10) and got["even"].wobble_cents == pytest.approx(0, abs=1e-9) and got["even"].frames == 150
    assert 0 < got["rising"].drift_cents <= 15 and got["broken"].steady_sec < 1.3 and got["tie"].median_cents == pytest.approx(0, abs=1e-9)
