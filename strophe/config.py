"""Settings of analysis, voicing, smoothing, segmentation and tuning, with presets and overrides."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# The defaults every result depends on.


@dataclass(frozen=True)
class Analysis:
    window: int = 2048
    zero_pad: int = 4
    hop: int = 512
    low_hz: float = 400.0
    high_hz: float = 4500.0
    sub_octave_db: float = 6.0
    remove_dc: bool = True


@dataclass(frozen=True)
class Voicing:
    min_clarity: float = 0.5
    min_snr_db: float = 12.0
    min_second_db: float = 6.0
    floor_percentile: float = 20.0
    floor_window_sec: float = 3.0
    background_above_db: float = 12.0
    absolute_floor_db: float = -70.0
    onset_db: float = 12.0
    sustain_db: float = 6.0
    warmup_sec: float = 0.3


@dataclass(frozen=True)
class Smoothing:
    min_run: int = 3
    median_filter: int = 5


@dataclass(frozen=True)
class Segment:
    glide_slope: float = 18.0
    glide_min_slope: float = 3.0
    glide_min_semitones: float = 0.8
    tolerance_cents: float = 60.0
    reference_median: int = 15
    confirm_frames: int = 7
    drift_cap: float = 1.5
    attack_trim: float = 0.25
    attack_trim_min_ms: float = 120.0
    min_note_ms: float = 80.0
    gap_merge_ms: float = 60.0
    masked_gap_ms: float = 400.0
    rest_gap_ms: float = 180.0


@dataclass(frozen=True)
class Tuning:
    a4_hz: float = 440.0
    automatic: bool = True
    max_offset_cents: float = 50.0
    min_concentration: float = 0.6
    min_notes: int = 4


@dataclass(frozen=True)
class Config:
    analysis: Analysis = field(default_factory=Analysis)
    voicing: Voicing = field(default_factory=Voicing)
    smoothing: Smoothing = field(default_factory=Smoothing)
    segment: Segment = field(default_factory=Segment)
    tuning: Tuning = field(default_factory=Tuning)


#: Tolerance in cents and drift cap in semitones of each preset.
PRESETS = {"strict": (40.0, 1.0), "normal": (60.0, 1.5), "forgiving": (90.0, 2.0)}


def preset(name: str) -> Config:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
    tolerance, drift = PRESETS[name]
    return override(Config(), {"segment.tolerance_cents": tolerance, "segment.drift_cap": drift})


def parse_setting(text: str) -> tuple[str, float | int | bool]:
    """The path and typed value of ``group.key=value``; the type is that of the default."""
    path, equals, raw = text.partition("=")
    group, _, key = path.strip().partition(".")
    default = getattr(getattr(Config(), group, None), key, None) if key else None
    if not equals or default is None:
        raise ValueError(f"no such setting: {text!r}")
    raw = raw.strip()
    if isinstance(default, bool):
        if raw not in ("true", "false"):
            raise ValueError(f"{path} is true or false, not {raw!r}")
        return path.strip(), raw == "true"
    try:
        value = float(raw)
    except ValueError:
        raise ValueError(f"{path} is a number, not {raw!r}") from None
    if value != value or value in (float("inf"), float("-inf")):
        raise ValueError(f"{path} is a finite number, not {raw!r}")
    return path.strip(), int(value) if isinstance(default, int) and value == int(value) else value


def override(config: Config, settings: dict[str, float | int | bool]) -> Config:
    """The configuration with single settings replaced; an unknown path is an error."""
    for path, value in settings.items():
        group, _, key = path.partition(".")
        part = getattr(config, group, None)
        if part is None or key not in {f.name for f in fields(part)}:
            raise ValueError(f"no such setting: {path}")
        config = replace(config, **{group: replace(part, **{key: value})})
    return config
