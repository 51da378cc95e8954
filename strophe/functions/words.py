"""Texts of the practice screens as column expressions: names, distances, durations, scores, advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pitch import half_up, octave, pitch_class

# Interval names by semitones, staff steps by pitch class, bounds and sentences of the reference.
INTERVALS = ["", "a semitone", "a whole tone", "a minor 3rd", "a major 3rd", "a 4th", "a tritone", "a 5th", "a minor 6th", "a major 6th", "a minor 7th", "a major 7th"]
STEPS = [0, 0, 1, 1, 2, 3, 3, 4, 4, 5, 5, 6]
SHARPS = [1, 3, 6, 8, 10]
BOTTOM_STEP = 30
NAME_LENGTH = 60
NOTICE_CENTS = 15
OCTAVE_SLIP_CENTS = 50
WOBBLY_CENTS, DEAD_ON_CENTS, AWAY_CENTS = 25, 10, 70
SLIPPED = "Part of that came out an octave from the rest — the register slipped partway through."
LANDED = "Every note landed. Nothing to fix."
WANDERED = "That one wandered while you held it — a slower, steadier breath is the fix, before the aim."
AWAY = "Steady, but sitting away from what played — listen to it again and lean the other way."
CLOSE = "Steady and close. That is what a good one feels like."
RIGHT = "Steady and right on it. Nothing to fix."


def _whole(x: Column) -> Column:
    """A number's text without decimals, halves rounded towards plus infinity."""
    return half_up(x).cast("long").cast("string")


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def staff_step(note: Column) -> Column:
    """Diatonic steps from C-1: seven an octave."""
    return (octave(note) * 7 + F.element_at(F.array(*[F.lit(s) for s in STEPS]), (pitch_class(note) + 1).cast("int"))).cast("int")


def is_sharp(note: Column) -> Column:
    return pitch_class(note).isin(SHARPS)


def ledger_offsets(note: Column) -> Column:
    """Ledger lines as even offsets from the bottom line, nearest first; none on the staff."""
    at = staff_step(note) - BOTTOM_STEP
    none = F.array().cast("array<int>")
    return F.when(at <= -2, F.sequence(F.lit(-2), at, F.lit(-2))).when(at >= 10, F.sequence(F.lit(10), at, F.lit(2))).otherwise(none)


def transposed(note: Column, octaves: Column) -> Column:
    return note + 12 * octaves


def signed_cents(cents: Column) -> Column:
    return F.concat(F.when(half_up(cents) > 0, "+").otherwise(""), _whole(cents))


def clean_name(name: Column, fallback: str) -> Column:
    """White space collapsed and trimmed, NAME_LENGTH characters at most, never empty."""
    short = F.left(F.trim(F.regexp_replace(name, "\\s+", " ")), F.lit(NAME_LENGTH))
    return F.when(F.coalesce(short, F.lit("")) == "", F.lit(fallback)).otherwise(short)


def clock(seconds: Column) -> Column:
    """m:ss of whole seconds; negative counts as none."""
    whole = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.concat(F.floor(whole / 60).cast("long").cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def duration(seconds: Column) -> Column:
    """Tenths of a second below a minute, m:ss above it."""
    tenths = F.format_string("%.1f s", seconds)
    return F.when(F.coalesce(seconds <= 0, F.lit(True)), "0.0 s").when(seconds < 60, tenths).otherwise(clock(seconds))


def ordinal(n: Column) -> Column:
    tens, ones = n % 100, n % 10
    ending = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def interval(semitones: Column) -> Column:
    """An unsigned distance as a musician says it: octaves and the rest."""
    n = F.abs(half_up(semitones)).cast("int")
    octaves, rest = F.floor(n / 12).cast("int"), n % 12
    name = F.element_at(F.array(*[F.lit(x) for x in INTERVALS]), rest + 1)
    many = F.when(octaves == 1, "an octave").otherwise(F.concat(octaves.cast("string"), F.lit(" octaves")))
    return F.when(n == 0, "the same note").when(octaves == 0, name).when(rest == 0, many).otherwise(F.concat(many, F.lit(" and "), name))


def distance(cents: Column) -> Column:
    """How far off, in cents or, near whole ones, in semitones."""
    size = F.abs(cents)
    way = F.when(cents > 0, "sharp").otherwise("flat")
    in_cents = F.concat(_whole(size), F.lit(" cents "), way)
    whole = half_up(size / 100)
    near = F.abs(size / 100 - whole) < 0.2
    named = F.when(whole == 12, F.concat(F.lit("an octave "), F.when(cents > 0, "high").otherwise("low"))).otherwise(
        F.concat(F.when(whole == 1, "a").otherwise(whole.cast("long").cast("string")), F.lit(" semitone"), _plural(whole, "", "s"), F.lit(" "), way)
    )
    return F.when(size < 100, in_cents).when(near, named).otherwise(in_cents)


def tuning(cents: Column) -> Column:
    """Said from NOTICE_CENTS on."""
    said = F.concat(F.lit("You ran about "), distance(cents), F.lit(" throughout — scored against that."))
    return F.when(F.coalesce(F.abs(cents) >= NOTICE_CENTS, F.lit(False)), said).otherwise("")


def register(semitones: Column, slipped: Column) -> Column:
    """Where the attempt lay beside what played."""
    way = F.when(semitones > 0, "below").otherwise("above")
    end = F.when(slipped, ".").otherwise(" — which is fine, the shape is what counts.")
    moved = F.concat(F.lit("You whistled it "), interval(semitones), F.lit(" "), way, F.lit(" what played"), end)
    return F.when(semitones == 0, "You whistled it in the register it played in.").otherwise(moved)


def octave_out(cents: Column) -> Column:
    return F.coalesce(F.abs(F.abs(cents) - 1200) <= OCTAVE_SLIP_CENTS, F.lit(False))


def score(clean: Column, off: Column, wrong: Column, missing: Column, extra: Column) -> Column:
    total = clean + off + wrong + missing
    some = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}")))  # noqa: E731  null parts are left out
    first = F.concat(clean.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" note"), _plural(total, "", "s"), F.lit(" clean"))
    return F.concat_ws(" · ", first, some(off, "a little off"), some(wrong, "wrong"), some(missing, "missed"), some(extra, "extra"))


def hold_advice(median: Column, wobble: Column, drift: Column) -> Column:
    slid = F.concat(F.lit("That one slid "), distance(drift), F.lit(" while you held it — aim for one pitch and keep the air behind it."))
    return F.when(drift_dominates(wobble, drift), slid).when(wobble >= WOBBLY_CENTS, WANDERED).when(F.abs(median) >= AWAY_CENTS, AWAY).when(F.abs(median) >= DEAD_ON_CENTS, CLOSE).otherwise(RIGHT)


def drift_dominates(wobble: Column, drift: Column) -> Column:
    return (F.abs(drift) >= WOBBLY_CENTS) & (F.abs(drift) > wobble)


def chord_warning(fraction: Column) -> Column:
    said = F.concat(F.lit("More than one note at a time in "), _whole(fraction * 100), F.lit("% of this part — the app kept the highest each time."))
    return F.when(fraction >= 0.05, said)


def listens(n: Column) -> Column:
    return F.when(n == 0, "").when(n == 1, "Heard it once.").otherwise(F.concat(F.lit("Heard it "), n.cast("string"), F.lit(" times.")))


def needle_percent(cents: Column, reach: float) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cents / reach)) * 50


def readout(cents: Column, limit: float = 200.0) -> Column:
    """Signed cents, an arrow from limit on, a dash without a pitch."""
    return F.when(cents.isNull(), "—").when(cents >= limit, "↑").when(cents <= -limit, "↓").otherwise(F.concat(signed_cents(cents), F.lit("¢")))


def verdict_code(verdict: Column) -> Column:
    """One character a verdict."""
    return F.when(verdict == "missing", "-").otherwise(F.left(verdict, F.lit(1)))


def hold_history(count: Column, offset: Column, wobble: Column) -> Column:
    """The running averages, from three holds on."""
    aim = F.when(F.abs(offset) < DEAD_ON_CENTS, "sitting right on it").otherwise(F.concat(F.lit("running "), distance(offset)))
    said = F.concat(F.lit("Lately: "), aim, F.lit(", wobble ±"), _whole(wobble), F.lit(" cents."))
    return F.when(count >= 3, said).otherwise("")


def ramp(before: Column, after: Column) -> Column:
    """What the length of the next phrase does."""
    return F.when(after > before, "Got it — one more note next time.").when(after < before, "Let us take one back off.").otherwise("Same length again.")


# Months as names of takes have them, the first part of a file's name, the head of the table of notes.
FILE_START = "whistle-"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
NOTE_HEADER = "  # |  start |   dur | note | midi | cents | conf |     Hz"


def default_name(at: Column) -> Column:
    """The name of a take recorded at a time: day, month, hour and minute."""
    return F.concat(F.lit("Recorded "), F.dayofmonth(at).cast("string"), F.lit(" "), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(at)), F.lit(", "), F.date_format(at, "HH:mm"))


def file_name(at: Column) -> Column:
    """A file's name that sorts by time."""
    return F.concat(F.lit(FILE_START), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit(".wav"))


def note_line(number: Column, start: Column, length: Column, name: Column, midi: Column, cents: Column, confidence: Column, hz: Column, flags: Column) -> Column:
    """A row of the table of notes under NOTE_HEADER; flags is an array of names."""
    fixed = lambda x, places: F.format_string(f"%.{places}f", half_up(x * 10**places) / 10**places)
    pad = lambda x, n: F.when(F.length(x) < n, F.lpad(x, n, " ")).otherwise(x)
    whole = half_up(cents).cast("long")
    signed = F.concat(F.when(whole >= 0, "+").otherwise(""), whole.cast("string"))
    parts = [pad(number.cast("string"), 3), pad(fixed(start, 2), 6), pad(fixed(length, 2), 5), pad(name, 4), pad(midi.cast("string"), 4), pad(signed, 5), pad(fixed(confidence, 2), 4), pad(fixed(hz, 1), 6)]
    return F.concat(F.concat_ws(" | ", *parts), F.lit(" | "), F.when(F.size(flags) > 0, F.concat(F.lit(" "), F.array_join(flags, ","))).otherwise(""))
