"""Melodies: chords of MIDI voices to their tops, playback schedules, text, drill ranges, drafts, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.pitch import half_up, note_name
from ..functions.words import staff_step

# Fixed values of the reference.
CHORD_SEC, LEAST_SEC, MOST_NOTES, DRUMS = 0.03, 0.05, 64, 9
REST_SEC = 0.18
LONG_GAP, SHORT_GAP, LEAST_SOUND = 1.0, 0.5, 0.09
MIDDLE_STEP = 34
DRILL_LOW, DRILL_HIGH, LEAST_SPAN, MOST_SPAN = 78, 90, 12, 24
LEFT, RIGHT, SPACING = 34, 10, 30
MOST_SHIFT = 3


def pitched(notes: DataFrame) -> DataFrame:
    """Notes without drums, or all of a file that has nothing else."""
    other = F.bool_or(F.col("channel") != DRUMS).over(Window.partitionBy("file"))
    return notes.withColumn("__other", other).where((F.col("channel") != DRUMS) | ~F.col("__other")).drop("__other")


def collapse_chords(notes: DataFrame) -> DataFrame:
    """file, track_idx, track_name, channel, chord_fraction, notes (midi, dur_sec) of every voice.

    Notes within CHORD_SEC of a group's first onset are one chord; its highest note stays and ends with
    the next onset at the latest. Groups hang on their first onset, so each voice (a file of 2 MiB at
    most) is folded in order.
    """
    one = F.struct("start_sec", "midi", "end_sec")
    voices = notes.groupBy("file", "track_idx", "track_name", "channel").agg(F.array_sort(F.collect_list(one)).alias("all"))
    start = F.array(F.struct(F.lit(-1e300).alias("onset"), F.lit(0).alias("size"), F.lit(-1).alias("midi"), F.lit(0.0).cast("double").alias("end")))

    def fold(groups: Column, n: Column) -> Column:
        last = F.element_at(groups, -1)
        joined = F.struct(last["onset"].alias("onset"), (last["size"] + 1).alias("size"), F.greatest(last["midi"], n["midi"]).alias("midi"), F.when(n["midi"] > last["midi"], n["end_sec"]).otherwise(last["end"]).alias("end"))
        fresh = F.struct(n["start_sec"].alias("onset"), F.lit(1).alias("size"), n["midi"].alias("midi"), n["end_sec"].alias("end"))
        within = n["start_sec"] - last["onset"] <= CHORD_SEC
        return F.when(within, F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(joined))).otherwise(F.concat(groups, F.array(fresh)))

    folded = voices.withColumn("g", F.aggregate("all", start, fold)).withColumn("g", F.slice("g", 2, F.size("g")))
    until = lambda g, i: F.least(g["end"], F.coalesce(F.get(F.col("g"), i + 1)["onset"], g["end"]))
    made = F.transform("g", lambda g, i: F.struct(g["midi"].alias("midi"), F.greatest(F.lit(LEAST_SEC), until(g, i) - g["onset"]).alias("dur_sec")))
    chords = F.size(F.filter("g", lambda g: g["size"] > 1)) / F.size("g")
    return folded.select("file", "track_idx", "track_name", "channel", chords.alias("chord_fraction"), made.alias("notes"))


def melodies(notes: DataFrame) -> DataFrame:
    """One row a voice: name, n_notes (MOST_NOTES at most), truncated, duration_sec, chord_fraction, notes."""
    voices = collapse_chords(pitched(notes))
    track = Window.partitionBy("file", "track_idx")
    base = F.when(F.coalesce(F.col("track_name"), F.lit("")) != "", F.col("track_name")).otherwise(F.concat(F.lit("Part "), (F.col("track_idx") + 1).cast("string")))
    voice = F.row_number().over(track.orderBy("channel"))
    named = voices.withColumns({"n": F.count(F.lit(1)).over(track), "voice": voice}).withColumn("name", F.when(F.col("n") > 1, F.concat(base, F.lit(" (voice "), F.col("voice").cast("string"), F.lit(")"))).otherwise(base))
    kept = named.withColumns({"truncated": F.size("notes") > MOST_NOTES, "notes": F.slice("notes", 1, MOST_NOTES)})
    total = F.aggregate("notes", F.lit(0.0), lambda a, n: a + n["dur_sec"])
    return kept.select("file", "track_idx", "channel", "name", F.size("notes").alias("n_notes"), "truncated", total.alias("duration_sec"), "chord_fraction", "notes")


def rest_before(gap: Column) -> Column:
    return gap > REST_SEC


def with_gaps(notes: DataFrame) -> DataFrame:
    """Adds gap, the silence before each note; null at a sequence's first."""
    return notes.withColumn("gap", F.col("start_sec") - F.lag("end_sec").over(Window.partitionBy("seq_id").orderBy("pos")))


def sequence_text(notes: DataFrame) -> DataFrame:
    """seq_id, text: note names in order, rests as slashes."""
    part = F.concat(F.when(rest_before(F.col("gap")), "/ ").otherwise(""), note_name(F.col("midi")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    return with_gaps(notes).groupBy("seq_id").agg(F.array_join(F.transform(ordered, lambda r: r["part"]), " ").alias("text"))


def schedule(notes: DataFrame, octaves: int = 0) -> DataFrame:
    """seq_id, pos, midi, start_sec, duration_sec: long silences cut short, short notes drawn out."""
    silence = F.greatest(F.lit(0.0), F.coalesce("gap", F.lit(0.0)))
    sound = F.greatest(F.lit(LEAST_SOUND), F.col("dur_sec"))
    rows = with_gaps(notes).withColumns({"wait": F.when(silence > LONG_GAP, SHORT_GAP).otherwise(silence), "sound": sound})
    reached = F.sum(F.col("wait") + F.col("sound")).over(Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("seq_id", "pos", (F.col("midi") + 12 * octaves).alias("midi"), (reached - F.col("sound")).alias("start_sec"), F.col("sound").alias("duration_sec"))


def display_octave(notes: DataFrame) -> DataFrame:
    """seq_id, shift: of 0, -1 and -2 the one that brings the median staff step nearest the middle line."""
    middle = notes.groupBy("seq_id").agg(F.median(staff_step(F.col("midi"))).alias("m"))
    far = lambda s: F.struct(F.abs(F.col("m") + 7 * s - MIDDLE_STEP).alias("far"), F.lit(abs(s)).alias("size"), F.lit(s).alias("shift"))
    return middle.select("seq_id", F.array_min(F.array(far(0), far(-1), far(-2)))["shift"].alias("shift"))


def usable(low: Column, high: Column) -> Column:
    return F.coalesce(low.isNotNull() & high.isNotNull() & (high > low), F.lit(False))


def drill_range(low: Column, high: Column) -> tuple[Column, Column]:
    """A register of one to two octaves around the measured one's centre."""
    centre, span = (low + high) / 2, F.greatest(F.lit(LEAST_SPAN), F.least(F.lit(MOST_SPAN), high - low))
    known = usable(low, high)
    return F.when(known, half_up(centre - span / 2).cast("int")).otherwise(DRILL_LOW), F.when(known, half_up(centre + span / 2).cast("int")).otherwise(DRILL_HIGH)


def undo_tuning(notes: DataFrame, offset: Column) -> DataFrame:
    """The notes as measured, before the offset (cents) was taken out."""
    measured = F.col("midi") + F.col("cents_offset") / 100 + offset / 100
    whole = half_up(measured).cast("int")
    moved = offset != 0
    return notes.withColumns({"midi": F.when(moved, whole).otherwise(F.col("midi")), "cents_offset": F.when(moved, (measured - whole) * 100).otherwise(F.col("cents_offset"))})


def supersaw_cents(count: int = 7, most: float = 25.0, power: float = 1.5) -> list[float]:
    """Offsets of the voices from the lowest: pairs that spread by a power, one at 0 if the count is odd."""
    pairs = count // 2
    side = [most * (k / pairs) ** power for k in range(1, pairs + 1)]
    return [-x for x in reversed(side)] + [0.0] * (count % 2) + side


def staff_places(at: Column, width: float) -> tuple[Column, Column]:
    """Row and x of the note at a place (from 0) on rows of a width."""
    per_row = max(1, int(max(SPACING, width - LEFT - RIGHT) // SPACING))
    return F.floor(at / per_row).cast("int"), LEFT + at % per_row * SPACING + SPACING / 2


def trimmed_to(keep_from: Column, keep_to: Column, at: Column, size: Column) -> tuple[Column, Column]:
    """The kept part [from, to) of a draft once its nearer end has been moved to a note."""
    low = at <= (keep_from + keep_to - 1) / 2
    known = (at >= 0) & (at < size)
    first = F.when(~known, keep_from).when(low, at).otherwise(F.least(keep_from, at))
    last = F.when(~known, keep_to).when(low, F.greatest(keep_to, at + 1)).otherwise(at + 1)
    return first, last


def shifted(octaves: Column, by: Column) -> Column:
    return F.greatest(F.lit(-MOST_SHIFT), F.least(F.lit(MOST_SHIFT), octaves + by))


def named_runs(frames: DataFrame, note: Column, valid: Column, least: int = 8) -> DataFrame:
    """take_id, start_idx, n, note of stretches of one note among valid frames, least frames long."""
    by = Window.partitionBy("take_id").orderBy("frame_idx")
    own = frames.select("take_id", "frame_idx", F.when(valid, note).alias("note"))
    fresh = F.when(F.col("note").eqNullSafe(F.lag("note").over(by)), 0).otherwise(1)
    runs = own.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by))
    spans = runs.where("note is not null").groupBy("take_id", "run", "note").agg(F.min("frame_idx").alias("start_idx"), F.count(F.lit(1)).alias("n"))
    return spans.where(F.col("n") >= least).drop("run")


def live_trail(points: DataFrame, most: int = 6000) -> DataFrame:
    """The newest points of each take (take_id, frame_idx, midi); runs of silence are one break."""
    order = Window.partitionBy("take_id").orderBy("frame_idx")
    marked = points.withColumns({"__first": F.row_number().over(order) == 1, "__before": F.lag("midi").over(order)})
    kept = marked.where("midi is not null or __first or __before is not null").drop("__first", "__before")
    age = F.row_number().over(Window.partitionBy("take_id").orderBy(F.desc("frame_idx")))
    return kept.withColumn("__age", age).where(F.col("__age") <= most).drop("__age")


def plot_grid(points: DataFrame, columns: int = 150, rows: int = 30) -> DataFrame:
    """take_id, row, column, mark of each take's plot of pitch (take_id, t_sec, midi, clarity, snr_db).

    Bounds come from the sure points, if there are more than twenty, by truncated ranks; the surest point
    of a cell gives its mark.
    """
    sure = (F.col("clarity") >= 0.5) & (F.col("snr_db") >= 12)
    ends = points.groupBy("take_id").agg(F.max("t_sec").alias("end"), F.sort_array(F.collect_list(F.when(sure, F.col("midi")))).alias("sure"), F.sort_array(F.collect_list("midi")).alias("all"))
    ends = ends.withColumn("x", F.when(F.size("sure") > 20, F.col("sure")).otherwise(F.col("all"))).where(F.size("x") > 0)
    rank = lambda p: F.get(F.col("x"), F.floor(p * (F.size("x") - 1)).cast("int"))
    bounds = ends.select("take_id", "end", (F.floor(rank(0.02)) - 2).alias("low"), (F.ceil(rank(0.98)) + 2).alias("high"))
    place = points.where("midi is not null").join(bounds, "take_id")
    column = F.least(F.lit(columns - 1), F.greatest(F.lit(0), half_up(F.col("t_sec") / F.col("end") * (columns - 1)))).cast("int")
    row = half_up((F.col("high") - F.col("midi")) / (F.col("high") - F.col("low")) * (rows - 1)).cast("int")
    level = F.when(sure, 2).when(F.col("clarity") >= 0.25, 1).otherwise(0)
    cells = place.select("take_id", row.alias("row"), column.alias("column"), level.alias("level")).where((F.col("row") >= 0) & (F.col("row") < rows))
    best = cells.groupBy("take_id", "row", "column").agg(F.max("level").alias("level"))
    return best.select("take_id", "row", "column", F.element_at(F.array(F.lit("."), F.lit("+"), F.lit("#")), F.col("level") + 1).alias("mark"))


ECHO_LOW, ECHO_HIGH, ECHO_SEC = 3, 6, 0.5


def phrase(weights: Column, seed: Column, length: Column, low: int, high: int) -> Column:
    """Notes of a walk in a register as an array: a start in its middle third, then steps drawn by weight that stay inside.

    weights is an array of (step, weight) by step. The kth note takes the seed's kth draw.
    """
    inner = max(1, (high - low) // 3)
    start = F.floor(uniform(seed, 1) * (inner + 1)).cast("int") + low + (high - low - inner) // 2

    def step(notes: Column, k: Column) -> Column:
        at = F.element_at(notes, -1)
        allowed = F.filter(weights, lambda w: (w["weight"] > 0) & (at + w["step"] >= low) & (at + w["step"] <= high))
        first = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("int").alias("step"))

        def picked(ways: Column) -> Column:
            total = F.aggregate(ways, F.lit(0.0), lambda run, w: run + w["weight"])
            draw = uniform(seed, k) * total
            passed = F.aggregate(ways, first, lambda s, w: F.struct((s["run"] + w["weight"]).alias("run"), F.coalesce(s["step"], F.when(s["run"] + w["weight"] > draw, w["step"])).alias("step")))
            return F.coalesce(passed["step"], F.element_at(ways, -1)["step"])

        return F.concat(notes, F.transform(F.array(allowed), lambda ways: at + picked(ways)))

    count = F.greatest(F.lit(ECHO_LOW), F.least(F.lit(ECHO_HIGH), length))
    return F.aggregate(F.sequence(F.lit(2), count), F.array(start), step)


def echo_phrases(weights: DataFrame, lengths: DataFrame, low: int = DRILL_LOW, high: int = DRILL_HIGH) -> DataFrame:
    """user_id, pos, midi: a phrase of each user's length (user_id, length) from their step weights; the id is the seed."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("step").cast("int").alias("step"), F.col("weight").cast("double").alias("weight"))))
    own = weights.groupBy("user_id").agg(ordered.alias("weights")).join(lengths, "user_id")
    return own.select("user_id", F.posexplode(phrase(F.col("weights"), F.col("user_id"), F.col("length"), low, high)).alias("pos", "midi"))


def hold_references(seed: Column, count: int, low: Column, high: Column) -> Column:
    """Notes to hold, one after the other, a semitone inside the register and never the same twice running.

    A drawn note that repeats the one before is moved up by one, or down at the top.
    """
    bottom, top = F.ceil(low).cast("int") + 1, F.floor(high).cast("int") - 1

    def step(notes: Column, k: Column) -> Column:
        drawn = bottom + F.floor(uniform(seed, k) * (top - bottom + 1)).cast("int")
        before = F.get(notes, F.size(notes) - 1)
        return F.concat(notes, F.transform(F.array(drawn), lambda d: F.when(~d.eqNullSafe(before), d).when(d + 1 <= top, d + 1).otherwise(d - 1)))

    middle_note = half_up((low + high) / 2).cast("int")
    return F.when(top > bottom, F.aggregate(F.sequence(F.lit(1), F.lit(count)), F.array().cast("array<int>"), step)).otherwise(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: middle_note))
