"""Folds over aligned attempts: ledgers, tallies, weaknesses, ramps; overlays of attempts on melodies.

Slots are rows (user_id, attempt_id, attempt_no, target_id, slot, target_midi, residual_cents, verdict),
extras rows (the same keys, after_slot). Counts are combined before each shuffle; ordered folds collect
one value an attempt, never one a note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words
from .frames import ewma

# Fixed values of the reference.
OFF_CENTS = 70.0
HISTORY = 20
ADAPT_GAIN, LEAST_AVAILABILITY = 3.0, 0.3
TIERS = [(4, 1.0), (7, 0.4), (12, 0.15)]
RAMP_LOW, RAMP_HIGH = 3, 6
SLICE, LEAST_SLICE = 0.5, 1e-3
PADDING, LEAST_RANGE, EMPTY_CENTRE = 2, 12, 84
VERDICTS = ("clean", "off", "wrong", "missing")
STATS_VERSION = 1
_INTERVAL = "observations double, clean double, off double, wrong double, missing double, absCentsEwma double, centsObservations double, wrongRateEwma double"


def steps_into(slots: DataFrame) -> DataFrame:
    """Adds step, the directed interval from the slot before; null at the first slot."""
    before = F.lag("target_midi").over(Window.partitionBy("attempt_id").orderBy("slot"))
    return slots.withColumn("step", F.col("target_midi") - before)


def interval_ledger(slots: DataFrame) -> DataFrame:
    """One row per user and step: counts, and the means of the wrong rate and of the aim.

    Each attempt's slots are first put together, so an attempt moves a mean once. Attempts without a sung
    note do not move the wrong rate, nor those without a right one the aim.
    """
    aimed = F.col("verdict").isin("clean", "off")
    each = steps_into(slots).where("step is not null").groupBy("user_id", "step", "attempt_no").agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], F.sum(F.when(aimed, F.abs("residual_cents"))).alias("cents")
    )
    sung, right = F.col("clean") + F.col("off") + F.col("wrong"), F.col("clean") + F.col("off")
    rated = each.withColumns({"rate": F.try_divide("wrong", sung), "aim": F.try_divide("cents", right)})
    totals = [F.sum(v).alias(v) for v in VERDICTS]
    folded = rated.groupBy("user_id", "step").agg(*totals, ewma_known("attempt_no", "rate").alias("wrong_rate"), ewma_known("attempt_no", "aim").alias("abs_cents"))
    return folded.withColumns({"observations": sung, "cents_observations": right})


def ewma_known(order: str, x: str) -> Column:
    """The weighted mean over the rows whose value is known; 0 without any."""
    known = F.when(F.col(x).isNotNull(), F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x")))
    rows = F.array_sort(F.collect_list(known))
    return F.coalesce(F.aggregate(rows, F.lit(None).cast("double"), lambda a, r: F.coalesce(a + 0.25 * (r["x"] - a), r["x"])), F.lit(0.0))


def weakness() -> Column:
    """Of a ledger's row: the wrong rate, and half a point at most for aim."""
    aim = F.when(F.col("cents_observations") > 0, F.least(F.lit(1.0), F.col("abs_cents") / OFF_CENTS)).otherwise(0.0)
    return F.col("wrong_rate") + 0.5 * aim


def weakest(ledger: DataFrame, least: int = 3, limit: int | None = None) -> DataFrame:
    """Steps with evidence enough, worst first within each user: by weakness, more evidence, lower step."""
    ranked = ledger.where(F.col("observations") >= least).withColumn("weakness", F.round(weakness(), 9))
    order = Window.partitionBy("user_id").orderBy(F.desc("weakness"), F.desc("observations"), "step")
    rows = ranked.withColumn("rank", F.row_number().over(order))
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def base_weight(step: Column) -> Column:
    size = F.abs(step)
    out = F.when(size <= TIERS[0][0], TIERS[0][1])
    for most, weight in TIERS[1:]:
        out = out.when(size <= most, weight)
    return out.otherwise(0.0)


def step_weights(users: DataFrame, ledger: DataFrame, span: int = 12, least: int = 5) -> DataFrame:
    """user_id, step, weight of every step up to an octave, raised where the ledger shows a weakness."""
    steps = users.select("user_id", F.explode(F.expr("filter(sequence(-12, 12), s -> s <> 0)")).alias("step"))
    known = ledger.where(F.col("observations") >= least).select("user_id", "step", weakness().alias("weakness"))
    places = span + 1
    gain = ADAPT_GAIN / F.greatest(F.lit(LEAST_AVAILABILITY), (places - F.abs("step")) / F.lit(places))
    return steps.join(known, ["user_id", "step"], "left").select("user_id", "step", (base_weight(F.col("step")) * (1 + gain * F.coalesce("weakness", F.lit(0.0)))).alias("weight"))


def weighted_pick(weights: DataFrame, key: str, order: str, weight: str, draw: Column) -> DataFrame:
    """key, order of the first row whose running weight passes draw (0 to 1) of the total; zeros never."""
    own = Window.partitionBy(key)
    running = F.sum(weight).over(own.orderBy(order))
    rows = weights.where(F.col(weight) > 0).withColumns({"__run": running, "__total": F.sum(weight).over(own)})
    passed = F.when(F.col("__run") > draw * F.col("__total"), F.col(order))
    return rows.groupBy(key).agg(F.coalesce(F.min(passed), F.max(order)).alias(order))


def counted(slots: DataFrame, extras: DataFrame) -> DataFrame:
    """Counts of the five outcomes of each attempt."""
    own = slots.groupBy("user_id", "attempt_id", "attempt_no", "target_id").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    added = extras.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("extra"))
    return own.join(added, "attempt_id", "left").withColumn("extra", F.coalesce("extra", F.lit(0).cast("long")))


def same_length(attempts: DataFrame, length: str = "n_slots") -> DataFrame:
    """The attempts since the target last changed its length; the older ones were about another melody."""
    own = Window.partitionBy("target_id").orderBy("attempt_no")
    changed = F.when(F.col(length) != F.lag(length).over(own), 1).otherwise(0)
    numbered = attempts.withColumn("__changed", changed).withColumn("__session", F.sum("__changed").over(own))
    last = F.max("__session").over(Window.partitionBy("target_id"))
    return numbered.withColumn("__last", last).where("__session = __last").drop("__changed", "__session", "__last")


def target_tallies(slots: DataFrame) -> DataFrame:
    """target_id, slot, attempts, counts, trouble since the target last changed its length."""
    lengths = slots.groupBy("target_id", "attempt_id", "attempt_no").agg(F.count(F.lit(1)).alias("n_slots"))
    live = same_length(lengths).select("attempt_id")
    tallied = slots.join(live, "attempt_id").groupBy("target_id", "slot").agg(F.count(F.lit(1)).alias("attempts"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return tallied.withColumn("trouble", F.least(F.lit(1.0), (F.col("wrong") + 0.7 * F.col("missing") + 0.35 * F.col("off")) / F.col("attempts")))


def trouble_spots(tallies: DataFrame, least: int = 2, bad: int = 2) -> DataFrame:
    """Slots with attempts and failures enough, worst first within each target."""
    rows = tallies.withColumns({"bad": F.col("wrong") + F.col("missing"), "trouble": F.round("trouble", 9)}).where((F.col("attempts") >= least) & (F.col("wrong") + F.col("missing") >= bad))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("trouble"), F.desc("bad"), "slot")))


def attempt_history(slots: DataFrame, keep: int = HISTORY) -> DataFrame:
    """target_id, attempt_no, verdicts (a character a slot): the newest attempts of the target's present length."""
    coded = F.array_sort(F.collect_list(F.struct("slot", words.verdict_code(F.col("verdict")).alias("c"))))
    each = slots.groupBy("target_id", "attempt_id", "attempt_no").agg(F.count(F.lit(1)).alias("n_slots"), F.array_join(F.transform(coded, lambda r: r["c"]), "").alias("verdicts"))
    newest = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("attempt_no")))
    return same_length(each).withColumn("age", newest).where(F.col("age") <= keep)


def hold_averages(holds: DataFrame) -> DataFrame:
    """user_id, count, offset, wobble: means over holds (user_id, at, median, wobble, drift) that did not slide."""
    kept = holds.where(~words.drift_dominates(F.col("wobble"), F.col("drift"))).withColumn("wobble", F.greatest(F.lit(0.0), F.col("wobble")))
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("count"), ewma("at", "median").alias("offset"), ewma("at", "wobble").alias("wobble"))


def echo_lengths(counts: DataFrame, first: int = RAMP_LOW) -> DataFrame:
    """user_id, length: of the next phrase after all attempts, a note longer after each success, else shorter."""
    got = (F.col("wrong") + F.col("missing") + F.col("extra") == 0) & (F.col("clean") + F.col("off") > 0)
    order = F.array_sort(F.collect_list(F.struct("attempt_no", got.alias("got"))))
    step = lambda n, r: F.greatest(F.lit(RAMP_LOW), F.least(F.lit(RAMP_HIGH), n + F.when(r["got"], 1).otherwise(-1)))
    return counts.groupBy("user_id").agg(F.aggregate(order, F.lit(first), step).alias("length"))


def padded_range(low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds of a plot: padded, an octave at least, around C6 when there is nothing."""
    bottom = F.floor(F.coalesce(low, F.lit(EMPTY_CENTRE))) - PADDING
    top = F.ceil(F.coalesce(high, F.lit(EMPTY_CENTRE))) + PADDING
    short = F.greatest(F.lit(0), LEAST_RANGE - (top - bottom))
    return (bottom - F.floor(short / 2)).cast("int"), (top + F.ceil(short / 2)).cast("int")


def register_slipped() -> Column:
    """Some slot held, and some wrong slot an octave out."""
    held = F.bool_or(F.col("verdict").isin("clean", "off"))
    return held & F.bool_or((F.col("verdict") == "wrong") & words.octave_out(F.col("residual_cents")))


def takeaways(slots: DataFrame, extras: DataFrame) -> DataFrame:
    """attempt_id, takeaway: the one sentence: the first wrong note, the first missing, the worst off, the extras."""
    said = lambda r: F.concat(F.lit("The "), words.ordinal(r["slot"] + 1), F.lit(" note came out "), words.distance(r["residual_cents"]), F.lit("."))
    own = F.struct("slot", "residual_cents")
    first = lambda v: F.min_by(own, F.when(F.col("verdict") == v, F.col("slot")))
    worst = F.max_by(own, F.when(F.col("verdict") == "off", F.struct(F.abs("residual_cents").alias("size"), -F.col("slot"))))
    each = slots.groupBy("attempt_id").agg(first("wrong").alias("wrong"), first("missing").alias("missing"), worst.alias("off"))
    n = extras.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("extra"))
    rows = each.join(n, "attempt_id", "left")
    w, m, o, e = (F.col(c) for c in ("wrong", "missing", "off", "extra"))
    text = (
        F.when(w.isNotNull() & words.octave_out(w["residual_cents"]), words.SLIPPED)
        .when(w.isNotNull(), said(w))
        .when(m.isNotNull(), F.concat(F.lit("The "), words.ordinal(m["slot"] + 1), F.lit(" note never arrived.")))
        .when(o.isNotNull(), said(o))
        .when(e == 1, "There was one note in there the melody does not have.")
        .when(e > 1, F.concat(F.lit("There were "), e.cast("string"), F.lit(" notes in there the melody does not have.")))
        .otherwise(words.LANDED)
    )
    return rows.select("attempt_id", text.alias("takeaway"))


def overlay(slots: DataFrame, extras: DataFrame) -> DataFrame:
    """attempt_id, index, slot, attempt_idx, outcome, residual_cents, start_sec, end_sec of what is drawn.

    Slots stand in the melody's order and extras after the slot they followed. Missing slots share the
    silence around them, or a slice of half the median note each where that is too short.
    """
    names = ["attempt_id", "slot", "attempt_idx", "outcome", "target_midi", "heard_midi", "residual_cents", "start_sec", "end_sec"]
    heard = F.col("sung_midi") + F.col("cents_offset") / 100
    own = slots.select("attempt_id", F.col("slot").alias("place"), F.lit(0).alias("late"), "slot", "attempt_idx", F.col("verdict").alias("outcome"), "target_midi", heard.alias("heard_midi"), "residual_cents", "start_sec", "end_sec")
    added = extras.select("attempt_id", F.col("after_slot").alias("place"), F.lit(1).alias("late"), "attempt_idx", F.lit("extra").alias("outcome"), heard.alias("heard_midi"), "start_sec", "end_sec")
    by = Window.partitionBy("attempt_id")
    order = by.orderBy("place", "late", "attempt_idx")
    sung = F.when(F.col("start_sec").isNotNull(), F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec")))
    every = own.unionByName(added, allowMissingColumns=True)
    upto, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    rows = every.withColumn("index", F.row_number().over(order) - 1).withColumn("at", F.when(F.col("start_sec").isNotNull(), F.struct("index", "start_sec")))
    rows = rows.withColumns({
        "before": F.coalesce(F.last("end_sec", ignorenulls=True).over(upto), F.lit(0.0)),
        "first": F.max("start_sec").over(upto).isNull(),
        "next": F.first("at", ignorenulls=True).over(onward),
        # missing slots between two that were sung are numbered by place: a window by them would sort all rows again
        "k": F.col("index") - F.coalesce(F.last("at.index", ignorenulls=True).over(upto), F.lit(-1)) - 1,
        "all": F.count(F.lit(1)).over(by),
        "take_end": F.coalesce(F.max("end_sec").over(by), F.lit(0.0)),
        "slice": F.greatest(F.lit(LEAST_SLICE), SLICE * F.coalesce(F.median(sung).over(by), F.lit(0.2))),
    })
    rows = rows.withColumn("count", F.coalesce("next.index", "all") - F.col("index") + F.col("k"))
    need = F.col("count") * F.col("slice")
    after = F.coalesce("next.start_sec", F.col("take_end") + need)
    room = after - F.col("before")
    start = F.when(room >= need, F.col("before")).when(F.col("first"), after - need).otherwise(F.greatest(F.lit(0.0), (F.col("before") + after) / 2 - need / 2))
    width = F.greatest(room, need)
    missing = F.col("outcome") == "missing"
    placed = rows.withColumns({"__start": F.when(missing, start + width * F.col("k") / F.col("count")).otherwise(F.col("start_sec")), "__end": F.when(missing, start + width * (F.col("k") + 1) / F.col("count")).otherwise(F.col("end_sec"))})
    return placed.drop("start_sec", "end_sec").withColumnsRenamed({"__start": "start_sec", "__end": "end_sec"}).select(*names[:1], "index", *names[1:])


def chips(items: DataFrame) -> DataFrame:
    """The verdict strip of an overlay: a pitch is named only where it was wrong or extra."""
    named = F.when(F.col("outcome").isin("wrong", "extra"), F.floor(F.col("heard_midi") + 0.5).cast("int"))
    return items.select("attempt_id", "index", "outcome", (F.col("slot") + 1).alias("position"), F.col("residual_cents").alias("cents"), named.alias("name_midi"))


def stats_documents(ledger: DataFrame, version: Column | None = None) -> DataFrame:
    """user_id, json: each user's ledger as a document, steps as its keys."""
    stat = F.struct("observations", *VERDICTS, F.col("abs_cents").alias("absCentsEwma"), F.col("cents_observations").alias("centsObservations"), F.col("wrong_rate").alias("wrongRateEwma"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("step").cast("string").alias("step"), stat.alias("stat")))))
    body = F.struct((F.lit(STATS_VERSION) if version is None else F.first(version)).alias("version"), entries.alias("intervals"))
    return ledger.groupBy("user_id").agg(F.to_json(body).alias("json"))


def read_stats(documents: DataFrame) -> DataFrame:
    """user_id, step and the ledger's columns of documents (user_id, json) of this version.

    Another version has no rows. Keys that are no whole number are left out; counts that are missing or
    negative are 0, means are held to their ranges.
    """
    read = F.from_json("json", F.lit(f"version double, intervals map<string, struct<{_INTERVAL}>>"))
    rows = documents.select("user_id", read.alias("d")).where(F.col("d.version") == STATS_VERSION).select("user_id", F.explode("d.intervals").alias("key", "s"))
    count = lambda c: F.greatest(F.lit(0), F.floor(F.coalesce(F.col(f"s.{c}"), F.lit(0.0)))).cast("long")
    mean = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.col(f"s.{c}"), F.lit(0.0)))
    counts = [count(v).alias(v) for v in (*VERDICTS, "observations")]
    known = rows.where("s is not null").withColumn("step", F.expr("try_cast(key as int)")).where("step is not null")
    return known.select("user_id", "step", *counts, count("centsObservations").alias("cents_observations"), F.least(F.lit(1.0), mean("wrongRateEwma")).alias("wrong_rate"), mean("absCentsEwma").alias("abs_cents"))
