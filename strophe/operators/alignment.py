"""Attempts aligned with their targets, whole in the engine: the search over transpositions, the path back, the second pass.

An attempt is a row of arrays, so nothing is exchanged. A table of least costs is a fold over the attempt's notes; it keeps the
way into each cell, and the path is unrolled from its end by a second fold. A transposition whose
lower bound can't beat the best cost so far is not filled; of equal costs the first in order stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attempts import CLEAN, DURATION, DURATION_PAIRS, EARLY_GAP, EPSILON, GAP, MOST_SUBSTITUTION, OFF, PRIOR, PRIOR_SEMITONES, REACH, REFERENCE_CENTS, REFERENCE_NOTES, SATURATION
from .drafts import let, middle

PAIR, SKIP_ATTEMPT, SKIP_TARGET = 0, 1, 2


def substitution(apart: Column) -> Column:
    """Cost of a pair by its distance in semitones: free at first, then growing to its most."""
    return MOST_SUBSTITUTION * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.abs(apart) - CLEAN / 100) / (SATURATION - CLEAN / 100)))


def prior(shift: Column) -> Column:
    """Cost of each pair under a transposition: a register of its own is free, far ones are less likely."""
    return PRIOR * F.least(F.abs(shift).cast("double"), F.lit(float(PRIOR_SEMITONES))) / PRIOR_SEMITONES


def _upto(first: int, last: Column) -> Column:
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def _mean(values: Column) -> Column:
    known = F.filter(values, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known))


def prepared(attempts: DataFrame) -> DataFrame:
    """attempt_id, n, m, apart and lasting (by attempt note, then target note), shifts in their order; null arrays are empty."""
    empty = F.array().cast("array<double>")
    rows = attempts.select("attempt_id", *[F.coalesce(F.col(c).cast("array<double>"), empty).alias(c) for c in ("sung", "target", "sung_sec", "target_sec")])
    logs = lambda c, like: F.when(F.size(c) == F.size(like), F.transform(c, lambda v: F.when(v > 0, F.log2(v)))).otherwise(F.transform(like, lambda v: F.lit(None).cast("double")))
    sized = rows.select("attempt_id", "sung", "target", F.size("sung").alias("n"), F.size("target").alias("m"), logs("sung_sec", "sung").alias("a"), logs("target_sec", "target").alias("b"))
    weight = F.lit(DURATION) * F.least(F.lit(1.0), F.lit(float(DURATION_PAIRS)) / F.greatest(F.lit(1), F.least("n", "m")))
    centre = F.coalesce(F.floor(middle(F.col("target")) - middle(F.col("sung")) + 0.5), F.lit(0)).cast("int")
    known = sized.withColumns({"tempo": F.coalesce(_mean(F.col("a")) - _mean(F.col("b")), F.lit(0.0)), "weight": weight, "centre": centre})
    around = [0, *(sign * k for k in range(1, REACH + 1) for sign in (-1, 1))]
    shifts = F.concat(F.transform(F.array(*[F.lit(k) for k in around]), lambda k: k + F.col("centre")), F.array(F.lit(0)))
    lasting = F.transform("a", lambda x: F.transform("b", lambda y: F.when(x.isNotNull() & y.isNotNull(), F.col("weight") * F.least(F.lit(1.0), F.abs(x - y - F.col("tempo")))).otherwise(0.0)))
    return known.select("attempt_id", "sung", "n", "m", F.transform("sung", lambda x: F.transform("target", lambda y: x - y)).alias("apart"), lasting.alias("lasting"), shifts.alias("shifts"))


def table(shift: Column, each: Column, ways: bool) -> Column:
    """cost of the best alignment under a shift and, if ways, the way into each cell, by attempt note (each: a pair's prior).

    A way is another one only where it is better by more than EPSILON: a pair, then a skipped note of the attempt, then one of the target.
    """
    n, m = F.col("n"), F.col("m")
    none = F.array().cast("array<array<int>>")
    first = F.struct(F.transform(_upto(0, m), lambda j: j * (GAP + F.when(n > 0, EARLY_GAP).otherwise(0.0))).alias("above"), none.alias("ways"))

    def row(state: Column, i: Column) -> Column:
        skip = GAP + F.when(i < n, EARLY_GAP).otherwise(0.0)
        start = F.struct(F.array(i * GAP).cast("array<double>").alias("costs"), F.array(F.lit(SKIP_ATTEMPT)).alias("ways"))

        def cell(done: Column, j: Column) -> Column:
            pair = F.get(state["above"], j - 1) + substitution(F.get(F.get("apart", i - 1), j - 1) + shift) + F.get(F.get("lasting", i - 1), j - 1) + each
            up, left = F.get(state["above"], j) + GAP, F.get(done["costs"], j - 1) + skip

            def best(three: Column) -> Column:
                p, u, left_ = three["p"], three["u"], three["l"]
                second = F.when(u < p - EPSILON, u).otherwise(p)
                way = F.when(left_ < second - EPSILON, SKIP_TARGET).when(u < p - EPSILON, SKIP_ATTEMPT).otherwise(PAIR)
                return F.struct(F.concat(done["costs"], F.array(F.when(left_ < second - EPSILON, left_).otherwise(second))).alias("costs"), (F.concat(done["ways"], F.array(way)) if ways else done["ways"]).alias("ways"))

            return let(F.struct(pair.alias("p"), up.alias("u"), left.alias("l")), best)

        filled = F.aggregate(_upto(1, m), start, cell)
        return let(filled, lambda r: F.struct(r["costs"].alias("above"), (F.concat(state["ways"], F.array(r["ways"])) if ways else state["ways"]).alias("ways")))

    return F.aggregate(_upto(1, n), first, row, lambda s: F.struct(F.element_at(s["above"], -1).alias("cost"), s["ways"].alias("ways")))


def least(shift: Column, each: Column) -> Column:
    """No alignment under a shift costs less: pairs for the shorter side at the best their rows allow, gaps for the rest."""
    longer = (F.col("n") - F.col("m")).cast("double")
    by_note = F.aggregate("apart", F.lit(0.0), lambda a, r: a + F.least(F.lit(2 * GAP), F.coalesce(F.array_min(F.transform(r, lambda x: substitution(x + shift))), F.lit(2 * GAP)) + each))
    return F.when(longer > 0, F.least(F.col("m"), F.col("n")) * each + longer * GAP).otherwise(by_note - longer * GAP)


def searched(rows: DataFrame) -> DataFrame:
    """rows with shift (the best transposition) and searched_cost, over all candidates in order."""
    start = F.struct(F.lit(float("inf")).alias("cost"), F.lit(0).alias("shift"))

    def better(best: Column, shift: Column) -> Column:
        each = prior(shift)
        tried = let(table(shift, each, ways=False)["cost"], lambda c: F.when(c < best["cost"] - EPSILON, F.struct(c.alias("cost"), shift.alias("shift"))).otherwise(best))
        return F.when(least(shift, each) < best["cost"] - EPSILON, tried).otherwise(best)

    return rows.withColumn("best", F.aggregate("shifts", start, better)).select("*", F.col("best.shift").alias("shift"), F.col("best.cost").alias("searched_cost")).drop("best", "shifts")


def path(ways: Column) -> Column:
    """(a, b): the notes of attempt and target that meet, in order; -1 on one side where a note was skipped."""
    none = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.col("n").alias("i"), F.col("m").alias("j"), none.alias("out"))

    def back(s: Column, _: Column) -> Column:
        way = F.when(s["i"] == 0, SKIP_TARGET).when(s["j"] == 0, SKIP_ATTEMPT).otherwise(F.get(F.get(ways, s["i"] - 1), s["j"]))

        def step(w: Column) -> Column:
            a, b = F.when(w == SKIP_TARGET, -1).otherwise(s["i"] - 1), F.when(w == SKIP_ATTEMPT, -1).otherwise(s["j"] - 1)
            return F.struct((s["i"] - F.when(w == SKIP_TARGET, 0).otherwise(1)).alias("i"), (s["j"] - F.when(w == SKIP_ATTEMPT, 0).otherwise(1)).alias("j"), F.concat(s["out"], F.array(F.struct(a.alias("a"), b.alias("b")))).alias("out"))

        return F.when((s["i"] == 0) & (s["j"] == 0), s).otherwise(let(way, step))

    return F.aggregate(_upto(1, F.col("n") + F.col("m")), start, back, lambda s: F.reverse(s["out"]))


def _met(p: Column) -> Column:
    return F.filter(p, lambda x: (x["a"] >= 0) & (x["b"] >= 0))


def reference(residuals: Column) -> Column:
    """Mean of residuals in cents that taper off towards OFF; 0 with fewer than two of weight."""
    weighed = F.filter(F.transform(residuals, lambda r: F.struct(r.alias("r"), F.greatest(F.lit(0.0), 1 - F.abs(r) / OFF).alias("w"))), lambda x: x["w"] > 0)
    total: Callable = lambda f: F.aggregate(weighed, F.lit(0.0), lambda a, x: a + f(x))
    mean = F.try_divide(total(lambda x: x["w"] * x["r"]), total(lambda x: x["w"]))
    return F.when(F.size(weighed) >= REFERENCE_NOTES, F.greatest(F.lit(-REFERENCE_CENTS), F.least(F.lit(REFERENCE_CENTS), mean))).otherwise(0.0)


def aligned(attempts: DataFrame) -> DataFrame:
    """attempt_id, n, m, sung, transposition, offset_cents, cost, searched_cost, moved (the whole shift) and path of every attempt."""
    found = searched(prepared(attempts))
    first = found.withColumn("ways", table(F.col("shift"), prior(F.col("shift")), ways=True)).withColumn("path", path(F.col("ways.ways")))
    residuals = F.transform(_met(F.col("path")), lambda p: (F.get(F.get("apart", p["a"]), p["b"]) + F.col("shift")) * 100)
    shifted = first.withColumn("offset_cents", reference(residuals)).withColumn("moved", F.col("shift") - F.col("offset_cents") / 100)
    again = shifted.withColumn("ways", F.when(F.col("offset_cents") == 0, F.col("ways")).otherwise(table(F.col("moved"), prior(F.col("shift")), ways=True)))
    last = again.withColumn("path", F.when(F.col("offset_cents") == 0, F.col("path")).otherwise(path(F.col("ways.ways"))))
    return last.select("attempt_id", "n", "m", "sung", "apart", F.col("shift").alias("transposition"), "offset_cents", F.col("ways.cost").alias("cost"), "searched_cost", "moved", "path")


def align_attempts(attempts: DataFrame) -> DataFrame:
    """Slots and extras of rows (attempt_id, sung, target, sung_sec, target_sec: arrays).

    A row for each note of the target (verdict missing without a note of the attempt), and one for each note the melody does not
    have: it has no slot, the verdict extra and the slot it comes after (-1: none). Null arrays are empty.
    """
    own = aligned(attempts)
    start = F.struct(F.lit(-1).alias("after"), F.array().cast("array<struct<a:int,b:int,after:int>>").alias("out"))

    def keep(s: Column, p: Column) -> Column:
        after = F.greatest(s["after"], p["b"])
        return F.struct(after.alias("after"), F.concat(s["out"], F.array(F.struct(p["a"].alias("a"), p["b"].alias("b"), after.alias("after")))).alias("out"))

    placed = own.withColumn("p", F.explode(F.aggregate("path", start, keep, lambda s: s["out"])))
    a, b = F.col("p.a"), F.col("p.b")
    residual = F.when((a >= 0) & (b >= 0), (F.get(F.get("apart", a), b) + F.col("moved")) * 100)
    size = F.abs(residual)
    verdict = F.when(a < 0, "missing").when(b < 0, "extra").when(size < CLEAN, "clean").when(size < OFF, "off").otherwise("wrong")
    return placed.select(
        "attempt_id", F.when(b >= 0, b).alias("slot"), F.when(a >= 0, a).alias("attempt_idx"), F.when(a >= 0, F.get("sung", a) + F.col("moved")).alias("heard"), residual.alias("residual_cents"),
        verdict.alias("verdict"), F.when(b < 0, F.col("p.after")).alias("after_slot"), "transposition", "offset_cents", "cost", "searched_cost",
    )
