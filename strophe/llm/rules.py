"""Operator 5: learned decision lists over quality statistics, in DataFrame operations only.

``statistics`` measures each whole text. ``learn`` reads the labelled statistics as counts: every feature
is cut at quantiles into at most ``BINS`` bins, and Spark counts good and bad rows of a growing and a
pruning part for each cell of bins. The cells are bounded (``BINS ** len(FEATURES)``, 32,768), so all
labelled rows count and only the cells come to the driver. There, sequential covering grows one
conjunction of thresholds after another for bad rows (FOIL gain), prunes it from its end on the pruning
part, and stops when a rule is not precise enough. The list becomes one ordered CASE expression.

Null texts have no words and fail the base rules; so do texts under 20 words. Labels with a null in
either column are left out, repeated labels count as often as they occur, and without labels the list is
empty and every text that passes the base rules is kept. Rows with null or repeated ids are kept, one out
for each one in. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, picked

SPACES = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
BINS = 8
MOST_RULES, MOST_TERMS = 8, 3
#: A rule must have at least this share of bad rows on the pruning part, and this many of them.
PRECISION, SUPPORT = 0.9, 5

FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    base = picked(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    measured = base.select(
        "id",
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("ls"),
        F.filter(F.split("t", SPACES), lambda w: w != "").alias("ws"),
    )
    hashed = measured.select(
        "id",
        "word_chars",
        "n_symbols",
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.size("ws").cast("long").alias("n_words"),
        F.transform("ws", lambda w: F.xxhash64(w)).alias("h"),
    )
    # a window's hash from those of its halves; the halves of windows of 8 are windows of 4, and so on
    for span in (1, 2, 4):
        tail = F.slice("h", F.lit(span + 1), F.greatest(F.size("h") - span, F.lit(0)))
        hashed = hashed.withColumn("h", F.zip_with(F.slice("h", F.lit(1), F.greatest(F.size("h") - span, F.lit(0))), tail, lambda a, b: F.xxhash64(a, b)))
    repeats = hashed.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("h")) < F.size("h"), _covered(F.col("h"))).otherwise(F.lit(0)).cast("long"))
    return repeats.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(h: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def twice(o: Column) -> Column:
        same = lambda i, j: F.get(o, i).getField("x").eqNullSafe(F.get(o, j).getField("x"))
        kept = F.filter(o, lambda s, i: ((i > 0) & same(i, i - 1)) | ((i < F.size(o) - 1) & same(i, i + 1)))
        return F.array_sort(F.transform(kept, lambda s: s.getField("i")))

    def spread(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    # the lambdas name the intermediate arrays, so each is computed once
    first = F.transform(F.array(ordered), lambda o: twice(o))
    return F.element_at(F.transform(first, lambda p: spread(p)), 1)


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    terms: tuple[Term, ...]
    bad: int
    good: int

    def sql(self) -> str:
        return " and ".join(t.sql() for t in self.terms)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain of narrowing p0 bad and n0 good rows to p and n."""
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))) if p else -1.0


def cover(cells: Sequence[tuple], cuts: dict[str, list[float]]) -> list[Rule]:
    """Sequential covering over cells: bins of the features, then bad and good of the growing and pruning parts."""
    names = list(FEATURES)
    k = len(names)
    inside = lambda cell, t: (cell[names.index(t.feature)] > cuts[t.feature].index(t.threshold)) == t.above
    tally = lambda rows, at: (sum(r[at] for r in rows), sum(r[at + 1] for r in rows))
    candidates = [Term(f, above, c) for f in names for c in cuts[f] for above in (True, False)]
    rest, rules = list(cells), []
    while len(rules) < MOST_RULES:
        rows, terms = rest, []
        while len(terms) < MOST_TERMS:
            p0, n0 = tally(rows, k)
            if not p0 or not n0:
                break
            scored = [(_gain(*tally([r for r in rows if inside(r, t)], k), p0, n0), -i) for i, t in enumerate(candidates)]
            best, at = max(scored)
            if best <= 0:
                break
            terms.append(candidates[-at])
            rows = [r for r in rows if inside(r, terms[-1])]

        def value(n: int) -> tuple[float, int]:
            p, q = tally([r for r in rest if all(inside(r, t) for t in terms[:n])], k + 2)
            return (p - q) / (p + q) if p + q else -1.0, -n

        if not terms:
            break
        terms = terms[: max(range(1, len(terms) + 1), key=value)]
        held = [r for r in rest if all(inside(r, t) for t in terms)]
        p, q = tally(held, k + 2)
        if p < SUPPORT or p < PRECISION * (p + q):
            break
        rules.append(Rule(tuple(terms), p, q))
        rest = [r for r in rest if not all(inside(r, t) for t in terms)]
    return rules


def learn(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """A decision list for label 0 from statistics and labels."""
    kinds = picked(labels, id=id_col, label=label_col).where("id is not null and label is not null")
    rows = measured.where("n_words > 0").join(kinds, "id").select("id", "label", *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    rows, _ = materialize(rows, "labelled")
    at = [i / BINS for i in range(1, BINS)]
    # quantiles of the bad rows too, as bad texts are few and lie at the ends
    got = rows.agg(*[F.percentile_approx(f, at, 1000).alias(f) for f in FEATURES], *[F.percentile_approx(F.when(F.col("label") == 0, F.col(f)), [0.1, 0.5], 1000).alias(f"{f}_bad") for f in FEATURES]).first()
    if got is None or any(got[f] is None for f in FEATURES):
        return []
    cuts = {}
    for f in FEATURES:
        own = sorted({*(got[f][i] for i in (0, 2, 4, 5, 6)), *(got[f"{f}_bad"] or [])})
        cuts[f] = own[: BINS - 1]
    bins = [sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES]
    part = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    bad = F.col("label") == 0
    cells = rows.select(*bins, part.alias("prune"), bad.alias("bad")).groupBy(*FEATURES).agg(F.count_if(~F.col("prune") & F.col("bad")), F.count_if(~F.col("prune") & ~F.col("bad")), F.count_if(F.col("prune") & F.col("bad")), F.count_if(F.col("prune") & ~F.col("bad")))
    return cover([tuple(r) for r in cells.collect()], cuts)  # at most BINS ** len(FEATURES) rows


def verdict(rules: Sequence[Rule]) -> Column:
    """The ordered list as one expression: false for the first rule that holds, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(F.expr(rule.sql()), F.lit(False)).otherwise(out)
    return out


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the statistics, base_failed and kept of each document."""
    measured, _ = materialize(statistics(docs, id_col, text_col), "quality")
    rules = learn(measured, labels.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else labels, id_col)
    kept = F.when(base_failed(), F.lit(False)).otherwise(verdict(rules))
    return measured.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"))
