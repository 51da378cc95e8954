"""Operator 6: fuzzy line deduplication by MinHash, in DataFrame operations only.

Every line that is not blank takes part; a line shorter than a shingle is a copy only of lines equal to it.
A longer line has the set of its ``SHINGLE``-character shingles. One 64-bit hash a shingle gives 49
minima: a rotation, other bits first for each, and exclusive or with fixed random numbers make as many
orders of the hashes. The minima are the points of a 7 x 7 grid and the bands 35 of its lines (five slopes,
which wrap), of which any two share one minimum at most: by simulation a pair agrees on no band with
probability 0.008 at similarity 0.8, 0.0007 at 0.85, and unlike lines rarely do: 0.06 at 0.4.

Lines that agree on a band meet in a bucket. Buckets of two are pairs. In a larger one every member is
first verified against its heaviest line (occurrences times length), and union-find joins those at 0.8 or
more; only then are pairs verified whose lines are still in different components. Small buckets form those
pairs themselves; members of larger ones meet on the first fifth of their shingles, rare ones first, of which two lines at
0.8 or more must share one. They meet within families only, which large buckets and components join, and rare is what is
rare in the family: an outer line's edits then come before what its family has in common, and by their number tell it
from all copies of that family at once. Sets are of 64-bit hashes of shingles. Before a pair is verified, a bit map of each line's shingles sorts out pairs
that differ in more bits than alike lines can: a bound, so no link is lost.

Of each component the line of the smallest (id, line number) stays; lines with equal text are one node,
and their other occurrences go too. Nodes are 64-bit hashes of lines; a second hash tells collisions, and
a line whose first hash is another line's stays where it is.

Lines and the counts of buckets are combined before the shuffle, so frequent lines and bands do not pile
up. Each distinct line is shuffled once, as text, and its minima are made where it then lies; 16 bits of each are
kept. Texts of candidates are picked by a bitmap and then an exact join.

Null texts have no lines and stay null; blank lines always stay, and so do their places. Rows with a null
id count as smallest and null ids equal each other; rows that repeat an id and a text keep or lose the same
lines. An empty table gives an empty table. ``dedup_lines`` keeps all other columns, whatever their names.
"""

from __future__ import annotations

import functools
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_place, discard, materialize, picked, place_of
from .components import components

SHINGLE = 5  # one changed character inside a line of 49 or more, or a run of two in 58 or more, still links
GRID, SLOPES = 7, 5
#: Bits of a minimum that are kept, low ones, which do not hang on its size, and minima in a word: other minima agree on them once in 65,536 times.
PART, EACH = 16, 4
SIMILARITY = 0.8
BLANK = " \t\r\x0b\x0c"
ROUNDING = 1e-9
WORDS = 16  # of 64 bits in a line's map
STEP = 16  # shingles hashed side by side in one row
MAP_STEP = 4
SMALL = 16  # lines of a bucket that form their pairs themselves, at most 8 a line
#: Bits of a broadcast bitmap for each value it holds, and at most: 4 MB.
BITS_EACH, BITS_MOST = 16, 1 << 25

_draw = random.Random(20)
MASKS = [_draw.getrandbits(64) - (1 << 63) for _ in range(GRID * GRID)]
TURNS = [19 * j % 64 for j in range(GRID * GRID)]
#: The lines of the grid by slope, as numbers of minima: y = slope * x + t for each t.
BANDS = [[[x * GRID + (slope * x + t) % GRID for x in range(GRID)] for t in range(GRID)] for slope in range(SLOPES)]


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the document's text), n (line number from 0), line, for lines that are not blank."""
    every = picked(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return every.where(F.length(F.trim("line", F.lit(BLANK))) > 0)


def _order(h: Column, j: int) -> Column:
    """A hash as the order j has it: rotated left by TURNS[j] bits, exclusive or MASKS[j]."""
    turned = F.shiftleft(h, TURNS[j]).bitwiseOR(F.shiftrightunsigned(h, 64 - TURNS[j])) if TURNS[j] else h
    return turned.bitwiseXOR(F.lit(MASKS[j]))


def _hashes(lines: DataFrame, step: int, unit: int) -> DataFrame:
    """h0 ... of every step shingles of each line, with its other columns; the last ones may repeat.

    With units of 4 bytes a shingle is SHINGLE characters, with units of 2 as many UTF-16 units, which is
    quicker and differs only beyond the basic plane."""
    width, last = unit * SHINGLE, f"length(b) - {unit * SHINGLE - 1}"
    own = [c for c in lines.columns if c != "line"]
    coded = lines.select(*own, F.encode("line", {2: "UTF-16BE", 4: "UTF-32"}[unit]).alias("b"))
    blocks = coded.select(*own, "b", F.explode(F.expr(f"sequence(1, {last}, {unit * step})")).alias("i"))
    return blocks.select(*own, *[F.xxhash64(F.expr(f"substring(b, least(i + {unit * k}, {last}), {width})")).alias(f"h{k}") for k in range(step)])


def signatures(lines: DataFrame) -> DataFrame:
    """lid, weight (which grows with the line's occurrences), w0 ... (PART bits of each minimum) of each distinct line.

    The lines are dealt out once, as texts, by lid; what follows goes by lid too and needs no shuffle of the minima.
    """
    distinct = lines.groupBy("lid").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("n"))
    least = [F.min(F.least(*[_order(F.col(f"h{k}"), j) for k in range(STEP)])).alias(f"m{j}") for j in range(GRID * GRID)]
    minima = _hashes(distinct, STEP, 2).groupBy("lid").agg((F.count(F.lit(1)) * F.max("n")).alias("weight"), *least)
    parts = [F.shiftleft(F.col(f"m{j}").bitwiseAND(F.lit((1 << PART) - 1)), j % EACH * PART) for j in range(GRID * GRID)]
    words = [functools.reduce(Column.bitwiseOR, parts[i : i + EACH]).alias(f"w{i // EACH}") for i in range(0, len(parts), EACH)]
    return minima.select("lid", "weight", *words)


def _keys(slope: int) -> Column:
    """The keys of a line's bands of a slope, from the words of signatures."""

    def part(j: int) -> Column:
        return F.shiftrightunsigned(F.col(f"w{j // EACH}"), j % EACH * PART).bitwiseAND(F.lit((1 << PART) - 1))

    return F.array(*[F.xxhash64(F.lit(slope), F.lit(t), *[part(j) for j in band]) for t, band in enumerate(BANDS[slope])])


def _set(line: Column) -> Column:
    """The hashes of a line's shingles of SHINGLE characters, each once."""
    width = 4 * SHINGLE

    def hashed(b: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(b) - (width - 1), F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(width))))

    # the lambda names the bytes, so they are made once
    return F.array_distinct(F.element_at(F.transform(F.array(F.encode(line, "UTF-32")), hashed), 1))


def _sieve(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose column may be among wanted's: a bitmap of at most BITS_MOST bits, in words, is broadcast."""
    bits = min(BITS_MOST, 1 << max(16, (BITS_EACH * wanted.count()).bit_length()))
    place = F.pmod(F.col(column), F.lit(bits))
    word, bit = F.shiftright(place, 6), F.expr(f"cast(pmod(`{column}`, {bits}L) & 63 as int)")
    parts = wanted.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("map"))
    met = rows.withColumn("word", word).join(F.broadcast(parts), "word")
    return met.where(F.call_function("shiftright", F.col("map"), bit).bitwiseAND(F.lit(1)) == 1).drop("word", "map")


def buckets(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) that are buckets of two, and (key, lid, weight) of the members of larger buckets.

    Slope by slope, so that no more keys lie on disk at once than there are bands of one slope.
    """
    twos, members = [], []
    for slope in range(SLOPES):
        keyed = signed.select("lid", "weight", F.explode(_keys(slope)).alias("key"))
        counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("lid").alias("u"), F.min("lid").alias("v"))
        shared, path = materialize(counted.where("n > 1"), "shared")
        twos.append(materialize(shared.where("n = 2").select("u", "v").distinct(), "twos")[0])
        large = shared.where("n > 2").select("key")
        members.append(materialize(_sieve(keyed, "key", large).join(large, "key"), "buckets")[0])
        discard(signed.sparkSession, path)
    return functools.reduce(DataFrame.union, twos), functools.reduce(DataFrame.union, members)


def _measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) with the exact similarity s of their shingle sets."""
    right = texts.select(F.col("lid").alias("v"), F.col("line").alias("lv"))
    met = pairs.join(texts.select(F.col("lid").alias("u"), F.col("line").alias("lu")), "u").join(right, "v")
    sets = F.struct(_set(F.col("lu")).alias("a"), _set(F.col("lv")).alias("b"))

    def similarity(x: Column) -> Column:
        return F.size(F.array_intersect(x.getField("a"), x.getField("b"))) / F.size(F.array_union(x.getField("a"), x.getField("b")))

    # the lambda names the two arrays, so each is made once
    return met.select("u", "v", F.element_at(F.transform(F.array(sets), similarity), 1).alias("s"))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return _measured(pairs, texts).where(F.col("s") >= SIMILARITY - ROUNDING).select("u", "v")


def sketches(texts: DataFrame) -> DataFrame:
    """lid, places (of shingles), map: WORDS words in which every shingle sets the bit that its hash names."""
    hashes = _hashes(texts, MAP_STEP, 4)

    def own(k: int, j: int) -> Column:
        h = F.col(f"h{k}")
        return F.when(h.bitwiseAND(F.lit(WORDS - 1)) == j, F.col(f"b{k}")).otherwise(F.lit(0).cast("long"))

    bits = hashes.select("lid", *[F.col(f"h{k}") for k in range(MAP_STEP)], *[F.expr(f"shiftleft(1L, cast(shiftright(h{k}, 6) & 63 as int)) as b{k}") for k in range(MAP_STEP)])
    words = [F.bit_or(functools.reduce(Column.bitwiseOR, [own(k, j) for k in range(MAP_STEP)])).alias(f"w{j}") for j in range(WORDS)]
    made = bits.groupBy("lid").agg((F.count(F.lit(1)) * MAP_STEP).alias("places"), *words)
    return made.select("lid", "places", F.array(*[F.col(f"w{j}") for j in range(WORDS)]).alias("map"))


def _as(maps: DataFrame, side: str) -> DataFrame:
    return maps.select(F.col("lid").alias(side), F.col("places").alias(f"{side}n"), F.col("map").alias(f"{side}m"))


def _may_link() -> Column:
    """False only for lines u and v that are surely less alike than SIMILARITY: each bit in which their
    maps differ is a shingle of one alone, and alike lines have few of those for their sizes."""
    differing = F.lit(0)
    for j in range(WORDS):
        differing = differing + F.bit_count(F.get("um", F.lit(j)).bitwiseXOR(F.get("vm", F.lit(j))))
    return differing <= (F.col("un") + F.col("vn")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + ROUNDING


def _families(large: DataFrame) -> DataFrame:
    """lid, label, family of the rows (key, lid, label): lines that share a key or a label, or others that do, are one family."""
    named = components(large.select(F.col("label").alias("u"), F.col("key").alias("v")).distinct())
    return large.select("lid", "label").distinct().join(named.select(F.col("node").alias("label"), F.col("component").alias("family")), "label")


def _rare(labelled: DataFrame, texts: DataFrame) -> DataFrame:
    """lid, label, size (of its set), h, at (from 0) of the shingles that lines of other labels have too, of those first
    in each line by a common order: shingles of one label alone, then the rest, rare ones first. There are as many first ones
    as a line differing from it by no more than SIMILARITY allows cannot all lack, and what two labels share is of the rest.
    Lines meet only within a family, if labelled has that column: a shingle is another one and as rare as it is there."""
    sets = texts.join(labelled, "lid").select("lid", "label", *[c for c in labelled.columns if c == "family"], _set(F.col("line")).alias("set"))
    own_h = F.xxhash64("family", "h") if "family" in labelled.columns else F.col("h")
    # dealt by shingle once, for its count and for the join that brings it back
    exploded = sets.select("*", F.size("set").alias("size"), F.explode("set").alias("h"))
    every = exploded.select("lid", "label", "size", own_h.alias("h")).repartition("h")
    counted = every.groupBy("h").agg(F.count(F.lit(1)).alias("f"), F.min("label").alias("low"), F.max("label").alias("high"))
    shared = every.join(counted.where("low <> high").select("h", "f"), "h")
    own = Window.partitionBy("lid")
    at = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("f", "h")) - 1
    ranked = shared.select("lid", "label", "size", "h", at.alias("at"))
    return ranked.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * SIMILARITY - ROUNDING))


def _rare_pairs(labelled: DataFrame, texts: DataFrame, maps: DataFrame | None = None) -> DataFrame:
    """Pairs (u, v) of lines (lid, label) of different labels that share a shingle among the first of both, and that the maps, if given, let link."""
    # what both can still share, after the places before this one, must reach the common part of alike sets: so large may the other's be
    room = (F.col("size") - F.col("at")) * ((1 + SIMILARITY) / SIMILARITY) - F.col("size") + ROUNDING
    placed = _rare(labelled, texts).withColumn("room", room)
    # of each shingle: the smallest set and the widest room of other labels, and whether the label is that with most lines
    one, own = Window.partitionBy("h"), Window.partitionBy("h", "label")
    lower, higher = (one.orderBy(o).rangeBetween(Window.unboundedPreceding, -1) for o in (F.col("label"), F.col("label").desc()))
    counted = placed.withColumn("n", F.struct(F.count(F.lit(1)).over(own).alias("n"), "label"))
    least, most = F.least(*[F.min("size").over(w) for w in (lower, higher)]), F.greatest(*[F.max("room").over(w) for w in (lower, higher)])
    seen = counted.select("h", "lid", "label", "size", "room", least.alias("least"), most.alias("most"), (F.max("n").over(one) == F.col("n")).alias("main"))
    posted, _ = materialize(seen.where("least <= room and most >= size").drop("least", "most"), "postings")

    def side(rows: DataFrame, s: str) -> DataFrame:
        named = rows.select("h", *[F.col(c).alias(s + c) for c in ("lid", "label", "size", "room", "main")])
        return named if maps is None else named.join(_as(maps, s), F.col(s + "lid") == F.col(s))

    # lines of the main label meet the others only, and so never each other
    met = side(posted.where("not main"), "u").join(side(posted, "v"), "h").where((F.col("ulabel") != F.col("vlabel")) & (F.col("vmain") | (F.col("ulid") > F.col("vlid"))) & (F.col("vsize") <= F.col("uroom")) & (F.col("usize") <= F.col("vroom")))
    if maps is not None:
        met = met.where(_may_link())
    return met.select(F.greatest("ulid", "vlid").alias("u"), F.least("ulid", "vlid").alias("v")).distinct()


def line_components(lines: DataFrame) -> DataFrame:
    """node (lid), component of the lines (lid, line) that are linked to another line."""
    spark = lines.sparkSession
    lines = lines.where(F.length("line") >= SHINGLE)
    signed, signed_path = materialize(signatures(lines), "signatures")
    twos, members = buckets(signed)
    discard(spark, signed_path)

    heaviest = members.groupBy("key").agg(F.max(F.struct("weight", "lid")).getField("lid").alias("pivot"))
    pivoted, _ = materialize(members.select("key", "lid").join(heaviest, "key"), "pivots")
    to_pivot = pivoted.where("lid <> pivot").select(F.greatest("lid", "pivot").alias("u"), F.least("lid", "pivot").alias("v"))
    pairs, _ = materialize(twos.union(to_pivot).distinct(), "pairs")

    wanted, _ = materialize(pairs.select(F.explode(F.array("u", "v")).alias("lid")).distinct(), "wanted")
    near = _sieve(lines, "lid", wanted).groupBy("lid").agg(F.first("line").alias("line")).join(wanted, "lid")
    texts, _ = materialize(near, "candidates")
    maps, _ = materialize(sketches(texts), "sketches")

    def may_link(some: DataFrame) -> DataFrame:
        return some.join(_as(maps, "u"), "u").join(_as(maps, "v"), "v").where(_may_link()).select("u", "v")

    likely, _ = materialize(may_link(pairs), "likely")
    first, _ = materialize(_linked(likely, texts), "links")
    named = components(first)

    labelled = pivoted.join(named, pivoted["lid"] == named["node"], "left").select("key", "lid", "pivot", F.coalesce("component", "lid").alias("label"))
    mixed = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "n")
    rest, _ = materialize(labelled.where("lid <> pivot").join(mixed, "key").select("key", "n", "lid", "label"), "mixed")
    small = rest.where(F.col("n") <= SMALL)
    a = small.select("key", F.col("lid").alias("u"), F.col("label").alias("cu"))
    b = small.select("key", F.col("lid").alias("v"), F.col("label").alias("cv"))
    within = a.join(b, (a["key"] == b["key"]) & (F.col("u") > F.col("v")) & (F.col("cu") != F.col("cv"))).select("u", "v")
    large = _families(rest.where(F.col("n") > SMALL))
    across, _ = materialize(within.union(_rare_pairs(large, texts, maps)).distinct(), "across")
    likely, _ = materialize(may_link(across), "likely")
    second, _ = materialize(_linked(likely, texts), "links")
    return components(first.union(second))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, gone (numbers of the lines to remove, ascending) of the documents that lose any."""
    lines = lines_of(docs, id_col, text_col).select("id", "th", "n", "line", F.xxhash64("line").alias("lid"))
    named = line_components(lines.select("lid", "line"))
    # every occurrence, once: what follows reads this and not the texts
    places, _ = materialize(lines.select("id", "th", "n", "lid", F.xxhash64(F.lit(1), F.col("line")).alias("check")), "places")
    counts = places.groupBy("lid").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("id", "n")).alias("first"), F.min("check").alias("check"), F.max("check").alias("other"))
    met = counts.where("check = other").join(named, F.col("lid") == F.col("node"), "left").where("component is not null or cnt > 1")
    placed, _ = materialize(met.select("lid", "first", F.coalesce("component", "lid").alias("component")), "lines")
    best = placed.groupBy("component").agg(F.min("first").alias("keep"))
    keepers = placed.join(best, "component").select("lid", "keep")
    gone = places.join(keepers, "lid").where(~(F.struct("id", "n").eqNullSafe(F.col("keep"))))
    return materialize(gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("n")).alias("gone")), "gone")[0]


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_lines, n_removed, removed (line numbers from 0, comma-joined) of each document."""
    gone = removed_lines(docs, id_col, text_col).select(F.col("id").alias("gid"), F.col("th").alias("gth"), "gone")
    own = picked(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("th"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    met = own.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    numbers = F.coalesce("gone", F.array().cast("array<int>"))
    return met.select(F.col("id").alias(id_col), F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.size(numbers).cast("long").alias("n_removed"), F.array_join(numbers.cast("array<string>"), ",").alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the removed lines; all other columns as they are."""
    gone = removed_lines(docs, id_col, text_col).select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th"), "gone")
    at = place_of(docs, text_col)
    id_, own = F.col(f"c{place_of(docs, id_col)}"), F.col(f"c{at}")
    lines = F.split(own, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))

    def rebuilt(x: Column) -> Column:
        return F.array_join(F.transform(x.getField("places"), lambda n: F.get(x.getField("lines"), n)), "\n")

    # the lambda names the two arrays, so each is made once and a line is found by its place
    text = F.when(F.col("gone").isNull(), own).otherwise(F.element_at(F.transform(F.array(F.struct(lines.alias("lines"), places.alias("places"))), rebuilt), 1))

    def without(rows: DataFrame) -> DataFrame:
        met = rows.join(gone, id_.eqNullSafe(F.col("gone_id")) & (F.xxhash64(own) == F.col("gone_th")), "left")
        return met.select(*[text.alias(c) if i == at else F.col(c) for i, c in enumerate(rows.columns)])

    return by_place(docs, without)
