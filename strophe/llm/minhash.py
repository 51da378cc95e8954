"""Operator 13: near-duplicate documents by circulant MinHash, confirmed on whole shingle sets.

A document's set holds the 64-bit hashes of its distinct shingles. A hash places a shingle in the first permutation
(its remainder by ``SPACE``); the second is one fixed permutation of all places, and coordinate k of the signature is its
least value over the set after it was shifted by k, in a circle. So all coordinates of a shingle are
neighbours in one table: a slice of it, no more hashing. ``BANDS`` bands of ``ROWS`` coordinates miss a
pair of exactly 0.8 with probability 7e-6, and every pair found is verified on the full sets.

Documents of one set are one node. The members of a bucket are first compared with its least node; what
these links connect is one component, so a group of near copies costs a comparison for each member and
band. Only buckets that still hold several components go on: their members are compared with one another where
the components differ, in blocks of bounded size: two blocks meet as rows of a matrix of shared shingles, whose product is the
sizes of all intersections. A block gives a link only where it joins two components, so rows out never exceed
members. A bucket of n members that do not link costs the square of n / block in block pairs; none of them is skipped.

Null texts and texts without words have an empty set and link with nothing. Rows of a null id take part; a component's
id is its least id that is not null, or null if it has none. Rows that repeat each other are all kept as rows.
An empty table gives an empty table. Columns are found by exact name; others are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, held, materialize, picked
from .components import components
from .linededup import _sieve

WIDTH = 4
PERCENT = 80
BANDS, ROWS = 30, 5
SPACE = 1 << 20
SEED = 13
#: Shingles whose slices are looked at together.
STEP = 4096
#: Shingles and members of one block.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 18, 512
#: Columns of the matrices that are multiplied at once.
COLUMNS = 1024
#: Texts that a task turns into sets before it hands them on.
TEXTS = 1000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a whole text's shingles, ascending; of fewer words the whole sequence is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    joined = map(b" ".join, zip(*[words[i : n + i] for i in range(width)])) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(digest, joined), np.uint64, n))


def _circle() -> np.ndarray:
    """The second permutation, prolonged by its own beginning: row p holds what place p has under every shift."""
    order = np.random.default_rng(SEED).permutation(SPACE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: BANDS * ROWS]]), BANDS * ROWS)


def signature(hashes: np.ndarray, circle: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS coordinates of a set that is not empty."""
    at = (hashes % np.uint64(SPACE)).astype(np.int64)
    parts = [circle[at[i : i + STEP]].min(axis=0) for i in range(0, len(at), STEP)]
    return parts[0] if len(parts) == 1 else np.min(parts, axis=0)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, TEXTS):
            yield b.slice(i, TEXTS)


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    circle = held("circulant", _circle)
    for b in _slices(batches):
        sizes, names, bands = [], [], []
        for text in b.column(2):
            own = shingles(text.as_py())
            sizes.append(len(own))
            names.append(xxhash.xxh3_128_digest(own.tobytes()))
            if len(own):
                rows = signature(own, circle).reshape(BANDS, ROWS)
                bands.append([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)])
            else:
                bands.append([])
        keys = pa.array([None if not x else np.array(x, np.uint64).view(np.int64) for x in bands], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), keys], ["id", "th", "n", "name", "bands"])


def marked(docs: DataFrame) -> DataFrame:
    """id, th (hash of the text), n (size of its set), name (128 bits of its set), bands, of docs (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.xxhash64("text").alias("th"), "text").mapInArrow(_marks, f"id {kind}, th long, n long, name binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n, hashes of the wanted nodes (node, least, th, name), each from the text of its least id."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            hashes = [shingles(t.as_py()) for t in b.column(2)]
            right = pa.array([xxhash.xxh3_128_digest(h.tobytes()) == name for h, name in zip(hashes, b.column(1).to_pylist())], pa.bool_())
            lists = pa.array([h.view(np.int64) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array([len(h) for h in hashes], pa.int64())], ["node", "hashes", "n"]).filter(right)

    texts = _sieve(docs.select("id", F.xxhash64("text").alias("th"), "text"), "th", wanted)
    own = wanted.select("node", "name", F.col("th").alias("own_th"), F.col("least").alias("own_id"))
    met = texts.join(own, (F.col("th") == F.col("own_th")) & F.col("id").eqNullSafe(F.col("own_id")))
    met = met.select("node", "name", "text").mapInArrow(run, "node long, hashes array<long>, n long")
    return met.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("hashes").alias("hashes"))


def _alike(common: Column, a: Column, b: Column) -> Column:
    return 100 * common >= PERCENT * (a + b - common)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v, with sizes un, vn) whose full sets are alike."""
    may = pairs.where(_alike(F.least("un", "vn"), F.col("un"), F.col("vn")))
    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("uh"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("vh"))
    met = may.join(left, "u").join(right, "v")
    return met.where(_alike(F.size(F.array_intersect("uh", "vh")), F.col("un"), F.col("vn"))).select("u", "v")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of left shares with each of right."""
    values = np.unique(np.concatenate(left))
    values = values[np.isin(values, np.concatenate(right))]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(values), COLUMNS):
        some = values[start : start + COLUMNS]

        def matrix(sets: list[np.ndarray]) -> np.ndarray:
            m = np.zeros((len(sets), len(some)), np.float32)
            for i, s in enumerate(sets):
                m[i, np.searchsorted(some, s[np.isin(s, some)])] = 1
            return m

        out += matrix(left) @ matrix(right).T
    return out


def _joining(nodes: list[int], labels: list[int], sets: list[np.ndarray], sides: list[bool]) -> list[tuple[int, int]]:
    """Links among a block's members, of different labels and, where two blocks meet, of different sides, that
    join what was apart: at most one less than there are labels."""
    one, other = ([i for i, s in enumerate(sides) if s is side] for side in (False, True))
    a, b = one or other, other or one
    common = intersections([sets[i] for i in a], [sets[i] for i in b])
    sizes = np.array([len(s) for s in sets], np.float64)
    alike = 100 * common >= PERCENT * (sizes[a][:, None] + sizes[b][None, :] - common)
    names = np.array(labels)
    alike &= names[a][:, None] != names[b][None, :]
    root = {x: x for x in set(labels)}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    at, to = np.nonzero(alike)
    _, numbers = np.unique(names, return_inverse=True)
    _, first = np.unique(numbers[a][at] * len(names) + numbers[b][to], return_index=True)  # a link for two labels is enough
    out = []
    for i, j in zip(at[first].tolist(), to[first].tolist()):
        u, v = find(labels[a[i]]), find(labels[b[j]])
        if u != v:
            root[u] = v
            out.append((nodes[a[i]], nodes[b[j]]))
    return out


def _within(block: pa.Table) -> pa.Table:
    rows = block.combine_chunks()
    sets = [np.asarray(s.values, np.int64) for s in rows.column("hashes")]
    found = _joining(*(rows.column(c).to_pylist() for c in ("node", "label")), sets, rows.column("side").to_pylist())
    ends = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"u": ends[:, 0], "v": ends[:, 1]})


def _across(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between different labels within each bucket of mixed (key, node, label)."""
    sized = mixed.join(sets.select("node", "n"), "node")
    wide = sized.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    own = sized.join(wide.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = own.select("key", "node", "label", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    paired = dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "label", (F.col("own") > F.col("other")).alias("side"))
    # two blocks without two labels have nothing to join; neither have equal lists of members that another bucket holds too
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "side")), F.bit_xor(F.xxhash64("side", "node", F.lit(1)))).alias("mark")
    listed = paired.groupBy("key", "a", "b").agg(F.min("label").alias("low"), F.max("label").alias("high"), mark).where("low <> high")
    once = listed.groupBy("mark").agg(F.min(F.struct("key", "a", "b")).alias("k")).select("k.*")
    chosen = paired.join(once, ["key", "a", "b"]).join(sets.select("node", "hashes"), "node")
    return chosen.select("key", "a", "b", "node", "label", "side", "hashes").groupBy("key", "a", "b").applyInArrow(_within, "u long, v long")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect nodes (node, least, th, n, name, bands) as all their links do."""
    spark = docs.sparkSession
    keyed = nodes.where("n > 0").select("node", F.explode("bands").alias("key"))
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("pivot")).where("members > 1").select("key", "pivot")
    members, _ = materialize(keyed.join(counted, "key"), "buckets")
    few = nodes.select("node", "least", "th", "name").join(members.select("node").distinct(), "node", "left_semi")
    few, _ = materialize(few, "few")
    sets, _ = materialize(_sets(docs, few), "sets")
    size = sets.select("node", "n")
    pairs = members.where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    pairs = pairs.join(size.toDF("u", "un"), "u").join(size.toDF("v", "vn"), "v")
    first, _ = materialize(_verified(pairs, sets), "links")
    named = components(first)
    labelled = members.join(named, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    labelled, path = materialize(labelled, "labelled")
    several = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    mixed, _ = materialize(labelled.join(several, "key"), "mixed")
    discard(spark, path)
    second, _ = materialize(_across(mixed, sets), "links")
    return first.union(second)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (least id that links reach), kept (whether that is its own) of each document."""
    own = picked(docs, id=id_col, text=text_col)
    each, _ = materialize(marked(own), "marked")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first")
    grouped = each.where("n > 0").groupBy("name").agg(least, F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    nodes = grouped.select("name", "n", "bands", F.col("first.id").alias("least"), F.col("first.th").alias("th"))
    nodes, _ = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = components(links(own, nodes))
    rooted, _ = materialize(nodes.join(labels, "node", "left").select("name", "least", F.coalesce("component", "node").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("name", "component_id")
    full = each.where("n > 0").select("id", "n", "name").join(named, "name").select("id", "n", "component_id")
    bare = each.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.union(bare).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
