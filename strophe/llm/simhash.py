"""Operator 9: SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most four bits share at least four
bytes at the same positions, so the index counts shared positional bytes and keeps pairs that reach
four. Postings of one positional byte would hold 1/256 of all fingerprints each and their pairs would
grow with the square of the corpus. The postings here are therefore of three positional bytes: 20
triples of positions (``TRIPLES``, checked below) are such that any four positions hold one of them, so
no pair is lost. Within a posting the shared bytes of a pair are tallied, pairs with fewer than four are
left out, and the rest is verified bit by bit.

Documents with equal fingerprints are one node. A posting gives a spanning forest of its links and not
the links themselves, which is all that components need: a group of near copies gives as many rows as it
has members. Postings of more than BLOCK members are dealt out in blocks, every pair of blocks to a row
of its own, so memory is bounded and no pair is skipped.

Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with a null or a
repeated id are kept, one row out for each row in; a component's id is its least id that is not null, or
null if it has none. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, materialize, picked, place_of
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCK = 1024


def _triples() -> list[tuple[int, int, int]]:
    """Three groups of positions in a ring; a triple lies in one group, or two in a group and one in the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    picked = []
    for t in combinations(range(8), 3):
        n = [sum(group[p] == g for p in t) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            picked.append(t)
    return picked


TRIPLES = _triples()


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint of one whole text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return 0
    hashes = []
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    if len(words) <= width:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        rows = [words[i : n + i] for i in range(width)]
        hashes = [digest(s, SEED) for s in map(b" ".join, zip(*rows))]
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (a hash of the text), fp (the fingerprint's bits as a signed number), one row a document."""
    rows = picked(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [fingerprint(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(bits, np.uint64).view(np.int64))], ["id", "th", "fp"])

    return rows.select("id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"id {kind.simpleString()}, th long, fp long")


def _posting_keys(fp: Column) -> Column:
    """The 20 keys of a fingerprint: number of the triple and its three bytes."""
    byte = [F.shiftrightunsigned(fp, 8 * (7 - p)).bitwiseAND(255) for p in range(8)]
    keys = [F.lit(i) * (1 << 24) + byte[a] * (1 << 16) + byte[b] * (1 << 8) + byte[c] for i, (a, b, c) in enumerate(TRIPLES)]
    return F.array(*keys)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many positional bytes two fingerprints share, from their exclusive or."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    other = ((x & low) + low | x) & ~low  # the high bit of each byte that differs
    return 8 - np.bitwise_count(other)


def forest(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links among prints: (member, first member of its tree).

    Trees grow from what has not been reached, so a dense group takes few comparisons.
    """
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(prints))
    while len(rest) > 1:
        first, rest = int(rest[0]), rest[1:]
        queue = [first]
        while queue and len(rest):
            x = prints[rest] ^ prints[queue.pop()]
            near = shared_bytes(x) >= 8 - distance
            near[near] = np.bitwise_count(x[near]) <= distance
            met = rest[near].tolist()
            edges += [(m, first) for m in met]
            queue += met
            rest = rest[~near]
    return edges


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints (fp) of nodes as all their links do."""
    if distance > 4:
        raise ValueError("the triples of positions are made for distances up to 4")
    postings = nodes.select(F.explode(_posting_keys(F.col("fp"))).alias("key"), "fp")
    # counted before the shuffle, so that a hot posting is in no single task
    sized = postings.join(postings.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "key")
    # blocks of a large posting: each member goes to every pair that its own block is in
    blocks = sized.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    pairs = blocks.select("key", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = pairs.groupBy("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = batch.column(0).offsets.to_numpy()
            prints = batch.column(0).flatten().to_numpy().view(np.uint64)
            bounds = (bounds - bounds[0]).tolist()
            edges = [(a + i, a + r) for a, b in zip(bounds[:-1], bounds[1:]) for i, r in forest(prints[a:b], distance)]
            ends = prints.view(np.int64)[np.array(edges, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["u", "v"])

    return rows.select("members").mapInArrow(run, "u long, v long").distinct()


def _rooted(marked: DataFrame, distance: int) -> DataFrame:
    """fp, least (id that has it), root (the component's name) of every fingerprint."""
    nodes, _ = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    labels = components(links(nodes, distance))
    return nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hexadecimal digits), component_id (least id that links reach) of each document."""
    marked, _ = materialize(fingerprints(docs, id_col, text_col), "prints")
    rooted = _rooted(marked, distance)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    out = marked.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, all columns as they are: that of the least id, an id before none.

    Rows of one id are told apart by their texts; of rows that share both, one stays, whichever it is.
    """
    marked, _ = materialize(fingerprints(docs, id_col, text_col), "prints")
    named = marked.groupBy("id", "th", "fp").agg(F.count(F.lit(1)).alias("n")).join(_rooted(marked, distance).select("fp", "root"), "fp")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th", "n")
    chosen, _ = materialize(named.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.id").alias("chosen_id"), F.col("k.th").alias("chosen_th"), F.col("k.n").alias("chosen_n")), "chosen")
    id_, text = (f"c{place_of(docs, c)}" for c in (id_col, text_col))

    def stay(rows: DataFrame) -> DataFrame:
        met = rows.join(chosen, F.col(id_).eqNullSafe(F.col("chosen_id")) & (F.xxhash64(text) == F.col("chosen_th")))
        again = met.where("chosen_n > 1").dropDuplicates(["chosen_id", "chosen_th"])
        return met.where("chosen_n = 1").union(again).select(*rows.columns)

    return by_place(docs, stay)
