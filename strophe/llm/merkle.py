"""Operator 12: a Merkle manifest of a dataset, with a proof for every row.

Each row is a leaf; the leaves of one group (a language) form a tree of arity 8 in the order of their ids,
and the roots of the groups form one more tree. A node is (group, height, place), and the number of leaves
tells how many children each parent has. So parents need no order of arrival: every task folds its sorted
leaves as events, a partial parent keeps its children's digests by slot, and when its arity is met its
digest is the next event, for its own parent. What a task can't complete (the parents at its edges) is
shuffled by ancestor and folded on by the same function. One pass climbs ``STRIDE`` heights, 512 nodes to
one, and each pass leaves a table of that height's nodes.

Proofs go back down by the same links: a block of at most 512 nodes meets the path of its ancestor, makes
the digests below it again and gives each of its nodes the siblings on the way up. So no task holds more
than one block and one path, and no group's size matters.

Null fields hash as ``-``; rows of a null group are a tree of their own, before all others. Leaves of a
null id come first; leaves of equal ids are ordered by digest, so rows that repeat each other may change
places without changing any digest. A group of one row is its own root. An empty table has no root and gives an
empty table. Columns are found by exact name; others are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, picked
from .ordered import in_order, places

ARITY = 8
STRIDE = 3
#: Of an index, for each height.
BITS = ARITY.bit_length() - 1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_EVENT = "tree string, m long, h int, idx long, slots array<int>, kids array<string>, digest string"
_PATH = "array<struct<slot:int,siblings:string>>"


def digest_of(columns: Sequence[Column]) -> Column:
    """SHA-256, in lowercase hex, of the columns in turn: - for null, else UTF-8 bytes, a colon, the value."""
    coded = []
    for c in columns:
        s = c.cast("string")
        coded.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def _parent(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def heights(n: int) -> int:
    """How many levels stand above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds nodes (one slot at height 0) and partial parents into the nodes STRIDE heights up, or a tree's root.

    Complete ones have a digest; what is still partial at the end is given out with its slots.
    """
    waiting: dict[tuple[str, int, int], tuple[int, dict[int, str]]] = {}

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string()]
        names = ["tree", "m", "h", "idx", "slots", "kids", "digest"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    for b in batches:
        done = []
        for tree, m, h, idx, slots, kids in zip(*[b.column(c).to_pylist() for c in ("tree", "m", "h", "idx", "slots", "kids")]):
            top = min(STRIDE, heights(m))
            while True:
                if h == 0:
                    digest = kids[0]
                else:
                    _, held = waiting.setdefault((tree, h, idx), (m, {}))
                    held.update(zip(slots, kids))
                    below = -(-m // ARITY ** (h - 1))
                    if len(held) < min(ARITY, below - ARITY * idx):
                        break
                    digest = _parent(held[s] for s in sorted(held))
                    del waiting[tree, h, idx]
                if h == top:
                    done.append((tree, m, h, idx, None, None, digest))
                    break
                h, slots, idx, kids = h + 1, [idx % ARITY], idx // ARITY, [digest]
        yield out(done)
    yield out([(tree, m, h, idx, list(held), list(held.values()), None) for (tree, h, idx), (m, held) in waiting.items()])


def _climb(nodes: DataFrame) -> DataFrame:
    """tree, m, idx, digest of the nodes STRIDE heights above nodes (tree, m: how many the tree has at this height, idx, digest)."""
    first = F.lit(0)
    events = nodes.select("tree", "m", first.alias("h"), "idx", F.array(first).alias("slots"), F.array("digest").alias("kids"))
    folded, path = materialize(events.mapInArrow(_fold, _EVENT), "folded")
    edge = folded.where("digest is null").withColumn("over", F.expr(f"shiftright(idx, {BITS} * ({STRIDE} - h))"))
    met = edge.repartition("tree", "over").sortWithinPartitions("tree", "over", "h", "idx").drop("over", "digest").mapInArrow(_fold, _EVENT)
    whole = F.when(F.col("digest").isNull(), F.raise_error(F.lit("a parent lacks children"))).otherwise(F.col("digest"))
    up = folded.where("digest is not null").union(met.withColumn("digest", whole))
    above, _ = materialize(up.select("tree", F.expr(f"case when m <= {ARITY**STRIDE} then 1L else (m + {ARITY**STRIDE - 1}) div {ARITY**STRIDE} end").alias("m"), "idx", "digest"), "height")
    discard(nodes.sparkSession, path)
    return above


def forest(leaves: DataFrame) -> list[DataFrame]:
    """The tables (tree, m, idx, digest) of every STRIDE-th height, from leaves to the roots."""
    most = leaves.agg(F.max("m")).first()[0] or 0
    tables = [leaves.select("tree", "m", "idx", "digest")]
    for _ in range(-(-heights(most) // STRIDE)):
        tables.append(_climb(tables[-1]))
    return tables


def _ways(digests: list[str], above: list[dict]) -> list[list[dict]]:
    """For each of a block's nodes, in order, its siblings on the way up: those in the block, then above."""
    ways: list[list[dict]] = [[] for _ in digests]
    row, height = digests, 0
    while len(row) > 1:
        runs = [row[i : i + ARITY] for i in range(0, len(row), ARITY)]
        joined = [["".join(run[:s] + run[s + 1 :]) for s in range(len(run))] for run in runs]
        for i, way in enumerate(ways):
            at = i // ARITY**height
            way.append({"slot": at % ARITY, "siblings": joined[at // ARITY][at % ARITY]})
        row, height = [_parent(run) for run in runs], height + 1
    return [way + above for way in ways]


def _descend(nodes: DataFrame, above: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """nodes (tree, m, idx, digest, kept) with subroot and path, from above (tree, idx, subroot, path of the ancestor).

    A run below the top that has one child alone has no sibling and adds an empty step: its parent still is a new digest.
    """
    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.append_column("subroot", pa.array([], pa.string())).append_column("path", pa.array([], kind))
        left = left.sort_by("idx")
        way = right.column("path")[0].as_py()
        ways = _ways(left.column("digest").to_pylist(), [])
        steps = min(STRIDE, heights(left.column("m")[0].as_py()))
        lone = {"slot": 0, "siblings": ""}
        paths = [w + [lone] * (steps - len(w)) + way for w in ways]
        grown = left.append_column("subroot", pa.array([right.column("subroot")[0].as_py()] * left.num_rows, pa.string()))
        return grown.append_column("path", pa.array(paths, kind))

    kind = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.string())]))
    rows = nodes.select("tree", "m", "idx", "digest", *kept).withColumn("over", F.shiftright("idx", BITS * STRIDE))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", subroot string, path {_PATH}"
    return rows.groupBy("tree", "over").cogroup(above.withColumnRenamed("idx", "over").groupBy("tree", "over")).applyInArrow(block, schema)


def _paths(tables: list[DataFrame], tops: DataFrame, kept: DataFrame | None = None, names: Sequence[str] = ()) -> DataFrame:
    """Paths of the leaves: down from tops (tree, subroot, path of each tree's root) through the tables."""
    way = tops.select("tree", F.lit(0).cast("long").alias("idx"), "subroot", "path")
    for table in reversed(tables[1:-1]):
        way = materialize(_descend(table, way).select("tree", "idx", "subroot", "path"), "paths")[0]
    leaves = tables[0] if kept is None else kept
    if len(tables) == 1:  # every tree is one leaf
        return leaves.join(way.drop("idx"), "tree")
    return _descend(leaves, way, names)


def proofs(leaves: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """kept, leaf, subroot, root, path of leaves (group: null or text, id, leaf, kept).

    path has a step for each height up to the root: the node's slot among its run, and its siblings' digests
    from left to right. ``folded`` of a leaf and its path is the root.
    """
    named = leaves.withColumn("tree", F.when(F.col("group").isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), "group"))).drop("group")
    named, path = materialize(named, "leaves")
    ordered = in_order(named, ["tree", "id", "leaf"], "ordered")
    discard(leaves.sparkSession, path)
    numbered, _ = materialize(places(ordered, ["tree"]).select("tree", F.col("total").alias("m"), "idx", F.col("leaf").alias("digest"), *kept), "numbered")
    tables = forest(numbered)
    roots = in_order(tables[-1].select("tree", "digest"), ["tree"], "roots")
    over = places(roots.withColumn("all", F.lit("")), ["all"]).select(F.col("all").alias("tree"), F.col("total").alias("m"), "idx", "digest", F.col("tree").alias("own"))
    over, _ = materialize(over, "roots")
    upper = forest(over)
    found = upper[-1].first()  # one row: the tree of all groups has one root
    root = found.digest if found else ""
    start = upper[-1].select("tree", F.col("digest").alias("subroot"), F.array().cast(_PATH).alias("path"))
    tops = _paths(upper, start, over, ["own"]).select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), "path")
    tops, _ = materialize(tops, "tops")
    out = _paths(tables, tops, numbered, kept)
    return out.select(*kept, F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    def step(digest: Column, s: Column) -> Column:
        before = s.getField("slot") * 64
        sides = [F.substring(s.getField("siblings"), F.lit(1), before), digest, F.substring(s.getField("siblings"), before + 1, F.lit(64 * ARITY))]
        return F.sha2(F.concat(*sides).cast("binary"), 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, from the leaf's to the root's children."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s.getField("siblings")), "").cast("binary"), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", tampered=None) -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    tampered, where given, says of an id (a column) which rows arrive with A-Z of their text lower-cased: their
    folded_root comes of the leaf as it arrives, all else of the rows as they were.
    """
    names = {f"f{i}": name for i, name in enumerate(fields)}
    rows = picked(docs, id=id_col, group=group_col, **names)
    own = [F.col(f) for f in names]
    lower = F.translate(F.col(f"f{list(fields).index(text_col)}"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    arrived = [lower if name == text_col else F.col(f) for f, name in names.items()]
    leaf = digest_of(own)
    met = F.when(F.coalesce(tampered(F.col("id")), F.lit(False)), digest_of(arrived)) if tampered else F.lit(None).cast("string")
    leaves = rows.select("id", F.col("group").cast("string").alias("group"), leaf.alias("leaf"), met.alias("met"))
    proved = proofs(leaves, ["id", "met"])
    whole = proved.withColumn("folded_root", folded(F.coalesce("met", "leaf"), F.col("path")))
    return whole.select(F.col("id").alias(id_col), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
