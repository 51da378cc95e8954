"""Operator 11: a prefix trie of conversations, rebuilt from their common first turns.

Every conversation takes its first h turns (h: the CRC-32 of its id, modulo 4) from the first conversation
of its group of 20, then goes on with its own turns after its first h. A node is a distinct sequence of
first turns, keyed by its depth and 128 bits: the exclusive or of a hash of each turn with its place. Hashes
along a conversation are running aggregates over blocks of places, so a conversation of very many turns is
cut over many tasks.

Partial tries: each partition combines its nodes' members, least member and ends before anything is
shuffled, ``SLOTS`` groups of partitions merge first, then all of them, by hashed key; so a node that
everything runs through gives a row for each task. End lists are merged in the order of (node, id) in
blocks, and a list of more than one block is hashed as a stream of its blocks.

The rollup goes bottom-up. Nodes of one member are settled without it. The others are joined into chains
(nodes with the same members follow one another), and a chain reports to the one above once all below
it have; what still waits is taken to the next round. So there are as many rounds as branchings below one
another, not turns.

Turns are ordered by number, null first; turns of one number by role, then by the MD5 of their text, so
rows that repeat each other are turns of their own. Null roles and texts are empty. Rows without a
conversation's id belong to none and are left out. A conversation may be left without turns: it ends at the root.
An empty table has no root. Columns are found by exact name; others are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, picked
from .ordered import in_order, part_of, places, running, spans

GROUP = 20
BORROWED = 4  # a conversation borrows fewer turns than this
SLOTS = 64
#: Ids of one block of an end list.
LIST_BLOCK = 4096
_WORD = r"[^\x20\x09-\x0D]+"
_NODE = ("depth", "k1", "k2")


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, a, b (hashes of role and text), words, at: the turns in order."""
    rows = picked(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null")
    rows = rows.select(F.col("conv").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.regexp_count("text", F.lit(_WORD)).cast("long")
    hashed = rows.select("conv", "turn", "role", F.md5("text").alias("tie"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), words.alias("words"))
    hashed, path = materialize(hashed, "hashed")  # the sort samples what it sorts: texts are read once
    ordered = in_order(hashed, ["conv", "turn", "role", "tie"], "turns").select("conv", "a", "b", "words", "at")
    discard(conversations.sparkSession, path)
    return ordered


def rebuilt(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv, size) and their turns (conv, depth from 1, a, b, words)."""
    spanned, _ = materialize(spans(ordered, ["conv"]), "spans")
    heads = places(ordered.where(F.col("conv") % GROUP == 0), ["conv"], spanned.where(F.col("conv") % GROUP == 0)).where(F.col("idx") < BORROWED - 1)
    # at most three turns a conversation
    lent = heads.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("idx", "a", "b", "words"))).alias("lent")).withColumnRenamed("conv", "lender")
    convs = spanned.groupBy("conv").agg(F.sum(F.when(F.col("before") == 0, F.col("total"))).alias("n"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % BORROWED, "lender": F.col("conv") - F.col("conv") % GROUP})
    met = convs.join(lent, "lender", "left").withColumn("lent", F.slice(F.coalesce("lent", F.array().cast("array<struct<idx:bigint,a:bigint,b:bigint,words:bigint>>")), F.lit(1), F.col("h").cast("int")))
    made, _ = materialize(met.select("conv", "h", "lent", (F.size("lent") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size")), "conversations")
    taken = made.select("conv", F.explode("lent").alias("t")).select("conv", (F.col("t.idx") + 1).alias("depth"), "t.a", "t.b", "t.words")
    wide = spanned.join(made.select("conv", "h", F.size("lent").alias("m")), "conv")
    own = places(ordered, ["conv"], wide).where("idx >= h").select("conv", (F.col("idx") - F.col("h") + F.col("m") + 1).alias("depth"), "a", "b", "words")
    return made.select("conv", "size"), taken.union(own)


def paths(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """conv, depth, k1, k2 (its node), p1, p2 (the node above), words, for each conversation and depth, the root's too."""
    salted = rows.select("conv", "depth", F.xxhash64("depth", "a").alias("z1"), F.xxhash64("depth", "b", F.lit(1)).alias("z2"), "words")
    keyed = salted.withColumns({"k1": F.col("z1"), "k2": F.col("z2")})
    summed = running(keyed, ["conv"], "depth", {"k1": F.bit_xor, "k2": F.bit_xor})
    below = summed.select("conv", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"), "words")
    zero = F.lit(0).cast("long")
    return below.union(convs.select("conv", zero, zero, zero, zero, zero, zero))


def nodes(walked: DataFrame) -> DataFrame:
    """One row a node: its key, p1, p2, words, n_convs, conv_id (least member)."""
    some = walked.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(SLOTS)))
    facts = [F.min(c).alias(c) for c in ("p1", "p2", "words")]  # the same in all rows of a node
    partial = some.groupBy(*_NODE, "slot").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), *facts)
    return partial.groupBy(*_NODE).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), *facts)


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's blocks, which come one after another."""
    key, state = None, sha256()

    def out(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done) if done else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()])], [*_NODE, "ends_sha256"])

    for b in batches:
        done = []
        for *own, ids in zip(*[b.column(c).to_pylist() for c in (*_NODE, "ids")]):
            if own == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = own, sha256(ids.encode())
        yield out(done)
    if key is not None:
        yield out([(*key, state.hexdigest())])


def end_lists(ends: DataFrame) -> DataFrame:
    """Node's key and ends_sha256 of the nodes at which conversations (conv) end."""
    numbered = places(in_order(ends, [*_NODE, "conv"], "ends"), _NODE)
    blocks = numbered.groupBy(*_NODE, "total", F.expr(f"idx div {LIST_BLOCK}").alias("block")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    listed, _ = materialize(blocks.select(*_NODE, "total", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")), "lists")
    short = listed.where(F.col("total") <= LIST_BLOCK).select(*_NODE, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    long = listed.where(F.col("total") > LIST_BLOCK).repartition(*_NODE).sortWithinPartitions(*_NODE, "block")
    return short.union(long.select(*_NODE, "ids").mapInArrow(_stream, "depth long, k1 long, k2 long, ends_sha256 string"))


def _chains(shared: DataFrame) -> DataFrame:
    """Chains of nodes with the same members: conv_id, n_convs, own (tokens that they save), that of their last node
    (n_children, n_single) and the chain above (up_conv, up_n)."""
    last = F.max_by(F.struct("n_children", "n_single"), "depth")
    first = F.min_by(F.struct(F.col("parent_conv_id").alias("up_conv"), F.col("parent_n").alias("up_n")), "depth")
    made = shared.groupBy("conv_id", "n_convs").agg(F.sum("own").alias("own"), last.alias("last"), first.alias("first"))
    return made.select("conv_id", "n_convs", "own", "last.*", "first.*")


def roll_up(chains: DataFrame) -> DataFrame:
    """conv_id, n_convs, leaves, saved: of everything from each chain's first node down."""
    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_single")).cast("long")
    state = chains.select("conv_id", "n_convs", "up_conv", "up_n", (F.col("n_children") - F.col("n_single")).alias("due"), leaves.alias("leaves"), F.col("own").alias("saved"))
    done = []
    while True:
        state, path = materialize(state, "rollup")
        ready = state.where("due = 0")
        done.append(ready.select("conv_id", "n_convs", "leaves", "saved"))
        waiting = state.where("due > 0")
        if waiting.isEmpty():
            break
        told = ready.where("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        met = waiting.join(told, ["conv_id", "n_convs"], "left")
        more = lambda c: F.coalesce(F.col(c), F.lit(0))
        state = met.select("conv_id", "n_convs", "up_conv", "up_n", (F.col("due") - more("n")).alias("due"), (F.col("leaves") + more("l")).alias("leaves"), (F.col("saved") + more("s")).alias("saved"))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _key(prefix: str = "") -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in _NODE]


def trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """Every node of the rebuilt conversations' trie, as op11 returns them."""
    convs, rows = rebuilt(turns(conversations, **columns))
    walked, _ = materialize(paths(convs, rows), "paths")
    ended = walked.join(convs, (walked["conv"] == convs["conv"]) & (F.col("depth") == F.col("size"))).select(*_NODE, walked["conv"])
    table, _ = materialize(nodes(walked), "nodes")
    lists, _ = materialize(end_lists(ended), "ends")

    one = F.col("n_convs") == 1
    above = table.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    counted = above.agg(F.count(F.lit(1)).alias("n_children"), F.count_if(one).alias("n_single"))
    shared = table.where(~one | (F.col("depth") == 0)).join(counted, list(_NODE), "left").fillna(0, ["n_children", "n_single"])
    shared, _ = materialize(shared, "shared")
    over = shared.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("over_conv"), F.col("n_convs").alias("over_n"))
    # a node whose parent is not shared has its parent's only member
    parent = F.when(F.col("depth") > 0, F.coalesce("over_conv", "conv_id")).alias("parent_conv_id")
    with_parent = lambda df: df.join(over, ["depth", "p1", "p2"], "left")

    own = (F.col("n_convs") - 1) * F.col("words")
    branching, _ = materialize(with_parent(shared).select(*_NODE, "conv_id", "n_convs", "n_children", "n_single", own.alias("own"), parent, F.col("over_n").alias("parent_n")), "branching")
    rolled = roll_up(_chains(branching))
    # within a chain, a node saves what the chain does without the nodes above it
    start = Window.partitionBy("conv_id", "n_convs")
    placed = branching.withColumns({"place": F.col("depth") - F.min("depth").over(start), "upto": F.col("own")})
    summed = running(placed, ["conv_id", "n_convs"], "place", {"upto": F.sum}).join(rolled, ["conv_id", "n_convs"])
    inner = summed.where("n_convs > 1 or depth = 0").select(*_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("upto") + F.col("own")).alias("saved_tokens"))

    nothing = F.lit(sha256(b"").hexdigest())
    inner = inner.join(lists, list(_NODE), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    tails = with_parent(table.where(one & (F.col("depth") > 0))).join(convs, F.col("conv_id") == F.col("conv"))
    at_end = F.col("depth") == F.col("size")
    single = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    tails = tails.select("conv_id", "depth", parent, "n_convs", F.when(at_end, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(at_end, single).otherwise(nothing).alias("ends_sha256"))
    return inner.select(*tails.columns).union(tails)
