"""Operator 2: benchmark decontamination with suffix arrays of the training text.

Words are numbered by the test set's vocabulary (0 for any other word). The documents of a group of
rows, laid end to end with a 0 between, are one training shard; its suffix array holds, in the order of
their words, the suffixes that can match: those that begin with the first words of some test window.
All others could only sort where no search ends. Every test suffix is binary-searched in every shard, so
there is no shuffle, and a shard needs memory in proportion to its rows only.

A window is ``words`` consecutive words of an item; an item of fewer words, but not none, is one window.
``detect`` counts the document words inside windows; ``matches`` extends each window to the longest
verbatim match and gives its place; ``clean`` removes the documents with a match.

The test set is read row by row and dealt into blocks of at most ``TEST_WORDS`` words; each block is
broadcast by itself, and a shard is searched with one block after another. No more than ``ROUND_BLOCKS``
blocks are broadcast at a time: the documents go through a larger test set in rounds, what is known of them
is written between rounds, and the blocks of a round are destroyed after it.

Texts that repeat a few words without end meet a window in very many places. Pairs of places that a word
before them would prolong are never made, the others are made ``PAIRS`` at a time, and long matches are
measured by doubling, so memory grows with the shard and the block and not with their product. Null texts
have no words.
Items with a null id count for hits and have no name; repeated items count once. Documents with null or
repeated ids are rows of their own; empty tables on either side are fine; other columns are not read,
and ``clean`` keeps them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, discard, materialize, picked
from .tokens import groups

WORDS = 10
#: Bound of a broadcast block of the test set, but for one longer item.
TEST_WORDS = 1_000_000
#: Blocks that are broadcast at the same time.
ROUND_BLOCKS = 8
#: Pairs of a place in the shard and a place in the block that are held at a time, but for those of one place.
PAIRS = 1 << 20
#: Words by which matches are prolonged one by one, before doubling takes over.
STEPS = 64

#: Bytes that part words become spaces, A-Z become a-z; digits, letters and bytes of other scripts stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _columns(ids: np.ndarray, at: np.ndarray, lengths: np.ndarray | int, width: int, bits: int, fill: int = 0) -> list[np.ndarray]:
    """Keys of as many word numbers as fit 63 bits, of the runs of width words at the places; beyond lengths, fill."""
    out, each = [], 63 // bits
    for first in range(0, width, each):
        key = np.zeros(len(at), np.int64)
        for k in range(first, first + each):
            word = np.where(k < lengths, ids[np.minimum(at + k, len(ids) - 1)], fill) if k < width else fill
            key = key << bits | word
        out.append(key)
    return out


class TestBlock:
    """A block of the test set: its vocabulary, words end to end, and distinct windows."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, list[bytes]]], words: int):
        vocab = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
        self.vocab, self.words = vocab, words
        # three words a key, or two where one item has very many different ones; all ones are no word
        self.bits = 21 if len(vocab) < (1 << 21) - 1 else 31
        prefix = 63 // self.bits
        self.names = [name for name, _ in items]
        self.ids = np.array([0, *(x for _, ws in items for x in [*(vocab[w] for w in ws), 0])], np.int64)
        at, size, item, begin, begins = [], [], [], 1, []
        for i, (_, ws) in enumerate(items):
            begins.append(begin)
            n = min(words, len(ws))
            for k in range(len(ws) - n + 1 if n else 0):
                at.append(begin + k)
                size.append(n)
                item.append(i)
            begin += len(ws) + 1
        self.begins = np.array(begins, np.int64)
        self.at, self.size, self.item = (np.array(x, np.int64) for x in (at, size, item))
        low = _columns(self.ids, self.at, self.size, words, self.bits)
        high = _columns(self.ids, self.at, self.size, words, self.bits, (1 << self.bits) - 1)
        # equal windows are searched once: window[w] is the number of window w's text
        rows = np.stack([*low, *high], 1) if len(at) else np.zeros((0, 2 * len(low)), np.int64)
        distinct, first, self.window = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        self.window = self.window.reshape(-1)
        self.low = list(distinct.T[: len(low)])
        self.high = list(distinct.T[len(low) :])
        self.length = self.size[first]
        self.starters = {k: np.unique(_columns(self.ids, self.at[m], k, prefix, self.bits)[0]) for k in range(1, prefix + 1) if (m := np.minimum(self.size, prefix) == k).any()}
        # places by window and the word before, so that those after a given word lie side by side
        before = self.ids[self.at - 1]
        self.by_window = np.lexsort((before, self.window))
        self.window_ends = np.searchsorted(self.window[self.by_window], np.arange(len(first) + 1))
        self.many = len(vocab) + 1
        self.before = (self.window * self.many + before)[self.by_window]

    def item_at(self, places: np.ndarray) -> np.ndarray:
        """The item that each place in the block's words lies in."""
        return np.searchsorted(self.begins, places, "right") - 1

    def number(self, words: list[bytes]) -> list[int]:
        get = self.vocab.get
        return [get(w, 0) for w in words]


class Shard:
    """The suffix array of documents given as word numbers, end to end with a 0 between."""

    def __init__(self, ids: np.ndarray, block: TestBlock):
        self.ids = ids
        some = np.zeros(len(ids), bool)
        known = np.flatnonzero(ids)
        for k, starts in block.starters.items():
            key = _columns(ids, known, k, 63 // block.bits, block.bits)[0]
            place = np.minimum(np.searchsorted(starts, key), len(starts) - 1)
            some[known[starts[place] == key]] = True
        at = np.flatnonzero(some)
        columns = _columns(ids, at, block.words, block.words, block.bits)
        order = np.lexsort(columns[::-1])
        self.suffixes, self.columns = at[order], [c[order] for c in columns]

    def _bound(self, wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """How many suffixes sort before each wanted key (or not after it)."""
        low = np.zeros(len(wanted[0]), np.int64)
        high = np.full(len(wanted[0]), len(self.suffixes), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            probe = np.minimum(mid, len(self.suffixes) - 1)
            less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for own, want in zip(self.columns, wanted):
                less |= same & (own[probe] < want)
                same &= own[probe] == want
            go = open_ & (less | same if after else less)
            low = np.where(go, mid + 1, low)
            high = np.where(open_ & ~go, mid, high)
        return low

    def search(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """Places of all occurrences of the block's distinct windows, and the window at each."""
        if not len(self.suffixes) or not len(block.length):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = self._bound(block.low, False), self._bound(block.high, True)
        n = last - first
        window = np.repeat(np.arange(len(n)), n)
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[window]
        return self.suffixes[rank], window


def _laid_out(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' words with a 0 before, between and after, and where each begins."""
    flat = [0]
    begins = []
    for d in docs:
        begins.append(len(flat))
        flat += d
        flat.append(0)
    return np.array(flat, np.int64), np.array([*begins, len(flat)], np.int64)


class Lengths:
    """How many words agree from a place in the shard and a place in the block on."""

    def __init__(self, ids: np.ndarray, block: TestBlock):
        self.ids, self.block = ids, block
        self.levels: list[np.ndarray] = []

    def _ranks(self) -> list[np.ndarray]:
        """Level k numbers the runs of 2 ** k words of shard and block, equal runs alike; a 0 is like no other."""
        if not self.levels:
            both = np.concatenate([self.ids, self.block.ids])
            zeros = np.flatnonzero(both == 0)
            both[zeros] = self.block.many + np.arange(len(zeros))
            longest_item = int(np.diff(np.append(self.block.begins, len(self.block.ids))).max())
            rank = np.unique(both, return_inverse=True)[1].astype(np.int32)
            self.levels.append(rank)
            while 1 << len(self.levels) <= longest_item:
                ahead = rank[np.minimum(np.arange(len(rank)) + (1 << (len(self.levels) - 1)), len(rank) - 1)]
                rank = np.unique(rank.astype(np.int64) * len(rank) + ahead, return_inverse=True)[1].astype(np.int32)
                self.levels.append(rank)
        return self.levels

    def __call__(self, places: np.ndarray, tests: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The lengths at these pairs, of which as many words as given are known to agree."""
        length = length.copy()
        going = np.arange(len(places))
        for _ in range(STEPS):
            own = self.ids[places[going] + length[going]]
            going = going[(own == self.block.ids[tests[going] + length[going]]) & (own != 0)]
            if not len(going):
                return length
            length[going] += 1
        for k, rank in reversed(list(enumerate(self._ranks()))):
            at, other = places[going] + length[going], tests[going] + length[going]
            # a run that would pass the end of its side holds a 0, so its number is its own
            same = rank[np.minimum(at, len(self.ids) - 1)] == rank[len(self.ids) + np.minimum(other, len(self.block.ids) - 1)]
            length[going[same]] += 1 << k
        return length


def longest(ids: np.ndarray, block: TestBlock) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The longest matches of the test set in a shard: place there, place in the block's words, words that agree.

    Every place of a test window is a test suffix; equal windows are searched once and stand for all of
    theirs. Matches that a word before them would prolong are left to the suffix that begins there, and
    the others are extended as far as both sides agree. So their words are those inside any window.
    They come in portions of about PAIRS.
    """
    places, window = Shard(ids, block).search(block)
    measured = Lengths(ids, block)
    begin, end = block.window_ends[window], block.window_ends[window + 1]
    before = ids[places - 1]
    # the window's tests after the same word, which lie side by side, are passed over; after a 0 none are
    alike = window * block.many + before
    low = np.searchsorted(block.before, alike)
    passed = np.where(before == 0, 0, np.searchsorted(block.before, alike, "right") - low)
    n = end - begin - passed
    upto = np.concatenate([[0], np.cumsum(n)])
    first = 0
    while first < len(places):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + PAIRS, "right")) - 1)
        own = np.arange(first, last)
        pair = np.repeat(own, n[own])
        rank = begin[pair] + np.arange(len(pair)) - (upto[pair] - upto[first])
        tests = block.at[block.by_window[np.where((passed[pair] > 0) & (rank >= low[pair]), rank + passed[pair], rank)]]
        if len(pair):
            yield places[pair], tests, measured(places[pair], tests, block.length[window[pair]])
        first = last


def examine(texts: pa.Array, blocks: list[Broadcast]) -> Iterator[tuple[np.ndarray, set[str]]]:
    """Of each text: which words the longest matches cover, and the names of the items found."""
    for group in groups(texts):
        words = [words_of(t.as_py()) for t in group]
        hit = np.zeros(sum(map(len, words)) + len(words) + 1, bool)
        found: list[set[str]] = [set() for _ in words]
        begins = np.zeros(1, np.int64)
        for b in blocks:
            block: TestBlock = b.value
            ids, begins = _laid_out([block.number(w) for w in words])
            edge = np.zeros(len(ids) + 1, np.int64)
            for places, tests, length in longest(ids, block):
                np.add.at(edge, places, 1)
                np.add.at(edge, places + length, -1)
                doc = np.searchsorted(begins, places, "right") - 1
                for pair in np.unique(doc * len(block.names) + block.item_at(tests)).tolist():
                    d, i = divmod(pair, len(block.names))
                    if block.names[i] is not None:
                        found[d].add(block.names[i])
            hit |= np.cumsum(edge[:-1]) > 0
        for i, w in enumerate(words):
            yield hit[begins[i] : begins[i] + len(w)], found[i]


def test_rounds(benchmark: DataFrame, words: int = WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[Broadcast]]:
    """The test set in rounds of at most ROUND_BLOCKS blocks of at most TEST_WORDS words (or one longer item)."""
    sc = benchmark.sparkSession.sparkContext
    blocks: list[Broadcast] = []
    items: list[tuple[str | None, list[bytes]]] = []
    held = 0
    rows = picked(benchmark, name=id_col, text=text_col)
    for name, text in rows.select(F.col("name").cast("string"), "text").toLocalIterator():
        own = words_of(text)
        if items and held + len(own) > TEST_WORDS:
            blocks.append(sc.broadcast(TestBlock(items, words)))
            items, held = [], 0
            if len(blocks) == ROUND_BLOCKS:
                yield blocks
                blocks = []
        items.append((name, own))
        held += len(own)
    yield [*blocks, sc.broadcast(TestBlock(items, words))]


test_rounds.__test__ = False  # not a test


def _through(rows: DataFrame, rounds: Iterator[list[Broadcast]], step: Callable[[DataFrame, list[Broadcast]], DataFrame]) -> DataFrame:
    """Step by step through the rounds; before the next one its rows are written and its blocks destroyed."""
    blocks, path = next(rounds), None
    for following in rounds:
        rows, written = materialize(step(rows, blocks), "round")
        for b in blocks:
            b.destroy()
        if path is not None:
            discard(rows.sparkSession, path)
        blocks, path = following, written
    return step(rows, blocks)


def detect(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_hit, items (sorted names), contaminated of each document."""
    rows = picked(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def step(rows: DataFrame, blocks: list[Broadcast]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                known = zip(b.column("hit"), b.column("items"))
                hits, items = [], []
                for (hit, found), (former, names) in zip(examine(b.column("text"), blocks), known):
                    if former.is_valid:
                        hit = hit | np.unpackbits(np.frombuffer(former.as_py(), np.uint8), count=len(hit)).astype(bool)
                        found = found.union(names.as_py())
                    hits.append(hit)
                    items.append(sorted(found))
                n = [pa.array([len(h) for h in hits], pa.int64()), pa.array([int(h.sum()) for h in hits], pa.int64())]
                bits = pa.array([np.packbits(h).tobytes() for h in hits], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), bits, *n, pa.array(items, pa.list_(pa.string()))], ["id", "text", "hit", "n_words", "n_hit", "items"])

        known = rows if "hit" in rows.columns else rows.selectExpr("id", "text", "cast(null as binary) as hit", "cast(null as array<string>) as items")
        return known.select("id", "text", "hit", "items").mapInArrow(run, f"id {kind}, text string, hit binary, n_words long, n_hit long, items array<string>")

    out = _through(rows, test_rounds(benchmark, words), step)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, text_col: str = "text") -> DataFrame:
    """The documents without any window of the test set, all their columns as they are."""
    at = docs.columns.index(text_col)

    def step(rows: DataFrame, blocks: list[Broadcast]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not hit.any() for hit, _ in examine(b.column(at), blocks)], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    return by_place(docs, lambda rows: _through(rows, test_rounds(benchmark, words), step))


def matches(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Longest verbatim matches: id_col, item_id, word_at (in the document), item_at, n_words."""
    rows = picked(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def found(blocks: list[Broadcast]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen = 0
                for group in groups(b.column("text")):
                    text_words = [words_of(t.as_py()) for t in group]
                    for shared in blocks:
                        block: TestBlock = shared.value
                        ids, begins = _laid_out([block.number(w) for w in text_words])
                        for at, test, length in longest(ids, block):
                            doc = np.searchsorted(begins, at, "right") - 1
                            item = block.item_at(test)
                            columns = [b.column("id").take(pa.array(doc + seen)), pa.array([block.names[i] for i in item.tolist()], pa.string()), *(pa.array(x, pa.int64()) for x in (at - begins[doc], test - block.begins[item], length))]
                            yield pa.RecordBatch.from_arrays(columns, ["id", "item_id", "word_at", "item_at", "n_words"])
                    seen += len(group)

        return rows.mapInArrow(run, f"id {kind}, item_id string, word_at long, item_at long, n_words long")

    rounds = test_rounds(benchmark, words)
    parts, blocks = [], next(rounds)
    for following in rounds:
        parts.append(materialize(found(blocks), "matches")[0])
        for b in blocks:
            b.destroy()
        blocks = following
    return functools.reduce(DataFrame.union, [*parts, found(blocks)]).withColumnRenamed("id", id_col)
