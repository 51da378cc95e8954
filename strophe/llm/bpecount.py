"""Operator 10: token counts by rank-synchronous merging of ragged arrays.

``count_tokens`` cuts texts into distinct pieces (see ``tokens``), lets the tokenizers library split the
unusual ones into pre-tokens, and merges all unknown pre-tokens of a group together: they lie end to end
in one numpy array of symbols; in each round every sequence applies its lowest-rank pair at all its
places, left to right, and sequences without a pair leave. What is left of a sequence is its count.
There is no shuffle.

Null and empty texts have 0 bytes and 0 tokens; null and repeated ids are kept as they are, one row out
for each row in; an empty table gives an empty table; other columns are not read. Very long texts and
very long pre-tokens need memory in proportion to their own length only.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, picked
from .tokens import MEMO_LENGTH, MEMO_PIECES, _LETTER_SIGN, apart, distinct_pieces, groups

_NONE = np.iinfo(np.int32).max
_PLAIN = "^ ?" + _LETTER_SIGN.split(")")[0][1:] + "+$"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class MergeTable:
    """Ranks and results of pairs, looked up by binary search."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model["end_of_word_suffix"]:
            raise ValueError("count_tokens() needs byte-level BPE without a normalizer")
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.span = max(vocab.values()) + 1
        keys = left * self.span + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.of_char = {c: vocab[c] for c in byte_symbols()}
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For neighbouring symbols, the pair's rank (or _NONE) and its place in the table."""
        wanted = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE), at

    def merged_counts(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many symbols survive in each sequence (none of them empty)."""
        left_over = lengths.copy()
        active = np.arange(len(lengths))
        while len(active):
            starts = np.cumsum(lengths) - lengths
            rank, at = self.find(symbols[:-1], symbols[1:])
            rank, at = np.append(rank, np.int32(_NONE)), np.append(at, 0)
            rank[starts + lengths - 1] = _NONE  # a sequence's last symbol has no pair
            least = np.minimum.reduceat(rank, starts)
            here = (rank == np.repeat(least, lengths)) & (rank != _NONE)
            places = np.flatnonzero(here)
            # a run of overlapping places is one symbol repeated: every second one counts
            begins = np.flatnonzero(np.diff(places, prepend=-2) != 1)
            run = np.repeat(begins, np.diff(np.append(begins, len(places))))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
            symbols[places] = self.made[at[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            lengths = lengths - np.add.reduceat(~keep, starts)
            stay = least != _NONE
            left_over[active[~stay]] = lengths[~stay]
            keep &= np.repeat(stay, np.diff(np.append(starts, len(symbols))))
            symbols, lengths, active = symbols[keep], lengths[stay], active[stay]
        return left_over


class Counter:
    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.known: dict[str, int] = {}

    def pretokens(self, piece: str) -> tuple[list[str], int]:
        """The pre-tokens of a piece in byte symbols, and how many special strings it holds."""
        parts, found = [piece], 0
        for special in self.table.specials:
            parts = [x for part in parts for x in part.split(special)]
        found = len(parts) - 1
        return [s for part in parts if part for s, _ in self.table.split(part)], found

    def count(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece."""
        if not pieces:
            return np.zeros(0, np.int64)
        t = self.table
        plain = pc.match_substring_regex(pa.array(pieces, pa.large_string()), _PLAIN).to_numpy(zero_copy_only=False)
        raw = [p.encode() for p, simple in zip(pieces, plain.tolist()) if simple]
        symbols, lengths = [t.of_byte[np.frombuffer(b"".join(raw), np.uint8)]], [len(r) for r in raw]
        owner = np.flatnonzero(plain).tolist()
        out = np.zeros(len(pieces), np.int64)
        for i in np.flatnonzero(~plain).tolist():
            words, out[i] = self.pretokens(pieces[i])
            for w in words:
                symbols.append(np.array([t.of_char[c] for c in w], np.int32))
                lengths.append(len(w))
                owner.append(i)
        if owner:
            np.add.at(out, np.array(owner), t.merged_counts(np.concatenate(symbols), np.array(lengths, np.int64)))
        return out

    def lookup(self, names: list[str]) -> np.ndarray:
        if len(self.known) > MEMO_PIECES:
            self.known.clear()
        known = self.known
        new = [n for n in names if n not in known]
        known.update(zip(new, self.count(new).tolist()))
        out = np.array([known[n] for n in names], np.int64)
        for n in new:
            if len(n) > MEMO_LENGTH:
                del known[n]
        return out

    def totals(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Tokens of each text, by group."""
        for group in groups(texts):
            lone = apart(group)
            names, codes, bounds = distinct_pieces(pc.if_else(pa.array(lone), "", group) if lone.any() else group)
            upto = np.concatenate([[0], np.cumsum(self.lookup(names)[codes])])[bounds]
            counts = np.diff(upto)
            if lone.any():
                counts[lone] = self.count(group.filter(pa.array(lone)).to_pylist())
            yield counts


def counter(path: str) -> Counter:
    """One counter a worker process and file."""
    return held(("counter", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    rows = picked(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for b in batches:
            counts = np.concatenate([np.zeros(0, np.int64), *own.totals(b.column(1))])
            size = pc.binary_length(pc.fill_null(b.column(1), "")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
