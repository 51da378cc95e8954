"""Exact token ids of whole texts through the tokenizers library, each distinct piece encoded once.

A text is cut where its pre-tokenizer always cuts, so the concatenated ids of the pieces are the ids of
the text. Two families are recognised from the tokenizer's own definition; any other one encodes whole
texts.

* byte-level with the usual pattern, no normalizer, no prefix space: a space that is followed by a
  character other than white space begins a pre-token, whatever stands before it.
* an inverted "removed" split whose classes exclude white space: no pre-token holds a space.

In both, a sign of ``,.;:!?`` after a letter begins a pre-token. Special strings hold neither, so a cut
never splits one. Texts with another kind of space or with the separator used here are encoded whole.

Texts go through Arrow kernels in groups: cut, dictionary-encode, look the distinct pieces up, gather.
Unknown pieces go to the library in calls of ``CALL_PIECES``; in the second family joined by spaces, as one text. Memory is
bounded: a group holds about ``GROUP_BYTES`` (``GROUP_DROPPED``) and the table of known pieces about ``MEMO_PIECES`` entries (``MEMO_DROPPED``): when its newer half is full, the older half goes,
and what is met again moves to the newer one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

GROUP_BYTES = 3 << 20
MEMO_PIECES = 400_000
#: The same, and a larger group, where the library takes many pieces as one text, which costs less than a call a piece.
MEMO_DROPPED = 400_000
GROUP_DROPPED = 8 << 20
#: Pieces of one call: what the library makes of them is some ten times their size.
CALL_PIECES = 16_384
#: Longer pieces are encoded each time and not remembered.
MEMO_LENGTH = 64

_MARK = "\x01"
#: The separator, or a space that does not surely begin a pre-token: before white space or at the end.
_APART = "\x01| ([\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|$)"
#: Words that a normalizer of NFC and small letters changes letter by letter, and the small letters of theirs that aren't ASCII.
#: The codes in bytes hold none of these letters.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
SMALL_LATIN = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
#: A letter whose lower case is one letter, then a sign.
_LETTER_SIGN = "([A-Za-zÀ-ÖØ-öø-įı-ſ])([,.;:!?])"


def groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[pa.Array]:
    """Slices of neighbouring texts of about limit bytes each, without nulls; null counts as empty."""
    texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "") if texts.null_count else texts  # which would copy them
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield texts.slice(first, last - first)
        first = last


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + lengths[i]], one after another."""
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return flat[shift + np.arange(len(shift))]


def distinct_pieces(texts: pa.Array, dropped: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of texts, a code for each piece in order, and where each text's pieces begin.

    Where spaces are dropped, pieces have none, so a word is the same piece with and without one before it."""
    mark = " " if dropped else _MARK
    marked = texts if dropped else pc.replace_substring(texts, " ", _MARK + " ")
    marked = pc.replace_substring_regex(marked, _LETTER_SIGN, f"\\1{mark}\\2")
    cut = pc.split_pattern(marked, mark)
    coded = cut.flatten().dictionary_encode()
    bounds = cut.offsets.to_numpy().astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), bounds - bounds[0]


def apart(texts: pa.Array) -> np.ndarray:
    """Which texts distinct_pieces() must not cut."""
    return pc.match_substring_regex(texts, _APART).to_numpy(zero_copy_only=False)


class Encoder:
    """Ids of texts, as runs of one flat array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = self._family(spec)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.mark = self._mark() if self.kind == "dropped" else None
        self.plain = self._plain(spec) if self.mark is not None else None
        self.last = self._last(spec["model"])
        self.memo = MEMO_DROPPED if self.mark is not None else MEMO_PIECES
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _family(spec: dict) -> str:
        pre = spec.get("pre_tokenizer") or {}
        specials = [t for t in spec["added_tokens"] if not re.fullmatch(r"<\|[a-z]+\|>", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]]
        if specials or spec.get("truncation") or spec.get("padding"):
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            return "spaces"
        kinds = {n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])}
        first = (pre.get("pretokenizers") or [{}])[0]
        if first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and kinds <= {"NFC", "Replace", "Lowercase"}:
            pattern = first["pattern"].get("Regex", "")
            if " " not in pattern and "[^\\s" in pattern:
                return "dropped"
        return "whole"

    def _plain(self, spec: dict):
        """The same model for words of LATIN letters in small ones and as bytes, between spaces, if the definition makes of such a word just that."""
        from tokenizers import Tokenizer, pre_tokenizers

        normal, (split, *after) = (spec.get("normalizer") or {}).get("normalizers", []), spec["pre_tokenizer"]["pretokenizers"]
        ways = split["pattern"]["Regex"].split("|")
        letters = "[\\p{L}]+"
        if letters not in ways or any(not w.startswith("'") for w in ways[: ways.index(letters)]):
            return None
        if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or normal[1]["pattern"] != {"Regex": "\\s+"}:
            return None
        if [(a["type"], a.get("add_prefix_space"), a.get("use_regex")) for a in after] != [("ByteLevel", False, False)]:
            return None
        made = Tokenizer(self.library.model)
        made.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.signs = [(c, "".join(w for w, _ in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c))) for c in SMALL_LATIN]
        return made

    def _mark(self) -> int | None:
        """The one id that the separator has as a word, if it has one."""
        alone, between = (self.library.encode(t, add_special_tokens=False).ids for t in (_MARK, f". {_MARK} ."))
        return alone[0] if len(alone) == 1 and len(between) == 3 and between.count(alone[0]) == 1 else None

    def _last(self, model: dict) -> np.ndarray:
        """Which ids end a word; none do where the model doesn't say."""
        last, suffix = np.zeros(self.library.get_vocab_size(), bool), model.get("end_of_word_suffix")
        if self.mark is not None and suffix:
            last[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        return last

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The library's ids of each piece, CALL_PIECES of them in one call."""
        call = self._call if self.mark is None else self._joined
        return [ids for i in range(0, len(pieces), CALL_PIECES) for ids in call(pieces[i : i + CALL_PIECES])]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """As three texts: pieces of LATIN letters, of which the model needs no more, and of other letters, of which
        each is a word, and others with the separator between them, a word and an id of its own."""
        out = {}
        latin = LATIN.fullmatch if self.plain else lambda p: None
        words = ([], [])
        for p in pieces if self.last.any() else []:
            if p.isalpha():
                words[latin(p) is None].append(p)
        for own, encode in zip(words, (self._small, self._text)):
            ids = encode(" ".join(own))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(own):  # else some piece is not one word
                out.update(zip(own, self._sliced(ids, np.append(0, ends[:-1]), ends)))
        others = [p for p in pieces if p not in out]
        if others:
            ids = self._text(f" {_MARK} ".join(others))
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            out.update(zip(others, self._sliced(ids, np.append(0, ends[:-1] + 1), ends), strict=True))
        return [out[p] for p in pieces]

    def _text(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _small(self, text: str) -> np.ndarray:
        """Ids of words of LATIN letters with a space between two."""
        if not text:
            return np.zeros(0, self.dtype)
        text = text.lower()
        if not text.isascii():
            for sign, coded in self.signs:
                text = text.replace(sign, coded)
        return np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _sliced(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw, w = ids.tobytes(), self.dtype.itemsize
        return [raw[a:b] for a, b in zip((starts * w).tolist(), (ends * w).tolist())]

    def _call(self, pieces: list[str]) -> list[bytes]:
        got = self.library.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, self.dtype)
        words = np.array([-1 if w is None else w for w in got.word_ids], np.int64)
        cuts = np.searchsorted(words, np.arange(len(pieces) + 1)) * self.dtype.itemsize
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _lookup(self, names: list[str]) -> list[bytes]:
        if len(self.known) > self.memo // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = []
        for n in names:
            if n not in known:
                if n in older:
                    known[n] = older[n]
                else:
                    new.append(n)
        known.update(zip(new, self._pieces(new)))
        out = [known[n] for n in names]
        for n in new:
            if len(n) > MEMO_LENGTH:
                del known[n]
        return out

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "whole":
            raw = self._whole(texts.to_pylist())
            return np.frombuffer(b"".join(raw), self.dtype), np.array([len(r) for r in raw], np.int64) // self.dtype.itemsize
        lone = apart(texts)
        names, codes, bounds = distinct_pieces(pc.if_else(pa.array(lone), "", texts) if lone.any() else texts, self.kind == "dropped")
        raw = self._lookup(names)
        sizes = np.array([len(r) for r in raw], np.int64) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(raw), self.dtype)
        each = sizes[codes]
        ids = ragged_take(flat, (np.cumsum(sizes) - sizes)[codes], each)
        upto = np.concatenate([[0], np.cumsum(each)])[bounds]
        lengths = np.diff(upto)
        if lone.any():
            parts, at = [], 0
            for i, r in zip(np.flatnonzero(lone), self._whole(texts.filter(pa.array(lone)).to_pylist())):
                parts += [ids[at : upto[i]], np.frombuffer(r, self.dtype)]
                lengths[i], at = len(parts[-1]), upto[i]
            ids = np.concatenate([*parts, ids[at:]])
        return ids, lengths

    def ids(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each group of neighbouring texts, all their ids and how many each text has."""
        for group in groups(texts, GROUP_DROPPED if self.kind == "dropped" else GROUP_BYTES):
            yield self._group(group)


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file; its tables last from task to task."""
    return held(("encoder", path), lambda: Encoder(path))
