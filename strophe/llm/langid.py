"""Operator 8: language identification by compression.

Each language has a raw-content zstandard dictionary made of passages of labelled texts. A text, in lower
case and with all but letters taken as one space, is compressed whole, block by block, with every
language's dictionary; the smallest total is the prediction. Where the two smallest lie within
``CLOSE`` bytes, as they do for a few words, the totals with each part of the dictionaries are added,
which tells finer. A text is rejected when the margin, relative to the smallest total, is below
``min_margin``.

The classifier is fitted on a bounded sample: of each language, passages of at most ``PASSAGE``
characters from about ``SAMPLE`` labelled documents, picked and placed by a hash, up to ``DICTIONARY``
bytes. Counting the labelled rows of each language and drawing the sample are the only steps that read
labels. There is no shuffle but that of the counts, which are combined first.

Null texts and texts without a letter are ``und`` with score 0, and rejected; so is every text if no row
is labelled. Null ids are kept and never learned from. Repeated rows are predicted alike. An empty table
gives an empty table. Other columns are not read by ``predict`` and are kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, held, picked

SAMPLE = 300
PASSAGE = 1000
DICTIONARY = 64 << 10
PARTS = 8
MOST_LANGUAGES = 1000
LEVEL = 7
TEXT_BLOCK = 4096
CLOSE = 4
MIN_MARGIN = 0.005

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def plain(text: str) -> bytes:
    """Lower-case letters, single spaces between and around."""
    return (" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """The dictionary of each language of the labelled rows."""
    rows = picked(labelled, id=id_col, text=text_col, lang=lang_col).where("id is not null and text is not null and lang is not null")
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    spark = labelled.sparkSession
    shares = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, SAMPLE / r["count"])) for r in counts], "lang string, share double"))
    h = F.xxhash64("id", "text")
    drawn = rows.withColumn("h", h).join(shares, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    room = F.greatest(F.length("text") - PASSAGE + 1, F.lit(1))
    # equal rows hash alike and count once, so the rows that reach the driver are about SAMPLE a language
    passages = drawn.dropDuplicates(["lang", "h"]).select("lang", "h", F.substring("text", F.pmod("h", room).cast("int") + 1, F.lit(PASSAGE)).alias("passage")).collect()
    made: dict[str, bytes] = {}
    for lang, _, passage in sorted(passages, key=lambda r: (r[0], r[1], r[2])):
        held = made.get(lang, b"")
        if len(held) < DICTIONARY:
            made[lang] = (held + plain(passage))[:DICTIONARY]
    return made


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.whole = [self._compressor(dictionaries[n]) for n in self.names]
        cut = [[d[i * len(d) // PARTS : (i + 1) * len(d) // PARTS] for i in range(PARTS)] for d in (dictionaries[n] for n in self.names)]
        self.parts = [[self._compressor(p) for p in parts if len(p) >= 8] for parts in cut]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, text: str) -> np.ndarray | None:
        """The compressed size for each language; None for a text without a letter."""
        if not self.names or not _LETTER.search(text):
            return None
        data = plain(text)
        blocks = [data[i : i + TEXT_BLOCK] for i in range(0, len(data), TEXT_BLOCK)]
        total = np.array([sum(len(c.compress(b)) for b in blocks) for c in self.whole], float)
        if len(total) > 1:
            least = np.partition(total, 1)
            if least[1] - least[0] <= CLOSE:
                total += [np.mean([sum(len(c.compress(b)) for b in blocks) for c in parts] or [len(data)]) for parts in self.parts]
        return total

    def predict(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
        """Language, score, whether it is accepted."""
        total = self.sizes(text) if text else None
        if total is None:
            return "und", 0.0, False
        best = int(total.argmin())
        width = max(2.0, 0.02 * total[best])
        score = float(1 / np.exp((total[best] - total) / width).sum())
        margin = (np.partition(total, 1)[1] - total[best]) / total[best] if len(total) > 1 else 1.0
        return self.names[best], score, bool(margin >= min_margin and margin > 0)


def _classifier(shared) -> Classifier:
    """The broadcast dictionaries' classifier, made once a worker process."""
    return held(("classifier", shared.value), lambda: Classifier(shared.value))


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score, accepted of each document."""
    rows = picked(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most MOST_LANGUAGES * DICTIONARY bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _classifier(shared)
        for b in batches:
            got = [own.predict(t.as_py(), min_margin) for t in b.column(1)]
            columns = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "lang_pred", "score", "accepted"])

    out = rows.mapInArrow(run, f"id {kind.simpleString()}, lang_pred string, score double, accepted boolean")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "accepted")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """The documents whose language is told, all their columns as they are."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _classifier(shared)
        for b in batches:
            yield b.filter(pa.array([own.predict(t.as_py(), min_margin)[2] for t in b.column(at)], pa.bool_()))

    return by_place(docs, lambda rows: rows.mapInArrow(run, rows.schema))
