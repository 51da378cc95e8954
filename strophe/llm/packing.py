"""Operator 7: packing by concatenation and cuts.

Two passes. The first encodes each partition in the order of the scan, numbers the tokens within it and
writes the ids to the shared folder. The totals of the partitions, one short row each, are summed in
order and give every partition its global offset. The second pass places each document on the global
line of tokens and cuts it where windows of ``window`` tokens meet; a document that crosses a window's
end gives one row for each piece. There is no shuffle of texts or ids, and no window but the last is
short.

Null and empty texts hold the end id alone. Null and repeated ids are kept; an empty table gives no
pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, picked
from .tokens import encoder


def encode_in_order(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, part (partition), at (tokens before it there), n, ids (little-endian, 4 bytes each)."""
    rows = picked(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            seen = 0
            for ids, lengths in own.ids(b.column(1)):
                ends = np.cumsum(lengths)
                wide = np.insert(ids.astype("<u4"), ends, np.uint32(end_id))  # an end id after each document
                sizes = lengths + 1
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                data = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer((cuts * 4).astype("<i8").tobytes()), pa.py_buffer(wide.tobytes())])
                columns = [b.column(0).slice(seen, len(sizes)), pa.array(np.full(len(sizes), part), pa.int64()), pa.array(at + cuts[:-1], pa.int64()), pa.array(sizes, pa.int64()), data.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", "at", "n", "ids"])
                seen, at = seen + len(sizes), at + int(cuts[-1])

    return rows.mapInArrow(run, f"id {kind.simpleString()}, part long, at long, n long, ids binary")


def place(encoded: DataFrame) -> DataFrame:
    """Adds begin, the document's place among the tokens of all partitions."""
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    # one short row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # broadcast: its rows are as many as the first pass had tasks, 16 bytes each, whatever the data's size
    return encoded.join(F.broadcast(offsets), "part").withColumn("begin", F.col("base") + F.col("at"))


def cut(placed: DataFrame, window: int = 4096) -> DataFrame:
    """One row a piece: id, doc_tokens, sequence_id, offset (in the sequence), start (in the document), length, ids."""
    pieces = placed.select("id", "begin", "n", "ids", F.explode(F.expr(f"sequence(begin div {window}, (begin + n - 1) div {window})")).alias("sequence_id"))
    first = F.greatest(F.col("begin"), F.col("sequence_id") * window)
    after = F.least(F.col("begin") + F.col("n"), (F.col("sequence_id") + 1) * window)
    spans = pieces.withColumns({"start": first - F.col("begin"), "length": after - first, "offset": first - F.col("sequence_id") * window})
    return spans.select("id", F.col("n").alias("doc_tokens"), "sequence_id", "offset", "start", "length", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as pieces of sequences of at most window tokens, with the ids of each piece."""
    encoded, _ = materialize(encode_in_order(docs, tokenizer, end_id, id_col, text_col), "packed")
    return cut(place(encoded), window).withColumnRenamed("id", id_col)
