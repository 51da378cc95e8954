"""Operator 1: token ids in sorted-string-table shards.

A shard is one file:

    block ...  data blocks, each a zstandard frame of about BLOCK bytes of entries
    index      for each block: its first key, where it begins, how long it is
    bloom      bits of a Bloom filter over the shard's keys
    footer     fixed size: places of index and bloom, counts, width of an id, magic

Every part ends with a newline byte, so that Spark's own text sink writes the parts of a partition in
order, through whatever file system the path names and with its commit protocol: no executor writes a
file by itself, and a lost one is simply run again.

A key is the document's identifier, as 8 big-endian bytes with the sign bit turned (bytes then sort as
numbers); a null identifier has the empty key, which sorts first. Within a block a key is stored as the
number of bytes it shares with the key before and the rest. A value is the ids, little-endian, of 2 or 4
bytes each. Repeated identifiers are kept as entries of their own, ordered by text.

Rows are dealt by ranges of the identifier, as many as the input's size asks for, and encoded only after
that. Null and empty texts have the end id alone; an empty table gives an empty folder of shards; other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import picked, plan_bytes, scratch_path
from .tokens import encoder

BLOCK = 64 << 10
SHARD_BYTES = 8 << 20
BITS_PER_KEY, HASHES = 10, 7
FOOTER = struct.Struct("<6QB7s")
MAGIC = b"SSTTOK1"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a = xxhash.xxh64_intdigest(key, 1)
    b = xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


def shard_parts(entries: Iterable[tuple[bytes, bytes]], width: int) -> Iterator[bytes]:
    """The parts of a shard, without their last newlines, for entries in the order of their keys."""
    pack = zstandard.ZstdCompressor(level=1)
    index, keys, block = [], [], bytearray()
    first = last = b""
    at = n_ids = 0

    def close() -> bytes:
        nonlocal at, block
        part = pack.compress(bytes(block))
        index.append((first, at, len(part)))
        at += len(part) + 1
        block = bytearray()
        return part

    for key, value in entries:
        if len(block) >= BLOCK:
            yield close()
        shared = 0
        if block:
            while shared < min(len(key), len(last)) and key[shared] == last[shared]:
                shared += 1
        else:
            first = key
        block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        last = key
        keys.append(key)
        n_ids += len(value) // width
    if not keys:
        return
    yield close()
    entry = b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in index)
    yield entry
    bits = max(64, len(keys) * BITS_PER_KEY + 7 & ~7)
    bloom = bytearray(bits // 8)
    for key in keys:
        for p in _bloom_places(key, bits):
            bloom[p >> 3] |= 1 << (p & 7)
    yield bytes(bloom)
    yield FOOTER.pack(at, len(entry), at + len(entry) + 1, len(bloom), len(keys), n_ids, width, MAGIC)


class Shard:
    """Reads one shard from its bytes."""

    def __init__(self, data: bytes):
        size = FOOTER.size + 1
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(data[-size:-1])
        if magic != MAGIC or data[-1:] != b"\n":
            raise ValueError("not a token shard")
        self.data, self.bloom = data, data[bloom_at : bloom_at + bloom_n]
        self.blocks: list[tuple[bytes, int, int]] = []
        at = index_at
        while at < index_at + index_n:
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            begin, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.blocks.append((key, begin, length))

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, begin, length = self.blocks[block]
        raw = zstandard.ZstdDecompressor().decompress(self.data[begin : begin + length])
        at, key = 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.blocks)):
            yield from self.entries(block)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, len(self.bloom) * 8))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that identifier: Bloom filter, binary search of the index, scan."""
        key = key_of(doc_id)
        found: list[np.ndarray] = []
        if not self.may_hold(key):
            return found
        block = bisect_right(self.blocks, key, key=lambda b: b[0]) - 1
        while block > 0 and self.blocks[block][0] == key:  # repeated identifiers may begin in blocks before
            block -= 1
        for k, value in (e for b in range(max(block, 0), len(self.blocks)) if self.blocks[b][0] <= key for e in self.entries(b)):
            if k == key:
                found.append(np.frombuffer(value, f"<u{self.width}"))
        return found


def write_token_tables(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes whole texts and writes shards in ascending order of the identifier below path."""
    rows = picked(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    size = plan_bytes(rows)
    if size > 1 << 56:  # not files, so Catalyst has no figure; measure
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = size // shard_bytes + 1
    dealt = rows.repartitionByRange(shards, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = np.array([end_id], own.dtype).tobytes()

        def entries() -> Iterator[tuple[bytes, bytes]]:
            for b in batches:
                names, at = b.column(0).to_pylist(), 0
                for ids, lengths in own.ids(b.column(1)):
                    raw, begin = ids.tobytes(), 0
                    for n in (lengths * own.dtype.itemsize).tolist():
                        yield key_of(names[at]), raw[begin : begin + n] + end
                        begin, at = begin + n, at + 1

        for part in shard_parts(entries(), own.dtype.itemsize):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], ["part"])

    # Spark's strings hold any bytes, and its text sink writes them as they are, each with a newline.
    parts = dealt.mapInArrow(run, "part binary").select(F.col("part").cast("string").alias("value"))
    parts.write.option("lineSep", "\n").option("compression", "none").text(path)


def read_token_tables(spark: SparkSession, path: str) -> DataFrame:
    """One row an entry: doc_id, shard (file), at (ids before it in its shard), n_tokens, ids_crc32, ids."""
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(path).where("length > 0")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                shard = Shard(data.as_py())
                rows: list[tuple] = []
                at = held = 0
                for key, value in shard:
                    ids = np.frombuffer(value, f"<u{shard.width}").astype("<u4").tobytes()
                    rows.append((id_of(key), name.as_py(), at, len(ids) // 4, zlib.crc32(ids), ids))
                    at, held = at + len(ids) // 4, held + len(ids)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "shard", "at", "n_tokens", "ids_crc32", "ids"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return files.select("path", "content").mapInArrow(run, "doc_id long, shard string, at long, n_tokens long, ids_crc32 long, ids binary")


def lookup(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """Ids of the given documents (column doc_id), by binary search in the shards that may hold them.

    The list asked for is sent to every shard, so it must be small; it is refused over 100,000 rows.
    """
    wanted = [r[0] for r in doc_ids.select("doc_id").limit(100_001).collect()]
    if len(wanted) > 100_000:
        raise ValueError("lookup() takes at most 100,000 identifiers; join read_token_tables() for more")
    files = spark.read.format("binaryFile").load(path).where("length > 0")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                shard = Shard(data.as_py())
                rows = [(i, ids.astype("int32").tolist()) for i in dict.fromkeys(wanted) for ids in shard.get(i)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return files.select("content").mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_positions(entries: DataFrame) -> DataFrame:
    """Adds start: ids of all documents before it, over all shards. A row a shard is summed in order."""
    totals = entries.groupBy("shard").agg(F.min(F.struct(F.col("doc_id"), F.col("at"))).alias("first"), F.sum("n_tokens").alias("n"))
    # one short row a shard, so the ordered sum over all of them stays small; min(struct) puts null first
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return entries.join(offsets, "shard").withColumn("start", F.col("base") + F.col("at"))


def token_tables(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Writes the shards and reads them back: doc_id, start, n_tokens, ids_crc32 of each document."""
    from .common import materialize

    path = path or scratch_path(docs.sparkSession, "sst")
    write_token_tables(docs, path, tokenizer, end_id)
    rows, _ = materialize(read_token_tables(docs.sparkSession, path).drop("ids"), "sst-rows")
    return token_positions(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
