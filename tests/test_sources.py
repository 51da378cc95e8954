"""The streaming source of blocks, the library of documents, and the two sides of a damaged shelf."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strophe.operators import shelf
from strophe.sources import blocks, library


def table(folder, name, first, n):
    folder.mkdir(exist_ok=True)
    rows = pa.table({"take_id": ["a"] * n, "at": pa.array(range(first, first + n), pa.int64()), "samples": [[float(i), 0.5] for i in range(first, first + n)]})
    pq.write_table(rows, folder / name, row_group_size=7)


def read(spark, folder, out, checkpoint, **options):
    blocks.register(spark)
    stream = spark.readStream.format(blocks.NAME).options(path=str(folder), **options).load()
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).start(str(out))
    try:
        query.processAllAvailable()
        return [p.numInputRows for p in query.recentProgress if p.numInputRows]
    finally:
        query.stop()
        query.awaitTermination()


def test_blocks_come_once_over_restarts(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    table(folder, "0.parquet", 0, 25)
    table(folder, "1.parquet", 25, 40)
    sizes = read(spark, folder, out, checkpoint, rows_per_batch=10, rows_per_task=4)
    assert sizes == [10] * 6 + [5]  # the limit holds, and batches run over the ends of files
    table(folder, "2.parquet", 65, 3)
    assert read(spark, folder, out, checkpoint, rows_per_batch=10) == [3]
    got = spark.read.parquet(str(out)).orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(68)) and all(list(r.samples) == [float(r["at"]), 0.5] for r in got)


def test_blocks_of_a_batch_that_is_run_again(tmp_path):
    table(tmp_path / "in", "0.parquet", 0, 25)
    table(tmp_path / "in", "1.parquet", 25, 40)
    make = lambda: blocks.BlockReader(blocks.Blocks({"path": str(tmp_path / "in")}).schema(), {"path": str(tmp_path / "in"), "rows_per_batch": "9", "rows_per_task": "5"})
    reader = make()
    end = reader.latestOffset()
    parts = reader.partitions({"rows": 20}, {"rows": 38})
    assert end == {"rows": 9} and [(p.start, p.stop) for p in parts] == [(20, 25), (0, 5), (5, 10), (10, 13)]
    rows = lambda r, ps: [x for p in ps for b in r.read(p) for x in b.column("at").to_pylist()]
    again = make()
    assert rows(reader, parts) == rows(again, again.partitions({"rows": 20}, {"rows": 38})) == list(range(20, 38))
    assert again.latestOffset() == {"rows": 47} and again.partitions({"rows": 38}, {"rows": 38}) == []
    table(tmp_path / "in", "0a.parquet", 0, 1)
    with pytest.raises(ValueError, match="added before"):
        again.latestOffset()
    with pytest.raises(ValueError, match="mounted"):
        blocks.local_path("s3://bucket/table")


def kept(df):
    return sorted((r.key, r.document) for r in df.collect())


def test_library_changes_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "library")
    assert library.read_library(spark, path).count() == 0
    make = lambda n, tag: spark.range(n, numPartitions=4).select(F.col("id").alias("key"), F.concat(F.lit(tag + '\n"é" '), F.col("id").cast("string")).alias("document"))
    library.write_library(make(20, "one"), path)
    first = kept(library.read_library(spark, path))
    assert len(first) == 20 and first[3] == (3, 'one\n"é" 3')
    broken = make(20, "two").withColumn("document", F.when(F.col("key") == 17, F.raise_error(F.lit("lost"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="lost"):
        library.write_library(broken, path)
    assert kept(library.read_library(spark, path)) == first and library.versions(path) == [1]
    library.write_library(make(2, "three"), path, "append")
    assert len(kept(library.read_library(spark, path))) == 22 and kept(library.read_library(spark, path, 1)) == first
    library.write_library(make(1, "four"), path)
    assert kept(library.read_library(spark, path)) == [(0, 'four\n"é" 0')] and library.versions(path) == [1, 2, 3]
    named = {p["file"] for v in (1, 2, 3) for p in library.manifest(path, v)["parts"]}
    assert all(p["rows"] for p in library.manifest(path)["parts"]) and named


def test_of_two_writers_one_wins(tmp_path):
    path = str(tmp_path / "library")
    one, two = library.LibraryWriter(path, True), library.LibraryWriter(path, True)
    one.commit([])
    with pytest.raises(RuntimeError, match="written by another"):
        two.commit([])
    assert library.versions(path) == [1] and not [f for f in (tmp_path / "library" / "manifests").iterdir() if f.name.startswith(".")]


def test_parts_that_are_not_whole_are_refused(spark, tmp_path):
    path = str(tmp_path / "library")
    library.write_library(spark.createDataFrame([(1, "x" * 100)], "key long, document string"), path)
    part = tmp_path / "library" / "parts" / library.manifest(path)["parts"][0]["file"]
    part.write_bytes(part.read_bytes()[:50])
    with pytest.raises(ValueError, match="not whole"):
        library.read_library(spark, path)


def test_both_sides_of_a_damaged_shelf(spark):
    stat = {"observations": 3, "clean": 1, "off": 1, "wrong": 1, "missing": 0, "centsObservations": 2, "wrongRateEwma": 0.5, "absCentsEwma": 12.5}
    rows = [
        (1, json.dumps({"version": 1, "intervals": {"-3": stat, "x": stat, "1.5": stat, "4": [1]}, "targets": None, "holds": None})),
        (2, json.dumps({"version": 1, "intervals": 7, "targets": {"9": {"slots": [{"clean": 2.9, "off": "1"}, 4], "history": [{"no": k, "verdicts": "cow-"} for k in range(21)]}, "10": {"slots": {}}, "11": 3}, "holds": {"count": 2, "offset": -4}})),
        (3, json.dumps({"version": "1"})),
        (4, "[1]"),
        (5, None),
        (6, json.dumps({"version": 1})),
        (7, json.dumps({"version": 1.0, "holds": [1], "intervals": {"2": {**stat, "wrongRateEwma": -1, "observations": -5}}})),
    ]
    accepted, rejected = shelf.read_documents(spark.createDataFrame(rows, "key long, document string"))
    got = {(r.key, r.kind, r.name, r.place): r for r in accepted.collect()}
    assert set(got) == {(1, "interval", "-3", None), (2, "slot", "9", 0), (2, "slot", "9", 1), (2, "hold", "holds", None), (7, "interval", "2", None)} | {(2, "attempt", "9", k) for k in range(20)}
    whole, slot, hold, mended = (got[k] for k in ((1, "interval", "-3", None), (2, "slot", "9", 0), (2, "hold", "holds", None), (7, "interval", "2", None)))
    assert (whole.total, whole.clean, whole.aimed, whole.x, whole.y, whole.repaired) == (3, 1, 2, 0.5, 12.5, [])
    assert (slot.clean, slot.off, slot.total, slot.repaired) == (2, 0, 2, ["off", "wrong", "missing"])
    assert (hold.total, hold.x, hold.y, hold.repaired) == (2, -4.0, 0.0, ["wobble"])
    assert (mended.total, mended.x) == (0, 0.0) and mended.repaired == ["observations", "wrongRateEwma"]
    want = {(1, "$.intervals.x", "name is no whole number"), (1, "$.intervals.1.5", "name is no whole number"), (1, "$.intervals.4", "no object"), (2, "$.targets.9.history[20]", "older than the newest"), (2, "$.targets.10", "no slots"), (2, "$.targets.11", "no object")}
    want |= {(3, "$", "another version"), (4, "$", "no object"), (5, "$", "no object"), (7, "$.holds", "no object")}
    assert {tuple(r) for r in rejected.collect()} == want and rejected.count() == len(want)
