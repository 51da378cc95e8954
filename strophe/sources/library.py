"""A library of documents that changes as a whole: ``df.write.format("strophe_library")``.

A version is a manifest that names its part files. Tasks write their parts first and tell their names, sizes and
digests; the driver then writes the manifest under the next number, which fails if another writer was
faster. So a version is there with all of its parts or not at all: after a failed task, or a driver that was lost, readers
go on with the version before, and parts that no manifest names are ignored. ``overwrite`` makes a version of
the new parts alone, ``append`` adds them to those before.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .blocks import local_path

NAME = "strophe_library"
SCHEMA = "key long, document string"


@dataclass
class Part(WriterCommitMessage):
    file: str
    rows: int
    bytes: int
    sha256: str


def versions(path: str) -> list[int]:
    folder = os.path.join(local_path(path), "manifests")
    return sorted(int(f.removesuffix(".json")) for f in os.listdir(folder) if f.endswith(".json")) if os.path.isdir(folder) else []


def manifest(path: str, version: int | None = None) -> dict:
    """A version's manifest, the newest by default; without any version no parts."""
    known = versions(path)
    if not known:
        return {"version": 0, "parts": []}
    with open(os.path.join(local_path(path), "manifests", f"{version or known[-1]}.json")) as f:
        return json.load(f)


class LibraryWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = local_path(path), overwrite, uuid.uuid4().hex
        self.base = manifest(path)["version"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        name = f"{self.run}-{task.partitionId()}-{task.taskAttemptId()}.jsonl"  # another attempt writes another file
        folder = os.path.join(self.path, "parts")
        os.makedirs(folder, exist_ok=True)
        digest, rows, size = hashlib.sha256(), 0, 0
        with open(os.path.join(folder, name), "wb") as f:
            for b in iterator:
                for key, document in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    line = json.dumps({"key": key, "document": document}, ensure_ascii=False).encode() + b"\n"
                    digest.update(line)
                    f.write(line)
                    rows, size = rows + 1, size + len(line)
            f.flush()
            os.fsync(f.fileno())
        return Part(name, rows, size, digest.hexdigest())

    def commit(self, messages: list) -> None:
        folder = os.path.join(self.path, "manifests")
        os.makedirs(folder, exist_ok=True)
        before = [] if self.overwrite else manifest(self.path, self.base or None)["parts"]
        parts = before + [asdict(m) for m in messages if m is not None and m.rows]
        for p in parts:
            if os.path.getsize(os.path.join(self.path, "parts", p["file"])) != p["bytes"]:
                raise ValueError(f"part {p['file']} is not whole")
        draft = os.path.join(folder, f".{self.run}")
        with open(draft, "w") as f:
            json.dump({"version": self.base + 1, "parts": parts}, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, os.path.join(folder, f"{self.base + 1}.json"))  # fails where the number is taken
        except FileExistsError:
            raise RuntimeError(f"version {self.base + 1} was written by another; read it and write again") from None
        finally:
            os.unlink(draft)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(os.path.join(self.path, "parts", m.file))


class Library(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> LibraryWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["bigint", "string"]:
            raise ValueError(f"a library holds {SCHEMA}")
        return LibraryWriter(self.options["path"], overwrite)


def write_library(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes documents (key, document) as the next version of the library at path."""
    documents.sparkSession.dataSource.register(Library)
    documents.select(F.col("key").cast("long").alias("key"), F.col("document").cast("string").alias("document")).write.format(NAME).mode(mode).save(path)


def read_library(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """key, document of a version, the newest by default; each part is held against its size."""
    parts = manifest(path, version)["parts"]
    folder = os.path.join(local_path(path), "parts")
    for p in parts:
        if os.path.getsize(os.path.join(folder, p["file"])) != p["bytes"]:
            raise ValueError(f"part {p['file']} is not whole")
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json([f"file://{os.path.join(folder, p['file'])}" for p in parts])
