"""A streaming source of a table's rows in order: ``spark.readStream.format("strophe_blocks")``.

The table is a folder of Parquet files, ordered by name; files may be added with later names, and never change. An
offset is the number of rows before it, so a batch that is run again after a failure reads the same rows.
``rows_per_batch`` limits what a batch admits, ``rows_per_task`` what a task of it reads. Only footers
are read on the driver; each task reads the row groups that hold its rows.
"""

from __future__ import annotations

import glob
import json
import os
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

NAME = "strophe_blocks"


def local_path(path: str) -> str:
    """A path without its scheme; the folder must be mounted wherever driver and executors run."""
    scheme, colon, rest = path.partition("://")
    if colon and scheme != "file":
        raise ValueError(f"{path} is not a folder of a mounted file system")
    return rest if colon else path.removeprefix("file:")


@dataclass
class Rows(InputPartition):
    """Rows [start, stop) of a file."""

    file: str
    start: int
    stop: int


class BlockReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns = [f.name for f in schema.fields]
        self.path = local_path(options["path"])
        self.limit = int(options.get("rows_per_batch", 1 << 62))
        self.share = int(options.get("rows_per_task", 100_000))
        if self.limit < 1 or self.share < 1:
            raise ValueError("rows_per_batch and rows_per_task must be positive")
        self.at = 0
        self.counts: dict[str, int] = {}

    def _ends(self) -> tuple[list[str], list[int]]:
        """The files in order, and how many rows lie before each one's end."""
        files = sorted(glob.glob(os.path.join(self.path, "*.parquet")))
        if list(self.counts) != files[: len(self.counts)]:
            raise ValueError("files of the table were removed, or added before those already read")
        for f in files[len(self.counts) :]:
            self.counts[f] = pq.read_metadata(f).num_rows
        ends, n = [], 0
        for f in files:
            n += self.counts[f]
            ends.append(n)
        return files, ends

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        _, ends = self._ends()
        return {"rows": min(max(self.at, ends[-1] if ends else 0), self.at + self.limit)}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        self.at = max(self.at, end["rows"])  # a query that is started again says here how far it had come
        files, ends = self._ends()
        out, at = [], start["rows"]
        while at < end["rows"]:
            k = bisect_right(ends, at)
            before = ends[k] - self.counts[files[k]]
            stop = min(end["rows"], ends[k], at + self.share)
            out.append(Rows(files[k], at - before, stop - before))
            at = stop
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with pq.ParquetFile(partition.file) as f:
            first = 0
            for g in range(f.num_row_groups):
                n = f.metadata.row_group(g).num_rows
                low, high = max(partition.start - first, 0), min(partition.stop - first, n)
                if low < high:
                    yield from f.read_row_group(g, columns=self.columns).slice(low, high - low).to_batches()
                first += n

    def commit(self, end: dict) -> None:
        """Offsets are counts of rows, so nothing is kept for batches that are done."""

    def stop(self) -> None:
        """No file stays open between batches."""


class Blocks(DataSource):
    """The source; its schema is that of the first file, or the one given to the reader."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        files = sorted(glob.glob(os.path.join(local_path(self.options["path"]), "*.parquet")))
        if not files:
            raise ValueError(f"no Parquet file in {self.options['path']}")
        return from_arrow_schema(pq.read_schema(files[0]))

    def streamReader(self, schema: StructType) -> BlockReader:
        return BlockReader(schema, dict(json.loads(json.dumps(dict(self.options)))))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Blocks)
