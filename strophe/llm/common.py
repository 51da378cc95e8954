"""Helpers that the operators of this subpackage share.

Scratch tables live under ``spark.checkpoint.dir``, the folder that driver and executors share; a
local temporary folder is used only where that setting is absent and the master is local, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strophe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{scratch_root(spark)}/strophe/{tag}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path that no live DataFrame reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            discard(spark, path)
        except Exception:  # the context may be gone; the folder's owner cleans up then
            return


#: Spark's own setting: an execution's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder once and returns a reader of it, which cuts the lineage.

    The shuffle files of the write are not needed after it and are deleted at its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def quoted(name: str) -> str:
    """A column's name as a reference, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size, from file sizes; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


_HELD: list = [None, None]


def held(key: object, make: Callable[[], object]):
    """What a worker process keeps from task to task: the last thing asked for, made once. An executor's
    workers go from one operator to the next, and what an earlier one needed is let go."""
    if _HELD[0] != key:
        _HELD[:] = [None, None]
        pa.default_memory_pool().release_unused()
        _HELD[:] = [key, make()]
    return _HELD[1]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def by_place(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Does work on docs with its columns named by their places, whatever signs or repeats the names hold."""
    return work(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])).toDF(*docs.columns)


def place_of(df: DataFrame, name: str) -> int:
    """Which column has this name: exactly, or, if none has, without regard to case, as Spark looks it up."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name}")
    return found[0]


def picked(df: DataFrame, **names: str) -> DataFrame:
    """The columns that names gives, under its keys, whatever other columns are called."""
    placed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return placed.select(*[F.col(f"c{place_of(df, name)}").alias(new) for new, name in names.items()])
