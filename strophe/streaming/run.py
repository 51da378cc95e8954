"""Running a stream to its end: folders that driver and executors share, state in RocksDB, a last row that closes time."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []
#: Later than any row; nothing is open after it.
END_OF_TIME = "9000-01-01 00:00:00"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder stands in for it where the master is local and it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strophe-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/strophe/{tag}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    """Deletes what was written on the way when the driver ends; a driver that is lost leaves it to the folder's owner."""
    for spark, path in _MADE:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended
            return


def as_stream(table: DataFrame, files: int = 1, tag: str = "source", order: str | None = None) -> DataFrame:
    """table as a stream of its rows in files micro-batches: ranges of order, each of as many parts as tasks of a shuffle can
    share, or a file at a time as it is partitioned."""
    spark, path = table.sparkSession, shared_path(table.sparkSession, tag)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // files) if order else 1
    dealt = table.repartitionByRange(files * parts, order).sortWithinPartitions(order) if order else table.coalesce(files)
    dealt.write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", parts).parquet(path)


def closed(stream: DataFrame, at: str, late: str, **values: object) -> DataFrame:
    """stream with a watermark on at, and one more row in its first batch: at the end of time, of values, else null.

    Every window, session and timer of a finite stream that is read in one batch ends by it, and only its own never
    does. values must let it through the filters of the plan, which Spark moves before the watermark. A stream of
    several batches would count all after its first as late, so it gets ``end_row`` as its last file instead.
    """
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, "end")
    end_row(spark, stream, at, **values).write.parquet(path)
    return stream.union(spark.readStream.schema(stream.schema).parquet(path)).withWatermark(at, late)


def end_row(spark: SparkSession, like: DataFrame, at: str, **values: object) -> DataFrame:
    """One row of like's columns at the end of time, of values, else null."""
    given = {**values, at: END_OF_TIME}
    return spark.range(1).select(*[F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in like.schema])


def drained(out: DataFrame, checkpoint: str | None = None, path: str | None = None, mode: str = "append"):
    """Runs out until its sources have nothing more; the rows written so far, and the query."""
    spark = out.sparkSession
    path = path or shared_path(spark, "drained")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        started = out.writeStream.format("parquet").option("checkpointLocation", checkpoint or shared_path(spark, "state")).outputMode(mode).trigger(availableNow=True).start(path)
        started.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(out.schema).parquet(path), started
