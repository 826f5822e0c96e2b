"""What the operators of this subpackage share: scratch tables, Arrow batches, text columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir

#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000

#: Python stages see at most this many bytes of a task's rows at a time.
BATCH_BYTES = 4 << 20


def own_dir(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share; an error on a cluster that names none."""
    return shared_dir(spark)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this application wrote there. Results that were not yet written elsewhere are gone then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder (in folders by the columns named) and read it back: lineage ends there, and a lost executor loses nothing."""
    path = f"{own_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(ids: DataFrame) -> DataFrame:
    """A small written table, to be broadcast if it has few enough rows: then the large side is not shuffled. Else both are sorted."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge")


def with_fields(df: DataFrame, added: str) -> tuple[list[str], StructType]:
    """The columns of ``df`` that stay beside the added ones (which replace columns of their names), and the schema of both."""
    new = StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in new.names]
    return [f.name for f in kept], StructType([*kept, *new.fields])


def _give_back() -> None:
    """Returns what a worker has freed to the system: it lives on for later stages, beside their memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not this C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, so that a run of very long rows does not fill a worker."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        _give_back()

    return df.mapInArrow(run, schema)
