"""What several training-data operators share."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker holds in temporary arrays at once.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a local master takes the system's temp folder; a cluster is refused,
    as its executors would not see each other's files. No setting of the session is changed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + os.path.join(tempfile.gettempdir(), "sparkbits-shared")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Folders of the call that is running, deleted at its end.
_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class scratch:
    """Tables that ``saved`` writes inside the block are deleted at its end; ``result`` stays.

    A block inside another one leaves its tables to the outer one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> scratch:
        self.outer = _SCRATCH.get()
        self.paths: list[str] = []
        self.token = _SCRATCH.set(self.paths)
        return self

    def result(self, df: DataFrame, purpose: str) -> DataFrame:
        """df worked out and written, so that the tables it was made of can go."""
        path = shared_dir(self.spark, purpose)
        out = _written(df, path)
        if self.outer is not None:
            self.outer.append(path)
        return out

    def __exit__(self, *error: object) -> None:
        _SCRATCH.reset(self.token)
        for path in self.paths:
            remove(self.spark, path)
        # what is collected here lets Spark's cleaner delete the shuffles of these tables, and keeps the driver small
        gc.collect()
        released()
        self.spark.sparkContext._jvm.System.gc()


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """df cut off from its lineage: written as Parquet to the shared folder and read again."""
    path = shared_dir(df.sparkSession, purpose)
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    return _written(df, path)


def field(df: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    return T.StructField(alias or name, df.schema[name].dataType, True)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def row_slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows that hold about ``most`` bytes each, one row at least."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


#: Rows and bytes of text that one Arrow batch holds, in the JVM and in the Python worker alike.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def released() -> None:
    """Gives freed memory back, as a worker stays for the next task, and the driver for the next stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of bounded size; larger settings of the session are lowered."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            conf.set(key, str(most))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return df.mapInArrow(kernel, schema)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
