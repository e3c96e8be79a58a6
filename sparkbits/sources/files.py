"""Files of raw bytes as bit vectors, and tables of packed vectors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder under ``spark.checkpoint.dir``, which driver and executors share; without that setting only a local master has one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/sparkbits-shared"
    return f"{base.rstrip('/')}/{name}"


def read_files(spark: SparkSession, path: str, endian: str = "big") -> DataFrame:
    """(path, bits) of every file; one value a file, so for files that fit a task. Spark's reader passes over empty files."""
    return spark.read.format("binaryFile").load(path).select("path", X.from_bytes("content", endian).alias("bits"))


def first_bytes(content: Column, n: int, strict: bool = True) -> Column:
    """The first n bytes of BINARY; fewer are an error, or taken where not strict. All of it for negative n."""
    if n < 0:
        return content
    part = F.substring(content, 1, n)
    return X.fail(F.length(content) >= n, part, "there are fewer bytes") if strict else part


def write_vectors(df: DataFrame, path: str, bits_col: str = "bits", endian: str = "big", mode: str = "errorifexists") -> None:
    """Parquet with the vector as a packed struct instead of text."""
    df.withColumn(bits_col, W.pack(bits_col, endian)).write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str, bits_col: str = "bits") -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn(bits_col, W.unpack(bits_col))


def write_files(df: DataFrame, folder: str, name_col: str, content_col: str) -> DataFrame:
    """One file of raw bytes for each row, in a folder that all executors reach; (file, bytes) of what was written."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        for batch in batches:
            names, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, blob in zip(names, blobs):
                with system.open_output_stream(f"{path}/{name}", compression=None) as f:
                    f.write(blob or b"")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(b or b"") for b in blobs], pa.int64())], names=["file", "bytes"])

    return df.select(F.col(name_col).cast("string"), content_col).mapInArrow(run, "file string, bytes long")
