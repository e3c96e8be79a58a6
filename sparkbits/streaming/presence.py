"""Presence vectors over event time: which of a few kinds of event a key has had in a window.

The state of a key and window is one BIGINT, and ``bit_or`` gives the same whatever the order and
however often a row comes, so late and repeated rows inside the watermark change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The event types in alphabetical order; the first is the highest bit.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def mark(kind: Column, kinds: Sequence[str] = EVENT_TYPES) -> Column:
    """The kind's bit as BIGINT, 0 for any other kind."""
    value = F.lit(0).cast("long")
    for k, name in enumerate(kinds):
        value = F.when(kind == name, F.lit(1 << (len(kinds) - 1 - k)).cast("long")).otherwise(value)
    return value


def as_bits(word: Column, n: int) -> Column:
    return F.lpad(F.bin(word), n, "0")


def presence(events: DataFrame, key: str = "user_id", kind: str = "event_type", kinds: Sequence[str] = EVENT_TYPES) -> DataFrame:
    """(key, bits) over all events."""
    return events.groupBy(key).agg(as_bits(F.bit_or(mark(F.col(kind), kinds)), len(kinds)).alias("bits"))


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = "10 minutes", key: str = "user_id", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(key, start, bits) by tumbling, or sliding, windows; works on tables and on streams."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    found = rows.groupBy(key, window.alias("w")).agg(F.bit_or(mark(F.col(kind))).alias("word"))
    return found.select(key, F.col("w.start").alias("start"), as_bits(F.col("word"), len(EVENT_TYPES)).alias("bits"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes", key: str = "user_id", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(key, start, stop, bits) by sessions that end after a gap."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    found = rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.bit_or(mark(F.col(kind))).alias("word"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), as_bits(F.col("word"), len(EVENT_TYPES)).alias("bits"))


def event_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of events as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Works off all that is there into an in-memory table of small results, and gives that table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
