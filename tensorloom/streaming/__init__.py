"""Live sparse tensors: triplets from a stream, summed by index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def live_compress(triplets: DataFrame, indices: list[str], value: str) -> DataFrame:
    """Streaming counterpart of compress: sums by index, as additive state per cell."""
    return triplets.groupBy(*(F.col(c).cast("long").alias(f"i{k}") for k, c in enumerate(indices))).agg(F.sum(F.col(value).cast("double")).alias("v"))


def windowed_compress(triplets: DataFrame, time: str, width: str, late: str, indices: list[str], value: str) -> DataFrame:
    """A sparse tensor per time window; rows later than the watermark are left out and closed windows leave the state."""
    keyed = triplets.withWatermark(time, late)
    return keyed.groupBy(F.window(time, width).alias("window"), *(F.col(c).cast("long").alias(f"i{k}") for k, c in enumerate(indices))).agg(F.sum(F.col(value).cast("double")).alias("v"))


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
