"""Counts of (cell, gene) pairs over event time, and a matrix that batches of new values add to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(stream: DataFrame, cell: str, gene: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, cell_id, gene, value): counts in tumbling windows; rows later than the watermark go, so state stays bounded."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    w = stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(cell).alias("cell_id"), F.col(gene).alias("gene"))
    return w.agg(F.count("*").cast("double").alias("value")).select(F.col("window.start").alias("start"), "cell_id", "gene", "value")


def write_deltas(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows as Parquet, each once; a matrix is their sum by cell and gene."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matrix_of(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("cell_id", "gene").agg(F.sum("value").alias("value"))
