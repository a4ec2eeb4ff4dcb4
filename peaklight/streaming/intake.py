"""New measurements as a stream: text files that arrive are parsed and judged batch by batch.

An addition of this engine; batch semantics are those of sources.measurement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peaklight.sources import measurement


def measurements(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """Whole texts of the files that arrive in a folder."""
    return spark.readStream.schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", per_batch).format("text").load(folder).select(F.col("_metadata.file_path").alias("path"), "value")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False):
    """Parse arriving files into Parquet; a batch is written under its number, so a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        measurement.parse(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    query = measurements(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def windowed_levels(stream: DataFrame, time: str = "ts", value: str = "value", width: str = "1 hour", late: str = "2 hours", key: str = "event_type") -> DataFrame:
    """Level and count per key and window of event time; rows later than the watermark drop out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.avg(value).alias("level"), F.count("*").alias("points")).select(F.col("window.start").alias("start"), key, "level", "points")
