"""Cells as a stream: windowed profiles with late data, and incremental tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def table_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_profile(events: DataFrame, time: str, by: list[str], value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and mean in event-time windows; rows later than the watermark are left out."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # event time must be a timestamp with a zone
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("window_start"), *by, "n", "mean_value")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark: state is dropped behind it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """A stream into Parquet, each micro-batch once."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def mergeable_profiles(cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Sums and counts for each feature, a part for each micro-batch; ``merged`` reads the profile."""

    def part(batch: DataFrame, epoch: int) -> None:
        sums = batch.groupBy("cohort", "layer", "feature").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
        sums.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")  # a repeated epoch replaces itself

    return cells.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The profile over all parts so far."""
    return spark.read.parquet(path).groupBy("cohort", "layer", "feature").agg((F.sum("total") / F.sum("n")).alias("value"), F.sum("n").alias("n"))
