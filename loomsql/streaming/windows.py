"""Windowed aggregation of an event stream. The same plan runs on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType


def window_counts(events: DataFrame, every: str = "1 day", slide: str | None = None, late: str = "2 days", time_col: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, key, n, total) of tumbling or sliding windows.

    On a stream the watermark bounds the state: events more than ``late`` behind the newest one are dropped and windows
    are final once it has passed them. On a table every row counts. Rows without a time are in no window.
    """
    rows = events.filter(F.col(time_col).isNotNull())
    if events.isStreaming:
        rows = rows.withColumn(time_col, F.col(time_col).cast(TimestampType())).withWatermark(time_col, late)
    w = F.window(F.col(time_col), every, slide) if slide else F.window(F.col(time_col), every)
    out = rows.groupBy(w.alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n", "total")


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
