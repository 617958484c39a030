"""Appending event files as they arrive: the same reshaping, as a stream into the layout by asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_events(spark: SparkSession, folder: str, schema: StructType, late: str = "30 days") -> DataFrame:
    """New Parquet files of events, each event once as long as it is not later than ``late``."""
    rows = spark.readStream.schema(schema).parquet(folder)
    stamped = rows.withColumn("event_date", F.col("event_date").cast("timestamp")).withWatermark("event_date", late)
    return stamped.dropDuplicatesWithinWatermark(["Segment_ID", "event_type", "event_date", "slot_idx"])


def append_by_asset(events: DataFrame, path: str, checkpoint: str, buckets: int = 512) -> StreamingQuery:
    """Writes the stream into bucket folders by asset; stops when all present files are read."""
    bucket = F.pmod(F.xxhash64("Segment_ID"), F.lit(buckets)).cast("int")
    return (
        events.withColumn("bucket", bucket).writeStream.format("parquet").partitionBy("bucket")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
