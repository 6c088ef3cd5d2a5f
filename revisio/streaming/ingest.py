"""Continuous import: records that arrive in a folder, each study once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from revisio.operators.resolve import uid


def new_records(spark: SparkSession, folder: str, schema: StructType, delay: str = "30 days", at: str = "retrieval_date") -> DataFrame:
    """A stream of the first record of each identifier within ``delay``; the watermark bounds the state."""
    s = spark.readStream.schema(schema).parquet(folder)
    seen = F.coalesce(F.try_to_timestamp(F.col(at)), F.to_timestamp(F.lit("1970-01-01")))
    return s.withColumn("uid", uid()).withColumn("seen_at", seen).withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["uid"])


def counted(events: DataFrame, at: str, key: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts of a key in windows of event time; late rows count until the watermark passes."""
    return events.withWatermark(at, delay).groupBy(F.window(at, window), key).agg(F.count("*").alias("n"))


def append_new(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of records as Parquet and ends when all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
