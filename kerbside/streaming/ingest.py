"""Descriptions that keep up with a folder: new metadata files are described and appended, each image once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kerbside.operators.merge import not_done
from kerbside.providers import ImageDescriber
from kerbside.sources import files


def metadata_stream(spark: SparkSession, folder: str, schema: str = "image_id string, lat double, lon double, captured_at timestamp, image_path string", watermark: str | None = "1 day") -> DataFrame:
    """New Parquet files of a folder, as they come. Repeated ids are dropped as long as the watermark remembers them."""
    df = spark.readStream.schema(schema).parquet(folder)
    return df.withWatermark("captured_at", watermark).dropDuplicatesWithinWatermark(["image_id"]) if watermark else df


def describe_stream(images: DataFrame, describer: ImageDescriber, output: str, checkpoint: str, available_now: bool = False, path: str = "image_path") -> StreamingQuery:
    """Appends descriptions to Parquet. An image that output has already, from a batch that was repeated, is left out."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["image_id"])
        if files.exists(spark, output):
            new = not_done(new, spark.read.parquet(output))
        described = describer.describe_frame(new, path)
        described.write.mode("append").parquet(output)

    writer = images.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, key, n) by event time, on streams and on tables; what comes later than ``late`` does not count on a stream."""
    from pyspark.sql import functions as F

    w = F.window(F.col(time).cast("timestamp"), window)
    source = events.withColumn(time, F.col(time).cast("timestamp"))
    source = source.withWatermark(time, late) if source.isStreaming else source
    return source.groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "key", "n")
