"""Streaming operators, run over the tables as a file stream until it is exhausted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.catalog import register
from rasterweave.catalog.frames import _PROB, _QUALITY_OUT, _quality_columns
from rasterweave.catalog.sql import query
from rasterweave.sources.driver_tables import frames_of, table
from rasterweave.sources.settle import shared_folder
from rasterweave.streaming.feed import fill_arriving, flag_arriving, latest, metric_means, upsert_into


#: Files of one micro-batch at most.
FILES_PER_BATCH = 16


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
    return reader.parquet(f"{sf_dir}/{name}*.parquet")


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input into Parquet files and read them back.

    In complete mode each micro-batch replaces the table of the one before.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/out")
    else:
        writer = writer.foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")
        )
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@register("stream_flag_frames", query("fr", _QUALITY_OUT.format(block="fr", prob=_PROB)))
def stream_flag_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = frames_of(arriving(spark, sf_dir, "embeddings"))
    return _quality_columns(drain(spark, flag_arriving(frames)))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arriving(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_id"),
        # Watermarks need an instant, not a local time.
        F.col("ts").cast("timestamp").alias("seen_at"),
        "event_id",
        "event_type",
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("mask"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("v"),
    )


@register(
    "stream_impute_last",
    query(
        "obs",
        """SELECT sample_id, event_id, round(last_value(CASE WHEN mask = 0 THEN v END IGNORE NULLS) OVER (
  PARTITION BY sample_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS filled FROM obs""",
    ),
)
def stream_impute_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drain(spark, fill_arriving(_events(spark, sf_dir), "seen_at", ["sample_id"]))
    return out.select("sample_id", "event_id", F.round("filled", 6).alias("filled"))


@register(
    "stream_metric_means",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type,
  round(avg(least(1.0::DOUBLE, value / 500)), 6) AS mean, CAST(count(*) AS DOUBLE) AS weight
FROM events GROUP BY date_trunc('hour', ts), event_type""",
)
def stream_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means per event type, as they stand at the end: windows still open are there too."""
    means = metric_means(_events(spark, sf_dir), "seen_at", ["event_type"], "v")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = upsert_into(means, f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    out = latest(spark, f"{folder}/out", means.schema, ["window", "event_type"])
    hour = F.date_format(F.col("window.start").cast("timestamp_ntz"), "yyyy-MM-dd HH")
    return out.select(hour.alias("hour"), "event_type", F.round("mean", 6).alias("mean"), "weight")


@register(
    "stream_running_means",
    """SELECT event_type, round(sum(least(1.0::DOUBLE, value / 500) * (1 + event_id % 3)) / sum(1 + event_id % 3), 6) AS mean,
  CAST(sum(1 + event_id % 3) AS DOUBLE) AS weight FROM events GROUP BY event_type""",
)
def stream_running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means since the start of the stream."""
    rows = _events(spark, sf_dir).withColumn("n", 1 + F.col("event_id") % 3)
    means = metric_means(rows, "seen_at", ["event_type"], "v", "n", window=None)
    out = drain(spark, means, "complete")
    return out.select("event_type", F.round("mean", 6).alias("mean"), "weight")
