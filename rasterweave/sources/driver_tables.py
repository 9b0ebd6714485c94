"""Series, frames and pixels derived from the driver's tables (FIXTURES.md B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions.grids import explode_pixels
from rasterweave.operators.scans import number_rows

SIDE = 4
N_PIXELS = SIDE * SIDE
BANDS = ["b0", "b1", "b2", "b3"]
FRAME_COLUMNS = ["sample_id", "tile", "t", "acq_date"]


# Read with their schema, so that no job is spent on inferring it.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gappy univariate series per user: (sample_id, t, acq_date, day, mask, v, event_id).

    Rows are numbered in two levels, by day and within the day, so that a user with
    very many events does not end up in one task.
    """
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_id"), "ts", "event_id", "event_type", "value"
    )
    day = F.unix_date(F.to_date("ts")).cast("bigint")
    numbered = number_rows(events, ["sample_id"], ["ts", "event_id"], "t", block=day)
    return numbered.select(
        "sample_id",
        "t",
        F.to_date("ts").alias("acq_date"),
        day.alias("day"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("mask"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("v"),
        "event_id",
    )


def _part(start: int, value: str) -> str:
    """One frame's pixels from the vector, by an expression of ``v``."""
    return f"transform(transform(slice(embedding, {start + 1}, {N_PIXELS}), f -> double(f)), v -> {value})"


def scene_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as one frame of 4 bands x 4 x 4 pixels; 10 frames make a sequence."""
    return frames_of(table(spark, sf_dir, "embeddings"))


def frames_of(embeddings: DataFrame) -> DataFrame:
    """The frame view of embedding rows, batch or streaming."""
    rows = embeddings.selectExpr(
        "*", "vec_id div 10 AS sample_id", "vec_id % 10 AS t",
        "CASE WHEN label IN (0, 1, 2) THEN 0.08D ELSE 0.35D END AS limit",
    )
    late = "IF(sample_id % 3 = 0 AND t >= 5, 45, 0)"
    clipped = "greatest(0.0D, least(1.0D, v + 0.5D))"
    return rows.selectExpr(
        "sample_id",
        "sample_id % 5 AS tile",
        "t",
        f"date_add(DATE '2018-01-01', int(5 * t + (7 * vec_id) % 4 + {late})) AS acq_date",
        f"{SIDE} AS height",
        f"{SIDE} AS width",
        *[
            f"{_part(N_PIXELS * i, f'IF(label <> 9, {clipped}, NULL)')} AS {b}"
            for i, b in enumerate(BANDS)
        ],
        f"{_part(48, 'least(100.0D, abs(v) * 200D)')} AS cloud_prob",
        f"{_part(48, 'tinyint(abs(v) > limit)')} AS cloud_mask",
    )


def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as pixel rows."""
    return explode_pixels(
        scene_frames(spark, sf_dir), [*BANDS, "cloud_prob", "cloud_mask"], FRAME_COLUMNS
    )


def radar_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second sensor: vv and vh in dB, missing for every fourth sequence."""
    return table(spark, sf_dir, "embeddings").where("(vec_id div 10) % 4 <> 0").selectExpr(
        "vec_id div 10 AS sample_id",
        "vec_id % 10 AS t",
        f"{_part(0, 'abs(v) * -50D')} AS vv",
        f"{_part(16, 'abs(v) * -50D')} AS vh",
    )
