"""Stored frame tables and sample lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.schema import ReadOptions, frames_schema


#: A name may come again in another split, and in another tile.
SAMPLE_KEYS = ("split", "tile", "sample_id")


def write_frames(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by split and tile, compressed with zstd.

    Rows are written where they lie: a tile may hold a large part of all
    frames, so they are not gathered by tile first.
    """
    (
        frames.write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("split", "tile")
        .parquet(path)
    )


def write_bucketed(frames: DataFrame, table: str, buckets: int, mode: str = "append") -> None:
    """Table bucketed by (sample_id, t), so that per-frame joins need no exchange."""
    (
        frames.write.mode(mode)
        .option("compression", "zstd")
        .bucketBy(buckets, "sample_id", "t")
        .sortBy("sample_id", "t")
        .saveAsTable(table)
    )


def read_frames(
    spark: SparkSession, path: str, options: ReadOptions | None = None, n_bands: int = 4
) -> DataFrame:
    """Frames of one split (or of train and val), reduced to the wanted bands.

    The filter on ``split`` prunes partitions, and only the columns of the
    channel set are read. Bands are renamed ``b0..`` in channel order.
    """
    frames = spark.read.schema(frames_schema(n_bands)).parquet(path)
    if options is None:
        return frames
    wanted = ["train", "val"] if options.mode == "all" else [_stored_split(options)]
    head = ["split", "tile", "sample_id", "sensor", "t", "acq_date", "height", "width"]
    tail = ["cloud_prob", "class_id", "cloud_mask"]
    bands = [F.col(f"b{p}").alias(f"b{i}") for i, p in enumerate(options.band_positions)]
    return frames.where(F.col("split").isin(wanted)).select(*head, *bands, *tail)


def _stored_split(options: ReadOptions) -> str:
    if options.sensor == "four-band" and options.split == "train":
        return options.mode
    return options.split


def list_samples(frames: DataFrame, name_contains: str | None = None, ordered: bool = False) -> DataFrame:
    """Distinct (split, tile, sample_id), sorted if ``ordered``; e.g. name_contains='ROIs' for ROI-named samples only."""
    rows = frames.where(F.col("sample_id").contains(name_contains)) if name_contains else frames
    keys = [c for c in SAMPLE_KEYS if c in frames.columns]
    listed = rows.select(*keys).distinct()
    return listed.orderBy(*keys) if ordered else listed


def union_splits(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several splits, matched by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_valid_samples(samples: DataFrame, path: str) -> None:
    """Store the list of usable samples."""
    samples.write.mode("overwrite").parquet(path)


def keep_listed(frames: DataFrame, samples: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Frames of the samples on a stored list; by split, tile and name as far as both have them."""
    if keys is None:
        keys = [c for c in SAMPLE_KEYS if c in frames.columns and c in samples.columns]
    return frames.join(samples.select(*keys), list(keys), "left_semi")


def pair_sensors(
    optical: DataFrame, radar: DataFrame, keys: Sequence[str] = ("sample_id", "t")
) -> DataFrame:
    """Optical frames with the radar frame of the same key; unpaired frames are dropped."""
    return optical.join(radar, list(keys))
