"""Cubes to scored frames and a list of usable samples."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.operators.quality import FRAME_KEYS, flag_frames, frame_statistics_arrays
from rasterweave.operators.sequences import valid_samples
from rasterweave.operators.gaps import split_by_tile
from rasterweave.schema import FilterSettings, frames_schema
from rasterweave.sources.cubes import cubes_to_frames, inventory, list_files
from rasterweave.sources.frames import SAMPLE_KEYS, write_frames, write_valid_samples
from rasterweave.sources.settle import settle

# --- fixed values -----------------------------------------------------------
FOUR_BAND_FILTER = FilterSettings("cloud-free", 5, return_valid_obs_only=False)
TWO_SENSOR_FILTER = FilterSettings(
    "cloud-free", 5, max_t_sampling=42, return_valid_obs_only=False
)
VALIDATION_SIZE = 5000
# ----------------------------------------------------------------------------


def score_frames(
    frames: DataFrame, strict: bool = False, with_prob: bool = True, prob_as_fraction: bool = False
) -> DataFrame:
    """``frame_quality`` of a frame table; one narrow projection, no shuffle.

    Training cubes have probabilities (with_prob), test cubes do not; the
    two-sensor set is scored strictly and stores probabilities as fractions.
    """
    if prob_as_fraction:
        frames = frames.withColumn("cloud_prob", F.transform("cloud_prob", lambda v: v * 100.0))
    keep = [c for c in ("split", *FRAME_KEYS) if c in frames.columns]
    stats = frame_statistics_arrays(frames, keep, prob="cloud_prob" if with_prob else None)
    return flag_frames(stats, strict, with_prob)


def usable_samples(quality: DataFrame, two_sensor: bool = False) -> DataFrame:
    """Samples the later steps may use, by split, tile and name as far as the table has them."""
    keys = [c for c in SAMPLE_KEYS if c in quality.columns]
    return valid_samples(quality, TWO_SENSOR_FILTER if two_sensor else FOUR_BAND_FILTER, keys)


def train_val_tiles(names: DataFrame, val_size: int = VALIDATION_SIZE, seed: int = 0) -> DataFrame:
    """(tile, split) from the names of cube files; all samples of a tile are in one split."""
    return split_by_tile(inventory(names), val_size, seed).select("tile", "split")


def store_quality(quality: DataFrame, path: str) -> None:
    """Write a frame-quality table."""
    quality.write.mode("append").option("compression", "zstd").parquet(path)


def unscored(spark: SparkSession, frames: DataFrame, path: str) -> DataFrame:
    """Stored frames without a row in the frame-quality table at ``path``, if there is one."""
    try:
        known = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return frames
    keys = [*SAMPLE_KEYS, "t"]
    return frames.join(known.select(*keys), keys, "left_anti")


def cube_content(spark: SparkSession, source: str) -> DataFrame:
    """(path, content, ...) of the cube files below ``source``."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.npz")
        .option("recursiveFileLookup", "true")
        .load(source)
    )


def ingest_cubes(
    spark: SparkSession, source: str, target: str, split: str, with_prob: bool | None = None
) -> None:
    """Convert the cubes below ``source``: frames, frame_quality and valid_samples tables."""
    ingest_files(spark, cube_content(spark, source), target, split, with_prob)


def ingest_train_val(
    spark: SparkSession, source: str, target: str, val_size: int = VALIDATION_SIZE, seed: int = 0
) -> None:
    """The same for training cubes, tiles divided into the splits 'train' and 'val'.

    The division looks at names only, before any content is read.
    """
    tiles = settle(train_val_tiles(list_files(spark, source), val_size, seed))
    ingest_files(spark, cube_content(spark, source), target, "train", tiles=tiles)


def ingest_files(
    spark: SparkSession,
    files: DataFrame,
    target: str,
    split: str,
    with_prob: bool | None = None,
    tiles: DataFrame | None = None,
) -> None:
    """Cube files (path, content) to the tables below ``target``.

    Cubes are decoded once; quality is scored on the stored frames, whose mask and
    probability columns are all that is read again. Names may come again in another split: every
    table and key has it. ``tiles`` (tile, split) divides the files' tiles into splits; one row a tile,
    small enough for the optimizer to send along.
    """
    frames = cubes_to_frames(files, split)
    splits = [split]
    if tiles is not None:
        frames = frames.drop("split").join(tiles, "tile")
        splits = ["train", "val"]
    write_frames(frames, f"{target}/frames")
    stored = spark.read.schema(frames_schema(4)).parquet(f"{target}/frames")
    prob = split in ("train", "val") if with_prob is None else with_prob
    fresh = unscored(spark, stored.where(F.col("split").isin(splits)), f"{target}/frame_quality")
    store_quality(score_frames(fresh, with_prob=prob), f"{target}/frame_quality")
    quality = spark.read.parquet(f"{target}/frame_quality")
    write_valid_samples(usable_samples(quality), f"{target}/valid_samples")


def score_two_sensor(spark: SparkSession, path: str, n_bands: int = 13) -> None:
    """Score a stored two-sensor frame table strictly, next to its frames."""
    frames = spark.read.schema(frames_schema(n_bands)).parquet(f"{path}/frames")
    fresh = unscored(spark, frames, f"{path}/frame_quality")
    scored = score_frames(fresh, strict=True, prob_as_fraction=True)
    store_quality(scored, f"{path}/frame_quality")
    quality = spark.read.parquet(f"{path}/frame_quality")
    write_valid_samples(usable_samples(quality, two_sensor=True), f"{path}/valid_samples")
