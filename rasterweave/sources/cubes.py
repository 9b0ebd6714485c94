"""Raster cubes in ``.npz`` files to frame rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterweave.functions import calendar

CUBE_KEY = "highresdynamic"


def inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """Cube files with tile and sample, without licence files."""
    named = files.withColumn("tile", calendar.tile_of(F.col(path)))
    return named.where(~F.col(path).rlike(r"(^|/)LICENSE$")).select(
        F.col(path).alias("path"), "tile", calendar.sample_stem(F.col(path)).alias("sample_id")
    )


def tile_inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """Number of cube files per tile."""
    return inventory(files, path).groupBy("tile").agg(F.count(F.lit(1)).alias("n_samples"))


def list_files(spark: SparkSession, path: str, pattern: str = "*.npz") -> DataFrame:
    """Files below ``path``; only their names are read, not their content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path")
    )


def _decode_schema(n_bands: int) -> T.StructType:
    real = T.ArrayType(T.FloatType())
    small = T.ArrayType(T.ByteType())
    return T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("t", T.IntegerType()),
            T.StructField("n_frames", T.IntegerType()),
            T.StructField("height", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            *[T.StructField(f"b{i}", real) for i in range(n_bands)],
            T.StructField("cloud_prob", real),
            T.StructField("class_id", small),
            T.StructField("cloud_mask", small),
        ]
    )


def decode_cubes(files: DataFrame, n_bands: int = 4) -> DataFrame:
    """(path, content) rows to frame rows; files are decoded where they are read.

    Channels: bands, then - with more than ``n_bands`` + 1 channels - cloud
    probability and scene class; the cloud mask is last. NaN becomes NULL.
    """
    schema = _decode_schema(n_bands)

    def rows(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        flat = pa.array(values.ravel(), from_pandas=True).cast(kind, safe=False)
        offsets = np.arange(0, values.size + 1, values.shape[1], dtype="int32")
        return pa.ListArray.from_arrays(offsets, flat)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        real, small = pa.float32(), pa.int8()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content.as_py())) as npz:
                    cube = npz[CUBE_KEY]
                h, w, c, n = cube.shape
                flat = cube.transpose(3, 2, 0, 1).reshape(n, c, h * w).astype("float32")
                same = lambda v: pa.array(np.full(n, v, dtype="int32"))
                columns = {
                    "path": pa.array([path.as_py()] * n),
                    "t": pa.array(np.arange(n, dtype="int32")),
                    "n_frames": same(n),
                    "height": same(h),
                    "width": same(w),
                }
                for b in range(n_bands):
                    columns[f"b{b}"] = rows(flat[:, b], real)
                if c > n_bands + 2:
                    columns["cloud_prob"] = rows(flat[:, n_bands], real)
                    columns["class_id"] = rows(flat[:, n_bands + 1], small)
                else:
                    columns["cloud_prob"] = pa.nulls(n, pa.list_(real))
                    columns["class_id"] = pa.nulls(n, pa.list_(small))
                columns["cloud_mask"] = rows(flat[:, -1], small)
                yield pa.RecordBatch.from_pydict(columns)

    return files.select("path", "content").mapInArrow(decode, schema)


def cube_lengths(files: DataFrame) -> DataFrame:
    """(path, n_frames) from the array headers alone; no pixel is decompressed."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)).open(f"{CUBE_KEY}.npy") as f:
                    version = np.lib.format.read_magic(f)
                    read = np.lib.format.read_array_header_1_0
                    if version != (1, 0):
                        read = np.lib.format.read_array_header_2_0
                    sizes.append(read(f)[0][3])
            yield pd.DataFrame({"path": pdf["path"], "n_frames": sizes})

    return files.select("path", "content").mapInPandas(measure, "path string, n_frames int")


def cubes_to_frames(
    files: DataFrame, split: str = "train", sensor: str = "S2", n_bands: int = 4
) -> DataFrame:
    """Frame table of all cubes; ``target`` cubes continue their ``context`` in time."""
    decoded = decode_cubes(files, n_bands)
    stem = calendar.sample_stem(F.col("path"))
    rows = decoded.withColumns({"sample_id": stem, "tile": F.split(stem, "/")[0]})
    is_target = F.col("path").rlike(r"(^|/)target(_[^/]*|/.*)$")
    if split != "train":
        # Context files are opened once more, for their headers; of their content
        # only (sample, length) is shuffled.
        context = cube_lengths(files.where(~is_target))
        lengths = context.select(stem.alias("sample_id"), F.col("n_frames").alias("_shift"))
        shift = F.when(is_target, F.coalesce("_shift", F.lit(0))).otherwise(0)
        rows = rows.join(lengths, "sample_id", "left").withColumn("t", F.col("t") + shift)
    dates = calendar.frame_dates(F.col("sample_id"))
    return rows.select(
        F.lit(split).alias("split"),
        "tile",
        "sample_id",
        F.lit(sensor).alias("sensor"),
        "t",
        F.get(dates, F.col("t")).alias("acq_date"),
        "height",
        "width",
        *[f"b{i}" for i in range(n_bands)],
        "cloud_prob",
        "class_id",
        "cloud_mask",
    )


def read_npz_cubes(
    spark: SparkSession, path: str, split: str = "train", n_bands: int = 4
) -> DataFrame:
    """All ``.npz`` cubes below ``path`` as frames."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.npz")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return cubes_to_frames(files, split, n_bands=n_bands)
