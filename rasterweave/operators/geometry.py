"""Crop, turn, mirror and resample whole samples; all frame-local projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions import grids
from rasterweave.functions.hashing import draw_int, hash_hex, uniform
from rasterweave.schema import CropSettings


def _resized(frames: DataFrame, height: Column, width: Column) -> DataFrame:
    # In its own projection: next to the arrays, "width" inside their lambda
    # expressions would be taken for the new column.
    return frames.withColumns({"height": height, "width": width})


def crop_frames(
    frames: DataFrame,
    arrays: Sequence[str],
    settings: CropSettings,
    seed: int = 0,
    sample: str = "sample_id",
) -> DataFrame:
    """The same window for all frames of a sample; centred or drawn from its key."""
    h, w = settings.shape
    free_y, free_x = F.col("height") - h, F.col("width") - w
    if settings.type == "center":
        y0, x0 = F.rint(free_y / 2.0).cast("int"), F.rint(free_x / 2.0).cast("int")
    else:
        y0 = draw_int(hash_hex(seed, "crop_y", sample), free_y + 1)
        x0 = draw_int(hash_hex(seed, "crop_x", sample), free_x + 1)
    cropped = {a: grids.crop(F.col(a), F.col("width"), y0, x0, (h, w)) for a in arrays}
    return _resized(frames.withColumns(cropped), F.lit(h), F.lit(w))


def rotate_frames(
    frames: DataFrame,
    arrays: Sequence[str],
    k: int | None = None,
    seed: int = 0,
    sample: str = "sample_id",
) -> DataFrame:
    """Counter-clockwise quarter turns, ``k`` given or drawn per sample."""
    turns = F.lit(k) if k is not None else draw_int(hash_hex(seed, "rotate", sample), F.lit(4))
    odd = turns % 2 == 1
    h, w = F.col("height"), F.col("width")
    turned = {a: grids.rotate90(F.col(a), h, w, turns) for a in arrays}
    return _resized(
        frames.withColumns(turned), F.when(odd, w).otherwise(h), F.when(odd, h).otherwise(w)
    )


def _flip(
    frames: DataFrame, arrays: Sequence[str], chosen: Column, source: callable
) -> DataFrame:
    size = F.col("height") * F.col("width")
    return frames.withColumns(
        {
            a: F.when(chosen, grids.remap(F.col(a), size, source)).otherwise(F.col(a))
            for a in arrays
        }
    )


def flip_horizontal(
    frames: DataFrame, arrays: Sequence[str], p: float = 0.5, seed: int = 0, sample="sample_id"
) -> DataFrame:
    """Mirror x for a share ``p`` of the samples."""
    chosen = uniform(hash_hex(seed, "flip_h", sample)) < p
    w = F.col("width")
    return _flip(frames, arrays, chosen, lambda i: (i - i % w + (w - 1 - i % w)).cast("int"))


def flip_vertical(
    frames: DataFrame, arrays: Sequence[str], p: float = 0.5, seed: int = 0, sample="sample_id"
) -> DataFrame:
    """Mirror y for a share ``p`` of the samples."""
    chosen = uniform(hash_hex(seed, "flip_v", sample)) < p
    h, w = F.col("height"), F.col("width")
    return _flip(
        frames, arrays, chosen, lambda i: ((h - 1) * w - (i - i % w) + i % w).cast("int")
    )


def augment(frames: DataFrame, arrays: Sequence[str], seed: int = 0) -> DataFrame:
    """Random turn, then vertical and horizontal mirror, drawn per sample."""
    turned = rotate_frames(frames, arrays, None, seed)
    return flip_horizontal(flip_vertical(turned, arrays, 0.5, seed), arrays, 0.5, seed)


def dilate(
    frames: DataFrame, mask: str, iterations: int = 1, out: str | None = None
) -> DataFrame:
    """Grow a mask by its edge neighbours ``iterations`` times."""
    name = out or mask
    for i in range(iterations):
        source = F.col(mask if i == 0 else name)
        frames = frames.withColumn(
            name, grids.dilate_cross(source, F.col("height"), F.col("width"))
        )
    return frames


def resample(
    frames: DataFrame, arrays: Sequence[str], shape: tuple[int, int], method: str = "bilinear"
) -> DataFrame:
    """Resample to ``shape``: 'bilinear', or 'mean' over adaptive blocks."""
    kernel = {"bilinear": grids.resample_bilinear, "mean": grids.downsample_mean}[method]
    h, w = F.col("height"), F.col("width")
    changed = {a: kernel(F.col(a), h, w, shape) for a in arrays}
    return _resized(frames.withColumns(changed), F.lit(shape[0]), F.lit(shape[1]))
