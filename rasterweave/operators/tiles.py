"""Frames cut into tiles that carry a halo, so that stencils need no neighbour tile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_tiles(
    frames: DataFrame,
    arrays: Sequence[str],
    keep: Sequence[str],
    side: int,
    halo: int = 0,
    height: str = "height",
    width: str = "width",
) -> DataFrame:
    """Tiles of ``side`` x ``side`` pixels, each with up to ``halo`` pixels around it.

    Adds ``tile_y`` and ``tile_x`` (numbers of the tile), ``top`` and ``left`` (rows and
    columns of halo before the tile's own pixels; less at the frame's border), ``own_h`` and
    ``own_w`` (its own pixels) and ``full_w`` (the width of what the arrays hold).
    A projection with generators: nothing is shuffled.
    """
    if side < 1 or halo < 0:
        raise ValueError("side must be positive and halo not negative")
    h, w = F.col(height).cast("int"), F.col(width).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), F.ceil(n / side).cast("int") - 1)
    rows = frames.where((h > 0) & (w > 0)).select(
        *keep, *arrays, h.alias("_h"), w.alias("_w"), F.explode(numbers(h)).alias("tile_y")
    )
    rows = rows.select("*", F.explode(numbers(F.col("_w"))).alias("tile_x"))

    def bounds(n: str, size: str):
        first = F.col(n) * side
        return F.greatest(first - halo, F.lit(0)), first, F.least(first + side, F.col(size)), F.least(first + side + halo, F.col(size))

    ya, y0, y1, yb = bounds("tile_y", "_h")
    xa, x0, x1, xb = bounds("tile_x", "_w")
    cut = lambda a: F.flatten(
        F.transform(F.sequence(ya, yb - 1), lambda y: F.slice(F.col(a), y * F.col("_w") + xa + 1, xb - xa))
    )
    return rows.select(
        *keep,
        "tile_y",
        "tile_x",
        (y0 - ya).alias("top"),
        (x0 - xa).alias("left"),
        (y1 - y0).alias("own_h"),
        (x1 - x0).alias("own_w"),
        (xb - xa).alias("full_w"),
        *[cut(a).alias(a) for a in arrays],
    )
