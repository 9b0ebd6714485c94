"""Row-major band arrays: index arithmetic, stencils and resampling, JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_pixels(
    frames: DataFrame, arrays: list[str], keep: list[str], width: str = "width"
) -> DataFrame:
    """Frame rows to pixel rows: one array column becomes one scalar column.

    A projection with a generator: no shuffle, and only the named arrays are read.
    """
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    rows = frames.select(*keep, F.col(width).alias("_w"), F.posexplode(zipped).alias("_p", "_v"))
    return rows.select(
        *keep,
        F.floor(F.col("_p") / F.col("_w")).cast("int").alias("y"),
        (F.col("_p") % F.col("_w")).cast("int").alias("x"),
        *[F.col(f"_v.{a}").alias(a) for a in arrays],
    )


def bind(value: Column, body: callable) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    An expression used inside an array lambda is evaluated again for every
    element; bound as a lambda variable it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(band: Column, index: Column) -> Column:
    """0-based element, NULL outside the array."""
    return F.get(band, index)


def remap(band: Column, size: Column, source: callable) -> Column:
    """New array of ``size`` elements; element i is taken from ``source(i)``."""
    return F.when(
        size > 0,
        F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), lambda i: at(band, source(i))),
    )


def _row(i: Column, width: Column) -> Column:
    return F.floor(i / width).cast("int")


def rotate90(band: Column, height: Column, width: Column, k: Column) -> Column:
    """Counter-clockwise by k quarter turns. The turned frame is W x H for odd k."""

    def source(i: Column, k4: Column) -> Column:
        new_w = F.when(k4 % 2 == 1, height).otherwise(width)
        y, x = _row(i, new_w), (i % new_w).cast("int")
        sy = F.when(k4 == 0, y).when(k4 == 1, x).when(k4 == 2, height - 1 - y).otherwise(height - 1 - x)
        sx = F.when(k4 == 0, x).when(k4 == 1, width - 1 - y).when(k4 == 2, width - 1 - x).otherwise(y)
        return (sy * width + sx).cast("int")

    turned = lambda k4: remap(band, height * width, lambda i: source(i, k4))
    return bind(F.pmod(k, F.lit(4)), turned)


def crop(band: Column, width: Column, y0: Column, x0: Column, shape: tuple[int, int]) -> Column:
    """The ``shape`` window whose corner is (y0, x0)."""
    h, w = shape

    def rows(first: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(h - 1)),
            lambda r: F.slice(band, (first + r * width).cast("int"), F.lit(w)),
        )

    return F.flatten(bind(y0 * width + x0 + 1, rows))


def dilate_cross(mask: Column, height: Column, width: Column) -> Column:
    """Maximum over the pixel and its four edge neighbours."""

    def widest(v: Column, i: Column) -> Column:
        x = i % width
        return F.greatest(
            v,
            F.when(x > 0, at(mask, i - 1)),
            F.when(x < width - 1, at(mask, i + 1)),
            F.when(i >= width, at(mask, (i - width).cast("int"))),
            F.when(i < (height - 1) * width, at(mask, (i + width).cast("int"))),
        )

    return F.transform(mask, widest)


def mean(band: Column) -> Column:
    """Mean of the non-null elements; NULL when there are none."""
    total = F.aggregate(band, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))
    n = F.aggregate(band, F.lit(0), lambda s, v: s + v.isNotNull().cast("int"))
    return F.when(n > 0, total / n)


def share(band: Column, test: callable) -> Column:
    """Fraction of all elements for which ``test`` holds; NULL test counts as false."""
    hits = F.aggregate(
        band, F.lit(0), lambda s, v: s + F.coalesce(test(v), F.lit(False)).cast("int")
    )
    return F.when(F.size(band) > 0, hits / F.size(band))


def resample_bilinear(
    band: Column, height: Column, width: Column, shape: tuple[int, int]
) -> Column:
    """Bilinear with half-pixel centres; edges repeat the border pixel."""
    h, w = shape

    def axis(i: Column, n_in: Column, n_out: int) -> tuple[Column, Column, Column]:
        pos = F.greatest(F.lit(0.0), (i + F.lit(0.5)) * n_in / F.lit(float(n_out)) - F.lit(0.5))
        lo = F.floor(pos).cast("int")
        return lo, F.least(lo + 1, n_in - 1).cast("int"), pos - lo

    def value(i: Column) -> Column:
        y0, y1, fy = axis(_row(i, F.lit(w)), height, h)
        x0, x1, fx = axis((i % w).cast("int"), width, w)
        cell = lambda y, x: at(band, (y * width + x).cast("int")).cast("double")
        top = cell(y0, x0) * (1 - fx) + cell(y0, x1) * fx
        low = cell(y1, x0) * (1 - fx) + cell(y1, x1) * fx
        return top * (1 - fy) + low * fy

    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), value)


def downsample_mean(band: Column, height: Column, width: Column, shape: tuple[int, int]) -> Column:
    """Adaptive block mean: block i spans floor(i*H/h) .. ceil((i+1)*H/h)."""
    h, w = shape

    def bounds(i: Column, n_in: Column, n_out: int) -> tuple[Column, Column]:
        low = F.floor(i * n_in / F.lit(float(n_out))).cast("int")
        return low, F.ceil((i + 1) * n_in / F.lit(float(n_out))).cast("int")

    def value(i: Column) -> Column:
        r0, r1 = bounds(_row(i, F.lit(w)), height, h)
        c0, c1 = bounds((i % w).cast("int"), width, w)
        block = F.flatten(
            F.transform(
                F.sequence(r0, r1 - 1),
                lambda r: F.slice(band, (r * width + c0 + 1).cast("int"), c1 - c0),
            )
        )
        return mean(block)

    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), value)


def gaussian_weights(size: int, sigma: float) -> list[float]:
    """Normalised 1-D Gaussian weights."""
    raw = [math.exp(-((i - size // 2) ** 2) / (2.0 * sigma**2)) for i in range(size)]
    return [r / sum(raw) for r in raw]
