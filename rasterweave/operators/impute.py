"""Filling gaps along time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterweave.operators.scans import BLOCK_ROWS, blocks_of, with_neighbours
from rasterweave.schema import IMPUTE_MODES

PIXEL_KEYS = ("sample_id", "y", "x")


def visibility(
    df: DataFrame,
    mask: str = "mask",
    keys: Sequence[str] = PIXEL_KEYS,
    t: str = "t",
    payload: Sequence[str] = (),
    block_size: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Add ``prev`` and ``next``: the nearest unmasked rows at or around each row."""
    block = None if block_size is None else blocks_of(t, block_size)
    return with_neighbours(df, keys, [t], F.col(mask) == 0, [t, *payload], block=block)


def last_visible(df: DataFrame, t: str = "t", **kw) -> DataFrame:
    """Add ``last_visible`` and ``next_visible``, NULL where there is none."""
    out = visibility(df, t=t, **kw)
    return out.withColumns(
        {"last_visible": F.col(f"prev.{t}"), "next_visible": F.col(f"next.{t}")}
    ).drop("prev", "next")


def _fill(mode: str, v: str, t: str, day: str) -> Column:
    v0, v1 = F.col(f"prev.{v}"), F.col(f"next.{v}")
    if mode == "last":
        return v0
    if mode == "next":
        return v1
    d, d0, d1 = F.col(day), F.col(f"prev.{day}"), F.col(f"next.{day}")
    one_sided = F.when(F.col("next").isNull(), v0).when(F.col("prev").isNull(), v1)
    if mode == "closest":
        return one_sided.when(d - d0 <= d1 - d, v0).otherwise(v1)
    # Two different neighbours on one day leave no slope: take the earlier one.
    flat = (F.col(f"prev.{t}") == F.col(f"next.{t}")) | (d0 == d1)
    return one_sided.when(flat, v0).otherwise(
        v0 + (v1 - v0) * F.try_divide((d - d0).cast("double"), (d1 - d0).cast("double"))
    )


def _source(mode: str, t: str, day: str) -> Column:
    t0, t1 = F.col(f"prev.{t}"), F.col(f"next.{t}")
    if mode == "last":
        return t0
    if mode == "next":
        return t1
    d, d0, d1 = F.col(day), F.col(f"prev.{day}"), F.col(f"next.{day}")
    return (
        F.when(F.col("next").isNull(), t0)
        .when(F.col("prev").isNull(), t1)
        .when(d - d0 <= d1 - d, t0)
        .otherwise(t1)
    )


def impute(
    df: DataFrame,
    values: Sequence[str],
    modes: Sequence[str] = IMPUTE_MODES,
    mask: str = "mask",
    keys: Sequence[str] = PIXEL_KEYS,
    t: str = "t",
    day: str | None = "day",
    block_size: int | None = BLOCK_ROWS,
    return_source: bool = False,
) -> DataFrame:
    """Add ``<value>_<mode>`` for every value and mode; all modes share one shuffle.

    ``day`` (whole days) is needed for 'closest' and 'linear'. With
    ``return_source`` the index of the row a value was taken from is added as
    ``source_<mode>`` (for 'linear': ``source_linear_prev`` / ``_next``).
    A task scans ``block_size`` steps of a key, or whole keys if it is None.
    """
    unknown = [m for m in modes if m not in IMPUTE_MODES]
    if unknown:
        raise ValueError(f"unknown imputation modes {unknown}; choose from {IMPUTE_MODES}")
    if day is None and {"closest", "linear"} & set(modes):
        raise ValueError("'closest' and 'linear' need the day of each row")
    payload = [*([day] if day else []), *values]
    out = visibility(df, mask, keys, t, payload, block_size)
    added = {f"{v}_{m}": _fill(m, v, t, day) for m in modes for v in values}
    if return_source:
        for m in modes:
            if m == "linear":
                added["source_linear_prev"] = F.col(f"prev.{t}")
                added["source_linear_next"] = F.col(f"next.{t}")
            else:
                added[f"source_{m}"] = _source(m, t, day)
    return out.withColumns(added).drop("prev", "next")


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """An array column of equal lengths as (rows, length) doubles; NULL becomes NaN."""
    flat = table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1).astype("float64")


def _lists(values: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype="int32")
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), from_pandas=True))


class SeriesFill:
    """Fills of one block of pixels over its frames (rows in time order)."""

    def __init__(self, hidden: np.ndarray, days: np.ndarray) -> None:
        n = len(hidden)
        step = np.arange(n)[:, None]
        prev = np.maximum.accumulate(np.where(hidden, -1, step), axis=0)
        later = np.minimum.accumulate(np.where(hidden, n, step)[::-1], axis=0)[::-1]
        self.has0, self.has1 = prev >= 0, later < n
        self.i0, self.i1 = np.maximum(prev, 0), np.minimum(later, n - 1)
        since, until = days[:, None] - days[self.i0], days[self.i1] - days[:, None]
        span = since + until
        self.sloped = self.has0 & self.has1 & (span != 0)
        self.weight = np.divide(since, span, out=np.zeros(span.shape), where=self.sloped)
        self.take0 = self.has0 & (~self.has1 | (since <= until))

    def __call__(self, modes: Sequence[str], cube: np.ndarray) -> list[np.ndarray]:
        """The filled cube for each mode; the two look-ups are shared by all of them."""
        before = np.where(self.has0, np.take_along_axis(cube, self.i0, 0), np.nan)
        after = np.where(self.has1, np.take_along_axis(cube, self.i1, 0), np.nan)
        made = {
            "last": lambda: before,
            "next": lambda: after,
            "closest": lambda: np.where(self.take0, before, after),
            "linear": lambda: np.where(
                self.sloped,
                before + (after - before) * self.weight,
                np.where(self.has0, before, after),
            ),
        }
        return [made[m]() for m in modes]


def split_blocks(
    frames: DataFrame, arrays: Sequence[str], keep: Sequence[str], block_pixels: int
) -> DataFrame:
    """Cut each frame's arrays into runs of ``block_pixels`` pixels (column ``block``)."""
    last = F.ceil(F.size(F.col(arrays[0])) / F.lit(block_pixels)) - 1
    rows = frames.select(
        *keep, *arrays, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block")
    )
    start = (F.col("block") * block_pixels + 1).cast("int")
    return rows.select(
        *keep, "block", *[F.slice(F.col(a), start, F.lit(block_pixels)).alias(a) for a in arrays]
    )


def impute_frames(
    frames: DataFrame,
    values: Sequence[str],
    modes: Sequence[str] = IMPUTE_MODES,
    mask: str = "mask",
    sample: str = "sample_id",
    t: str = "t",
    day: str = "day",
    extra: Sequence[str] = (),
    block_pixels: int = 2048,
) -> DataFrame:
    """Same fills on band arrays: rows (sample, t, block) with arrays of pixels.

    The shuffle key is (sample, pixel block) and rows stay arrays, so the bytes
    moved are those of the bands and a large sample is spread over many tasks.
    A task holds T x block_pixels values. A value never seen, and a NULL pixel, is NULL.
    ``extra`` array columns (the target, say) travel along unchanged.
    """
    arrays = [*values, mask, *extra]
    blocks = split_blocks(frames, arrays, [sample, t, day], block_pixels)
    added = [
        T.StructField(f"{v}_{m}", T.ArrayType(T.DoubleType())) for v in values for m in modes
    ]

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by(t)
        series = SeriesFill(matrix(table, mask) == 1, table[day].to_numpy().astype("float64"))
        for v in values:
            for m, values_of in zip(modes, series(modes, matrix(table, v))):
                table = table.append_column(f"{v}_{m}", _lists(values_of))
        return table

    schema = T.StructType([*blocks.schema.fields, *added])
    return blocks.groupBy(sample, "block").applyInArrow(fill, schema)
