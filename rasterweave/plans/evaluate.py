"""Impute simulated gaps in every mode and score the result per mode."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions.grids import explode_pixels, mean
from rasterweave.operators.impute import SeriesFill, impute, matrix, split_blocks
from rasterweave.operators.metrics import (
    SSIM_WINDOW,
    STRATA,
    SUMS,
    BlockSums,
    dissimilarity,
    mean_over_samples,
    metrics_of_sums,
    sample_metrics,
    to_long,
)
from rasterweave.operators.tiles import split_tiles
from rasterweave.operators.windows import plan_windows, score_windows, stitch_windows
from rasterweave.schema import IMPUTE_MODES
from rasterweave.sources.settle import settle


def _by_mode(filled: DataFrame, bands: Sequence[str], modes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per input row and mode, with prediction columns ``p_<band>``."""
    options = [
        F.struct(F.lit(m).alias("method"), *[F.col(f"{b}_{m}").alias(f"p_{b}") for b in bands])
        for m in modes
    ]
    return filled.select(*keep, F.explode(F.array(*options)).alias("_m")).select(*keep, "_m.*")


def impute_pixels(
    masked: DataFrame, bands: Sequence[str], modes: Sequence[str] = IMPUTE_MODES
) -> DataFrame:
    """Filled pixel rows ``<band>_<mode>`` of masked frames.

    A masked value is never read by a fill, so the target bands serve as input:
    prediction and target come out side by side and no join follows.
    """
    keep = ["sample_id", "t", "acq_date"]
    pixels = explode_pixels(masked, [*bands, "mask", "cloud_mask"], keep)
    dated = pixels.withColumn("day", F.unix_date("acq_date")).drop("acq_date")
    return impute(dated, bands, modes, block_size=None)


def score_modes(
    masked: DataFrame,
    bands: Sequence[str],
    modes: Sequence[str] = IMPUTE_MODES,
    masked_metrics: bool = True,
    sam_unit: str = "deg",
) -> DataFrame:
    """Metrics per method and sample: one shuffle of pixels, then one of sums."""
    filled = impute_pixels(masked, bands, modes)
    keep = ["sample_id", "mask", "cloud_mask", *bands]
    rows = _by_mode(filled, bands, modes, keep)
    return sample_metrics(
        rows,
        [f"p_{b}" for b in bands],
        list(bands),
        ["method", "sample_id"],
        cloud="cloud_mask" if masked_metrics else None,
        sam_unit=sam_unit,
    )


def score_modes_arrays(
    masked: DataFrame,
    bands: Sequence[str],
    modes: Sequence[str] = IMPUTE_MODES,
    masked_metrics: bool = True,
    sam_unit: str = "deg",
    block_pixels: int = 2048,
) -> DataFrame:
    """The same metrics with arrays in the shuffle, for large frames.

    Blocks of pixels are shuffled by (sample, block) as arrays and reduced to a few
    sums per method in place, so neither pixel rows nor predictions are made.
    """
    blocks = split_blocks(
        masked.withColumn("day", F.unix_date("acq_date")),
        [*bands, "mask", "cloud_mask"],
        ["sample_id", "t", "day"],
        block_pixels,
    )
    names = [f"{name}_{s}" for s in STRATA for name in SUMS]

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        mask = matrix(table, "mask")
        use = matrix(table, "cloud_mask") == 0 if masked_metrics else np.ones(mask.shape, bool)
        fill = SeriesFill(mask == 1, table["day"].to_numpy().astype("float64"))
        target = [matrix(table, b) for b in bands]
        reduce = BlockSums(target, mask, use, sam_unit)
        by_mode = zip(*[fill(modes, y) for y in target])
        sums = [reduce(pred) for pred in by_mode]
        columns = {
            "method": pa.array(list(modes)),
            "sample_id": table["sample_id"].slice(0, 1).combine_chunks().take(pa.array([0] * len(modes))),
        }
        return pa.table({**columns, **{n: [float(s[n]) for s in sums] for n in names}})

    kind = blocks.schema["sample_id"].dataType.simpleString()
    schema = f"method string, sample_id {kind}, " + ", ".join(f"`{n}` double" for n in names)
    parts = blocks.groupBy("sample_id", "block").applyInArrow(score, schema)
    keys = ["method", "sample_id"]
    sums = parts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    return metrics_of_sums(sums, keys)


_STRUCTURE = ("_dssim", "_ndssim", "_gap")


class TileScore:
    """Sums behind all metrics of one tile's own pixels, by frame; a halo serves the SSIM window only."""

    def __init__(
        self, mask: np.ndarray, target: Sequence[np.ndarray], hidden: np.ndarray | None, full_w: int,
        own: tuple[slice, slice] = (slice(None), slice(None)), sam_unit: str = "deg", ssim: bool = True,
    ) -> None:
        self.frames, self.shape, self.own = len(mask), (len(mask), -1, full_w), (slice(None), *own)
        self.target, self.ssim = target, ssim
        inner_mask = self._inner(mask)
        use = np.ones(inner_mask.shape, bool) if hidden is None else self._inner(hidden) == 0
        inner = [self._inner(y) for y in target]
        self.sums = [BlockSums([y[i : i + 1] for y in inner], inner_mask[i : i + 1], use[i : i + 1], sam_unit) for i in range(self.frames)]
        self.gap = (inner_mask == 1).any(axis=1)

    def _inner(self, cube: np.ndarray) -> np.ndarray:
        return cube.reshape(self.shape)[self.own].reshape(self.frames, -1)

    def __call__(self, pred: Sequence[np.ndarray]) -> list[dict[str, float]]:
        """One row of sums for each frame."""
        inner = [self._inner(p) for p in pred]
        out = [s([p[i : i + 1] for p in inner]) for i, s in enumerate(self.sums)]
        total, n = np.zeros(self.frames), np.zeros(self.frames)
        if self.ssim:
            for p, y in zip(pred, self.target):
                d = self._inner(dissimilarity(p.reshape(self.shape), y.reshape(self.shape)))
                total += np.nansum(d, axis=1)
                n += (~np.isnan(d)).sum(axis=1)
        for row, *values in zip(out, total, n, self.gap):
            row.update(zip(_STRUCTURE, map(float, values)))
        return out


_SUM_NAMES = [*[f"{name}_{s}" for s in STRATA for name in SUMS], *_STRUCTURE]


def frame_sums(
    frames: DataFrame,
    pred: Sequence[str],
    target: Sequence[str],
    keys: Sequence[str] = ("sample_id",),
    cloud: str | None = None,
    sam_unit: str = "deg",
    ssim: bool = True,
) -> DataFrame:
    """Sums per frame (keys, t) of predictions that lie beside their targets; no shuffle, no pixel rows.

    ``cloud`` drops target pixels hidden in reality from all sums but those of SSIM.
    """
    keys = [*keys, "t"]
    held = list(dict.fromkeys([*pred, *target, "mask", *([cloud] if cloud else [])]))
    rows = frames.select(*keys, "width", *held)

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                hidden = matrix(one, cloud) if cloud else None
                tile = TileScore(
                    matrix(one, "mask"), [matrix(one, y) for y in target], hidden, one["width"][0].as_py(), sam_unit=sam_unit, ssim=ssim
                )
                row = tile([matrix(one, p) for p in pred])[0]
                columns = [*[one[k].combine_chunks() for k in keys], *[pa.array([row[c]]) for c in _SUM_NAMES]]
                yield pa.RecordBatch.from_arrays(columns, [*keys, *_SUM_NAMES])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(score, f"{kinds}, " + ", ".join(f"`{n}` double" for n in _SUM_NAMES))


def loss_terms_of_sums(parts: DataFrame, clear: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """The L1 terms and the SSIM term per key, from ``frame_sums`` over all pixels and over those visible in reality."""
    keys = list(keys)

    def per_value(s: str) -> Column:
        return F.try_divide(F.sum(f"_ae_{s}"), F.sum(f"_n_{s}"))

    terms = parts.groupBy(*keys).agg(
        per_value("all").alias("l1_loss"),
        per_value("occluded").alias("l1_loss_occluded_input_pixels"),
        per_value("observed").alias("l1_loss_observed_input_pixels"),
        F.avg(F.try_divide("_dssim", "_ndssim")).alias("ssim_loss"),
    )
    return terms.join(clear.groupBy(*keys).agg(per_value("all").alias("masked_l1_loss")), keys)


def metrics_of_tiles(parts: DataFrame, keys: Sequence[str], ssim: bool = True) -> DataFrame:
    """Metrics per key from the sums of tiles and frames, rows (keys, t, sums).

    Frames are put together first, as SSIM is a mean of frames; both steps combine map-side and
    move only sums.
    """
    keys = list(keys)
    names = [f"{name}_{s}" for s in STRATA for name in SUMS]
    total = [F.sum(n).alias(n) for n in names]
    frames = parts.groupBy(*keys, "t").agg(
        *total, F.try_divide(F.sum("_dssim"), F.sum("_ndssim")).alias("_d"), F.max("_gap").alias("_gap")
    )
    structure = lambda v: F.lit(1.0) - F.lit(2.0) * F.avg(v)
    gappy = F.col("_gap") == 1
    sums = frames.groupBy(*keys).agg(
        *total,
        structure(F.col("_d")).alias("ssim_all"),
        structure(F.when(gappy, F.col("_d"))).alias("ssim_occluded"),
        structure(F.when(~gappy, F.col("_d"))).alias("ssim_observed"),
    )
    out = metrics_of_sums(sums, [*keys, *([f"ssim_{s}" for s in STRATA] if ssim else [])])
    return out.select(*keys, *[c for c in out.columns if c not in keys])


def score_modes_tiles(
    masked: DataFrame,
    bands: Sequence[str],
    modes: Sequence[str] = IMPUTE_MODES,
    masked_metrics: bool = True,
    sam_unit: str = "deg",
    side: int = 64,
    ssim: bool = True,
) -> DataFrame:
    """All metrics per method and sample, SSIM of the filled frames included, after one shuffle of tiles.

    Tiles carry the pixels that the SSIM window reaches beyond them, so fill, sums
    and stencil run in one pass over (sample, tile); neither filled frames nor pixel rows are
    made. A task holds a tile's frames: T x (side + 4)^2 values a band.
    """
    halo = SSIM_WINDOW // 2 if ssim else 0
    tiles = split_tiles(
        masked.withColumn("day", F.unix_date("acq_date")),
        [*bands, "mask", "cloud_mask"],
        ["sample_id", "t", "day"],
        side,
        halo,
    )
    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        one = {c: table[c][0].as_py() for c in ("top", "left", "own_h", "own_w", "full_w")}
        own = (slice(one["top"], one["top"] + one["own_h"]), slice(one["left"], one["left"] + one["own_w"]))
        mask, target = matrix(table, "mask"), [matrix(table, b) for b in bands]
        tile = TileScore(mask, target, matrix(table, "cloud_mask") if masked_metrics else None, one["full_w"], own, sam_unit, ssim)
        fill = SeriesFill(mask == 1, table["day"].to_numpy().astype("float64"))
        rows = [row for pred in zip(*[fill(modes, y) for y in target]) for row in tile(pred)]
        n = table.num_rows
        return pa.table({
            "method": pa.array(np.repeat(list(modes), n)),
            "sample_id": pa.chunked_array([table["sample_id"].combine_chunks()] * len(modes)),
            "t": pa.chunked_array([table["t"].combine_chunks()] * len(modes)),
            **{c: [row[c] for row in rows] for c in _SUM_NAMES},
        })

    kinds = {c: tiles.schema[c].dataType.simpleString() for c in ("sample_id", "t")}
    schema = f"method string, sample_id {kinds['sample_id']}, t {kinds['t']}, " + ", ".join(f"`{n}` double" for n in _SUM_NAMES)
    parts = tiles.groupBy("sample_id", "tile_y", "tile_x").applyInArrow(score, schema)
    return metrics_of_tiles(parts, ["method", "sample_id"], ssim)


def summarize(per_sample: DataFrame, prefix: str = "masked_", empty: str = "skip") -> DataFrame:
    """Unweighted mean over sequences per method, metric and stratum."""
    long = to_long(per_sample, ["method", "sample_id"], prefix, skip_missing=empty == "skip")
    return mean_over_samples(long, ["method", "metric", "stratum"], empty=empty)


def score_predictor(
    frames: DataFrame,
    bands: Sequence[str],
    predict: Callable[[pd.DataFrame], pd.DataFrame],
    window: int,
    sample: str = "sample_id",
    t: str = "pos",
    masked_metrics: bool = True,
    sam_unit: str = "deg",
    ssim: bool = True,
) -> DataFrame:
    """Metrics per sequence of a user's predictor, from window plan to score.

    ``frames`` are the rows of a simulation: ``<band>_in`` is what the predictor sees, the bands
    are the targets, ``t`` counts the frames of a sequence from 0. ``predict`` gets the input columns and
    ``mask`` of one window in order of ``t`` and returns (sample, k, t, p_<band>). Windows are planned on the
    share of hidden pixels, the predictor runs once for each, its results are stored, stitched
    and held against the targets frame by frame.
    """
    kind = frames.schema[sample].dataType.simpleString()
    rows = frames.withColumn("t", F.col(t).cast("bigint"))
    plan = settle(plan_windows(rows.select(sample, "t", mean(F.col("mask")).alias("coverage")), window, sample))
    inputs = rows.select(sample, "t", "height", "width", "mask", *[f"{b}_in" for b in bands])
    schema = f"{sample} {kind}, k bigint, t bigint, " + ", ".join(f"p_{b} array<double>" for b in bands)
    scored = settle(score_windows(inputs, plan, predict, schema, sample))
    preds = [f"p_{b}" for b in bands]
    stitched = stitch_windows(scored, plan, preds, sample)
    beside = rows.select(sample, "t", "width", "mask", "cloud_mask", *bands).join(stitched, [sample, "t"])
    parts = frame_sums(beside, preds, bands, [sample], "cloud_mask" if masked_metrics else None, sam_unit, ssim)
    return metrics_of_tiles(parts, [sample], ssim)
