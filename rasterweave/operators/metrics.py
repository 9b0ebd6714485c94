"""How good a filling is: per sequence, over all, hidden and visible input pixels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterweave.functions.grids import gaussian_weights

# --- fixed values -----------------------------------------------------------
STRATA = ("all", "occluded", "observed")
SSIM_WINDOW, SSIM_SIGMA, SSIM_MAX = 5, 1.5, 1.0
# ----------------------------------------------------------------------------


#: Metrics that are better the larger they are, with or without the prefix 'masked_'; errors and losses are not.
LARGER_IS_BETTER = {"psnr", "ssim"}


def _plus(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def spectral_angle(pred: Sequence[Column], target: Sequence[Column], unit: str = "rad") -> Column:
    """Angle between two spectra; NULL if a band is missing or a norm is 0."""
    p = [c.cast("double") for c in pred]
    y = [c.cast("double") for c in target]
    dot = _plus([a * b for a, b in zip(p, y)])
    norms = F.sqrt(_plus([a * a for a in p])) * F.sqrt(_plus([b * b for b in y]))
    cosine = F.try_divide(dot, norms)
    angle = F.when(
        cosine.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    )
    return F.degrees(angle) if unit == "deg" else angle


def angle_of_arrays(a: Column, b: Column, unit: str = "rad") -> Column:
    """Spectral angle of two arrays of equal length."""
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    cosine = F.try_divide(dot, norm(a) * norm(b))
    angle = F.when(
        cosine.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    )
    return F.degrees(angle) if unit == "deg" else angle


def sample_metrics(
    scored: DataFrame,
    pred: Sequence[str],
    target: Sequence[str],
    keys: Sequence[str] = ("sample_id",),
    mask: str = "mask",
    cloud: str | None = None,
    valid: str | None = None,
    sam_unit: str = "rad",
    missing: str = "skip",
) -> DataFrame:
    """mae, mse, rmse, psnr and sam per key and stratum, one row per key.

    ``scored`` has one row per pixel with prediction and target side by side.
    All strata come from one aggregation, combined map-side, so only sums move.
    ``cloud`` drops target pixels hidden in reality; ``valid`` drops padded frames.
    Pixels without a prediction are skipped, or, with missing='null', make the
    value of their stratum NULL.
    """
    rows = scored
    if valid:
        rows = rows.where(F.col(valid) == 1)
    if cloud:
        rows = rows.where(F.col(cloud) == 0)
    diffs = [F.col(p).cast("double") - F.col(y).cast("double") for p, y in zip(pred, target)]
    zero = F.lit(0.0)
    rows = rows.select(
        *keys,
        F.col(mask).alias("_mask"),
        _plus([F.coalesce(F.abs(d), zero) for d in diffs]).alias("_ae"),
        _plus([F.coalesce(d * d, zero) for d in diffs]).alias("_se"),
        _plus([d.isNotNull().cast("int") for d in diffs]).alias("_n"),
        spectral_angle([F.col(p) for p in pred], [F.col(y) for y in target], sam_unit).alias("_sam"),
    )
    tests = {"all": F.lit(True), "occluded": F.col("_mask") == 1, "observed": F.col("_mask") == 0}
    aggs = []
    for stratum, test in tests.items():
        for name in ("_ae", "_se", "_n"):
            aggs.append(F.sum(F.when(test, F.col(name))).alias(f"{name}_{stratum}"))
        aggs.append(F.sum(F.when(test, F.col("_sam"))).alias(f"_sam_{stratum}"))
        aggs.append(F.count(F.when(test, F.col("_sam"))).alias(f"_nsam_{stratum}"))
        aggs.append(
            F.sum(F.when(test, F.lit(len(diffs)) - F.col("_n"))).alias(f"_gone_{stratum}")
        )
    return metrics_of_sums(rows.groupBy(*keys).agg(*aggs), keys, missing)


SUMS = ("_ae", "_se", "_n", "_sam", "_nsam", "_gone")


class BlockSums:
    """The sums behind the metrics of one block of pixels; NaN is a missing value."""

    def __init__(
        self, target: Sequence[np.ndarray], mask: np.ndarray, use: np.ndarray, sam_unit: str
    ) -> None:
        self.target, self.unit = target, sam_unit
        self.norm = np.sqrt(sum(y * y for y in target))
        strata = (use, use & (mask == 1), use & (mask == 0))
        self.weights = np.stack([s.ravel() for s in strata], axis=1).astype("float64")

    def __call__(self, pred: Sequence[np.ndarray]) -> dict[str, float]:
        shape = self.norm.shape
        ae, se, dot, square = (np.zeros(shape) for _ in range(4))
        n = np.full(shape, float(len(pred)))
        for p, y in zip(pred, self.target):
            d = np.abs(p - y)
            gone = np.isnan(d)
            if gone.any():
                n -= gone
                d[gone] = 0.0
            ae += d
            se += d * d
            dot += p * y
            square += p * p
        norms = np.sqrt(square) * self.norm
        seen = norms > 0
        cosine = np.divide(dot, norms, out=np.ones(shape), where=seen)
        angle = np.arccos(np.clip(cosine, -1.0, 1.0))
        angle = np.degrees(angle) if self.unit == "deg" else angle
        parts = np.stack([v.ravel() for v in (ae, se, n, angle, seen, len(pred) - n)])
        sums = parts @ self.weights
        return {
            f"{name}_{stratum}": float(sums[i, j])
            for i, name in enumerate(SUMS)
            for j, stratum in enumerate(STRATA)
        }


def metrics_of_sums(sums: DataFrame, keys: Sequence[str], missing: str = "skip") -> DataFrame:
    """mae, mse, rmse, psnr and sam per stratum from one row of sums per key."""
    out = []
    for s in STRATA:
        whole = F.col(f"_gone_{s}") == 0 if missing == "null" else F.lit(True)
        n = F.when(whole & (F.col(f"_n_{s}") > 0), F.col(f"_n_{s}").cast("double"))
        mse = F.col(f"_se_{s}") / n
        rmse = F.sqrt(mse)
        sam = F.try_divide(F.col(f"_sam_{s}"), F.col(f"_nsam_{s}").cast("double"))
        out += [
            (F.col(f"_ae_{s}") / n).alias(f"mae_{s}"),
            mse.alias(f"mse_{s}"),
            rmse.alias(f"rmse_{s}"),
            F.when(rmse == 0, F.lit(float("inf")))
            .otherwise(F.lit(20.0) * F.log10(F.lit(1.0) / F.nullif(rmse, F.lit(0.0))))
            .alias(f"psnr_{s}"),
            F.when(whole, sam).alias(f"sam_{s}"),
        ]
    return sums.select(*keys, *out)


def _filtered(maps: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Separable zero-padded filter over the last two axes."""
    r = len(weights) // 2
    for axis in (-2, -1):
        pad = [(0, 0)] * maps.ndim
        pad[axis] = (r, r)
        wide = np.pad(maps, pad)
        size = maps.shape[axis]
        maps = sum(w * np.take(wide, np.arange(i, i + size), axis) for i, w in enumerate(weights))
    return maps


def dissimilarity(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(1 - SSIM)/2 of each pixel, from (frames, H, W) stacks; NaN where the window holds a missing value."""
    w = np.array(gaussian_weights(SSIM_WINDOW, SSIM_SIGMA))
    c1, c2 = (0.01 * SSIM_MAX) ** 2, (0.03 * SSIM_MAX) ** 2
    mp, my, mpp, myy, mpy = _filtered(np.stack([p, y, p * p, y * y, p * y]), w)
    spread = (mpp - mp * mp) + (myy - my * my) + c2
    ssim = (2 * mp * my + c1) * (2 * (mpy - mp * my) + c2) / ((mp * mp + my * my + c1) * spread)
    return np.clip(1.0 - ssim, 0.0, 1.0) / 2.0


@F.pandas_udf(T.DoubleType())
def _frame_dssim(height: pd.Series, width: pd.Series, p: pd.Series, y: pd.Series) -> pd.Series:
    out = np.empty(len(p))
    for i, (h, w, a, b) in enumerate(zip(height, width, p, y)):
        shape = (-1, h, w)
        # One frame at a time: (bands, H, W) is the working set, whatever the batch.
        found = dissimilarity(
            np.asarray(a, dtype="float64").reshape(shape),
            np.asarray(b, dtype="float64").reshape(shape),
        )
        seen = ~np.isnan(found)
        out[i] = found[seen].mean() if seen.any() else np.nan
    return pd.Series(out)


def frame_dssim(frames: DataFrame, pred: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Add ``dssim``, the mean (1 - SSIM)/2 over bands and pixels of each frame row.

    5x5 Gaussian window (sigma 1.5), zero padding, per-pixel value clipped to
    [0, 1] before halving. Pixels whose window holds a missing value are left out; a frame
    of only such pixels has NULL. Works on whole frames where they lie; no shuffle.
    """
    both = [F.flatten(F.array(*[F.col(c) for c in cols])) for cols in (pred, target)]
    found = _frame_dssim(F.col("height"), F.col("width"), *both)
    return frames.withColumn("dssim", F.nanvl(found, F.lit(None).cast("double")))


def sample_ssim(
    frames: DataFrame,
    pred: Sequence[str],
    target: Sequence[str],
    keys: Sequence[str] = ("sample_id",),
    mask: str = "mask",
    valid: str | None = None,
) -> DataFrame:
    """ssim over all frames, over frames with any gap, and over frames without."""
    rows = frames.where(F.col(valid) == 1) if valid else frames
    scored = frame_dssim(rows, pred, target).withColumn(
        "_gap", F.exists(F.col(mask), lambda m: m == 1)
    )
    ssim = lambda v: F.lit(1.0) - F.lit(2.0) * F.avg(v)
    return scored.groupBy(*keys).agg(
        ssim(F.col("dssim")).alias("ssim_all"),
        ssim(F.when(F.col("_gap"), F.col("dssim"))).alias("ssim_occluded"),
        ssim(F.when(~F.col("_gap"), F.col("dssim"))).alias("ssim_observed"),
    )


def to_long(
    wide: DataFrame, keys: Sequence[str], prefix: str = "", skip_missing: bool = True
) -> DataFrame:
    """(keys, metric, stratum, value) rows from ``<metric>_<stratum>`` columns."""
    named = [c for c in wide.columns if c.rsplit("_", 1)[-1] in STRATA and c not in keys]
    entries = []
    for c in named:
        metric, stratum = c.rsplit("_", 1)
        shown = metric if metric.startswith("ssim") else prefix + metric
        entries.append(
            F.struct(
                F.lit(shown).alias("metric"),
                F.lit(stratum).alias("stratum"),
                F.col(c).cast("double").alias("value"),
            )
        )
    long = wide.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*")
    return long.where(F.col("value").isNotNull()) if skip_missing else long


#: Sums are kept to this many decimals, so that they do not depend on the order of their parts.
_EXACT = "decimal(38,18)"
_STATE = ("total", "weight", "rest", "infinite", "n", "missing")


def mean_states(
    values: DataFrame, keys: Sequence[str] = ("metric", "stratum"), value: str = "value", weight: str | None = None
) -> DataFrame:
    """What a mean per key is made of, to be stored and merged with the states of other samples.

    ``total`` and ``weight`` are decimal sums, which are the same however rows are dealt out;
    ``rest`` is the sum of values too large for them, ``infinite`` the number of infinite values by
    their sign, ``n`` the values that count and ``missing`` those that do not (NULL, NaN).
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    v = F.col(value).cast("double")
    usable = v.isNotNull() & ~F.isnan(v)
    endless = F.abs(v) == float("inf")
    part = F.when(usable & ~endless, v * w)
    small = F.abs(part) < 1e19
    zero = F.lit(0).cast(_EXACT)
    return values.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(small, part).try_cast(_EXACT)), zero).alias("total"),
        F.coalesce(F.sum(F.when(usable, w).try_cast(_EXACT)), zero).alias("weight"),
        F.coalesce(F.sum(F.when(~small, part)), F.lit(0.0)).alias("rest"),
        F.coalesce(F.sum(F.when(usable & endless, F.sign(v)).cast("bigint")), F.lit(0).cast("bigint")).alias("infinite"),
        F.count(F.when(usable, 1)).alias("n"),
        F.count(F.when(~usable, 1)).alias("missing"),
    )


def merge_states(states: DataFrame, keys: Sequence[str] = ("metric", "stratum")) -> DataFrame:
    """One state per key from any number of them, such as the union of stored tables."""
    kinds = {c: states.schema[c].dataType.simpleString() for c in _STATE}
    return states.groupBy(*keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in _STATE])


def means_of_states(states: DataFrame, keys: Sequence[str] = ("metric", "stratum"), empty: str = "skip") -> DataFrame:
    """(keys, mean, n) of merged states."""
    if empty not in ("skip", "nan"):
        raise ValueError("empty must be 'skip' or 'nan'")
    total = F.col("total").cast("double") + F.col("rest")
    mean = F.when(F.col("infinite") > 0, F.lit(float("inf"))).when(F.col("infinite") < 0, F.lit(float("-inf"))).otherwise(
        F.try_divide(total, F.col("weight").cast("double"))
    )
    if empty == "nan":
        mean = F.when(F.col("missing") == 0, mean).otherwise(F.lit(float("nan")))
    return states.select(*keys, mean.alias("mean"), "n")


def mean_over_samples(
    values: DataFrame,
    keys: Sequence[str] = ("metric", "stratum"),
    value: str = "value",
    weight: str | None = None,
    empty: str = "skip",
) -> DataFrame:
    """Weighted mean per key; a missing value is skipped, or sticks with empty='nan'.

    The result is the same, to the last bit, however the rows are dealt out.
    """
    return means_of_states(mean_states(values, keys, value, weight), keys, empty)


def loss_terms(
    scored: DataFrame,
    pred: Sequence[str],
    target: Sequence[str],
    keys: Sequence[str] = ("sample_id",),
    mask: str = "mask",
    cloud: str | None = None,
    valid: str | None = None,
) -> DataFrame:
    """L1 losses per key: all, hidden input, visible input, cloud-free target."""
    rows = scored.where(F.col(valid) == 1) if valid else scored
    diffs = [F.abs(F.col(p).cast("double") - F.col(y).cast("double")) for p, y in zip(pred, target)]
    total = _plus([F.coalesce(d, F.lit(0.0)) for d in diffs])
    n = _plus([d.isNotNull().cast("int") for d in diffs])
    tests = {
        "l1_loss": F.lit(True),
        "l1_loss_occluded_input_pixels": F.col(mask) == 1,
        "l1_loss_observed_input_pixels": F.col(mask) == 0,
    }
    if cloud:
        tests["masked_l1_loss"] = F.col(cloud) == 0
    return rows.groupBy(*keys).agg(
        *[
            F.try_divide(F.sum(F.when(t, total)), F.sum(F.when(t, n)).cast("double")).alias(name)
            for name, t in tests.items()
        ]
    )


def total_loss(terms: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Add ``total_loss``: the weighted sum of the named terms, as far as present."""
    parts = [F.coalesce(F.col(k), F.lit(0.0)) * F.lit(float(w)) for k, w in weights.items()]
    return terms.withColumn("total_loss", _plus(parts))
