"""Frame statistics and the impaired / cloudy / good status of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions import grids
from rasterweave.schema import band_columns

# --- fixed values (percent) -------------------------------------------------
PROB_ABOVE = 1.0
CLOUD_PCT_MAX = 40.0
CLOUD_PCT_MAX_NO_PROB = 5.0
PROB_PCT_LOW, CLOUD_PCT_WITH_LOW = 1.0, 10.0
PROB_PCT_HIGH, CLOUD_PCT_WITH_HIGH, CLOUD_PCT_WITH_HIGH_STRICT = 4.0, 8.0, 3.5
# ----------------------------------------------------------------------------

FRAME_KEYS = ("sample_id", "tile", "t", "acq_date")


def frame_statistics(
    pixels: DataFrame,
    keys: Sequence[str] = FRAME_KEYS,
    bands: Sequence[str] | None = None,
    mask: str = "cloud_mask",
    prob: str | None = "cloud_prob",
) -> DataFrame:
    """Per-frame cloud_pct, coverage, prob_pct and not_avail from pixel rows (map-side combined)."""
    bands = list(bands or band_columns(pixels.columns))
    n = F.count(F.lit(1))
    aggs = [
        (F.lit(100.0) * F.sum(F.col(mask).cast("double")) / n).alias("cloud_pct"),
        (F.sum(F.col(mask).cast("double")) / n).alias("coverage"),
        F.every(F.coalesce(*[F.col(b) for b in bands]).isNull()).alias("not_avail"),
    ]
    if prob:
        above = F.when(F.col(prob) > PROB_ABOVE, 1.0).otherwise(0.0)
        aggs.append((F.lit(100.0) * F.sum(above) / n).alias("prob_pct"))
    return pixels.groupBy(*keys).agg(*aggs)


def frame_statistics_arrays(
    frames: DataFrame,
    keep: Sequence[str] = FRAME_KEYS,
    bands: Sequence[str] | None = None,
    mask: str = "cloud_mask",
    prob: str | None = "cloud_prob",
) -> DataFrame:
    """The same statistics from frame rows: a projection, no shuffle, so it streams."""
    bands = list(bands or band_columns(frames.columns))
    gone = " AND ".join(f"forall(`{b}`, v -> v IS NULL OR isnan(v))" for b in bands)
    hidden = f"aggregate(`{mask}`, 0D, (s, v) -> s + double(v))"
    stats = {
        "cloud_pct": f"100D * {hidden} / size(`{mask}`)",
        "coverage": f"{hidden} / size(`{mask}`)",
        "not_avail": gone,
    }
    if prob:
        above = f"aggregate(`{prob}`, 0D, (s, v) -> s + IF(v > {PROB_ABOVE}D, 1D, 0D))"
        stats["prob_pct"] = f"100D * {above} / size(`{prob}`)"
    return frames.selectExpr(
        *[f"`{c}`" for c in keep], *[f"{e} AS {name}" for name, e in stats.items()]
    )


def is_impaired(strict: bool = False, with_prob: bool = True) -> Column:
    """The frame test over cloud_pct, prob_pct and not_avail."""
    cloud, gone = F.col("cloud_pct"), F.col("not_avail")
    if not with_prob:
        return gone | (cloud >= CLOUD_PCT_MAX_NO_PROB)
    prob = F.col("prob_pct")
    high = CLOUD_PCT_WITH_HIGH_STRICT if strict else CLOUD_PCT_WITH_HIGH
    return (
        gone
        | (cloud >= CLOUD_PCT_MAX)
        | ((prob > PROB_PCT_LOW) & (cloud > CLOUD_PCT_WITH_LOW))
        | ((prob > PROB_PCT_HIGH) & (cloud > high))
    )


def flag_frames(stats: DataFrame, strict: bool = False, with_prob: bool = True) -> DataFrame:
    """Add impaired, cloudy (impaired but available) and valid_obs."""
    return (
        stats.withColumn("impaired", is_impaired(strict, with_prob))
        .withColumn("cloudy", F.col("impaired") & ~F.col("not_avail"))
        .withColumn("valid_obs", (~F.col("impaired")).cast("int"))
    )


def good_only(
    frames: DataFrame, strict: bool = False, with_prob: bool = True
) -> DataFrame:
    """Frames that are not impaired, judged from their own arrays.

    The same test as :func:`flag_frames`, without a join: it drops the frames no
    later step will use before their bands are shuffled.
    """
    prob = "cloud_prob" if with_prob else None
    stats = frame_statistics_arrays(frames, frames.columns, prob=prob)
    return stats.where(~is_impaired(strict, with_prob)).select(*frames.columns)


def status_lists(
    quality: DataFrame, keys: Sequence[str] = ("sample_id",), t: str = "t", block: int = 4096
) -> DataFrame:
    """Sorted frame lists per sample, cut into ``block`` frames per row.

    ``list_no`` numbers the rows of a sample: a sequence of up to ``block`` frames has
    one, a longer one goes on in further rows, so that no row grows with the data.
    """
    def frames_where(test: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(test, F.col(t))))

    return (
        quality.withColumn("list_no", F.floor(F.col(t) / block).cast("bigint"))
        .groupBy(*keys, "list_no")
        .agg(
            frames_where(F.col("impaired")).alias("idx_impaired_frames"),
            frames_where(F.col("cloudy")).alias("idx_cloudy_frames"),
            frames_where(~F.col("impaired")).alias("idx_good_frames"),
            F.transform(
                F.sort_array(F.collect_list(F.struct(F.col(t), F.col("valid_obs")))),
                lambda s: s["valid_obs"],
            ).alias("valid_obs"),
        )
    )


def frame_coverage(
    frames: DataFrame, keys: Sequence[str] = ("sample_id", "t"), mask: str = "mask"
) -> DataFrame:
    """Mean mask of each frame, from its own array."""
    return frames.select(*keys, grids.mean(F.col(mask)).alias("coverage"))


def occlude(mask: Column, above: float | None) -> Column:
    """Whole frame masked if its coverage exceeds ``above``; None or 0 is off."""
    if not above:
        return mask
    full = F.array_repeat(F.lit(1).cast("tinyint"), F.size(mask))
    return F.when(grids.mean(mask) > above, full).otherwise(mask)


def band_means_observed(
    frames: DataFrame,
    bands: Sequence[str],
    mask: str = "mask",
    valid: str | None = "valid_obs",
    keys: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """Mean of the unmasked pixels of valid frames, as ``mean_<band>`` per sample.

    Each frame is reduced to a sum and a count before anything is shuffled.
    """
    rows = frames.where(F.col(valid) == 1) if valid else frames

    def fold(b: str, start: Column, pick: callable) -> Column:
        pairs = F.arrays_zip(F.col(b).alias("v"), F.col(mask).alias("m"))
        keep = lambda p: (p["m"] == 0) & p["v"].isNotNull()
        return F.aggregate(pairs, start, lambda s, p: s + F.when(keep(p), pick(p)).otherwise(start))

    parts = []
    for b in bands:
        parts.append(fold(b, F.lit(0.0), lambda p: p["v"].cast("double")).alias(f"_s_{b}"))
        parts.append(fold(b, F.lit(0), lambda p: F.lit(1)).alias(f"_n_{b}"))
    sums = rows.select(*keys, *parts).groupBy(*keys)
    return sums.agg(
        *[
            F.try_divide(F.sum(f"_s_{b}"), F.sum(f"_n_{b}").cast("double")).alias(f"mean_{b}")
            for b in bands
        ]
    )


def tile_counts(samples: DataFrame, tile: str = "tile", sample: str = "sample_id") -> DataFrame:
    """Samples per tile and their share of all samples."""
    counts = samples.groupBy(tile).agg(F.count_distinct(sample).alias("n_samples"))
    total = counts.agg(F.sum("n_samples")).scalar()
    return counts.withColumn("share", F.col("n_samples") / total)
