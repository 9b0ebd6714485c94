"""Artificial gaps: which frames, whose masks, and what hidden pixels hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.functions import grids, radiometry
from rasterweave.functions.hashing import draw_int, gaussian, hash_bucket, hash_hex, uniform
from rasterweave.operators.geometry import dilate
from rasterweave.operators.joins import spread_join
from rasterweave.operators.quality import band_means_observed, occlude
from rasterweave.operators.scans import number_rows, with_length
from rasterweave.schema import MaskSettings

SAMPLE = ("sample_id",)
#: Leading hash digits that cut a key's ranking into parts, 4096 of them.
_DIGITS = 3
NOISE_STD = 0.5


def _ranked(
    df: DataFrame, keys: Sequence[str], wanted: Column, h: Column, name: str
) -> DataFrame:
    """Rank the wanted rows of a key by hash, from 0; the others come after them.

    The leading hash digits are the block of the numbering, for wanted rows and for
    the others, so a key of any length is ranked by many tasks.
    """
    bucket = hash_bucket(F.col("_h"), _DIGITS) + F.when(wanted, 0).otherwise(16**_DIGITS)
    rows = df.withColumn("_h", h)
    return number_rows(rows, keys, [bucket, F.col("_h")], name, block=bucket.cast("bigint")).drop("_h")


def _effective_length(settings: MaskSettings, keys: Sequence[str]) -> Column:
    n = F.col("n_frames")
    if settings.fixed_masking_ratio:
        return n
    return draw_int(hash_hex(settings.seed, "ratio", *keys), n) + 1


def draw_masked(
    frames: DataFrame,
    settings: MaskSettings,
    keys: Sequence[str] = SAMPLE,
    pos: str = "pos",
) -> DataFrame:
    """Add ``masked`` (0/1): ceil(ratio * N) of the allowed frames, without replacement.

    ``pos`` numbers the frames of a sequence from 0. Excluded positions may be
    negative, counting from the end; the draw is capped at the allowed frames.
    """
    keys = list(keys)
    ratio = F.lit(float(settings.ratio_masked_frames))
    excluded = F.lit(False)
    for p in settings.non_masked_frames:
        excluded = excluded | (F.col(pos) == (F.lit(p) if p >= 0 else F.col("n_frames") + p))
    rows = with_length(frames, keys).withColumn("_allowed", ~excluded)
    ranked = _ranked(
        rows, keys, F.col("_allowed"), hash_hex(settings.seed, "mask", *keys, pos), "_rank"
    )
    hit = F.col("_allowed") & (F.col("_rank") < F.ceil(ratio * _effective_length(settings, keys)))
    return ranked.withColumn("masked", hit.cast("int")).drop("_allowed", "_rank")


def draw_fully_masked(
    frames: DataFrame,
    settings: MaskSettings,
    keys: Sequence[str] = SAMPLE,
    pos: str = "pos",
) -> DataFrame:
    """Add ``fully_masked`` (0/1): ceil(full ratio * N) of the masked frames."""
    if settings.ratio_fully_masked_frames <= 0:
        return frames.withColumn("fully_masked", F.lit(0))
    keys = list(keys)
    ratio = F.lit(float(settings.ratio_fully_masked_frames))
    ranked = _ranked(
        with_length(frames, keys),
        keys,
        F.col("masked") == 1,
        hash_hex(settings.seed, "full", *keys, pos),
        "_rank",
    )
    quota = F.ceil(ratio * _effective_length(settings, keys))
    hit = (F.col("masked") == 1) & (F.col("_rank") < quota)
    return ranked.withColumn("fully_masked", hit.cast("int")).drop("_rank")


def sample_masked_frames(
    frames: DataFrame,
    settings: MaskSettings,
    earlier: DataFrame | None = None,
    keys: Sequence[str] = SAMPLE,
    pos: str = "pos",
) -> DataFrame:
    """Masked and fully masked frames.

    ``earlier`` holds (keys, pos, masked, fully_masked) of a run with the same ratio
    of masked frames: its samples keep their masked frames, and also their fully
    masked ones unless those are NULL there, in which case they are drawn.
    """
    drawn = draw_masked(frames, settings, keys, pos)
    if earlier is None:
        return draw_fully_masked(drawn, settings, keys, pos)
    at = [*keys, pos]
    old = earlier.select(
        *at, F.col("masked").alias("_masked"), F.col("fully_masked").alias("_full")
    )
    reused = drawn.join(old, at, "left").withColumn(
        "masked", F.coalesce(F.col("_masked"), F.col("masked"))
    )
    full = draw_fully_masked(reused, settings, keys, pos)
    return full.withColumn(
        "fully_masked", F.coalesce(F.col("_full"), F.col("fully_masked"))
    ).drop("_masked", "_full")


def donor_index(
    coverage: DataFrame,
    min_coverage: float = 0.1,
    seed: int = 0,
    draw: str = "frame",
) -> DataFrame:
    """Frames that may lend their mask, numbered for drawing.

    ``coverage`` has (tile, sample_id, t, coverage). With draw='frame' the number
    runs over the donor frames of a tile; with 'sample' there are two numbers, of
    the sequence in its tile and of the frame in its sequence.
    """
    donors = coverage.where(F.col("coverage") >= min_coverage).select(
        "tile", F.col("sample_id").alias("donor_sample"), F.col("t").alias("donor_t")
    )
    frame_hash = hash_hex(seed, "donor_order", "donor_sample", "donor_t")
    yes = F.lit(True)
    if draw == "frame":
        return _ranked(donors, ["tile"], yes, frame_hash, "donor_no")
    samples = donors.select("tile", "donor_sample").distinct()
    sample_hash = hash_hex(seed, "donor_sample_order", "donor_sample")
    numbered = _ranked(samples, ["tile"], yes, sample_hash, "donor_sample_no")
    frames = _ranked(donors, ["tile", "donor_sample"], yes, frame_hash, "donor_no")
    return frames.join(numbered, ["tile", "donor_sample"])


def draw_donors(
    masked: DataFrame,
    donors: DataFrame,
    seed: int = 0,
    draw: str = "frame",
    keys: Sequence[str] = ("sample_id", "t"),
) -> DataFrame:
    """Give every masked frame a donor of its tile, with replacement.

    Adds donor_sample and donor_t, NULL where the tile has no donor.
    """
    keys = list(keys)
    if draw == "frame":
        sizes = donors.groupBy("tile").agg((F.max("donor_no") + 1).alias("_n"))
        pick = draw_int(hash_hex(seed, "donor", *keys), F.col("_n"))
        rows = masked.join(sizes, "tile", "left").withColumn("donor_no", pick).drop("_n")
        return spread_join(rows, donors, ["tile", "donor_no"], keys).drop("donor_no")
    per_sample = donors.groupBy("tile", "donor_sample", "donor_sample_no").agg(
        (F.max("donor_no") + 1).alias("_n")
    )
    sizes = per_sample.groupBy("tile").agg((F.max("donor_sample_no") + 1).alias("_m"))
    pick_sample = draw_int(hash_hex(seed, "donor_sample", *keys), F.col("_m"))
    rows = masked.join(sizes, "tile", "left").withColumn("donor_sample_no", pick_sample).drop("_m")
    rows = spread_join(rows, per_sample, ["tile", "donor_sample_no"], keys)
    pick = draw_int(hash_hex(seed, "donor", *keys), F.col("_n"))
    rows = rows.withColumn("donor_no", pick).drop("_n", "donor_sample_no")
    frames = donors.drop("donor_sample_no")
    return spread_join(rows, frames, ["tile", "donor_sample", "donor_no"], keys).drop("donor_no")


def tiles_without_donor(masked: DataFrame, donors: DataFrame) -> DataFrame:
    """Tiles that have masked frames but nothing to lend."""
    return masked.select("tile").distinct().join(donors, "tile", "left_anti")


def compose_masks(
    frames: DataFrame,
    draws: DataFrame,
    donor_frames: DataFrame,
    donor_mask: str = "cloud_mask",
    out: str = "mask",
    keys: Sequence[str] = ("sample_id", "t"),
    occlude_above: float | None = None,
) -> DataFrame:
    """Put each drawn donor mask on its frame; all other frames get a zero mask."""
    keys = list(keys)
    lent = donor_frames.select(
        F.col("sample_id").alias("donor_sample"),
        F.col("t").alias("donor_t"),
        occlude(F.col(donor_mask), occlude_above).alias("_lent"),
    )
    placed = spread_join(
        draws.select(*keys, "donor_sample", "donor_t"),
        lent,
        ["donor_sample", "donor_t"],
        keys,
        rows_per_copy=10_000,
    ).select(*keys, "_lent")
    zeros = F.array_repeat(F.lit(0).cast("tinyint"), F.size(donor_mask))
    return (
        frames.join(placed, keys, "left")
        .withColumn(out, F.coalesce(F.col("_lent"), zeros))
        .drop("_lent")
    )


def union_masks(mask: Column, real: Column) -> Column:
    """1 where the artificial mask is set or the real one is 1."""
    return F.zip_with(
        mask, real, lambda m, c: F.when((m > 0) | (c == 1), 1).otherwise(0).cast("tinyint")
    )


def fill_gaps(
    frames: DataFrame,
    bands: Sequence[str],
    fill_type: str = "fill_value",
    fill_value: float = 0.0,
    mask: str = "mask",
    seed: int = 0,
    keys: Sequence[str] = SAMPLE,
    t: str = "t",
    valid: str | None = None,
    suffix: str = "",
) -> DataFrame:
    """Fill masked pixels: a constant, the value plus noise clipped to [0, 1], or band means."""

    def replaced(b: str, value: Column) -> Column:
        return F.zip_with(b, mask, lambda v, m: F.when(m == 1, value).otherwise(v))

    if fill_type == "fill_value":
        filled = {b: replaced(b, F.lit(float(fill_value))) for b in bands}
    elif fill_type == "white_noise":

        def noisy(b: str) -> Column:
            def value(v: Column, i: Column) -> Column:
                h = hash_hex(seed, f"noise_{b}", *keys, t, i)
                noise = radiometry.clip(gaussian(h) * F.lit(NOISE_STD), 0.0, 1.0)
                return F.when(F.get(F.col(mask), i) == 1, v + noise).otherwise(v)

            return F.transform(b, value)

        filled = {b: noisy(b) for b in bands}
    elif fill_type == "mean":
        frames = frames.join(band_means_observed(frames, bands, mask, valid, keys), list(keys), "left")
        filled = {b: replaced(b, F.col(f"mean_{b}")) for b in bands}
    else:
        raise ValueError(f"unknown fill type {fill_type!r}")
    out = frames.withColumns({f"{b}{suffix}": c for b, c in filled.items()})
    return out.drop(*[f"mean_{b}" for b in bands]) if fill_type == "mean" else out


def mask_sequence(
    frames: DataFrame,
    bands: Sequence[str],
    settings: MaskSettings,
    mask: str = "mask",
    valid: str | None = None,
    suffix: str = "_in",
) -> DataFrame:
    """Dilate, then fill: adds ``<band><suffix>`` and leaves the final mask in ``mask``."""
    grown = dilate(frames, mask, settings.dilate)
    return fill_gaps(
        grown, bands, settings.fill_type, settings.fill_value, mask, settings.seed,
        valid=valid, suffix=suffix,
    )


def overlay_masks(
    frames: DataFrame,
    masks: DataFrame,
    seed: int = 0,
    keys: Sequence[str] = SAMPLE,
    pos: str = "pos",
    out: str = "mask",
) -> DataFrame:
    """Place ``masks`` (keys, mask_no from 0, mask) on random distinct frames.

    As many masks as frames are placed in order.
    """
    keys = list(keys)
    n_frames = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nf"))
    n_masks = masks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nm"))
    sizes = n_frames.join(n_masks, keys, "left")
    ranked = _ranked(frames, keys, F.lit(True), hash_hex(seed, "overlay", *keys, pos), "_rank")
    target = F.when(F.col("_nf") == F.col("_nm"), F.col(pos)).otherwise(F.col("_rank"))
    placed = masks.select(*keys, F.col("mask_no").cast("bigint").alias("_target"), F.col("mask").alias("_m"))
    zeros = F.array_repeat(F.lit(0).cast("tinyint"), F.col("height") * F.col("width"))
    return (
        ranked.join(sizes, keys)
        .withColumn("_target", target.cast("bigint"))
        .join(placed, [*keys, "_target"], "left")
        .withColumn(out, F.coalesce(F.col("_m"), zeros))
        .drop("_rank", "_target", "_nf", "_nm", "_m")
    )


def split_by_tile(
    samples: DataFrame, val_size: int, seed: int = 0, tile: str = "tile", sample: str = "sample_id"
) -> DataFrame:
    """Split of each tile: 'train' until N - val_size samples are reached, then 'val'.

    Tiles are drawn without replacement with probability proportional to their
    sample count, by exponential keys; no tile is in both splits.
    """
    counts = samples.groupBy(tile).agg(F.count_distinct(sample).cast("bigint").alias("n_samples"))
    key = -F.ln(uniform(hash_hex(seed, "split", tile))) / F.col("n_samples")
    keyed = counts.withColumn("_key", key)
    # Keys scaled by the mean count spread over (0, 1) as 1 - exp(-key): its
    # equal-width classes are ordered blocks of a few tiles each.
    scale = counts.agg(F.avg("n_samples")).scalar()
    block = F.floor((F.lit(1.0) - F.exp(-F.col("_key") * scale)) * 1024).cast("bigint")
    return (
        running_total(keyed, "_key", "n_samples", block, "_before")
        .withColumn(
            "split",
            F.when(
                F.col("_before") < counts.agg(F.sum("n_samples")).scalar() - F.lit(val_size), "train"
            ).otherwise("val"),
        )
        .drop("_key", "_before")
    )


def running_total(
    df: DataFrame, order: str, value: str, block: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over all rows strictly before each row, in two levels.

    Only the block totals - a fixed number of rows - pass through one task.
    """
    rows = df.withColumn("_block", block)
    totals = rows.groupBy("_block").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(F.lit(1)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_block", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, "_block")
        .withColumn(name, F.col("_o") + F.col("_i"))
        .drop("_block", "_i", "_o")
    )
