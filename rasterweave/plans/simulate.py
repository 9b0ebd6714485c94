"""Gap simulation over selected frames, and the assembled training set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.functions import radiometry
from rasterweave.operators import gaps, quality, sequences
from rasterweave.operators.scans import BLOCK_ROWS
from rasterweave.schema import FilterSettings, MaskSettings
from rasterweave.sources.settle import settle


def choose_frames(
    frame_quality: DataFrame,
    settings: FilterSettings,
    max_len: int | None = None,
    seed: int = 0,
    block_size: int = BLOCK_ROWS,
) -> DataFrame:
    """Usable frames of usable samples, numbered by ``pos``; scalars only, no bands."""
    ok = sequences.valid_samples(frame_quality, settings, block_size=block_size)
    chosen = sequences.select_frames(
        frame_quality.join(ok, "sample_id", "left_semi"), settings, block_size=block_size
    )
    kept = sequences.trim_random_window(chosen, max_len, seed, block_size=block_size)
    return kept.select("sample_id", "tile", "t", "pos", "n_frames", "valid_obs")


def simulate_gaps(
    frames: DataFrame,
    chosen: DataFrame,
    coverage: DataFrame,
    bands: Sequence[str],
    settings: MaskSettings,
    earlier: DataFrame | None = None,
    donor_frames: DataFrame | None = None,
) -> DataFrame:
    """Chosen frames with mask, masked, fully_masked and the filled bands ``<band>_in``.

    ``chosen`` comes from :func:`choose_frames`; ``coverage`` is any table of (tile,
    sample_id, t, coverage), such as the frame quality; only chosen samples lend masks. Both are used several
    times and should be stored tables (see ``settle``), as should nothing larger:
    which frame gets which mask is decided on scalars, and the band arrays are
    read and shuffled once, in the final join. Masks are lent within the
    tile, by ``donor_frames`` (of which only the mask is read) or ``frames``. Where
    only good frames can be chosen, pass ``frames`` through ``quality.good_only``
    and all frames as donors, so that unusable bands are never shuffled.

    Every ranking and join on tile or sample is split into parts. What they decide is
    stored at two points, since each split reads its input twice.
    """
    if settings.mask_type == "real_clouds":
        flags = chosen.drop("tile", "n_frames").withColumns(
            {"masked": F.lit(0), "fully_masked": F.lit(0)}
        )
        own = frames.join(flags, ["sample_id", "t"])
        own = own.withColumn("cloud_mask", quality.occlude(F.col("cloud_mask"), settings.occlude_above))
        return gaps.mask_sequence(own.withColumn("mask", F.col("cloud_mask")), bands, settings)

    drawn = settle(gaps.sample_masked_frames(chosen, settings, earlier))
    usable = chosen.select("tile", "sample_id").distinct()
    donors = gaps.donor_index(
        coverage.join(usable, ["tile", "sample_id"], "left_semi"), settings.min_donor_coverage, settings.seed, settings.donor_draw
    )
    draws = settle(
        gaps.draw_donors(
            drawn.where(F.col("masked") == 1).select("sample_id", "tile", "t"),
            donors,
            settings.seed,
            settings.donor_draw,
        )
    )
    out = gaps.compose_masks(
        frames.join(drawn.drop("tile", "n_frames"), ["sample_id", "t"]),
        draws,
        frames if donor_frames is None else donor_frames,
        occlude_above=settings.occlude_above,
    )
    if settings.occlude_above:
        real = quality.occlude(F.col("cloud_mask"), settings.occlude_above)
        out = out.withColumn("cloud_mask", real)
    if settings.apply_full:
        ones = F.array_repeat(F.lit(1).cast("tinyint"), F.size("mask"))
        out = out.withColumn("mask", F.when(F.col("fully_masked") == 1, ones).otherwise(F.col("mask")))
    if settings.union_real_masks:
        union = gaps.union_masks(F.col("mask"), F.col("cloud_mask"))
        out = out.withColumn("mask", quality.occlude(union, settings.occlude_above))
    return gaps.mask_sequence(out, bands, settings)


def apply_stored_masks(
    stored: DataFrame, bands: Sequence[str], settings: MaskSettings
) -> DataFrame:
    """Gaps of an earlier run on its target frames: union with real clouds, grow, fill.

    ``stored`` comes from ``read_simulation``; no draw is repeated, nothing is shuffled.
    """
    out = stored
    if settings.mask_type == "random_clouds" and settings.union_real_masks:
        union = gaps.union_masks(F.col("mask"), F.col("cloud_mask"))
        out = out.withColumn("mask", quality.occlude(union, settings.occlude_above))
    return gaps.mask_sequence(out, bands, settings)


def training_set(
    masked: DataFrame,
    bands: Sequence[str],
    max_len: int,
    position: str = "day-of-year",
    append_mask: bool = False,
    radar: Sequence[str] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per sample: x, y, masks, cloud_mask, valid_obs, positions and days.

    Frames at ``pos`` >= max_len start further rows (``part``), so that a row
    never holds more than ``max_len`` frames; sequences trimmed to max_len have one.
    ``radar`` columns are added to x, ``extra`` columns (cloud_prob, class_id) kept apart.
    """
    timed = sequences.add_position(masked, position, "position", t="pos")
    timed = sequences.add_position(timed, "day-within-sequence", "days", t="pos")
    inputs = [F.col(f"{b}_in") for b in bands]
    if append_mask:
        inputs.append(F.transform("mask", lambda v: v.cast("double")))
    inputs += [F.col(r) for r in radar]
    entry = F.struct(
        F.col("pos"),
        F.array(*inputs).alias("x"),
        F.array(*[F.col(b) for b in bands]).alias("y"),
        F.col("mask"),
        F.col("cloud_mask"),
        F.col("valid_obs"),
        F.col("position"),
        F.col("days"),
        F.date_format("acq_date", "yyyy-MM-dd").alias("date"),
        *[F.col(c) for c in extra],
    )
    rows = timed.withColumn("part", F.floor(F.col("pos") / max_len).cast("bigint"))
    grouped = rows.groupBy("tile", "sample_id", "part").agg(
        F.sort_array(F.collect_list(entry)).alias("_f")
    )
    pick = lambda name: F.transform("_f", lambda f: f[name])
    return grouped.select(
        "tile",
        "sample_id",
        "part",
        pick("x").alias("x"),
        pick("y").alias("y"),
        pick("mask").alias("masks"),
        pick("cloud_mask").alias("cloud_mask"),
        pick("valid_obs").alias("masks_valid_obs"),
        pick("position").alias("position_days"),
        pick("days").alias("days"),
        pick("date").alias("dates"),
        *[pick(c).alias(c) for c in extra],
    )


def clean_bands(frames: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Reflectances with missing values as 0, clipped to [0, 1]."""
    lift = radiometry.per_pixel(radiometry.clean_reflectance)
    return frames.withColumns({b: lift(F.col(b)) for b in bands})
