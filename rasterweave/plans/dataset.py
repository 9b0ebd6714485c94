"""Model-ready samples of a stored data set, by one set of options."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions import grids, radiometry
from rasterweave.operators import geometry, quality, sequences
from rasterweave.plans.simulate import apply_stored_masks, choose_frames, clean_bands, simulate_gaps, training_set
from rasterweave.schema import ReadOptions, band_columns
from rasterweave.sources.frames import keep_listed, list_samples, pair_sensors, read_frames
from rasterweave.sources.settle import settle
from rasterweave.sources.simulations import read_simulation

RADAR = ["vv", "vh"]


def _prepared(
    frames: DataFrame, options: ReadOptions, bands: list[str], radar: DataFrame | None, seed: int
) -> tuple[DataFrame, list[str]]:
    """Augmented, cropped and scaled frames; all arrays of a frame are changed alike."""
    arrays = [*bands, "cloud_mask", *options.extra]
    if options.include_radar:
        # Paired first, so that both sensors are turned and cropped together.
        frames = pair_sensors(frames, radar.select("sample_id", "t", *RADAR))
        arrays += RADAR
    if options.augment and options.split == "train" and options.mode != "val":
        frames = geometry.augment(frames, arrays, seed)
    if options.crop is not None and options.crop.enabled:
        frames = geometry.crop_frames(frames, arrays, options.crop, seed)
    if options.sensor == "thirteen-band":
        scale = radiometry.per_pixel(radiometry.scale_optical)
        frames = frames.withColumns({b: scale(F.col(b)) for b in bands})
    else:
        frames = clean_bands(frames, bands)
    if options.include_radar:
        scale = radiometry.per_pixel(radiometry.scale_radar)
        frames = frames.withColumns({r: scale(F.col(r)) for r in RADAR})
    if options.drop_black:
        frames = sequences.drop_black(frames, bands, ["tile", "sample_id"])
    return frames, arrays


def model_samples(
    spark: SparkSession,
    root: str,
    options: ReadOptions,
    row_frames: int,
    seed: int = 0,
    n_bands: int | None = None,
    radar: DataFrame | None = None,
) -> DataFrame:
    """Training rows from the ``frames`` and ``frame_quality`` tables below ``root``.

    Selection follows ``options.filter``, gaps follow ``options.mask`` (none without
    it); masks are lent by frames of chosen samples, cropped and turned like the targets. With
    ``options.stored_run`` the sequences and masks of that run are used as they are stored. A row
    holds up to ``row_frames`` frames.
    """
    if options.include_radar and radar is None:
        raise ValueError("include_radar needs the radar frames")
    append_mask = options.channels.endswith("-mask")
    if options.stored_run is not None:
        stored = read_simulation(spark, options.stored_run, options.mask.run_key)
        gappy = apply_stored_masks(stored, band_columns(stored.columns), options.mask)
        return training_set(
            gappy, band_columns(stored.columns), row_frames, options.position_strategy, append_mask, extra=options.extra
        )
    n_bands = n_bands or (4 if options.sensor == "four-band" else 13)
    raw = read_frames(spark, f"{root}/frames", options, n_bands)
    bands = band_columns(raw.columns)
    scored = spark.read.parquet(f"{root}/frame_quality")
    scored = keep_listed(scored, list_samples(raw))
    if options.include_radar:
        scored = scored.join(radar.select("sample_id").distinct(), "sample_id", "left_semi")
    chosen = settle(choose_frames(scored, options.filter, options.max_seq_length, seed))
    frames, _ = _prepared(raw, options, bands, radar, seed)

    if options.mask is not None:
        coverage = settle(
            frames.select(
                "tile", "sample_id", "t", grids.mean(F.col("cloud_mask")).alias("coverage")
            )
        )
        masking = options.mask
        if options.render_occluded_above is not None:
            masking = replace(masking, occlude_above=options.render_occluded_above)
        gappy = simulate_gaps(frames, chosen, coverage, bands, masking)
    else:
        real = quality.occlude(F.col("cloud_mask"), options.render_occluded_above)
        zeros = F.array_repeat(F.lit(0).cast("tinyint"), F.size("cloud_mask"))
        gappy = frames.join(chosen.drop("tile", "n_frames"), ["sample_id", "t"]).withColumns(
            {"cloud_mask": real, "mask": zeros, **{f"{b}_in": F.col(b) for b in bands}}
        )
    return training_set(
        gappy,
        bands,
        row_frames,
        options.position_strategy,
        append_mask=append_mask,
        radar=RADAR if options.include_radar else (),
        extra=options.extra,
    )
