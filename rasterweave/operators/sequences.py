"""Which samples and which of their frames to use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions import calendar
from rasterweave.functions.hashing import draw_int, hash_hex
from rasterweave.operators.metrics import LARGER_IS_BETTER
from rasterweave.operators.scans import BLOCK_ROWS, blocks_of, number_rows, runs, with_length
from rasterweave.schema import POSITION_STRATEGIES, FilterSettings

SAMPLE = ("sample_id",)


def _longest(all_runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The longest run per key (first one on ties); runs of one frame do not count."""
    ranked = F.struct(F.col("run_len"), (-F.col("run_start")).alias("neg"), F.col("run_end"))
    best = all_runs.groupBy(*keys).agg(F.max(F.when(F.col("run_len") > 1, ranked)).alias("_b"))
    return best.select(
        *keys,
        F.coalesce(-F.col("_b.neg"), F.lit(0)).cast("bigint").alias("run_start"),
        F.coalesce(F.col("_b.run_end"), F.lit(0)).cast("bigint").alias("run_end"),
        F.coalesce(F.col("_b.run_len"), F.lit(0)).cast("bigint").alias("run_len"),
    )


def longest_good_run(
    quality: DataFrame,
    keys: Sequence[str] = SAMPLE,
    t: str = "t",
    valid: str = "valid_obs",
    block_size: int = BLOCK_ROWS,
) -> DataFrame:
    """Longest run of consecutive good frames: bounds and length, 0/0/0 if none."""
    linked = lambda row, before: row[t] - before[t] == 1
    found = runs(quality, keys, t, F.col(valid) == 1, linked, block=blocks_of(t, block_size))
    return _longest(found, keys)


def longest_run_within_gap(
    quality: DataFrame,
    max_days: int,
    keys: Sequence[str] = SAMPLE,
    t: str = "t",
    day: str = "acq_date",
    valid: str = "valid_obs",
    block_size: int = BLOCK_ROWS,
) -> DataFrame:
    """Longest chain of good frames whose neighbours are at most ``max_days`` apart."""
    linked = lambda row, before: F.datediff(row[day], before[day]) <= max_days
    found = runs(
        quality, keys, t, F.col(valid) == 1, linked, [day], block=blocks_of(t, block_size)
    )
    return _longest(found, keys)


def max_invalid_run(
    quality: DataFrame,
    keys: Sequence[str] = SAMPLE,
    t: str = "t",
    valid: str = "valid_obs",
    block_size: int = BLOCK_ROWS,
) -> DataFrame:
    """Longest run of invalid frames per key, 0 if every frame is valid."""
    linked = lambda row, before: row[t] - before[t] == 1
    found = runs(quality, keys, t, F.col(valid) == 0, linked, block=blocks_of(t, block_size))
    return found.groupBy(*keys).agg(F.max("run_len").cast("bigint").alias("max_invalid"))


def valid_samples(
    quality: DataFrame,
    settings: FilterSettings,
    keys: Sequence[str] = SAMPLE,
    required: DataFrame | None = None,
    block_size: int = BLOCK_ROWS,
) -> DataFrame:
    """Keys of the samples that pass the filter.

    ``required`` (the second sensor's samples, say) keeps only keys found there.
    With 'cloud-free', a limit on invalid frames decides alone and
    ``max_t_sampling`` is not looked at.
    """
    keys = list(keys)
    out = quality.select(*keys).distinct()
    if settings.type == "cloud-free":
        good = quality.groupBy(*keys).agg(F.sum("valid_obs").alias("_good"))
        out = good.where(F.col("_good") >= settings.min_length).select(*keys)
        if settings.max_num_consec_invalid is not None:
            worst = max_invalid_run(quality, keys, block_size=block_size)
            ok = worst.where(F.col("max_invalid") <= settings.max_num_consec_invalid)
            out = out.join(ok, keys, "left_semi")
        elif settings.max_t_sampling is not None:
            out = out.join(_long_chains(quality, settings, keys, block_size), keys, "left_semi")
    elif settings.type == "cloud-free_consecutive":
        run = longest_good_run(quality, keys, block_size=block_size)
        out = run.where(F.col("run_len") >= settings.min_length).select(*keys)
        if settings.max_t_sampling is not None:
            out = out.join(_long_chains(quality, settings, keys, block_size), keys, "left_semi")
    if required is not None:
        out = out.join(required.select(*keys).distinct(), keys, "left_semi")
    return out


def _long_chains(
    quality: DataFrame, settings: FilterSettings, keys: Sequence[str], block_size: int
) -> DataFrame:
    chain = longest_run_within_gap(
        quality, settings.max_t_sampling, keys, block_size=block_size
    )
    return chain.where(F.col("run_len") >= settings.min_length)


def drop_black(
    frames: DataFrame, bands: Sequence[str], keys: Sequence[str] = SAMPLE
) -> DataFrame:
    """Drop every sample in which the scaled bands of some frame sum to 0."""
    total = F.lit(0.0)
    for b in bands:
        total = total + F.aggregate(
            F.col(b), F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0))
        )
    black = frames.where(total == 0).select(*keys).distinct()
    return frames.join(black, list(keys), "left_anti")


def select_frames(
    quality: DataFrame,
    settings: FilterSettings,
    keys: Sequence[str] = SAMPLE,
    block_size: int = BLOCK_ROWS,
) -> DataFrame:
    """Frames to use, with ``valid_obs`` renewed for the filter type.

    Only valid frames are returned unless ``return_valid_obs_only`` is off.
    """
    keys = list(keys)
    bounds = None
    if settings.type == "cloud-free" and settings.max_t_sampling is not None:
        bounds = longest_run_within_gap(
            quality, settings.max_t_sampling, keys, block_size=block_size
        )
    elif settings.type == "cloud-free_consecutive":
        bounds = longest_good_run(quality, keys, block_size=block_size)
    if bounds is not None:
        inside = F.col("t").between(F.col("run_start"), F.col("run_end"))
        flag = F.when(inside, F.col("valid_obs")).otherwise(0)
        out = quality.join(bounds, keys).withColumn("valid_obs", flag)
        out = out.drop("run_start", "run_end", "run_len")
    elif settings.type is None:
        out = quality.withColumn("valid_obs", F.lit(1))
    else:
        out = quality
    if settings.return_valid_obs_only:
        out = out.where(F.col("valid_obs") == 1)
    return out


def trim_random_window(
    kept: DataFrame,
    max_len: int | None,
    seed: int = 0,
    keys: Sequence[str] = SAMPLE,
    t: str = "t",
    block_size: int = BLOCK_ROWS,
) -> DataFrame:
    """Number the kept frames (``pos`` from 0) and keep a random run of ``max_len``.

    Sequences no longer than ``max_len`` stay whole; ``pos`` counts from the
    first frame that is left, ``n_frames`` is what is left of the sequence.
    """
    keys = list(keys)
    numbered = number_rows(kept, keys, [t], "pos", block=blocks_of(t, block_size))
    rows = with_length(numbered, keys)
    if max_len is None:
        return rows
    n = F.col("n_frames")
    start = F.when(n > max_len, draw_int(hash_hex(seed, "trim", *keys), n - max_len + 1))
    return (
        rows.withColumn("pos", F.col("pos") - F.coalesce(start, F.lit(0)))
        .where((F.col("pos") >= 0) & (F.col("pos") < max_len))
        .withColumn("n_frames", F.least(n, F.lit(max_len).cast("bigint")))
    )


def add_position(
    df: DataFrame,
    strategy: str,
    name: str = "position",
    keys: Sequence[str] = SAMPLE,
    t: str = "t",
    day: str = "acq_date",
    block_size: int = BLOCK_ROWS,
) -> DataFrame:
    """Whole-number position in time of each frame, by strategy."""
    if strategy not in POSITION_STRATEGIES:
        raise ValueError(f"strategy must be one of {POSITION_STRATEGIES}")
    if strategy == "day-of-year":
        return df.withColumn(name, calendar.day_of_year(F.col(day)).cast("bigint"))
    if strategy == "absolute":
        return df.withColumn(name, calendar.days_since_reference(F.col(day)).cast("bigint"))
    if strategy == "enumeration":
        return number_rows(df, keys, [t], name, block=blocks_of(t, block_size))
    # The date of the first frame is a map-side combined minimum, not a window.
    first = df.groupBy(*keys).agg(F.min_by(day, t).alias("_first"))
    return (
        df.join(first, list(keys))
        .withColumn(name, F.datediff(F.col(day), F.col("_first")).cast("bigint"))
        .drop("_first")
    )


def slice_time(df: DataFrame, t_start: int, t_end: int, t: str = "t") -> DataFrame:
    """Frames with ``t_start <= t < t_end``."""
    return df.where((F.col(t) >= t_start) & (F.col(t) < t_end))


def pad_sequences(
    frames: DataFrame,
    values: dict[str, Column],
    length: int | None = None,
    batch: Sequence[str] = (),
    keys: Sequence[str] = SAMPLE,
    pos: str = "pos",
) -> DataFrame:
    """Extend every sequence to ``length``, or to the longest of its ``batch``.

    Added frames carry the given padding values and validity 0.
    """
    keys, batch = list(keys), list(batch)
    sizes = frames.groupBy(*batch, *keys).agg((F.max(pos) + 1).cast("int").alias("_n"))
    if length is not None:
        target = sizes.withColumn("_to", F.lit(length))
    elif batch:
        longest = sizes.groupBy(*batch).agg(F.max("_n").alias("_to"))
        target = sizes.join(longest, batch)
    else:
        target = sizes.withColumn("_to", sizes.agg(F.max("_n")).scalar())
    # Only the missing positions are generated; existing rows are not joined.
    padding = target.where(F.col("_to") > F.col("_n")).select(
        *batch,
        *keys,
        F.explode(F.sequence("_n", F.col("_to") - 1)).alias(pos),
    ).withColumn(pos, F.col(pos).cast("bigint"))
    filled = padding.withColumns({**values, "valid_obs": F.lit(0)})
    return frames.unionByName(filled, allowMissingColumns=True)


def best_by_objective(
    run_metrics: DataFrame, keys: Sequence[str] = ("metric",), larger: Column | None = None
) -> DataFrame:
    """Best run per metric, by what the metric measures; first name on ties.

    ``larger`` tells otherwise which rows are better the larger they are.
    """
    if larger is None:
        name = F.regexp_replace("metric", "^masked_", "")
        larger = name.isin(*sorted(LARGER_IS_BETTER))
    signed = F.when(larger, -F.col("value")).otherwise(F.col("value"))
    usable = F.col("value").isNotNull() & ~F.isnan("value")
    return (
        run_metrics.where(usable)
        .groupBy(*keys)
        .agg(F.min(F.struct(signed.alias("s"), "run", "value")).alias("_b"))
        .select(*keys, F.col("_b.run").alias("run"), F.col("_b.value").alias("value"))
    )
