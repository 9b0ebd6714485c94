"""Stored gap simulations: one target per sample, many mask runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.schema import MaskSettings
from rasterweave.sources.commits import commit, read_committed
from rasterweave.sources.settle import forget, settle

TARGET, MASKS = "target", "masks"
FRAME = ["sample_id", "pos"]
MASK_COLUMNS = ["run_key", "sample_id", "pos", "mask", "masked", "fully_masked"]


def run_key_ratios(run_key: Column) -> Column:
    """The ratios in a run key: masked frames, then fully masked ones if there are any."""
    numbers = F.regexp_extract_all(run_key, F.lit(r"(\d*\.\d+|\d+)"), 1)
    return F.transform(numbers, lambda n: n.cast("double"))


def earlier_draws(masks: DataFrame, settings: MaskSettings) -> DataFrame:
    """(sample_id, pos, masked, fully_masked) of the best matching earlier run per sample.

    A run with both ratios is reused as it is; failing that, one with the same ratio
    of masked frames gives these, and fully masked frames are left to be drawn (NULL).
    """
    wanted = [float(settings.ratio_masked_frames)]
    if settings.ratio_fully_masked_frames > 0:
        wanted.append(float(settings.ratio_fully_masked_frames))
    ratios = run_key_ratios(F.col("run_key"))
    same = ratios == F.array(*[F.lit(w) for w in wanted])
    runs = masks.where(F.get(ratios, F.lit(0)) == wanted[0]).withColumn("_same", same)
    best = runs.groupBy("sample_id").agg(
        F.min(F.struct((~F.col("_same")).alias("other"), "run_key")).alias("_b")
    )
    keep_full = F.when(~F.col("_b.other"), F.col("fully_masked"))
    return (
        runs.join(best.select("sample_id", "_b", F.col("_b.run_key").alias("run_key")), ["sample_id", "run_key"])
        .select("sample_id", "pos", "masked", keep_full.alias("fully_masked"))
    )


def not_yet_simulated(samples: DataFrame, masks: DataFrame, run_key: str) -> DataFrame:
    """Samples without masks of this run."""
    done = masks.where(F.col("run_key") == run_key).select("sample_id").distinct()
    return samples.join(done, "sample_id", "left_anti")


def target_differences(stored: DataFrame, renewed: DataFrame, columns: list[str]) -> DataFrame:
    """Frames present in both whose ``columns`` differ, and frames in one table only.

    Frames of samples that only one side has are no difference.
    """
    both = stored.select("sample_id").distinct().join(
        renewed.select("sample_id").distinct(), "sample_id", "left_semi"
    )
    a = stored.join(both, "sample_id", "left_semi").select(*FRAME, F.struct(*columns).alias("_a"))
    b = renewed.join(both, "sample_id", "left_semi").select(*FRAME, F.struct(*columns).alias("_b"))
    # Compared as they are: a hash would pass over NULL pixels.
    return a.join(b, FRAME, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*FRAME)


def write_simulation(
    spark: SparkSession, simulated: DataFrame, path: str, run_key: str, target: list[str]
) -> None:
    """Add one run: targets of new samples once, and this run's masks once.

    The simulation is evaluated once, into a staged table; the comparison and both
    parts start from there and become visible by one commit. A sample stored earlier must have
    the same target frames again; otherwise nothing is added and an error is raised. A run
    that is repeated adds the samples it lacks.
    """
    name = uuid.uuid4().hex
    columns = list(dict.fromkeys([*MASK_COLUMNS, *target]))
    staged = settle(simulated.withColumn("run_key", F.lit(run_key)).select(*columns))
    stored, masks = (read_committed(spark, path, kind) for kind in (TARGET, MASKS))
    new_target, new_masks = staged, staged
    if stored is not None:
        compared = [c for c in target if c not in FRAME]
        if not target_differences(stored, staged, compared).isEmpty():
            forget(staged)
            raise RuntimeError("the simulated targets differ from those stored by an earlier run")
        new_target = staged.join(stored.select("sample_id").distinct(), "sample_id", "left_anti")
        done = masks.where(F.col("run_key") == run_key).select("sample_id").distinct()
        new_masks = staged.join(done, "sample_id", "left_anti")
    out = lambda df: df.write.option("compression", "zstd")
    out(new_target.select(*dict.fromkeys([*FRAME, *target]))).parquet(f"{path}/{name}/{TARGET}")
    out(new_masks.select(*MASK_COLUMNS)).parquet(f"{path}/{name}/{MASKS}")
    commit(spark, path, name)
    forget(staged)


def read_masks(spark: SparkSession, path: str) -> DataFrame | None:
    """Masks of all complete runs; None if there is none."""
    return read_committed(spark, path, MASKS)


def read_simulation(spark: SparkSession, path: str, run_key: str) -> DataFrame:
    """Target frames with the masks of one run. Each write holds one run, so the others' row groups are passed over."""
    masks, stored = read_masks(spark, path), read_committed(spark, path, TARGET)
    if masks is None:
        raise ValueError(f"no complete simulation below {path}")
    return stored.join(masks.where(F.col("run_key") == run_key).drop("run_key"), FRAME)
