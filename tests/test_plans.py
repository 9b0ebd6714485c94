"""What the physical plans must look like."""

from __future__ import annotations

import __spark_entry__ as entry
from pyspark.sql import functions as F

from rasterweave.operators.impute import impute
from rasterweave.operators.quality import flag_frames, frame_statistics_arrays, good_only
from rasterweave.plans.evaluate import impute_pixels, score_modes, score_modes_arrays
from rasterweave.sources.driver_tables import scene_frames
from tests.test_impute import raster


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frame_quality_has_no_shuffle_and_no_python(spark, sf_dir):
    p = plan(flag_frames(frame_statistics_arrays(scene_frames(spark, sf_dir))))
    assert "Exchange" not in p and "Python" not in p and "Pandas" not in p


def test_all_modes_share_one_shuffle(spark):
    p = plan(impute_pixels(raster(spark), ["b0", "b1"]))
    assert p.count("Exchange") == 1 and "Python" not in p


def test_scores_add_only_a_shuffle_of_sums(spark):
    p = plan(score_modes(raster(spark), ["b0", "b1"]))
    assert p.count("Exchange") == 2
    assert plan(score_modes_arrays(raster(spark), ["b0", "b1"])).count("Exchange") == 2


def test_band_selection_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "f")
    raster(spark).write.parquet(path)
    p = plan(impute_pixels(spark.read.parquet(path), ["b1"], ["last"]))
    scan = p[p.index("ReadSchema") :].splitlines()[0]
    assert "b1" in scan and "b0" not in scan


def test_time_filter_is_pushed(spark, tmp_path):
    path = str(tmp_path / "f")
    raster(spark).write.parquet(path)
    p = plan(spark.read.parquet(path).where(F.col("t") < 2).select("sample_id", "b0"))
    assert "PushedFilters: [IsNotNull(t), LessThan(t,2)]" in p


def test_blocked_fill_never_windows_over_the_bare_key(spark):
    df = raster(spark).select("sample_id", "t", F.col("height").alias("day"), F.lit(0).alias("mask"), F.lit(1.0).alias("v"))
    p = plan(impute(df, ["v"], ["linear"], keys=["sample_id"], block_size=2))
    # Rows are windowed by (key, block); only block summaries by key.
    assert "_block" in p


def test_no_cartesian_products(spark, sf_dir):
    for name in ("tile_counts", "valid_sequences", "pad_sequences", "split_by_tile", "window_plan", "ssim"):
        p = plan(entry.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_good_frames_are_told_without_a_join(spark, sf_dir):
    frames = scene_frames(spark, sf_dir)
    good = good_only(frames)
    assert "Exchange" not in plan(good) and good.columns == frames.columns
    flagged = flag_frames(frame_statistics_arrays(frames))
    want = flagged.where("valid_obs = 1").select("sample_id", "t")
    assert good.select("sample_id", "t").exceptAll(want).isEmpty()
    assert good.count() == want.count()
