"""Gap simulation: quotas, exclusions, donors, masks and fills."""

from __future__ import annotations

import math
from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterweave.functions.hashing import hash_hex
from rasterweave.operators import gaps
from rasterweave.operators.geometry import dilate
from rasterweave.operators.joins import spread_join
from rasterweave.operators.quality import occlude
from rasterweave.plans.simulate import simulate_gaps
from rasterweave.schema import MaskSettings
from tests.compare import spark_rows

FIXED = MaskSettings(ratio_masked_frames=0.5, fixed_masking_ratio=True)


def frames(spark, lengths: dict[str, int], tile="T"):
    rows = [(s, tile, t, t) for s, n in lengths.items() for t in range(n)]
    return spark.createDataFrame(rows, "sample_id string, tile string, t bigint, pos bigint")


def drawn(df, col="masked"):
    out = {}
    for r in df.where(F.col(col) == 1).collect():
        out.setdefault(r.sample_id, set()).add(r.pos)
    return out


def test_quota_is_rounded_up(spark):
    lengths = {"a": 1, "b": 5, "c": 10, "d": 13}
    got = drawn(gaps.sample_masked_frames(frames(spark, lengths), FIXED))
    assert {s: len(p) for s, p in got.items()} == {s: math.ceil(0.5 * n) for s, n in lengths.items()}


def test_excluded_positions_and_cap(spark):
    settings = replace(FIXED, ratio_masked_frames=1.0, non_masked_frames=(0, -1))
    got = drawn(gaps.draw_masked(frames(spark, {"a": 5, "b": 2}), settings))
    assert got == {"a": {1, 2, 3}}


def test_varying_ratio_masks_at_least_one(spark):
    settings = replace(FIXED, fixed_masking_ratio=False)
    got = drawn(gaps.draw_masked(frames(spark, {f"s{i}": 8 for i in range(30)}), settings))
    sizes = {len(p) for p in got.values()}
    assert len(got) == 30 and min(sizes) >= 1 and max(sizes) <= 4 and len(sizes) > 1


def test_fully_masked_is_a_subset(spark):
    settings = replace(FIXED, ratio_fully_masked_frames=0.3)
    df = gaps.sample_masked_frames(frames(spark, {"a": 10, "b": 7}), settings)
    masked, full = drawn(df), drawn(df, "fully_masked")
    assert {s: len(p) for s, p in full.items()} == {"a": 3, "b": 3}
    assert all(full[s] <= masked[s] for s in full)


def test_ranking_is_that_of_the_plain_window(spark):
    df = frames(spark, {"hot": 300, "a": 4})
    h = hash_hex(0, "mask", "sample_id", "pos")
    want = df.select("sample_id", "pos", (F.row_number().over(Window.partitionBy("sample_id").orderBy(h)) - 1).alias("rank"))
    got = gaps._ranked(df, ["sample_id"], F.lit(True), h, "rank").select("sample_id", "pos", F.col("rank").cast("int"))
    assert spark_rows(want) == spark_rows(got)


def test_earlier_run_is_reused(spark):
    df = frames(spark, {"a": 6, "b": 6})
    first = gaps.sample_masked_frames(df, FIXED)
    earlier = first.where("sample_id = 'a'").select(
        "sample_id", "pos", "masked", F.lit(None).cast("int").alias("fully_masked")
    )
    again = gaps.sample_masked_frames(
        df, replace(FIXED, seed=99, ratio_fully_masked_frames=0.2), earlier
    )
    assert drawn(again)["a"] == drawn(first)["a"]
    assert drawn(again, "fully_masked")["a"] <= drawn(first)["a"]


def test_spread_join_equals_join(spark):
    left = spark.range(500).select("id", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7).alias("k"))
    right = spark.range(6).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    left = left.withColumn("k", F.col("k").cast("int"))
    want = left.join(right, "k", "left").select("id", "k", "v")
    got = spread_join(left, right, ["k"], ["id"], rows_per_copy=20).select("id", "k", "v")
    assert spark_rows(want) == spark_rows(got)


def coverage(spark):
    rows = [("T", "a", 0, 0.0), ("T", "a", 1, 0.5), ("T", "b", 0, 0.1), ("U", "c", 0, 0.05)]
    return spark.createDataFrame(rows, "tile string, sample_id string, t bigint, coverage double")


@pytest.mark.parametrize("draw", ["frame", "sample"])
def test_donors_come_from_the_tile(spark, draw):
    donors = gaps.donor_index(coverage(spark), 0.1, draw=draw)
    masked = frames(spark, {f"s{i}": 6 for i in range(10)}).unionByName(frames(spark, {"u": 2}, "U"))
    out = gaps.draw_donors(masked, donors, draw=draw)
    assert out.count() == 62
    got = {(r.tile, r.donor_sample, r.donor_t) for r in out.collect()}
    assert got == {("T", "a", 1), ("T", "b", 0), ("U", None, None)}
    assert [r.tile for r in gaps.tiles_without_donor(masked, donors).collect()] == ["U"]


def test_dilation_stops_at_the_border(spark):
    df = spark.createDataFrame([([0, 0, 1, 0, 0, 0],)], "mask array<int>").withColumns(
        {"height": F.lit(2), "width": F.lit(3)}
    )
    assert dilate(df, "mask").first().mask == [0, 1, 1, 0, 0, 1]
    assert dilate(df, "mask", 2).first().mask == [1, 1, 1, 0, 1, 1]


def test_occlusion_is_strict(spark):
    df = spark.createDataFrame([([1, 0],), ([1, 1],), ([0, 0],)], "m array<tinyint>")
    assert [r[0] for r in df.select(occlude(F.col("m"), 0.5)).collect()] == [[1, 0], [1, 1], [0, 0]]
    assert df.select(occlude(F.col("m"), 0.4)).first()[0] == [1, 1]
    assert df.select(occlude(F.col("m"), 0.0)).first()[0] == [1, 0]


def test_noise_is_added_repeatable_and_bounded(spark):
    df = spark.createDataFrame([("a", 0, [0.2] * 50, [1] * 25 + [0] * 25)], "sample_id string, t int, b0 array<double>, mask array<int>")
    one = gaps.fill_gaps(df, ["b0"], "white_noise").first().b0
    assert one == gaps.fill_gaps(df, ["b0"], "white_noise").first().b0
    assert one[25:] == [0.2] * 25 and all(0.2 <= v <= 1.2 for v in one) and len(set(one[:25])) > 5


def test_mean_fill(spark):
    df = spark.createDataFrame(
        [("a", 0, [1.0, 3.0], [0, 1], 1), ("a", 1, [2.0, 9.0], [0, 0], 0)],
        "sample_id string, t int, b0 array<double>, mask array<int>, valid_obs int",
    )
    rows = gaps.fill_gaps(df, ["b0"], "mean", valid="valid_obs").orderBy("t").collect()
    assert [r.b0 for r in rows] == [[1.0, 1.0], [2.0, 9.0]]
    with pytest.raises(ValueError):
        gaps.fill_gaps(df, ["b0"], "median")


def test_split_keeps_tiles_whole(spark):
    samples = spark.range(200).select((F.col("id") * F.col("id") % 23).alias("tile"), F.col("id").alias("sample_id"))
    out = gaps.split_by_tile(samples, 50, seed=3).collect()
    assert len(out) == samples.select("tile").distinct().count()
    train = sum(r.n_samples for r in out if r.split == "train")
    biggest = max(r.n_samples for r in out)
    assert 150 <= train < 150 + biggest


def test_overlay_in_order_when_complete(spark):
    df = frames(spark, {"a": 3}).withColumns({"height": F.lit(1), "width": F.lit(2)})
    masks = spark.createDataFrame([("a", i, [i, 0]) for i in range(3)], "sample_id string, mask_no int, mask array<tinyint>")
    rows = gaps.overlay_masks(df, masks).orderBy("pos").collect()
    assert [r.mask for r in rows] == [[0, 0], [1, 0], [2, 0]]
    some = gaps.overlay_masks(df, masks.where("mask_no > 0").withColumn("mask_no", F.col("mask_no") - 1)).collect()
    assert sorted(r.mask[0] for r in some) == [0, 1, 2]


def test_simulation_is_repeatable(spark):
    from tests.test_impute import raster

    df = raster(spark, samples=4, frames=6).withColumn("tile", F.col("sample_id") % 2).drop("mask")
    chosen = df.select("sample_id", "tile", "t", F.col("t").alias("pos"), F.lit(6).cast("bigint").alias("n_frames"), F.lit(1).alias("valid_obs"))
    cover = df.select("tile", "sample_id", "t", occlude(F.col("cloud_mask"), None).alias("m")).withColumn(
        "coverage", F.aggregate("m", F.lit(0.0), lambda s, v: s + v) / F.size("m")
    ).drop("m")
    settings = MaskSettings(min_donor_coverage=0.05, ratio_fully_masked_frames=0.2, apply_full=True)
    run = lambda: spark_rows(simulate_gaps(df, chosen, cover, ["b0"], settings).select("sample_id", "t", "masked", "fully_masked", F.col("mask").cast("string"), F.col("b0_in").cast("string")))
    first = run()
    assert first == run()
