"""Fills along time: edge cases, properties, and agreement of the layouts."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from rasterweave.functions.grids import explode_pixels
from rasterweave.operators.impute import impute, impute_frames, last_visible
from rasterweave.operators.scans import number_rows, runs, with_neighbours
from rasterweave.plans.evaluate import score_modes, score_modes_arrays
from tests.compare import spark_rows

MODES = ["last", "next", "closest", "linear"]


def series(spark, rows):
    """rows: (sample_id, t, day, mask, v)"""
    return spark.createDataFrame(rows, "sample_id string, t int, day int, mask int, v double")


def filled(spark, rows, **kw):
    out = impute(series(spark, rows), ["v"], keys=["sample_id"], **kw)
    return [tuple(r) for r in out.orderBy("t").select(*[f"v_{m}" for m in MODES]).collect()]


def test_never_observed(spark):
    assert filled(spark, [("a", 0, 0, 1, 5.0), ("a", 1, 5, 1, 6.0)]) == [(None,) * 4] * 2


def test_gap_at_either_end(spark):
    rows = [("a", 0, 0, 1, 9.0), ("a", 1, 5, 0, 1.0), ("a", 2, 10, 1, 9.0)]
    assert filled(spark, rows) == [(None, 1, 1, 1), (1, 1, 1, 1), (1, None, 1, 1)]


def test_equal_distance_takes_past(spark):
    rows = [("a", 0, 0, 0, 1.0), ("a", 1, 5, 1, 0.0), ("a", 2, 10, 0, 3.0)]
    assert filled(spark, rows)[1] == (1.0, 3.0, 1.0, 2.0)


def test_linear_weights_by_days(spark):
    rows = [("a", 0, 0, 0, 0.0), ("a", 1, 9, 1, 7.0), ("a", 2, 12, 0, 4.0)]
    assert filled(spark, rows)[1] == (0.0, 4.0, 4.0, 3.0)


def test_neighbours_on_one_day(spark):
    rows = [("a", 0, 3, 0, 1.0), ("a", 1, 3, 1, 7.0), ("a", 2, 3, 0, 4.0)]
    assert filled(spark, rows)[1] == (1.0, 4.0, 1.0, 1.0)


def test_source_index(spark):
    rows = [("a", 0, 0, 0, 1.0), ("a", 1, 9, 1, 7.0), ("a", 2, 10, 0, 4.0)]
    out = impute(series(spark, rows), ["v"], keys=["sample_id"], return_source=True)
    row = out.where("t = 1").first()
    assert (row.source_last, row.source_next, row.source_closest) == (0, 2, 2)
    assert (row.source_linear_prev, row.source_linear_next) == (0, 2)


def test_unknown_mode_and_missing_day(spark):
    df = series(spark, [("a", 0, 0, 0, 1.0)])
    with pytest.raises(ValueError):
        impute(df, ["v"], ["cubic"])
    with pytest.raises(ValueError):
        impute(df, ["v"], ["linear"], day=None)


def gappy(spark, n=400):
    """Three keys; one of them holds most rows, with gaps longer than a block."""
    h = F.pmod(F.xxhash64("id"), F.lit(100))
    return (
        spark.range(n)
        .select(
            F.when(F.col("id") < n * 3 // 4, "hot").when(F.col("id") % 2 == 0, "a").otherwise("b").alias("sample_id"),
            "id",
            (h / 100).alias("v"),
            F.when((F.col("id").between(40, 90)) | (h < 45), 1).otherwise(0).alias("mask"),
        )
        .withColumn("day", (F.col("id") * 3 + h % 3).cast("int"))
    )


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocked_scan_equals_plain(spark, block):
    df = number_rows(gappy(spark), ["sample_id"], ["id"], "t", block=F.lit(0))
    cut = number_rows(
        gappy(spark), ["sample_id"], ["id"], "t", block=F.floor(F.col("id") / 13)
    )
    assert spark_rows(df) == spark_rows(cut)
    one = impute(df, ["v"], keys=["sample_id"])
    two = impute(df, ["v"], keys=["sample_id"], block_size=block)
    assert spark_rows(one) == spark_rows(two)
    linked = lambda row, before: row["t"] - before["t"] == 1
    by_block = F.floor(F.col("t") / block)
    a = runs(df, ["sample_id"], "t", F.col("mask") == 1, linked, block=F.lit(0))
    b = runs(df, ["sample_id"], "t", F.col("mask") == 1, linked, block=by_block)
    # Blocks without members may add rows of no run.
    assert spark_rows(a.where("run_len > 0")) == spark_rows(b.where("run_len > 0"))
    assert a.select("sample_id").distinct().count() == b.select("sample_id").distinct().count()


@pytest.mark.parametrize("block", [1, 3, 10, 100])
def test_runs_against_a_plain_scan(spark, block):
    """Links that skip rows that are no members, and look at a payload; also keys without members."""
    rng = random.Random(block)
    rows, want = [], []
    for s in range(6):
        days, last, run = 0, None, None
        for t in range(rng.randrange(1, 40)):
            days += rng.randrange(1, 9)
            ok = int(s != 5 and rng.random() < 0.6)
            rows.append((s, t, days, ok))
            if not ok:
                continue
            if last is not None and days - last <= 7:
                run[1:] = [t, run[2] + 1]
            else:
                run = [t, t, 1]
                want.append((s, run))
            last = days
    df = spark.createDataFrame(rows, "s int, t int, day int, ok int").repartition(3)
    near = lambda row, before: row["day"] - before["day"] <= 7
    got = runs(df, ["s"], "t", F.col("ok") == 1, near, ["day"], block=F.floor(F.col("t") / block))
    found = sorted(tuple(r) for r in got.where("run_len > 0").select("s", "run_start", "run_end", "run_len").collect())
    assert found == sorted((s, *r) for s, r in want)
    assert {r.s for r in got.collect()} == {r[0] for r in rows}


def test_exclusive_neighbours(spark):
    df = series(spark, [("a", i, i, 0, float(i)) for i in range(5)])
    out = with_neighbours(
        df, ["sample_id"], ["t"], F.lit(True), ["t"], inclusive=False, block=F.floor(F.col("t") / 2)
    )
    got = [(r.prev and r.prev.t, r.next and r.next.t) for r in out.orderBy("t").collect()]
    assert got == [(None, 1), (0, 2), (1, 3), (2, 4), (3, None)]


def test_properties(spark):
    df = number_rows(gappy(spark), ["sample_id"], ["id"], "t", block=F.lit(0))
    out = impute(last_visible(df, keys=["sample_id"]), ["v"], keys=["sample_id"])
    visible = F.col("mask") == 0
    kept = F.lit(True)
    for m in MODES:
        kept = kept & (F.col(f"v_{m}") == F.col("v"))
    assert out.where(visible & ~kept).isEmpty()
    between = F.col("v_linear").between(
        F.least("v_last", "v_next") - 1e-12, F.greatest("v_last", "v_next") + 1e-12
    )
    assert out.where(~between).isEmpty()
    ordered = (F.col("last_visible") <= F.col("t")) & (F.col("t") <= F.col("next_visible"))
    assert out.where(~ordered).isEmpty()


def raster(spark, samples=3, frames=7, h=3, w=5):
    n = h * w
    cell = F.sequence(F.lit(0), F.lit(n - 1))
    noise = lambda k, i: F.pmod(F.xxhash64(F.lit(k), F.col("id"), i), F.lit(1000)) / 1000
    df = spark.range(samples * frames).select(
        "id", F.floor(F.col("id") / frames).alias("sample_id"), (F.col("id") % frames).alias("t")
    )
    df = df.withColumns(
        {
            "acq_date": F.date_add(F.lit("2018-01-01").cast("date"), (F.col("id") * 4 + F.col("id") % 3).cast("int")),
            "height": F.lit(h),
            "width": F.lit(w),
            "b0": F.transform(cell, lambda i: noise(0, i)),
            "b1": F.transform(cell, lambda i: noise(1, i)),
            "mask": F.transform(cell, lambda i: (noise(2, i) < 0.4).cast("tinyint")),
            "cloud_mask": F.transform(cell, lambda i: (noise(3, i) < 0.1).cast("tinyint")),
        }
    )
    return df.drop("id")


def test_array_layout_equals_pixels(spark):
    frames = raster(spark).withColumn("day", F.unix_date("acq_date"))
    bands = ["b0", "b1"]
    pixels = explode_pixels(frames, [*bands, "mask"], ["sample_id", "t", "day"])
    cols = [f"{b}_{m}" for b in bands for m in MODES]
    want = impute(pixels, bands).select(
        "sample_id", "t", (F.col("y") * 5 + F.col("x")).alias("p"), *[F.round(c, 9).alias(c) for c in cols]
    )
    blocks = impute_frames(frames, bands, block_pixels=4)
    got = blocks.select(
        "sample_id", "t", "block", F.posexplode(F.arrays_zip(*cols)).alias("i", "v")
    ).select(
        "sample_id",
        "t",
        (F.col("block") * 4 + F.col("i")).cast("int").alias("p"),
        *[F.round(f"v.{c}", 9).alias(c) for c in cols],
    )
    assert spark_rows(want) == spark_rows(got)


@pytest.mark.parametrize("cloudless_only", [True, False])
def test_array_scores_equal_pixel_scores(spark, cloudless_only):
    frames = raster(spark)
    one = score_modes(frames, ["b0", "b1"], masked_metrics=cloudless_only)
    two = score_modes_arrays(frames, ["b0", "b1"], masked_metrics=cloudless_only, block_pixels=4)
    a = {(r.method, r.sample_id): r.asDict() for r in one.collect()}
    b = {(r.method, r.sample_id): r.asDict() for r in two.collect()}
    assert a.keys() == b.keys() and len(a) == 12
    for k in a:
        for c, v in a[k].items():
            if isinstance(v, float):
                assert math.isclose(v, b[k][c], rel_tol=1e-9, abs_tol=1e-9), (k, c)
            else:
                assert v == b[k][c]
