"""Metrics: definitions, strata and edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.operators import metrics as M
from rasterweave.operators.impute import SeriesFill
from rasterweave.operators.tiles import split_tiles
from rasterweave.plans import evaluate as E


def scored(spark, rows):
    """rows: (sample_id, mask, cloud, p0, p1, y0, y1)"""
    return spark.createDataFrame(
        rows, "sample_id string, mask int, cloud int, p0 double, p1 double, y0 double, y1 double"
    )


def run(df, **kw):
    return M.sample_metrics(df, ["p0", "p1"], ["y0", "y1"], **kw).first()


def test_definitions(spark):
    r = run(scored(spark, [("a", 0, 0, 0.5, 0.5, 0.4, 0.2), ("a", 1, 0, 0.1, 0.9, 0.1, 0.4)]))
    assert math.isclose(r.mae_all, (0.1 + 0.3 + 0.0 + 0.5) / 4)
    assert math.isclose(r.mse_occluded, 0.25 / 2)
    assert math.isclose(r.rmse_observed, math.sqrt((0.01 + 0.09) / 2))
    assert math.isclose(r.psnr_occluded, 20 * math.log10(1 / math.sqrt(0.125)))
    cos = (0.5 * 0.4 + 0.5 * 0.2) / (math.hypot(0.5, 0.5) * math.hypot(0.4, 0.2))
    assert math.isclose(r.sam_observed, math.acos(cos))


def test_perfect_prediction(spark):
    r = run(scored(spark, [("a", 0, 0, 0.3, 0.4, 0.3, 0.4)]))
    assert r.psnr_all == math.inf and r.mae_all == 0.0


def test_empty_stratum_is_null(spark):
    r = run(scored(spark, [("a", 0, 0, 0.3, 0.4, 0.3, 0.5)]))
    assert r.mae_occluded is None and r.sam_occluded is None and r.psnr_occluded is None


def test_zero_norm_is_skipped(spark):
    r = run(scored(spark, [("a", 0, 0, 0.0, 0.0, 0.3, 0.5)]))
    assert r.sam_all is None and r.mae_all == 0.4


def test_cloudy_target_is_dropped(spark):
    rows = [("a", 0, 0, 0.3, 0.4, 0.3, 0.5), ("a", 0, 1, 9.0, 9.0, 0.0, 0.0)]
    assert math.isclose(run(scored(spark, rows), cloud="cloud").mae_all, 0.05)


def test_missing_prediction(spark):
    rows = [("a", 1, 0, None, None, 0.3, 0.5), ("a", 1, 0, 0.3, 0.4, 0.3, 0.5)]
    assert math.isclose(run(scored(spark, rows)).mae_occluded, 0.05)
    r = run(scored(spark, rows), missing="null")
    assert r.mae_occluded is None and r.sam_all is None


def test_mean_over_samples(spark):
    df = spark.createDataFrame(
        [("mae", "all", 1.0, 1), ("mae", "all", 4.0, 2), ("mae", "gap", None, 1), ("mae", "gap", 2.0, 1)],
        "metric string, stratum string, value double, n int",
    )
    got = {r.stratum: (r["mean"], r.n) for r in M.mean_over_samples(df, weight="n").collect()}
    assert got == {"all": (3.0, 2), "gap": (2.0, 1)}
    stuck = {r.stratum: r["mean"] for r in M.mean_over_samples(df, empty="nan").collect()}
    assert math.isnan(stuck["gap"]) and stuck["all"] == 2.5


def test_long_form(spark):
    wide = run_wide = M.sample_metrics(
        scored(spark, [("a", 0, 0, 0.5, 0.5, 0.4, 0.2)]), ["p0", "p1"], ["y0", "y1"]
    )
    rows = M.to_long(run_wide, ["sample_id"], "masked_").collect()
    assert {(r.metric, r.stratum) for r in rows} == {
        (f"masked_{m}", s) for m in ("mae", "mse", "rmse", "psnr", "sam") for s in ("all", "observed")
    }
    assert len(M.to_long(wide, ["sample_id"], skip_missing=False).collect()) == 15


def brute_dssim(p, y):
    w = np.exp(-((np.arange(5) - 2) ** 2) / (2 * 1.5**2))
    k = np.outer(w, w) / np.outer(w, w).sum()

    def f(a):
        out = np.zeros_like(a)
        wide = np.pad(a, 2)
        for i in range(a.shape[0]):
            for j in range(a.shape[1]):
                out[i, j] = (wide[i : i + 5, j : j + 5] * k).sum()
        return out

    mp, my = f(p), f(y)
    sp, sy, spy = f(p * p) - mp**2, f(y * y) - my**2, f(p * y) - mp * my
    s = (2 * mp * my + 1e-4) * (2 * spy + 9e-4) / ((mp**2 + my**2 + 1e-4) * (sp + sy + 9e-4))
    return np.clip(1 - s, 0, 1).mean() / 2


def test_ssim_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in range(3):
        p, y = rng.random((6, 9)), rng.random((6, 9))
        rows.append(("a", t, 6, 9, p.ravel().tolist(), y.ravel().tolist(), [int(t == 1)] * 54, float(brute_dssim(p, y))))
    df = spark.createDataFrame(
        rows, "sample_id string, t int, height int, width int, p array<double>, y array<double>, mask array<int>, want double"
    )
    got = M.frame_dssim(df, ["p"], ["y"])
    assert got.where(F.abs(F.col("dssim") - F.col("want")) > 1e-12).isEmpty()
    r = M.sample_ssim(df, ["p"], ["y"]).first()
    assert math.isclose(r.ssim_occluded, 1 - 2 * rows[1][-1])
    assert math.isclose(r.ssim_all, 1 - 2 * np.mean([x[-1] for x in rows]))
    same = M.sample_ssim(df, ["p"], ["p"]).first()
    assert math.isclose(same.ssim_all, 1.0)


@pytest.mark.parametrize("unit,factor", [("rad", 1.0), ("deg", 180 / math.pi)])
def test_angle_units(spark, unit, factor):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(M.angle_of_arrays(F.col("a"), F.col("b"), unit)).first()[0]
    assert math.isclose(got, math.pi / 4 * factor)


def test_total_loss(spark):
    df = scored(spark, [("a", 0, 0, 0.5, 0.5, 0.4, 0.2), ("a", 1, 1, 0.1, 0.9, 0.1, 0.4)])
    terms = M.loss_terms(df, ["p0", "p1"], ["y0", "y1"], cloud="cloud")
    r = M.total_loss(terms, {"l1_loss": 1.0, "masked_l1_loss": 2.0}).first()
    assert math.isclose(r.total_loss, r.l1_loss + 2 * r.masked_l1_loss)
    assert math.isclose(r.masked_l1_loss, 0.2) and math.isclose(r.l1_loss_occluded_input_pixels, 0.25)


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for sample in ("a", "b"):
        for t in range(6):
            y = rng.random((2, 11 * 13))
            mask = (rng.random(11 * 13) < (0.4 if t % 2 else 0.0)).astype(int)
            cloud = (rng.random(11 * 13) < 0.2).astype(int)
            rows.append((sample, t, f"2018-01-{5 * t + 1:02d}", 11, 13, *y.tolist(), mask.tolist(), cloud.tolist()))
    df = spark.createDataFrame(
        rows, "sample_id string, t int, acq_date string, height int, width int, b0 array<double>, b1 array<double>, mask array<int>, cloud_mask array<int>"
    )
    return df.withColumn("acq_date", F.to_date("acq_date"))


def by_key(df):
    return {(r["method"], r["sample_id"]): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("side", [3, 5, 64])
def test_tiles_score_like_whole_frames(spark, gappy, side):
    """No tile edge shows: sums equal those of blocks, SSIM equals that of whole filled frames."""
    got = by_key(E.score_modes_tiles(gappy, ["b0", "b1"], side=side))
    plain = by_key(E.score_modes_arrays(gappy, ["b0", "b1"]))
    assert got.keys() == plain.keys() and len(got) == 8
    for key, row in plain.items():
        for name, value in row.items():
            if isinstance(value, float):
                assert math.isclose(got[key][name], value, rel_tol=1e-9, abs_tol=1e-7), name
    sample = [r for r in gappy.orderBy("sample_id", "t").collect() if r.sample_id == "a"]
    mask = np.array([r["mask"] for r in sample])
    fill = SeriesFill(mask == 1, np.array([5.0 * r["t"] for r in sample]))
    made = zip(*[fill(["last", "next"], np.array([r[b] for r in sample])) for b in ("b0", "b1")])
    for mode, preds in zip(("last", "next"), made):
        d = np.stack([
            M.dissimilarity(p.reshape(-1, 11, 13), np.array([r[b] for r in sample]).reshape(-1, 11, 13)) for p, b in zip(preds, ("b0", "b1"))
        ])
        frames = np.array([np.nanmean(d[:, t]) if not np.isnan(d[:, t]).all() else np.nan for t in range(6)])
        assert math.isclose(got[mode, "a"]["ssim_all"], 1 - 2 * np.nanmean(frames), rel_tol=1e-9)
        assert math.isclose(got[mode, "a"]["ssim_occluded"], 1 - 2 * np.nanmean(frames[mask.any(1)]), rel_tol=1e-9)


def test_tiles_cover_each_pixel_once(spark, gappy):
    numbered = gappy.limit(1).withColumn("b0", F.transform("b0", lambda v, i: i.cast("double")))
    for side, halo in ((4, 2), (13, 1), (1, 0), (50, 3)):
        seen = []
        for r in split_tiles(numbered, ["b0"], ["t"], side, halo).collect():
            cells = np.array(r.b0).reshape(-1, r.full_w)
            seen += cells[r.top : r.top + r.own_h, r.left : r.left + r.own_w].ravel().tolist()
        assert sorted(seen) == list(range(11 * 13))
    with pytest.raises(ValueError):
        split_tiles(gappy, ["b0"], ["t"], 0)


def test_predictor_that_is_right_scores_perfectly(spark, gappy):
    frames = gappy.withColumns({"pos": F.col("t"), "b0_in": F.col("b0"), "b1_in": F.col("b1")})
    copied = lambda pdf: pdf[["sample_id", "k", "t"]].assign(p_b0=pdf["b0_in"], p_b1=pdf["b1_in"])
    rows = E.score_predictor(frames, ["b0", "b1"], copied, 4).collect()
    assert {r.sample_id for r in rows} == {"a", "b"}
    for r in rows:
        assert r.mae_all == 0 and r.psnr_occluded == math.inf and math.isclose(r.ssim_all, 1.0)
    shifted = lambda pdf: copied(pdf).assign(p_b0=pdf["b0_in"].map(lambda v: v + 0.1))
    assert all(math.isclose(r.mae_all, 0.05) for r in E.score_predictor(frames, ["b0", "b1"], shifted, 4).collect())


def test_means_do_not_depend_on_how_rows_are_dealt_out(spark):
    rng = np.random.default_rng(2)
    rows = [("m", str(i % 3), float(v), float(w)) for i, (v, w) in enumerate(zip(rng.normal(0, 1e5, 3000) ** 3 / 1e5, rng.random(3000)))]
    df = spark.createDataFrame(rows, "metric string, stratum string, value double, w double")
    keys = ["metric", "stratum"]
    seen = set()
    for n in (1, 3, 16):
        whole = M.mean_over_samples(df.repartition(n), weight="w")
        halves = [M.mean_states(df.where(t).repartition(n), keys, weight="w") for t in ("w < 0.3", "w >= 0.3")]
        merged = M.means_of_states(M.merge_states(halves[0].union(halves[1]), keys), keys)
        seen |= {tuple(sorted(map(tuple, d.collect()))) for d in (whole, merged)}
    assert len(seen) == 1
    means = {r.stratum: r["mean"] for r in M.mean_over_samples(df, weight="w").collect()}
    for s, mean in means.items():
        mine = [(v, w) for _, g, v, w in rows if g == s]
        assert math.isclose(mean, math.fsum(v * w for v, w in mine) / math.fsum(w for _, w in mine), rel_tol=1e-12)


def test_states_of_odd_values(spark):
    rows = [("a", None), ("a", float("nan")), ("a", 2.0), ("b", float("inf")), ("b", 1.0), ("c", None), ("d", 1e25), ("d", 3e25)]
    df = spark.createDataFrame(rows, "metric string, value double").withColumn("stratum", F.lit("all"))
    got = {r.metric: (r["mean"], r.n) for r in M.mean_over_samples(df).collect()}
    assert got == {"a": (2.0, 1), "b": (math.inf, 2), "c": (None, 0), "d": (2e25, 2)}
