"""Window planning and stitching against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.operators import attention, windows


def expected_plan(cover, window):
    """Direct reading of the rules, over a whole list."""
    n = len(cover)
    out = [(0, min(window, n))]
    while out[-1][1] < n:
        due = out[-1][0] + window // 2
        if due + window > n:
            start = n - window
        elif cover[due] <= 0.1:
            start = due
        else:
            reach = math.ceil((window // 2) / 2)
            near = list(range(max(0, due - reach), min(due + reach + 1, n)))
            least = min(cover[i] for i in near)
            start = min((i for i in near if cover[i] == least), key=lambda i: abs(i - due))
        start = min(start, n - window)
        out.append((start, start + window))
    return out


def covers(seed=0, samples=25):
    rng = random.Random(seed)
    return {
        f"s{i:02d}": [rng.choice([0.0, 0.05, 0.2, 0.5, 0.5, 0.9]) for _ in range(rng.randint(1, 60))]
        for i in range(samples)
    }


def coverage_table(spark, data):
    rows = [(s, t, c) for s, cs in data.items() for t, c in enumerate(cs)]
    return spark.createDataFrame(rows, "sample_id string, t int, coverage double")


@pytest.mark.parametrize("window,block", [(4, 4096), (5, 3), (10, 8), (10, 1), (4, 7)])
def test_plan(spark, window, block):
    data = covers()
    got = {}
    for r in windows.plan_windows(coverage_table(spark, data), window, block=block).collect():
        got.setdefault(r.sample_id, []).append((r.k, r.t_start, r.t_end))
    want = {s: [(k, *w) for k, w in enumerate(expected_plan(c, window))] for s, c in data.items()}
    assert {s: sorted(v) for s, v in got.items()} == want


def test_small_window_is_refused(spark):
    with pytest.raises(ValueError):
        windows.plan_windows(coverage_table(spark, {"a": [0.0]}), 3)


def test_plan_of_one_very_long_sequence(spark):
    """A million frames of one sample: no task sees more than a block of them."""
    n = 1_000_000
    noise = F.pmod(F.xxhash64("id"), F.lit(7)).cast("int")
    frames = spark.range(n).select(F.lit("a").alias("sample_id"), F.col("id").alias("t"), (noise / 10.0).alias("coverage"))
    cover = [r.coverage for r in frames.select("t", "coverage").orderBy("t").toLocalIterator()]
    plan = windows.plan_windows(frames, 12, block=20_000)
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in plan.orderBy("k").select("k", "t_start", "t_end").collect()]
    assert got == [(k, *w) for k, w in enumerate(expected_plan(cover, 12))]


def expected_stitch(plan, preds, n):
    """preds[k]: array (frames of window k, pixels)."""
    out = np.zeros((n, preds[0].shape[1]))
    for k, (a, b) in enumerate(plan):
        if k == 0:
            out[a:b] = preds[0]
            continue
        common = range(a, plan[k - 1][1])
        err = [np.abs(out[t] - preds[k][t - a]).mean() for t in common]
        switch = a + int(np.argmin(err))
        out[switch:b] = preds[k][switch - a :]
    return out


@pytest.mark.parametrize("window,chunk", [(4, 256), (7, 1), (7, 2), (13, 3)])
def test_stitch(spark, window, chunk):
    data = covers(3, 12)
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for s, c in data.items():
        plan = expected_plan(c, window)
        preds = [rng.integers(0, 100, (b - a, 3)) / 100.0 for a, b in plan]
        want[s] = expected_stitch(plan, preds, len(c))
        for k, (a, b) in enumerate(plan):
            rows += [(s, k, t, preds[k][t - a].tolist()) for t in range(a, b)]
    scored = spark.createDataFrame(rows, "sample_id string, k bigint, t bigint, p array<double>")
    plan = windows.plan_windows(coverage_table(spark, data), window)
    got = windows.stitch_windows(scored, plan, ["p"], chunk=chunk).collect()
    assert len(got) == sum(len(c) for c in data.values())
    for r in got:
        assert np.allclose(r.p, want[r.sample_id][r.t]), (r.sample_id, r.t)


def test_same_predictor_everywhere_gives_its_values(spark):
    data = covers(5, 6)
    frames = coverage_table(spark, data).withColumn("b0", F.array(F.col("t") * 1.0, F.col("coverage")))
    plan = windows.plan_windows(coverage_table(spark, data), 6)
    scored = windows.score_windows(
        frames, plan, lambda pdf: pdf[["sample_id", "k", "t", "b0"]],
        "sample_id string, k bigint, t bigint, b0 array<double>",
    )
    out = windows.stitch_windows(scored, plan, ["b0"])
    back = out.join(frames.select("sample_id", "t", F.col("b0").alias("want")), ["sample_id", "t"])
    assert back.count() == frames.count() and back.where(F.col("b0") != F.col("want")).isEmpty()


def softmax(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@pytest.mark.parametrize("n_head,block", [(1, 256), (2, 256), (2, 2), (1, 1)])
def test_attention(spark, monkeypatch, n_head, block):
    monkeypatch.setattr(attention, "FAN", 2)
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for s, n in enumerate((3, 9, 3)):
        q, k, v = rng.random((n, 4)), rng.random((n, 4)), rng.random((n, 6))
        ok = np.arange(n) != n - 1
        parts, mean_w = [], []
        d = 4 // n_head
        for h in range(n_head):
            score = q[:, h * d : (h + 1) * d] @ k[:, h * d : (h + 1) * d].T / np.sqrt(d)
            w = softmax(np.where(ok[None, :], score, -1000.0))
            mean_w.append(w)
            parts.append(w @ v[:, h * 6 // n_head : (h + 1) * 6 // n_head])
        want[s] = (np.concatenate(parts, 1), (np.mean(mean_w, 0) * ok[None, :]) @ v)
        rows += [(s, 0, 0, t, bool(ok[t]), q[t].tolist(), k[t].tolist(), v[t].tolist()) for t in range(n)]
    df = spark.createDataFrame(
        rows, "sample_id int, y int, x int, t int, ok boolean, q array<double>, k array<double>, v array<double>"
    )
    for r in attention.temporal_attention(df, n_head=n_head, valid="ok", block=block).collect():
        assert np.allclose(r.attended, want[r.sample_id][0][r.t])
    weights = attention.attention_weights(df, n_head=n_head, valid="ok", block=block)
    assert weights.where(F.size("attention") > n_head * block * block).isEmpty()
    for r in attention.apply_attention(weights, df, n_head=n_head, mode="mean", valid="ok", block=block).collect():
        assert np.allclose(r.attended, want[r.sample_id][1][r.t])
    with pytest.raises(ValueError):
        attention.apply_attention(weights, df, mode="max")


def test_attention_with_extreme_scores(spark):
    """Scores far apart in different blocks: the running maximum keeps exponentials finite."""
    rows = [(0, 0, 0, t, [1.0], [float(800 * t)], [float(t)]) for t in range(6)]
    df = spark.createDataFrame(rows, "sample_id int, y int, x int, t int, q array<double>, k array<double>, v array<double>")
    got = attention.temporal_attention(df, block=2).collect()
    assert len(got) == 6 and all(np.allclose(r.attended, [5.0]) for r in got)


@pytest.mark.parametrize("mode", ["group", "mean"])
def test_maps_are_resized_by_mode(spark, mode):
    """Shrinking: block means for groups of heads, bilinear for their mean."""
    w = np.arange(16.0).reshape(4, 4)
    df = spark.createDataFrame([("a", 0, 0, 0, 4, 4, w.ravel().tolist())], "sample_id string, head int, t_out int, t_in int, height int, width int, w array<double>")
    got = attention.resize_maps(df, (2, 2), mode=mode).first().w
    # Half size: pixel centres fall on the corner of four pixels, so both give their mean.
    assert np.allclose(got, [2.5, 4.5, 10.5, 12.5])
    odd = attention.resize_maps(df, (1, 1), mode=mode).first().w
    assert np.allclose(odd, [7.5])
    third = attention.resize_maps(df, (3, 3), mode=mode).first().w
    assert np.allclose(third[0], 2.5 if mode == "group" else 0.833333, atol=1e-5)


@pytest.mark.parametrize("block", [3, 16])
def test_maps_of_both_modes_in_one_pass(spark, block):
    """Blocks of maps, missing pairs and heads, a padded frame, an absent band, a map of another size."""
    rng = np.random.default_rng(4)
    frames = {t: [None if (t, b) == (5, 1) else rng.random(16) for b in range(4)] for t in range(8)}
    maps = {(h, o, i): rng.random((2, 2) if i != 6 else (4, 4)) for h in range(2) for o in range(8) for i in range(9) if (o, i) != (2, 4) and (h, o) != (1, 7)}
    rows = [("a", t, t != 3, *[None if v is None else v.tolist() for v in bands]) for t, bands in frames.items()]
    df = spark.createDataFrame(rows, "sample_id string, t int, ok boolean, " + ", ".join(f"b{i} array<double>" for i in range(4)))
    weights = [("a", h, o, i, *m.shape, m.ravel().tolist()) for (h, o, i), m in maps.items()]
    weights = spark.createDataFrame(weights, "sample_id string, head int, t_out int, t_in int, height int, width int, w array<double>")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    bands = [f"b{i}" for i in range(4)]
    got = attention.apply_maps(weights.mapInArrow(count, weights.schema), df, bands, (4, 4), 2, ("group", "mean"), "ok", block=block).collect()
    assert seen.value == len(maps)
    large = {k: r.w for k, r in zip(maps, attention.resize_maps(weights, (4, 4)).collect())}
    want = {}
    for (h, o, i), w in large.items():
        if i > 7 or i == 3:
            continue
        heads = [g for g in range(2) if (g, o, i) in maps]
        for mode, some, share in (("group", (2 * h, 2 * h + 1), 1), ("mean", range(4), len(heads))):
            values = [frames[i][b] for b in some]
            if all(v is not None for v in values):
                for b, v in zip(some, values):
                    want[mode, o, b] = want.get((mode, o, b), 0) + np.array(w) / share * v
    assert len(got) == 2 * 8 * 16
    for r in got:
        for b in range(4):
            v, wanted = r[f"b{b}"], want.get((r["mode"], r.t, b))
            assert v is None if wanted is None else np.isclose(v, wanted[4 * r.y + r.x])
