"""Runs, filters, trimming and padding."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rasterweave.operators import sequences as S
from rasterweave.operators.quality import flag_frames, frame_statistics_arrays, status_lists
from rasterweave.schema import CropSettings, FilterSettings, MaskSettings, ReadOptions


def quality(spark, valid: dict[str, str], step=5):
    """One sample per entry; '1' marks a good frame."""
    rows = [(s, "T", t, step * t, int(c)) for s, flags in valid.items() for t, c in enumerate(flags)]
    df = spark.createDataFrame(rows, "sample_id string, tile string, t int, d int, valid_obs int")
    return df.withColumn("acq_date", F.date_add(F.lit("2018-01-01").cast("date"), F.col("d"))).drop("d")


def by_sample(df, *cols):
    return {r.sample_id: tuple(r[c] for c in cols) for r in df.collect()}


RUN = ("run_start", "run_end", "run_len")


def test_longest_run(spark):
    q = quality(
        spark,
        {"single": "00100", "tie": "1101100", "long": "1101110", "none": "000", "all": "1111"},
    )
    got = by_sample(S.longest_good_run(q), *RUN)
    assert got == {
        "single": (0, 0, 0),  # a run of one frame does not count
        "tie": (0, 1, 2),
        "long": (3, 5, 3),
        "none": (0, 0, 0),
        "all": (0, 3, 4),
    }


def test_longest_run_within_gap(spark):
    q = quality(spark, {"a": "1010010101", "b": "1000001"})
    got = by_sample(S.longest_run_within_gap(q, 10), *RUN)
    assert got == {"a": (5, 9, 3), "b": (0, 0, 0)}


def test_max_invalid_run(spark):
    q = quality(spark, {"none": "111", "end": "10100", "one": "0111", "all": "000"})
    assert by_sample(S.max_invalid_run(q), "max_invalid") == {
        "none": (0,), "end": (2,), "one": (1,), "all": (3,),
    }


def test_invalid_limit_decides_before_gap_limit(spark):
    q = quality(spark, {"a": "1010101"}, step=30)
    both = FilterSettings("cloud-free", 4, max_num_consec_invalid=1, max_t_sampling=7)
    gap = FilterSettings("cloud-free", 4, max_t_sampling=7)
    assert S.valid_samples(q, both).count() == 1
    assert S.valid_samples(q, gap).count() == 0


def test_select_keeps_all_frames_with_flags(spark):
    q = quality(spark, {"a": "1101110"})
    keep_all = FilterSettings("cloud-free_consecutive", 2, return_valid_obs_only=False)
    rows = S.select_frames(q, keep_all).orderBy("t").collect()
    assert [r.valid_obs for r in rows] == [0, 0, 0, 1, 1, 1, 0]


@pytest.mark.parametrize("block", [65_536, 2])
def test_trim_is_a_run_of_kept_frames(spark, block):
    q = quality(spark, {f"s{i}": "1011011101" for i in range(20)}).where("valid_obs = 1")
    out = S.trim_random_window(q, 4, seed=1, block_size=block)
    kept = [0, 2, 3, 5, 6, 7, 9]
    starts = set()
    for s in {r.sample_id for r in out.collect()}:
        rows = sorted((r.pos, r.t, r.n_frames) for r in out.where(F.col("sample_id") == s).collect())
        assert [p for p, _, _ in rows] == [0, 1, 2, 3] and {n for _, _, n in rows} == {4}
        first = kept.index(rows[0][1])
        assert [t for _, t, _ in rows] == kept[first : first + 4]
        starts.add(first)
    assert len(starts) > 1


def test_short_sequence_is_not_trimmed(spark):
    out = S.trim_random_window(quality(spark, {"a": "111"}), 5)
    assert sorted((r.pos, r.n_frames) for r in out.collect()) == [(0, 3), (1, 3), (2, 3)]


def test_pad_to_longest(spark):
    q = quality(spark, {"a": "11", "b": "1111"}).withColumn("pos", F.col("t").cast("bigint"))
    out = S.pad_sequences(q, {"t": F.lit(-1)})
    assert sorted((r.pos, r.valid_obs) for r in out.where("sample_id = 'a'").collect()) == [
        (0, 1), (1, 1), (2, 0), (3, 0),
    ]
    assert out.count() == 8


def test_positions(spark):
    q = quality(spark, {"a": "111"})
    for strategy, want in {
        "day-of-year": [0, 5, 10],
        "day-within-sequence": [0, 5, 10],
        "absolute": [923, 928, 933],
        "enumeration": [0, 1, 2],
    }.items():
        rows = S.add_position(q, strategy).orderBy("t").collect()
        assert [r.position for r in rows] == want
    with pytest.raises(ValueError):
        S.add_position(q, "week")


def test_drop_black(spark):
    df = spark.createDataFrame(
        [("a", 0, [0.0, 0.0]), ("a", 1, [0.1, 0.0]), ("b", 0, [0.2, None])],
        "sample_id string, t int, b0 array<double>",
    )
    assert {r.sample_id for r in S.drop_black(df, ["b0"]).collect()} == {"b"}


def test_thresholds(spark):
    def flags(cloud_pct, prob_pct, strict=False, with_prob=True, gone=False):
        df = spark.createDataFrame(
            [(float(cloud_pct), float(prob_pct), gone)], "cloud_pct double, prob_pct double, not_avail boolean"
        )
        return flag_frames(df, strict, with_prob).first().impaired

    assert flags(40, 0) and not flags(39.9, 0)
    assert flags(10.1, 1.1) and not flags(10, 1.1) and not flags(10.1, 1)
    assert flags(8.1, 4.1) and not flags(8, 4.1) and not flags(8.1, 4)
    assert flags(3.6, 4.1, strict=True) and not flags(3.5, 4.1, strict=True)
    assert flags(5, 0, with_prob=False) and not flags(4.9, 99, with_prob=False)
    assert flags(0, 0, gone=True)


def test_missing_frame_is_impaired_not_cloudy(spark):
    df = spark.createDataFrame(
        [("a", 0, [None, None], [0, 0], [0.0, 0.0]), ("a", 1, [None, 0.1], [0, 0], [0.0, 0.0]),
         ("a", 2, [float("nan")] * 2, [0, 0], [0.0, 0.0])],
        "sample_id string, t int, b0 array<double>, cloud_mask array<int>, cloud_prob array<double>",
    )
    q = flag_frames(frame_statistics_arrays(df, ["sample_id", "t"]))
    rows = q.orderBy("t").collect()
    assert [(r.impaired, r.cloudy, r.valid_obs) for r in rows] == [
        (True, False, 0), (False, False, 1), (True, False, 0),
    ]
    lists = status_lists(q, block=2).orderBy("list_no").collect()
    assert [r.idx_impaired_frames for r in lists] == [[0], [2]]
    assert [r.valid_obs for r in lists] == [[0, 1], [0]]


def test_best_by_objective(spark):
    rows = [("masked_mae", "a", 0.2), ("masked_mae", "b", 0.1), ("psnr", "a", 30.0), ("psnr", "b", 20.0), ("masked_psnr", "a", 1.0),
            ("masked_psnr", "b", float("inf")), ("ssim", "b", 0.5), ("ssim", "a", 0.5), ("total_loss", "a", None), ("total_loss", "b", 3.0),
            ("sam", "a", float("nan"))]
    df = spark.createDataFrame(rows, "metric string, run string, value double")
    out = {r.metric: (r.run, r.value) for r in S.best_by_objective(df).collect()}
    assert out == {"masked_mae": ("b", 0.1), "psnr": ("a", 30.0), "masked_psnr": ("b", float("inf")), "ssim": ("a", 0.5), "total_loss": ("b", 3.0)}
    turned = S.best_by_objective(df.where("metric = 'psnr'"), larger=F.lit(False)).first()
    assert turned.run == "b"


@pytest.mark.parametrize(
    "make",
    [
        lambda: ReadOptions(split="test"),
        lambda: ReadOptions(channels="nir"),
        lambda: ReadOptions(channels="bgr-mask"),
        lambda: ReadOptions(position_strategy="week"),
        lambda: ReadOptions(mode="test"),
        lambda: ReadOptions(render_occluded_above=1),
        lambda: FilterSettings("clear"),
        lambda: FilterSettings("cloud-free", 2.5),
        lambda: CropSettings("middle"),
        lambda: CropSettings("center", (0, 4)),
        lambda: MaskSettings("fog"),
        lambda: MaskSettings(ratio_masked_frames=0.1, ratio_fully_masked_frames=0.2),
    ],
)
def test_bad_options(make):
    with pytest.raises(ValueError):
        make()


def test_good_options():
    opts = ReadOptions(sensor="thirteen-band", split="val", channels="bgr-nir-mask", mask=MaskSettings())
    assert opts.band_positions == (1, 2, 3, 7) and opts.num_channels == 5
    assert MaskSettings().run_key == "ratio_masked_0.5/masks_random_clouds"
    assert MaskSettings(ratio_fully_masked_frames=0.1).run_key.startswith("ratio_masked_0.5_fully_masked_0.1/")
