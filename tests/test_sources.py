"""Cubes, stored frames and stored simulations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.plans import ingest
from rasterweave.schema import MaskSettings, ReadOptions, frames_schema
from rasterweave.sources import cubes, simulations
from rasterweave.sources.commits import drop_uncommitted, read_committed
from rasterweave.sources.frames import (
    keep_listed,
    list_samples,
    pair_sensors,
    read_frames,
    union_splits,
    write_bucketed,
    write_frames,
)


def cube(channels, frames, seed):
    rng = np.random.default_rng(seed)
    c = rng.random((8, 8, channels, frames)).astype("float32")
    c[:, :, -1, :] = 0
    c[0, 0, 0, 0] = np.nan
    return c


@pytest.fixture()
def npz_root(tmp_path):
    root = tmp_path / "cubes"
    made = {}
    for tile, stem in (("31TA", "31TA_2018-01-01_2018-01-30_1_2"), ("31TB", "31TB_2018-02-01_2018-03-02_3_4")):
        (root / "train" / tile).mkdir(parents=True)
        made[stem] = cube(7, 6, len(made))
        np.savez(root / "train" / tile / f"{stem}.npz", highresdynamic=made[stem])
    (root / "train" / "LICENSE").write_text("x")
    return root, made


def test_npz_round_trip(spark, npz_root):
    root, made = npz_root
    frames = cubes.read_npz_cubes(spark, str(root / "train"))
    assert frames.count() == 12
    for stem, c in made.items():
        rows = frames.where(F.col("sample_id").endswith(stem)).orderBy("t").collect()
        for t, r in enumerate(rows):
            assert r.tile == stem[:4] and r.sample_id == f"{stem[:4]}/{stem}"
            got = np.array([np.nan if v is None else v for v in r.b0], dtype="float32")
            assert np.array_equal(got, c[:, :, 0, t].ravel(), equal_nan=True)
            assert np.array_equal(np.array(r.cloud_prob, dtype="float32"), c[:, :, 4, t].ravel())
    first = frames.where("t = 0").orderBy("sample_id").first()
    assert str(first.acq_date) == "2018-01-05" and first.b0[0] is None


def test_inventory_and_tile_counts(spark, npz_root):
    root, _ = npz_root
    listed = cubes.inventory(cubes.list_files(spark, str(root), "*"))
    assert {(r.tile) for r in listed.collect()} == {"31TA", "31TB"}
    counts = cubes.tile_inventory(cubes.list_files(spark, str(root)))
    assert {(r.tile, r.n_samples) for r in counts.collect()} == {("31TA", 1), ("31TB", 1)}


def test_context_and_target_are_joined(spark, tmp_path):
    stem = "31TA_2018-01-01_2018-01-30_1_2"
    parts = {"context": cube(5, 2, 1), "target": cube(5, 4, 2)}
    for kind, c in parts.items():
        d = tmp_path / "iid" / kind / "31TA"
        d.mkdir(parents=True)
        np.savez(d / f"{kind}_{stem}.npz", highresdynamic=c)
    frames = cubes.read_npz_cubes(spark, str(tmp_path / "iid"), split="iid").orderBy("t").collect()
    assert [r.t for r in frames] == list(range(6))
    assert {r.sample_id for r in frames} == {f"31TA/{stem}"}
    whole = np.concatenate([parts["context"], parts["target"]], axis=3)
    assert np.allclose([r.b1[5] for r in frames], whole[0, 5, 1])
    assert frames[0].cloud_prob is None


def test_ingest_end_to_end(spark, npz_root, tmp_path):
    root, _ = npz_root
    out = str(tmp_path / "out")
    ingest.ingest_cubes(spark, str(root / "train"), out, "train")
    opts = ReadOptions(channels="rgb")
    frames = read_frames(spark, f"{out}/frames", opts)
    plan = frames.select("sample_id", "b0")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan or "PartitionFilters: [(split" in plan
    assert "ReadSchema: struct<sample_id:string,b2:array<float>>" in plan
    assert frames.count() == 12 and list_samples(frames).count() == 2
    quality = spark.read.parquet(f"{out}/frame_quality")
    assert quality.where("valid_obs = 1").count() == 12
    valid = spark.read.parquet(f"{out}/valid_samples")
    assert keep_listed(frames, valid.limit(1)).count() == 6
    tiles = ingest.train_val_tiles(cubes.list_files(spark, str(root)), val_size=1)
    assert sorted(r.split for r in tiles.collect()) == ["train", "val"]


def test_ingest_divides_tiles_into_train_and_val(spark, npz_root, tmp_path):
    root, _ = npz_root
    out = str(tmp_path / "out")
    ingest.ingest_train_val(spark, str(root / "train"), out, val_size=1)
    frames = spark.read.parquet(f"{out}/frames")
    assert sorted(r.split for r in frames.select("split", "tile").distinct().collect()) == ["train", "val"]
    assert spark.read.parquet(f"{out}/frame_quality").groupBy("split").count().count() == 2
    assert [tuple(r) for r in list_samples(frames, ordered=True).collect()] == sorted(tuple(r) for r in list_samples(frames).collect())


def test_equal_names_in_two_splits(spark, tmp_path):
    """Each split keeps its own frames, its own flags and its own place on the list."""
    out = str(tmp_path / "out")
    for split, hidden in (("train", 0), ("iid", 1)):
        c = np.full((4, 4, 7, 6), 0.4, "float32")
        c[:, :, 4] = 0
        c[:, :, -1] = hidden
        d = tmp_path / split / "context" / "tileA"
        d.mkdir(parents=True)
        np.savez(d / "context_s1_2018-01-01_2018-01-31_x.npz" if split == "iid" else d / "s1_2018-01-01_2018-01-31_x.npz", highresdynamic=c)
        ingest.ingest_cubes(spark, str(tmp_path / split), out, split)
    quality = spark.read.parquet(f"{out}/frame_quality")
    assert {(r.split, r.valid_obs, r["count"]) for r in quality.groupBy("split", "valid_obs").count().collect()} == {("train", 1, 6), ("iid", 0, 6)}
    valid = spark.read.parquet(f"{out}/valid_samples")
    assert [r.split for r in valid.collect()] == ["train"]
    frames = spark.read.parquet(f"{out}/frames")
    assert {r.split for r in keep_listed(frames, valid).collect()} == {"train"}


def test_repeated_ingest_scores_new_frames_only(spark, npz_root, tmp_path):
    root, _ = npz_root
    out = str(tmp_path / "out")
    ingest.ingest_cubes(spark, str(root / "train"), out, "train")
    more = tmp_path / "more" / "tileZ"
    more.mkdir(parents=True)
    np.savez(more / "z_2018-01-01_2018-01-31_x.npz", highresdynamic=np.zeros((8, 8, 7, 6), "float32"))
    ingest.ingest_cubes(spark, str(more.parent), out, "train")
    quality = spark.read.parquet(f"{out}/frame_quality")
    assert quality.count() == 18 == quality.select("tile", "sample_id", "t").distinct().count()


def test_differences_see_missing_pixels(spark):
    side = lambda v: spark.createDataFrame([("a", 0, v)], "sample_id string, pos int, b0 array<double>")
    one, two = side([1.0, None, 2.0]), side([None, 1.0, 2.0])
    assert simulations.target_differences(one, two, ["b0"]).count() == 1
    assert simulations.target_differences(one, one, ["b0"]).isEmpty()


def small_frames(spark):
    row = lambda split, tile, s, t: (
        split, tile, s, "S2", t, None, 1, 2, [0.1, 0.2], [0.3, 0.4], [1.0, 2.0], [1, 1], [0, 1],
    )
    rows = [row("train", "A", "ROIs1/a", t) for t in range(3)] + [row("val", "B", "other/b", t) for t in range(2)]
    return spark.createDataFrame(rows, frames_schema(2))


def test_mode_all_reads_both_splits(spark, tmp_path):
    path = str(tmp_path / "f")
    write_frames(small_frames(spark), path)
    back = spark.read.parquet(path)
    assert back.count() == 5
    assert list_samples(back, "ROIs").count() == 1
    rgb = {"channels": "bgr"}
    assert read_frames(spark, path, ReadOptions(mode="all", **rgb), 3).count() == 5
    assert read_frames(spark, path, ReadOptions(mode="val", **rgb), 3).count() == 2
    assert union_splits([back.where("split = 'train'"), back.where("split = 'val'")]).count() == 5


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS rw_opt")
    spark.sql("DROP TABLE IF EXISTS rw_sar")
    df = small_frames(spark)
    try:
        write_bucketed(df, "rw_opt", 4)
        write_bucketed(df.select("sample_id", "t", F.col("b1").alias("vv")), "rw_sar", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = pair_sensors(spark.table("rw_opt"), spark.table("rw_sar"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS rw_opt")
        spark.sql("DROP TABLE IF EXISTS rw_sar")


def simulation(spark, samples, shift=0.0, mask=1):
    rows = [(s, p, [0.5 + shift], [mask], 1, 0) for s in samples for p in range(2)]
    return spark.createDataFrame(
        rows, "sample_id string, pos bigint, b0 array<double>, mask array<tinyint>, masked int, fully_masked int"
    )


def test_simulation_store(spark, tmp_path):
    path, key = str(tmp_path / "sim"), MaskSettings().run_key
    simulations.write_simulation(spark, simulation(spark, ["a"]), path, key, ["b0"])
    simulations.write_simulation(spark, simulation(spark, ["a", "b"]), path, key, ["b0"])
    simulations.write_simulation(spark, simulation(spark, ["a", "b"]), path, key, ["b0"])
    assert simulations.read_simulation(spark, path, key).count() == 4
    other = MaskSettings(ratio_masked_frames=0.3).run_key
    simulations.write_simulation(spark, simulation(spark, ["a"], mask=0), path, other, ["b0"])
    assert read_committed(spark, path, "target").count() == 4
    assert simulations.read_simulation(spark, path, other).count() == 2
    masks = simulations.read_masks(spark, path)
    left = simulations.not_yet_simulated(simulation(spark, ["a", "b", "c"]), masks, other)
    assert {r.sample_id for r in left.collect()} == {"b", "c"}
    with pytest.raises(RuntimeError):
        simulations.write_simulation(spark, simulation(spark, ["a"], shift=0.1), path, "new", ["b0"])
    assert simulations.read_masks(spark, path).where("run_key = 'new'").isEmpty()
    assert read_committed(spark, str(tmp_path / "none"), "masks") is None


def test_killed_write_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    path, key = str(tmp_path / "sim"), MaskSettings().run_key
    simulations.write_simulation(spark, simulation(spark, ["a"]), path, key, ["b0"])

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(simulations, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            simulations.write_simulation(spark, simulation(spark, ["b"]), path, key, ["b0"])
    assert {r.sample_id for r in simulations.read_simulation(spark, path, key).collect()} == {"a"}
    assert len(drop_uncommitted(spark, path)) == 1 and drop_uncommitted(spark, path) == []
    simulations.write_simulation(spark, simulation(spark, ["b"]), path, key, ["b0"])
    assert {r.sample_id for r in simulations.read_simulation(spark, path, key).collect()} == {"a", "b"}


def test_simulation_is_evaluated_once(spark, tmp_path):
    path, seen = str(tmp_path / "sim"), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = simulation(spark, ["a", "b"])
    counted = counted.mapInArrow(count, counted.schema)
    for _ in range(2):
        simulations.write_simulation(spark, counted, path, "k", ["b0"])
    assert seen.value == 8


def test_earlier_draws_pick_the_closest_run(spark):
    key = lambda full: MaskSettings(ratio_masked_frames=0.5, ratio_fully_masked_frames=full).run_key
    rows = [
        (key(0.0), "a", 0, 1, 0), (key(0.2), "a", 0, 0, 1), (key(0.0), "b", 0, 1, 0),
        ("ratio_masked_0.3/masks_random_clouds", "c", 0, 1, 0),
    ]
    masks = spark.createDataFrame(rows, "run_key string, sample_id string, pos bigint, masked int, fully_masked int")
    ratios = {r[0] for r in masks.select(F.array_join(simulations.run_key_ratios(F.col("run_key")).cast("array<string>"), ",")).collect()}
    assert ratios == {"0.5", "0.5,0.2", "0.3"}
    got = simulations.earlier_draws(masks, MaskSettings(ratio_fully_masked_frames=0.2))
    assert {r.sample_id: (r.masked, r.fully_masked) for r in got.collect()} == {"a": (0, 1), "b": (1, None)}


def test_workflow_from_cubes_to_scores(spark, tmp_path):
    """Ingest, choose, simulate, store, read back, score."""
    from rasterweave.plans import evaluate, simulate
    from rasterweave.schema import FilterSettings
    from rasterweave.sources.settle import settle

    rng = np.random.default_rng(5)
    for i in range(4):
        c = rng.random((8, 8, 7, 8)).astype("float32")
        c[:, :, -1, :] = 0
        c[:3, :, -1, 3] = 1
        c[:, :, 4, :] = 0.5
        c[:, :, 4, 3] = 90
        d = tmp_path / "cubes" / f"tile{i % 2}"
        d.mkdir(parents=True, exist_ok=True)
        np.savez(d / f"s{i}_2018-01-01_2018-02-12_x.npz", highresdynamic=c)
    out = str(tmp_path / "out")
    ingest.ingest_cubes(spark, str(tmp_path / "cubes"), out, "train")
    bands = ["b0", "b1", "b2", "b3"]
    frames = simulate.clean_bands(spark.read.schema(frames_schema(4)).parquet(f"{out}/frames"), bands)
    quality = spark.read.parquet(f"{out}/frame_quality")
    assert quality.where("valid_obs = 0").select("t").distinct().collect()[0].t == 3
    chosen = settle(simulate.choose_frames(quality, FilterSettings("cloud-free", 5), max_len=6))
    settings = MaskSettings(non_masked_frames=(0,), fixed_masking_ratio=True)
    gappy = simulate.simulate_gaps(frames, chosen, quality, bands, settings)
    stored = ["sample_id", "tile", "pos", "t", "acq_date", "height", "width", *bands, "cloud_mask", "valid_obs"]
    simulations.write_simulation(spark, gappy, f"{out}/sim", settings.run_key, stored)
    back = simulations.read_simulation(spark, f"{out}/sim", settings.run_key)
    again = simulate.apply_stored_masks(back, bands, settings)
    assert again.count() == 24
    assert again.where("masked = 1").count() == 12
    one = evaluate.summarize(evaluate.score_modes_arrays(gappy, bands))
    two = evaluate.summarize(evaluate.score_modes(again, bands))
    a = {(r.method, r.metric, r.stratum): r["mean"] for r in one.collect()}
    b = {(r.method, r.metric, r.stratum): r["mean"] for r in two.collect()}
    assert a.keys() == b.keys() and len(a) == 60
    assert all(np.isclose(a[k], b[k]) for k in a)
    assert a[("linear", "masked_mae", "observed")] == 0.0
    from rasterweave.plans.dataset import model_samples

    direct = model_samples(spark, out, ReadOptions(channels="bgr-nir-mask", mask=settings, stored_run=f"{out}/sim"), 6).collect()
    rows = simulate.training_set(again, bands, 6, append_mask=True, extra=["masked"]).collect()
    assert {r.sample_id: r.x for r in direct} == {r.sample_id: r.x for r in rows}
    assert len(rows) == 4 and {len(r.x) for r in rows} == {6} and {len(r.x[0]) for r in rows} == {5}


def test_model_samples(spark, tmp_path):
    from rasterweave.plans.dataset import model_samples
    from rasterweave.schema import CropSettings, FilterSettings

    rng = np.random.default_rng(7)
    for i in range(3):
        c = rng.random((8, 8, 7, 8)).astype("float32")
        c[:, :, -1, :] = 0
        c[:4, :, -1, 5] = 1
        c[:, :, 4, :] = 0.5
        d = tmp_path / "cubes" / "tile0"
        d.mkdir(parents=True, exist_ok=True)
        np.savez(d / f"s{i}_2018-01-01_2018-02-12_x.npz", highresdynamic=c)
    out = str(tmp_path / "out")
    ingest.ingest_cubes(spark, str(tmp_path / "cubes"), out, "train")
    options = ReadOptions(
        channels="bgr-mask",
        max_seq_length=5,
        filter=FilterSettings("cloud-free", 5),
        crop=CropSettings("random", (6, 5)),
        mask=MaskSettings(fixed_masking_ratio=True),
        augment=True,
    )
    rows = model_samples(spark, out, options, row_frames=5).collect()
    assert len(rows) == 3
    for r in rows:
        assert len(r.x) == 5 and len(r.x[0]) == 4 and len(r.x[0][0]) == 30 and len(r.y[0]) == 3
        assert r.days[0] == 0 and r.masks_valid_obs == [1] * 5
        for x, y, m in zip(r.x, r.y, r.masks):
            assert x[3] == [float(v) for v in m]
            assert all(a == (1.0 if hidden else b) for a, b, hidden in zip(x[0], y[0], m))
    assert sum(any(m) for r in rows for m in r.masks) == 9
    shown = ReadOptions(channels="bgr", filter=FilterSettings("cloud-free", 5), drop_black=True, extra=("cloud_prob", "class_id"))
    rows = model_samples(spark, out, shown, row_frames=8).collect()
    assert len(rows) == 3 and all(len(r.cloud_prob[0]) == 64 == len(r.class_id[0]) for r in rows)
    plain = ReadOptions(channels="bgr-nir", filter=FilterSettings(None), position_strategy="absolute")
    rows = model_samples(spark, out, plain, row_frames=4).collect()
    assert len(rows) == 6 and all(r.x == r.y for r in rows)
    with pytest.raises(ValueError):
        model_samples(spark, out, ReadOptions(include_radar=True), 4)


def test_two_sensor_samples(spark, tmp_path):
    from rasterweave.plans.dataset import model_samples
    from rasterweave.schema import FilterSettings

    row = lambda s, t: (
        "test", "R1", s, "S2", t, None, 1, 2, *[[5000.0 * b, 20000.0] for b in range(13)],
        [0.001, 0.0], None, [0, 0],
    )
    df = spark.createDataFrame([row(s, t) for s in ("a", "b") for t in range(6)], frames_schema(13))
    df = df.withColumn("acq_date", F.date_add(F.lit("2018-01-01").cast("date"), F.col("t") * 7))
    out = str(tmp_path / "s")
    write_frames(df, f"{out}/frames")
    ingest.score_two_sensor(spark, out)
    assert spark.read.parquet(f"{out}/valid_samples").count() == 2
    radar = df.where("sample_id = 'a'").select(
        "sample_id", "t", F.array(F.lit(-30.0), F.lit(-5.0)).alias("vv"), F.array(F.lit(0.0), F.lit(-25.0)).alias("vh")
    )
    options = ReadOptions(
        split="test", sensor="thirteen-band", channels="bgr-nir", include_radar=True,
        filter=FilterSettings("cloud-free", 5, max_t_sampling=42),
    )
    rows = model_samples(spark, out, options, 6, radar=radar).collect()
    assert [r.sample_id for r in rows] == ["a"]
    assert rows[0].x[0] == [[0.5, 1.0], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0], [0.0, 0.8], [1.0, 0.0]]


def test_forgotten_tables_are_deleted(spark):
    import os

    from rasterweave.sources.settle import forget, settle

    one, two = settle(spark.range(3)), settle(spark.range(4))
    forget(one)
    assert not os.path.exists(one._settled_in.removeprefix("file:")) and two.count() == 4
