"""Queries over cubes, stored simulations and the training set."""

from __future__ import annotations

import io
import uuid
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.catalog import register
from rasterweave.catalog.frames import _QUALITY_OUT, _ids, _quality_columns, _r
from rasterweave.catalog.simulation import SETTINGS, chosen, simulated, targets
from rasterweave.catalog.sql import BANDS, query
from rasterweave.functions import grids
from rasterweave.plans.ingest import ingest_files, score_frames
from rasterweave.plans.simulate import training_set
from rasterweave.sources.cubes import CUBE_KEY, cubes_to_frames
from rasterweave.sources.driver_tables import scene_frames
from rasterweave.sources.frames import keep_listed, list_samples, read_frames
from rasterweave.sources.settle import settle, shared_folder
from rasterweave.sources.simulations import not_yet_simulated, read_simulation, target_differences, write_simulation


def _pack(bands: list[str]):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        cube = np.stack(
            [np.stack(pdf[b].to_numpy()).reshape(-1, h, w) for b in bands], axis=-1
        ).transpose(1, 2, 3, 0)
        out = io.BytesIO()
        np.savez(out, **{CUBE_KEY: cube.astype("float32")})
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [out.getvalue()]})

    return pack


def cube_files(spark: SparkSession, sf_dir: str, context: int | None = None) -> DataFrame:
    """(path, content) of one ``.npz`` cube per sequence, or context and target cubes."""
    f = scene_frames(spark, sf_dir)
    part = F.lit("") if context is None else F.when(F.col("t") < context, "context").otherwise("target")
    mark = F.lit("") if context is None else F.concat(part, F.lit("_"))
    path = F.concat(
        F.lit("/in/"), part, F.lit("/tile"), F.col("tile").cast("string"), F.lit("/"), mark,
        F.lit("s"), F.col("sample_id").cast("string"), F.lit("_2018-01-01_2018-03-01_x.npz"),
    )
    f = f.withColumn("path", path).withColumn("class_id", F.transform("cloud_mask", lambda v: v * 3))
    channels = [*BANDS, "cloud_prob", "class_id", "cloud_mask"]
    channels = channels if context is None else [*BANDS, "cloud_mask"]
    return (
        f.select("path", "t", "height", "width", *channels)
        .groupBy("path")
        .applyInPandas(_pack(channels), "path string, content binary")
    )


_NAME = "'tile' || tile || '/s' || sample_id || '_2018-01-01_2018-03-01_x'"


@register(
    "cube_frames",
    query(
        "pix",
        f"""SELECT {_NAME} AS sample_id, 'tile' || tile AS tile, t, strftime(DATE '2018-01-05' + CAST(5 * t AS INTEGER), '%Y-%m-%d') AS acq_date,
  y, x, {", ".join(f"round(CAST(CAST({b} AS FLOAT) AS DOUBLE), 5) AS {b}" for b in BANDS)}, round(CAST(CAST(cloud_prob AS FLOAT) AS DOUBLE), 3) AS cloud_prob, 3 * cloud_mask AS class_id, cloud_mask FROM pix""",
    ),
)
def cube_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = cubes_to_frames(cube_files(spark, sf_dir))
    arrays = [*BANDS, "cloud_prob", "class_id", "cloud_mask"]
    p = grids.explode_pixels(frames, arrays, ["sample_id", "tile", "t", "acq_date"])
    return p.select(
        "sample_id", "tile", *_ids("t"), F.date_format("acq_date", "yyyy-MM-dd").alias("acq_date"),
        *_ids("y", "x"), *[F.round(F.col(b).cast("double"), 5).alias(b) for b in BANDS],
        F.round(F.col("cloud_prob").cast("double"), 3).alias("cloud_prob"),
        *_ids("class_id", "cloud_mask"),
    )


@register(
    "cube_quality",
    query(
        "fr_noprob",
        f"""SELECT {_NAME} AS sample_id, 'tile' || tile AS tile, t, round(cloud_pct, 6) AS cloud_pct,
  CAST(not_avail AS BIGINT) AS not_avail, CAST(impaired AS BIGINT) AS impaired, CAST(cloudy AS BIGINT) AS cloudy, valid_obs FROM fr_noprob""",
    ),
)
def cube_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest of a test split: context and target cubes joined along time, then scored."""
    # Settled: these rows stand for files, which are read more than once.
    files = settle(cube_files(spark, sf_dir, context=4))
    frames = cubes_to_frames(files, split="iid")
    return _quality_columns(score_frames(frames, with_prob=False), prob=False).withColumn(
        "t", F.col("t").cast("bigint")
    )


_SPLIT_QUALITY = " UNION ALL ".join(
    f"""SELECT '{split}' AS split, {_NAME} AS sample_id, 'tile' || tile AS tile, t, round(cloud_pct, 6) AS cloud_pct,
  CAST(impaired AS BIGINT) AS impaired, CAST(valid_obs AS BIGINT) AS valid_obs,
  CAST(sum(valid_obs) OVER (PARTITION BY sample_id) >= 5 AS BIGINT) AS usable FROM {source}"""
    for split, source in (("train", "fr"), ("iid", "fr_noprob"))
)


@register("ingest_two_splits", query(("fr", "fr_noprob"), _SPLIT_QUALITY))
def ingest_two_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names ingested as training and as test cubes: stored, scored and listed by split."""
    target = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    ingest_files(spark, settle(cube_files(spark, sf_dir)), target, "train")
    ingest_files(spark, settle(cube_files(spark, sf_dir, context=4)), target, "iid")
    frames = read_frames(spark, f"{target}/frames")
    listed = keep_listed(list_samples(frames), spark.read.parquet(f"{target}/valid_samples")).withColumn("_ok", F.lit(1))
    quality = spark.read.parquet(f"{target}/frame_quality").join(listed, ["split", "tile", "sample_id"], "left")
    return quality.select(
        "split", "sample_id", "tile", *_ids("t"), _r("cloud_pct", "cloud_pct"), *_ids("impaired", "valid_obs"),
        F.coalesce("_ok", F.lit(0)).cast("bigint").alias("usable"),
    )


@register(
    "simulation_round_trip",
    query(
        "sim",
        f"""SELECT sample_id, pos, t, CAST(max(masked) AS BIGINT) AS masked, CAST(max(fully_masked) AS BIGINT) AS fully_masked,
  CAST(sum(mask) AS BIGINT) AS n_hidden, {", ".join(f"round(sum({b}), 5) AS sum_{b}" for b in BANDS)} FROM sim GROUP BY ALL""",
    ),
)
def simulation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs added to a store in parts, one of them repeated; the first one read back."""
    path = f"{shared_folder(spark)}/simulation-{uuid.uuid4().hex}"
    target = ["sample_id", "pos", "t", *BANDS, "cloud_mask"]
    one = simulated(spark, sf_dir)
    write_simulation(spark, one.where("sample_id % 2 = 0"), path, SETTINGS.run_key, target)
    write_simulation(spark, one, path, SETTINGS.run_key, target)
    other = replace(SETTINGS, ratio_masked_frames=0.25)
    write_simulation(spark, simulated(spark, sf_dir, other), path, other.run_key, target)
    back = read_simulation(spark, path, SETTINGS.run_key)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return back.select(
        *_ids("sample_id", "pos", "t", "masked", "fully_masked"), total("mask").cast("bigint").alias("n_hidden"),
        *[F.round(total(b), 5).alias(f"sum_{b}") for b in BANDS],
    )


@register(
    "not_yet_simulated",
    query("usable", "SELECT sample_id FROM usable WHERE sample_id % 3 <> 0"),
)
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = chosen(spark, sf_dir).select("sample_id").distinct()
    done = simulated(spark, sf_dir).where(F.col("sample_id") % 3 == 0)
    masks = done.select("sample_id", F.lit(SETTINGS.run_key).alias("run_key"))
    return not_yet_simulated(samples, masks, SETTINGS.run_key)


@register(
    "target_differences",
    query("whole", "SELECT sample_id, pos FROM whole WHERE sample_id % 7 = 0 AND pos = 2"),
)
def changed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose stored target no longer matches: one frame of some samples is altered."""
    now = targets(spark, sf_dir)
    altered = (F.col("sample_id") % 7 == 0) & (F.col("pos") == 2)
    stored = now.withColumn(
        "b0", F.transform("b0", lambda v: v + F.when(altered, 1.0).otherwise(0.0))
    )
    return target_differences(stored, now, list(BANDS))


@register(
    "training_set",
    query(
        "sim",
        """SELECT sample_id, part, count(*) // 16 AS n_frames, round(sum(b0_in + b1_in + b2_in + b3_in + mask), 5) AS sum_x,
  round(sum(b0 + b1 + b2 + b3), 5) AS sum_y, sum(mask) AS sum_mask,
  string_agg(CAST(dayofyear(acq_date) - 1 AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE y = 0 AND x = 0) AS positions,
  string_agg(CAST(date_diff('day', d0, acq_date) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE y = 0 AND x = 0) AS days
FROM (SELECT *, pos // 4 AS part, first_value(acq_date) OVER (PARTITION BY sample_id ORDER BY pos) AS d0 FROM sim)
GROUP BY sample_id, part""",
    ).replace("sum(mask) AS", "CAST(sum(mask) AS BIGINT) AS"),
)
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training_set(simulated(spark, sf_dir), list(BANDS), 4, append_mask=True)

    def total(nested: str, depth: int):
        flat = F.flatten(nested) if depth == 2 else F.flatten(F.flatten(nested))
        return F.aggregate(flat, F.lit(0.0), lambda s, v: s + v.cast("double"))

    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return out.select(
        "sample_id",
        "part",
        F.size("x").cast("bigint").alias("n_frames"),
        F.round(total("x", 3), 5).alias("sum_x"),
        F.round(total("y", 3), 5).alias("sum_y"),
        total("masks", 2).cast("bigint").alias("sum_mask"),
        text("position_days").alias("positions"),
        text("days").alias("days"),
    )
