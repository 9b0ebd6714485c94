"""Queries over gap simulation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.catalog import register
from rasterweave.catalog.frames import KEY, _ids, _r, frame_quality_of
from rasterweave.catalog.sql import BANDS, clean, digits, hexa, query, uniform
from rasterweave.functions import grids
from rasterweave.operators import gaps, geometry, quality
from rasterweave.plans.simulate import choose_frames, clean_bands
from rasterweave.plans.simulate import simulate_gaps as simulate
from rasterweave.schema import FilterSettings, MaskSettings
from rasterweave.sources.driver_tables import observations, scene_frames, table
from rasterweave.sources.settle import settle

FILTER = FilterSettings("cloud-free", 5)
SETTINGS = MaskSettings(
    ratio_masked_frames=0.5,
    ratio_fully_masked_frames=0.2,
    non_masked_frames=(0,),
    union_real_masks=True,
    fill_value=1.0,
)


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good frames of usable samples; scalars only."""
    return settle(choose_frames(settle(frame_quality_of(spark, sf_dir)), FILTER))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen frames with clean bands."""
    frames = clean_bands(scene_frames(spark, sf_dir), BANDS)
    return frames.join(chosen(spark, sf_dir).drop("tile"), ["sample_id", "t"])


def simulated(
    spark: SparkSession, sf_dir: str, settings: MaskSettings = SETTINGS
) -> DataFrame:
    """Chosen frames with masks and filled input bands."""
    scored = settle(frame_quality_of(spark, sf_dir))
    kept = settle(choose_frames(scored, FILTER))
    every = scene_frames(spark, sf_dir)
    good = clean_bands(quality.good_only(every), BANDS)
    return simulate(good, kept, scored, list(BANDS), settings, donor_frames=every)


def drawn_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.sample_masked_frames(chosen(spark, sf_dir), SETTINGS)


@register(
    "masked_frames",
    query("drawn", "SELECT sample_id, t, pos, masked, fully_masked FROM drawn"),
)
def masked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn_frames(spark, sf_dir).select(
        "sample_id", "t", "pos", *_ids("masked", "fully_masked")
    )


@register(
    "masked_frames_fixed_ratio",
    query(
        "obs",
        f"""SELECT sample_id, t, CASE WHEN ok AND row_number() OVER (PARTITION BY sample_id
    ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, {hexa(4, 'mask', 'sample_id', 't')}) <= ceil(0.3::DOUBLE * n)
  THEN 1 ELSE 0 END AS masked
FROM (SELECT *, t <> 0 AND t <> n - 1 AS ok FROM (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM obs))""",
    ),
)
def masked_frames_fixed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = MaskSettings(
        ratio_masked_frames=0.3, non_masked_frames=(0, -1), fixed_masking_ratio=True, seed=4
    )
    rows = observations(spark, sf_dir).select("sample_id", "t")
    return gaps.draw_masked(rows, settings, pos="t").select("sample_id", "t", *_ids("masked"))


@register(
    "reused_sampling",
    query(
        "drawn",
        f"""SELECT sample_id, t, pos, m AS masked, CASE WHEN m = 1 AND row_number() OVER (PARTITION BY sample_id
    ORDER BY m DESC, {hexa(9, 'full', 'sample_id', 'pos')}) <= ceil(0.2::DOUBLE * (1 + {digits(hexa(9, 'ratio', 'sample_id'))} % n))
    THEN 1 ELSE 0 END AS fully_masked
FROM (SELECT *, CASE WHEN sample_id % 2 = 0 THEN masked ELSE m9 END AS m FROM (
  SELECT *, CASE WHEN pos <> 0 AND row_number() OVER (PARTITION BY sample_id
      ORDER BY CASE WHEN pos <> 0 THEN 0 ELSE 1 END, {hexa(9, 'mask', 'sample_id', 'pos')})
      <= ceil(0.5::DOUBLE * (1 + {digits(hexa(9, 'ratio', 'sample_id'))} % n)) THEN 1 ELSE 0 END AS m9
  FROM (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM drawn)))""",
    ),
)
def reused_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = settle(drawn_frames(spark, sf_dir)).where(F.col("sample_id") % 2 == 0)
    earlier = old.select("sample_id", "pos", "masked", F.lit(None).cast("int").alias("fully_masked"))
    rows = chosen(spark, sf_dir)
    out = gaps.sample_masked_frames(rows, replace(SETTINGS, seed=9), earlier)
    return out.select("sample_id", "t", "pos", *_ids("masked", "fully_masked"))


def coverage_of(frames: DataFrame) -> DataFrame:
    return frames.select(
        "tile", "sample_id", "t", grids.mean(F.col("cloud_mask")).alias("coverage")
    )


def usable_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the frames of usable samples, which may lend their masks."""
    usable = chosen(spark, sf_dir).select("sample_id").distinct()
    return coverage_of(scene_frames(spark, sf_dir)).join(usable, "sample_id", "left_semi")


@register(
    "donor_masks",
    query("draws", "SELECT sample_id, t, donor_sample, donor_t FROM draws"),
)
def donor_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    donors = gaps.donor_index(settle(usable_coverage(spark, sf_dir)))
    masked = settle(drawn_frames(spark, sf_dir).where(F.col("masked") == 1))
    return gaps.draw_donors(masked, donors).select("sample_id", "t", "donor_sample", "donor_t")


@register(
    "donor_masks_two_stage",
    query(
        ("drawn", "stats"),
        """SELECT d.sample_id, d.t, s.donor_sample, f.donor_t
FROM d LEFT JOIN s ON s.tile = d.tile AND s.sample_no = d.hs % s.m
LEFT JOIN f ON f.tile = s.tile AND f.donor_sample = s.donor_sample AND f.donor_no = d.hf % f.n""",
        d=f"""SELECT *, {digits(hexa(0, 'donor_sample', 'sample_id', 't'))} AS hs,
  {digits(hexa(0, 'donor', 'sample_id', 't'))} AS hf FROM drawn WHERE masked = 1""",
        f=f"""SELECT tile, sample_id AS donor_sample, t AS donor_t, count(*) OVER (PARTITION BY sample_id) AS n,
  row_number() OVER (PARTITION BY sample_id ORDER BY {hexa(0, 'donor_order', 'sample_id', 't')}) - 1 AS donor_no
FROM stats WHERE coverage >= 0.1 AND sample_id IN (SELECT sample_id FROM usable)""",
        s=f"""SELECT tile, donor_sample, count(*) OVER (PARTITION BY tile) AS m,
  row_number() OVER (PARTITION BY tile ORDER BY {hexa(0, 'donor_sample_order', 'donor_sample')}) - 1 AS sample_no
FROM (SELECT DISTINCT tile, donor_sample FROM f)""",
    ),
)
def donor_masks_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    donors = gaps.donor_index(settle(usable_coverage(spark, sf_dir)), draw="sample")
    masked = settle(drawn_frames(spark, sf_dir).where(F.col("masked") == 1))
    return gaps.draw_donors(masked, donors, draw="sample").select(
        "sample_id", "t", "donor_sample", "donor_t"
    )


@register(
    "tiles_without_donor",
    query(
        ("fr", "stats"),
        """SELECT DISTINCT tile FROM stats WHERE tile NOT IN (
  SELECT tile FROM stats WHERE coverage >= 0.999)""",
    ),
)
def tiles_without_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = scene_frames(spark, sf_dir)
    donors = gaps.donor_index(coverage_of(frames), min_coverage=0.999)
    return gaps.tiles_without_donor(frames, donors)


@register(
    "split_by_tile",
    """WITH c AS (SELECT c_nationkey AS tile, count(*) AS n_samples FROM customer GROUP BY c_nationkey),
k AS (SELECT *, -ln("""
    + uniform(hexa(0, "split", "tile"))
    + """) / n_samples AS key FROM c)
SELECT CAST(tile AS BIGINT) AS tile, n_samples, CASE WHEN coalesce(sum(n_samples) OVER (
    ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  < (SELECT sum(n_samples) FROM c) - 50 THEN 'train' ELSE 'val' END AS split FROM k""",
)
def split_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("tile"), F.col("c_custkey").alias("sample_id")
    )
    out = gaps.split_by_tile(samples, val_size=50)
    return out.select(*_ids("tile"), "n_samples", "split")


def _pixel_rows(frames: DataFrame, bands: list[str], extra: list[str] = ()) -> DataFrame:
    p = grids.explode_pixels(frames, [*bands, "mask"], ["sample_id", "t", *extra])
    return p.select(
        *_ids(*KEY), *_ids(*extra), *[_r(b, b) for b in bands], *_ids("mask")
    )


_IN = [f"{b}_in" for b in BANDS]


@register(
    "simulate_gaps",
    query(
        "sim",
        "SELECT sample_id, t, y, x, pos, masked, fully_masked, "
        + ", ".join(f"round({b}, 6) AS {b}" for b in _IN)
        + ", mask FROM sim",
    ),
)
def simulate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel_rows(simulated(spark, sf_dir), _IN, ["pos", "masked", "fully_masked"])


@register(
    "simulate_full_and_dilated",
    query(
        "composed",
        """SELECT sample_id, t, y, x, round(CASE WHEN m = 1 THEN 0.25::DOUBLE ELSE b0 END, 6) AS b0_in, m AS mask FROM (
  SELECT a.*, (SELECT max(b.mask) FROM w b WHERE b.sample_id = a.sample_id AND b.t = a.t
      AND abs(b.y - a.y) + abs(b.x - a.x) <= 2) AS m FROM w a)""",
        w="SELECT * REPLACE (CASE WHEN fully_masked = 1 THEN 1 ELSE mask END AS mask) FROM composed",
    ),
)
def simulate_full_and_dilated(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = replace(
        SETTINGS, union_real_masks=False, apply_full=True, dilate=2, fill_value=0.25
    )
    return _pixel_rows(simulated(spark, sf_dir, settings), ["b0_in"])


@register(
    "simulate_real_clouds",
    query(
        ("pix", "whole"),
        f"""SELECT sample_id, t, y, x, round(CASE WHEN m = 1 THEN 1.0::DOUBLE ELSE b0 END, 6) AS b0_in, m AS mask FROM (
  SELECT p.sample_id, p.t, y, x, {clean('b0')} AS b0,
    CASE WHEN avg(cloud_mask) OVER (PARTITION BY p.sample_id, p.t) > 0.1 THEN 1 ELSE cloud_mask END AS m
  FROM pix p JOIN whole k ON k.sample_id = p.sample_id AND k.t = p.t)""",
    ),
)
def simulate_real_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = MaskSettings("real_clouds", occlude_above=0.1)
    return _pixel_rows(simulated(spark, sf_dir, settings), ["b0_in"])


@register(
    "union_masks",
    query("united", "SELECT sample_id, t, y, x, mask FROM united"),
)
def union_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel_rows(simulated(spark, sf_dir), [])


@register(
    "occlude_frames",
    query(
        "pix",
        """SELECT sample_id, t, y, x, CASE WHEN avg(cloud_mask) OVER (PARTITION BY sample_id, t) > 0.3
  THEN 1 ELSE cloud_mask END AS mask FROM pix""",
    ),
)
def occlude_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = scene_frames(spark, sf_dir)
    return _pixel_rows(frames.withColumn("mask", quality.occlude(F.col("cloud_mask"), 0.3)), [])


@register(
    "dilate",
    query(
        "pix",
        """SELECT a.sample_id, a.t, a.y, a.x, max(b.cloud_mask) AS mask FROM pix a JOIN pix b
  ON b.sample_id = a.sample_id AND b.t = a.t AND abs(b.y - a.y) + abs(b.x - a.x) <= 1
GROUP BY a.sample_id, a.t, a.y, a.x""",
    ),
)
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel_rows(geometry.dilate(scene_frames(spark, sf_dir), "cloud_mask", out="mask"), [])


def _noise(b: str) -> str:
    h = hexa(0, f"noise_{b}", "sample_id", "t", "y * 4 + x")
    return (
        f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, sqrt(-2.0::DOUBLE * ln({uniform(h)})) "
        f"* cos(2.0::DOUBLE * pi() * {uniform(h, 14)}) * 0.5::DOUBLE))"
    )


@register(
    "fill_noise",
    query(
        "pix",
        f"""SELECT sample_id, t, y, x, round(CASE WHEN cloud_mask = 1 THEN {clean('b0')} + {_noise('b0')} ELSE {clean('b0')} END, 6) AS b0_in,
  cloud_mask AS mask FROM pix""",
    ),
)
def fill_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = clean_bands(scene_frames(spark, sf_dir), ["b0"]).withColumn("mask", F.col("cloud_mask"))
    out = gaps.fill_gaps(frames, ["b0"], "white_noise", suffix="_in")
    return _pixel_rows(out, ["b0_in"])


@register(
    "fill_mean",
    query(
        ("pix", "fr"),
        f"""SELECT p.sample_id, p.t, p.y, p.x, round(CASE WHEN p.cloud_mask = 1 THEN m.b0 ELSE {clean('p.b0')} END, 6) AS b0_in,
  round(CASE WHEN p.cloud_mask = 1 THEN m.b1 ELSE {clean('p.b1')} END, 6) AS b1_in, p.cloud_mask AS mask
FROM pix p LEFT JOIN (SELECT p.sample_id, avg({clean('b0')}) AS b0, avg({clean('b1')}) AS b1
  FROM pix p JOIN fr f ON f.sample_id = p.sample_id AND f.t = p.t
  WHERE f.valid_obs = 1 AND p.cloud_mask = 0 GROUP BY p.sample_id) m USING (sample_id)""",
    ),
)
def fill_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = clean_bands(scene_frames(spark, sf_dir), ["b0", "b1"])
    valid = frame_quality_of(spark, sf_dir).select("sample_id", "t", "valid_obs")
    rows = frames.join(valid, ["sample_id", "t"]).withColumn("mask", F.col("cloud_mask"))
    out = gaps.fill_gaps(rows, ["b0", "b1"], "mean", valid="valid_obs", suffix="_in")
    return _pixel_rows(out, ["b0_in", "b1_in"])


@register(
    "overlay_masks",
    query(
        ("pix", "fr"),
        f"""SELECT p.sample_id, p.t, p.y, p.x, coalesce(m.cloud_mask, 0) AS mask FROM pix p
JOIN (SELECT sample_id, t, row_number() OVER (PARTITION BY sample_id ORDER BY {hexa(2, 'overlay', 'sample_id', 't')}) - 1 AS r
      FROM fr) k ON k.sample_id = p.sample_id AND k.t = p.t
LEFT JOIN pix m ON m.sample_id = p.sample_id AND m.t = k.r AND m.t < 4 AND m.y = p.y AND m.x = p.x""",
    ),
)
def overlay_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = scene_frames(spark, sf_dir)
    masks = frames.where(F.col("t") < 4).select(
        "sample_id", F.col("t").alias("mask_no"), F.col("cloud_mask").alias("mask")
    )
    return _pixel_rows(gaps.overlay_masks(frames, masks, seed=2, pos="t"), [])
