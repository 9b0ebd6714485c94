"""Queries over frames: quality, selection, radiometry, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.catalog import register
from rasterweave.catalog.sql import BANDS, chains, clean, digits, hexa, query, uniform
from rasterweave.functions import grids, radiometry
from rasterweave.operators import attention, geometry, quality, sequences
from rasterweave.plans.simulate import clean_bands
from rasterweave.schema import CropSettings, FilterSettings, ReadOptions
from rasterweave.sources.driver_tables import (
    FRAME_COLUMNS,
    radar_frames,
    scene_frames,
    scene_pixels,
)
from rasterweave.sources.frames import pair_sensors

ARRAYS = [*BANDS, "cloud_prob", "cloud_mask"]
KEY = ["sample_id", "t", "y", "x"]


def _r(c: str | Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def frame_quality_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged frames by the rule with probabilities."""
    stats = quality.frame_statistics_arrays(scene_frames(spark, sf_dir))
    return quality.flag_frames(stats)


def _ids(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


_QUALITY_OUT = """SELECT sample_id, tile, t, round(cloud_pct, 6) AS cloud_pct, {prob}
  CAST(not_avail AS BIGINT) AS not_avail, CAST(impaired AS BIGINT) AS impaired, CAST(cloudy AS BIGINT) AS cloudy,
  valid_obs FROM {block}"""


def _quality_columns(df: DataFrame, prob: bool = True) -> DataFrame:
    shown = [_r("prob_pct", "prob_pct")] if prob else []
    return df.select(
        "sample_id", "tile", "t", _r("cloud_pct", "cloud_pct"), *shown,
        *_ids("not_avail", "impaired", "cloudy", "valid_obs"),
    )


_PROB = "round(prob_pct, 6) AS prob_pct,"


@register("frame_quality", query("fr", _QUALITY_OUT.format(block="fr", prob=_PROB)))
def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality_columns(frame_quality_of(spark, sf_dir))


@register("frame_quality_strict", query("fr_strict", _QUALITY_OUT.format(block="fr_strict", prob=_PROB)))
def frame_quality_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Second sensor layout: probabilities stored as fractions.
    there_and_back = lambda v: radiometry.fraction_to_percent(radiometry.percent_to_fraction(v))
    frames = scene_frames(spark, sf_dir).withColumn("cloud_prob", F.transform("cloud_prob", there_and_back))
    return _quality_columns(quality.flag_frames(quality.frame_statistics_arrays(frames), strict=True))


@register("frame_quality_noprob", query("fr_noprob", _QUALITY_OUT.format(block="fr_noprob", prob="")))
def frame_quality_noprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.frame_statistics_arrays(scene_frames(spark, sf_dir), prob=None)
    return _quality_columns(quality.flag_frames(stats, with_prob=False), prob=False)


_LISTS = {
    "idx_impaired_frames": "impaired",
    "idx_cloudy_frames": "cloudy",
    "idx_good_frames": "NOT impaired",
}


@register(
    "frame_status_lists",
    query(
        "fr",
        "SELECT sample_id, t // 4096 AS list_no, "
        + ", ".join(
            f"coalesce(string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) FILTER (WHERE {test}), '') AS {n}"
            for n, test in _LISTS.items()
        )
        + ", string_agg(CAST(valid_obs AS VARCHAR), ',' ORDER BY t) AS valid_obs FROM fr GROUP BY sample_id, t // 4096",
    ),
)
def frame_status_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = quality.status_lists(frame_quality_of(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return lists.select("sample_id", "list_no", *[text(c) for c in (*_LISTS, "valid_obs")])


@register(
    "frame_coverage",
    query("stats", "SELECT sample_id, t, round(coverage, 6) AS coverage FROM stats"),
)
def frame_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.frame_coverage(scene_frames(spark, sf_dir), mask="cloud_mask")
    return out.select("sample_id", "t", _r("coverage", "coverage"))


@register(
    "tile_counts",
    query(
        "fr",
        """SELECT tile, count(DISTINCT sample_id) AS n_samples,
  round(count(DISTINCT sample_id) / sum(count(DISTINCT sample_id)) OVER (), 6) AS share FROM fr GROUP BY tile""",
    ),
)
def tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.tile_counts(scene_frames(spark, sf_dir))
    return out.select("tile", "n_samples", _r("share", "share"))


@register("longest_run", query("best_run", "SELECT * FROM best_run"))
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.longest_good_run(frame_quality_of(spark, sf_dir))


@register("longest_run_gap", query("fr", "SELECT * FROM c", c=chains(28)))
def longest_run_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.longest_run_within_gap(frame_quality_of(spark, sf_dir), 28)


@register("max_invalid_run", query("invalid", "SELECT * FROM invalid"))
def max_invalid_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.max_invalid_run(frame_quality_of(spark, sf_dir))


_GOOD = "SELECT sample_id FROM fr GROUP BY sample_id HAVING sum(valid_obs) >= 5"


@register(
    "valid_sequences",
    query(
        ("fr", "invalid", "best_run", "chain28"),
        f"""SELECT 'good' AS rule, sample_id FROM ({_GOOD})
UNION ALL SELECT 'invalid', sample_id FROM ({_GOOD}) JOIN invalid USING (sample_id) WHERE max_invalid <= 2
UNION ALL SELECT 'gap', sample_id FROM ({_GOOD}) JOIN chain28 USING (sample_id) WHERE run_len >= 5
UNION ALL SELECT 'consecutive', sample_id FROM best_run WHERE run_len >= 3
UNION ALL SELECT 'radar', sample_id FROM ({_GOOD}) WHERE sample_id % 4 <> 0""",
    ),
)
def valid_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frame_quality_of(spark, sf_dir)
    rules = {
        "good": FilterSettings("cloud-free", 5),
        "invalid": FilterSettings("cloud-free", 5, max_num_consec_invalid=2, max_t_sampling=28),
        "gap": FilterSettings("cloud-free", 5, max_t_sampling=28),
        "consecutive": FilterSettings("cloud-free_consecutive", 3),
        "radar": FilterSettings("cloud-free", 5),
    }
    out = None
    for name, settings in rules.items():
        required = radar_frames(spark, sf_dir) if name == "radar" else None
        part = sequences.valid_samples(fr, settings, required=required)
        part = part.select(F.lit(name).alias("rule"), "sample_id")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "kept_frames",
    query(
        ("fr", "best_run", "chain28"),
        """SELECT 'good' AS rule, sample_id, t, valid_obs FROM fr WHERE valid_obs = 1
UNION ALL SELECT 'gap', f.sample_id, t, valid_obs FROM fr f JOIN chain28 USING (sample_id)
  WHERE valid_obs = 1 AND t BETWEEN run_start AND run_end
UNION ALL SELECT 'consecutive', f.sample_id, t,
  CASE WHEN t BETWEEN run_start AND run_end THEN valid_obs ELSE 0 END FROM fr f JOIN best_run USING (sample_id)
UNION ALL SELECT 'none', sample_id, t, 1 FROM fr""",
    ),
)
def kept_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frame_quality_of(spark, sf_dir)
    rules = {
        "good": FilterSettings("cloud-free", 5),
        "gap": FilterSettings("cloud-free", 5, max_t_sampling=28),
        "consecutive": FilterSettings("cloud-free_consecutive", 3, return_valid_obs_only=False),
        "none": FilterSettings(None),
    }
    out = None
    for name, settings in rules.items():
        part = sequences.select_frames(fr, settings)
        part = part.select(F.lit(name).alias("rule"), "sample_id", "t", *_ids("valid_obs"))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "black_frames",
    query(
        "pix",
        f"""SELECT DISTINCT sample_id FROM pix WHERE sample_id NOT IN (
  SELECT sample_id FROM pix GROUP BY sample_id, t
  HAVING sum({' + '.join(clean(b) for b in BANDS)}) = 0)""",
    ),
)
def black_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = clean_bands(scene_frames(spark, sf_dir), BANDS)
    return sequences.drop_black(frames, BANDS).select("sample_id").distinct()


@register("trim_window", query("trimmed", "SELECT sample_id, t, pos FROM trimmed"))
def trim_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frame_quality_of(spark, sf_dir)
    settings = FilterSettings("cloud-free", 5)
    ok = sequences.valid_samples(fr, settings)
    kept = sequences.select_frames(fr.join(ok, "sample_id", "left_semi"), settings)
    return sequences.trim_random_window(kept, 6).select("sample_id", "t", "pos")


@register(
    "pad_sequences",
    query(
        "fr",
        """SELECT s.sample_id, g.pos, coalesce(k.t, -1) AS t, CASE WHEN k.t IS NULL THEN 0 ELSE 1 END AS valid_obs
FROM (SELECT tile, sample_id, max(pos) + 1 AS n, max(max(pos) + 1) OVER (PARTITION BY tile) AS m
      FROM k GROUP BY tile, sample_id) s
CROSS JOIN LATERAL (SELECT unnest(range(s.m)) AS pos) g
LEFT JOIN k ON k.sample_id = s.sample_id AND k.pos = g.pos""",
        k="""SELECT tile, sample_id, t, row_number() OVER (PARTITION BY sample_id ORDER BY t) - 1 AS pos
FROM fr WHERE valid_obs = 1""",
    ),
)
def pad_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frame_quality_of(spark, sf_dir)
    kept = sequences.trim_random_window(fr.where(F.col("valid_obs") == 1), None)
    rows = kept.select("tile", "sample_id", "t", "pos", "valid_obs")
    out = sequences.pad_sequences(rows, {"t": F.lit(-1).cast("bigint")}, batch=["tile"])
    return out.select("sample_id", "pos", "t", *_ids("valid_obs"))


@register(
    "slice_time",
    query("fr", "SELECT sample_id, t, valid_obs FROM fr WHERE t >= 2 AND t < 7"),
)
def slice_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.slice_time(frame_quality_of(spark, sf_dir), 2, 7)
    return out.select("sample_id", "t", *_ids("valid_obs"))


# --- radiometry ---------------------------------------------------------------


@register(
    "clean_scale",
    query(
        "pix",
        f"""SELECT sample_id, t, y, x, round({clean('b0')}, 6) AS clean_b0,
  CASE WHEN b1 IS NOT NULL THEN round(greatest(0.0::DOUBLE, least(10000.0::DOUBLE, b1 * 12000)) / 10000, 6) END AS optical_b1,
  CASE WHEN b2 IS NOT NULL THEN round((greatest(-25.0::DOUBLE, least(0.0::DOUBLE, b2 * 40 - 35)) + 25) / 25, 6) END AS radar_b2,
  round(cloud_prob / 100, 6) AS prob FROM pix""",
    ),
)
def clean_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene_pixels(spark, sf_dir)
    return p.select(
        *_ids(*KEY),
        _r(radiometry.clean_reflectance(F.col("b0")), "clean_b0"),
        _r(radiometry.scale_optical(F.col("b1") * 12000), "optical_b1"),
        _r(radiometry.scale_radar(F.col("b2") * 40 - 35), "radar_b2"),
        _r(radiometry.percent_to_fraction(F.col("cloud_prob")), "prob"),
    )


@register(
    "select_bands",
    query(
        "pix",
        """SELECT sample_id, t, y, x, round(b2, 6) AS c0, round(b1, 6) AS c1, round(b0, 6) AS c2,
  CAST(cloud_mask AS DOUBLE) AS mask_channel FROM pix""",
    ),
)
def select_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only the chosen band arrays are unfolded.
    wanted = [f"b{p}" for p in ReadOptions(channels="rgb").band_positions]
    p = grids.explode_pixels(scene_frames(spark, sf_dir), [*wanted, "cloud_mask"], FRAME_COLUMNS)
    channels = F.concat(radiometry.band_vector(wanted), F.array(F.col("cloud_mask").cast("double")))
    at = lambda i: F.get(channels, F.lit(i))
    return p.select(*_ids(*KEY), *[_r(at(i), f"c{i}") for i in range(3)], at(3).alias("mask_channel"))


@register(
    "false_color",
    query(
        "pix",
        "SELECT sample_id, t, y, x, round(b3, 6) AS nir, round(b2, 6) AS red, round(b1, 6) AS green FROM pix",
    ),
)
def false_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb, nir = radiometry.output_positions("bgr-nir")
    p = scene_pixels(spark, sf_dir)
    out = radiometry.false_color(radiometry.band_vector(list(BANDS)), rgb, nir)
    names = ("nir", "red", "green")
    return p.select(*_ids(*KEY), *[_r(F.get(out, F.lit(i)), n) for i, n in enumerate(names)])


@register(
    "brightness",
    query(
        "pix",
        "SELECT sample_id, t, y, x, CASE WHEN b0 IS NOT NULL THEN round(least(1.0::DOUBLE, b0 * 1.7::DOUBLE), 6) END AS bright FROM pix",
    ),
)
def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene_pixels(spark, sf_dir)
    return p.select(*_ids(*KEY), _r(radiometry.apply_brightness(F.col("b0"), 1.7), "bright"))


@register(
    "sensor_pairing",
    """SELECT vec_id // 10 AS sample_id, vec_id % 10 AS t, i // 4 AS y, i % 4 AS x,
  round((greatest(-25.0::DOUBLE, least(0.0::DOUBLE, -50.0::DOUBLE * abs(CAST(embedding[i + 1] AS DOUBLE)))) + 25) / 25, 6) AS vv,
  round((greatest(-25.0::DOUBLE, least(0.0::DOUBLE, -50.0::DOUBLE * abs(CAST(embedding[17 + i] AS DOUBLE)))) + 25) / 25, 6) AS vh,
  CASE WHEN label = 9 THEN NULL ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    0.5::DOUBLE + CAST(embedding[i + 1] AS DOUBLE))), 6) END AS b0
FROM embeddings, range(16) r(i) WHERE (vec_id // 10) % 4 <> 0""",
)
def sensor_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    optical = scene_frames(spark, sf_dir).select("sample_id", "t", "width", "b0")
    scaled = radiometry.per_pixel(radiometry.scale_radar)
    radar = radar_frames(spark, sf_dir).withColumns({c: scaled(F.col(c)) for c in ("vv", "vh")})
    p = grids.explode_pixels(pair_sensors(optical, radar), ["vv", "vh", "b0"], ["sample_id", "t"])
    return p.select(*_ids(*KEY), *[_r(c, c) for c in ("vv", "vh", "b0")])


# --- geometry -----------------------------------------------------------------


def _pixels(frames: DataFrame, band: str = "b0") -> DataFrame:
    p = grids.explode_pixels(frames, [band, "cloud_mask"], ["sample_id", "t"])
    return p.select(*_ids(*KEY), _r(band, band), *_ids("cloud_mask"))


_CY = f"{digits(hexa(3, 'crop_y', 'sample_id'))} % 3"
_CX = f"{digits(hexa(3, 'crop_x', 'sample_id'))} % 2"


@register(
    "crop",
    query(
        "pix",
        f"""SELECT 'random' AS kind, sample_id, t, y - cy AS y, x - cx AS x, round(b0, 6) AS b0, cloud_mask
FROM (SELECT *, {_CY} AS cy, {_CX} AS cx FROM pix) WHERE y >= cy AND y < cy + 2 AND x >= cx AND x < cx + 3
UNION ALL SELECT 'center', sample_id, t, y - 1, x - 1, round(b0, 6), cloud_mask FROM pix
WHERE y BETWEEN 1 AND 2 AND x BETWEEN 1 AND 2""",
    ),
)
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = scene_frames(spark, sf_dir)
    parts = []
    for settings in (CropSettings("random", (2, 3)), CropSettings("center", (2, 2))):
        out = geometry.crop_frames(frames, ["b0", "cloud_mask"], settings, seed=3)
        parts.append(_pixels(out).select(F.lit(settings.type).alias("kind"), "*"))
    return parts[0].unionByName(parts[1])


_K = f"{digits(hexa(5, 'rotate', 'sample_id'))} % 4"


@register(
    "rotate90",
    query(
        "pix",
        f"""SELECT sample_id, t, CASE k WHEN 0 THEN y WHEN 1 THEN 3 - x WHEN 2 THEN 3 - y ELSE x END AS y,
  CASE k WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 3 - x ELSE 3 - y END AS x, round(b0, 6) AS b0, cloud_mask
FROM (SELECT *, {_K} AS k FROM pix)""",
    ),
)
def rotate90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(geometry.rotate_frames(scene_frames(spark, sf_dir), ["b0", "cloud_mask"], seed=5))


@register(
    "flip",
    query(
        "pix",
        f"""SELECT sample_id, t, CASE WHEN {uniform(hexa(5, 'flip_v', 'sample_id'))} < 0.5 THEN 3 - y ELSE y END AS y,
  CASE WHEN {uniform(hexa(5, 'flip_h', 'sample_id'))} < 0.5 THEN 3 - x ELSE x END AS x, round(b0, 6) AS b0, cloud_mask FROM pix""",
    ),
)
def flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = ["b0", "cloud_mask"]
    frames = geometry.flip_vertical(scene_frames(spark, sf_dir), arrays, seed=5)
    return _pixels(geometry.flip_horizontal(frames, arrays, seed=5))


def _axis(out: str, n_in: int, n_out: int, name: str) -> str:
    pos = f"greatest(0.0::DOUBLE, ({out} + 0.5::DOUBLE) * {n_in} / {n_out}::DOUBLE - 0.5::DOUBLE)"
    return (
        f"CAST(floor({pos}) AS BIGINT) AS {name}0, "
        f"least(CAST(floor({pos}) AS BIGINT) + 1, {n_in - 1}) AS {name}1, {pos} - floor({pos}) AS f{name}"
    )


@register(
    "resample_bilinear",
    query(
        "pix",
        """SELECT p.sample_id, p.t, g.y, g.x, round(sum(p.b0 * (
    CASE WHEN p.y = g.y0 THEN 1 - g.fy ELSE 0 END + CASE WHEN p.y = g.y1 THEN g.fy ELSE 0 END) * (
    CASE WHEN p.x = g.x0 THEN 1 - g.fx ELSE 0 END + CASE WHEN p.x = g.x1 THEN g.fx ELSE 0 END)), 6) AS b0
FROM pix p JOIN g ON p.y IN (g.y0, g.y1) AND p.x IN (g.x0, g.x1)
GROUP BY p.sample_id, p.t, g.y, g.x""",
        g=f"SELECT y, x, {_axis('y', 4, 6, 'y')}, {_axis('x', 4, 5, 'x')} FROM range(6) a(y), range(5) b(x)",
    ),
)
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.resample(scene_frames(spark, sf_dir), ["b0"], (6, 5))
    p = grids.explode_pixels(out, ["b0"], ["sample_id", "t"])
    return p.select(*_ids(*KEY), _r("b0", "b0"))


@register(
    "downsample_mean",
    query(
        "pix",
        """SELECT p.sample_id, p.t, g.y, g.x, round(avg(p.b0), 6) AS b0 FROM pix p
JOIN (SELECT y, x FROM range(3) a(y), range(2) b(x)) g
  ON p.y >= g.y * 4 // 3 AND p.y < CAST(ceil((g.y + 1) * 4 / 3) AS BIGINT)
 AND p.x >= g.x * 2 AND p.x < (g.x + 1) * 2
GROUP BY p.sample_id, p.t, g.y, g.x""",
    ),
)
def downsample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.resample(scene_frames(spark, sf_dir), ["b0"], (3, 2), "mean")
    p = grids.explode_pixels(out, ["b0"], ["sample_id", "t"])
    return p.select(*_ids(*KEY), _r("b0", "b0"))


# --- attention ----------------------------------------------------------------

_HEADS = 2


def _qkv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frame: one band each as query, key and two kinds of value."""
    f = scene_frames(spark, sf_dir)
    filled = {b: F.transform(b, lambda v: F.coalesce(v, F.lit(0.0))) for b in BANDS}
    f = f.withColumns(filled)
    return f.select(
        "sample_id", "t",
        F.col("b0").alias("q"), F.col("b1").alias("k"), F.col("b2").alias("v"), F.col("b3").alias("v2"),
        (F.col("t") != 9).alias("ok"),
    )


def _component(source: str, name: str) -> str:
    return f"coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CAST({source} AS DOUBLE))), 0.0::DOUBLE) AS {name}"


_QKV = (
    "SELECT vec_id // 10 AS sample_id, vec_id % 10 AS t, h, "
    + ", ".join(
        [f"CASE WHEN label = 9 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CAST(embedding[{base} + {width} * h + {i} + 1] AS DOUBLE))) AS {n}{i}"
         for n, base, width in (("q", 0, 8), ("k", 16, 8), ("v", 32, 8), ("u", 48, 8))
         for i in range(width)]
    )
    + " FROM embeddings, range(2) r(h)"
)
_SCORES = (
    "SELECT a.sample_id, a.h, a.t AS t_out, b.t AS t_in, "
    + ", ".join(f"b.{n}{i}" for n in "vu" for i in range(8)) + ", "
    "CASE WHEN b.t = 9 THEN -1000.0::DOUBLE ELSE ("
    + " + ".join(f"a.q{i} * b.k{i}" for i in range(8))
    + ") / sqrt(8.0::DOUBLE) END AS s FROM qkv a JOIN qkv b ON a.sample_id = b.sample_id AND a.h = b.h"
)
_WEIGHTS = """SELECT *, e / sum(e) OVER (PARTITION BY sample_id, h, t_out) AS w FROM (
  SELECT *, exp(s - max(s) OVER (PARTITION BY sample_id, h, t_out)) AS e FROM scores)"""


def _attended(value: str) -> str:
    """Weighted sums of both heads' values, head after head."""
    return ", ".join(
        f"round(sum(CASE WHEN h = {i // 8} THEN w * {value}{i % 8} END), 6) AS a{i}" for i in range(16)
    )


@register(
    "temporal_attention",
    "WITH qkv AS (" + _QKV + "), scores AS (" + _SCORES + "), weights AS (" + _WEIGHTS + """)
SELECT sample_id, t_out AS t, """ + _attended("v") + " FROM weights GROUP BY sample_id, t_out",
)
def temporal_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = attention.temporal_attention(
        _qkv(spark, sf_dir), n_head=_HEADS, keys=["sample_id"], valid="ok"
    )
    return out.select(
        "sample_id", "t", *[_r(F.get("attended", F.lit(i)), f"a{i}") for i in range(16)]
    )


@register(
    "apply_attention",
    "WITH qkv AS (" + _QKV + "), scores AS (" + _SCORES + "), weights AS (" + _WEIGHTS + """),
mean_w AS (SELECT sample_id, t_out, t_in, avg(w) AS w FROM weights GROUP BY ALL),
val AS (SELECT sample_id, t, """
    + ", ".join(f"max(CASE WHEN h = {i // 8} THEN u{i % 8} END) AS c{i}" for i in range(16))
    + """ FROM qkv GROUP BY ALL)
SELECT 'group' AS kind, sample_id, t_out AS t, """ + _attended("u") + """
FROM weights WHERE t_in <> 9 GROUP BY sample_id, t_out
UNION ALL
SELECT 'mean', m.sample_id, t_out, """ + ", ".join(f"round(sum(w * c{i}), 6)" for i in range(16)) + """
FROM mean_w m JOIN val ON val.sample_id = m.sample_id AND val.t = m.t_in WHERE t_in <> 9 GROUP BY m.sample_id, t_out""",
)
def apply_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _qkv(spark, sf_dir)
    weights = attention.attention_weights(rows, n_head=_HEADS, keys=["sample_id"], valid="ok")
    parts = []
    for mode in ("group", "mean"):
        out = attention.apply_attention(
            weights, rows, "v2", _HEADS, mode, keys=["sample_id"], valid="ok"
        )
        cols = [_r(F.get("attended", F.lit(i)), f"a{i}") for i in range(16)]
        parts.append(out.select(F.lit(mode).alias("kind"), "sample_id", "t", *cols))
    return parts[0].unionByName(parts[1])


_MAPS = """maps AS (SELECT a.vec_id // 10 AS sample_id, h AS head, a.vec_id % 10 AS t_out, b.vec_id % 10 AS t_in,
  m // 2 AS my, m % 2 AS mx, ((7 * a.vec_id + 3 * b.vec_id + 5 * h + m) % 11) / 11.0::DOUBLE AS w
FROM embeddings a JOIN embeddings b ON a.vec_id // 10 = b.vec_id // 10, range(2) r(h), range(4) q(m)),
ax AS (SELECT i, CAST(floor(p) AS BIGINT) AS lo, least(CAST(floor(p) AS BIGINT) + 1, 1) AS hi, p - floor(p) AS f
  FROM (SELECT i, greatest(0.0::DOUBLE, (i + 0.5::DOUBLE) / 2 - 0.5::DOUBLE) AS p FROM range(4) r(i))),
up AS (SELECT sample_id, head, t_out, t_in, a.i AS y, b.i AS x, sum(w
    * (CASE WHEN my = a.lo THEN 1 - a.f ELSE 0 END + CASE WHEN my = a.hi THEN a.f ELSE 0 END)
    * (CASE WHEN mx = b.lo THEN 1 - b.f ELSE 0 END + CASE WHEN mx = b.hi THEN b.f ELSE 0 END)) AS w
  FROM maps JOIN ax a ON my IN (a.lo, a.hi) JOIN ax b ON mx IN (b.lo, b.hi) GROUP BY ALL)"""


@register(
    "attention_maps",
    query(
        "pix",
        "SELECT 'group' AS kind, u.sample_id, t_out AS t, u.y, u.x, "
        + ", ".join(f"round(sum(CASE WHEN head = {i // 2} THEN w * {clean(b)} END), 6) AS {b}" for i, b in enumerate(BANDS))
        + " FROM up u JOIN pix p ON p.sample_id = u.sample_id AND p.t = u.t_in AND p.y = u.y AND p.x = u.x WHERE t_in <> 9 GROUP BY ALL"
        + " UNION ALL SELECT 'mean', u.sample_id, t_out, u.y, u.x, "
        + ", ".join(f"round(sum(w * {clean(b)}) / 2, 6)" for b in BANDS)
        + " FROM up u JOIN pix p ON p.sample_id = u.sample_id AND p.t = u.t_in AND p.y = u.y AND p.x = u.x WHERE t_in <> 9 GROUP BY ALL",
    ).replace("\nSELECT 'group'", ",\n" + _MAPS + "\nSELECT 'group'"),
)
def attention_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2x2 weight maps of two heads, enlarged and applied to the 4x4 frames."""
    frames = clean_bands(scene_frames(spark, sf_dir), BANDS)
    a = frames.select("sample_id", F.col("t").alias("t_out"))
    b = frames.select("sample_id", F.col("t").alias("t_in"))
    first, second = F.col("sample_id") * 10 + F.col("t_out"), F.col("sample_id") * 10 + F.col("t_in")
    head = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("head")
    weights = a.join(b, "sample_id").select("*", head).withColumn(
        "w", F.array(*[(7 * first + 3 * second + 5 * F.col("head") + m) % 11 / 11.0 for m in range(4)])
    )
    weights = weights.withColumns({"height": F.lit(2), "width": F.lit(2)})
    rows = frames.withColumn("ok", F.col("t") != 9)
    out = attention.apply_maps(weights, rows, list(BANDS), (4, 4), _HEADS, ("group", "mean"), "ok")
    return out.select(F.col("mode").alias("kind"), *_ids(*KEY), *[_r(b, b) for b in BANDS])
