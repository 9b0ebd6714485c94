"""Queries over imputed rasters and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.catalog import SQL, register
from rasterweave.catalog.frames import _ids, _r
from rasterweave.catalog.series import window_plan_sql
from rasterweave.catalog.simulation import simulated
from rasterweave.catalog.sql import BANDS, _metric_sums, clean, fill, metrics_sql, query
from rasterweave.functions import grids
from rasterweave.operators import metrics, windows
from rasterweave.operators.sequences import best_by_objective
from rasterweave.plans import evaluate
from rasterweave.plans.simulate import clean_bands
from rasterweave.schema import IMPUTE_MODES
from rasterweave.sources.driver_tables import scene_frames, table
from rasterweave.sources.settle import settle

STRATA = metrics.STRATA


@register(
    "impute_raster",
    query(
        "seen",
        "SELECT sample_id, t, y, x, "
        + ", ".join(
            f"round({fill(m, b + '_in')}, 6) AS {b}_{m}" for b in BANDS for m in IMPUTE_MODES
        )
        + " FROM seen",
    ),
)
def impute_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = evaluate.impute_pixels(simulated(spark, sf_dir), list(BANDS))
    return filled.select(
        *_ids("sample_id", "t", "y", "x"),
        *[_r(f"{b}_{m}", f"{b}_{m}") for b in BANDS for m in IMPUTE_MODES],
    )


_MEASURES = ("mae", "mse", "rmse", "psnr", "sam")


def _shown(measure: str, stratum: str):
    """Rounded; an infinite PSNR is shown as NULL."""
    name = f"{measure}_{stratum}"
    return F.when(F.abs(name) < float("inf"), F.round(name, 6)).alias(name)


def _shown_sql(measure: str, stratum: str) -> str:
    name = f"{measure}_{stratum}"
    return f"CASE WHEN NOT isinf({name}) THEN round({name}, 6) END AS {name}"


_WIDE = [(m, s) for m in _MEASURES for s in STRATA]


@register(
    "metrics_by_sequence",
    query(
        "method_metrics",
        "SELECT method, sample_id, " + ", ".join(_shown_sql(*c) for c in _WIDE) + " FROM method_metrics",
    ),
)
def metrics_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.score_modes(simulated(spark, sf_dir), list(BANDS))
    return out.select("method", "sample_id", *[_shown(*c) for c in _WIDE])


@register(
    "metrics_by_sequence_arrays",
    query(
        "method_metrics",
        "SELECT method, sample_id, " + ", ".join(_shown_sql(*c) for c in _WIDE) + " FROM method_metrics",
    ),
)
def metrics_by_sequence_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.score_modes_arrays(simulated(spark, sf_dir), list(BANDS), block_pixels=8)
    return out.select("method", "sample_id", *[_shown(*c) for c in _WIDE])


# --- SSIM -----------------------------------------------------------------------

_W = grids.gaussian_weights(metrics.SSIM_WINDOW, metrics.SSIM_SIGMA)


def _ssim_blocks(source: str, pred: str, keys: str = "sample_id") -> dict[str, str]:
    """Blocks up to ``dis``, a value per frame, for predictions ``pred`` (of a band) in ``source``."""
    same = " AND ".join(f"n.{k} = c.{k}" for k in keys.split(", "))
    keyed = ", ".join(f"c.{k}" for k in keys.split(", "))
    return {
        "pair": " UNION ALL ".join(
            f"SELECT {keys}, t, y, x, '{b}' AS band, {pred.format(b=b)} AS p, {b} AS q FROM {source}" for b in BANDS
        ),
        "w": "SELECT * FROM (VALUES "
        + ", ".join(f"({i - 2}, {w!r}::DOUBLE)" for i, w in enumerate(_W))
        + ") v(d, w)",
        "local": f"""SELECT {keyed}, c.t, c.band, c.y, c.x,
  sum(wy.w * wx.w * n.p) AS mp, sum(wy.w * wx.w * n.q) AS mq, sum(wy.w * wx.w * n.p * n.p) AS mpp,
  sum(wy.w * wx.w * n.q * n.q) AS mqq, sum(wy.w * wx.w * n.p * n.q) AS mpq
FROM pair c JOIN pair n ON {same} AND n.t = c.t AND n.band = c.band
JOIN w wy ON wy.d = n.y - c.y JOIN w wx ON wx.d = n.x - c.x GROUP BY ALL HAVING count(n.p) = count(*)""",
        "dis": f"""SELECT {keys}, t, avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 -
    (2 * mp * mq + 0.0001::DOUBLE) * (2 * (mpq - mp * mq) + 0.0009::DOUBLE) /
    ((mp * mp + mq * mq + 0.0001::DOUBLE) * (mpp - mp * mp + mqq - mq * mq + 0.0009::DOUBLE)))) / 2) AS d
FROM local GROUP BY {keys}, t""",
        "gap": "SELECT sample_id, t, max(mask) AS g FROM sim GROUP BY sample_id, t",
    }


_SSIM = _ssim_blocks("sim", "{b}_in")
_FILLED_SSIM = {
    **_ssim_blocks("filled", "p_{b}", "method, sample_id"),
    "structure": """SELECT method, sample_id, 1 - 2 * avg(d) AS ssim_all, 1 - 2 * avg(d) FILTER (WHERE g = 1) AS ssim_occluded,
  1 - 2 * avg(d) FILTER (WHERE g = 0) AS ssim_observed FROM dis JOIN gap USING (sample_id, t) GROUP BY method, sample_id""",
}


_LONG = " UNION ALL ".join(
    [
        f"SELECT method, 'masked_{m}' AS metric, '{s}' AS stratum, {m}_{s} AS value FROM method_metrics"
        for m in ("mae", "mse", "rmse", "psnr", "sam")
        for s in STRATA
    ]
    + [f"SELECT method, 'ssim' AS metric, '{s}' AS stratum, ssim_{s} AS value FROM structure" for s in STRATA]
)
_MEANS = """SELECT method, metric, stratum, avg(value) AS mean, count(value) AS n
FROM long WHERE value IS NOT NULL GROUP BY ALL"""


def mode_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summarize(evaluate.score_modes_tiles(simulated(spark, sf_dir), list(BANDS)))


@register(
    "metrics_by_mode",
    query(
        "method_metrics",
        """SELECT method, metric, stratum, CASE WHEN isinf(mean) THEN NULL ELSE round(mean, 6) END AS mean, n FROM means""",
        **_FILLED_SSIM,
        long=_LONG,
        means=_MEANS,
    ),
)
def metrics_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics, SSIM included, from tiles with a halo."""
    # Infinite means (a perfect sequence) are shown as NULL.
    finite = F.when(F.col("mean") < float("inf"), F.round("mean", 6))
    return mode_means(spark, sf_dir).select("method", "metric", "stratum", finite.alias("mean"), "n")


@register("metrics_by_mode_merged", SQL["metrics_by_mode"])
def metrics_by_mode_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same means from stored states: of a first part of the sequences, then of those that came later."""
    scored = settle(evaluate.score_modes_tiles(simulated(spark, sf_dir), list(BANDS)))
    keys = ["method", "metric", "stratum"]
    states = [
        settle(metrics.mean_states(metrics.to_long(scored.where(part), ["method", "sample_id"], "masked_"), keys))
        for part in ("sample_id % 3 = 0", "sample_id % 3 <> 0")
    ]
    out = metrics.means_of_states(metrics.merge_states(states[0].unionByName(states[1]), keys), keys)
    finite = F.when(F.col("mean") < float("inf"), F.round("mean", 6))
    return out.select(*keys, finite.alias("mean"), "n")


@register(
    "best_run",
    query(
        "method_metrics",
        """SELECT metric, stratum, method AS run, CASE WHEN isinf(mean) THEN NULL ELSE round(mean, 6) END AS value FROM means
QUALIFY row_number() OVER (PARTITION BY metric, stratum
  ORDER BY round(CASE WHEN metric IN ('masked_psnr', 'ssim') THEN -mean ELSE mean END, 6), method) = 1""",
        **_FILLED_SSIM,
        long=_LONG,
        means=_MEANS,
    ),
)
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best fill by each metric and stratum."""
    # Rounded first: what differs by rounding errors only is a tie.
    runs = mode_means(spark, sf_dir).select("metric", "stratum", F.col("method").alias("run"), F.round("mean", 6).alias("value"))
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    return best_by_objective(runs, ["metric", "stratum"]).select("metric", "stratum", "run", finite.alias("value"))


_SIMPLE = _metric_sums(
    "(SELECT sample_id, mask, cloud_mask, " + ", ".join(f"{b}, {b}_in AS p_{b}" for b in BANDS) + " FROM sim)",
    "sample_id",
    "TRUE",
    "rad",
)


@register(
    "metrics_strata",
    query(
        "sim",
        "SELECT sample_id, " + ", ".join(_shown_sql(m, s) for m in _MEASURES for s in STRATA) + " FROM m",
        s=_SIMPLE,
        m=metrics_sql("s", "sample_id"),
    ),
)
def metrics_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the gappy input itself is from the target."""
    inputs = [f"{b}_in" for b in BANDS]
    parts = evaluate.frame_sums(simulated(spark, sf_dir), inputs, list(BANDS), sam_unit="rad", ssim=False)
    out = evaluate.metrics_of_tiles(parts, ["sample_id"], ssim=False)
    return out.select("sample_id", *[_shown(m, s) for m in _MEASURES for s in STRATA])


@register(
    "ssim",
    query(
        "sim",
        """SELECT sample_id, round(1 - 2 * avg(d), 6) AS ssim_all, round(1 - 2 * avg(d) FILTER (WHERE g = 1), 6) AS ssim_occluded,
  round(1 - 2 * avg(d) FILTER (WHERE g = 0), 6) AS ssim_observed FROM dis JOIN gap USING (sample_id, t) GROUP BY sample_id""",
        **_SSIM,
    ),
)
def ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = [f"{b}_in" for b in BANDS]
    parts = evaluate.frame_sums(simulated(spark, sf_dir), inputs, list(BANDS))
    out = evaluate.metrics_of_tiles(parts, ["sample_id"])
    return out.select("sample_id", *[_r(f"ssim_{s}", f"ssim_{s}") for s in STRATA])


WEIGHTS = {
    "l1_loss": 1.0,
    "l1_loss_occluded_input_pixels": 0.5,
    "l1_loss_observed_input_pixels": 0.25,
    "masked_l1_loss": 2.0,
    "ssim_loss": 0.1,
}
_ABS = " + ".join(f"abs({b}_in - {b})" for b in BANDS)


@register(
    "total_loss",
    query(
        "sim",
        "SELECT sample_id, "
        + ", ".join(f"round({k}, 6) AS {k}" for k in WEIGHTS)
        + ", round("
        + " + ".join(f"coalesce({k}, 0) * {w}::DOUBLE" for k, w in WEIGHTS.items())
        + ", 6) AS total_loss FROM terms JOIN ls USING (sample_id)",
        **_SSIM,
        terms=f"""SELECT sample_id, avg({_ABS}) / 4 AS l1_loss, avg({_ABS}) FILTER (WHERE mask = 1) / 4 AS l1_loss_occluded_input_pixels,
  avg({_ABS}) FILTER (WHERE mask = 0) / 4 AS l1_loss_observed_input_pixels,
  avg({_ABS}) FILTER (WHERE cloud_mask = 0) / 4 AS masked_l1_loss FROM sim GROUP BY sample_id""",
        ls="SELECT sample_id, avg(d) AS ssim_loss FROM dis GROUP BY sample_id",
    ),
)
def total_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = settle(simulated(spark, sf_dir))
    inputs = [f"{b}_in" for b in BANDS]
    parts = evaluate.frame_sums(frames, inputs, list(BANDS))
    clear = evaluate.frame_sums(frames, inputs, list(BANDS), cloud="cloud_mask", ssim=False)
    out = metrics.total_loss(evaluate.loss_terms_of_sums(parts, clear), WEIGHTS)
    return out.select("sample_id", *[_r(k, k) for k in WEIGHTS], _r("total_loss", "total_loss"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


@register(
    "sam_pairs",
    f"""SELECT a.vec_id, round(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_DOT.format(a='a.embedding', b='b.embedding')}
  / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')}))))), 6) AS angle
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def sam_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle between each vector and the next one."""
    vectors = table(spark, sf_dir, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    rows = vectors.select("vec_id", "embedding").join(after, "vec_id")
    angle = metrics.angle_of_arrays(F.col("embedding"), F.col("after"))
    return rows.select("vec_id", _r(angle, "angle"))


@register(
    "band_means_observed",
    query(
        ("pix", "fr"),
        f"""SELECT sample_id, {', '.join(f'round(avg({clean(b)}), 6) AS mean_{b}' for b in BANDS)}
FROM pix p JOIN fr f USING (sample_id, t) WHERE f.valid_obs = 1 AND p.cloud_mask = 0 GROUP BY sample_id""",
    ),
)
def band_means_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterweave.catalog.frames import frame_quality_of
    from rasterweave.operators.quality import band_means_observed as means

    frames = clean_bands(scene_frames(spark, sf_dir), BANDS)
    valid = frame_quality_of(spark, sf_dir).select("sample_id", "t", "valid_obs")
    out = means(frames.join(valid, ["sample_id", "t"]), list(BANDS), mask="cloud_mask")
    return out.select("sample_id", *[_r(f"mean_{b}", f"mean_{b}") for b in BANDS])


def _trend(t, values, weights):
    """Least-squares line per pixel (columns) over the frames (rows), by weight."""
    import numpy as np

    n = np.maximum(weights.sum(0), 1.0)
    mt, mv = (weights * t).sum(0) / n, (weights * values).sum(0) / n
    var = (weights * (t - mt) ** 2).sum(0)
    slope = np.where(var > 0, (weights * (t - mt) * (values - mv)).sum(0) / np.where(var > 0, var, 1.0), 0.0)
    return list(mv + slope * (t - mt))


def linear_trend(pdf):
    """All bands of one window of frames, from what clouds leave visible."""
    import numpy as np

    t = pdf["t"].to_numpy(dtype="float64")[:, None]
    w = 1.0 - np.stack(pdf["cloud_mask"].to_numpy()).astype("float64")
    made = {f"p_{b}": _trend(t, np.stack(pdf[b].to_numpy()), w) for b in BANDS}
    return pdf[["sample_id", "k", "t"]].assign(**made)


def linear_trend_of_input(pdf):
    """The same from simulated input."""
    import numpy as np

    t = pdf["t"].to_numpy(dtype="float64")[:, None]
    w = 1.0 - np.stack(pdf["mask"].to_numpy()).astype("float64")
    made = {f"p_{b}": _trend(t, np.stack(pdf[f"{b}_in"].to_numpy()), w) for b in BANDS}
    return pdf[["sample_id", "k", "t"]].assign(**made)


def _stitched_blocks(source: str, pixels: str, hidden: str, value: str) -> str:
    """Plan, trend per window, pixel and band, then one switch after the other; up to ``own`` and ``pred``.

    ``pixels`` has (sample_id, t, pixel, ...), t from 0.
    """
    plan = window_plan_sql(source, 4).rsplit("\nSELECT sample_id, k, t_start", 1)[0]
    each = " UNION ALL ".join(
        f"SELECT sample_id, t, pixel, '{b}' AS band, {value.format(b=b)} AS v, CAST(1 - {hidden} AS DOUBLE) AS o FROM {pixels}"
        for b in BANDS
    )
    return plan + f""",
win AS (SELECT sample_id, k, t_start, least(t_start + 4, n) AS t_end FROM plan),
long AS ({each}),
seen4 AS (
  SELECT w.sample_id, w.k, CAST(p.t AS DOUBLE) AS s, p.t, p.pixel, p.band, p.v, p.o
  FROM win w JOIN long p ON p.sample_id = w.sample_id AND p.t >= w.t_start AND p.t < w.t_end),
mid AS (
  SELECT sample_id, k, pixel, band, sum(o * s) / greatest(sum(o), 1) AS mt, sum(o * v) / greatest(sum(o), 1) AS mv
  FROM seen4 GROUP BY ALL),
line AS (
  SELECT sample_id, k, pixel, band, mt, mv, coalesce(sum(o * (s - mt) * (v - mv)) / nullif(sum(o * (s - mt) * (s - mt)), 0), 0) AS a
  FROM seen4 JOIN mid USING (sample_id, k, pixel, band) GROUP BY ALL),
pred AS (
  SELECT sample_id, k, t, pixel, band, mv + a * (s - mt) AS p FROM seen4 JOIN line USING (sample_id, k, pixel, band)),
gap4 AS (
  SELECT b.sample_id, b.k, b.t, a.k AS a, round(avg(abs(a.p - b.p)), 9) AS e
  FROM pred a JOIN pred b ON a.sample_id = b.sample_id AND a.t = b.t AND a.pixel = b.pixel AND a.band = b.band AND a.k < b.k
  GROUP BY ALL),
st AS (
  SELECT DISTINCT sample_id, CAST(0 AS BIGINT) AS k, [CAST(0 AS BIGINT)] AS starts FROM win
  UNION ALL
  SELECT * FROM (
    SELECT s.sample_id, s.k + 1 AS k, list_append(s.starts, g.t) AS starts
    FROM st s JOIN gap4 g ON g.sample_id = s.sample_id AND g.k = s.k + 1
      AND g.a = list_max(list_filter(range(len(s.starts)), lambda j: s.starts[j + 1] <= g.t))
    JOIN win w ON w.sample_id = s.sample_id AND w.k = s.k AND g.t >= w.t_start AND g.t < w.t_end
    QUALIFY row_number() OVER (PARTITION BY s.sample_id ORDER BY g.e, g.t) = 1)),
own AS (
  SELECT w.sample_id, t, max(w.k) AS owner
  FROM (SELECT w.sample_id, w.k, unnest(range(st.starts[w.k + 1], w.t_end)) AS t
    FROM win w JOIN st ON st.sample_id = w.sample_id AND st.k = w.k) w GROUP BY ALL),
wide AS (
  SELECT o.sample_id, o.t, o.owner, p.pixel, {", ".join(f"max(p.p) FILTER (WHERE p.band = '{b}') AS p_{b}" for b in BANDS)}
  FROM own o JOIN pred p ON p.sample_id = o.sample_id AND p.t = o.t AND p.k = o.owner GROUP BY ALL)"""


def _stitched_sql() -> str:
    source = query("stats", "").strip().removeprefix("WITH ") + """, src AS (
  SELECT sample_id, t, coverage AS c, count(*) OVER (PARTITION BY sample_id) AS n FROM stats),
placed AS (SELECT *, y * 4 + x AS pixel FROM pix)"""
    return _stitched_blocks(source, "placed", "cloud_mask", clean("{b}")) + f"""
SELECT sample_id, t, owner, pixel, {", ".join(f"round(p_{b}, 6) AS p_{b}" for b in BANDS)} FROM wide"""


@register("stitched_scores", _stitched_sql())
def stitched_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear trend per window, stitched."""
    frames = clean_bands(scene_frames(spark, sf_dir), list(BANDS))
    coverage = frames.select(
        "sample_id", "t", grids.mean(F.col("cloud_mask")).alias("coverage")
    )
    plan = settle(windows.plan_windows(coverage, 4))
    preds = [f"p_{b}" for b in BANDS]
    scored = windows.score_windows(
        frames.select("sample_id", "t", *BANDS, "cloud_mask"),
        plan,
        linear_trend,
        "sample_id bigint, k bigint, t bigint, " + ", ".join(f"{p} array<double>" for p in preds),
    )
    # Settled, so that the predictor runs once.
    out = windows.stitch_windows(settle(scored), plan, preds)
    return out.select("sample_id", "t", "owner", F.posexplode(F.arrays_zip(*preds)).alias("pixel", "v")).select(
        "sample_id", "t", "owner", *_ids("pixel"), *[_r(f"v.{p}", p) for p in preds]
    )


def _predictor_sql() -> str:
    source = query("sim", "").strip().removeprefix("WITH ") + """, placed AS (
  SELECT sample_id, t AS frame, pos AS t, y, x, y * 4 + x AS pixel, * EXCLUDE (sample_id, t, pos, y, x) FROM sim),
src AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM (SELECT sample_id, t, avg(mask) AS c FROM placed GROUP BY ALL))"""
    extra = {
        "scored": f"""SELECT a.sample_id, a.t, a.y, a.x, a.mask, a.cloud_mask, {", ".join(f"a.{b}, w.p_{b}" for b in BANDS)}
  FROM placed a JOIN wide w ON w.sample_id = a.sample_id AND w.t = a.t AND w.pixel = a.pixel""",
        "sums4": _metric_sums("scored", "sample_id", "cloud_mask = 0"),
        "m": metrics_sql("sums4", "sample_id"),
        **_ssim_blocks("scored", "p_{b}"),
        "gap": "SELECT sample_id, t, max(mask) AS g FROM placed GROUP BY sample_id, t",
        "structure": """SELECT sample_id, 1 - 2 * avg(d) AS ssim_all, 1 - 2 * avg(d) FILTER (WHERE g = 1) AS ssim_occluded,
  1 - 2 * avg(d) FILTER (WHERE g = 0) AS ssim_observed FROM dis JOIN gap USING (sample_id, t) GROUP BY sample_id""",
    }
    shown = ", ".join(_shown_sql(m, s) for m in (*_MEASURES, "ssim") for s in STRATA)
    blocks = _stitched_blocks(source, "placed", "mask", "{b}_in")
    return blocks + "".join(f",\n{n} AS ({sql})" for n, sql in extra.items()) + f"\nSELECT sample_id, {shown} FROM m JOIN structure USING (sample_id)"


@register("predictor_metrics", _predictor_sql())
def predictor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor of one's own from window plan to metrics, on simulated gaps."""
    out = evaluate.score_predictor(settle(simulated(spark, sf_dir)), list(BANDS), linear_trend_of_input, 4)
    return out.select("sample_id", *[_shown(m, s) for m in (*_MEASURES, "ssim") for s in STRATA])
