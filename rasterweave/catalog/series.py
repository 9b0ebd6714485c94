"""Queries over univariate series and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.catalog import SQL, register
from rasterweave.catalog.sql import digits, hexa, query
from rasterweave.functions import calendar
from rasterweave.functions.encoding import positional_features
from rasterweave.operators import sequences, windows
from rasterweave.operators.impute import impute, last_visible
from rasterweave.schema import POSITION_STRATEGIES
from rasterweave.sources.cubes import inventory, tile_inventory
from rasterweave.sources.driver_tables import observations, table

_BACK = "(PARTITION BY sample_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_AHEAD = "(PARTITION BY sample_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _seen(col: str) -> str:
    return f"CASE WHEN mask = 0 THEN {col} END"


@register(
    "visibility_index",
    query(
        "obs",
        f"""SELECT sample_id, t, last_value({_seen('t')} IGNORE NULLS) OVER {_BACK} AS last_visible,
  first_value({_seen('t')} IGNORE NULLS) OVER {_AHEAD} AS next_visible FROM obs""",
    ),
)
def visibility_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return last_visible(obs, keys=["sample_id"]).select(
        "sample_id", "t", "last_visible", "next_visible"
    )


@register("visibility_index_blocked", SQL["visibility_index"])
def visibility_index_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the two-level numbering and scan, as for a very large user."""
    obs = observations(spark, sf_dir)
    return last_visible(obs, keys=["sample_id"], block_size=16).select(
        "sample_id", "t", "last_visible", "next_visible"
    )


_NEIGHBOURS = f"""SELECT *, last_value({_seen('t')} IGNORE NULLS) OVER {_BACK} AS t0,
  last_value({_seen('day')} IGNORE NULLS) OVER {_BACK} AS d0, last_value({_seen('v')} IGNORE NULLS) OVER {_BACK} AS v0,
  first_value({_seen('t')} IGNORE NULLS) OVER {_AHEAD} AS t1, first_value({_seen('day')} IGNORE NULLS) OVER {_AHEAD} AS d1,
  first_value({_seen('v')} IGNORE NULLS) OVER {_AHEAD} AS v1 FROM obs"""
_CASE = {
    "last": ("v0", "t0"),
    "next": ("v1", "t1"),
    "closest": (
        "CASE WHEN t1 IS NULL THEN v0 WHEN t0 IS NULL THEN v1 WHEN day - d0 <= d1 - day THEN v0 ELSE v1 END",
        "CASE WHEN t1 IS NULL THEN t0 WHEN t0 IS NULL THEN t1 WHEN day - d0 <= d1 - day THEN t0 ELSE t1 END",
    ),
    "linear": (
        "CASE WHEN t1 IS NULL THEN v0 WHEN t0 IS NULL THEN v1 WHEN t0 = t1 OR d0 = d1 THEN v0 "
        "ELSE v0 + (v1 - v0) * (CAST(day - d0 AS DOUBLE) / CAST(d1 - d0 AS DOUBLE)) END",
        None,
    ),
}


def _register_impute(mode: str) -> None:
    value, source = _CASE[mode]
    shown = f", {source} AS source" if source else ""

    @register(
        f"impute_{mode}",
        query("obs", f"SELECT sample_id, t, round({value}, 6) AS filled{shown} FROM n", n=_NEIGHBOURS),
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        obs = observations(spark, sf_dir)
        out = impute(
            obs, ["v"], [mode], keys=["sample_id"], return_source=mode != "linear"
        )
        cols = ["sample_id", "t", F.round(f"v_{mode}", 6).alias("filled")]
        if mode != "linear":
            cols.append(F.col(f"source_{mode}").alias("source"))
        return out.select(*cols)


for _mode in _CASE:
    _register_impute(_mode)


@register(
    "positions",
    query(
        "obs",
        """SELECT sample_id, t, dayofyear(acq_date) - 1 AS day_of_year,
  date_diff('day', first_value(acq_date) OVER (PARTITION BY sample_id ORDER BY t), acq_date) AS day_within_sequence,
  date_diff('day', DATE '2015-06-23', acq_date) AS absolute,
  row_number() OVER (PARTITION BY sample_id ORDER BY t) - 1 AS enumeration FROM obs""",
    ),
)
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = observations(spark, sf_dir)
    for s in POSITION_STRATEGIES:
        out = sequences.add_position(out, s, s.replace("-", "_"))
    return out.select("sample_id", "t", *[s.replace("-", "_") for s in POSITION_STRATEGIES])


def _cube_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cube file name per order: tile = customer, dates from the order."""
    orders = table(spark, sf_dir, "orders")
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 40).cast("int"))
    return orders.select(
        F.concat_ws(
            "/",
            F.lit("/cubes/iid_test_split/context"),
            F.concat(F.lit("tile"), F.col("o_custkey") % 50),
            F.concat(
                F.lit("context_cube"), F.col("o_orderkey"), F.lit("_"), start, F.lit("_"), end,
                F.lit("_c.npz"),
            ),
        ).alias("path")
    )


_NAMES = """SELECT o_orderkey, o_custkey % 50 AS tile_no, CAST(o_orderdate AS DATE) AS s,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS e FROM orders"""


@register(
    "expand_dates",
    "WITH n AS (" + _NAMES + """)
SELECT sample_id, k AS t, strftime(s + CAST(4 + 5 * k AS INTEGER), '%Y-%m-%d') AS acq_date FROM (
  SELECT 'tile' || tile_no || '/cube' || o_orderkey || '_' || s || '_' || e || '_c' AS sample_id, s, e,
    unnest(range(CASE WHEN e - s >= 4 THEN (e - s - 4) // 5 + 1 ELSE 0 END)) AS k FROM n)""",
)
def expand_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = calendar.sample_stem(F.col("path"))
    named = _cube_names(spark, sf_dir).select(stem.alias("sample_id"))
    return named.select(
        "sample_id", F.posexplode(calendar.frame_dates(F.col("sample_id"))).alias("t", "d")
    ).select("sample_id", F.col("t").cast("bigint").alias("t"), F.date_format("d", "yyyy-MM-dd").alias("acq_date"))


@register(
    "cube_inventory",
    "WITH n AS (" + _NAMES + """)
SELECT 'tile' || tile_no AS tile,
  'tile' || tile_no || '/cube' || o_orderkey || '_' || s || '_' || e || '_c' AS sample_id FROM n""",
)
def cube_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    licence = F.lit("/cubes/iid_test_split/context/LICENSE").alias("path")
    names = _cube_names(spark, sf_dir)
    return inventory(names.unionByName(names.select(licence))).select("tile", "sample_id")


@register(
    "tile_inventory",
    "WITH n AS (" + _NAMES + """)
SELECT 'tile' || tile_no AS tile, count(*) AS n_samples FROM n GROUP BY tile_no""",
)
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_inventory(_cube_names(spark, sf_dir))


@register(
    "positional_features",
    query(
        "obs",
        "SELECT sample_id, t, "
        + ", ".join(
            f"round({'sin' if i % 2 == 0 else 'cos'}(CAST(day AS DOUBLE) / pow(1000.0::DOUBLE, 2.0::DOUBLE * {(i % 4) // 2} / 4)), 6) AS f{i}"
            for i in range(8)
        )
        + " FROM obs",
    ),
)
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    obs = obs.withColumn("f", positional_features(F.col("day"), 4, repeat=2))
    return obs.select(
        "sample_id", "t", *[F.round(F.get("f", F.lit(i)), 6).alias(f"f{i}") for i in range(8)]
    )


_EVENT_RUNS = """SELECT sample_id, min(t) AS run_start, max(t) AS run_end, count(*) AS run_len
FROM (SELECT sample_id, t, t - row_number() OVER (PARTITION BY sample_id ORDER BY t) AS g
      FROM obs WHERE mask = 0) GROUP BY sample_id, g"""


@register(
    "longest_run_events",
    query(
        "obs",
        """SELECT s.sample_id, coalesce(r.run_start, 0) AS run_start, coalesce(r.run_end, 0) AS run_end,
  coalesce(r.run_len, 0) AS run_len FROM (SELECT DISTINCT sample_id FROM obs) s LEFT JOIN (
  SELECT * FROM runs WHERE run_len > 1
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY run_len DESC, run_start) = 1) r USING (sample_id)""",
        runs=_EVENT_RUNS,
    ),
)
def longest_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    quality = obs.withColumn("valid_obs", 1 - F.col("mask"))
    return sequences.longest_good_run(quality)


@register(
    "trim_events",
    query(
        "obs",
        f"""SELECT sample_id, t, p - CASE WHEN n > 20 THEN {digits(hexa(7, 'trim', 'sample_id'))} % (n - 20 + 1) ELSE 0 END AS pos
FROM kept_rows QUALIFY pos >= 0 AND pos < 20""",
        kept_rows="""SELECT sample_id, t, row_number() OVER (PARTITION BY sample_id ORDER BY t) - 1 AS p,
  count(*) OVER (PARTITION BY sample_id) AS n FROM obs WHERE mask = 0""",
    ).replace("QUALIFY", "WHERE"),
)
def trim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    kept = obs.where(F.col("mask") == 0)
    return sequences.trim_random_window(kept, 20, seed=7).select(
        "sample_id", "t", "pos"
    )


def window_plan_sql(source: str, window: int) -> str:
    """Recursive plan over ``source`` (sample_id, t, c, n), by the definition."""
    stride = window // 2
    reach = -(-stride // 2)
    return f"""WITH RECURSIVE {source},
due AS (SELECT a.sample_id, a.t AS t_start, a.n, a.t + {stride} AS due, b.c FROM src a
        LEFT JOIN src b ON b.sample_id = a.sample_id AND b.t = a.t + {stride}),
near AS (SELECT d.sample_id, d.t_start, f.t FROM due d JOIN src f ON f.sample_id = d.sample_id
           AND f.t BETWEEN greatest(0, d.due - {reach}) AND least(d.due + {reach}, d.n - 1)
         WHERE d.c > 0.1
         QUALIFY row_number() OVER (PARTITION BY d.sample_id, d.t_start ORDER BY f.c, abs(f.t - d.due), f.t) = 1),
succ AS (SELECT d.sample_id, d.t_start, d.n,
           CASE WHEN d.due + {window} > d.n THEN d.n - {window}
                WHEN d.c <= 0.1 THEN d.due ELSE least(m.t, d.n - {window}) END AS nxt
         FROM due d LEFT JOIN near m USING (sample_id, t_start)),
plan AS (SELECT DISTINCT sample_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS t_start, n FROM src
         UNION ALL
         SELECT p.sample_id, p.k + 1, s.nxt, p.n FROM plan p JOIN succ s
           ON s.sample_id = p.sample_id AND s.t_start = p.t_start WHERE p.t_start + {window} < p.n)
SELECT sample_id, k, t_start, least(t_start + {window}, n) AS t_end FROM plan"""


@register(
    "window_plan",
    window_plan_sql(
        query("obs", "").strip().removeprefix("WITH ")
        + """, src AS (SELECT sample_id, t, CAST(mask AS DOUBLE) AS c,
  count(*) OVER (PARTITION BY sample_id) AS n FROM obs)""",
        10,
    ),
)
def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    coverage = obs.select("sample_id", "t", F.col("mask").cast("double").alias("coverage"))
    return windows.plan_windows(coverage, 10)
