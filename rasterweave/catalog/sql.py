"""Named SQL building blocks for the counterparts of the queries."""

from __future__ import annotations

BANDS = ("b0", "b1", "b2", "b3")


def hexa(seed: int, purpose: str, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', '{purpose}', {', '.join(keys)}))"


def digits(h: str, start: int = 1, length: int = 13) -> str:
    return f"CAST('0x' || substr({h}, {start}, {length}) AS BIGINT)"


def uniform(h: str, start: int = 1) -> str:
    return f"((CAST({digits(h, start)} AS DOUBLE) + 0.5::DOUBLE) / {16**13}::DOUBLE)"


def _band(i: int) -> str:
    return (
        f"CASE WHEN label = 9 THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, "
        f"0.5::DOUBLE + CAST(embedding[{16 * i} + i + 1] AS DOUBLE))) END AS b{i}"
    )


def clean(b: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce({b}, 0.0::DOUBLE)))"


_E48 = "abs(CAST(embedding[48 + i + 1] AS DOUBLE))"

BLOCKS = {
    "obs": (
        (),
        """SELECT user_id AS sample_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
  CAST(ts AS DATE) AS acq_date,
  date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS mask,
  least(1.0::DOUBLE, value / 500) AS v, event_id, ts
FROM events""",
    ),
    "pix": (
        (),
        f"""SELECT vec_id // 10 AS sample_id, (vec_id // 10) % 5 AS tile, vec_id % 10 AS t,
  i // 4 AS y, i % 4 AS x,
  DATE '2018-01-01' + CAST(5 * (vec_id % 10) + (7 * vec_id) % 4
    + CASE WHEN (vec_id // 10) % 3 = 0 AND vec_id % 10 >= 5 THEN 45 ELSE 0 END AS INTEGER) AS acq_date,
  {', '.join(_band(i) for i in range(4))},
  least(100.0::DOUBLE, 200 * {_E48}) AS cloud_prob,
  CASE WHEN {_E48} > CASE WHEN label IN (0, 1, 2) THEN 0.08::DOUBLE ELSE 0.35::DOUBLE END
    THEN 1 ELSE 0 END AS cloud_mask
FROM embeddings, range(16) r(i)""",
    ),
    "stats": (
        ("pix",),
        """SELECT sample_id, tile, t, acq_date,
  100.0::DOUBLE * sum(cloud_mask) / count(*) AS cloud_pct,
  100.0::DOUBLE * sum(CASE WHEN cloud_prob > 1 THEN 1 ELSE 0 END) / count(*) AS prob_pct,
  bool_and(b0 IS NULL AND b1 IS NULL AND b2 IS NULL AND b3 IS NULL) AS not_avail,
  avg(cloud_mask) AS coverage
FROM pix GROUP BY ALL""",
    ),
    "fr": (
        ("stats",),
        """SELECT *, CASE WHEN impaired THEN 0 ELSE 1 END AS valid_obs,
  impaired AND NOT not_avail AS cloudy
FROM (SELECT *, not_avail OR cloud_pct >= 40 OR (prob_pct > 1 AND cloud_pct > 10)
        OR (prob_pct > 4 AND cloud_pct > 8) AS impaired FROM stats)""",
    ),
    "fr_strict": (
        ("stats",),
        """SELECT *, CASE WHEN impaired THEN 0 ELSE 1 END AS valid_obs,
  impaired AND NOT not_avail AS cloudy
FROM (SELECT *, not_avail OR cloud_pct >= 40 OR (prob_pct > 1 AND cloud_pct > 10)
        OR (prob_pct > 4 AND cloud_pct > 3.5) AS impaired FROM stats)""",
    ),
    "fr_noprob": (
        ("stats",),
        """SELECT *, CASE WHEN impaired THEN 0 ELSE 1 END AS valid_obs,
  impaired AND NOT not_avail AS cloudy
FROM (SELECT *, not_avail OR cloud_pct >= 5 AS impaired FROM stats)""",
    ),
    "good_runs": (
        ("fr",),
        """SELECT sample_id, min(t) AS run_start, max(t) AS run_end, count(*) AS run_len
FROM (SELECT sample_id, t, t - row_number() OVER (PARTITION BY sample_id ORDER BY t) AS g
      FROM fr WHERE valid_obs = 1)
GROUP BY sample_id, g""",
    ),
    "bad_runs": (
        ("fr",),
        """SELECT sample_id, count(*) AS run_len
FROM (SELECT sample_id, t, t - row_number() OVER (PARTITION BY sample_id ORDER BY t) AS g
      FROM fr WHERE valid_obs = 0)
GROUP BY sample_id, g""",
    ),
    "invalid": (
        ("fr", "bad_runs"),
        """SELECT s.sample_id, coalesce(max(b.run_len), 0) AS max_invalid
FROM (SELECT DISTINCT sample_id FROM fr) s LEFT JOIN bad_runs b USING (sample_id) GROUP BY s.sample_id""",
    ),
    "best_run": (
        ("fr", "good_runs"),
        """SELECT s.sample_id, coalesce(r.run_start, 0) AS run_start, coalesce(r.run_end, 0) AS run_end,
  coalesce(r.run_len, 0) AS run_len
FROM (SELECT DISTINCT sample_id FROM fr) s LEFT JOIN (
  SELECT * FROM good_runs WHERE run_len > 1
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY run_len DESC, run_start) = 1) r
USING (sample_id)""",
    ),
}


def chains(days: int) -> str:
    """Longest chain of good frames at most ``days`` apart, per sample of ``fr``."""
    return f"""SELECT s.sample_id, coalesce(r.run_start, 0) AS run_start,
  coalesce(r.run_end, 0) AS run_end, coalesce(r.run_len, 0) AS run_len
FROM (SELECT DISTINCT sample_id FROM fr) s LEFT JOIN (
  SELECT sample_id, min(t) AS run_start, max(t) AS run_end, count(*) AS run_len FROM (
    SELECT *, sum(brk) OVER (PARTITION BY sample_id ORDER BY t) AS g FROM (
      SELECT sample_id, t, CASE WHEN date_diff('day', lag(acq_date) OVER (PARTITION BY sample_id ORDER BY t),
        acq_date) <= {days} THEN 0 ELSE 1 END AS brk
      FROM fr WHERE valid_obs = 1))
  GROUP BY sample_id, g HAVING count(*) > 1
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, min(t)) = 1) r
USING (sample_id)"""


BLOCKS["chain28"] = (("fr",), chains(28))
BLOCKS["chain42"] = (("fr",), chains(42))

# Simulation: good frames of usable samples, gaps drawn and filled. Only one query trims them.
_TRIM = digits(hexa(0, "trim", "sample_id"))
BLOCKS["usable"] = (
    ("fr",),
    "SELECT sample_id FROM fr GROUP BY sample_id HAVING sum(valid_obs) >= 5",
)
BLOCKS["kept"] = (
    ("fr", "usable"),
    """SELECT sample_id, tile, t, acq_date, valid_obs,
  row_number() OVER (PARTITION BY sample_id ORDER BY t) - 1 AS p,
  count(*) OVER (PARTITION BY sample_id) AS n
FROM fr WHERE valid_obs = 1 AND sample_id IN (SELECT sample_id FROM usable)""",
)
BLOCKS["whole"] = (
    ("kept",),
    "SELECT sample_id, tile, t, acq_date, valid_obs, p AS pos FROM kept",
)
BLOCKS["trimmed"] = (
    ("kept",),
    f"""SELECT sample_id, tile, t, acq_date, valid_obs, pos FROM (
  SELECT *, p - CASE WHEN n > 6 THEN {_TRIM} % (n - 6 + 1) ELSE 0 END AS pos FROM kept)
WHERE pos >= 0 AND pos < 6""",
)
BLOCKS["quota"] = (
    ("whole",),
    f"""SELECT sample_id, n, 1 + {digits(hexa(0, 'ratio', 'sample_id'))} % n AS eff
FROM (SELECT sample_id, count(*) AS n FROM whole GROUP BY sample_id)""",
)
BLOCKS["drawn"] = (
    ("whole", "quota"),
    f"""SELECT *, CASE WHEN masked = 1 AND row_number() OVER (PARTITION BY sample_id
    ORDER BY masked DESC, {hexa(0, 'full', 'sample_id', 'pos')}) <= ceil(0.2::DOUBLE * eff)
    THEN 1 ELSE 0 END AS fully_masked
FROM (SELECT t.*, q.eff, CASE WHEN pos <> 0 AND row_number() OVER (PARTITION BY sample_id
    ORDER BY CASE WHEN pos <> 0 THEN 0 ELSE 1 END, {hexa(0, 'mask', 'sample_id', 'pos')})
    <= ceil(0.5::DOUBLE * eff) THEN 1 ELSE 0 END AS masked
  FROM whole t JOIN quota q USING (sample_id))""",
)
BLOCKS["donors"] = (
    ("stats", "usable"),
    f"""SELECT tile, sample_id AS donor_sample, t AS donor_t,
  row_number() OVER (PARTITION BY tile ORDER BY {hexa(0, 'donor_order', 'sample_id', 't')}) - 1 AS donor_no,
  count(*) OVER (PARTITION BY tile) AS n
FROM stats WHERE coverage >= 0.1 AND sample_id IN (SELECT sample_id FROM usable)""",
)
BLOCKS["draws"] = (
    ("drawn", "donors"),
    f"""SELECT d.sample_id, d.tile, d.t, o.donor_sample, o.donor_t
FROM (SELECT *, {digits(hexa(0, 'donor', 'sample_id', 't'))} AS h FROM drawn WHERE masked = 1) d
LEFT JOIN donors o ON o.tile = d.tile AND o.donor_no = d.h % o.n""",
)
BLOCKS["composed"] = (
    ("pix", "drawn", "draws"),
    f"""SELECT p.sample_id, p.tile, p.t, d.pos, p.acq_date, p.y, p.x, d.masked, d.fully_masked,
  {', '.join(f'{clean("p." + b)} AS {b}' for b in BANDS)}, p.cloud_mask,
  coalesce(l.cloud_mask, 0) AS mask
FROM pix p JOIN drawn d ON d.sample_id = p.sample_id AND d.t = p.t
LEFT JOIN draws w ON w.sample_id = p.sample_id AND w.t = p.t
LEFT JOIN pix l ON l.sample_id = w.donor_sample AND l.t = w.donor_t AND l.y = p.y AND l.x = p.x""",
)
BLOCKS["united"] = (
    ("composed",),
    "SELECT * REPLACE (CASE WHEN mask > 0 OR cloud_mask = 1 THEN 1 ELSE 0 END AS mask) FROM composed",
)
BLOCKS["dilated"] = (
    ("united",),
    """SELECT a.* REPLACE ((SELECT max(b.mask) FROM united b WHERE b.sample_id = a.sample_id
    AND b.t = a.t AND abs(b.y - a.y) + abs(b.x - a.x) <= 1) AS mask) FROM united a""",
)
BLOCKS["sim"] = (
    ("united",),
    f"SELECT *, {', '.join(f'CASE WHEN mask = 1 THEN 1.0::DOUBLE ELSE {b} END AS {b}_in' for b in BANDS)} FROM united",
)


def _filled(modes=("last", "next", "closest", "linear")) -> str:
    one = "PARTITION BY sample_id, y, x ORDER BY t"
    back = f"({one} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"({one} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    seen = lambda c: f"CASE WHEN mask = 0 THEN {c} END"
    cols = []
    for c in ("t", "day", *[f"{b}_in" for b in BANDS]):
        cols.append(f"last_value({seen(c)} IGNORE NULLS) OVER {back} AS {c}_0")
        cols.append(f"first_value({seen(c)} IGNORE NULLS) OVER {ahead} AS {c}_1")
    return (
        f"SELECT *, {', '.join(cols)} FROM "
        "(SELECT *, date_diff('day', DATE '1970-01-01', acq_date) AS day FROM sim)"
    )


BLOCKS["seen"] = (("sim",), _filled())


def fill(mode: str, v: str) -> str:
    """Filled value from neighbour columns ``<c>_0`` and ``<c>_1``."""
    if mode == "last":
        return f"{v}_0"
    if mode == "next":
        return f"{v}_1"
    head = f"CASE WHEN t_1 IS NULL THEN {v}_0 WHEN t_0 IS NULL THEN {v}_1 "
    if mode == "closest":
        return head + f"WHEN day - day_0 <= day_1 - day THEN {v}_0 ELSE {v}_1 END"
    return head + (
        f"WHEN t_0 = t_1 OR day_0 = day_1 THEN {v}_0 ELSE {v}_0 + ({v}_1 - {v}_0) "
        f"* (CAST(day - day_0 AS DOUBLE) / CAST(day_1 - day_0 AS DOUBLE)) END"
    )


BLOCKS["filled"] = (
    ("seen",),
    " UNION ALL ".join(
        f"SELECT '{m}' AS method, sample_id, t, y, x, mask, cloud_mask, {', '.join(BANDS)}, "
        + ", ".join(f"{fill(m, b + '_in')} AS p_{b}" for b in BANDS)
        + " FROM seen"
        for m in ("last", "next", "closest", "linear")
    ),
)


def _metric_sums(source: str, keys: str, where: str, unit: str = "deg") -> str:
    d = [f"(p_{b} - {b})" for b in BANDS]
    ae = " + ".join(f"coalesce(abs({x}), 0)" for x in d)
    se = " + ".join(f"coalesce({x} * {x}, 0)" for x in d)
    n = " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in d)
    dot = " + ".join(f"p_{b} * {b}" for b in BANDS)
    pn = " + ".join(f"p_{b} * p_{b}" for b in BANDS)
    yn = " + ".join(f"{b} * {b}" for b in BANDS)
    conv = "degrees" if unit == "deg" else ""
    aggs = []
    for s, test in (("all", "TRUE"), ("occluded", "mask = 1"), ("observed", "mask = 0")):
        f = f"FILTER (WHERE {test})"
        aggs.append(
            f"sum(ae) {f} / nullif(sum(n) {f}, 0) AS mae_{s}, sum(se) {f} / nullif(sum(n) {f}, 0) AS mse_{s}, "
            f"avg(angle) {f} AS sam_{s}"
        )
    return f"""SELECT {keys}, {', '.join(aggs)} FROM (
  SELECT *, CASE WHEN norms > 0 THEN {conv}(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, dot / norms)))) END AS angle
  FROM (SELECT {keys}, mask, cloud_mask, {ae} AS ae, {se} AS se, {n} AS n, {dot} AS dot,
          sqrt({pn}) * sqrt({yn}) AS norms FROM {source} WHERE {where}))
GROUP BY {keys}"""


BLOCKS["method_sums"] = (
    ("filled",), _metric_sums("filled", "method, sample_id", "cloud_mask = 0")
)
def metrics_sql(sums: str, keys: str) -> str:
    """All metrics by stratum from a table of ``_metric_sums``."""
    return f"SELECT {keys}, " + ", ".join(
        f"mae_{s}, mse_{s}, sqrt(mse_{s}) AS rmse_{s}, "
        f"CASE WHEN mse_{s} = 0 THEN 'inf'::DOUBLE ELSE 20 * log10(1 / sqrt(nullif(mse_{s}, 0))) END AS psnr_{s}, sam_{s}"
        for s in ("all", "occluded", "observed")
    ) + f" FROM {sums}"


BLOCKS["method_metrics"] = (("method_sums",), metrics_sql("method_sums", "method, sample_id"))


def query(needs: tuple[str, ...] | str, body: str, **extra: str) -> str:
    """``body`` with the blocks it needs, in dependency order, as a WITH clause."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in BLOCKS[name][0]:
            visit(n)
        order.append(name)

    for name in (needs,) if isinstance(needs, str) else needs:
        visit(name)
    parts = [f"{n} AS ({BLOCKS[n][1]})" for n in order]
    parts += [f"{n} AS ({sql})" for n, sql in extra.items()]
    head = "WITH RECURSIVE " if "RECURSIVE" in body or any("UNION ALL SELECT r." in p for p in parts) else "WITH "
    return head + ",\n".join(parts) + "\n" + body.replace("/*RECURSIVE*/", "")
