"""Queries for spatial statistics, projections, forecasts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrametra.functions import text
from terrametra.operators import cleaning as C
from terrametra.operators import market as M
from terrametra.operators import matching as J
from terrametra.operators import rollups as R
from terrametra.operators import spatial as X
from terrametra.operators import stats as S
from terrametra.plans import forecast as FC
from terrametra.plans import projection as P
from terrametra.plans import reports as RP
from terrametra.plans import streets as ST
from terrametra.plans.bindings import (
    CELL_EDGES,
    CELLS,
    EST,
    EVENTS,
    LISTINGS,
    MUNI,
    PRICED,
    STREETS,
    Tables,
    cell_values,
    establishments,
    events,
    listings,
    municipalities,
    streets,
)
from terrametra.plans.registry import query, r
from terrametra.session import durable

BASE = f"{MUNI}, {EST}, {CELLS}, {CELL_EDGES}"
RHO, SCALE = 1.2, 0.10


def _graph(t: Tables):
    c = durable(cell_values(t))
    return c, X.grid_edges(c)


@query("spatial_lag", f"WITH {BASE} SELECT cell_id, round(coalesce(l.m, 0), 6) AS lag FROM cells LEFT JOIN (SELECT src, avg(value) AS m FROM edges JOIN cells ON dst = cell_id GROUP BY 1) l ON src = cell_id")
def spatial_lag(t: Tables):
    c, e = _graph(t)
    return S.spatial_lag(c, e, "value", "lag").select("cell_id", r("lag").alias("lag"))


@query(
    "local_moran_front",
    f"""WITH {BASE}, z AS (SELECT cell_id, (value - avg(value) OVER ()) / (stddev_pop(value) OVER () + 1e-9) AS z FROM cells),
    l AS (SELECT src, avg(z) AS lag FROM edges JOIN z ON dst = cell_id GROUP BY 1)
    SELECT cell_id, round(z, 6) AS z, round(coalesce(lag, 0), 6) AS lag, z < -0.05 AND coalesce(lag, 0) > 0.15 AS front FROM z LEFT JOIN l ON src = cell_id""",
)
def local_moran_front(t: Tables):
    c, e = _graph(t)
    return S.local_moran(c, e, "value").select("cell_id", r("z").alias("z"), r("lag").alias("lag"), "front")


@query(
    "moran_i",
    f"""WITH {BASE}, z AS (SELECT cell_id, value - avg(value) OVER () AS z FROM cells)
    SELECT round((SELECT count(*) FROM z) / count(*) * sum(a.z * b.z) / ((SELECT sum(z * z) FROM z) + 1e-12), 6) AS moran, (SELECT count(*) FROM z) AS cells, count(*) AS pairs
    FROM edges JOIN z a ON src = a.cell_id JOIN z b ON dst = b.cell_id""",
)
def moran_i(t: Tables):
    c, e = _graph(t)
    return S.moran_index(c, e, "value").select(r("moran").alias("moran"), "cells", "pairs")


def steps_sql(start: str, steps: int, rho: str, bump: int | None = None, strength: float = 0.0, extra: str = "") -> str:
    """Table expressions v0..v{steps} of the projection; ``start`` selects cell_id, v, p, g, b (and ``extra``)."""
    part = f"PARTITION BY {extra}" if extra else ""
    key = f"{extra}, " if extra else ""
    using = f"({key}cell_id)"
    out = [f"v0 AS MATERIALIZED ({start})"]
    for i in range(steps):
        p = f"least(greatest(p + {strength} * b, 0), 1.35)" if bump == i else "p"
        out.append(
            f"""x{i} AS MATERIALIZED (SELECT *, (v - min(v) OVER ({part})) / (max(v) OVER ({part}) - min(v) OVER ({part}) + 1e-9) AS x FROM v{i}),
    v{i + 1} AS MATERIALIZED (SELECT {key}cell_id, v * (1 + g + {rho} * {SCALE} * coalesce(lag, 0) * ({p})) AS v, {p} AS p, g, b{', r' if extra else ''}
      FROM x{i} LEFT JOIN (SELECT {key}src AS cell_id, sum(x) / count(*) AS lag FROM edges JOIN x{i} ON dst = cell_id GROUP BY ALL) l USING {using})"""
        )
    return ",\n    ".join(out)


def long_sql(steps: int, extra: str = "") -> str:
    key = f"{extra}, " if extra else ""
    return "traj AS (" + " UNION ALL ".join(f"SELECT {key}cell_id, {i}::INT AS t, v AS value FROM v{i}" for i in range(steps + 1)) + ")"


_START = "SELECT cell_id, value AS v, potential AS p, growth AS g, 0.0e0 AS b FROM cells"
_BUMP = "SELECT cell_id, value AS v, potential AS p, growth AS g, exp(-((lng + 106) * (lng + 106) + (lat - 22) * (lat - 22)) / (2 * 1.2e0 * 1.2e0)) AS b FROM cells"
_GRIDC = f"""{EST}, cells AS (SELECT round_even(lng / 0.0028e0, 0)::BIGINT AS gx, round_even(lat / 0.0028e0, 0)::BIGINT AS gy, gx * 100000 + gy AS cell_id, avg(price) AS value, avg(emp) / 50 AS potential, 0.02e0 AS growth FROM est GROUP BY 1, 2),
  edges AS (SELECT a.cell_id AS src, b.cell_id AS dst FROM cells a JOIN cells b ON b.gx BETWEEN a.gx - 1 AND a.gx + 1 AND b.gy BETWEEN a.gy - 1 AND a.gy + 1 WHERE a.cell_id <> b.cell_id)"""


@query("diffusion_projection", f"WITH {_GRIDC}, {steps_sql(_START, 10, str(RHO))}, {long_sql(10)} SELECT cell_id, t, round(value, 3) AS value FROM traj")
def diffusion_projection(t: Tables):
    g = R.grid_rollup(establishments(t), "lng", "lat", 0.0028, {"value": F.avg("price"), "potential": F.avg("emp") / 50, "growth": F.lit(0.02)})
    cells = durable(g.withColumn("cell_id", F.col("gx") * 100000 + F.col("gy")))
    out = P.project(cells, X.grid_edges(cells), 10, RHO, SCALE)
    return out.select("cell_id", "t", r("value", 3).alias("value"))


@query("projection_bump", f"WITH {BASE}, {steps_sql(_BUMP, 4, str(RHO), 1, 0.6)}, {long_sql(4)} SELECT cell_id, t, round(value, 3) AS value FROM traj")
def projection_bump(t: Tables):
    c, e = _graph(t)
    out = P.project(P.gaussian_bump(c, -106.0, 22.0, 1.2), e, 4, RHO, SCALE, bump_year=1, bump_strength=0.6)
    return out.select("cell_id", "t", r("value", 3).alias("value"))


_FLOW_UNION = " UNION ALL ".join(
    f"SELECT src AS cell_id, dst AS neighbour, {i} AS t, a.v * {RHO} * {SCALE} * a.p * d.x / n.deg AS amount FROM edges JOIN x{i} a ON src = a.cell_id JOIN x{i} d ON dst = d.cell_id JOIN deg n USING (src)"
    for i in range(3)
)
_OWN_UNION = " UNION ALL ".join(f"SELECT cell_id, {i + 1} AS year, v * g AS own FROM v{i}" for i in range(3))
_ATTR = f"{BASE}, {steps_sql(_START, 3, str(RHO))}, deg AS (SELECT src, count(*) AS deg FROM edges GROUP BY 1), fl AS ({_FLOW_UNION}), ow AS ({_OWN_UNION})"


def _attribution(t: Tables):
    c, e = _graph(t)
    e = durable(e)
    trace = durable(P.project(c, e, 3, RHO, SCALE))
    return P.growth_attribution(trace, c, e, RHO, SCALE)


@query(
    "growth_attribution",
    f"WITH {_ATTR} SELECT cell_id, year::INT AS year, round(own, 4) AS own, round(coalesce(c, 0), 4) AS contagion FROM ow LEFT JOIN (SELECT cell_id, t + 1 AS year, sum(amount) AS c FROM fl GROUP BY 1, 2) USING (cell_id, year)",
)
def growth_attribution(t: Tables):
    yearly, _ = _attribution(t)
    return yearly.select("cell_id", "year", r("own", 4).alias("own"), r("contagion", 4).alias("contagion"))


@query("neighbour_shares", f"WITH {_ATTR} SELECT cell_id, neighbour, round(sum(amount), 4) AS total FROM fl GROUP BY 1, 2")
def neighbour_shares(t: Tables):
    _, shares = _attribution(t)
    return shares.select("cell_id", "neighbour", r("total", 4).alias("total"))


@query(
    "peak_year",
    f"WITH {_ATTR}, y AS (SELECT cell_id, year, own + coalesce(c, 0) AS inc FROM ow LEFT JOIN (SELECT cell_id, t + 1 AS year, sum(amount) AS c FROM fl GROUP BY 1, 2) USING (cell_id, year)) SELECT cell_id, arg_max(year, inc)::INT AS peak_year FROM y GROUP BY 1",
)
def peak_year(t: Tables):
    yearly, _ = _attribution(t)
    return P.peak_year(yearly.withColumn("increment", F.col("own") + F.col("contagion")))


SCENARIOS = [
    {"scenario": i, "rho": RHO * m, "growth_factor": gf, "potential_offset": po}
    for i, (m, gf, po) in enumerate([(0.8, 0.85, -0.05), (0.9, 1.0, 0.0), (1.0, 1.0, 0.05), (1.1, 1.1, 0.0), (1.2, 1.15, 0.1)])
]
_SCN = "scn(scenario, r, gf, po) AS (VALUES " + ", ".join(f"({s['scenario']}, {s['rho']}::DOUBLE, {s['growth_factor']}::DOUBLE, {s['potential_offset']}::DOUBLE)" for s in SCENARIOS) + ")"
_SCN_START = "SELECT scenario, cell_id, value AS v, least(greatest(potential + po, 0), 1.35) AS p, growth * gf AS g, 0.0e0 AS b, r FROM cells, scn"


@query(
    "scenario_bands",
    f"""WITH {BASE}, {_SCN}, {steps_sql(_SCN_START, 3, "r", extra="scenario")}, {long_sql(3, "scenario")}
    SELECT cell_id, t, round(quantile_cont(value, 0.1), 3) AS p10, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.9), 3) AS p90 FROM traj GROUP BY 1, 2""",
)
def scenario_bands(t: Tables):
    c, e = _graph(t)
    b = P.scenario_bands(P.project(c, e, 3, scale=SCALE, scenarios=SCENARIOS))
    return b.select("cell_id", "t", *[r(x, 3).alias(x) for x in ("p10", "p50", "p90")])


RHOS = [round(i * 0.05, 2) for i in range(31)]
_OBS = "obs AS (SELECT muni AS cell_id, avg(price) FILTER (WHERE year = 1996) AS first, avg(price) FILTER (WHERE year = 1996) * (1.05 + avg(price) FILTER (WHERE year = 1999) / 500000) AS last FROM est GROUP BY 1)"
_RHO_SCN = "scn(scenario, r) AS (SELECT range::INT, round(range * 0.05, 2)::DOUBLE FROM range(31))"
_RHO_START = "SELECT scenario, cell_id, first AS v, potential AS p, growth AS g, 0.0e0 AS b, r FROM cells JOIN obs USING (cell_id), scn"


def _observed(t: Tables):
    e = establishments(t)
    mean = lambda y: F.avg(F.when(F.col("year") == y, F.col("price")))
    return e.groupBy(F.col("muni").alias("cell_id")).agg(mean(1996).alias("first"), (mean(1996) * (1.05 + mean(1999) / 500000)).alias("last"))


@query(
    "mape_calibration",
    f"""WITH {BASE}, {_OBS}, {_RHO_SCN}, {steps_sql(_RHO_START, 3, "r", extra="scenario")}
    SELECT scenario, round(any_value(r), 2) AS rho, round(avg(abs(v / first - 1 - (last / first - 1)) / (abs(last / first - 1) + 1e-9)) * 100, 6) AS mape FROM v3 JOIN obs USING (cell_id) GROUP BY 1""",
)
def mape_calibration(t: Tables):
    c, e = _graph(t)
    out = P.calibrate_rho(c, e, durable(_observed(t)), RHOS, 3, SCALE)
    return out.select("scenario", r("rho", 2).alias("rho"), r("mape").alias("mape"))


@query(
    "best_rho",
    f"""WITH {BASE}, {_OBS}, {_RHO_SCN}, {steps_sql(_RHO_START, 3, "r", extra="scenario")},
    m AS (SELECT scenario, any_value(r) AS r, avg(abs(v / first - 1 - (last / first - 1)) / (abs(last / first - 1) + 1e-9)) * 100 AS mape FROM v3 JOIN obs USING (cell_id) GROUP BY 1)
    SELECT round(r, 2) AS rho, round(mape, 6) AS mape FROM m ORDER BY m.mape, scenario LIMIT 1""",
)
def best_rho(t: Tables):
    c, e = _graph(t)
    out = P.best_rho(P.calibrate_rho(c, e, durable(_observed(t)), RHOS, 3, SCALE))
    return out.select(r("rho", 2).alias("rho"), r("mape").alias("mape"))


@query(
    "nsmallest_error",
    f"""WITH {BASE}, {_OBS}, {steps_sql(_START.replace("value AS v", "first AS v").replace("FROM cells", "FROM cells JOIN obs USING (cell_id)"), 3, str(RHO))}
    SELECT cell_id, round(abs((v / first - 1) - (last / first - 1)) * 100, 6) AS error_pp FROM v3 JOIN obs USING (cell_id) ORDER BY 2, 1 LIMIT 5""",
)
def nsmallest_error(t: Tables):
    c, e = _graph(t)
    obs = durable(_observed(t))
    start = c.drop("value").join(obs.select("cell_id", F.col("first").alias("value")), "cell_id")
    final = P.project(start, e, 3, RHO, SCALE).filter("t = 3")
    return P.fit_errors(final, obs).select("cell_id", r("error_pp").alias("error_pp"))


_PROJ4 = f"{BASE}, {steps_sql(_START, 4, str(RHO))}, {long_sql(4)}"
# value at year 2.4: between t = 2 and t = 3
_AT = "av AS (SELECT a.cell_id, a.v * 0.6e0 + b.v * 0.4e0 AS value, (b.v - a.v) / a.v AS rate, o.v AS base FROM v2 a JOIN v3 b USING (cell_id) JOIN v0 o USING (cell_id))"


def _trajectories(t: Tables, steps: int = 4):
    c, e = _graph(t)
    return c, durable(P.project(c, e, steps, RHO, SCALE))


@query("interpolate_year", f"WITH {_PROJ4}, {_AT} SELECT cell_id, round(value, 3) AS value, round(rate, 8) AS rate, round(base, 4) AS base FROM av")
def interpolate_year(t: Tables):
    _, tr = _trajectories(t)
    return P.value_at(tr, 2.4, 4).select("cell_id", r("value", 3).alias("value"), r("rate", 8).alias("rate"), r("base", 4).alias("base"))


@query(
    "back_extend",
    f"""WITH {_PROJ4}, k AS (SELECT a.cell_id, -s.k AS t, a.v / pow(1 + (b.v / a.v - 1) * 0.8e0, s.k) AS value FROM v0 a JOIN v1 b USING (cell_id), (SELECT unnest(range(1, 6)) AS k) s)
    SELECT cell_id, t::INT AS t, round(value, 3) AS value FROM (SELECT * FROM k UNION ALL SELECT * FROM traj)""",
)
def back_extend(t: Tables):
    _, tr = _trajectories(t)
    return P.extend_back(tr).select("cell_id", "t", r("value", 3).alias("value"))


_SCORE = f"""{_AT}, sc AS (SELECT aw.*, cells.name, potential, value_ / base - 1 AS growth FROM (SELECT cell_id, value AS value_, rate, base FROM av) aw JOIN cells USING (cell_id)),
  s2 AS (SELECT *, (growth - min(growth) OVER ()) / (max(growth) OVER () - min(growth) OVER () + 1e-9) AS a, (rate - min(rate) OVER ()) / (max(rate) OVER () - min(rate) OVER () + 1e-9) AS b,
    (value_ - min(value_) OVER ()) / (max(value_) OVER () - min(value_) OVER () + 1e-9) AS c FROM sc),
  s3 AS (SELECT cell_id, name, round_even(10 * least(greatest(0.40 * a + 0.25 * potential + 0.20 * b + 0.15 * (1 - c), 0), 1), 1) AS score, value_, base, growth, rate, potential FROM s2)"""


@query(
    "ranking_table",
    f"""WITH {_PROJ4}, {_SCORE} SELECT cell_id, name, score, round(value_, 0) AS price, round(growth, 6) AS growth, round(rate, 6) AS rate, (cell_id % 3) AS inbound FROM s3""",
)
def ranking_table(t: Tables):
    c, tr = _trajectories(t)
    flows = c.select(F.explode(F.sequence(F.lit(1), (F.col("cell_id") % 3).cast("int"))).alias("k"), F.col("cell_id").alias("target")).filter("k > 0 and target % 3 > 0")
    flows = flows.filter(F.col("k") <= F.col("target") % 3)
    tab = RP.ranking_table(c.select("cell_id", "name", "potential"), tr, 2.4, 4, flows)
    return tab.select("cell_id", "name", "score", r("value", 0).alias("price"), r("growth").alias("growth"), r("rate").alias("rate"), "inbound")


@query("composite_score", f"WITH {_PROJ4}, {_SCORE} SELECT cell_id, score FROM s3")
def composite_score(t: Tables):
    c, tr = _trajectories(t)
    return RP.ranking_table(c.select("cell_id", "name", "potential"), tr, 2.4, 4).select("cell_id", "score")


@query("top40", f"WITH {_PROJ4}, {_SCORE} SELECT cell_id, score, round(growth, 6) AS growth FROM s3 ORDER BY s3.growth DESC, cell_id LIMIT 40")
def top40(t: Tables):
    c, tr = _trajectories(t)
    return RP.top_units(RP.ranking_table(c.select("cell_id", "name", "potential"), tr, 2.4, 4)).select("cell_id", "score", r("growth").alias("growth"))


@query(
    "trajectory_table",
    f"""WITH {_PROJ4}, g AS (SELECT a.cell_id, b.v / a.v - 1 AS growth FROM v0 a JOIN v4 b USING (cell_id) ORDER BY 2 DESC, 1 LIMIT 8)
    SELECT cell_id, t, round(value, 3) AS value, CASE WHEN growth = (SELECT max(growth) FROM g) THEN round(value, 3) END AS p50 FROM traj JOIN g USING (cell_id)""",
)
def trajectory_table(t: Tables):
    c, tr = _trajectories(t)
    bands = P.scenario_bands(tr, (0.5,))
    out = RP.trajectory_table(tr, 4, bands)
    return out.select("cell_id", "t", r("value", 3).alias("value"), r("p50", 3).alias("p50"))


@query(
    "phase_table",
    f"""WITH {_PROJ4}, {_AT}, q AS (SELECT quantile_cont(rate, 0.85) AS a, quantile_cont(rate, 0.55) AS b FROM av)
    SELECT cell_id, round(value, 3) AS price, round(rate * 100, 6) AS rate_pct, CASE WHEN rate >= a THEN 'mutation' WHEN rate >= b THEN 'expansion' ELSE 'latent' END AS phase FROM av, q""",
)
def phase_table(t: Tables):
    c, tr = _trajectories(t)
    return RP.phase_table(c, tr, 2.4, 4).select("cell_id", r("value", 3).alias("price"), r("rate_pct").alias("rate_pct"), "phase")


@query(
    "contagion_test",
    f"""WITH {EST}, o AS (SELECT min(lng) AS x, min(lat) AS y, quantile_cont(year, 0.6) AS cut FROM est),
    c AS (SELECT round_even((lng - x) / 0.0027e0, 0)::BIGINT AS gx, round_even((lat - y) / 0.0027e0, 0)::BIGINT AS gy, count(*) FILTER (WHERE year <= cut) AS b, count(*) FILTER (WHERE year > cut) AS a FROM est, o GROUP BY 1, 2),
    n AS (SELECT p.gx, p.gy, p.b, p.a, sum(q.b) - p.b AS nb FROM c p JOIN c q ON q.gx BETWEEN p.gx - 1 AND p.gx + 1 AND q.gy BETWEEN p.gy - 1 AND p.gy + 1 GROUP BY p.gx, p.gy, p.b, p.a)
    SELECT count(*) AS cells, round(corr(b, a), 6) AS r_own, round(corr(nb, a), 6) AS r_near, (SELECT cut FROM o) AS cut_year, corr(nb, a) > 0.25 AS spatial_term_supported FROM n""",
)
def contagion_test(t: Tables):
    out = S.contagion_test(establishments(t), "year")
    return out.select("cells", r("r_own").alias("r_own"), r("r_near").alias("r_near"), "cut_year", "spatial_term_supported")


@query(
    "corr_pre_post",
    f"""WITH {EST}, c AS (SELECT round_even(lng / 0.005e0, 0)::BIGINT AS gx, round_even(lat / 0.005e0, 0)::BIGINT AS gy, count(*) FILTER (WHERE year <= 1998) AS b, count(*) FILTER (WHERE year > 1998) AS a FROM est GROUP BY 1, 2),
    n AS (SELECT p.gx, p.gy, p.b, p.a, sum(q.b) - p.b AS nb FROM c p JOIN c q ON q.gx BETWEEN p.gx - 1 AND p.gx + 1 AND q.gy BETWEEN p.gy - 1 AND p.gy + 1 GROUP BY p.gx, p.gy, p.b, p.a)
    SELECT count(*) AS cells, round(corr(b, a), 6) AS r_own, round(corr(nb, a), 6) AS r_near FROM n""",
)
def corr_pre_post(t: Tables):
    e = establishments(t).withColumn("gx", F.rint(F.col("lng") / 0.005).cast("bigint")).withColumn("gy", F.rint(F.col("lat") / 0.005).cast("bigint"))
    out = S.corr_before_after(J.before_after(e, ["gx", "gy"], F.col("year") <= 1998))
    return out.select("cells", r("r_own").alias("r_own"), r("r_near").alias("r_near"))


_ANCHORS = f"""o AS (SELECT min(lng) AS x, min(lat) AS y FROM est),
  ac AS (SELECT round_even((lng - x) / 0.0025e0, 0)::BIGINT AS gx, round_even((lat - y) / 0.0025e0, 0)::BIGINT AS gy, sum(emp) AS emp, avg(lng) AS lng, avg(lat) AS lat FROM est, o GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 6),
  an AS (SELECT gx * 100000 + gy AS k, lng, lat, round_even(0.45 + 0.55 * ((emp - min(emp) OVER ()) / (max(emp) OVER () - min(emp) OVER () + 1e-9)), 3) AS weight FROM ac)"""


def _anchors(t: Tables):
    a = R.employment_anchors(establishments(t), "name", "emp", "pkey")
    return durable(a.withColumn("k", F.col("gx") * 100000 + F.col("gy")))


@query(
    "hedonic_ols",
    f"""WITH {EST}, {LISTINGS}, {PRICED}, {_ANCHORS},
    d AS (SELECT a.id, a.pm2, min(12742.0e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) AS km
      FROM priced a, an b WHERE operation = 'venta' AND pm2 > 3000 AND pm2 < 200000 GROUP BY 1, 2),
    y AS (SELECT km, ln(pm2) AS y FROM d), q AS (SELECT quantile_cont(km, 0.97) AS f, quantile_cont(y, 0.02) AS lo, quantile_cont(y, 0.98) AS hi FROM y),
    k AS (SELECT km, y FROM y, q WHERE km <= f AND y >= lo AND y <= hi),
    s AS (SELECT count(*) AS n, regr_slope(y, km) AS b, regr_intercept(y, km) AS a, regr_r2(y, km) AS r2, regr_sxx(y, km) AS sxx, regr_syy(y, km) AS syy, avg(km) AS m, max(km) AS x FROM k),
    e AS (SELECT *, sqrt(syy * (1 - r2) / (n - 2) / sxx) AS se FROM s)
    SELECT n, round((exp(b) - 1) * 100, 5) AS pct_per_km, round((exp(b - 1.645 * se) - 1) * 100, 5) AS pct_low, round((exp(b + 1.645 * se) - 1) * 100, 5) AS pct_high, round(r2, 6) AS r2, round(m, 6) AS km_mean, round(x, 6) AS km_max, round(exp(a), 3) AS price_at_anchor FROM e""",
)
def hedonic_ols(t: Tables):
    p = C.with_unit_price(listings(t)).filter((F.col("operation") == "venta") & (F.col("pm2") > 3000) & (F.col("pm2") < 200000))
    near = X.nearest(p.select("id", "pm2", "lng", "lat"), _anchors(t), "k", metric="haversine")
    out = S.hedonic_gradient(near, "near_dist", "pm2")
    return out.select("n", *[r(c, 5).alias(c) for c in ("pct_per_km", "pct_low", "pct_high")], *[r(c).alias(c) for c in ("r2", "km_mean", "km_max")], r("price_at_anchor", 3).alias("price_at_anchor"))


PANELQ = """pq AS (SELECT s_nationkey::BIGINT AS zone, ((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) + 2000)::INT AS y, avg(l_extendedprice) AS idx FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
FIRST, LAST = 2008, 2028
RATES = f"""{PANELQ}, {MUNI}, z AS (SELECT DISTINCT zone FROM pq), gr0 AS (SELECT zone, t::INT AS t FROM z, range({FIRST}, {LAST + 1}) s(t)),
  gr AS (SELECT g.zone, g.t, a.idx AS x, CASE WHEN b.idx <> 0 AND a.idx <> 0 THEN a.idx / b.idx - 1 END AS g1, CASE WHEN c.idx <> 0 AND a.idx <> 0 THEN pow(a.idx / c.idx, 1.0e0 / 3) - 1 END AS g3
    FROM gr0 g LEFT JOIN pq a ON a.zone = g.zone AND a.y = g.t LEFT JOIN pq b ON b.zone = g.zone AND b.y = g.t - 1 LEFT JOIN pq c ON c.zone = g.zone AND c.y = g.t - 3),
  nat AS (SELECT t, avg(g3) AS nat FROM gr GROUP BY 1), f AS (SELECT gr.*, nat, coalesce(nullif(g3, 0), nat) AS tr FROM gr JOIN nat USING (t)),
  w AS (SELECT a.cell_id AS a, b.cell_id AS b, 1.0e0 / greatest(12742.0e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))), 50) AS w
    FROM muni a JOIN muni b ON a.cell_id <> b.cell_id WHERE a.cell_id IN (SELECT zone FROM z) AND b.cell_id IN (SELECT zone FROM z)),
  nb AS (SELECT f.t, w.a AS zone, sum(w * tr) / sum(w) AS nb FROM w JOIN f ON f.zone = w.b GROUP BY 1, 2),
  hz(h, w1, w2, w3, w4) AS (VALUES (1, 0.18e0, 0.06e0, 0.01e0, 0.75e0), (3, 0.34e0, 0.01e0, 0.03e0, 0.62e0)),
  rt AS (SELECT f.zone, f.t, h, 0.5 * (0.5 * g1 + 0.3 * g3 + 0.2 * nat) + 0.5 * (w1 * g1 + w2 * g3 + w3 * nat + w4 * nb) AS rate, g1, nat, x, n.idx AS xn
    FROM f JOIN nb USING (t, zone) CROSS JOIN hz LEFT JOIN pq n ON n.zone = f.zone AND n.y = f.t + h),
  ev AS (SELECT zone, t, h, xn / x - 1 AS real, pow(1 + rate, h) - 1 AS pred, pow(1 + g1, h) - 1 AS persist, pow(1 + nat, h) - 1 AS national FROM rt WHERE x IS NOT NULL AND xn IS NOT NULL AND rate IS NOT NULL)"""


def _panel_q(t: Tables):
    li = t.lineitem.select("l_suppkey", "l_extendedprice", ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") + 2000).alias("year"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("zone"))
    p = li.join(s, li.l_suppkey == s.s_suppkey).groupBy("zone", "year").agg(F.avg("l_extendedprice").alias("idx"))
    zones = p.select("zone").distinct()
    coords = municipalities(t).select(F.col("cell_id").alias("zone"), "lat", "lng").join(zones, "zone", "left_semi")
    return durable(p), durable(coords)


@query("ensemble_rates", f"WITH {RATES} SELECT zone, t, h, round(rate, 8) AS rate, round(g1, 8) AS g1, round(nat, 8) AS nat FROM rt")
def ensemble_rates(t: Tables):
    p, c = _panel_q(t)
    return FC.ensemble_rates(p, c, FIRST, LAST).select("zone", "t", "h", r("rate", 8).alias("rate"), r("g1", 8).alias("g1"), r("nat", 8).alias("nat"))


def _bands_sql(lead: str) -> str:
    return f"""o AS (SELECT DISTINCT h, t FROM ev), bd AS (SELECT o.h, o.t, quantile_cont(e.real - e.pred, 0.05) * CASE o.h WHEN 1 THEN 2.0 ELSE 1.85 END AS lo,
      quantile_cont(e.real - e.pred, 0.95) * CASE o.h WHEN 1 THEN 2.0 ELSE 1.85 END AS hi FROM o JOIN ev e ON e.h = o.h AND e.t + {lead} <= o.t GROUP BY 1, 2 HAVING count(*) >= 20)"""


_WALK = """SELECT h, round(avg(abs(pred - real) * 100), 6) AS mae_model, round(avg(abs(persist - real) * 100), 6) AS mae_persistence, round(avg(abs(national - real) * 100), 6) AS mae_national,
  count(*) AS n, count(DISTINCT t) AS origins, round(avg((real >= pred + lo AND real <= pred + hi)::INT) * 100, 6) AS coverage_pct FROM ev LEFT JOIN bd USING (h, t) GROUP BY 1"""


def _walk(t: Tables, strict: bool):
    p, c = _panel_q(t)
    w = FC.walk_forward(p, c, FIRST, LAST, strict=strict)
    return w.select("h", *[r(x).alias(x) for x in ("mae_model", "mae_persistence", "mae_national", "coverage_pct")], "n", "origins")


@query("walk_forward", f"WITH {RATES}, {_bands_sql('ev_h')} {_WALK}".replace("e.t + ev_h", "e.t + e.h"))
def walk_forward(t: Tables):
    return _walk(t, True)


@query("walk_forward_parity", f"WITH {RATES}, {_bands_sql('1')} {_WALK}")
def walk_forward_parity(t: Tables):
    return _walk(t, False)


@query("expanding_quantile", f"WITH {RATES}, {_bands_sql('ev_h')} SELECT h, t, round(lo, 8) AS lo, round(hi, 8) AS hi FROM bd".replace("e.t + ev_h", "e.t + e.h"))
def expanding_quantile(t: Tables):
    p, c = _panel_q(t)
    rows = durable(FC.evaluate_rows(FC.ensemble_rates(p, c, FIRST, LAST - 1)))
    seen = rows.select("h", "t").distinct()
    return FC.expanding_bands(rows, LAST).join(seen, ["h", "t"]).select("h", "t", r("lo", 8).alias("lo"), r("hi", 8).alias("hi"))


@query(
    "mae_coverage",
    f"WITH {RATES} SELECT h, round(avg(abs(pred - real) * 100), 6) AS mae_model, round(avg(abs(persist - real) * 100), 6) AS mae_persistence, round(avg(abs(national - real) * 100), 6) AS mae_national, count(*) AS n, count(DISTINCT t) AS origins, round(avg((abs(pred - real) < 0.05)::INT) * 100, 6) AS coverage_pct FROM ev GROUP BY 1",
)
def mae_coverage(t: Tables):
    p, c = _panel_q(t)
    rows = FC.evaluate_rows(FC.ensemble_rates(p, c, FIRST, LAST))
    out = FC.mae_table(rows.withColumn("inside", F.abs(F.col("pred") - F.col("real")) < 0.05))
    return out.select("h", *[r(x).alias(x) for x in ("mae_model", "mae_persistence", "mae_national", "coverage_pct")], "n", "origins")


@query(
    "panel_forecast",
    f"""WITH {RATES}, b AS (SELECT h, quantile_cont(real - pred, 0.05) * CASE h WHEN 1 THEN 2.0 ELSE 1.85 END AS lo, quantile_cont(real - pred, 0.95) * CASE h WHEN 1 THEN 2.0 ELSE 1.85 END AS hi FROM ev WHERE t + h < {LAST} GROUP BY 1),
    tg(h, bh, st) AS (VALUES (1, 1, 1.0e0), (3, 3, 1.0e0), (5, 3, 5 / 3.0e0), (10, 3, 10 / 3.0e0))
    SELECT zone, tg.h, round(pow(1 + rate, tg.h), 6) AS f, round(greatest(pow(1 + rate, tg.h) + lo * st, 0.5), 6) AS lo, round(pow(1 + rate, tg.h) + hi * st, 6) AS hi, round(rate, 8) AS g1
    FROM rt JOIN tg ON rt.h = tg.bh JOIN b ON b.h = tg.bh WHERE rt.t = {LAST} AND rate IS NOT NULL""",
)
def panel_forecast(t: Tables):
    p, c = _panel_q(t)
    f = FC.forecast(p, c, LAST, FIRST)
    return f.select("zone", "h", r("f").alias("f"), r("lo").alias("lo"), r("hi").alias("hi"), r("g1", 8).alias("g1"))


_ZS = """zs AS (SELECT c_nationkey::BIGINT AS zone, avg(o_totalprice) / 10000 AS appreciation, avg(c_acctbal) / 1000 AS yield_, stddev_pop(o_totalprice) / 10000 AS volatility, (count(*) % 90)::DOUBLE AS dom, (1 + c_nationkey % 3)::DOUBLE AS opp
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)"""


def _part(c: str, inv: bool = False) -> str:
    e = f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"
    return f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 50 ELSE least(greatest({'1 - ' if inv else ''}{e}, 0), 1) * 100 END"


@query(
    "zone_score",
    f"""WITH {_ZS}, p AS (SELECT zone, {_part('appreciation')} AS a, {_part('yield_')} AS b, {_part('volatility', True)} AS c, {_part('dom', True)} AS d, {_part('opp')} AS e FROM zs),
    s AS (SELECT *, floor(a * 0.35 + b * 0.2 + c * 0.2 + d * 0.1 + e * 0.15 + 0.5)::BIGINT AS score FROM p)
    SELECT zone, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade, floor(a + 0.5)::BIGINT AS s_appreciation, floor(c + 0.5)::BIGINT AS s_volatility FROM s""",
)
def zone_score(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    z = j.groupBy(F.col("c_nationkey").cast("bigint").alias("zone")).agg(
        (F.avg("o_totalprice") / 10000).alias("appreciation"),
        (F.avg("c_acctbal") / 1000).alias("yield"),
        (F.stddev_pop("o_totalprice") / 10000).alias("volatility"),
        (F.count("*") % 90).cast("double").alias("days_on_market"),
    )
    z = z.withColumn("opportunity", (1 + F.col("zone") % 3).cast("double"))
    return S.zone_score(z).select("zone", "score", "grade", "s_appreciation", "s_volatility")


@query(
    "compare_units",
    f"""WITH {_ZS}, a AS (SELECT * FROM zs WHERE zone = 3), b AS (SELECT * FROM zs WHERE zone = 9)
    SELECT 'appreciation' AS metric, round(a.appreciation, 6) AS value_a, round(b.appreciation, 6) AS value_b, CASE WHEN a.appreciation > b.appreciation THEN 'a' ELSE 'b' END AS winner FROM a, b UNION ALL
    SELECT 'volatility', round(a.volatility, 6), round(b.volatility, 6), CASE WHEN a.volatility < b.volatility THEN 'a' ELSE 'b' END FROM a, b UNION ALL
    SELECT 'opportunity', a.opp, b.opp, CASE WHEN a.opp = b.opp THEN 'tie' WHEN a.opp > b.opp THEN 'a' ELSE 'b' END FROM a, b""",
)
def compare_units(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    z = j.groupBy(F.col("c_nationkey").cast("bigint").alias("zone")).agg((F.avg("o_totalprice") / 10000).alias("appreciation"), (F.stddev_pop("o_totalprice") / 10000).alias("volatility"))
    z = z.withColumn("opportunity", (1 + F.col("zone") % 3).cast("double"))
    out = S.compare_units(z, "zone", 3, 9, {"appreciation": True, "volatility": False, "opportunity": True})
    return out.select("metric", r("value_a").alias("value_a"), r("value_b").alias("value_b"), "winner")


@query(
    "cosine_twins",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1), z AS (SELECT vec_id, i, (v - m) / (s + 1e-9) AS z FROM x JOIN st USING (i)),
    ref AS (SELECT i, z AS rz FROM z WHERE vec_id = 7), c AS (SELECT vec_id, sum(z * rz) / (sqrt(sum(z * z)) * sqrt(sum(rz * rz)) + 1e-9) AS s FROM z JOIN ref USING (i) WHERE vec_id <> 7 GROUP BY 1)
    SELECT vec_id, round(least(greatest(s, 0), 1), 6) AS similarity FROM c ORDER BY s DESC, vec_id LIMIT 10""",
)
def cosine_twins(t: Tables):
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return S.cosine_twins(e, "v", "vec_id", 7).select("vec_id", r("similarity").alias("similarity"))


_ROLL = """ru AS (SELECT street, count(*) AS n_estab, sum(emp) AS employment, count(*) FILTER (WHERE contains(name, 'GIZMO') AND year >= 2000) AS indicators FROM est GROUP BY 1)"""


@query(
    "economic_dossier",
    f"""WITH {EST}, {MUNI}, {_ROLL}, ar AS (SELECT c_custkey AS unit, -110.0e0 + 8 * ((c_custkey * 7919 % 1000) * 0.001e0) AS lng, 18.0e0 + 8 * ((c_custkey * 613 % 1000) * 0.001e0) AS lat, 12000.0e0 + 100 * c_nationkey AS sp, (c_nationkey % 10) / 10.0e0 AS pot FROM customer),
    d AS (SELECT ar.unit, arg_min(m.cell_id, (sqrt(pow(ar.lng - m.lng, 2) + pow(ar.lat - m.lat, 2)), m.cell_id)) AS metro, min(sqrt(pow(ar.lng - m.lng, 2) + pow(ar.lat - m.lat, 2))) AS d FROM ar, muni m GROUP BY 1),
    j AS (SELECT ar.*, metro, d, exp(-pow((d - 0.22e0) / 0.22e0, 2)) AS ring, coalesce(n_estab, 0) AS n, coalesce(employment, 0) AS e, coalesce(indicators, 0) AS i FROM ar JOIN d USING (unit) LEFT JOIN ru ON ru.street = ar.unit),
    k AS (SELECT *, (ln(1 + e) - min(ln(1 + e)) OVER ()) / (max(ln(1 + e)) OVER () - min(ln(1 + e)) OVER () + 1e-9) AS en, (i - min(i) OVER ()) / (max(i) OVER () - min(i) OVER () + 1e-9) AS inn, least(greatest(0.55e0 * pot + 0.50e0 * ring, 0.02), 1) AS mp FROM j),
    v AS (SELECT *, ln(1 + n) + 0.6e0 * en AS raw FROM k), x AS (SELECT *, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 1e-9) AS vital FROM v)
    SELECT unit, metro, round_even(d * 105, 0) AS metro_km, n AS n_estab, e::BIGINT AS employment, i AS indicators, round(CASE WHEN n > 0 THEN vital END, 6) AS vitality,
    round(CASE WHEN n > 0 THEN sp * (0.35e0 + 1.3e0 * vital) ELSE sp * (0.42e0 + 0.78e0 * exp(-pow(d / 0.30e0, 2))) END, 0) AS price,
    round_even(CASE WHEN n > 0 THEN least(greatest(0.45e0 * mp + 0.30e0 * ring + 0.25e0 * inn, 0.02), 1) ELSE mp END, 3) AS potential FROM x""",
)
def economic_dossier(t: Tables):
    k = F.col("c_custkey")
    areas = t.customer.select(
        k.alias("unit"),
        (F.lit(-110.0) + 8 * ((k * 7919 % 1000) * F.lit(0.001))).alias("lng"),
        (F.lit(18.0) + 8 * ((k * 613 % 1000) * F.lit(0.001))).alias("lat"),
        (F.lit(12000.0) + 100 * F.col("c_nationkey")).alias("state_price"),
        ((F.col("c_nationkey") % 10) / 10.0).alias("state_potential"),
    )
    roll = establishments(t).groupBy(F.col("street").alias("unit")).agg(
        F.count("*").alias("n_estab"),
        F.sum("emp").alias("employment"),
        F.lit(0.0).alias("resilience"),
        F.sum((F.col("name").contains("GIZMO") & (F.col("year") >= 2000)).cast("bigint")).alias("indicators"),
    )
    metros = municipalities(t).select(F.col("cell_id").alias("metro"), "lng", "lat")
    d = ST.economic_dossier(areas, roll, metros, "unit")
    return d.select("unit", "metro", "metro_km", "n_estab", F.col("employment").cast("bigint").alias("employment"), "indicators", r("vitality").alias("vitality"), "price", "potential")


TRADES = ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"]
_DOSSIER = f"""{EST}, {STREETS}, {_ANCHORS}, q AS (SELECT quantile_cont(year, 0.6) AS cut FROM est),
  a AS (SELECT street, count(*) AS n, sum(emp) AS e, count(*) FILTER (WHERE year >= cut) AS ro FROM est, q GROUP BY 1),
  m AS (SELECT street, trade FROM (SELECT street, trade, row_number() OVER (PARTITION BY street ORDER BY count(*) DESC, trade) AS p FROM est GROUP BY 1, 2) WHERE p = 1),
  h0 AS (SELECT street, trade, count(*) AS c FROM est GROUP BY 1, 2), h AS (SELECT street, (-sum(c / n * ln(c / n)) - (6 - count(*)) * 1e-9 * ln(1e-9)) / ln(6) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY street) AS n FROM h0) GROUP BY 1),
  px AS (SELECT s.street, sum(an.weight * exp(-(pow(s.lng - an.lng, 2) + pow(s.lat - an.lat, 2)) / (2.0e0 * 0.012e0 * 0.012e0))) AS prox FROM streets s, an GROUP BY 1),
  j AS (SELECT s.street, s.lng, s.lat, coalesce(n, 0) AS n, coalesce(e, 0) AS e, coalesce(trade, 'Servicios') AS trade, coalesce(h, 0) AS h, coalesce(ro, 0) AS ro, prox FROM streets s LEFT JOIN a USING (street) LEFT JOIN m USING (street) LEFT JOIN h USING (street) JOIN px USING (street)),
  v0 AS (SELECT *, ln(1 + n) + 0.6e0 * ln(1 + e) AS raw FROM j), v AS (SELECT *, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 1e-9) AS vital, (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER () + 1e-9) AS busy, least(greatest(prox, 0), 1) AS near FROM v0),
  ds AS (SELECT street, n AS n_estab, e::BIGINT AS employment, trade AS sector, round_even(vital, 3) AS vitality, round_even(least(greatest(prox, 0), 1.3), 3) AS anchor_proximity, round_even(9000 + 9500 * vital + 6500 * near, 0) AS value,
    round_even(least(greatest(0.50 * near + 0.35 * (1 - vital) + 0.15 * busy, 0.02), 1), 3) AS potential, round_even(h, 3) AS resilience, ro AS recent_openings, ro = 0 AND n >= 10 AS stagnant FROM v)"""


def _dossier(t: Tables):
    return ST.street_dossier(streets(t).select("street", "lng", "lat"), establishments(t), _anchors(t), "street", "trade", "emp", "year", TRADES)


@query("street_dossier", f"WITH {_DOSSIER} SELECT * FROM ds")
def street_dossier(t: Tables):
    return _dossier(t).drop("lng", "lat").withColumn("employment", F.col("employment").cast("bigint"))


@query(
    "market_gap_table",
    f"""WITH {_DOSSIER}, c AS (SELECT street, sector, count(*) AS shops FROM est GROUP BY 1, 2), s AS (SELECT unnest(['Comercio', 'Servicios', 'Industria', 'Alimentos']) AS sector),
    g AS (SELECT ds.street, s.sector, coalesce(shops, 0) AS shops, ds.employment * (0.5 + anchor_proximity) / (1 + 2.5 * coalesce(shops, 0)) AS gap FROM ds CROSS JOIN s LEFT JOIN c ON c.street = ds.street AND c.sector = s.sector),
    n AS (SELECT *, (gap - min(gap) OVER ()) / (max(gap) OVER () - min(gap) OVER () + 1e-9) AS x FROM g)
    SELECT street, sector, shops, round_even(x, 2) AS gap_score FROM n ORDER BY x DESC, street, sector LIMIT 15""",
)
def market_gap_table(t: Tables):
    counts = establishments(t).groupBy("street", "sector").agg(F.count("*").alias("shops"))
    return ST.market_gaps(_dossier(t).drop("sector"), counts, "street", "sector").select("street", "sector", "shops", "gap_score")


_HAVB = "12742.0e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))"
_DEMAND = f"""c AS (SELECT round_even(lng / 0.0028e0, 0)::BIGINT AS gx, round_even(lat / 0.0028e0, 0)::BIGINT AS gy, sum(emp) AS employment, count(*) FILTER (WHERE contains(name, 'GIZMO')) AS comp, count(*) AS n FROM est GROUP BY 1, 2),
  dem AS (SELECT a.gx, a.gy, a.n, sum(b.employment)::BIGINT AS demand, sum(b.comp)::BIGINT AS competitors FROM c a JOIN c b ON b.gx BETWEEN a.gx - 1 AND a.gx + 1 AND b.gy BETWEEN a.gy - 1 AND a.gy + 1 GROUP BY 1, 2, 3)"""


@query(
    "site_selection",
    f"""WITH {EST}, {STREETS}, {_DEMAND}, s0 AS (SELECT *, ln(1 + demand) / (1 + 1.2e0 * competitors) AS raw FROM dem WHERE n >= 8),
    s AS (SELECT *, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 1e-9) AS score, (gx + 0.5) * 0.0028e0 AS lng, (gy + 0.5) * 0.0028e0 AS lat FROM s0),
    a AS (SELECT * FROM s ORDER BY score DESC, gx, gy LIMIT 10), b AS (SELECT DISTINCT lng, lat FROM est WHERE contains(name, 'GIZMO')),
    k AS (SELECT a.gx, a.gy, min({_HAVB}) AS km FROM a, b GROUP BY 1, 2),
    st AS (SELECT a.gx, a.gy, arg_min(t.street, (sqrt(pow(a.lng - t.lng, 2) + pow(a.lat - t.lat, 2)), t.street)) AS street FROM a, streets t GROUP BY 1, 2)
    SELECT gx, gy, demand, competitors, round(score, 6) AS score, street, round_even(km * 1000.0e0, 0) AS competitor_m FROM a JOIN k USING (gx, gy) JOIN st USING (gx, gy)""",
)
def site_selection(t: Tables):
    comp = ST.competitor_flag(F.col("name"), ["GIZMO"])
    s = ST.site_selection(establishments(t), "emp", comp, streets(t).select("street", "lng", "lat"), "street")
    return s.select("gx", "gy", "demand", "competitors", r("score").alias("score"), "street", "competitor_m")


SPECIES = {"Bolt": ["BOLT"], "Gear": ["GEAR"], "Ring": ["RING"]}
_CANARY = f"""y AS (SELECT max(year) AS ym FROM est),
  cc AS (SELECT round_even(lng / 0.0028e0, 0)::BIGINT AS gx, round_even(lat / 0.0028e0, 0)::BIGINT AS gy, lng, lat, year >= ym - 2 AS recent, CASE WHEN contains(name, 'BOLT') THEN 'Bolt' WHEN contains(name, 'GEAR') THEN 'Gear' WHEN contains(name, 'RING') THEN 'Ring' END AS sp FROM est, y),
  cz AS (SELECT gx, gy, count(*) FILTER (WHERE recent) AS recent, count(*) FILTER (WHERE NOT recent) AS earlier, avg(lng) AS lng, avg(lat) AS lat, string_agg(DISTINCT sp, ', ' ORDER BY sp) FILTER (WHERE recent) AS species FROM cc WHERE sp IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (WHERE recent) >= 1),
  cs AS (SELECT *, recent / (1 + 0.8e0 * earlier) AS raw FROM cz), ct AS (SELECT *, round_even((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 1e-9) * 100, 0)::BIGINT AS score FROM cs),
  top AS (SELECT * FROM ct ORDER BY score DESC, recent DESC, gx, gy LIMIT 10),
  named AS (SELECT top.gx, top.gy, arg_min(t.street, (sqrt(pow(top.lng - t.lng, 2) + pow(top.lat - t.lat, 2)), t.street)) AS street FROM top, streets t GROUP BY 1, 2),
  can AS (SELECT gx, gy, recent, earlier, species, score, street FROM top JOIN named USING (gx, gy))"""


def _canaries(t: Tables):
    return ST.canary_top(establishments(t), text.first_category(F.col("name"), SPECIES), "year", streets(t).select("street", "lng", "lat"), "street")


@query("canary_top", f"WITH {EST}, {STREETS}, {_CANARY} SELECT * FROM can")
def canary_top(t: Tables):
    return _canaries(t).select("gx", "gy", "recent", "earlier", "species", "score", "street")


_SISMO = """sd AS (SELECT min(added_on) AS since FROM (SELECT DISTINCT added_on FROM est ORDER BY 1 DESC LIMIT 2)),
  sm AS (SELECT street, count(*) FILTER (WHERE added_on >= since) AS openings, 0::BIGINT AS closures, count(CASE WHEN contains(name, 'BOLT') OR contains(name, 'GEAR') OR contains(name, 'RING') THEN 1 END) FILTER (WHERE added_on >= since) AS indicators FROM est, sd GROUP BY 1)"""


def _sismo(t: Tables):
    return R.openings_report(establishments(t), "street", "added_on", text.first_category(F.col("name"), SPECIES))


@query(
    "gentrification_index",
    f"""WITH {EST}, {STREETS}, {_CANARY}, {_SISMO}, b AS (SELECT street, max(score) AS canaries, sum(recent)::BIGINT AS recent FROM can GROUP BY 1),
    j AS (SELECT sm.*, openings - closures AS net, coalesce(canaries, 0) AS canaries, coalesce(recent, 0) AS recent FROM sm LEFT JOIN b USING (street)),
    p AS (SELECT *, (canaries - min(canaries) OVER ()) / (max(canaries) OVER () - min(canaries) OVER () + 1e-9) AS a, (greatest(net, 0) - min(greatest(net, 0)) OVER ()) / (max(greatest(net, 0)) OVER () - min(greatest(net, 0)) OVER () + 1e-9) AS n2,
      (indicators - min(indicators) OVER ()) / (max(indicators) OVER () - min(indicators) OVER () + 1e-9) AS i2 FROM j),
    x AS (SELECT *, round_even(100 * (0.5e0 * a + 0.3e0 * n2 + 0.2e0 * i2), 0)::BIGINT AS idx FROM p WHERE (SELECT max(canaries) FROM j) > 0)
    SELECT street, idx AS index, canaries, recent, net, indicators FROM x WHERE idx > 0 ORDER BY idx DESC, recent DESC, street LIMIT 12""",
)
def gentrification_index(t: Tables):
    return ST.gentrification_index(_sismo(t).drop("species"), _canaries(t), "street").select("street", "index", "canaries", "recent", "net", "indicators")


@query(
    "sismograph_magnitude",
    f"""WITH {EST}, {_SISMO}, s AS (SELECT c_custkey AS street FROM customer), j AS (SELECT street, coalesce(openings, 0) AS openings, coalesce(closures, 0) AS closures, coalesce(indicators, 0) AS indicators FROM s LEFT JOIN sm USING (street)),
    k AS (SELECT *, 2.2e0 * indicators + openings - 0.8e0 * closures AS raw FROM j)
    SELECT street, openings, closures, indicators, round_even((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 1e-9), 3) AS magnitude FROM k""",
)
def sismograph_magnitude(t: Tables):
    s = t.customer.select(F.col("c_custkey").alias("street"))
    return ST.sismograph_magnitude(s, _sismo(t), "street").select("street", "openings", "closures", "indicators", "magnitude")


_VERDICT = f"""{LISTINGS}, {PRICED}, md AS (SELECT zone, pm2, row_number() OVER (PARTITION BY zone ORDER BY pm2) - 1 AS i, count(*) OVER (PARTITION BY zone) AS c FROM priced WHERE operation = 'venta' AND pm2 > 5000 AND pm2 < 150000),
  vd AS (SELECT p.*, CASE WHEN d.pm2 <> 0 AND p.pm2 <> 0 THEN floor((p.pm2 / d.pm2 - 1.0e0) * 100.0e0 + 0.5)::BIGINT END AS vs FROM priced p LEFT JOIN md d ON d.zone = p.zone AND d.i = d.c // 2)"""


@query("price_verdict", f"WITH {_VERDICT} SELECT id, vs, CASE WHEN vs <= -12 THEN 'oportunidad' WHEN vs >= 12 THEN 'sobreprecio' WHEN vs IS NOT NULL THEN 'justo' END AS verdict FROM vd")
def price_verdict(t: Tables):
    return M.price_verdict(C.with_unit_price(listings(t))).select("id", "vs", "verdict")


TODAY = "2001-09-01"
_TRACK = f"""{LISTINGS}, cur AS (SELECT zone, id, price, CASE WHEN id % 11 = 0 THEN 'USD' ELSE 'MXN' END AS m FROM listings WHERE day >= DATE '1996-01-01'),
  old AS (SELECT zone, id, floor(price * (1 + ((id % 7) - 3) / 100.0e0)) AS p, 'MXN' AS m, day AS f FROM listings WHERE day < DATE '2000-07-01'),
  cu AS (SELECT zone, id, CASE WHEN (id % 7) = 3 THEN floor(price) ELSE price END AS p, m FROM cur),
  df AS (SELECT coalesce(c.zone, o.zone) AS zone, coalesce(c.id, o.id) AS id, c.p AS cp, o.p AS op, c.m AS cm, o.m AS om, o.f,
    CASE WHEN c.id IS NULL THEN 'closed' WHEN o.id IS NULL THEN 'new' WHEN c.m <> o.m THEN 'reset' WHEN c.p < o.p THEN 'cut' WHEN c.p > o.p THEN 'raised' ELSE 'same' END AS status FROM cu c FULL JOIN old o ON o.zone = c.zone AND o.id = c.id)"""


def _tracked(t: Tables):
    k = F.col("id")
    base = listings(t)
    cur = base.filter("day >= date '1996-01-01'").select("zone", "id", F.when(k % 7 == 3, F.floor("price").cast("double")).otherwise(F.col("price")).alias("price"), F.when(k % 11 == 0, "USD").otherwise("MXN").alias("currency"))
    old = base.filter("day < date '2000-07-01'").select(
        "zone", "id", F.col("day").alias("first_seen"), F.floor(F.col("price") * (1 + ((k % 7) - 3) / 100.0)).cast("double").alias("price"), F.lit("MXN").alias("currency"), F.array().cast(M.CHANGE).alias("changes")
    )
    return M.diff_snapshot(cur, old, TODAY, ["zone", "id"])


@query(
    "listing_tracker",
    f"""WITH {_TRACK} SELECT zone, id, status, strftime(CASE WHEN status IN ('new', 'reset') THEN DATE '{TODAY}' ELSE f END, '%Y-%m-%d') AS first_seen, coalesce(cp, op) AS price,
    CASE WHEN status IN ('cut', 'raised') THEN 1 ELSE 0 END AS changes, CASE WHEN status = 'closed' THEN greatest(date_diff('day', f, DATE '{TODAY}'), 0)::INT END AS days FROM df""",
)
def listing_tracker(t: Tables):
    d = _tracked(t)
    return d.select("zone", "id", "status", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), "price", F.size("changes").alias("changes"), F.col("days_on_market").alias("days"))


@query(
    "tracker_totals",
    f"WITH {_TRACK} SELECT zone, count(*) FILTER (WHERE status IN ('new', 'reset')) AS added, count(*) FILTER (WHERE status = 'cut') AS cuts, count(*) FILTER (WHERE status = 'closed') AS closed, count(*) FILTER (WHERE status <> 'closed') AS tracked FROM df GROUP BY 1",
)
def tracker_totals(t: Tables):
    return M.tracker_totals(_tracked(t), "zone")


@query(
    "closures",
    f"""WITH {_TRACK}, pv AS (SELECT zone, id, day AS closed_on FROM listings),
    keep AS (SELECT zone, id, closed_on FROM pv ANTI JOIN (SELECT * FROM df WHERE status IN ('new', 'reset', 'closed')) USING (zone, id)),
    al AS (SELECT * FROM keep UNION ALL SELECT zone, id, DATE '{TODAY}' FROM df WHERE status = 'closed')
    SELECT zone, id, strftime(closed_on, '%Y-%m-%d') AS closed_on FROM al""",
)
def closures(t: Tables):
    prev = listings(t).select("zone", "id", F.col("day").alias("closed_on"), "price", F.lit(0).alias("days"))
    out = M.closures(prev, _tracked(t), TODAY, ["zone", "id"], "zone")
    return out.select("zone", "id", F.date_format("closed_on", "yyyy-MM-dd").alias("closed_on"))


_MT = f"""{LISTINGS}, tr AS (SELECT zone, CASE WHEN kind = 'terreno' THEN -id ELSE id END AS id, day AS first_seen, price * 0.95e0 AS p, price AS p0 FROM listings),
  mt AS (SELECT l.*, CASE WHEN t.id IS NOT NULL THEN greatest(date_diff('day', t.first_seen, DATE '{TODAY}'), 0)::INT END AS days_listed, t.first_seen = DATE '1995-01-01' AS censored, CASE WHEN t.p0 > 0 AND t.id % 2 = 0 THEN floor((t.p / t.p0 - 1.0e0) * 100.0e0 + 0.5)::BIGINT END AS cut_pct
    FROM listings l LEFT JOIN tr t ON t.zone = l.zone AND t.id = l.id)"""


def _market(t: Tables):
    one = F.array(F.struct(F.col("day").alias("at"), F.col("price").alias("from"), (F.col("price") * 0.95).alias("to"))).cast(M.CHANGE)
    key = F.when(F.col("kind") == "terreno", -F.col("id")).otherwise(F.col("id")).alias("id")  # land is tracked under ids of its own
    tracker = listings(t).select(
        "zone", key, F.to_date(F.lit("1995-01-01")).alias("base"), F.to_date(F.lit(TODAY)).alias("act"), F.col("day").alias("first_seen"), (F.col("price") * 0.95).alias("price"),
        F.when(F.col("id") % 2 == 0, one).otherwise(F.array().cast(M.CHANGE)).alias("changes"),
    )
    return J.track_listings(listings(t), tracker, ["zone", "id"])


@query("market_track_join", f"WITH {_MT} SELECT id, days_listed, censored, cut_pct FROM mt")
def market_track_join(t: Tables):
    return _market(t).select("id", "days_listed", "censored", "cut_pct")


_BUDGET = 200000.0
_BASKET = f"""{_MT}, {PRICED}, md AS (SELECT zone, pm2, row_number() OVER (PARTITION BY zone ORDER BY pm2) - 1 AS i, count(*) OVER (PARTITION BY zone) AS c FROM priced WHERE operation = 'venta' AND pm2 > 5000 AND pm2 < 150000),
  bk AS (SELECT mt.id, mt.zone, mt.price, (mt.zone_no % 9)::DOUBLE AS zy, mt.days_listed, mt.cut_pct, CASE WHEN d.pm2 <> 0 AND p.pm2 <> 0 THEN floor((p.pm2 / d.pm2 - 1.0e0) * 100.0e0 + 0.5) END AS vs
    FROM mt JOIN priced p ON p.id = mt.id LEFT JOIN md d ON d.zone = mt.zone AND d.i = d.c // 2 WHERE mt.operation = 'venta' AND mt.price > 0 AND mt.price <= {_BUDGET}),
  sc AS (SELECT id, zone, price, coalesce(least(greatest(-vs, -40), 40) / 40.0e0, 0) + 1.6e0 * zy / 12 + 0.5e0 * CASE WHEN cut_pct < 0 THEN least(1.0e0, abs(cut_pct) / 15.0e0) ELSE 0 END
    + 0.35e0 * CASE WHEN days_listed IS NOT NULL THEN least(1.0e0, days_listed / 180.0e0) ELSE 0 END AS score FROM bk)"""


def _scored(t: Tables):
    v = M.price_verdict(C.with_unit_price(_market(t))).withColumn("zone_yield", (F.col("zone_no") % 9).cast("double"))
    return M.basket_scores(v, _BUDGET, "renta").select("id", "zone", "price", "score")


@query("basket_scores", f"WITH {_BASKET} SELECT id, zone, price, round(score, 6) AS score FROM sc")
def basket_scores(t: Tables):
    return _scored(t).select("id", "zone", "price", r("score").alias("score"))


@query(
    "investment_basket",
    f"""WITH {_BASKET}, p1 AS (SELECT * FROM sc ORDER BY score DESC, id LIMIT 1),
    p2 AS (SELECT sc.* FROM sc, p1 WHERE sc.zone <> p1.zone AND sc.price <= {_BUDGET} - p1.price ORDER BY sc.score DESC, sc.id LIMIT 1),
    p3 AS (SELECT sc.* FROM sc, p1, p2 WHERE sc.zone NOT IN (p1.zone, p2.zone) AND sc.price <= {_BUDGET} - p1.price - p2.price ORDER BY sc.score DESC, sc.id LIMIT 1),
    sp AS (SELECT 1 AS pick, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3),
    k AS (SELECT count(*) AS k, sum(price) AS s FROM sp),
    r1 AS (SELECT (k.k + 1) AS pick, sc.* FROM sc, k WHERE k.k < 3 AND sc.id NOT IN (SELECT id FROM sp) AND sc.price <= {_BUDGET} - k.s ORDER BY sc.score DESC, sc.id LIMIT 1),
    k2 AS (SELECT count(*) AS k, sum(price) AS s FROM (SELECT price FROM sp UNION ALL SELECT price FROM r1)),
    r2 AS (SELECT (k2.k + 1) AS pick, sc.* FROM sc, k2 WHERE k2.k < 3 AND sc.id NOT IN (SELECT id FROM sp UNION ALL SELECT id FROM r1) AND sc.price <= {_BUDGET} - k2.s ORDER BY sc.score DESC, sc.id LIMIT 1)
    SELECT pick::INT AS pick, zone, id, price, round(score, 6) AS score FROM (SELECT * FROM sp UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)""",
)
def investment_basket(t: Tables):
    b = M.greedy_basket(_scored(t), _BUDGET, "zone", "id")
    return b.select("pick", "zone", "id", "price", r("score").alias("score"))


_ROOMY = f"""{LISTINGS}, sc AS (SELECT id, zone, price, (rooms + baths)::DOUBLE AS score FROM listings WHERE operation = 'venta' AND price <= 90000),
  p1 AS (SELECT * FROM sc ORDER BY score DESC, id LIMIT 1),
  p2 AS (SELECT sc.* FROM sc, p1 WHERE sc.zone <> p1.zone AND sc.price <= 90000 - p1.price ORDER BY sc.score DESC, sc.id LIMIT 1),
  p3 AS (SELECT sc.* FROM sc, p1, p2 WHERE sc.zone NOT IN (p1.zone, p2.zone) AND sc.price <= 90000 - p1.price - p2.price ORDER BY sc.score DESC, sc.id LIMIT 1),
  sp AS (SELECT 1 AS pick, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3), k AS (SELECT count(*) AS k, sum(price) AS s FROM sp),
  r1 AS (SELECT (k.k + 1) AS pick, sc.* FROM sc, k WHERE k.k < 3 AND sc.id NOT IN (SELECT id FROM sp) AND sc.price <= 90000 - k.s ORDER BY sc.score DESC, sc.id LIMIT 1),
  k2 AS (SELECT count(*) AS k, sum(price) AS s FROM (SELECT price FROM sp UNION ALL SELECT price FROM r1)),
  r2 AS (SELECT (k2.k + 1) AS pick, sc.* FROM sc, k2 WHERE k2.k < 3 AND sc.id NOT IN (SELECT id FROM sp UNION ALL SELECT id FROM r1) AND sc.price <= 90000 - k2.s ORDER BY sc.score DESC, sc.id LIMIT 1)"""


@query("greedy_budget", f"WITH {_ROOMY} SELECT pick::INT AS pick, zone, id, price, score FROM (SELECT * FROM sp UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)")
def greedy_budget(t: Tables):
    scored = listings(t).filter("operation = 'venta'").select("zone", "id", "price", (F.col("rooms") + F.col("baths")).cast("double").alias("score"))
    return M.greedy_basket(scored, 90000.0, "zone", "id")


_ALERTS = f"""{EVENTS}, al AS (SELECT event_id AS id, 'z' || (user_id % 25)::VARCHAR AS zone, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 3 END AS horizon, 1.0e0 + event_id % 5 AS threshold, event_id % 7 <> 0 AS active, CASE WHEN event_id % 3 <> 0 THEN (event_id % 40)::DOUBLE END AS last_value FROM ev),
  fc AS (SELECT 'z' || c_nationkey::VARCHAR AS zone, h, 1 + avg(o_totalprice) / 1000000 * h / 2 AS f FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES (1), (3)) t(h) GROUP BY 1, 2),
  aj AS (SELECT al.*, floor((f - 1.0e0) * 1000.0e0 + 0.5) / 10.0e0 AS new_value FROM al JOIN fc ON fc.zone = al.zone AND h = horizon WHERE active),
  ac AS (SELECT *, CASE WHEN last_value IS NULL THEN 'baseline' WHEN abs(new_value - last_value) >= threshold THEN 'alert' ELSE 'quiet' END AS action FROM aj)"""


def _alerts(t: Tables):
    k = F.col("event_id")
    al = events(t).select(
        k.alias("id"),
        F.concat(F.lit("z"), (F.col("user_id") % 25).cast("string")).alias("zone"),
        F.when(k % 2 == 0, 1).otherwise(3).alias("horizon"),
        (1.0 + k % 5).alias("threshold"),
        (k % 7 != 0).alias("active"),
        F.when(k % 3 != 0, (k % 40).cast("double")).alias("last_value"),
    )
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    means = j.groupBy(F.concat(F.lit("z"), F.col("c_nationkey").cast("string")).alias("zone")).agg(F.avg("o_totalprice").alias("m"))
    fc = means.select("zone", F.explode(F.array(F.lit(1), F.lit(3))).alias("horizon"), "m").withColumn("f", 1 + F.col("m") / 1000000 * F.col("horizon") / 2)
    return M.threshold_alerts(al, fc)


@query("threshold_alerts", f"WITH {_ALERTS} SELECT id, action, new_value, floor(abs(new_value - last_value) * 10.0e0 + 0.5) / 10.0e0 AS delta, CASE WHEN action <> 'quiet' THEN new_value ELSE last_value END AS last_value_next FROM ac")
def threshold_alerts(t: Tables):
    return _alerts(t).select("id", "action", "new_value", "delta", "last_value_next")


@query(
    "alert_messages",
    f"WITH {_ALERTS} SELECT zone, horizon, count(*) AS watchers, arg_min(last_value, id) AS last_value, arg_min(new_value, id) AS new_value FROM ac WHERE action = 'alert' GROUP BY 1, 2",
)
def alert_messages(t: Tables):
    return M.alert_messages(_alerts(t)).select("zone", "horizon", "watchers", "last_value", "new_value")


@query(
    "monthly_index",
    f"""WITH {LISTINGS}, h AS (SELECT zone, month, count(*) AS n, 1 AS run FROM listings WHERE operation = 'venta' AND month < '2001-03' GROUP BY 1, 2), c AS (SELECT zone, month, count(*) AS n, 2 AS run FROM listings WHERE month >= '2001-01' GROUP BY 1, 2),
    b AS (SELECT * FROM h WHERE month NOT IN (SELECT month FROM c) UNION ALL SELECT * FROM c) SELECT zone, month, n, run FROM b""",
)
def monthly_index(t: Tables):
    li = listings(t)
    h = li.filter("operation = 'venta' and month < '2001-03'").groupBy("zone", "month").agg(F.count("*").alias("n")).withColumn("run", F.lit(1))
    c = li.filter("month >= '2001-01'").groupBy("zone", "month").agg(F.count("*").alias("n")).withColumn("run", F.lit(2))
    return M.monthly_index(h, c, ["zone"], "month").select("zone", "month", "n", "run")


@query(
    "live_market_join",
    f"""WITH {LISTINGS}, {PRICED}, mm AS (SELECT zone_no, floor(avg(pm2_mxn) + 0.5)::BIGINT AS p, count(*) AS n FROM priced WHERE operation = 'venta' GROUP BY 1)
    SELECT s_suppkey AS unit, CASE WHEN mm.p > 0 THEN '$' || format('{{:t,}}', mm.p) || '/m2 (' || format('{{:t,}}', mm.n) || ' sales)' ELSE '' END AS market_line FROM supplier LEFT JOIN mm ON mm.zone_no = s_nationkey + 3""",
)
def live_market_join(t: Tables):
    p = C.with_unit_price(listings(t)).filter("operation = 'venta'")
    m = p.groupBy("zone").agg(F.floor(F.avg("pm2_mxn") + 0.5).alias("pm2_sale"), F.count("*").alias("n_sale"))
    m = m.select(text.slug(F.col("zone")).alias("slug"), "pm2_sale", "n_sale")
    units = t.supplier.select(F.col("s_suppkey").alias("unit"), F.concat(F.lit("Zóna "), (F.col("s_nationkey") + 3).cast("string")).alias("town"))
    out = RP.live_market_lines(units, "unit", [F.concat(F.col("town"), F.lit(", Estado")), F.col("town")], m)
    return out.select("unit", "market_line")


