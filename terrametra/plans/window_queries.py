"""Queries for window-like operators, order statistics, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrametra.functions import numeric
from terrametra.operators import matching as J
from terrametra.operators import ranking as K
from terrametra.operators import stats as S
from terrametra.plans import forecast as FC
from terrametra.plans.bindings import CELL_EDGES, CELLS, EST, EVENTS, LISTINGS, MUNI, PANEL, PRICED, Tables, cell_values, establishments, events, listings, panel
from terrametra.plans import streets as ST
from terrametra.operators import cleaning as C
from terrametra.operators import market as M
from terrametra.operators.spatial import grid_edges
from terrametra.plans.registry import query, r


@query(
    "percentile_position",
    """WITH a AS (SELECT o_custkey AS unit, count(*) AS n FROM orders GROUP BY 1)
    SELECT unit, n, round_even(100.0e0 * (row_number() OVER (ORDER BY n, unit) - 1) / (count(*) OVER () - 1), 0)::BIGINT AS pct FROM a""",
)
def percentile_position(t: Tables):
    a = t.orders.groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").alias("n"))
    return K.percentile_position(a, "n", "unit").select("unit", "n", "pct")


@query(
    "percentile_strict",
    """WITH a AS (SELECT o_custkey AS unit, o_orderpriority AS offence, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT unit, offence, n, least(round_even(100.0e0 * (rank() OVER (PARTITION BY offence ORDER BY n) - 1) / (count(*) OVER (PARTITION BY offence) - 1), 0), 100)::BIGINT AS pct FROM a""",
)
def percentile_strict(t: Tables):
    a = t.orders.groupBy(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("offence")).agg(F.count("*").alias("n"))
    return K.percentile_strict(a, ["offence"], "n").select("unit", "offence", "n", "pct")


@query(
    "lower_bound_pct",
    """WITH p AS (SELECT s_suppkey AS probe_id, (1000 + s_suppkey * 4711 % 500000)::DOUBLE AS x FROM supplier),
    o AS (SELECT o_totalprice AS v FROM orders)
    SELECT probe_id, round_even(100.0e0 * (SELECT count(*) FROM o WHERE v < x) / ((SELECT count(*) FROM o) - 1), 0)::BIGINT AS pct FROM p""",
)
def lower_bound_pct(t: Tables):
    probes = t.supplier.select(F.col("s_suppkey").alias("probe_id"), (1000 + F.col("s_suppkey") * 4711 % 500000).cast("double").alias("x"))
    return K.place_in_distribution(probes, "x", t.orders, "o_totalprice").select("probe_id", "pct")


@query(
    "cume_dist_temp",
    f"""WITH {MUNI}, {EST}, {CELLS}, {CELL_EDGES}, n AS (SELECT src AS cell_id, avg(value) AS m FROM edges JOIN cells ON dst = cell_id GROUP BY 1),
    c AS (SELECT cell_id, value, cume_dist() OVER (ORDER BY value) AS share FROM cells)
    SELECT cell_id, round(share, 6) AS share, CASE WHEN share * 100 >= 67 THEN 'caliente' WHEN share * 100 >= 33 THEN 'incubando' ELSE 'fría' END AS temperature,
    CASE WHEN value < 0.95 * m THEN 'below' WHEN value > 1.05 * m THEN 'above' WHEN m IS NOT NULL THEN 'level' END AS against_near FROM c LEFT JOIN n USING (cell_id)""",
)
def cume_dist_temp(t: Tables):
    c = cell_values(t)
    out = S.temperature(c, grid_edges(c), "value")
    return out.select("cell_id", r("share").alias("share"), "temperature", "against_near")


@query("minmax_norm", "SELECT o_orderkey AS id, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER () + 1e-9), 9) AS x FROM orders")
def minmax_norm(t: Tables):
    return numeric.add_min_max(t.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice"), {"x": "o_totalprice"}).select("id", r("x", 9).alias("x"))


@query("zscore", "SELECT o_orderkey AS id, round((o_totalprice - avg(o_totalprice) OVER ()) / (stddev_pop(o_totalprice) OVER () + 1e-9), 7) AS z FROM orders")
def zscore(t: Tables):
    return numeric.add_zscore(t.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice"), {"z": "o_totalprice"}).select("id", r("z", 7).alias("z"))


@query(
    "quantile_class",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.85) AS a, quantile_cont(o_totalprice, 0.55) AS b FROM orders)
    SELECT o_orderkey AS id, CASE WHEN o_totalprice >= a THEN 'mutation' WHEN o_totalprice >= b THEN 'expansion' ELSE 'latent' END AS label FROM orders, q""",
)
def quantile_class(t: Tables):
    out = K.threshold_class(t.orders, "o_totalprice", [(0.85, "mutation"), (0.55, "expansion")], "latent")
    return out.select(F.col("o_orderkey").alias("id"), "label")


@query(
    "exact_quantile",
    f"""WITH {EST} SELECT sector, round(quantile_cont(price, 0.5), 5) AS p50, round(quantile_cont(price, 0.95), 5) AS p95 FROM est GROUP BY 1""",
)
def exact_quantile(t: Tables):
    both = K.exact_quantiles(establishments(t), ["sector"], "price", {"p50": 0.5, "p95": 0.95})
    return both.select("sector", r("p50", 5).alias("p50"), r("p95", 5).alias("p95"))


@query(
    "upper_median",
    f"""WITH {EST}, p AS (SELECT sector, price, row_number() OVER (PARTITION BY sector ORDER BY price) - 1 AS i, count(*) OVER (PARTITION BY sector) AS c FROM est)
    SELECT sector, price AS med FROM p WHERE i = c // 2""",
)
def upper_median(t: Tables):
    return K.upper_median(establishments(t), ["sector"], "price", "med")


@query(
    "cagr_lag",
    f"""WITH {PANEL} SELECT a.zone, a.year::INT AS t, round(CASE WHEN b.idx <> 0 THEN a.idx / b.idx - 1 END, 8) AS g1, round(CASE WHEN c.idx <> 0 THEN pow(a.idx / c.idx, 1.0e0 / 3) - 1 END, 8) AS g3
    FROM panel a LEFT JOIN panel b ON b.zone = a.zone AND b.year = a.year - 1 LEFT JOIN panel c ON c.zone = a.zone AND c.year = a.year - 3 WHERE a.year BETWEEN 1996 AND 2001""",
)
def cagr_lag(t: Tables):
    g = FC.growth_rates(panel(t), 1996, 2001).filter("x is not null")
    return g.select("zone", "t", r("g1", 8).alias("g1"), r("g3", 8).alias("g3"))


@query("latest_k_dates", f"WITH {EST} SELECT muni, added_on FROM (SELECT *, dense_rank() OVER (PARTITION BY muni ORDER BY added_on DESC) AS k FROM (SELECT DISTINCT muni, added_on FROM est)) WHERE k <= 2")
def latest_k_dates(t: Tables):
    return K.latest_k_dates(establishments(t), ["muni"], "added_on", 2)


@query(
    "top_n_per_group",
    "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 5",
)
def top_n_per_group(t: Tables):
    return K.top_n_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 5).select("o_custkey", "o_orderkey", "rank")


@query(
    "keep_last",
    f"WITH {EVENTS} SELECT zone, strftime(ts, '%Y-%m-%d') AS day, event_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY zone, ts::DATE ORDER BY ts DESC, event_id DESC) AS p FROM ev WHERE zone <> '') WHERE p = 1",
)
def keep_last(t: Tables):
    e = events(t).filter("zone <> ''").select("zone", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", r("score", 4).alias("score"))
    return K.keep_last(e, ["zone", "day"], ["ts", "event_id"]).select("zone", "day", "event_id", "score")


_MACRO = """s AS (SELECT c_nationkey::BIGINT AS series, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  x AS (SELECT series, month, CASE WHEN (series + substr(month, 6, 2)::INT) % 5 = 0 THEN 'N/E' ELSE format('{:t,.2f}', v) END AS raw FROM s),
  ok AS (SELECT series, month, try_cast(replace(raw, ',', '') AS DOUBLE) AS v FROM x WHERE raw <> 'N/E')"""


def _macro(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    s = j.groupBy(F.col("c_nationkey").cast("bigint").alias("series"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    hole = (F.col("series") + F.substring("month", 6, 2).cast("int")) % 5 == 0
    return s.select("series", "month", F.when(hole, "N/E").otherwise(F.format_number("v", 2)).alias("raw"))


@query("last_valid", f"WITH {_MACRO} SELECT series, arg_max(v, month) AS value, max(month) AS as_of FROM ok GROUP BY 1")
def last_valid(t: Tables):
    return FC.last_valid(_macro(t), "series", "month", "raw")


@query(
    "year_over_year",
    f"WITH {_MACRO}, p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month DESC) AS p FROM ok) SELECT a.series, round_even(100.0e0 * (a.v / b.v - 1), 2) AS yoy_pct, a.month AS as_of FROM p a JOIN p b USING (series) WHERE a.p = 1 AND b.p = 13",
)
def year_over_year(t: Tables):
    return FC.year_over_year(_macro(t), "series", "month", "raw")


@query(
    "dense_segment",
    f"""WITH {EST}, c AS (SELECT street, okey, line, pkey, round_even(lng / 0.005e0, 0)::BIGINT AS gx, round_even(lat / 0.005e0, 0)::BIGINT AS gy FROM est),
    b AS (SELECT street, gx AS cx, gy AS cy FROM (SELECT *, row_number() OVER (PARTITION BY street ORDER BY k DESC, gx, gy) AS p FROM (SELECT street, gx, gy, count(*) AS k FROM c GROUP BY 1, 2, 3)) WHERE p = 1)
    SELECT street, cx, cy, count(*) AS points FROM c JOIN b USING (street) WHERE abs(gx - cx) <= 1 AND abs(gy - cy) <= 1 GROUP BY 1, 2, 3""",
)
def dense_segment(t: Tables):
    e = establishments(t)
    near = ST.densest_block(e.select("street", "lng", "lat", "okey"), "street")
    x, y = F.rint(F.col("lng") / 0.005).cast("bigint"), F.rint(F.col("lat") / 0.005).cast("bigint")
    cells = e.groupBy("street", x.alias("cx"), y.alias("cy")).agg(F.count("*").alias("k"))
    top = K.top_n_per_group(cells, ["street"], [F.col("k").desc(), "cx", "cy"], 1).select("street", "cx", "cy")
    return near.groupBy("street").agg(F.count("*").alias("points")).join(top, "street").select("street", "cx", "cy", "points")


@query(
    "street_axis",
    f"""WITH {EST}, c AS (SELECT street, lng, lat, okey * 1000000 + pkey * 10 + line AS tie, round_even(lng / 0.005e0, 0)::BIGINT AS gx, round_even(lat / 0.005e0, 0)::BIGINT AS gy FROM est),
    big AS (SELECT street FROM c GROUP BY 1 HAVING count(*) >= 4),
    b AS (SELECT street, gx AS cx, gy AS cy FROM (SELECT *, row_number() OVER (PARTITION BY street ORDER BY k DESC, gx, gy) AS p FROM (SELECT street, gx, gy, count(*) AS k FROM c SEMI JOIN big USING (street) GROUP BY 1, 2, 3)) WHERE p = 1),
    d AS (SELECT c.* FROM c JOIN b USING (street) WHERE abs(gx - cx) <= 1 AND abs(gy - cy) <= 1),
    a AS (SELECT street, avg(lng) AS mx, avg(lat) AS my, 0.5 * atan2(2 * covar_pop(lng, lat), var_pop(lng) - var_pop(lat)) AS ang FROM d GROUP BY 1 HAVING count(*) >= 4),
    p AS (SELECT d.*, round((lng - mx) * cos(ang) + (lat - my) * sin(ang), 12) AS proj FROM d JOIN a USING (street)),
    k AS (SELECT *, row_number() OVER (PARTITION BY street ORDER BY proj, lng, lat, tie) - 1 AS pos, count(*) OVER (PARTITION BY street) AS n FROM p)
    SELECT street, count(*) AS vertices, round(sum(round_even(lng, 5)), 5) AS sx, round(sum(round_even(lat, 5)), 5) AS sy FROM k
    WHERE list_contains(list_transform(range(12), lambda i: i * (n - 1) // 11), pos) GROUP BY 1""",
)
def street_axis(t: Tables):
    e = establishments(t).withColumn("tie", F.col("okey") * 1000000 + F.col("pkey") * 10 + F.col("line"))
    axes = ST.street_axes(e.select("street", "lng", "lat", "tie"), "street", "tie")
    add = lambda f: F.aggregate("path", F.lit(0.0), lambda s, p: s + p[f])
    return axes.select("street", F.size("path").cast("bigint").alias("vertices"), r(add("lng"), 5).alias("sx"), r(add("lat"), 5).alias("sy"))


@query(
    "multi_order_search",
    f"""WITH {LISTINGS}, {PRICED}, m AS (SELECT zone, pm2, row_number() OVER (PARTITION BY zone ORDER BY pm2) - 1 AS i, count(*) OVER (PARTITION BY zone) AS c FROM priced WHERE operation = 'venta' AND pm2 > 5000 AND pm2 < 150000),
    v AS (SELECT p.*, (zone_no % 9)::DOUBLE AS zone_yield, CASE WHEN d.pm2 <> 0 AND p.pm2 <> 0 THEN floor((p.pm2 / d.pm2 - 1.0e0) * 100.0e0 + 0.5) END AS vs FROM priced p LEFT JOIN m d ON d.zone = p.zone AND d.i = d.c // 2)
    SELECT * FROM (SELECT 'fair_price' AS how, row_number() OVER (ORDER BY coalesce(vs, 999), id)::INT AS pos, id FROM v) WHERE pos <= 24 UNION ALL
    SELECT * FROM (SELECT 'price_asc', row_number() OVER (ORDER BY price, id)::INT AS pos, id FROM v) WHERE pos <= 24 UNION ALL
    SELECT * FROM (SELECT 'price_desc', row_number() OVER (ORDER BY price DESC, id)::INT AS pos, id FROM v) WHERE pos <= 24 UNION ALL
    SELECT * FROM (SELECT 'yield', row_number() OVER (ORDER BY zone_yield DESC, id)::INT AS pos, id FROM v) WHERE pos <= 24""",
)
def multi_order_search(t: Tables):
    v = M.price_verdict(C.with_unit_price(listings(t))).withColumn("zone_yield", (F.col("zone_no") % 9).cast("double"))
    parts = None
    for how in ("fair_price", "price_asc", "price_desc", "yield"):
        order = M.search_order(how)
        top = M.search(v, how)
        # the 24 result rows are numbered for comparison
        from pyspark.sql import Window

        one = top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(how)).orderBy(*order))).select(F.lit(how).alias("how"), "pos", "id")
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query(
    "two_key_top",
    f"WITH {EST} SELECT street, count(*) AS n, max(year) AS newest FROM est GROUP BY 1 ORDER BY n DESC, newest DESC, street LIMIT 10",
)
def two_key_top(t: Tables):
    g = establishments(t).groupBy("street").agg(F.count("*").alias("n"), F.max("year").alias("newest"))
    return g.orderBy(F.col("n").desc(), F.col("newest").desc(), "street").limit(10)


@query(
    "union_all",
    "SELECT portal, count(*) AS n FROM (SELECT o_orderpriority AS portal FROM orders UNION ALL SELECT l_returnflag FROM lineitem UNION ALL SELECT event_type FROM events) GROUP BY 1",
)
def union_all(t: Tables):
    u = t.orders.select(F.col("o_orderpriority").alias("portal")).unionByName(t.lineitem.select(F.col("l_returnflag").alias("portal"))).unionByName(t.events.select(F.col("event_type").alias("portal")))
    return u.groupBy("portal").agg(F.count("*").alias("n"))


@query("except_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def except_keys(t: Tables):
    return J.only_in(t.customer, t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("intersect_keys", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def intersect_keys(t: Tables):
    return J.in_both(t.customer, t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query(
    "distinct",
    "SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2",
)
def distinct(t: Tables):
    li = t.lineitem.select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("first_order"))
    return J.first_per_key(li, ["l_partkey", "l_suppkey"], ["first_order"])


@query(
    "token_sets",
    f"WITH {EST} SELECT array_to_string(list_sort(list_distinct(string_split(name, ' '))), ' ') AS bag, count(*) AS n FROM est GROUP BY 1",
)
def token_sets(t: Tables):
    bag = F.array_join(F.array_sort(F.array_distinct(F.split("name", " "))), " ")
    return establishments(t).groupBy(bag.alias("bag")).agg(F.count("*").alias("n"))


