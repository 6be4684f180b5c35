"""Queries for aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrametra.functions import text
from terrametra.functions.constants import MONTHS
from terrametra.operators import cleaning as C
from terrametra.operators import rollups as R
from terrametra.plans.bindings import EST, EVENTS, LISTINGS, MUNI, PRICED, Tables, establishments, events, listings, municipalities
from terrametra.plans.registry import query, r

INDICATORS = ["BOLT", "GIZMO"]
SPECIES = {"Bolt": ["BOLT"], "Gear": ["GEAR"], "Ring": ["RING"]}

# Recent marks: the newest two distinct months per state (or over all rows).
_RECENT_STATE = """d AS (SELECT DISTINCT state, added_on FROM est),
  rk AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY added_on DESC) AS p FROM d),
  cut AS (SELECT state, min(added_on) AS since FROM rk WHERE p <= 2 GROUP BY 1 HAVING count(*) >= 2),
  m AS (SELECT e.*, coalesce(e.added_on >= c.since, false) AS recent, contains(name, 'BOLT') OR contains(name, 'GIZMO') AS ind
        FROM est e LEFT JOIN cut c USING (state))"""
_RECENT_ALL = """d AS (SELECT DISTINCT added_on FROM est), c AS (SELECT min(added_on) AS since FROM (SELECT added_on FROM d ORDER BY 1 DESC LIMIT 2)),
  m AS (SELECT e.*, e.added_on >= c.since AS recent, contains(name, 'BOLT') OR contains(name, 'GIZMO') AS ind FROM est e, c)"""


def _rollup_sql(key: str, extra: str, recent: str) -> str:
    return f"""WITH {EST}, {recent},
    s AS (SELECT {key}, sector, count(*) AS c FROM m GROUP BY ALL),
    h AS (SELECT {key}, -sum((c / n) * ln(c / n)) / ln(4) AS e FROM (SELECT *, sum(c) OVER (PARTITION BY {key}) AS n FROM s) GROUP BY 1)
    SELECT {key}, {extra} count(*) AS n_estab, sum(staff)::BIGINT AS employment,
      count(*) FILTER (WHERE sector = 'Comercio') AS comercio, count(*) FILTER (WHERE sector = 'Servicios') AS servicios,
      count(*) FILTER (WHERE sector = 'Industria') AS industria, count(*) FILTER (WHERE sector = 'Alimentos') AS alimentos,
      round_even(any_value(h.e), 3) AS resilience, count(*) FILTER (WHERE recent) AS recent_openings,
      count(*) FILTER (WHERE recent AND ind) AS indicators
    FROM m JOIN h USING ({key}) GROUP BY 1"""


@query("municipal_rollup", _rollup_sql("muni", "min(state) AS state,", _RECENT_STATE))
def municipal_rollup(t: Tables):
    ind = text.contains_any(F.col("name"), INDICATORS)
    return R.registry_rollup(establishments(t), ["muni"], "sector", "staff", "added_on", ind, labels=["state"], entity=["state"])


@query("postal_rollup", _rollup_sql("postal", "", _RECENT_ALL.replace("e.*,", "e.*, lpad((street * 37 % 100000)::VARCHAR, 5, '0') AS postal,")))
def postal_rollup(t: Tables):
    e = establishments(t).withColumn("postal", C.postal_key(F.col("street") * 37 % 100000))
    return R.registry_rollup(e, ["postal"], "sector", "staff", "added_on", text.contains_any(F.col("name"), INDICATORS))


@query(
    "entropy",
    f"""WITH {EST}, s AS (SELECT street, trade, count(*) AS c FROM est GROUP BY 1, 2),
    h AS (SELECT street, -sum(c / n * ln(c / n)) AS e, count(*) AS k FROM (SELECT *, sum(c) OVER (PARTITION BY street) AS n FROM s) GROUP BY 1)
    SELECT street, round((e - (6 - k) * 1e-9 * ln(1e-9)) / ln(6), 6) AS all_classes, round(e / ln(6), 6) AS present FROM h""",
)
def entropy(t: Tables):
    e = establishments(t)
    trades = ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"]
    a = R.sector_entropy(e, ["street"], "trade", "all_classes", 6, trades)
    b = R.sector_entropy(e, ["street"], "trade", "present", 6)
    return a.join(b, "street").select("street", r("all_classes").alias("all_classes"), r("present").alias("present"))


@query(
    "mode_sector",
    f"""WITH {EST}, s AS (SELECT street, trade, count(*) AS c FROM est GROUP BY 1, 2)
    SELECT street, trade AS sector FROM (SELECT *, row_number() OVER (PARTITION BY street ORDER BY c DESC, trade) AS p FROM s) WHERE p = 1""",
)
def mode_sector(t: Tables):
    return R.mode_value(establishments(t), ["street"], "trade", "sector")


_GRID = "round_even(lng / 0.0028e0, 0)::BIGINT AS gx, round_even(lat / 0.0028e0, 0)::BIGINT AS gy"


@query("grid_rollup", f"WITH {EST} SELECT {_GRID}, sum(emp)::BIGINT AS employment, count(*) AS n, round(sum(price), 2) AS price FROM est GROUP BY 1, 2")
def grid_rollup(t: Tables):
    m = {"employment": F.sum("emp").cast("bigint"), "n": F.count("*"), "price": r(F.sum("price"), 2)}
    return R.grid_rollup(establishments(t), "lng", "lat", 0.0028, m)


@query(
    "employment_anchors",
    f"""WITH {EST}, o AS (SELECT min(lng) AS x, min(lat) AS y FROM est),
    c AS (SELECT round_even((lng - x) / 0.0025e0, 0)::BIGINT AS gx, round_even((lat - y) / 0.0025e0, 0)::BIGINT AS gy, est.* FROM est, o),
    n AS (SELECT gx, gy, name FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY emp DESC, pkey, name) AS p FROM c) WHERE p = 1),
    a AS (SELECT gx, gy, sum(emp) AS emp, avg(lng) AS lng, avg(lat) AS lat FROM c GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 6)
    SELECT gx, gy, emp::BIGINT AS emp, round(lng, 9) AS lng, round(lat, 9) AS lat, name,
      round_even(0.45 + 0.55 * ((emp - min(emp) OVER ()) / (max(emp) OVER () - min(emp) OVER () + 1e-9)), 3) AS weight FROM a JOIN n USING (gx, gy)""",
)
def employment_anchors(t: Tables):
    a = R.employment_anchors(establishments(t), "name", "emp", "pkey")
    return a.select("gx", "gy", F.col("emp").cast("bigint").alias("emp"), r("lng", 9).alias("lng"), r("lat", 9).alias("lat"), "name", "weight")


@query(
    "price_anchors",
    """WITH s AS (SELECT c_nationkey::BIGINT AS zone, o_orderpriority AS portal, median(o_totalprice) AS med, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT zone, round(median(med), 4) AS price_m2, sum(n)::BIGINT AS samples FROM s GROUP BY 1 HAVING sum(n) >= 590""",
)
def price_anchors(t: Tables):
    from terrametra.operators.ranking import exact_median

    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("bigint").alias("zone"), F.col("o_orderpriority").alias("portal"), F.col("o_totalprice").alias("p")
    )
    samples = exact_median(j, ["zone", "portal"], "p", "med").join(j.groupBy("zone", "portal").agg(F.count("*").alias("n")), ["zone", "portal"])
    return R.price_anchors(samples, ["zone"], "med", "n", 590).select("zone", r("price_m2", 4).alias("price_m2"), "samples")


_SIDES = """k AS (SELECT zone, zone_no, CASE WHEN is_land AND operation <> 'renta' THEN 't' WHEN NOT is_land AND operation = 'venta' THEN 'v'
    WHEN NOT is_land AND operation = 'renta' THEN 'r' END AS k, CASE WHEN is_land THEN land_pm2_mxn ELSE pm2_mxn END AS x FROM priced),
  p AS (SELECT *, row_number() OVER (PARTITION BY zone, k ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY zone, k) AS c FROM k WHERE x > 0 AND k IS NOT NULL),
  med AS (SELECT zone, k, x FROM p WHERE i = c // 2),
  cnt AS (SELECT zone, count(*) FILTER (WHERE k = 'v') AS nv, count(*) FILTER (WHERE k = 'r') AS nr, count(*) FILTER (WHERE k = 't') AS nt FROM k GROUP BY 1),
  w AS (SELECT cnt.*, (SELECT x FROM med m WHERE m.zone = cnt.zone AND k = 'v') AS mv, (SELECT x FROM med m WHERE m.zone = cnt.zone AND k = 'r') AS mr,
    (SELECT x FROM med m WHERE m.zone = cnt.zone AND k = 't') AS mt FROM cnt)"""


@query(
    "market_metrics",
    f"""WITH {LISTINGS}, {PRICED}, {_SIDES}
    SELECT zone, floor(mv + 0.5)::BIGINT AS pm2_sale, nv AS n_sale, floor(mr + 0.5)::BIGINT AS pm2_rent, nr AS n_rent, floor(mt + 0.5)::BIGINT AS pm2_land, nt AS n_land,
    CASE WHEN nv >= 5 AND nr >= 5 THEN floor(mr * 12.0e0 / mv * 1000.0e0 + 0.5) / 10.0e0 END AS gross_yield FROM w""",
)
def market_metrics(t: Tables):
    return R.market_metrics(C.with_unit_price(listings(t)))


@query(
    "zone_registry",
    f"""WITH {LISTINGS}, {PRICED}, b AS (SELECT zone, count(*) AS n, avg(lat) AS la, avg(lng) AS ln, count(*) FILTER (WHERE operation = 'venta') AS nv, count(*) FILTER (WHERE operation = 'renta') AS nr FROM priced GROUP BY 1 HAVING count(*) >= 3),
    p AS (SELECT zone, operation, pm2_mxn AS x, row_number() OVER (PARTITION BY zone, operation ORDER BY pm2_mxn) - 1 AS i, count(*) OVER (PARTITION BY zone, operation) AS c FROM priced WHERE pm2_mxn > 0),
    med AS (SELECT zone, max(CASE WHEN operation = 'venta' THEN x END) AS mv, max(CASE WHEN operation = 'renta' THEN x END) AS mr FROM p WHERE i = c // 2 GROUP BY 1)
    SELECT zone, n, round(la, 4) AS lat, round(ln, 4) AS lng, floor(mv + 0.5)::BIGINT AS pm2,
    CASE WHEN nv >= 5 AND nr >= 5 THEN floor(mr * 12.0e0 / mv * 1000.0e0 + 0.5) / 10.0e0 END AS gross_yield FROM b LEFT JOIN med USING (zone)""",
)
def zone_registry(t: Tables):
    return R.zone_registry(C.with_unit_price(listings(t)))


@query(
    "trailing_rate",
    """WITH m AS (SELECT 'e' || (c_nationkey)::VARCHAR AS entity, o_orderpriority AS offence, year(o_orderdate) * 100 + month(o_orderdate) AS period, count(*) AS cases
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    l AS (SELECT *, row_number() OVER (PARTITION BY entity, offence ORDER BY period DESC) AS p FROM m),
    s AS (SELECT entity, offence, sum(cases)::BIGINT AS total, count(*) AS k, max(period)::BIGINT AS cut FROM l WHERE p <= 12 GROUP BY 1, 2)
    SELECT entity, offence, total, cut, round_even(total / (1000.0 + 137 * substr(entity, 2)::INT) * 100000, 1) AS rate FROM s WHERE k = 12""",
)
def trailing_rate(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("e"), F.col("c_nationkey").cast("string")).alias("entity"),
        F.col("o_orderpriority").alias("offence"),
        F.year("o_orderdate").cast("bigint").alias("year"),
        F.month("o_orderdate").alias("m"),
    )
    # the incidence file is wide: one row per entity, offence and year with twelve text columns
    wide = j.groupBy("entity", "offence", "year").agg(
        *[F.coalesce(F.format_number(F.nullif(F.sum((F.col("m") == i + 1).cast("bigint")), F.lit(0)), 0), F.lit(" ")).alias(name) for i, name in enumerate(MONTHS)]
    )
    long = R.unpivot_months(wide, ["entity", "offence", "year"], MONTHS)
    long = long.select("entity", "offence", (F.col("year") * 100 + F.col("month")).alias("period"), "cases")
    pop = municipalities(t).select(F.concat(F.lit("e"), F.col("cell_id").cast("string")).alias("entity"), (1000.0 + 137 * F.col("cell_id")).alias("population"))
    return R.trailing_rate(long, pop)


_CONTRACTS = """c AS (SELECT o_orderkey AS id, c_nationkey::BIGINT AS entity, CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE year(o_orderdate) END::BIGINT AS year,
    o_orderkey % 10 <> 0 AS national, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS amt FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _contracts(t: Tables):
    k = F.col("o_orderkey")
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        k.alias("id"),
        F.col("c_nationkey").cast("bigint").alias("entity"),
        F.when(k % 23 == 0, 0).otherwise(F.year("o_orderdate")).cast("bigint").alias("year"),
        F.when(k % 10 == 0, "usd").otherwise("mxn").alias("currency"),
        text.amount(F.when(k % 13 == 0, "s/d").otherwise(F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))).alias("amt"),
    )


def _contract_parts(t: Tables):
    return R.contract_rollup(_contracts(t), "entity", "year", F.col("currency").isin("mxn", "pesos"), "amt", "id", [])


@query("contract_rollup", f"WITH {_CONTRACTS} SELECT entity, year, count(*) AS n, round(coalesce(sum(CASE WHEN national THEN amt END), 0), 2) AS amount FROM c GROUP BY 1, 2")
def contract_rollup(t: Tables):
    return _contract_parts(t)[0].select("entity", "year", "n", r("amount", 2).alias("amount"))


@query(
    "contract_top",
    f"""WITH {_CONTRACTS} SELECT entity, year, id, amt AS amount, p AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY amt DESC, id)::INT AS p
    FROM c WHERE national AND amt IS NOT NULL) WHERE p <= 5""",
)
def contract_top(t: Tables):
    return _contract_parts(t)[1].select("entity", "year", "id", "amount", "rank")


@query(
    "contract_window",
    f"""WITH {_CONTRACTS}, s AS (SELECT greatest(max(year) - 4, min(year)) AS lo, max(year) AS hi FROM c WHERE year > 0),
    w AS (SELECT c.* FROM c, s WHERE year BETWEEN lo AND hi),
    t AS (SELECT entity, id, row_number() OVER (PARTITION BY entity ORDER BY amt DESC, id) AS p FROM w WHERE national AND amt IS NOT NULL)
    SELECT entity, count(*) AS n, round(coalesce(sum(CASE WHEN national THEN amt END), 0), 2) AS amount,
    (SELECT string_agg(id::VARCHAR, ',' ORDER BY p) FROM t WHERE t.entity = w.entity AND p <= 5) AS top_ids FROM w GROUP BY entity""",
)
def contract_window(t: Tables):
    totals, top = _contract_parts(t)
    sums, best = R.contract_window(totals, top, "entity", "year", "id")
    ids = best.groupBy("entity").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("top_ids")
    )
    return sums.join(ids, "entity", "left").select("entity", "n", r("amount", 2).alias("amount"), "top_ids")


@query(
    "field_completeness",
    f"""WITH {LISTINGS}, x AS (SELECT operation, count(*) AS n_rows, count(m2_built) AS m2_built, count(m2_land) AS m2_land, count(price) AS price FROM listings GROUP BY 1)
    SELECT operation, n_rows, field, filled, floor(filled * 100.0e0 / n_rows + 0.5)::BIGINT AS pct FROM (UNPIVOT x ON m2_built, m2_land, price INTO NAME field VALUE filled)""",
)
def field_completeness(t: Tables):
    out = R.field_completeness(listings(t), ["m2_built", "m2_land", "price"], ["operation"])
    return out.withColumnRenamed("rows", "n_rows")


@query(
    "stagnation",
    f"""WITH {EST}, a AS (SELECT street, count(*) AS n, count(*) FILTER (WHERE year >= 2001) AS o FROM est GROUP BY 1),
    b AS (SELECT *, o / greatest(n, 1) AS renewal, n >= 595 AS urban FROM a), q AS (SELECT quantile_cont(renewal, 0.15) AS cut FROM b WHERE urban)
    SELECT street, n, o, round(renewal, 6) AS renewal, urban, urban AND renewal <= coalesce(cut, 0) AS stagnant FROM b, q""",
)
def stagnation(t: Tables):
    a = establishments(t).groupBy("street").agg(F.count("*").alias("n"), F.sum((F.col("year") >= 2001).cast("bigint")).alias("o"))
    return R.stagnation(a, "o", "n", 595).select("street", "n", "o", r("renewal").alias("renewal"), "urban", "stagnant")


@query(
    "stagnation_report",
    f"""WITH {EST}, a AS (SELECT street, count(*) AS n, count(*) FILTER (WHERE year >= 2001) AS o FROM est GROUP BY 1),
    b AS (SELECT *, o / greatest(n, 1) AS renewal, n >= 595 AS urban FROM a), q AS (SELECT quantile_cont(renewal, 0.15) AS cut FROM b WHERE urban),
    s AS (SELECT b.*, urban AND renewal <= cut AS stagnant FROM b, q)
    SELECT count(*) FILTER (WHERE stagnant) AS n_stagnant, count(*) FILTER (WHERE urban) AS n_urban, round(median(renewal) FILTER (WHERE stagnant), 6) AS median_stagnant,
    round(median(renewal) FILTER (WHERE urban), 6) AS median_urban FROM s""",
)
def stagnation_report(t: Tables):
    a = establishments(t).groupBy("street").agg(F.count("*").alias("n"), F.sum((F.col("year") >= 2001).cast("bigint")).alias("o"))
    rep = R.stagnation_report(R.stagnation(a, "o", "n", 595))
    return rep.select("n_stagnant", "n_urban", r("median_stagnant").alias("median_stagnant"), r("median_urban").alias("median_urban"))


@query(
    "street_stagnation",
    f"""WITH {EST}, q AS (SELECT quantile_cont(year, 0.6) AS cut FROM est), e AS (SELECT street * 1000 + okey % 997 AS place, year FROM est)
    SELECT place, count(*) AS n_estab, count(*) FILTER (WHERE year >= cut) AS recent_openings, count(*) FILTER (WHERE year >= cut) = 0 AND count(*) >= 2 AS stagnant FROM e, q GROUP BY 1""",
)
def street_stagnation(t: Tables):
    e = establishments(t).select((F.col("street") * 1000 + F.col("okey") % 997).alias("place"), "year")
    return R.street_stagnation(e, "place", "year", 2)


def _zone_growth(t: Tables):
    g = listings(t).groupBy("zone_no").agg((F.avg("price") / 250000 - 1).alias("growth"), F.count("*").alias("n"))
    return municipalities(t).join(g, F.col("cell_id") == F.col("zone_no"))


_ZG = f"""{LISTINGS}, {MUNI}, g AS (SELECT m.*, x.growth FROM muni m JOIN (SELECT zone_no, avg(price) / 250000 - 1 AS growth FROM listings GROUP BY 1) x ON x.zone_no = m.cell_id),
  mb AS (SELECT 'south' AS basket, * FROM g WHERE lat < 22 UNION ALL SELECT 'west', * FROM g WHERE lng < -105 UNION ALL SELECT 'even', * FROM g WHERE cell_id % 2 = 0)"""


def _baskets():
    return {"south": F.col("lat") < 22, "west": F.col("lng") < -105, "even": F.col("cell_id") % 2 == 0}


@query(
    "basket_stats",
    f"WITH {_ZG} SELECT basket, count(*) AS n, round(avg(growth) * 100, 6) AS mean_pct, round(stddev_pop(growth) * 100, 6) AS risk_pct FROM mb GROUP BY 1",
)
def basket_stats(t: Tables):
    s, _ = R.basket_stats(_zone_growth(t), "growth", _baskets(), "name", "cell_id")
    return s.select("basket", "n", r("mean_pct").alias("mean_pct"), r("risk_pct").alias("risk_pct"))


@query(
    "basket_top",
    f"WITH {_ZG} SELECT basket, cell_id, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY growth DESC, cell_id)::INT AS rank FROM mb) WHERE rank <= 4",
)
def basket_top(t: Tables):
    return R.basket_stats(_zone_growth(t), "growth", _baskets(), "name", "cell_id")[1].select("basket", "cell_id", "name", "rank")


@query(
    "demand_rollup",
    f"""WITH {EVENTS}, de AS (SELECT * FROM ev WHERE event <> '')
    SELECT 'total' AS kind, '' AS key, '' AS event, count(*) AS n FROM de UNION ALL
    SELECT 'zone', zone, event, count(*) FROM de WHERE zone <> '' GROUP BY 2, 3 UNION ALL
    SELECT 'budget', budget, '', count(*) FROM de WHERE budget <> '' GROUP BY 2 UNION ALL
    SELECT 'type', type, '', count(*) FROM de WHERE type <> '' GROUP BY 2 UNION ALL
    SELECT 'style', s, '', count(*) FROM (SELECT unnest(styles) AS s FROM de) GROUP BY 2""",
)
def demand_rollup(t: Tables):
    return R.demand_rollup(events(t))


@query(
    "sismograph",
    f"""WITH {EST}, {_RECENT_ALL}, x AS (SELECT street, recent, CASE WHEN contains(name, 'BOLT') THEN 'Bolt' WHEN contains(name, 'GEAR') THEN 'Gear' WHEN contains(name, 'RING') THEN 'Ring' END AS sp FROM m)
    SELECT street, count(*) FILTER (WHERE recent) AS openings, 0::BIGINT AS closures, count(sp) FILTER (WHERE recent) AS indicators,
    coalesce(string_agg(DISTINCT sp, ', ' ORDER BY sp) FILTER (WHERE recent AND sp IS NOT NULL), '—') AS species FROM x GROUP BY 1""",
)
def sismograph(t: Tables):
    return R.openings_report(establishments(t), "street", "added_on", text.first_category(F.col("name"), SPECIES))


@query(
    "canary_cells",
    f"""WITH {EST}, y AS (SELECT max(year) AS ym FROM est),
    c AS (SELECT {_GRID}, lng, lat, year >= ym - 2 AS recent, CASE WHEN contains(name, 'BOLT') THEN 'Bolt' WHEN contains(name, 'GEAR') THEN 'Gear' WHEN contains(name, 'RING') THEN 'Ring' END AS sp FROM est, y)
    SELECT gx, gy, count(*) FILTER (WHERE recent) AS recent, count(*) AS total, count(*) FILTER (WHERE NOT recent) AS earlier, round(sum(lng), 4) AS lng_sum, round(sum(lat), 4) AS lat_sum,
    string_agg(DISTINCT sp, ', ' ORDER BY sp) FILTER (WHERE recent) AS species FROM c WHERE sp IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (WHERE recent) >= 1""",
)
def canary_cells(t: Tables):
    c = R.canary_cells(establishments(t), text.first_category(F.col("name"), SPECIES), "year")
    return c.select("gx", "gy", "recent", "total", "earlier", r(F.col("lng") * F.col("total"), 4).alias("lng_sum"), r(F.col("lat") * F.col("total"), 4).alias("lat_sum"), "species")


_UNITS = "u AS (SELECT s_nationkey::BIGINT AS town, s_suppkey AS unit, avg(l_extendedprice) AS price, avg(l_quantity) / 25 - 1 AS growth, avg(l_discount) AS rate, avg(l_tax) AS potential FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


def _units(t: Tables):
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("s_nationkey").cast("bigint").alias("town"), F.col("s_suppkey").alias("unit")).agg(
        F.avg("l_extendedprice").alias("price"), (F.avg("l_quantity") / 25 - 1).alias("growth"), F.avg("l_discount").alias("rate"), F.avg("l_tax").alias("potential")
    )


@query(
    "borough_rollup",
    f"""WITH {_UNITS} SELECT town, count(*) AS units, round(avg(price), 4) AS mean_price, round(avg(growth), 6) AS mean_growth, round(avg(rate), 6) AS mean_rate,
    round(avg(potential), 6) AS mean_potential, (SELECT unit FROM u v WHERE v.town = u.town ORDER BY growth DESC, unit LIMIT 1) AS leader FROM u GROUP BY town""",
)
def borough_rollup(t: Tables):
    b = R.borough_rollup(_units(t), "town", "unit")
    return b.select("town", "units", r("mean_price", 4).alias("mean_price"), *[r(c).alias(c) for c in ("mean_growth", "mean_rate", "mean_potential")], "leader")


@query("presale_floor", "SELECT l_suppkey AS project, min(l_extendedprice) AS floor_price FROM lineitem WHERE l_quantity - 40 > 0 GROUP BY 1")
def presale_floor(t: Tables):
    mix = t.lineitem.select(F.col("l_suppkey").alias("project"), "l_extendedprice", (F.col("l_quantity") - 40).alias("available"))
    return R.presale_floor(mix, "project", "l_extendedprice", "available")


@query(
    "subscribers_by_zone",
    f"""WITH {EVENTS}, p AS (SELECT DISTINCT zone, 'u' || user_id::VARCHAR || '@example.org' AS email FROM ev)
    SELECT zone, email, count(*) OVER (PARTITION BY zone) AS subscribers FROM p""",
)
def subscribers_by_zone(t: Tables):
    a = events(t).withColumn("email", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org")))
    return R.subscribers_by_zone(a, "zone", "email")


@query(
    "inventory_by_state",
    f"WITH {LISTINGS} SELECT zone, count(*) AS listings, count(DISTINCT contact) AS towns FROM listings GROUP BY 1 HAVING count(*) >= 600",
)
def inventory_by_state(t: Tables):
    return R.inventory_by_state(listings(t), "zone", "contact", 600)


@query(
    "impact_summary",
    f"""WITH {EST}, m AS (SELECT street, (avg(emp) / 25.5)::DOUBLE AS x FROM est GROUP BY 1)
    SELECT count(*) AS anchors, round(median(x), 6) AS median_multiplier, CASE WHEN median(x) > 1.05 THEN 'accelerates' WHEN median(x) < 0.95 THEN 'no accelerating effect' ELSE 'neutral' END AS reading FROM m""",
)
def impact_summary(t: Tables):
    m = establishments(t).groupBy("street").agg((F.avg("emp") / 25.5).alias("x"))
    return R.impact_summary(m, "x").select("anchors", r("median_multiplier").alias("median_multiplier"), "reading")


@query(
    "kpi_summary",
    f"""WITH {_UNITS}, v AS (SELECT *, price * (1 + growth) AS now FROM u), q AS (SELECT quantile_cont(rate, 0.9) AS q FROM v)
    SELECT round(avg(now), 4) AS mean_value, round((avg(now) / avg(price) - 1) * 100, 6) AS change_pct, count(*) FILTER (WHERE rate >= q) AS fast_cells,
    count(*) FILTER (WHERE unit % 3 = 0) AS covered, (SELECT unit FROM v ORDER BY now / price DESC, unit LIMIT 1) AS fastest FROM v, q""",
)
def kpi_summary(t: Tables):
    v = _units(t).withColumn("now", F.col("price") * (1 + F.col("growth")))
    k = R.kpi_summary(v, "now", "price", "rate", "unit", F.col("unit") % 3 == 0)
    return k.select(r("mean_value", 4).alias("mean_value"), r("change_pct").alias("change_pct"), "fast_cells", "covered", "fastest")
