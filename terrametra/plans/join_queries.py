"""Queries for joins and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrametra.functions import text
from terrametra.operators import matching as J
from terrametra.operators import rollups as R
from terrametra.operators import spatial as X
from terrametra.operators import stats as S
from terrametra.plans import streets as ST
from terrametra.plans.bindings import EST, LISTINGS, MUNI, QUEEN, STREETS, Tables, establishments, listings, municipalities, streets
from terrametra.plans.registry import query, r

# Haversine metres between (a.lat, a.lng) and (b.lat, b.lng).
_HAV = "12742.0e0 * asin(sqrt(least(greatest(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2), 0), 1)))"


@query(
    "street_profile",
    f"""WITH {EST}, s AS (SELECT c_custkey AS street FROM customer), a AS (SELECT street, count(*) AS n, sum(emp) AS e FROM est GROUP BY 1),
    m AS (SELECT street, trade FROM (SELECT street, trade, row_number() OVER (PARTITION BY street ORDER BY count(*) DESC, trade) AS p FROM est GROUP BY 1, 2) WHERE p = 1)
    SELECT street, coalesce(n, 0) AS n_estab, coalesce(e, 0)::BIGINT AS employment, coalesce(trade, 'Servicios') AS sector FROM s LEFT JOIN a USING (street) LEFT JOIN m USING (street)""",
)
def street_profile(t: Tables):
    s = t.customer.select(F.col("c_custkey").alias("street"))
    p = ST.street_profile(s, establishments(t), "street", "trade", "emp")
    return p.select("street", "n_estab", F.col("employment").cast("bigint").alias("employment"), "sector")


@query(
    "override_join",
    """SELECT c.c_custkey AS unit, coalesce(o.p, c.c_acctbal) AS price FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o.o_custkey = c.c_custkey""",
)
def override_join(t: Tables):
    base = t.customer.select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("price"))
    seen = t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("unit")).agg(F.max("o_totalprice").alias("price"))
    return J.override(base, seen, ["unit"], ["price"])


@query("dim_lookup", "SELECT r_name AS state, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def dim_lookup(t: Tables):
    dim = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("state"))
    return J.lookup(t.customer, dim, ["c_nationkey"]).groupBy("state").agg(F.count("*").alias("n"))


_CUTS = f"""{EST}, w AS (SELECT name, street, okey FROM est WHERE year >= 1996),
  old AS (SELECT name, street, okey FROM est WHERE year <= 1996),
  op AS (SELECT * FROM w ANTI JOIN old USING (name, street)), cl AS (SELECT * FROM old ANTI JOIN w USING (name, street))"""


@query(
    "snapshot_diff",
    f"""WITH {_CUTS}, x AS (SELECT street, [CASE WHEN contains(name, 'BOLT') OR contains(name, 'GEAR') THEN 'Hardware' END, CASE WHEN contains(name, 'RING') OR contains(name, 'HOT') THEN 'Warm' END] AS sp FROM op),
    s AS (SELECT street, string_agg(DISTINCT u, ', ' ORDER BY u) AS species FROM (SELECT street, unnest(sp) AS u FROM x) WHERE u IS NOT NULL GROUP BY 1)
    SELECT street, count(*) AS openings, coalesce((SELECT count(*) FROM cl WHERE cl.street = x.street), 0) AS closures,
    count(*) FILTER (WHERE sp[1] IS NOT NULL OR sp[2] IS NOT NULL) AS indicators, coalesce(any_value(s.species), '—') AS species FROM x LEFT JOIN s USING (street) GROUP BY street""",
)
def snapshot_diff(t: Tables):
    e = establishments(t).select(F.initcap("name").alias("name"), "street", "year", "okey")
    new, old = e.filter("year >= 1996"), e.filter("year <= 1996")
    sp = text.all_categories(text.ascii_upper(F.col("name")), {"Hardware": ["BOLT", "GEAR"], "Warm": ["RING", "HOT"]})
    new, old = (d.withColumn("street_txt", F.col("street").cast("string")) for d in (new, old))
    out = J.registry_diff(new, old, "name", "street_txt", sp)
    return out.select(F.col("street_txt").cast("bigint").alias("street"), "openings", "closures", "indicators", "species")


_DIAMONDS = f"""{LISTINGS}, p AS (SELECT s_suppkey AS poly_id, -99.20e0 + (s_suppkey * 7919 % 1000) * 0.0001e0 + 0.00003e0 AS x, 19.45e0 + (s_suppkey * 15485863 % 1000) * 0.0001e0 + 0.00003e0 AS y FROM supplier),
  hits AS (SELECT poly_id, id, price FROM p JOIN listings ON abs(lng - x) + abs(lat - y) < 0.006e0)"""


def _diamonds(t: Tables):
    """A diamond of 0.006 degrees around every supplier."""
    k = F.col("s_suppkey")
    x = F.lit(-99.20) + (k * 7919 % 1000) * F.lit(0.0001) + F.lit(0.00003)
    y = F.lit(19.45) + (k * 15485863 % 1000) * F.lit(0.0001) + F.lit(0.00003)
    d = 0.006
    corner = lambda dx, dy: F.struct((x + dx).alias("lng"), (y + dy).alias("lat"))
    ring = F.array(corner(d, 0.0), corner(0.0, d), corner(-d, 0.0), corner(0.0, -d), corner(d, 0.0))
    return t.supplier.select(k.alias("poly_id"), F.array(ring).alias("rings"))


@query("point_in_polygon", f"WITH {_DIAMONDS} SELECT poly_id, count(*) AS n, sum(id)::BIGINT AS id_sum FROM hits GROUP BY 1")
def point_in_polygon(t: Tables):
    points = listings(t).select("lng", "lat", "id", F.lit(1).alias("n"))
    hits = X.points_in_polygons(points, _diamonds(t), step=0.004, sums=["n", "id"], each=True)
    return hits.groupBy("poly_id").agg(F.sum("n").alias("n"), F.sum("id").alias("id_sum"))


@query("short_rent_signal", f"WITH {_DIAMONDS} SELECT poly_id, count(*) AS listings, round(median(price), 4) AS night_price FROM hits GROUP BY 1")
def short_rent_signal(t: Tables):
    out = R.polygon_signal(listings(t).select("price", "lng", "lat", "id"), _diamonds(t), "price", step=0.004)
    return out.select("poly_id", "listings", r("night_price", 4).alias("night_price"))


def _squares(t: Tables, half: float):
    s = streets(t)
    corner = lambda dx, dy: F.struct((F.col("lng") + dx).alias("lng"), (F.col("lat") + dy).alias("lat"))
    ring = F.array(corner(-half, -half), corner(half, -half), corner(half, half), corner(-half, half), corner(-half, -half))
    return s.select(F.col("street").alias("cell_id"), F.array(ring).alias("rings"), "lng", "lat")


@query(
    "polygon_adjacency",
    f"""WITH {STREETS} SELECT a.street AS src, b.street AS dst FROM streets a JOIN streets b ON a.street <> b.street
    WHERE sqrt(pow(greatest(abs(a.lng - b.lng) - 0.008e0, 0), 2) + pow(greatest(abs(a.lat - b.lat) - 0.008e0, 0), 2)) <= 0.00253e0""",
)
def polygon_adjacency(t: Tables):
    return X.polygon_adjacency(_squares(t, 0.004), 0.00253)


@query(
    "street_crossings",
    f"""WITH {STREETS}, n AS (SELECT a.street AS src, b.street AS dst FROM streets a JOIN streets b ON a.street <> b.street
      WHERE sqrt(pow(greatest(abs(a.lng - b.lng) - 0.008e0, 0), 2) + pow(greatest(abs(a.lat - b.lat) - 0.008e0, 0), 2)) <= 0.00253e0)
    SELECT street AS cell_id, greatest(count(dst), 1) AS degree FROM streets LEFT JOIN n ON src = street GROUP BY 1""",
)
def street_crossings(t: Tables):
    sq = _squares(t, 0.004)
    return X.degrees_of(sq, X.polygon_adjacency(sq, 0.00253, counted=True))


@query("grid_adjacency", f"""WITH {EST}, c AS (SELECT DISTINCT round_even(lng / 0.0028e0, 0)::BIGINT AS gx, round_even(lat / 0.0028e0, 0)::BIGINT AS gy FROM est)
    SELECT a.gx * 100000 + a.gy AS src, b.gx * 100000 + b.gy AS dst FROM c a JOIN c b ON b.gx BETWEEN a.gx - 1 AND a.gx + 1 AND b.gy BETWEEN a.gy - 1 AND a.gy + 1 WHERE a.gx <> b.gx OR a.gy <> b.gy""")
def grid_adjacency(t: Tables):
    cells = R.grid_rollup(establishments(t), "lng", "lat", 0.0028, {"n": F.count("*")})
    return X.grid_edges(cells.withColumn("cell_id", F.col("gx") * 100000 + F.col("gy")))


@query("queen_edges", f"WITH {MUNI}, {QUEEN} SELECT src, dst FROM edges")
def queen_edges(t: Tables):
    return X.grid_edges(municipalities(t))


@query(
    "nearest_neighbor",
    f"""WITH {LISTINGS}, {STREETS}, d AS (SELECT l.id, s.street, sqrt(pow(l.lng - s.lng, 2) + pow(l.lat - s.lat, 2)) AS d FROM listings l, streets s)
    SELECT id, arg_min(street, (d, street)) AS near_id, round(min(d), 8) AS dist FROM d GROUP BY 1""",
)
def nearest_neighbor(t: Tables):
    out = X.nearest(listings(t).select("id", "lng", "lat"), streets(t), "street", stable=True)
    return out.select("id", "near_id", r("near_dist", 8).alias("dist"))


@query(
    "nearest_by_rings",
    f"""WITH {LISTINGS}, {STREETS}, d AS (SELECT l.id, s.street, sqrt(pow(l.lng - s.lng, 2) + pow(l.lat - s.lat, 2)) AS d FROM listings l, streets s)
    SELECT id, arg_min(street, (d, street)) AS near_id, round(min(d), 8) AS dist FROM d GROUP BY 1""",
)
def nearest_by_rings(t: Tables):
    """The same search without the packed path, as large anchor tables run it."""
    out = X.nearest(listings(t).select("id", "lng", "lat"), streets(t), "street", step=0.004, limit=0, stable=True)
    return out.select("id", "near_id", r("near_dist", 8).alias("dist"))


@query(
    "nearest_within",
    f"""WITH {LISTINGS}, {STREETS}, d AS (SELECT a.id, b.street, {_HAV} AS d FROM listings a, streets b),
    n AS (SELECT id, arg_min(street, (d, street)) AS near_id, min(d) AS d FROM d GROUP BY 1)
    SELECT id, CASE WHEN d <= 0.3 THEN near_id END AS near_id, round(CASE WHEN d <= 0.3 THEN d END, 7) AS km FROM n""",
)
def nearest_within(t: Tables):
    out = X.nearest_within(listings(t).select("id", "lng", "lat"), streets(t), "street", 0.3, stable=True)
    return out.select("id", "near_id", r("near_dist", 7).alias("km"))


@query(
    "nearest_within_planar",
    f"""WITH {LISTINGS}, {STREETS}, d AS (SELECT a.id, b.street, sqrt(pow((b.lng - a.lng) * 111.0e0 * cos(radians(a.lat)), 2) + pow((b.lat - a.lat) * 111.0e0, 2)) AS d FROM listings a, streets b),
    n AS (SELECT id, arg_min(street, (d, street)) AS near_id, min(d) AS d FROM d GROUP BY 1)
    SELECT id, CASE WHEN d <= 0.3 THEN near_id END AS near_id, round(CASE WHEN d <= 0.3 THEN d END, 7) AS km FROM n""",
)
def nearest_within_planar(t: Tables):
    out = X.nearest_within(listings(t).select("id", "lng", "lat"), streets(t), "street", 0.3, metric="planar", stable=True)
    return out.select("id", "near_id", r("near_dist", 7).alias("km"))


@query(
    "distance_self_join",
    f"""WITH c AS (SELECT c_custkey AS k, -99.20e0 + (c_custkey * 7919 % 1000) * 0.0001e0 AS lng, 19.45e0 + (c_custkey * 15485863 % 1013) * 0.0001e0 AS lat FROM customer),
    p AS (SELECT a.k AS a, b.k AS b, {_HAV} * 1000 AS m FROM c a JOIN c b ON a.k < b.k AND abs(a.lat - b.lat) < 0.006e0)
    SELECT a, b, round_even(m, 0)::BIGINT AS dist_m FROM p WHERE m < 600""",
)
def distance_self_join(t: Tables):
    k = F.col("c_custkey")
    sites = t.customer.select(
        k.alias("k"),
        (F.lit(-99.20) + (k * 7919 % 1000) * F.lit(0.0001)).alias("lng"),
        (F.lit(19.45) + (k * 15485863 % 1013) * F.lit(0.0001)).alias("lat"),
    )
    return X.close_pairs(sites, "k", 600.0)


_DEMAND = f"""{EST}, c AS (SELECT round_even(lng / 0.0028e0, 0)::BIGINT AS gx, round_even(lat / 0.0028e0, 0)::BIGINT AS gy, sum(emp) AS employment, count(*) FILTER (WHERE contains(name, 'GIZMO')) AS comp, count(*) AS n FROM est GROUP BY 1, 2),
  dem AS (SELECT a.gx, a.gy, a.n, sum(b.employment)::BIGINT AS demand, sum(b.comp)::BIGINT AS competitors FROM c a JOIN c b ON b.gx BETWEEN a.gx - 1 AND a.gx + 1 AND b.gy BETWEEN a.gy - 1 AND a.gy + 1 GROUP BY 1, 2, 3)"""


@query("queen_sum", f"WITH {_DEMAND} SELECT gx, gy, n, demand, competitors FROM dem")
def queen_sum(t: Tables):
    return ST.demand_grid(establishments(t), "emp", ST.competitor_flag(F.col("name"), ["GIZMO"]))


@query(
    "coverage_gaps",
    f"""WITH {_DEMAND}, {STREETS}, cells AS (SELECT gx * 100000 + gy AS cell_id, (gx + 0.5) * 0.0028e0 AS lng, (gy + 0.5) * 0.0028e0 AS lat, demand FROM dem WHERE n >= 8),
    d AS (SELECT a.cell_id, a.demand, min({_HAV}) AS km FROM cells a, streets b GROUP BY 1, 2)
    SELECT cell_id, demand, round_even(km, 2) AS network_km FROM d WHERE km > 0.25 ORDER BY demand DESC, cell_id LIMIT 5""",
)
def coverage_gaps(t: Tables):
    cells = ST.cell_centre(ST.demand_grid(establishments(t), "emp").filter("n >= 8")).withColumn("cell_id", F.col("gx") * 100000 + F.col("gy"))
    out = X.coverage_gaps(cells, streets(t), km=0.25)
    return out.select("cell_id", "demand", "network_km")


@query(
    "nearest_competitor",
    f"""WITH {STREETS}, {EST}, b AS (SELECT DISTINCT lng, lat FROM est WHERE contains(name, 'GIZMO')), d AS (SELECT a.street, min({_HAV}) AS km FROM streets a, b GROUP BY 1)
    SELECT street, round_even(km * 1000.0e0, 0) AS competitor_m FROM d""",
)
def nearest_competitor(t: Tables):
    rivals = establishments(t).filter(F.col("name").contains("GIZMO")).select("lng", "lat").distinct().withColumn("site", F.concat_ws(",", "lng", "lat"))
    out = X.nearest(streets(t), rivals, "site", metric="haversine", stable=True)
    return out.select("street", F.bround(F.col("near_dist") * 1000.0).alias("competitor_m"))


_EVENT = f"""{EST}, a AS (SELECT okey, line, pkey, lng, lat, year FROM est WHERE emp >= 48 AND year BETWEEN 1997 AND 1999),
  ids AS (SELECT okey * 100000000 + pkey * 10 + line AS anchor_id, min(lng) AS lng, min(lat) AS lat, min(year) AS year FROM a GROUP BY 1),
  near AS (SELECT i.anchor_id, any_value(i.year) AS year,
    count(*) FILTER (WHERE e.year BETWEEN i.year - 2 AND i.year - 1) AS before_near, count(*) FILTER (WHERE e.year BETWEEN i.year + 1 AND i.year + 2) AS after_near
    FROM ids i JOIN est e ON e.lng > i.lng - 0.005e0 AND e.lng < i.lng + 0.005e0 AND e.lat > i.lat - 0.005e0 AND e.lat < i.lat + 0.005e0
      AND sqrt(pow(e.lng - i.lng, 2) + pow(e.lat - i.lat, 2)) < 0.004e0 AND sqrt(pow(e.lng - i.lng, 2) + pow(e.lat - i.lat, 2)) > 1e-9 GROUP BY 1)"""


def _large(t: Tables):
    a = establishments(t).filter((F.col("emp") >= 48) & F.col("year").between(1997, 1999))
    return a.groupBy((F.col("okey") * 100000000 + F.col("pkey") * 10 + F.col("line")).alias("anchor_id")).agg(
        F.min("lng").alias("lng"), F.min("lat").alias("lat"), F.min("year").alias("year")
    )


@query("radius_count", f"WITH {_EVENT} SELECT anchor_id, coalesce(before_near, 0) AS before_near, coalesce(after_near, 0) AS after_near FROM ids LEFT JOIN near USING (anchor_id)")
def radius_count(t: Tables):
    return X.radius_count(_large(t), establishments(t), "year").select("anchor_id", "before_near", "after_near")


@query(
    "event_study",
    f"""WITH {_EVENT}, y AS (SELECT year, count(*) AS k FROM est GROUP BY 1),
    x AS (SELECT n.*, (SELECT coalesce(sum(k), 0) FROM y WHERE y.year BETWEEN n.year - 2 AND n.year - 1) AS bc, (SELECT coalesce(sum(k), 0) FROM y WHERE y.year BETWEEN n.year + 1 AND n.year + 2) AS ac FROM near n)
    SELECT anchor_id, year, before_near, after_near, round_even((after_near / before_near) / (ac / bc), 2) AS multiplier FROM x WHERE before_near >= 3 AND bc > 0 AND ac > 0 AND after_near > 0""",
)
def event_study(t: Tables):
    return S.event_study(_large(t), establishments(t), "year").select("anchor_id", "year", "before_near", "after_near", "multiplier")


@query(
    "radius_search",
    f"WITH {LISTINGS}, {STREETS}, p AS (SELECT a.street AS query_id, b.id, {_HAV} * 1000 AS m FROM streets a, listings b) SELECT query_id, count(*) AS n, round(sum(m), 2) AS total_m FROM p WHERE m < 500 GROUP BY 1",
)
def radius_search(t: Tables):
    q = streets(t).select(F.col("street").alias("query_id"), "lng", "lat")
    hits = X.radius_search(q, listings(t).select("id", "lng", "lat"), None, 0.5)
    return hits.groupBy("query_id").agg(F.sum("n").alias("n"), r(F.sum(F.col("n") * F.col("dist_m")), 2).alias("total_m"))


@query(
    "slug_fallback_join",
    """WITH reg AS (SELECT CASE WHEN s_acctbal < 3000 THEN 'x' ELSE '' END || lower(replace(s_name, '#', '-')) AS slug, s_suppkey AS reg_id FROM supplier UNION ALL SELECT CASE WHEN n_regionkey = 2 THEN 'x' ELSE '' END || 'nation-' || n_nationkey::VARCHAR, 1000000 + n_nationkey FROM nation),
    u AS (SELECT s_suppkey AS unit, lower(replace(s_name, '#', '-')) AS s2, 'nation-' || s_nationkey::VARCHAR AS s3 FROM supplier)
    SELECT unit, coalesce(a.reg_id, b.reg_id) AS reg_id, coalesce(a.slug, b.slug) AS slug FROM u LEFT JOIN reg a ON a.slug = s2 LEFT JOIN reg b ON b.slug = s3""",
)
def slug_fallback_join(t: Tables):
    n = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    units = n.select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("a"), F.col("n_name").alias("b"))
    marked = lambda cond, name: text.slug(F.concat(F.when(cond, "x").otherwise(""), F.col(name))).alias("slug")
    reg = t.supplier.select(marked(F.col("s_acctbal") < 3000, "s_name"), F.col("s_suppkey").alias("reg_id")).unionByName(
        t.nation.select(marked(F.col("n_regionkey") == 2, "n_name"), (1000000 + F.col("n_nationkey").cast("bigint")).alias("reg_id"))
    )
    out = J.slug_fallback_join(units, "unit", [F.concat_ws(", ", "a", "b"), F.col("a"), F.col("b")], reg, "slug")
    return out.select("unit", "reg_id", "slug")


@query(
    "entity_resolution",
    """WITH off AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Gral. Ciudad ' || c_custkey::VARCHAR WHEN 1 THEN 'Villa ' || c_custkey::VARCHAR || ' Norte' WHEN 2 THEN 'San Pedro ' || c_custkey::VARCHAR ELSE 'Santa Fe ' || c_custkey::VARCHAR || ' de la Sierra' END AS official FROM customer)
    SELECT CASE c_custkey % 4 WHEN 0 THEN 'GENERAL CIUDAD ' || c_custkey::VARCHAR WHEN 1 THEN 'Norte Villa ' || c_custkey::VARCHAR WHEN 2 THEN 'san pedro ' || c_custkey::VARCHAR ELSE 'Sta Fe ' || c_custkey::VARCHAR END AS request,
    official, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 4 END AS rule FROM off
    UNION ALL SELECT 'San Pedro', NULL, 4 UNION ALL SELECT 'Nowhere', NULL, NULL""",
)
def entity_resolution(t: Tables):
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    pick = lambda a, b, c, d: F.when(k % 4 == 0, a).when(k % 4 == 1, b).when(k % 4 == 2, c).otherwise(d)
    cat = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    names = t.customer.select(pick(cat("Gral. Ciudad ", s), cat("Villa ", s, " Norte"), cat("San Pedro ", s), cat("Santa Fe ", s, " de la Sierra")).alias("official"))
    asked = t.customer.select(pick(cat("GENERAL CIUDAD ", s), cat("Norte Villa ", s), cat("san pedro ", s), cat("Sta Fe ", s)).alias("request"))
    extra = t.region.select(F.explode(F.array(F.lit("San Pedro"), F.lit("Nowhere"))).alias("request"))
    out = J.resolve_entities(asked.unionByName(extra), "request", names, "official")
    return out.select("request", "official", "rule")


@query(
    "partial_name_join",
    """WITH mon AS (SELECT 'mun ' || c_custkey::VARCHAR || ' x' AS mun, 'nation ' || c_nationkey::VARCHAR AS ent, c_custkey % 6 AS level FROM customer),
    z AS (SELECT s_suppkey AS zone, CASE WHEN s_suppkey % 10 = 0 THEN '*' WHEN s_suppkey % 2 = 0 THEN 'mun ' || s_suppkey::VARCHAR || ' x' ELSE 'mun ' || s_suppkey::VARCHAR END AS mun, 'nation ' || (s_nationkey)::VARCHAR AS ent FROM supplier),
    h AS (SELECT zone, level, CASE WHEN z.mun = '*' AND contains(m.ent, z.ent) THEN 1 WHEN z.mun <> '*' AND (contains(m.ent, z.ent) OR contains(z.ent, m.ent)) AND m.mun = z.mun THEN 1
      WHEN z.mun <> '*' AND (contains(m.ent, z.ent) OR contains(z.ent, m.ent)) AND contains(m.mun, z.mun) THEN 2 END AS rule FROM z, mon m),
    b AS (SELECT *, min(rule) OVER (PARTITION BY zone) AS best FROM h WHERE rule IS NOT NULL)
    SELECT zone, max(level) AS level, count(*) AS matched FROM b WHERE rule = best GROUP BY 1""",
)
def partial_name_join(t: Tables):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    mon = t.customer.select(F.concat(F.lit("mun "), c.cast("string"), F.lit(" x")).alias("mun"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("ent"), (c % 6).alias("level"))
    name = F.concat(F.lit("mun "), s.cast("string"))
    zones = t.supplier.select(
        s.alias("zone"),
        F.when(s % 10 == 0, "*").when(s % 2 == 0, F.concat(name, F.lit(" x"))).otherwise(name).alias("mun"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("ent"),
    )
    return drought_of(J.partial_name_join(zones, mon, [F.max("level").alias("level"), F.count("*").alias("matched")]))


def drought_of(matched):
    return matched.groupBy("zone").agg(F.max("level").alias("level"), F.sum("matched").alias("matched"))


@query(
    "drought_zone",
    """WITH mon AS (SELECT s_suppkey::VARCHAR AS mun, 'nation_' || s_nationkey::VARCHAR AS ent, s_suppkey % 6 AS level FROM supplier)
    SELECT n_name AS zone, max(level) AS level, count(*) AS matched FROM nation JOIN mon ON contains(mon.ent, lower(n_name)) GROUP BY 1""",
)
def drought_zone(t: Tables):
    s = F.col("s_suppkey")
    mon = t.supplier.select(s.cast("string").alias("mun"), F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("ent"), (s % 6).alias("level"))
    zones = t.nation.select(F.col("n_name").alias("zone"), F.lit("*").alias("mun"), F.lower("n_name").alias("ent"))
    return drought_of(J.partial_name_join(zones, mon, [F.max("level").alias("level"), F.count("*").alias("matched")]))


@query(
    "fill_cross_join",
    f"""WITH {EST}, c AS (SELECT street, sector, count(*) AS k FROM est GROUP BY 1, 2), s AS (SELECT unnest(['Comercio', 'Servicios', 'Industria', 'Alimentos']) AS sector)
    SELECT c_custkey AS street, s.sector, coalesce(k, 0) AS shops FROM customer CROSS JOIN s LEFT JOIN c ON c.street = c_custkey AND c.sector = s.sector""",
)
def fill_cross_join(t: Tables):
    counts = establishments(t).groupBy("street", "sector").agg(F.count("*").alias("shops"))
    base = t.customer.select(F.col("c_custkey").alias("street"))
    return J.complete_with_zero(base, ["street"], "sector", ["Comercio", "Servicios", "Industria", "Alimentos"], counts, "shops")


@query(
    "before_after_outer",
    f"""WITH {EST}, q AS (SELECT quantile_cont(year, 0.6) AS cut FROM est), g AS (SELECT round_even(lng / 0.0027e0, 0)::BIGINT AS gx, round_even(lat / 0.0027e0, 0)::BIGINT AS gy, year <= cut AS b FROM est, q)
    SELECT gx, gy, count(*) FILTER (WHERE b) AS before, count(*) FILTER (WHERE NOT b) AS after FROM g GROUP BY 1, 2""",
)
def before_after_outer(t: Tables):
    from terrametra.operators.ranking import quantile_value

    e = establishments(t)
    g = e.withColumn("cut", quantile_value(e, "year", 0.6)).withColumn("gx", F.rint(F.col("lng") / 0.0027).cast("bigint")).withColumn("gy", F.rint(F.col("lat") / 0.0027).cast("bigint"))
    return J.before_after(g, ["gx", "gy"], F.col("year") <= F.col("cut"))


@query(
    "registry_merge",
    """WITH a AS (SELECT lower(replace(n_name, '_', '-')) AS slug, n_name AS name, 0 AS p FROM nation),
    b AS (SELECT 'nation-' || (c_nationkey + 5)::VARCHAR AS slug, min(c_name) AS name, 1 AS p FROM customer GROUP BY 1)
    SELECT slug, arg_min(name, p) AS name FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""",
)
def registry_merge(t: Tables):
    a = t.nation.select(text.slug(F.col("n_name")).alias("slug"), F.col("n_name").alias("name"))
    b = t.customer.select(F.concat(F.lit("nation-"), (F.col("c_nationkey") + 5).cast("string")).alias("slug"), F.col("c_name").alias("name"))
    return J.merge_registries([a, b], "slug", "name").select("slug", "name")


@query(
    "inverse_distance_weights",
    f"""WITH {STREETS}, p AS (SELECT a.street, 1.0e0 / greatest({_HAV}, 2.0) AS w, (b.street % 17)::DOUBLE AS v FROM streets a JOIN streets b ON a.street <> b.street)
    SELECT street, round(sum(w * v) / sum(w), 7) AS v_near FROM p GROUP BY 1""",
)
def inverse_distance_weights(t: Tables):
    z = streets(t).withColumn("v", (F.col("street") % 17).cast("double"))
    return X.inverse_distance_mean(z, "street", "v", floor_km=2.0, block=30).select("street", r("v_near", 7).alias("v_near"))


_FLOW = f"""{EST}, {STREETS}, u AS (SELECT s.street, s.lng, s.lat, sum(e.emp) AS mass, avg(e.price) AS rate FROM streets s JOIN est e USING (street) GROUP BY 1, 2, 3),
  src AS (SELECT * FROM u ORDER BY mass DESC, street LIMIT 6), tgt AS (SELECT * FROM u WHERE street NOT IN (SELECT street FROM src) ORDER BY rate DESC, street LIMIT 20)"""


@query(
    "gravity_flow",
    f"""WITH {_FLOW}, p AS (SELECT t.street AS target, s.street AS source, s.mass / pow(sqrt(pow(t.lng - s.lng, 2) + pow(t.lat - s.lat, 2)) + 0.1e0, 1.2e0) AS pull, t.rate FROM tgt t, src s)
    SELECT target, arg_max(source, pull) AS source, round(max(pull), 4) AS pull, round(any_value(rate) / ((SELECT max(rate) FROM u) + 1e-9), 8) AS intensity FROM p GROUP BY 1""",
)
def gravity_flow(t: Tables):
    facts = establishments(t).groupBy("street").agg(F.sum("emp").alias("mass"), F.avg("price").alias("rate"))
    f = X.gravity_flows(streets(t).select("street", "lng", "lat").join(facts, "street"), "street", "mass", "rate")
    return f.select("target", "source", r("pull", 4).alias("pull"), r("intensity", 8).alias("intensity"))


# One table expression per anchor, in anchor order.
_PULLS = "".join(
    f""", q{i + 1} AS (SELECT cell_id, lng, lat, p * (1.0e0 - w) + ap * w AS p FROM (SELECT q{i}.*, a.p AS ap,
      exp(-(pow(q{i}.lng - a.lng, 2) + pow(q{i}.lat - a.lat, 2)) / (2.0e0 * 0.011e0 * 0.011e0)) * 0.6e0 AS w FROM q{i}, a WHERE a.k = {i}))"""
    for i in range(5)
)


@query(
    "geo_calibration",
    f"""WITH {_DEMAND}, m AS (SELECT gx * 100000 + gy AS cell_id, (gx + 0.5) * 0.0028e0 AS lng, (gy + 0.5) * 0.0028e0 AS lat, 9000.0e0 + demand AS price FROM dem),
    a AS (SELECT r_regionkey AS k, -99.20e0 + (r_regionkey * 7919 % 1000) * 0.0001e0 AS lng, 19.45e0 + (r_regionkey * 613 % 1000) * 0.0001e0 AS lat, 15000.0e0 + 500 * r_regionkey AS p FROM region),
    d AS (SELECT a.k, a.p, m.price, sqrt(pow(m.lng - a.lng, 2) + pow(m.lat - a.lat, 2)) AS d, m.cell_id FROM a, m),
    f AS (SELECT median(p / price) AS f FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, cell_id) AS i FROM d WHERE d < 0.03e0) WHERE i = 1),
    q0 AS (SELECT m.cell_id, m.lng, m.lat, m.price * f.f AS p FROM m, f){_PULLS}
    SELECT cell_id, round_even(p, 0) AS calibrated FROM q5""",
)
def geo_calibration(t: Tables):
    k = F.col("r_regionkey")
    anchors = t.region.select(
        k.alias("anchor_no"),
        (F.lit(-99.20) + (k * 7919 % 1000) * F.lit(0.0001)).alias("lng"),
        (F.lit(19.45) + (k * 613 % 1000) * F.lit(0.0001)).alias("lat"),
        (F.lit(15000.0) + 500 * k).alias("price_m2"),
    )
    cells = ST.cell_centre(ST.demand_grid(establishments(t), "emp")).select((F.col("gx") * 100000 + F.col("gy")).alias("cell_id"), "lng", "lat", (F.lit(9000.0) + F.col("demand")).alias("price"))
    return X.calibrate_to_anchors(cells, "price", anchors).select("cell_id", "calibrated")


@query(
    "anchor_top3",
    f"""WITH {EST}, {STREETS}, u AS (SELECT s.street, s.lng, s.lat, avg(e.price) AS rate FROM streets s JOIN est e USING (street) GROUP BY 1, 2, 3),
    a AS (SELECT n_nationkey::BIGINT AS anchor_id, -99.20e0 + (n_nationkey * 7919 % 1000) * 0.0001e0 + CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS lng, 19.45e0 + (n_nationkey * 613 % 1000) * 0.0001e0 AS lat FROM nation),
    d AS (SELECT a.anchor_id, u.street, u.rate, sqrt(pow(u.lng - a.lng, 2) + pow(u.lat - a.lat, 2)) AS d FROM a, u),
    k AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY d, street) AS i, min(d) OVER (PARTITION BY anchor_id) AS m FROM d),
    c AS (SELECT * FROM k WHERE (m < 0.024e0 AND d < 0.024e0) OR (m >= 0.024e0 AND i <= 8))
    SELECT anchor_id, street, rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY rate DESC, street)::INT AS rank FROM c) WHERE rank <= 3""",
)
def anchor_top3(t: Tables):
    facts = establishments(t).groupBy("street").agg(F.avg("price").alias("rate"))
    units = streets(t).select("street", "lng", "lat").join(facts, "street")
    k = F.col("n_nationkey")
    anchors = t.nation.select(
        k.cast("bigint").alias("anchor_id"),
        (F.lit(-99.20) + (k * 7919 % 1000) * F.lit(0.0001) + F.when(k % 5 == 0, 1).otherwise(0)).alias("lng"),
        (F.lit(19.45) + (k * 613 % 1000) * F.lit(0.0001)).alias("lat"),
    )
    return X.anchor_top3(anchors, units, "street", "rate").select("anchor_id", "street", "rank")


@query(
    "rank_cp_source",
    """WITH e AS (SELECT lpad((c_custkey * 2 % 1200)::VARCHAR, 5, '0') AS cp, c_acctbal AS lat, c_acctbal * 2 AS lng, 1 + c_custkey % 2 AS q, c_custkey AS pos FROM customer),
    m AS (SELECT lpad(s_suppkey::VARCHAR, 5, '0') AS cp, s_acctbal AS lat, s_acctbal * 2 AS lng, 0 AS q, s_suppkey AS pos FROM supplier),
    b AS (SELECT *, 0 AS precision FROM e UNION ALL SELECT *, 1 FROM m)
    SELECT cp, lat, lng, precision FROM (SELECT *, row_number() OVER (PARTITION BY cp ORDER BY precision, q DESC, pos DESC) AS p FROM b) WHERE p = 1""",
)
def rank_cp_source(t: Tables):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    exact = t.customer.select(
        F.lpad((c * 2 % 1200).cast("string"), 5, "0").alias("cp"), F.col("c_acctbal").alias("lat"), (F.col("c_acctbal") * 2).alias("lng"), (1 + c % 2).alias("q"), c.alias("pos")
    )
    town = t.supplier.select(F.lpad(s.cast("string"), 5, "0").alias("cp"), F.col("s_acctbal").alias("lat"), (F.col("s_acctbal") * 2).alias("lng"), F.lit(0).cast("bigint").alias("q"), s.alias("pos"))
    return J.rank_sources(exact, town, "cp", "q", "pos")


