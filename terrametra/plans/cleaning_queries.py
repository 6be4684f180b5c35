"""Queries for projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrametra.functions import geo, numeric, text
from terrametra.functions.constants import DROUGHT_LABELS
from terrametra.operators import cleaning as C
from terrametra.operators import market as M
from terrametra.plans.bindings import EST, LISTINGS, MUNI, PRICED, STREETS, Tables, establishments, listings, municipalities, streets
from terrametra.plans.registry import query, r

TRADE_WORDS = {"Hardware": ["BOLT", "GEAR"], "Jewels": ["RING", "GEAR"], "Gadgets": ["WIDGET", "GIZMO"]}


@query("sector_map", f"WITH {EST} SELECT code, sector, count(*) AS n FROM est GROUP BY 1, 2")
def sector_map(t: Tables):
    return establishments(t).groupBy("code", "sector").agg(F.count("*").alias("n"))


@query("employment_band", f"WITH {EST} SELECT band, staff, count(*) AS n, sum(staff)::BIGINT AS total FROM est GROUP BY 1, 2")
def employment_band(t: Tables):
    return establishments(t).groupBy("band", "staff").agg(F.count("*").alias("n"), F.sum("staff").alias("total"))


@query(
    "geo_key",
    f"""WITH {EST} SELECT lpad(state::VARCHAR, 2, '0') || lpad(muni::VARCHAR, 3, '0') AS area,
    lpad((street * 37 % 100000)::VARCHAR, 5, '0') AS postal,
    CASE substr(lpad((street * 37 % 100000)::VARCHAR, 5, '0'), 1, 2) WHEN '01' THEN 'Uno' WHEN '02' THEN 'Dos' ELSE 'Otro' END AS borough,
    count(*) AS n FROM est GROUP BY 1, 2, 3""",
)
def geo_key(t: Tables):
    code = C.postal_key(F.concat((F.col("street") * 37 % 100000).cast("string"), F.lit(".0")))
    return establishments(t).groupBy(
        C.area_key(F.col("state"), F.col("muni")).alias("area"),
        code.alias("postal"),
        C.prefix_lookup(code, {"01": "Uno", "02": "Dos"}, "Otro").alias("borough"),
    ).agg(F.count("*").alias("n"))


@query(
    "street_name",
    f"""WITH {EST}, s AS (SELECT trade AS kind, CASE WHEN pkey % 3 = 0 THEN trade || ' ' || name ELSE name END AS nom FROM est),
    f AS (SELECT CASE WHEN starts_with(upper(nom), upper(kind) || ' ') THEN nom ELSE kind || ' ' || nom END AS full_name FROM s)
    SELECT array_to_string(list_transform(string_split(full_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS street,
    count(*) AS n FROM f GROUP BY 1""",
)
def street_name(t: Tables):
    e = establishments(t).withColumn("nom", F.when(F.col("pkey") % 3 == 0, F.concat_ws(" ", "trade", "name")).otherwise(F.col("name")))
    named = e.select(C.street_name(F.col("trade"), F.col("nom")).alias("street")).filter("street is not null")
    return named.groupBy("street").agg(F.count("*").alias("n"))


@query(
    "valid_coords",
    f"""WITH {EST}, x AS (SELECT muni, CASE WHEN okey % 11 = 0 THEN 'n/d' WHEN okey % 13 = 0 THEN '' WHEN okey % 17 = 0 THEN '95.5' ELSE lat::VARCHAR END AS la, lng FROM est)
    SELECT muni, count(*) AS n, round(sum(try_cast(la AS DOUBLE)), 4) AS lat_sum FROM x
    WHERE try_cast(la AS DOUBLE) BETWEEN 14 AND 33 AND lng BETWEEN -119 AND -86 GROUP BY 1""",
)
def valid_coords(t: Tables):
    la = (
        F.when(F.col("okey") % 11 == 0, "n/d").when(F.col("okey") % 13 == 0, "").when(F.col("okey") % 17 == 0, "95.5").otherwise(F.col("lat").cast("string"))
    )
    e = establishments(t).select("muni", la.alias("lat"), F.col("lng").cast("string").alias("lng"))
    ok = C.valid_coordinates(e, box=C.NATIONAL_BOX)
    return ok.groupBy("muni").agg(F.count("*").alias("n"), r(F.sum("lat"), 4).alias("lat_sum"))


@query(
    "keyword_class",
    f"""WITH {EST} SELECT name,
    CASE WHEN contains(name, 'BOLT') OR contains(name, 'GEAR') THEN 'Hardware' WHEN contains(name, 'RING') THEN 'Jewels'
         WHEN contains(name, 'WIDGET') OR contains(name, 'GIZMO') THEN 'Gadgets' END AS first_class,
    array_to_string(list_filter([CASE WHEN contains(name, 'BOLT') OR contains(name, 'GEAR') THEN 'Hardware' END,
      CASE WHEN contains(name, 'RING') OR contains(name, 'GEAR') THEN 'Jewels' END,
      CASE WHEN contains(name, 'WIDGET') OR contains(name, 'GIZMO') THEN 'Gadgets' END], lambda z: z IS NOT NULL), ',') AS all_classes,
    count(*) AS n FROM est GROUP BY 1, 2, 3""",
)
def keyword_class(t: Tables):
    name = text.ascii_upper(F.col("name"))
    return establishments(t).groupBy(
        "name",
        text.first_category(name, TRADE_WORDS).alias("first_class"),
        F.array_join(text.all_categories(name, TRADE_WORDS), ",").alias("all_classes"),
    ).agg(F.count("*").alias("n"))


@query(
    "plausible_price",
    f"""WITH {LISTINGS}, m AS (SELECT *, m2_built AS m2 FROM listings)
    SELECT zone, count(*) FILTER (WHERE price / m2 > 3000 AND price / m2 < 220000 AND m2 >= 15) AS sample,
    count(*) FILTER (WHERE price / m2 > 3000 AND price / m2 < 200000) AS regression,
    count(*) FILTER (WHERE price / m2 > 5000 AND price / m2 < 150000) AS verdict,
    count(*) FILTER (WHERE price >= 1000) AS listed FROM m GROUP BY 1""",
)
def plausible_price(t: Tables):
    cols = [
        F.count(F.when(C.plausible_price(F.col("price"), F.col("m2_built"), use), 1)).alias(use) for use in ("sample", "regression", "verdict")
    ]
    return listings(t).groupBy("zone").agg(*cols, F.count(F.when(F.col("price") >= 1000, 1)).alias("listed"))


def _paths(t: Tables):
    k = F.col("s_suppkey")
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(11)),
        lambda i: F.struct(
            (F.lit(-99.0) + F.floor(i / 2) * (k % 3).cast("double") * F.lit(0.00125) + F.lit(0.0000001)).alias("lng"),
            (F.lit(19.0) + F.floor(i / 3) * (k % 2).cast("double") * F.lit(0.00175) + F.lit(0.0000001)).alias("lat"),
        ),
    )
    return t.supplier.select(k.alias("street"), steps.alias("path"))


@query(
    "ring_clean",
    """WITH p AS (SELECT s_suppkey AS street, i, round_even(-99.0e0 + (i // 2) * (s_suppkey % 3) * 0.00125e0 + 0.0000001e0, 5) AS lng,
      round_even(19.0e0 + (i // 3) * (s_suppkey % 2) * 0.00175e0 + 0.0000001e0, 5) AS lat FROM supplier, range(12) g(i)),
    q AS (SELECT *, lag(lng) OVER w AS pl, lag(lat) OVER w AS pa FROM p WINDOW w AS (PARTITION BY street ORDER BY i)),
    k AS (SELECT * FROM q WHERE i = 0 OR lng <> pl OR lat <> pa)
    SELECT street, count(*) AS vertices, min(lng) AS x0, max(lng) AS x1, min(lat) AS y0, max(lat) AS y1 FROM k GROUP BY 1 HAVING count(*) >= 2""",
)
def ring_clean(t: Tables):
    slim = C.clean_paths(_paths(t), "path", 5, 2)
    box = geo.bbox(F.array("path"))
    return slim.select("street", F.size("path").cast("bigint").alias("vertices"), box["x0"].alias("x0"), box["x1"].alias("x1"), box["y0"].alias("y0"), box["y1"].alias("y1"))


@query("pii_whitelist", f"WITH {LISTINGS} SELECT id, price AS precio, operation AS operacion, zone AS municipio, lat, lng FROM listings")
def pii_whitelist(t: Tables):
    raw = listings(t).select(
        "id", F.col("price").alias("precio"), F.col("operation").alias("operacion"), F.col("zone").alias("municipio"), "lat", "lng", "contact",
        F.lit("x@example.org").alias("email"),
    )
    public = C.public_fields(raw)
    return public.select("id", "precio", "operacion", "municipio", "lat", "lng")


@query(
    "lead_clean",
    """WITH d AS (SELECT c_custkey, substr(c_name, 1, CASE WHEN c_custkey % 9 = 0 THEN 2 ELSE 40 END) AS nombre,
      CASE WHEN c_custkey % 5 = 0 THEN 'sin' ELSE '55 ' || lpad(c_custkey::VARCHAR, 8, '0') END AS telefono,
      CASE WHEN c_custkey % 7 = 0 THEN 'http://spam' ELSE '' END AS website FROM customer)
    SELECT nombre, telefono, CASE WHEN website <> '' THEN 'honeypot'
      WHEN NOT regexp_full_match(regexp_replace(telefono, '[^0-9]', '', 'g'), '[0-9]{10}') THEN 'phone'
      WHEN length(trim(nombre)) < 3 THEN 'name' END AS rejected FROM d""",
)
def lead_clean(t: Tables):
    k = F.col("c_custkey")
    leads = t.customer.select(
        F.substring("c_name", F.lit(1), F.when(k % 9 == 0, 2).otherwise(40)).alias("nombre"),
        F.when(k % 5 == 0, "sin").otherwise(F.concat(F.lit("55 "), F.lpad(k.cast("string"), 8, "0"))).alias("telefono"),
        F.when(k % 7 == 0, "http://spam").otherwise("").alias("website"),
        F.lit("secret").alias("password"),
    )
    return C.clean_leads(leads).select("nombre", "telefono", "rejected")


@query(
    "geo_sanity",
    f"""WITH {LISTINGS}, {MUNI},
    l AS (SELECT *, (zone_no * 7 + id) % 25 AS place FROM listings),
    x AS (SELECT l.id, l.zone_no, p.lat AS la, p.lng AS ln, c.lat AS cla, c.lng AS cln FROM l JOIN muni p ON p.cell_id = l.place JOIN muni c ON c.cell_id = l.zone_no),
    d AS (SELECT *, 12742.0e0 * asin(sqrt(pow(sin(radians(cla - la) / 2), 2) + cos(radians(la)) * cos(radians(cla)) * pow(sin(radians(cln - ln) / 2), 2))) > 300 AS broken FROM x)
    SELECT zone_no, count(*) FILTER (WHERE broken) AS nulled, round(sum(CASE WHEN NOT broken THEN la END), 3) AS lat_left FROM d GROUP BY 1""",
)
def geo_sanity(t: Tables):
    m = municipalities(t)
    spots = m.select(F.col("cell_id").alias("place"), "lat", "lng")
    placed = listings(t).select("zone_no", ((F.col("zone_no") * 7 + F.col("id")) % 25).alias("place")).join(spots, "place")
    cities = m.select(F.col("cell_id").alias("zone_no"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    out = C.geo_sanity(placed, cities, "zone_no")
    return out.groupBy("zone_no").agg(F.sum(F.col("geo_broken").cast("bigint")).alias("nulled"), r(F.sum("lat"), 3).alias("lat_left"))


@query("price_m2", f"WITH {LISTINGS}, {PRICED} SELECT id, pm2, pm2_mxn, land_pm2_mxn, is_land FROM priced")
def price_m2(t: Tables):
    p = C.with_unit_price(listings(t))
    return p.select("id", "pm2", "pm2_mxn", "land_pm2_mxn", "is_land")


@query(
    "listing_search",
    f"""WITH {LISTINGS}, y AS (SELECT *, (zone_no % 9)::DOUBLE AS zone_yield FROM listings)
    SELECT id, price, zone FROM y WHERE operation = 'venta' AND contains(kind, 'casa') AND rooms >= 3 AND baths >= 2
    AND price <= 300000 AND price >= 20000 AND m2_built >= 60 AND zone_yield >= 4""",
)
def listing_search(t: Tables):
    y = listings(t).withColumn("zone_yield", (F.col("zone_no") % 9).cast("double"))
    cond = M.search_filter(
        operation="venta", kind="Casa", rooms_min=3, baths_min=2, budget_max=300000, budget_min=20000, m2_min=60, yield_min=4
    )
    return y.filter(cond).select("id", "price", "zone")


_BRANCH_LINE = """CASE WHEN c_custkey % 10 = 0 THEN 'lat,lng,name' WHEN c_custkey % 10 = 1 THEN '' WHEN c_custkey % 10 = 2 THEN 'abc,def'
  WHEN c_custkey % 10 = 3 THEN '95.0,-99.1,Far' WHEN c_custkey % 10 = 4 THEN (19 + c_custkey % 100)::VARCHAR || ',-99'
  WHEN c_custkey % 10 = 5 THEN '19.4' ELSE ' 19.' || (c_custkey % 100)::VARCHAR || ' , -99.' || (c_custkey % 77)::VARCHAR || ', ' || c_name END"""


@query(
    "branch_parse",
    f"""WITH l AS (SELECT c_custkey AS line_no, trim({_BRANCH_LINE}) AS li FROM customer),
    a AS (SELECT line_no, list_transform(string_split(li, ','), lambda x: trim(x)) AS p FROM l WHERE li <> '' AND NOT starts_with(lower(li), 'lat')),
    b AS (SELECT line_no, try_cast(p[1] AS DOUBLE) AS lat, try_cast(p[2] AS DOUBLE) AS lng, p[3] AS nm, len(p) AS k FROM a),
    c AS (SELECT *, coalesce(k >= 2 AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180, false) AS ok FROM b),
    d AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY line_no) AS pos FROM c)
    SELECT line_no, ok, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lng END AS lng,
    CASE WHEN ok THEN coalesce(CASE WHEN nm <> '' AND lower(nm) <> 'nan' THEN nm END, 'Branch ' || pos::VARCHAR) END AS name FROM d""",
)
def branch_parse(t: Tables):
    k = F.col("c_custkey")
    m = k % 10
    line = (
        F.when(m == 0, "lat,lng,name")
        .when(m == 1, "")
        .when(m == 2, "abc,def")
        .when(m == 3, "95.0,-99.1,Far")
        .when(m == 4, F.concat((19 + k % 100).cast("string"), F.lit(",-99")))
        .when(m == 5, "19.4")
        .otherwise(F.concat(F.lit(" 19."), (k % 100).cast("string"), F.lit(" , -99."), (k % 77).cast("string"), F.lit(", "), F.col("c_name")))
    )
    return C.parse_branches(t.customer.select(k.alias("line_no"), line.alias("value"))).select("line_no", "ok", "lat", "lng", "name")


@query(
    "amount_parse",
    """WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'N/D' WHEN o_orderkey % 8 = 0 THEN ''
      ELSE ' $' || format('{:t,.2f}', o_totalprice) || ' ' END AS txt FROM orders)
    SELECT id, try_cast(regexp_replace(trim(txt), '[$, ]', '', 'g') AS DOUBLE) AS amount FROM a""",
)
def amount_parse(t: Tables):
    k = F.col("o_orderkey")
    txt = F.when(k % 9 == 0, "N/D").when(k % 8 == 0, "").otherwise(F.concat(F.lit(" $"), F.format_number("o_totalprice", 2), F.lit(" ")))
    return t.orders.select(k.alias("id"), text.amount(txt).alias("amount"))


@query(
    "year_extract",
    """WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'sin fecha 1803' ELSE 'inicio: ' || strftime(o_orderdate, '%d/%m/%Y') END AS txt,
      strftime(o_orderdate, '%Y-%m') AS cut FROM orders)
    SELECT try_cast(nullif(regexp_extract(txt, '(?:19|20)[0-9]{2}'), '') AS INT) AS text_year, try_cast(substr(cut, 1, 4) AS INT) AS lead_year, count(*) AS n FROM a GROUP BY 1, 2""",
)
def year_extract(t: Tables):
    k = F.col("o_orderkey")
    txt = F.when(k % 6 == 0, "sin fecha 1803").otherwise(F.concat(F.lit("inicio: "), F.date_format("o_orderdate", "dd/MM/yyyy")))
    return t.orders.groupBy(
        text.year_in(txt).alias("text_year"), text.leading_year(F.date_format("o_orderdate", "yyyy-MM")).alias("lead_year")
    ).agg(F.count("*").alias("n"))


@query(
    "slug",
    """SELECT doc_id, md5(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug_md5 FROM documents""",
)
def slug(t: Tables):
    return t.documents.select("doc_id", F.md5(text.slug(F.col("text"))).alias("slug_md5"))


@query(
    "normalize_name",
    """WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(upper(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'))), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents)
    SELECT doc_id, md5(array_to_string(list_transform(ws, lambda x: CASE x WHEN 'GRAL' THEN 'GENERAL' WHEN 'PTE' THEN 'PRESIDENTE' WHEN 'DR' THEN 'DOCTOR' WHEN 'STA' THEN 'SANTA' ELSE x END), ' ')) AS name_md5 FROM w""",
)
def normalize_name(t: Tables):
    return t.documents.select("doc_id", F.md5(text.normalized_name(F.col("text"))).alias("name_md5"))


@query(
    "coverage_gate",
    """WITH c AS (SELECT o_orderpriority LIKE '%URGENT' OR o_orderpriority LIKE '%HIGH' AS obra, o_orderkey % 10 < 7 AS known FROM orders)
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE obra) AS eligible, count(*) FILTER (WHERE obra AND NOT known) AS unidentified,
    round(count(*) FILTER (WHERE obra AND known) / count(*) FILTER (WHERE obra), 6) AS coverage,
    count(*) FILTER (WHERE obra AND known) / count(*) FILTER (WHERE obra) >= 0.6 AS passed FROM c""",
)
def coverage_gate(t: Tables):
    p = F.col("o_orderpriority")
    works = p.endswith("URGENT") | p.endswith("HIGH")
    out = C.coverage_gate(t.orders, works, F.col("o_orderkey") % 10 < 7)
    return out.select(F.col("rows").alias("n_rows"), "eligible", "unidentified", r("coverage").alias("coverage"), "passed")


@query(
    "zone_lookup",
    """SELECT n_name AS zone, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE lower(n_name) = 'nation_7' GROUP BY 1""",
)
def zone_lookup(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return C.zone_lookup(j.groupBy(F.col("n_name").alias("zone")).agg(F.count("*").alias("total")), "zone", " Nation_7 ", "total")


@query(
    "zone_ranking",
    "SELECT n_name AS zone, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def zone_ranking(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return C.zone_lookup(j.groupBy(F.col("n_name").alias("zone")).agg(F.count("*").alias("total")), "zone", None, "total")


_LABELS = ", ".join("'" + x + "'" for x in DROUGHT_LABELS)


@query(
    "drought_lookup",
    f"""WITH {STREETS}, mon AS (SELECT CASE WHEN s_acctbal < 2000 THEN 'otro ' ELSE '' END || lower(s_name) AS mun, 'nation_' || s_nationkey::VARCHAR AS ent, s_suppkey % 6 AS level FROM supplier)
    SELECT street, m.level, ([{_LABELS}])[m.level + 1] AS drought FROM streets LEFT JOIN mon m ON m.mun = lower(street_name) AND m.ent = 'nation_' || muni::VARCHAR""",
)
def drought_lookup(t: Tables):
    s = F.col("s_suppkey")
    monitor = t.supplier.select(
        F.concat(F.when(F.col("s_acctbal") < 2000, "otro ").otherwise(""), F.lower("s_name")).alias("mun"), F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("ent"), (s % 6).cast("int").alias("level")
    )
    towns = streets(t).select("street", F.concat(F.lit(" "), F.upper("street_name")).alias("town"), F.concat(F.lit("NÁTION_"), F.col("muni").cast("string")).alias("state"))
    return C.drought_lookup(towns, monitor, "town", "state").select("street", F.col("level").cast("bigint").alias("level"), "drought")


@query(
    "competitor_text",
    f"""WITH {EST}, d AS (SELECT CASE WHEN okey % 9 = 0 THEN NULL ELSE (okey % 4000) // 100 * 100.0e0 + 7 END AS m FROM est)
    SELECT CASE WHEN m IS NULL THEN 'no competitor of this kind in the city' WHEN m >= 1000 THEN 'nearest competitor at ' || printf('%.1f', m / 1000) || ' km'
    ELSE 'nearest competitor at ' || format('{{:t,}}', m::BIGINT) || ' m' END AS reading, count(*) AS n FROM d GROUP BY 1""",
)
def competitor_text(t: Tables):
    m = F.when(F.col("okey") % 9 != 0, F.expr("okey % 4000 div 100") * 100.0 + 7)
    e = establishments(t).select(m.alias("m"))
    return e.groupBy(text.distance_text(F.col("m")).alias("reading")).agg(F.count("*").alias("n"))


@query(
    "tag_entity",
    """WITH d AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'México, Nation ' || c_nationkey::VARCHAR || ', Centro' WHEN 1 THEN 'Nation ' || c_nationkey::VARCHAR || ', México'
      WHEN 2 THEN 'Repotenciación de la línea' ELSE 'Centro, MEXICO' END AS txt, c_nationkey AS n, c_custkey % 4 AS k FROM customer)
    SELECT CASE WHEN k IN (0, 1) AND n < 10 THEN 'state ' || n::VARCHAR WHEN k IN (1, 3) THEN 'mexico' END AS entity, count(*) AS n FROM d GROUP BY 1""",
)
def tag_entity(t: Tables):
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    txt = (
        F.when(k == 0, F.concat(F.lit("México, Nation "), n, F.lit(", Centro")))
        .when(k == 1, F.concat(F.lit("Nation "), n, F.lit(", México")))
        .when(k == 2, "Repotenciación de la línea")
        .otherwise("Centro, MEXICO")
    )
    states = {f"nation {i}": f"state {i}" for i in range(10)} | {"mexico": "mexico"}
    return t.customer.groupBy(C.tag_entity(txt, states).alias("entity")).agg(F.count("*").alias("n"))


@query(
    "scalar_numbers",
    f"""WITH {LISTINGS} SELECT id, round(ln(1 + price), 6) AS log1p, floor(price / 7 + 0.5)::BIGINT AS js_round,
    round_even(price / 16, 0) AS np_round, least(greatest(price, 50000), 200000) AS clipped,
    CASE WHEN m2_land > 0 THEN price / m2_land END AS ratio,
    strftime(DATE '1899-12-30' + (34000 + id % 5000)::INT, '%Y-%m-%d') AS serial_date,
    greatest(date_diff('day', day, DATE '2000-01-01'), 0)::INT AS days FROM listings""",
)
def scalar_numbers(t: Tables):
    p = F.col("price")
    return listings(t).select(
        "id",
        r(F.log1p(p)).alias("log1p"),
        numeric.half_up(p / 7).alias("js_round"),
        numeric.half_even(p / 16).alias("np_round"),
        numeric.clip(p, 50000, 200000).alias("clipped"),
        numeric.safe_ratio(p, F.col("m2_land")).alias("ratio"),
        F.date_format(numeric.excel_date((34000 + F.col("id") % 5000).cast("string")), "yyyy-MM-dd").alias("serial_date"),
        numeric.days_between(F.to_date(F.lit("2000-01-01")), F.col("day")).alias("days"),
    )


@query(
    "scalar_distances",
    f"""WITH {LISTINGS} SELECT id, round(12742.0e0 * asin(sqrt(pow(sin(radians(19.5e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(19.5e0)) * pow(sin(radians(-99.15e0 - lng) / 2), 2))), 6) AS km,
    round(sqrt(pow(lng + 99.15e0, 2) + pow(lat - 19.5e0, 2)), 8) AS degrees,
    round(sqrt(pow((lng + 99.15e0) * 111 * cos(radians(19.5e0)), 2) + pow((lat - 19.5e0) * 111, 2)), 6) AS planar_km,
    round(exp(-(pow(lng + 99.15e0, 2) + pow(lat - 19.5e0, 2)) / (2 * 0.011e0 * 0.011e0)), 8) AS kernel FROM listings""",
)
def scalar_distances(t: Tables):
    x, y = F.col("lng"), F.col("lat")
    x0, y0 = F.lit(-99.15), F.lit(19.5)
    return listings(t).select(
        "id",
        r(geo.haversine_km(y, x, y0, x0)).alias("km"),
        r(geo.planar_deg(x, y, x0, y0), 8).alias("degrees"),
        r(geo.planar_km(x, y, x0, y0)).alias("planar_km"),
        r(geo.gaussian(geo.planar_sq(x, y, x0, y0), 0.011), 8).alias("kernel"),
    )


@query(
    "scalar_text",
    f"""WITH {LISTINGS} SELECT id, '$' || format('{{:t,}}', floor(price)::BIGINT) AS money, printf('%+.1f%%', (floor(price) % 200 - 100) / 2) AS pct, upper(kind[1]) || lower(kind[2:]) AS kind,
    strftime(day, '%Y-%m') AS month, string_split(month, '-')[2] AS mm FROM listings""",
)
def scalar_text(t: Tables):
    whole = F.floor("price").cast("double")
    return listings(t).select(
        "id",
        text.money(whole).alias("money"),
        text.percent((whole % 200 - 100) / 2).alias("pct"),
        text.title_case(F.col("kind")).alias("kind"),
        F.date_format("day", "yyyy-MM").alias("month"),
        F.split("month", "-")[1].alias("mm"),
    )
