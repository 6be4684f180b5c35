"""Queries for sources, sinks and account tables. Files are derived from the tables and written below the shared folder."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from terrametra.functions import geo, text
from terrametra.operators.cleaning import employment_of, in_nation, sector_of
from terrametra.operators.matching import canonical_name, coverage_plan
from terrametra.plans.bindings import EST, EVENTS, LISTINGS, STREETS, Tables, establishments, events, listings, streets
from terrametra.plans.registry import query, r
from terrametra.sources import accounts as A
from terrametra.sources import files as S
from terrametra.sources import html as H
from terrametra.sources import postal as Z
from terrametra.session import durable, work_path


def _registry_text(t: Tables):
    return establishments(t).select(
        F.col("state").cast("string").alias("cve_ent"),
        F.col("muni").cast("string").alias("CVE_MUN"),
        F.col("code").alias("codigo_act"),
        F.col("band").alias("per_ocu"),
        F.col("added_on").alias("fecha_alta"),
        F.concat(F.lit("Café "), F.col("name")).alias("nom_estab"),
        F.col("lat").cast("string").alias("latitud"),
        F.col("lng").cast("string").alias("longitud"),
        F.lit("unused").alias("extra"),
    )


_BY_AREA = """SELECT state::VARCHAR AS state_code, muni::VARCHAR AS town_code, sector, count(*) AS n, sum(staff)::BIGINT AS staff, round(sum(lat), 4) AS lat, count(*) FILTER (WHERE contains(name, 'BOLT')) AS bolts FROM est GROUP BY 1, 2, 3"""


def _by_area(reg):
    return reg.groupBy("state_code", "town_code", sector_of(F.col("activity_code")).alias("sector")).agg(
        F.count("*").alias("n"),
        F.sum(employment_of(F.col("band"))).alias("staff"),
        r(F.sum(F.col("lat").cast("double")), 4).alias("lat"),
        F.sum((F.col("name").startswith("Café ") & F.col("name").contains("BOLT")).cast("bigint")).alias("bolts"),
    )


@query("registry_scan", f"WITH {EST} {_BY_AREA}")
def registry_scan(t: Tables):
    path = work_path(t.spark, "registry")
    _registry_text(t).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    reg = S.scan_registry(t.spark, path, fields=["state_code", "town_code", "activity_code", "band", "name", "lat"], required=["band"])
    return _by_area(reg)


def _zip_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One archive per Arrow batch: the registry member and a smaller member that must not be read."""
    for b in batches:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("conjunto/datos.csv", b.to_csv(index=False).encode("latin-1"))
            z.writestr("diccionario.csv", "a,b\n1,2\n")
        yield pd.DataFrame({"path": [f"part-{b['cve_ent'].iloc[0]}.zip" if len(b) else "none.zip"], "content": [buf.getvalue()]})


@query("archive_scan", f"WITH {EST} {_BY_AREA}")
def archive_scan(t: Tables):
    archives = _registry_text(t).mapInPandas(_zip_batches, "path string, content binary")
    rows = S.unpack_archives(archives, ["cve_ent", "cve_mun", "codigo_act", "per_ocu", "nom_estab", "latitud"])
    return _by_area(S.bind_headers(rows, {k: S.REGISTRY_ALIASES[k] for k in ("state_code", "town_code", "activity_code", "band", "name", "lat")}))


@query(
    "multi_part_union",
    """WITH a AS (SELECT l_suppkey AS key, l_returnflag AS part, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT key, arg_min(n, part) AS n FROM a WHERE key NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) GROUP BY 1""",
)
def multi_part_union(t: Tables):
    by = t.lineitem.groupBy(F.col("l_suppkey").alias("key"), "l_returnflag").agg(F.count("*").alias("n"))
    parts = [by.filter(F.col("l_returnflag") == f).select("key", "n") for f in ("A", "N", "R")]
    done = t.supplier.filter("s_nationkey = 3").select(F.col("s_suppkey").alias("key"))
    return S.union_parts(parts, "key", done).select("key", "n")


@query("gz_csv_io", f"WITH {EST} SELECT sector, year::INT AS year, count(*) AS n, round(sum(price), 2) AS price FROM est GROUP BY 1, 2")
def gz_csv_io(t: Tables):
    path = work_path(t.spark, "gz")
    S.write_gz_csv(establishments(t).select("name", "sector", "street", "price", "year"), path)
    back = S.read_gz_csv(t.spark, path, "name string, sector string, street bigint, price double, year int")
    return back.groupBy("sector", "year").agg(F.count("*").alias("n"), r(F.sum("price"), 2).alias("price"))


def _street_docs(t: Tables):
    """Street documents: suppliers of a nation in chunks of fifty."""
    s = streets(t).withColumn("doc", F.expr("street div 50"))
    path = F.array(F.array("lng", "lat"), F.array(F.col("lng") + 0.001, F.col("lat")), F.array(F.col("lng") + 0.001, F.col("lat")))
    return s.select("muni", "doc", F.struct(F.col("street_name").alias("nombre"), path.alias("camino")).alias("c")).groupBy("muni", "doc").agg(
        F.collect_list("c").alias("calles")
    ).select(F.col("muni").cast("string").alias("municipio"), F.lit("Estado").alias("estado"), "calles")


@query("nested_json_scan", f"WITH {STREETS} SELECT muni::VARCHAR AS town, street_name AS street, 2 AS vertices, round(lng, 4) AS lng FROM streets")
def nested_json_scan(t: Tables):
    path = work_path(t.spark, "streets")
    _street_docs(t).write.json(path)
    rows = S.scan_streets(t.spark, path)
    slim = rows.withColumn("path", geo.drop_repeats(F.col("path"), 5)).filter(F.size("path") >= 2)
    return slim.select("town", "street", F.size("path").alias("vertices"), r(F.col("path")[0]["lng"], 4).alias("lng"))


@query(
    "geojson_scan",
    f"""WITH {STREETS} SELECT '0' || (street % 10)::VARCHAR || lpad((street % 1000)::VARCHAR, 3, '0') AS cell_id, street_name AS name, count(*) OVER () AS total,
    round(lng, 5) AS lng, round(lat, 4) AS lat, round(lng - 0.002, 5) AS x0 FROM streets""",
)
def geojson_scan(t: Tables):
    path = work_path(t.spark, "geojson")
    h = 0.002
    corner = lambda dx, dy: F.array(F.col("lng") + dx, F.col("lat") + dy)
    ring = F.array(corner(-h, -h), corner(h, -h), corner(h, h), corner(-h, h), corner(-h, -h))
    s = streets(t)
    single = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    multi = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates"))
    geometry = F.when(F.col("street") % 2 == 0, F.to_json(single)).otherwise(F.to_json(multi))
    props = F.concat(F.lit('{"state_code":"'), (F.col("street") % 10).cast("string"), F.lit('","mun_code":"'), (F.col("street") % 1000).cast("string"), F.lit('","mun_name":"'), F.col("street_name"), F.lit('"}'))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), geometry, F.lit("}"))
    docs = s.select(F.expr("street div 50").alias("doc"), feature.alias("f")).groupBy("doc").agg(F.array_join(F.collect_list("f"), ",").alias("fs"))
    docs.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("fs"), F.lit("]}")).alias("value")).write.text(path)
    cells = S.geo_cells(S.scan_geojson(t.spark, path))
    total = cells.agg(F.count("*")).scalar()
    return cells.withColumn("total", total).select("cell_id", "name", "total", r("lng", 5).alias("lng"), r("lat", 4).alias("lat"), r(F.col("box")["x0"], 5).alias("x0"))


@query(
    "ndjson_append",
    f"""WITH {LISTINGS} SELECT count(*) AS total, count(*) FILTER (WHERE operation = 'venta') AS sales, count(*) FILTER (WHERE operation = 'renta') AS rents,
    count(*) FILTER (WHERE operation NOT IN ('venta', 'renta')) AS others, floor(count(*) FILTER (WHERE id % 4 <> 0) * 100.0e0 / count(*) + 0.5)::BIGINT AS geo_pct FROM listings""",
)
def ndjson_append(t: Tables):
    path = work_path(t.spark, "ndjson")
    li = listings(t).select("id", F.lit(None).cast("string").alias("url"), F.col("kind").alias("title"), "price", F.col("zone").alias("location"), "operation", F.when(F.col("id") % 4 != 0, F.col("lat")).alias("lat"))
    keyed = li.withColumn("key", S.listing_key()).withColumn("seq", F.col("id"))
    S.append_ndjson(t.spark, keyed.filter("operation = 'venta'"), path)
    store = t.spark.read.schema(keyed.schema).json(path)
    # the second run offers every listing twice; only unseen keys are appended
    S.append_ndjson(t.spark, S.append_unseen(store, keyed.unionByName(keyed)).select(*keyed.columns), path)
    return S.listing_stats(t.spark.read.schema(keyed.schema).json(path))


@query(
    "dataset_discovery",
    """SELECT 'town_' || c_custkey::VARCHAR AS suffix, CASE WHEN c_custkey % 3 = 0 THEN 'Town ' || c_custkey::VARCHAR ELSE c_name END AS town,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'E' || c_nationkey::VARCHAR END AS state FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def dataset_discovery(t: Tables):
    k = F.col("c_custkey").cast("string")
    a = t.customer.select(F.concat(F.lit("data/streets_town_"), k, F.lit(".json")).alias("path"))
    b = t.orders.filter("o_orderstatus = 'F'").select(F.concat(F.lit("data/businesses_town_"), F.col("o_custkey").cast("string"), F.lit(".csv.gz")).alias("path"))
    docs = t.customer.filter("c_custkey % 3 <> 0").select(F.concat(F.lit("town_"), k).alias("suffix"), F.col("c_name").alias("town"), F.concat(F.lit("E"), F.col("c_nationkey").cast("string")).alias("state"))
    return S.discover_datasets(a.unionByName(b), r"^streets_(.+)\.json$", r"^businesses_(.+)\.csv\.gz$", docs)


@query(
    "header_detect",
    """SELECT 'Nation ' || c_nationkey::VARCHAR AS entity, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 9 <> 0) AS with_amount, round(sum(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END), 2) AS amount
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1""",
)
def header_detect(t: Tables):
    path = work_path(t.spark, "contracts")
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    j.select(
        F.when(F.col("o_orderstatus") == "P", "Adquisiciones").otherwise("Obra Pública").alias("Tipo de Contratación"),
        F.lit("N/A").alias("Importe clave"),
        F.when(k % 9 == 0, "s/d").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("Importe DRC"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("Entidad Federativa"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Fecha de inicio"),
        F.lit("Título").alias("Título del contrato"),
        F.lit("mxn").alias("Moneda"),
    ).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    c = S.scan_contracts(t.spark, path)
    works = c.filter(text.fold_lower(F.col("kind")).contains("obra"))
    amt = text.amount(F.col("amount"))
    return works.groupBy("entity").agg(F.count("*").alias("n"), F.count(amt).alias("with_amount"), r(F.sum(amt), 2).alias("amount"))


@query(
    "history_upsert",
    """WITH a AS (SELECT c_nationkey::BIGINT AS zone, o_orderpriority AS portal, strftime(o_orderdate, '%Y-%m') AS day, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS run, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)
    SELECT zone, portal, day, max(run)::INT AS run, arg_max(n, run) AS n FROM a GROUP BY 1, 2, 3""",
)
def history_upsert(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    keys = ["zone", "portal", "day"]
    base = j.select(F.col("c_nationkey").cast("bigint").alias("zone"), F.col("o_orderpriority").alias("portal"), F.date_format("o_orderdate", "yyyy-MM").alias("day"), "o_orderstatus")
    old = base.filter("o_orderstatus = 'F'").groupBy(*keys).agg(F.count("*").alias("n")).withColumn("run", F.lit(1))
    new = base.filter("o_orderstatus <> 'F'").groupBy(*keys).agg(F.count("*").alias("n")).withColumn("run", F.lit(2))
    return S.upsert_history(old, new, keys).select(*keys, "run", "n")


@query("zone_shards", f"WITH {LISTINGS} SELECT 'zona-' || zone_no::VARCHAR AS zone_slug, count(*) AS n, strftime(max(day), '%Y-%m-%d') AS updated FROM listings GROUP BY 1")
def zone_shards(t: Tables):
    path = work_path(t.spark, "shards")
    S.write_shards(listings(t).withColumn("updated", F.date_format("day", "yyyy-MM-dd")), path)
    return S.shard_index(t.spark, path, "updated")


@query(
    "json_export",
    f"WITH {EST} SELECT street, '{{\"key\":' || street::VARCHAR || ',\"value\":{{\"n\":' || count(*)::VARCHAR || ',\"staff\":' || sum(staff)::VARCHAR || '}}}}' AS doc FROM est GROUP BY street",
)
def json_export(t: Tables):
    path = work_path(t.spark, "export")
    a = establishments(t).groupBy("street").agg(F.count("*").alias("n"), F.sum("staff").alias("staff"))
    S.export_json(a, path, "street")
    return t.spark.read.text(path).select(F.get_json_object("value", "$.key").cast("bigint").alias("street"), F.col("value").alias("doc"))


_POINTS = """pt AS (SELECT lpad((c_custkey % 100000)::VARCHAR, 5, '0') AS cp, 14.0e0 + (c_custkey * 7919 % 19000) * 0.001e0 AS lat, -118.0e0 + (c_custkey * 15485863 % 32000) * 0.001e0 AS lng, c_custkey % 2 AS precision FROM customer)"""
_RECORD = "cp || lpad(round_even(lat * 1000, 0)::BIGINT::VARCHAR, 5, '0') || lpad(round_even(abs(lng) * 1000, 0)::BIGINT::VARCHAR, 6, '0') || precision::VARCHAR"


def _postal_points(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(
        F.lpad((k % 100000).cast("string"), 5, "0").alias("cp"),
        (F.lit(14.0) + (k * 7919 % 19000) * F.lit(0.001)).alias("lat"),
        (F.lit(-118.0) + (k * 15485863 % 32000) * F.lit(0.001)).alias("lng"),
        (k % 2).alias("precision"),
    )


@query("fixed_width_index", f"WITH {_POINTS} SELECT cp, {_RECORD} AS record, round(round_even(lat * 1000, 0) / 1000, 3) AS lat, round(-round_even(abs(lng) * 1000, 0) / 1000, 3) AS lng, precision::INT AS precision FROM pt")
def fixed_width_index(t: Tables):
    path = work_path(t.spark, "postal")
    Z.write_index(Z.encode(_postal_points(t)), path)
    d = Z.decode(Z.read_index(t.spark, path))
    return d.select("cp", "record", r("lat", 3).alias("lat"), r("lng", 3).alias("lng"), "precision")


@query(
    "fixed_width_verify",
    f"WITH {_POINTS} SELECT count(*) AS records, 0::BIGINT AS bad_length, 0::BIGINT AS bad_digits, 0::BIGINT AS out_of_box, 0::BIGINT AS bad_precision, count(*) FILTER (WHERE precision = 0) AS exact_points, 0::BIGINT AS out_of_order FROM pt",
)
def fixed_width_verify(t: Tables):
    path = work_path(t.spark, "postal")
    Z.write_index(Z.encode(_postal_points(t)), path)
    return Z.verify(Z.read_index(t.spark, path))


@query("national_box", f"WITH {_POINTS} SELECT lat BETWEEN 14 AND 33 AND lng BETWEEN -119 AND -86 AS inside, count(*) AS n FROM pt GROUP BY 1")
def national_box(t: Tables):
    return _postal_points(t).groupBy(in_nation(F.col("lat"), F.col("lng")).alias("inside")).agg(F.count("*").alias("n"))


@query(
    "account_tables",
    f"WITH {EVENTS} SELECT user_id, zone, count(*) AS alerts, max(event_id) AS last_id FROM ev WHERE event <> 'error' GROUP BY 1, 2",
)
def account_tables(t: Tables):
    """Alerts stored as a table; the active-only read is pushed down to the files."""
    path = work_path(t.spark, "alerts")
    raw = events(t).select(
        F.col("event_id").alias("id"), "user_id", "zone", F.lit(None).cast("int").alias("horizon"), F.lit(None).cast("double").alias("threshold"),
        (F.col("event") != "error").alias("active"), F.lit(None).cast("double").alias("last_value"),
    )
    A.with_defaults(raw).write.parquet(path)
    a = A.active_alerts(t.spark.read.parquet(path))
    return a.groupBy("user_id", "zone").agg(F.count("*").alias("alerts"), F.max("id").alias("last_id"))


@query("own_rows", f"WITH {EVENTS} SELECT event_id, zone FROM ev WHERE user_id = 8")
def own_rows(t: Tables):
    return A.own_rows(events(t), 8).select("event_id", "zone")


@query("favorite_zones", f"WITH {EVENTS} SELECT user_id, zone, arg_min(event_id, (ts, event_id)) AS event_id FROM ev GROUP BY 1, 2")
def favorite_zones(t: Tables):
    return A.unique_zone(events(t).select("user_id", "zone", "ts", "event_id"), ["ts", "event_id"]).select("user_id", "zone", "event_id")


@query(
    "active_alerts",
    f"WITH {EVENTS} SELECT event_id AS id, coalesce(CASE WHEN k % 4 <> 0 THEN k % 10 END, 5)::INT AS horizon, coalesce(CASE WHEN k % 6 <> 0 THEN k::DOUBLE END, 5) AS threshold FROM ev WHERE coalesce(CASE WHEN k % 5 <> 0 THEN k % 3 <> 0 END, true)",
)
def active_alerts(t: Tables):
    k = F.col("k")
    raw = events(t).select(
        F.col("event_id").alias("id"), "user_id", "zone", F.when(k % 4 != 0, (k % 10).cast("int")).alias("horizon"), F.when(k % 6 != 0, k.cast("double")).alias("threshold"),
        F.when(k % 5 != 0, k % 3 != 0).alias("active"), F.lit(None).cast("double").alias("last_value"),
    )
    return A.active_alerts(A.with_defaults(raw)).select("id", "horizon", "threshold")


@query(
    "partition_coverage",
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'Solo' WHEN c_custkey % 5 = 0 THEN 'Marca ' || (c_custkey % 50)::VARCHAR || ' / Pueblo ' || c_custkey::VARCHAR || ', Nation ' || c_nationkey::VARCHAR
        ELSE 'Pueblo ' || (c_custkey % 900)::VARCHAR || ', Nation ' || c_nationkey::VARCHAR END AS name, c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    p AS (SELECT name, n, c_nationkey, trim(split_part(name, ',', 1)) AS town FROM n WHERE contains(name, ',') AND n >= 8 AND c_nationkey <> 4),
    s AS (SELECT *, list_transform(string_split(town, '/'), lambda x: replace(regexp_replace(lower(trim(x)), '[^a-z0-9]+', '-', 'g'), '-', '_')) AS sfx FROM p),
    o AS (SELECT * FROM s WHERE NOT list_has_any(sfx, (SELECT list('pueblo_' || s_suppkey::VARCHAR) FROM supplier))),
    b AS (SELECT *, row_number() OVER (PARTITION BY sfx[1] ORDER BY n DESC, name) AS i FROM o)
    SELECT sfx[1] AS suffix, name, n FROM b WHERE i = 1 ORDER BY n DESC, name LIMIT 60""",
)
def partition_coverage(t: Tables):
    k, kn = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    nat = F.concat(F.lit(", Nation "), kn)
    name = (
        F.when(k % 7 == 0, "Solo")
        .when(k % 5 == 0, F.concat(F.lit("Marca "), (k % 50).cast("string"), F.lit(" / Pueblo "), k.cast("string"), nat))
        .otherwise(F.concat(F.lit("Pueblo "), (k % 900).cast("string"), nat))
    )
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    reg = t.customer.join(counts, "c_custkey", "left").select(name.alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    done = t.supplier.select(F.concat(F.lit("pueblo_"), F.col("s_suppkey").cast("string")).alias("suffix"))
    code = canonical_name(text.fold_lower(F.col("state")), [f"nation {i}" for i in range(25) if i != 4])
    code = F.when(text.fold_lower(F.col("state")) != "nation 4", code)
    return coverage_plan(reg, done, 8, 60, code).select("suffix", "name", "n")


@query(
    "listing_export",
    f"WITH {LISTINGS} SELECT id, price, zone, kind || ', \"' || operation || '\"' AS title FROM listings",
)
def listing_export(t: Tables):
    path = work_path(t.spark, "csv")
    li = listings(t).select("id", "price", "zone", F.concat("kind", F.lit(', "'), "operation", F.lit('"')).alias("title"))
    S.write_listing_csv(li, path, ["id", "price", "zone", "title"])
    return t.spark.read.option("header", True).option("escape", '"').schema("id bigint, price double, zone string, title string").csv(path)


# HTML pages built from all listings: pages of twenty, one of four layouts.
def _pages(t: Tables):
    li = listings(t).withColumn("page_id", F.expr("id div 20"))
    p, k = F.col("price").cast("decimal(18,2)").cast("string"), F.col("id").cast("string")
    whole = lambda c: F.col(c).cast("int").cast("string")
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    if_any = lambda c, *x: F.coalesce(cat(*x), F.lit("")) if c is None else F.coalesce(F.when(F.col(c).isNotNull(), cat(*x)), F.lit(""))
    m, g, rooms, baths = whole("m2_built"), whole("m2_land"), F.col("rooms").cast("string"), F.col("baths").cast("string")
    url, image = cat("/inmueble-", k), cat("https://img.example/", k, ".jpg")
    state = cat('{"title":"T ', k, '","price":', p, if_any("m2_built", ',"construction":', m, ',"surface":', m), if_any("m2_land", ',"land_area":', g), ',"location":{"city":"', F.col("zone"), '"},"url":"', url, '","photos":[{"src":"', image, '"}],"parking":', baths, ',"bedrooms":', rooms, '}')
    ld = cat('{"@type":"House","name":"T ', k, '","url":"', url, '","image":["', image, '"],"offers":{"price":"', p, '","priceCurrency":"', F.col("currency"), '"}', if_any("m2_built", ',"floorSize":{"value":"', m, ' m"}'), ',"address":{"addressLocality":"', F.col("zone"), '"}}')
    res = cat('{"idPropiedadesDB":', k, ',"encabezado":"T ]', k, '","precio":"', p, '","moneda":"', F.col("currency"), '"', if_any("m2_built", ',"m2C":', m), if_any("m2_land", ',"m2T":', g), ',"estacionamientos":', baths, ',"municipio":"', F.col("zone"), '","estado":"E","pais":"P","fotos":{"propiedadThumbnail":["', image, '"]},"urlCorrectaPropiedad":"', url, '","tipoOperacion":"', F.col("operation"), '"}')
    pad = F.rpad(F.lit("<p>x</p>"), 160, ".")
    # a card without rooms on every third id, so that a card that reached into the next one would find them there
    of_rooms = F.when(F.col("id") % 3 != 0, cat("<i>", rooms, " Rec</i>")).otherwise("")
    win = cat('<div><a href="', url, '"><img src="', image, '"></a>Casa en venta <b>$', F.format_number("price", 2), " MXN</b>", if_any("m2_built", "<span>", m, " m² Construcción</span>"), if_any("m2_land", "<span>", g, " m² Terreno</span>"), of_rooms, "<i>", baths, " Estac</i><br>+ ", baths, "00 mantenimiento", pad, "</div>")
    one = F.when(F.col("page_id") % 4 == 0, state).when(F.col("page_id") % 4 == 1, ld).when(F.col("page_id") % 4 == 2, res).otherwise(win)
    rows = li.select("page_id", F.struct("id", one.alias("x")).alias("o"))
    # at most twenty listings per page
    body = rows.groupBy("page_id").agg(F.array_sort(F.collect_list("o")).alias("o")).withColumn("o", F.transform("o", lambda v: v["x"]))
    joined = F.array_join("o", ",")
    k4 = F.col("page_id") % 4
    html = (
        F.when(k4 == 0, cat('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"list":[', joined, "]}}}</script></html>"))
        .when(k4 == 1, cat("<html><script type='application/ld+json'>", '{"@context":"x","@graph":[', joined, "]}</script></html>"))
        .when(k4 == 2, cat('<html><script>window.REP_LOG_APP_PROPS = {"totalHits":9,"results":[', joined, '],"other":[1,2]};</script></html>'))
        .otherwise(cat("<html><body>", F.array_join("o", " "), "</body></html>"))
    )
    return body.select("page_id", html.alias("html"))


@query(
    "html_listing_extract",
    f"""WITH {LISTINGS}, l AS (SELECT *, id // 20 AS page_id, (id // 20) % 4 AS k FROM listings WHERE price >= 1000)
    SELECT page_id, (['state', 'ld', 'results', 'window'])[k + 1] AS strategy, count(*) AS n, round(sum(price), 2) AS price, sum(m2_built)::BIGINT AS m2, sum(CASE WHEN k <> 1 THEN m2_land END)::BIGINT AS land,
    sum(CASE WHEN k IN (0, 2) THEN NULL WHEN k = 1 THEN NULL WHEN id % 3 <> 0 THEN rooms END)::BIGINT AS card_rooms, sum(CASE WHEN k = 0 THEN rooms END)::BIGINT AS rooms,
    sum(CASE WHEN k <> 1 THEN baths END)::BIGINT AS parking, sum(CASE WHEN k = 3 THEN 100 * baths END)::BIGINT AS maintenance, sum(CASE WHEN k = 2 THEN id END)::BIGINT AS ids,
    count(DISTINCT CASE WHEN k IN (1, 2) THEN zone END) AS towns, count(DISTINCT CASE WHEN k = 2 THEN 'E|P' END) AS places, count(DISTINCT 'https://site.example/inmueble-' || id::VARCHAR) AS urls,
    sum(CASE WHEN k = 3 THEN 0 ELSE id END)::BIGINT AS images, sum(id)::BIGINT AS url_ids FROM l GROUP BY 1, 2""",
)
def html_listing_extract(t: Tables):
    out = H.extract_listings(durable(_pages(t)), base="https://site.example")
    whole = lambda c: F.sum(c).cast("bigint")
    number = lambda c: F.regexp_extract(c, "([0-9]+)(?:[.]jpg)?$", 1).try_cast("bigint")
    card = F.col("strategy") == "window"
    return out.groupBy("page_id", "strategy").agg(
        F.count("*").alias("n"), r(F.sum("price"), 2).alias("price"), whole("m2_built").alias("m2"), whole("m2_land").alias("land"),
        whole(F.when(card, F.col("rooms"))).alias("card_rooms"), whole(F.when(~card, F.col("rooms"))).alias("rooms"), whole("parking").alias("parking"), whole("maintenance").alias("maintenance"),
        whole(F.col("id").cast("bigint")).alias("ids"), F.count_distinct("town").alias("towns"), F.count_distinct(F.concat("state", F.lit("|"), "country")).alias("places"), F.count_distinct("url").alias("urls"),
        whole(F.when(card, F.lit(0)).otherwise(number("image"))).alias("images"), whole(number("url")).alias("url_ids"),
    )


@query(
    "html_price_samples",
    f"""WITH {LISTINGS}, l AS (SELECT id, id // 20 AS page_id, (id // 20) % 4 AS k, CASE WHEN (id // 20) % 4 = 3 THEN floor(price) ELSE price END AS price, CASE WHEN (id // 20) % 4 = 3 THEN coalesce(m2_built, m2_land) ELSE m2_built END AS m2 FROM listings WHERE (id // 20) % 4 <> 2),
    s AS (SELECT DISTINCT page_id, price, m2, CASE WHEN k = 0 THEN 0 ELSE id END AS u FROM l WHERE m2 > 15 AND (k <> 3 OR price >= 10000) AND price / m2 > 3000 AND price / m2 < 220000)
    SELECT page_id, count(*) AS samples, round(median(price / m2), 4) AS median_pm2 FROM s GROUP BY 1""",
)
def html_price_samples(t: Tables):
    s = H.price_samples(durable(_pages(t)))
    return H.sample_medians(s, ["page_id"]).select("page_id", "samples", r("median_pm2", 4).alias("median_pm2"))


@query(
    "html_price_pairs",
    r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)\$\s?([\d,]{6,12})(?:\s?MXN)?.{0,300}?(\d{2,4})\s?m', 1) AS a, regexp_extract_all(html, '(?s)\$\s?([\d,]{6,12})(?:\s?MXN)?.{0,300}?(\d{2,4})\s?m', 2) AS b FROM pages)
    SELECT page_id, len(a) AS pairs, md5(array_to_string(list_transform(list_zip(a, b), lambda x: x[1] || ':' || x[2]), '|')) AS digest FROM p""",
)
def html_price_pairs(t: Tables):
    h = F.col("html")
    a, b = (F.regexp_extract_all(h, F.lit(H.PRICE_PAIR), F.lit(i)) for i in (1, 2))
    joined = F.array_join(F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(":"), y)), "|")
    return t.pages.select("page_id", F.size(a).cast("bigint").alias("pairs"), F.md5(joined).alias("digest"))


@query(
    "page_json_blocks",
    r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) AS scripts, len(regexp_extract_all(html, '(?is)<script[^>]*type\s*=\s*["'']application/ld\+json["''][^>]*>(.*?)</script>', 1)) AS ld,
    md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS plain_md5 FROM pages""",
)
def page_json_blocks(t: Tables):
    h = F.col("html")
    return t.pages.select(
        "page_id",
        F.size(F.regexp_extract_all(h, F.lit("(?is)<script[^>]*>(.*?)</script>"), F.lit(1))).cast("bigint").alias("scripts"),
        F.size(F.regexp_extract_all(h, F.lit(H.LD_JSON), F.lit(1))).cast("bigint").alias("ld"),
        F.md5(H.plain(h)).alias("plain_md5"),
    )


@query(
    "json_props",
    "SELECT event_id::BIGINT AS event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
)
def json_props(t: Tables):
    m = F.from_json("props", "map<string,string>")
    return t.events.select(F.col("event_id").cast("bigint").alias("event_id"), H.pick(m, "K|key").cast("bigint").alias("k"))


@query(
    "ring_geometry",
    f"""WITH {STREETS} SELECT street, round(lng, 5) AS cx, round(lat, 5) AS cy, true AS inside FROM streets""",
)
def ring_geometry(t: Tables):
    h = 0.002
    corner = lambda dx, dy: F.struct((F.col("lng") + dx).alias("lng"), (F.col("lat") + dy).alias("lat"))
    ring = F.array(corner(-h, -h), corner(h, -h), corner(h, h), corner(-h, h), corner(-h, -h))
    s = streets(t).withColumn("ring", ring)
    c = geo.ring_centroid(F.col("ring"))
    p = geo.interior_point(F.array("ring"))
    return s.select("street", r(c["lng"], 5).alias("cx"), r(c["lat"], 5).alias("cy"), geo.inside(F.array("ring"), p["lng"], p["lat"]).alias("inside"))


@query(
    "compact_rings",
    f"""WITH {STREETS} SELECT street, 5 AS vertices, round_even((lng - 0.002e0) * 10000.0e0, 0) AS x0 FROM streets""",
)
def compact_rings(t: Tables):
    h = 0.002
    corner = lambda dx, dy: F.struct((F.col("lng") + dx).alias("lng"), (F.col("lat") + dy).alias("lat"))
    ring = F.array(corner(-h, -h), corner(-h, -h), corner(h, -h), corner(h, h), corner(-h, h), corner(-h, -h))
    s = S.compact_rings(streets(t).select("street", F.array(ring).alias("rings")))
    return s.select("street", F.size(F.col("rings")[0]).alias("vertices"), F.col("box")["x0"].alias("x0"))


