"""Bind the test tables to the shapes the operators expect, in Spark and as SQL table expressions.

The tables carry no coordinates, so they are derived by integer arithmetic that both engines evaluate alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrametra.operators.cleaning import employment_of, sector_of


class Tables:
    """Lazy readers for the Parquet tables of one directory."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def municipalities(t: Tables) -> DataFrame:
    """Nations as municipalities on a five-by-five grid; the region is their state."""
    n = F.col("n_nationkey").cast("bigint")
    return t.nation.select(
        n.alias("cell_id"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("bigint").alias("state"),
        (n % 5).alias("gx"),
        F.expr("n_nationkey div 5").cast("bigint").alias("gy"),
    ).select("*", (F.lit(-110.0) + 2 * F.col("gx")).alias("lng"), (F.lit(18.0) + 2 * F.col("gy")).alias("lat"))


MUNI = """muni AS (
  SELECT n_nationkey::BIGINT AS cell_id, n_name AS name, n_regionkey::BIGINT AS state,
         (n_nationkey % 5)::BIGINT AS gx, (n_nationkey // 5)::BIGINT AS gy,
         -110.0e0 + 2 * (n_nationkey % 5) AS lng, 18.0e0 + 2 * (n_nationkey // 5) AS lat
  FROM nation)"""

# Bands by employee count; the last label is unknown to the band table on purpose.
BANDS = [(5, "0 a 5 personas"), (10, "6 a 10 personas"), (30, "11 a 30 personas"), (45, "31 a 50 personas")]


def establishments(t: Tables) -> DataFrame:
    """Line items with their part and supplier as business registry rows."""
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    part = t.part.select("p_partkey", "p_name", "p_type")
    supp = t.supplier.select("s_suppkey", "s_nationkey")
    j = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    q = F.col("l_quantity")
    band = F.when(q <= BANDS[0][0], BANDS[0][1])
    for top, label in BANDS[1:]:
        band = band.when(q <= top, label)
    x = (F.col("l_orderkey") * 7919 + F.col("l_linenumber").cast("bigint") * 104729) % 1000
    y = (F.col("l_orderkey") * 15485863 + F.col("l_partkey") * 7) % 1000
    code = F.concat((F.col("l_partkey") % 90 + 10).cast("string"), F.lit("0001"))
    band = band.otherwise("otro")
    return j.select(
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_partkey").alias("pkey"),
        F.col("l_extendedprice").alias("price"),
        F.upper("p_name").alias("name"),
        F.col("p_type").alias("trade"),
        code.alias("code"),
        sector_of(code).alias("sector"),
        band.alias("band"),
        employment_of(band).cast("bigint").alias("staff"),
        q.alias("emp"),
        F.col("l_suppkey").alias("street"),
        F.col("s_nationkey").cast("bigint").alias("muni"),
        (F.col("s_nationkey").cast("bigint") % 5).alias("state"),
        F.year("l_shipdate").cast("bigint").alias("year"),
        F.date_format("l_shipdate", "yyyy-MM").alias("added_on"),
        (F.lit(-99.20) + x * F.lit(0.0001)).alias("lng"),
        (F.lit(19.45) + y * F.lit(0.0001)).alias("lat"),
    )


def _sector_case(code: str) -> str:
    from terrametra.functions.constants import SECTOR_BY_PREFIX

    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTOR_BY_PREFIX.items())
    return f"CASE substr({code}, 1, 2) {whens} ELSE 'Servicios' END"


_CODE = "((l_partkey % 90 + 10)::VARCHAR || '0001')"
_BAND = (
    "CASE WHEN l_quantity <= 5 THEN '0 a 5 personas' WHEN l_quantity <= 10 THEN '6 a 10 personas' "
    "WHEN l_quantity <= 30 THEN '11 a 30 personas' WHEN l_quantity <= 45 THEN '31 a 50 personas' ELSE 'otro' END"
)
EST = f"""est AS (
  SELECT l_orderkey AS okey, l_linenumber::BIGINT AS line, l_partkey AS pkey, l_extendedprice AS price,
         upper(p_name) AS name, p_type AS trade, {_CODE} AS code, {_sector_case(_CODE)} AS sector, {_BAND} AS band,
         (CASE WHEN l_quantity <= 5 THEN 3 WHEN l_quantity <= 10 THEN 8 WHEN l_quantity <= 30 THEN 20
               WHEN l_quantity <= 45 THEN 40 ELSE 3 END)::BIGINT AS staff,
         l_quantity AS emp, l_suppkey AS street, s_nationkey::BIGINT AS muni, (s_nationkey % 5)::BIGINT AS state,
         year(l_shipdate)::BIGINT AS year, strftime(l_shipdate, '%Y-%m') AS added_on,
         -99.20e0 + ((l_orderkey * 7919 + l_linenumber::BIGINT * 104729) % 1000) * 0.0001e0 AS lng,
         19.45e0 + ((l_orderkey * 15485863 + l_partkey * 7) % 1000) * 0.0001e0 AS lat
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def streets(t: Tables) -> DataFrame:
    """Suppliers as streets with a midpoint near the businesses."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("street"),
        F.col("s_name").alias("street_name"),
        F.col("s_nationkey").cast("bigint").alias("muni"),
        (F.lit(-99.20) + (k * 7919 % 1000) * F.lit(0.0001)).alias("lng"),
        (F.lit(19.45) + (k * 15485863 % 1000) * F.lit(0.0001)).alias("lat"),
    )


STREETS = """streets AS (
  SELECT s_suppkey AS street, s_name AS street_name, s_nationkey::BIGINT AS muni,
         -99.20e0 + (s_suppkey * 7919 % 1000) * 0.0001e0 AS lng,
         19.45e0 + (s_suppkey * 15485863 % 1000) * 0.0001e0 AS lat
  FROM supplier)"""


def listings(t: Tables) -> DataFrame:
    """Orders with their customer as listings: F sale, O rent, P land for sale."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    land = s == "P"
    return j.select(
        k.alias("id"),
        F.col("o_totalprice").alias("price"),
        F.when(k % 10 == 0, "USD").otherwise("MXN").alias("currency"),
        F.when(s == "O", "renta").otherwise("venta").alias("operation"),
        F.when(land, "terreno").when(k % 2 == 0, "casa").otherwise("departamento").alias("kind"),
        F.when(~land, (40 + k % 160).cast("double")).alias("m2_built"),
        F.when(land, (100 + k % 400).cast("double")).alias("m2_land"),
        (1 + k % 5).alias("rooms"),
        (1 + k % 3).alias("baths"),
        F.concat(F.lit("Zona "), F.col("c_nationkey").cast("string")).alias("zone"),
        F.col("c_nationkey").cast("bigint").alias("zone_no"),
        F.col("c_name").alias("contact"),
        F.col("c_mktsegment").alias("segment"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.to_date("o_orderdate").alias("day"),
        (F.lit(-99.20) + (k * 7919 % 1000) * F.lit(0.0001)).alias("lng"),
        (F.lit(19.45) + (k * 15485863 % 1000) * F.lit(0.0001)).alias("lat"),
    )


LISTINGS = """listings AS (
  SELECT o_orderkey AS id, o_totalprice AS price, CASE WHEN o_orderkey % 10 = 0 THEN 'USD' ELSE 'MXN' END AS currency,
         CASE WHEN o_orderstatus = 'O' THEN 'renta' ELSE 'venta' END AS operation,
         CASE WHEN o_orderstatus = 'P' THEN 'terreno' WHEN o_orderkey % 2 = 0 THEN 'casa' ELSE 'departamento' END AS kind,
         CASE WHEN o_orderstatus <> 'P' THEN (40 + o_orderkey % 160)::DOUBLE END AS m2_built,
         CASE WHEN o_orderstatus = 'P' THEN (100 + o_orderkey % 400)::DOUBLE END AS m2_land,
         1 + o_orderkey % 5 AS rooms, 1 + o_orderkey % 3 AS baths,
         'Zona ' || c_nationkey::VARCHAR AS zone, c_nationkey::BIGINT AS zone_no, c_name AS contact, c_mktsegment AS segment,
         strftime(o_orderdate, '%Y-%m') AS month, o_orderdate::DATE AS day,
         -99.20e0 + (o_orderkey * 7919 % 1000) * 0.0001e0 AS lng,
         19.45e0 + (o_orderkey * 15485863 % 1000) * 0.0001e0 AS lat
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

# Prices per m2 in SQL, on top of LISTINGS.
PRICED = """priced AS (
  SELECT *, CASE WHEN price <> 0 AND m2_built > 0 THEN floor(price / m2_built + 0.5)::BIGINT END AS pm2,
         coalesce(CASE WHEN price <> 0 AND m2_built > 0 THEN floor(price / m2_built + 0.5) END, 0)
           * CASE WHEN currency = 'USD' THEN 17.5e0 ELSE 1.0e0 END AS pm2_mxn,
         CASE WHEN m2_land > 0 THEN price * CASE WHEN currency = 'USD' THEN 17.5e0 ELSE 1.0e0 END / m2_land ELSE 0.0e0 END AS land_pm2_mxn,
         coalesce(m2_land > 0 AND coalesce(m2_built, 0) <= 0, false) AS is_land
  FROM listings)"""


def panel(t: Tables) -> DataFrame:
    """Yearly mean line price per supplier nation as the index panel."""
    li = t.lineitem.select("l_suppkey", "l_extendedprice", F.year("l_shipdate").alias("year"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("zone"))
    return li.join(s, li.l_suppkey == s.s_suppkey).groupBy("zone", "year").agg(F.avg("l_extendedprice").alias("idx"))


PANEL = """panel AS (
  SELECT s_nationkey::BIGINT AS zone, year(l_shipdate)::INT AS year, avg(l_extendedprice) AS idx
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def events(t: Tables) -> DataFrame:
    """Events as demand records: zone, event, budget, type, styles, score."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    e = F.col("event_type")
    return t.events.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("bigint").alias("user_id"),
        e.alias("event"),
        F.when(k % 7 != 0, F.concat(F.lit("z"), (F.col("user_id") % 32).cast("string"))).otherwise("").alias("zone"),
        F.when(k % 3 != 0, F.concat(F.lit("b"), (k % 4).cast("string"))).alias("budget"),
        F.when(k % 5 != 0, F.concat(F.lit("t"), (k % 6).cast("string"))).alias("type"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("s"), (k % 5).cast("string")), F.concat(F.lit("s"), (5 + k % 3).cast("string")))).alias("styles"),
        F.col("value").alias("score"),
        k.alias("k"),
    )


EVENTS = """ev AS (
  SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type AS event, value AS score, k,
         CASE WHEN k % 7 <> 0 THEN 'z' || (user_id % 32)::VARCHAR ELSE '' END AS zone,
         CASE WHEN k % 3 <> 0 THEN 'b' || (k % 4)::VARCHAR END AS budget,
         CASE WHEN k % 5 <> 0 THEN 't' || (k % 6)::VARCHAR END AS type,
         CASE WHEN k % 2 = 0 THEN ['s' || (k % 5)::VARCHAR, 's' || (5 + k % 3)::VARCHAR] END AS styles
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""

# Directed queen edges of the municipality grid.
QUEEN = """edges AS (
  SELECT a.cell_id AS src, b.cell_id AS dst FROM muni a JOIN muni b
    ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.cell_id <> b.cell_id)"""


def cell_values(t: Tables) -> DataFrame:
    """Municipalities with a value (mean line price), potential and growth, over the whole registry."""
    facts = establishments(t).groupBy("muni").agg(
        F.avg("price").alias("value"), F.avg("emp").alias("_e"), F.count("*").alias("n_estab")
    )
    return municipalities(t).join(facts, F.col("cell_id") == F.col("muni")).select(
        "cell_id",
        "name",
        "state",
        "gx",
        "gy",
        "lng",
        "lat",
        "n_estab",
        "value",
        (F.col("_e") / 50).alias("potential"),
        (F.lit(0.02) + F.col("cell_id") * F.lit(0.001)).alias("growth"),
    )


CELLS = """cells AS (
  SELECT m.*, f.value, f.e / 50 AS potential, 0.02e0 + m.cell_id * 0.001e0 AS growth, f.n_estab
  FROM muni m JOIN (SELECT muni, avg(price) AS value, avg(emp) AS e, count(*) AS n_estab FROM est GROUP BY 1) f ON f.muni = m.cell_id)"""
# Queen edges between cells that have a value.
CELL_EDGES = """edges AS (
  SELECT a.cell_id AS src, b.cell_id AS dst FROM cells a JOIN cells b
    ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.cell_id <> b.cell_id)"""
