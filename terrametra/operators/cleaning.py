"""Projections, filters and row-level cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrametra.functions import geo, text
from terrametra.functions.constants import (
    DEFAULT_EMPLOYMENT,
    DEFAULT_SECTOR,
    DROUGHT_LABELS,
    EMPLOYMENT_BANDS,
    LEAD_FIELDS,
    NATIONAL_BOX,
    PUBLIC_LISTING_FIELDS,
    SECTOR_BY_PREFIX,
    USD_MXN,
)
from terrametra.functions.numeric import half_up


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def sector_of(code: Column) -> Column:
    """Macro sector from the first two characters of an activity code."""
    return F.coalesce(F.try_element_at(literal_map(SECTOR_BY_PREFIX), F.substring(code.cast("string"), 1, 2)), F.lit(DEFAULT_SECTOR))


def employment_of(band: Column) -> Column:
    """Point estimate of an employment band label."""
    return F.coalesce(F.try_element_at(literal_map(EMPLOYMENT_BANDS), band), F.lit(DEFAULT_EMPLOYMENT))


def area_key(state: Column, town: Column) -> Column:
    return F.concat(F.lpad(state.cast("string"), 2, "0"), F.lpad(town.cast("string"), 3, "0"))


def postal_key(code: Column) -> Column:
    """Five-digit postal code from text or number."""
    n = code.cast("string").try_cast("double").try_cast("bigint")
    return F.lpad(n.cast("string"), 5, "0")


def prefix_lookup(code: Column, table: dict[str, str], default: str, width: int = 2) -> Column:
    return F.coalesce(F.try_element_at(literal_map(table), F.substring(code, 1, width)), F.lit(default))


def street_name(kind: Column, name: Column) -> Column:
    """Kind plus name, unless the name already starts with the kind; title case, NULL below three letters."""
    k, n = F.trim(F.coalesce(kind, F.lit(""))), F.trim(F.coalesce(name, F.lit("")))
    keep = (k == "") | F.startswith(F.upper(n), F.concat(F.upper(k), F.lit(" ")))
    full = F.trim(text.title_case(F.when(keep, n).otherwise(F.concat(k, F.lit(" "), n))))
    return F.when(F.length(full) > 2, full)


def coordinate(c: Column) -> Column:
    """Numeric coordinate; NaN, infinities and text give NULL."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def valid_coordinates(df: DataFrame, lat: str = "lat", lng: str = "lng", box: tuple | None = None) -> DataFrame:
    """Rows with usable coordinates inside the world, or inside ``box`` (lat_min, lat_max, lng_min, lng_max)."""
    lo_lat, hi_lat, lo_lng, hi_lng = box or (-90.0, 90.0, -180.0, 180.0)
    out = df.withColumn(lat, coordinate(F.col(lat))).withColumn(lng, coordinate(F.col(lng)))
    return out.filter(F.col(lat).between(lo_lat, hi_lat) & F.col(lng).between(lo_lng, hi_lng))


def in_nation(lat: Column, lng: Column) -> Column:
    a, b, c, d = NATIONAL_BOX
    return lat.between(a, b) & lng.between(c, d)


# Open price-per-m2 intervals by use.
PRICE_WINDOWS = {"sample": (3000.0, 220000.0), "regression": (3000.0, 200000.0), "verdict": (5000.0, 150000.0)}


def plausible_price(price: Column, m2: Column, use: str = "sample") -> Column:
    """Strictly inside the window of the use; samples also need at least 15 m2."""
    lo, hi = PRICE_WINDOWS[use]
    p = F.try_divide(price, m2)
    ok = (p > lo) & (p < hi)
    return ok & (m2 >= 15) if use == "sample" else ok


def clean_paths(df: DataFrame, path: str, digits: int = 5, minimum: int = 2) -> DataFrame:
    """Rounded polylines without repeated vertices; shorter than ``minimum`` vertices drop out."""
    return df.withColumn(path, geo.drop_repeats(F.col(path), digits)).filter(F.size(path) >= minimum)


def public_fields(df: DataFrame, fields: list[str] = PUBLIC_LISTING_FIELDS) -> DataFrame:
    """Only whitelisted fields, absent ones as NULL."""
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


# Published limits of a lead and of a branch name.
LEAD_WIDTH = 200
LEAD_BYTES = 8 * 1024
BRANCH_WIDTH = 40


def clean_leads(df: DataFrame, fields: list[str] = LEAD_FIELDS, width: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Whitelisted lead fields plus ``rejected`` (NULL when the lead is kept).

    Reasons in order: honeypot, phone (ten digits), name (three characters), size.
    ``width`` and ``max_bytes``, such as ``LEAD_WIDTH`` and ``LEAD_BYTES``, clip fields and reject large leads.
    """
    kept = [f for f in fields if f in df.columns]
    clipped = df.select(
        *[(F.col(f).cast("string") if width is None else F.substring(F.col(f).cast("string"), 1, width)).alias(f) for f in kept],
        *([F.col("website")] if "website" in df.columns else [F.lit(None).cast("string").alias("website")]),
    )
    digits = F.regexp_replace(F.coalesce(F.col("telefono"), F.lit("")), "[^0-9]", "")
    size = F.length(F.to_json(F.struct(*kept)))
    reason = (
        F.when(F.coalesce(F.col("website"), F.lit("")) != "", "honeypot")
        .when(~digits.rlike("^[0-9]{10}$"), "phone")
        .when(F.length(F.trim(F.coalesce(F.col("nombre"), F.lit("")))) < 3, "name")
    )
    if max_bytes is not None:
        reason = reason.when(size > max_bytes, "size")
    return clipped.withColumn("rejected", reason).drop("website")


def geo_sanity(df: DataFrame, cities: DataFrame, state: str, km: float = 300.0) -> DataFrame:
    """Null the coordinates of rows farther than ``km`` from the anchor city of their state.

    ``cities(state key, c_lat, c_lng)`` is one row per state.
    """
    out = df.join(cities, state, "left")
    far = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")) > km
    broken = F.coalesce(far, F.lit(False))
    return (
        out.withColumn("geo_broken", broken)
        .withColumn("lat", F.when(~broken, F.col("lat")))
        .withColumn("lng", F.when(~broken, F.col("lng")))
        .drop("c_lat", "c_lng")
    )


def with_unit_price(df: DataFrame, rate: float = USD_MXN) -> DataFrame:
    """Add ``pm2`` (rounded price per built m2), ``pm2_mxn``, ``land_pm2_mxn`` and ``is_land``."""
    price, built, land = F.col("price"), F.col("m2_built"), F.col("m2_land")
    fx = F.when(F.col("currency") == "USD", F.lit(rate)).otherwise(F.lit(1.0))
    pm2 = F.when((price != 0) & (built > 0), half_up(price / built))
    return (
        df.withColumn("pm2", pm2)
        .withColumn("pm2_mxn", F.coalesce(F.col("pm2"), F.lit(0)) * fx)
        .withColumn("land_pm2_mxn", F.when(land > 0, F.coalesce(price, F.lit(0.0)) * fx / land).otherwise(F.lit(0.0)))
        .withColumn("is_land", F.coalesce((land > 0) & (F.coalesce(built, F.lit(0.0)) <= 0), F.lit(False)))
    )


def parse_branches(lines: DataFrame, line: str = "value", order: str = "line_no", width: int | None = None) -> DataFrame:
    """``lat,lng[,name]`` lines to branches with ``ok`` and ``attempted`` flags.

    Header and blank lines are not attempted; names default to the running number of the accepted branch.
    ``width``, such as ``BRANCH_WIDTH``, clips names; they stay whole by default.
    """
    from terrametra.operators.ranking import ordered_positions

    li = F.trim(F.col(line))
    parts = F.transform(F.split(li, ","), lambda p: F.trim(p))
    attempted = (li != "") & ~F.startswith(F.lower(li), F.lit("lat"))
    lat, lng = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    ok = attempted & (F.size(parts) >= 2) & lat.between(-90, 90) & lng.between(-180, 180)
    name = F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    name = F.when((name != "") & (F.lower(name) != "nan"), name if width is None else F.substring(name, 1, width))
    rows = lines.filter(attempted).select(
        F.col(order), F.coalesce(ok, F.lit(False)).alias("ok"), lat.alias("lat"), lng.alias("lng"), name.alias("name")
    )
    good = ordered_positions(rows.filter("ok"), [order]).drop("group_rows")
    named = good.withColumn("name", F.coalesce(F.col("name"), F.concat(F.lit("Branch "), (F.col("position") + 1).cast("string")))).drop("position")
    bad = rows.filter("not ok").withColumn("lat", F.lit(None).cast("double")).withColumn("lng", F.lit(None).cast("double"))
    return named.unionByName(bad.withColumn("name", F.lit(None).cast("string")).select(*named.columns))


def coverage_gate(df: DataFrame, eligible: Column, identified: Column, minimum: float = 0.60) -> DataFrame:
    """One row: rows, eligible rows, rows without an entity, coverage, and whether the output may be published."""
    return df.agg(
        F.count("*").alias("rows"),
        F.sum(eligible.cast("bigint")).alias("eligible"),
        F.sum((eligible & ~identified).cast("bigint")).alias("unidentified"),
    ).select(
        "*",
        ((F.col("eligible") - F.col("unidentified")) / F.greatest(F.col("eligible"), F.lit(1))).alias("coverage"),
        ((F.col("eligible") - F.col("unidentified")) / F.greatest(F.col("eligible"), F.lit(1)) >= minimum).alias("passed"),
    )


def require_coverage(report: DataFrame) -> float:
    """Raise when the gate did not pass; returns the coverage otherwise."""
    row = report.first()
    if not row["passed"]:
        raise ValueError(f"coverage {row['coverage']:.3f} is below the minimum; output refused")
    return row["coverage"]


def tag_entity(tags: Column, states: dict[str, str], country: str = "mexico") -> Column:
    """First comma token that names a state; a leading token equal to the country is skipped."""
    parts = F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda p: text.fold_lower(p))
    table = literal_map(states)
    usable = F.filter(parts, lambda p, i: ~((i == 0) & (p == country)))
    return F.get(F.filter(F.transform(usable, lambda p: F.try_element_at(table, p)), lambda s: s.isNotNull()), F.lit(0))


def zone_lookup(df: DataFrame, zone: str, wanted: str | None, total: str) -> DataFrame:
    """One zone (case-insensitive) or the whole ranking."""
    if wanted:
        return df.filter(F.lower(zone) == wanted.strip().lower())
    return df.orderBy(F.col(total).desc(), zone)


def drought_lookup(df: DataFrame, monitor: DataFrame, town: str, state: str) -> DataFrame:
    """Official drought level and label by folded (town, state); NULL where the monitor has no row.

    ``monitor(mun, ent, level)`` has one row per folded municipality.
    """
    keyed = df.withColumn("_m", text.fold_lower(F.col(town))).withColumn("_e", text.fold_lower(F.col(state)))
    levels = monitor.select(F.col("mun").alias("_m"), F.col("ent").alias("_e"), "level")
    labels = F.array(*[F.lit(x) for x in DROUGHT_LABELS])
    return keyed.join(levels, ["_m", "_e"], "left").withColumn("drought", F.get(labels, F.col("level"))).drop("_m", "_e")
