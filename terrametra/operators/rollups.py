"""Registry and listing roll-ups. All aggregates combine on the map side before their shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrametra.functions.constants import SECTORS
from terrametra.functions.numeric import add_min_max, half_even, half_up, one_row
from terrametra.operators.ranking import (
    exact_median,
    latest_k_dates,
    quantile_value,
    top_n_per_group,
    upper_median,
)
from terrametra.operators.spatial import points_in_polygons
from terrametra.session import durable


def recent_flag(df: DataFrame, date: str, k: int = 2, name: str = "recent", per: list[str] | None = None) -> DataFrame:
    """Mark rows of the newest ``k`` distinct dates; with fewer than ``k`` dates nothing is recent.

    The rows are compared with a threshold date: without ``per`` the
    threshold is a scalar, with ``per`` one row per entity, which Spark broadcasts while it is small.
    """
    per = per or []
    dates = latest_k_dates(df, per, date, k)
    cut = dates.groupBy(*per).agg(F.min(date).alias("_from"), F.count("*").alias("_k"))
    cut = cut.select(*per, F.when(F.col("_k") >= k, F.col("_from")).alias("_from"))
    marked = df.join(cut, per, "left") if per else df.withColumn("_from", cut.select("_from").scalar())
    return marked.withColumn(name, F.coalesce(F.col(date) >= F.col("_from"), F.lit(False))).drop("_from")


def sector_entropy(
    df: DataFrame, keys: list[str], sector: str, name: str = "entropy", classes: int = 4, all_classes: list[str] | None = None
) -> DataFrame:
    """Shannon entropy of sector shares over ln(classes).

    Only sectors that occur count, unless ``all_classes`` is given: then each absent class adds a share
    floored at 1e-9.
    """
    counts = df.groupBy(*keys, sector).agg(F.count("*").alias("_c"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    p = F.greatest(F.col("_c") / F.col("_n"), F.lit(1e-9))
    ent = counts.join(totals, keys).groupBy(*keys).agg(
        (-F.sum(p * F.log(p))).alias("_h"), F.first("_k").alias("_k")
    )
    h = F.col("_h")
    if all_classes is not None:
        h = h - (len(all_classes) - F.col("_k")) * F.lit(1e-9 * math.log(1e-9))
    return ent.select(*keys, (h / math.log(classes)).alias(name))


def mode_value(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias(name))


def registry_rollup(
    df: DataFrame,
    keys: list[str],
    sector: str,
    employment: str,
    date: str,
    indicator: Column,
    labels: list[str] | None = None,
    sectors: list[str] = SECTORS,
    k: int = 2,
    entity: list[str] | None = None,
) -> DataFrame:
    """One row per area: businesses, employment, sector counts, diversity, recent openings and indicators.

    ``entity`` lists the columns of the source file or state whose own newest dates decide what is recent.
    Counts per (area, sector) carry every other measure, so the second aggregation sees at most one row per
    sector and both aggregations combine before they shuffle.
    """
    marked = recent_flag(df.withColumn("_ind", indicator), date, k, per=entity)
    per_sector = marked.groupBy(*keys, sector).agg(
        F.count("*").alias("_c"),
        F.sum(employment).alias("_e"),
        F.sum(F.col("recent").cast("bigint")).alias("_r"),
        F.sum((F.col("_ind") & F.col("recent")).cast("bigint")).alias("_i"),
        *[F.min(c).alias(c) for c in labels or []],
    )
    n = F.sum("_c")
    # sum(-p ln p) with p = c / n equals ln(n) - sum(c ln c) / n: one pass over the sector counts
    entropy = (F.log(n) - F.sum(F.col("_c") * F.log(F.col("_c"))) / n) / math.log(4)
    return per_sector.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in labels or []],
        n.alias("n_estab"),
        F.sum("_e").alias("employment"),
        *[F.sum(F.when(F.col(sector) == s, F.col("_c")).otherwise(0)).alias(s.lower()) for s in sectors],
        half_even(entropy, 3).alias("resilience"),
        F.sum("_r").alias("recent_openings"),
        F.sum("_i").alias("indicators"),
    )


def grid_rollup(df: DataFrame, lng: str, lat: str, step: float, measures: dict[str, Column], origin: tuple[Column, Column] | None = None) -> DataFrame:
    """Cells by half-even rounding of the coordinates: ``gx, gy`` and the given aggregates."""
    x, y = F.col(lng), F.col(lat)
    if origin is not None:
        x, y = x - origin[0], y - origin[1]
    cells = df.withColumn("gx", F.rint(x / step).cast("bigint")).withColumn("gy", F.rint(y / step).cast("bigint"))
    return cells.groupBy("gx", "gy").agg(*[v.alias(k) for k, v in measures.items()])


def employment_anchors(df: DataFrame, name: str, employment: str, tie: str, step: float = 0.0025, n: int = 6) -> DataFrame:
    """The ``n`` densest employment cells, named after their largest business, weight .45 + .55 * scaled.

    ``tie`` is a column that orders equally large businesses.
    """
    origin = df.agg(F.min("lng").alias("x"), F.min("lat").alias("y"))
    o = one_row(origin)
    cells = grid_rollup(
        df.withColumn("_o", o),
        "lng",
        "lat",
        step,
        {
            "emp": F.sum(employment),
            "lng": F.avg("lng"),
            "lat": F.avg("lat"),
            "name": F.min_by(name, F.struct(-F.col(employment), F.col(tie))),
        },
        origin=(F.col("_o")["x"], F.col("_o")["y"]),
    )
    top = cells.orderBy(F.col("emp").desc(), "gx", "gy").limit(n)
    scaled = add_min_max(top, {"_s": F.col("emp").cast("double")})
    return scaled.withColumn("weight", half_even(F.lit(0.45) + F.lit(0.55) * F.col("_s"), 3)).drop("_s")


def price_anchors(samples: DataFrame, keys: list[str], price: str, count: str, minimum: int = 8) -> DataFrame:
    """Median of the portal medians and total samples per zone; zones below ``minimum`` samples drop out."""
    med = exact_median(samples, keys, price, "price_m2")
    total = samples.groupBy(*keys).agg(F.sum(count).alias("samples"))
    return med.join(total, keys).filter(F.col("samples") >= minimum)


# Matched (polygon, price) rows that are listed; beyond, prices are counted by range first.
LISTED_HITS = 1 << 24
# Ranges a count tells apart, and counts before prices are listed.
RANGES, ROUNDS = 32, 2


def polygon_signal(points: DataFrame, polygons: DataFrame, price: str, step: float, listed: int | None = None, depth: int | None = None) -> DataFrame:
    """Listings per polygon and their median price.

    Up to ``listed`` (``LISTED_HITS``) matches are written as rows (polygon, price) and ranked. Beyond that, prices are
    counted per polygon and range, then per part of the range that holds a middle rank, and only the prices of that part
    are listed and ranked (``depth`` as in ``region_sums``). The ranges come from sketched bounds; the result is exact whatever they are.
    """
    points = points.select("lng", "lat", F.col(price).cast("double").alias("_v"), F.lit(1).alias("listings"))
    parts = points_in_polygons(points, polygons, step, ["listings"], depth=depth)
    counts = durable(parts.groupBy("poly_id").agg(F.sum("listings").alias("listings")))
    if (counts.agg(F.sum("listings")).first()[0] or 0) <= (LISTED_HITS if listed is None else listed):
        hits = durable(points_in_polygons(points, polygons, step).select("poly_id", "_v"))
        return counts.join(exact_median(hits, ["poly_id"], "_v", "night_price"), "poly_id", "left")
    return counts.join(_narrowed_median(points, polygons, step, depth), "poly_id", "left")


def _narrowed_median(points: DataFrame, polygons: DataFrame, step: float, depth: int | None) -> DataFrame:
    """Exact median of ``_v`` per polygon as ``night_price``, by counts in ever smaller ranges of ``_v``."""
    priced = points.select("lng", "lat", "_v").filter("_v is not null")
    every = [F.lit(i / RANGES**ROUNDS) for i in range(1, RANGES**ROUNDS)]
    marks = priced.agg(F.percentile_approx("_v", F.array(*every), 4 * RANGES**ROUNDS).alias("b")).scalar()
    priced = priced.withColumn("_m", marks).withColumn("_d0", F.lit(0))
    digits, code = [], F.lit(0)  # a price's range, digit by digit: the number of marks below it among those of its range
    for i in range(1, ROUNDS + 1):
        wide = RANGES ** (ROUNDS - i)
        own = F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda k: F.get("_m", (code + k * wide - 1).cast("int")))
        priced = priced.withColumn(f"_d{i}", F.size(F.filter(own, lambda m: m < F.col("_v"))))
        digits.append(f"_d{i}")
        code = code + F.col(f"_d{i}") * wide
    priced = durable(priced.groupBy("lng", "lat", *digits, "_v").agg(F.count("*").alias("_c")))
    names = [f"_n{k}" for k in range(RANGES)]
    wanted, found = None, []  # (poly_id, _r rank, found digits, _o rows before the range)
    for i, digit in enumerate(digits):
        shapes = polygons if wanted is None else wanted.select("poly_id", *found).distinct().join(polygons, "poly_id")
        rows = priced.select("lng", "lat", *found, *[F.when(F.col(digit) == k, F.col("_c")).otherwise(0).alias(n) for k, n in enumerate(names)])
        parts = points_in_polygons(rows, shapes, step, names, on=found, depth=depth)
        counts = parts.groupBy("poly_id", *found).agg(F.array(*[F.sum(n) for n in names]).alias("_h"))
        if wanted is None:
            total = F.aggregate("_h", F.lit(0).cast("bigint"), lambda s, x: s + x)
            counts = counts.withColumn("_n", total).filter("_n > 0")
            ranks = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)))
            held = counts.select("poly_id", "_h", F.explode(ranks).alias("_r"), F.lit(0).cast("bigint").alias("_o"))
        else:
            held = wanted.join(counts, ["poly_id", *found])
        start = F.struct(F.col("_o").alias("o"), F.lit(0).alias("d"), F.lit(False).alias("end"))

        def on_to(s: Column, x: Column) -> Column:
            end = s["end"] | (s["o"] + x > F.col("_r"))
            return F.struct(F.when(end, s["o"]).otherwise(s["o"] + x).alias("o"), F.when(end, s["d"]).otherwise(s["d"] + 1).alias("d"), end.alias("end"))

        held = held.withColumn("_s", F.aggregate("_h", start, on_to))
        wanted = durable(held.select("poly_id", "_r", *found, F.col("_s.d").alias(digit), F.col("_s.o").alias("_o")))
        found.append(digit)
    shapes = wanted.select("poly_id", *found).distinct().join(polygons, "poly_id")
    listed = points_in_polygons(priced.select("lng", "lat", *found, "_v", "_c"), shapes, step, on=found)
    listed = listed.groupBy("poly_id", *found, "_v").agg(F.sum("_c").alias("_c"))
    before = Window.partitionBy("poly_id", "_r").orderBy("_v")
    ranked = wanted.join(listed, ["poly_id", *found]).withColumn("_e", F.col("_o") + F.sum("_c").over(before))
    middle = ranked.filter((F.col("_r") < F.col("_e")) & (F.col("_r") >= F.col("_e") - F.col("_c")))
    low, high = F.min_by("_v", "_r"), F.max_by("_v", "_r")
    both = middle.groupBy("poly_id").agg(low.alias("_lo"), high.alias("_hi"))
    return both.select("poly_id", (F.col("_lo") + 0.5 * (F.col("_hi") - F.col("_lo"))).alias("night_price"))


def gross_yield(rent: Column, sale: Column, n_rent: Column, n_sale: Column, minimum: int = 5) -> Column:
    """Yearly rent over sale price in percent, one decimal; NULL below ``minimum`` rows on either side."""
    enough = (n_rent >= minimum) & (n_sale >= minimum) & rent.isNotNull() & sale.isNotNull()
    return F.when(enough, half_up(rent * 12.0 / sale * 1000.0) / 10.0)


def market_metrics(listings: DataFrame, zone: str = "zone") -> DataFrame:
    """Per zone: upper-median price per m2 of sale, rent and land with counts, and the gross yield.

    Expects ``operation, pm2_mxn, land_pm2_mxn, is_land``. Non-positive prices count but do not enter medians.
    """
    kind = (
        F.when(F.col("is_land") & (F.col("operation") != "renta"), "t")
        .when(~F.col("is_land") & (F.col("operation") == "venta"), "v")
        .when(~F.col("is_land") & (F.col("operation") == "renta"), "r")
    )
    value = F.when(kind == "t", F.col("land_pm2_mxn")).otherwise(F.col("pm2_mxn"))
    tagged = listings.select(F.col(zone).alias("zone"), kind.alias("_k"), F.when(value > 0, value).alias("_x")).filter("_k is not null")
    tagged = durable(tagged)  # read by the medians (twice) and the counts
    med = upper_median(tagged, ["zone", "_k"], "_x", "_m")
    counts = tagged.groupBy("zone", "_k").agg(F.count("*").alias("_n"))
    both = counts.join(med, ["zone", "_k"], "left")
    wide = both.groupBy("zone").agg(
        *[F.max(F.when(F.col("_k") == k, F.col("_m"))).alias(f"_m{k}") for k in "vrt"],
        *[F.coalesce(F.max(F.when(F.col("_k") == k, F.col("_n"))), F.lit(0)).alias(f"n_{k}") for k in "vrt"],
    )
    return wide.select(
        "zone",
        half_up(F.col("_mv")).alias("pm2_sale"),
        F.col("n_v").alias("n_sale"),
        half_up(F.col("_mr")).alias("pm2_rent"),
        F.col("n_r").alias("n_rent"),
        half_up(F.col("_mt")).alias("pm2_land"),
        F.col("n_t").alias("n_land"),
        gross_yield(F.col("_mr"), F.col("_mv"), F.col("n_r"), F.col("n_v")).alias("gross_yield"),
    )


def zone_registry(listings: DataFrame, zone: str = "zone", minimum: int = 3) -> DataFrame:
    """Zones with at least ``minimum`` listings: count, centroid, sale median and yield."""
    base = listings.groupBy(F.col(zone).alias("zone")).agg(
        F.count("*").alias("n"),
        F.avg("lat").alias("_lat"),
        F.avg("lng").alias("_lng"),
        F.sum((F.col("operation") == "venta").cast("bigint")).alias("_nv"),
        F.sum((F.col("operation") == "renta").cast("bigint")).alias("_nr"),
    )
    sides = listings.filter(F.col("operation").isin("venta", "renta")).select(
        F.col(zone).alias("zone"), "operation", F.when(F.col("pm2_mxn") > 0, F.col("pm2_mxn")).alias("_x")
    )
    med = (
        upper_median(sides, ["zone", "operation"], "_x", "_m")
        .groupBy("zone")
        .agg(
            F.max(F.when(F.col("operation") == "venta", F.col("_m"))).alias("_mv"),
            F.max(F.when(F.col("operation") == "renta", F.col("_m"))).alias("_mr"),
        )
    )
    return (
        base.filter(F.col("n") >= minimum)
        .join(med, "zone", "left")
        .select(
            "zone",
            "n",
            F.round("_lat", 4).alias("lat"),
            F.round("_lng", 4).alias("lng"),
            half_up(F.col("_mv")).alias("pm2"),
            gross_yield(F.col("_mr"), F.col("_mv"), F.col("_nr"), F.col("_nv")).alias("gross_yield"),
        )
    )


def trailing_rate(long: DataFrame, population: DataFrame, months: int = 12, per: float = 100_000.0) -> DataFrame:
    """Incidents of the last ``months`` published months per 100,000 inhabitants.

    ``long(entity, offence, period, cases)`` with NULL for unpublished; a shorter series gives no row.
    """
    monthly = long.filter(F.col("cases").isNotNull()).groupBy("entity", "offence", "period").agg(F.sum("cases").alias("cases"))
    last = top_n_per_group(monthly, ["entity", "offence"], [F.col("period").desc()], months)
    total = (
        last.groupBy("entity", "offence")
        .agg(F.sum("cases").alias("total"), F.count("*").alias("_m"), F.max("period").alias("cut"))
        .filter(F.col("_m") == months)
    )
    return total.join(population, "entity").select(
        "entity", "offence", "total", "cut", half_even(F.col("total") / F.col("population") * per, 1).alias("rate")
    )


def unpivot_months(wide: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Wide month columns to (ids, month 1-12, cases); blank cells are unpublished, thousands commas allowed."""
    long = wide.unpivot(ids, columns, "_name", "_raw")
    number = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i + 1)])
    cases = F.regexp_replace(F.trim(F.col("_raw").cast("string")), ",", "").try_cast("double").try_cast("bigint")
    return long.select(*ids, number[F.col("_name")].alias("month"), cases.alias("cases"))


def contract_rollup(df: DataFrame, entity: str, year: str, currency_ok: Column, amount: str, order_key: str, carry: list[str], n: int = 5):
    """Per entity and year: contracts, amount in national currency, and the ``n`` largest contracts.

    Contracts with foreign currency or unreadable amounts count but add no amount and enter no top list.
    Returns (totals, top).
    """
    usable = df.withColumn("_amt", F.when(currency_ok, F.col(amount)))
    totals = usable.groupBy(entity, year).agg(F.count("*").alias("n"), F.coalesce(F.sum("_amt"), F.lit(0.0)).alias("amount"))
    top = top_n_per_group(
        usable.filter(F.col("_amt").isNotNull()).select(entity, year, F.col("_amt").alias("amount"), order_key, *carry),
        [entity, year],
        [F.col("amount").desc(), F.col(order_key)],
        n,
    )
    return totals, top


def contract_window(totals: DataFrame, top: DataFrame, entity: str, year: str, order_key: str, years: int = 4, n: int = 5):
    """Collapse the newest ``years + 1`` years; the yearly top lists already hold every overall leader."""
    dated = totals.filter(F.col(year) > 0)
    span = one_row(dated.agg(F.max(year).alias("hi"), F.min(year).alias("lo")))

    def inside(df):
        lo = F.greatest(F.col("_s")["hi"] - years, F.col("_s")["lo"])
        return df.withColumn("_s", span).filter((F.col(year) >= lo) & (F.col(year) <= F.col("_s")["hi"])).drop("_s")

    sums = inside(totals).groupBy(entity).agg(F.sum("n").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))
    best = top_n_per_group(inside(top).drop("rank"), [entity], [F.col("amount").desc(), F.col(order_key)], n)
    return sums, best


def field_completeness(df: DataFrame, fields: list[str], keys: list[str] | None = None) -> DataFrame:
    """Rounded percentage of rows with a value, per field (long form), optionally per key."""
    agg = df.groupBy(*(keys or [])).agg(
        F.count("*").alias("rows"), *[F.sum(F.col(f).isNotNull().cast("bigint")).alias(f) for f in fields]
    )
    long = agg.unpivot([*(keys or []), "rows"], fields, "field", "filled")
    return long.withColumn("pct", half_up(F.col("filled") * 100.0 / F.greatest(F.col("rows"), F.lit(1))))


def stagnation(df: DataFrame, openings: str, businesses: str, minimum: int = 300, prob: float = 0.15) -> DataFrame:
    """Renewal = openings / businesses; units at or below the low quantile of the large units are flagged."""
    rate = F.col(openings) / F.greatest(F.col(businesses), F.lit(1))
    out = df.withColumn("renewal", rate).withColumn("urban", F.col(businesses) >= minimum)
    cut = quantile_value(out.filter("urban"), "renewal", prob)
    return out.withColumn("_cut", F.coalesce(cut, F.lit(0.0))).withColumn(
        "stagnant", F.col("urban") & (F.col("renewal") <= F.col("_cut"))
    ).drop("_cut")


def stagnation_report(flagged: DataFrame) -> DataFrame:
    """One row: flagged units, their median renewal and the median of all large units."""
    counts = flagged.agg(F.sum(F.col("stagnant").cast("bigint")).alias("n_stagnant"), F.sum(F.col("urban").cast("bigint")).alias("n_urban"))
    return counts.withColumn("median_stagnant", quantile_value(flagged.filter("stagnant"), "renewal", 0.5)).withColumn(
        "median_urban", quantile_value(flagged.filter("urban"), "renewal", 0.5)
    )


def street_stagnation(df: DataFrame, street: str, year: str, minimum: int = 10, prob: float = 0.6) -> DataFrame:
    """Streets with ``minimum`` businesses and no opening since the year quantile."""
    cut = quantile_value(df, year, prob)
    return (
        df.withColumn("_cut", cut)
        .groupBy(street)
        .agg(
            F.count("*").alias("n_estab"),
            F.sum((F.col(year) >= F.col("_cut")).cast("bigint")).alias("recent_openings"),
        )
        .withColumn("stagnant", (F.col("recent_openings") == 0) & (F.col("n_estab") >= minimum))
    )


def basket_stats(df: DataFrame, value: str, baskets: dict[str, Column], label: str, key: str, n: int = 4):
    """Mean, population deviation and size of overlapping rule-defined baskets, and their top rows.

    Membership is exploded once, so overlapping baskets share one scan. Returns (stats, top).
    """
    tags = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in baskets.items()]), lambda x: x.isNotNull())
    members = df.select(key, label, value, F.explode(tags).alias("basket"))
    stats = members.groupBy("basket").agg(
        F.count("*").alias("n"), (F.avg(value) * 100).alias("mean_pct"), (F.stddev_pop(value) * 100).alias("risk_pct")
    )
    return stats, top_n_per_group(members, ["basket"], [F.col(value).desc(), F.col(key)], n)


def demand_rollup(events: DataFrame, n: int | None = None) -> DataFrame:
    """Long demand counters ``(kind, key, event, n)``: total, zone by event, budget, type and style.

    Records without an event do not count. ``n`` limits the zones to the most demanded, as a report shows them.
    """
    events = events.filter(F.col("event") != "")
    zones = events.filter(F.col("zone") != "").groupBy("zone", "event").agg(F.count("*").alias("n"))
    if n is not None:
        top = zones.groupBy("zone").agg(F.sum("n").alias("_z")).orderBy(F.col("_z").desc(), "zone").limit(n)
        zones = zones.join(F.broadcast(top.select("zone")), "zone", "left_semi")  # at most n rows
    parts = [
        events.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("").alias("key"), F.lit("").alias("event"), "n"),
        zones.select(F.lit("zone").alias("kind"), F.col("zone").alias("key"), "event", "n"),
    ]
    for kind, col in (("budget", F.col("budget")), ("type", F.col("type")), ("style", F.explode("styles"))):
        part = events.select(col.alias("key")).filter(F.coalesce(F.col("key"), F.lit("")) != "")
        parts.append(part.groupBy("key").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", F.lit("").alias("event"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def openings_report(df: DataFrame, street: str, date: str, species: Column, n_species: int | None = None) -> DataFrame:
    """Per street: openings in the newest two cuts, how many are indicators, and their species names."""
    marked = recent_flag(df.withColumn("_sp", species), date)
    fresh = F.when(F.col("recent"), F.col("_sp"))
    return (
        marked.groupBy(street)
        .agg(
            F.sum(F.col("recent").cast("bigint")).alias("openings"),
            F.lit(0).cast("bigint").alias("closures"),
            F.count(fresh).alias("indicators"),
            F.sort_array(F.collect_set(fresh)).alias("_s"),  # bounded by the catalogue
        )
        .withColumn("species", F.when(F.size("_s") > 0, F.array_join("_s" if n_species is None else F.slice("_s", 1, n_species), ", ")).otherwise("—"))
        .drop("_s")
    )


def canary_cells(df: DataFrame, species: Column, year: str, step: float = 0.0028, window: int = 2) -> DataFrame:
    """Grid cells with recent canary businesses: recent, earlier and total counts, centre and species text."""
    newest = df.agg(F.max(year)).scalar()
    can = (
        df.withColumn("species", species)
        .withColumn("_newest", newest)
        .filter(F.col("species").isNotNull())
        .withColumn("recent", F.coalesce(F.col(year), F.lit(0)) >= F.col("_newest") - window)
    )
    cells = grid_rollup(
        can,
        "lng",
        "lat",
        step,
        {
            "recent": F.sum(F.col("recent").cast("bigint")),
            "total": F.count("*"),
            "lng": F.avg("lng"),
            "lat": F.avg("lat"),
            "_s": F.sort_array(F.collect_set(F.when(F.col("recent"), F.col("species")))),  # bounded by the catalogue
        },
    )
    return (
        cells.filter(F.col("recent") >= 1)
        .withColumn("earlier", F.col("total") - F.col("recent"))
        .withColumn("species", F.when(F.size("_s") > 0, F.array_join("_s", ", ")).otherwise("-"))
        .drop("_s")
    )


def borough_rollup(df: DataFrame, group: str, unit: str) -> DataFrame:
    """Mean price, growth, rate and potential per group plus its fastest unit (first by name on ties)."""
    return df.groupBy(group).agg(
        F.count("*").alias("units"),
        F.avg("price").alias("mean_price"),
        F.avg("growth").alias("mean_growth"),
        F.avg("rate").alias("mean_rate"),
        F.avg("potential").alias("mean_potential"),
        F.min_by(unit, F.struct(-F.col("growth"), F.col(unit))).alias("leader"),
    )


def presale_floor(mix: DataFrame, key: str, price: str, available: str) -> DataFrame:
    """Lowest price among unit types that are still available."""
    return mix.filter(F.col(available) > 0).groupBy(key).agg(F.min(price).alias("floor_price"))


def subscribers_by_zone(alerts: DataFrame, zone: str, email: str) -> DataFrame:
    """Distinct (zone, email) rows with the zone's subscriber count; no zone is collected into one value."""
    pairs = alerts.select(zone, email).distinct()
    return pairs.join(pairs.groupBy(zone).agg(F.count("*").alias("subscribers")), zone)


def inventory_by_state(listings: DataFrame, state: str, town: str, minimum: int = 900) -> DataFrame:
    """Listings and distinct towns per state with at least ``minimum`` listings.

    Distinct towns are formed by (state, town) first, so a hot state is split over its towns.
    """
    towns = listings.filter(F.coalesce(F.col(state), F.lit("")) != "").groupBy(state, town).agg(F.count("*").alias("_c"))
    return (
        towns.groupBy(state)
        .agg(F.sum("_c").alias("listings"), F.count(F.when(F.col(town) != "", F.lit(1))).alias("towns"))
        .filter(F.col("listings") >= minimum)
    )


def impact_summary(df: DataFrame, value: str) -> DataFrame:
    """Median multiplier, number of anchors and the reading at 1.05 / 0.95."""
    one = df.agg(F.count("*").alias("anchors")).withColumn("median_multiplier", quantile_value(df, value, 0.5))
    label = (
        F.when(F.col("median_multiplier") > 1.05, "accelerates")
        .when(F.col("median_multiplier") < 0.95, "no accelerating effect")
        .otherwise("neutral")
    )
    return one.withColumn("reading", F.when(F.col("anchors") > 0, label))


def kpi_summary(df: DataFrame, now: str, base: str, rate: str, label: str, covered: Column, prob: float = 0.90) -> DataFrame:
    """One row: mean value, change against base, fast cells, covered units and the fastest unit."""
    q = quantile_value(df, rate, prob)
    return df.withColumn("_q", q).agg(
        F.avg(now).alias("mean_value"),
        ((F.avg(now) / F.avg(base) - 1) * 100).alias("change_pct"),
        F.sum((F.col(rate) >= F.col("_q")).cast("bigint")).alias("fast_cells"),
        F.sum(covered.cast("bigint")).alias("covered"),
        F.min_by(label, F.struct(-(F.col(now) / F.col(base)), F.col(label))).alias("fastest"),
    )


