"""Area and street compositions: dossiers, site selection, market gaps, gentrification signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrametra.functions import geo, text
from terrametra.functions.constants import SECTORS
from terrametra.functions.numeric import add_min_max, clip, half_even
from terrametra.operators.matching import complete_with_zero, override
from terrametra.operators.ranking import quantile_value
from terrametra.operators.rollups import canary_cells, grid_rollup, mode_value, sector_entropy
from terrametra.operators.spatial import nearest, queen_sum, site_scores

STEP = 0.0028


def cell_centre(df: DataFrame, step: float = STEP) -> DataFrame:
    """Centre as published: (index + 0.5) * step, half a cell beside the rounded index."""
    return df.withColumn("lng", (F.col("gx") + 0.5) * step).withColumn("lat", (F.col("gy") + 0.5) * step)


def demand_grid(est: DataFrame, employment: str, competitor: Column | None = None, step: float = STEP) -> DataFrame:
    """Employment, businesses and competitors per cell, with the 3x3 sums as demand and competition."""
    comp = competitor if competitor is not None else F.lit(False)
    cells = grid_rollup(
        est,
        "lng",
        "lat",
        step,
        {"employment": F.sum(employment), "comp": F.sum(F.coalesce(comp, F.lit(False)).cast("bigint")), "n": F.count("*")},
    )
    around = queen_sum(cells, ["employment", "comp"])
    return around.select(
        "gx", "gy", "n", F.col("employment_around").cast("bigint").alias("demand"), F.col("comp_around").alias("competitors")
    )


def name_cells(cells: DataFrame, streets: DataFrame, street: str) -> DataFrame:
    """Name each cell after its nearest street midpoint ``(street, lng, lat)``."""
    return nearest(cells, streets, street).withColumnRenamed("near_id", "street").drop("near_dist")


def site_selection(est: DataFrame, employment: str, competitor: Column, streets: DataFrame, street: str, n: int = 10, minimum: int = 8) -> DataFrame:
    """Top cells of unmet demand for one business line, with street and distance to the nearest competitor."""
    grid = demand_grid(est, employment, competitor)
    scored = cell_centre(site_scores(grid, minimum))
    top = scored.orderBy(F.col("score").desc(), "gx", "gy").limit(n)
    named = name_cells(top, streets, street)
    rivals = est.filter(competitor).select("lng", "lat").distinct().withColumn("_site", F.concat_ws(",", "lng", "lat"))
    near = nearest(named, rivals, "_site", metric="haversine")
    return near.withColumn("competitor_m", half_even(F.col("near_dist") * 1000.0)).drop("near_id", "near_dist")


def canary_top(est: DataFrame, species: Column, year: str, streets: DataFrame, street: str, n: int = 10) -> DataFrame:
    """Cells where canary businesses just arrived and were rare before, scored 0-100."""
    cells = canary_cells(est, species, year)
    raw = F.col("recent") / (F.lit(1.0) + 0.8 * F.col("earlier"))
    scored = add_min_max(cells, {"_s": raw}).withColumn("score", half_even(F.col("_s") * 100).cast("bigint")).drop("_s")
    top = scored.orderBy(F.col("score").desc(), F.col("recent").desc(), "gx", "gy").limit(n)
    return name_cells(top, streets, street)


def sismograph_magnitude(streets: DataFrame, report: DataFrame, street: str) -> DataFrame:
    """Scaled 2.2 * indicators + openings - 0.8 * closures per street; streets without a report count as zero."""
    j = streets.select(street).join(report, street, "left").fillna(0, ["openings", "closures", "indicators"]).fillna("—", ["species"])
    raw = 2.2 * F.col("indicators") + F.col("openings") - 0.8 * F.col("closures")
    return add_min_max(j, {"_m": raw}).withColumn("magnitude", half_even(F.col("_m"), 3)).drop("_m")


def gentrification_index(report: DataFrame, canaries: DataFrame, street: str, n: int = 12) -> DataFrame:
    """0-100 early-gentrification index per street, or no row when no canary scores above zero.

    ``report(street, openings, closures, indicators)``; ``canaries(street, score, recent, species)`` per cell.
    """
    best = canaries.groupBy(street).agg(
        F.max("score").alias("canaries"), F.sum("recent").alias("recent"), F.max_by("species", F.struct("score", "recent")).alias("new_species")
    )
    base = (
        report.withColumn("net", F.col("openings") - F.col("closures"))
        .join(best, street, "left")
        .fillna(0, ["canaries", "recent"])
        .fillna("—", ["new_species"])
    )
    parts = add_min_max(
        base,
        {"_c": F.col("canaries").cast("double"), "_n": F.greatest(F.col("net"), F.lit(0)).cast("double"), "_i": F.col("indicators").cast("double")},
    )
    index = half_even(100 * (0.5 * F.col("_c") + 0.3 * F.col("_n") + 0.2 * F.col("_i"))).cast("bigint")
    any_canary = base.agg(F.max("canaries")).scalar()
    return (
        parts.withColumn("index", index)
        .withColumn("_any", any_canary)
        .filter((F.col("_any") > 0) & (F.col("index") > 0))
        .drop("_c", "_n", "_i", "_any")
        .orderBy(F.col("index").desc(), F.col("recent").desc(), street)
        .limit(n)
    )


def market_gaps(profile: DataFrame, counts: DataFrame, street: str, sector: str, n: int = 15, sectors: list[str] = SECTORS) -> DataFrame:
    """Missing business lines: ``employment * (0.5 + anchor) / (1 + 2.5 * shops)`` scaled, top ``n``.

    ``profile(street, employment, anchor_proximity)``; ``counts(street, sector, shops)``.
    """
    full = complete_with_zero(profile.select(street, "employment", "anchor_proximity"), [street], sector, sectors, counts, "shops")
    gap = F.col("employment") * (0.5 + F.col("anchor_proximity")) / (1 + 2.5 * F.col("shops"))
    scored = add_min_max(full, {"_g": gap})
    return scored.orderBy(F.col("_g").desc(), street, sector).limit(n).withColumn("gap_score", half_even(F.col("_g"), 2)).drop("_g")


def anchor_proximity(df: DataFrame, anchors: DataFrame, sigma: float = 0.012) -> DataFrame:
    """Sum of weighted Gaussian kernels around the employment anchors (a list of six, packed into one value)."""
    pack = anchors.agg(F.sort_array(F.collect_list(F.struct("lng", "lat", "weight"))).alias("a"))
    out = df.withColumn("_a", pack.scalar())
    total = F.aggregate(
        "_a",
        F.lit(0.0),
        lambda s, a: s + a["weight"] * geo.gaussian(geo.planar_sq(F.col("lng"), F.col("lat"), a["lng"], a["lat"]), sigma),
    )
    return out.withColumn("_prox", total).drop("_a")


def street_profile(streets: DataFrame, est: DataFrame, street: str, sector: str, employment: str) -> DataFrame:
    """Streets with their businesses, employment and leading sector; empty streets get defaults."""
    totals = est.groupBy(street).agg(F.count("*").alias("n_estab"), F.sum(employment).alias("employment"))
    return (
        streets.join(totals, street, "left")
        .join(mode_value(est, [street], sector, "sector"), street, "left")
        .fillna(0, ["n_estab", "employment"])
        .fillna("Servicios", ["sector"])
    )


def street_dossier(streets: DataFrame, est: DataFrame, anchors: DataFrame, street: str, sector: str, employment: str, year: str, sectors: list[str] = SECTORS) -> DataFrame:
    """Vitality, anchor proximity, value, potential, diversity and renewal of every street ``(street, lng, lat)``."""
    df = street_profile(streets, est, street, sector, employment)
    raw = F.log1p(F.col("n_estab").cast("double")) + 0.6 * F.log1p(F.col("employment").cast("double"))
    df = add_min_max(df, {"_vital": raw, "_busy": F.col("n_estab").cast("double")})
    df = anchor_proximity(df, anchors)
    near = clip(F.col("_prox"), 0, 1)
    diversity = sector_entropy(est, [street], sector, "_h", classes=len(sectors), all_classes=sectors)
    cut = quantile_value(est, year, 0.6)
    fresh = est.withColumn("_cut", cut).groupBy(street).agg(F.sum((F.col(year) >= F.col("_cut")).cast("bigint")).alias("recent_openings"))
    out = df.join(diversity, street, "left").join(fresh, street, "left").fillna(0, ["recent_openings"])
    return out.select(
        street,
        "lng",
        "lat",
        "n_estab",
        "employment",
        "sector",
        half_even(F.col("_vital"), 3).alias("vitality"),
        half_even(clip(F.col("_prox"), 0, 1.3), 3).alias("anchor_proximity"),
        half_even(9000 + 9500 * F.col("_vital") + 6500 * near).alias("value"),
        half_even(clip(0.50 * near + 0.35 * (1 - F.col("_vital")) + 0.15 * F.col("_busy"), 0.02, 1), 3).alias("potential"),
        half_even(F.coalesce("_h", F.lit(0.0)), 3).alias("resilience"),
        "recent_openings",
        ((F.col("recent_openings") == 0) & (F.col("n_estab") >= 10)).alias("stagnant"),
    )


def vitality(df: DataFrame, n: str, employment: str, name: str = "vitality") -> DataFrame:
    """Scaled ln(1 + businesses) + 0.6 * scaled ln(1 + employment)."""
    inner = add_min_max(df, {"_e": F.log1p(F.col(employment).cast("double"))})
    return add_min_max(inner, {name: F.log1p(F.col(n).cast("double")) + 0.6 * F.col("_e")}).drop("_e")


def economic_dossier(areas: DataFrame, rollup: DataFrame, metros: DataFrame, key: str) -> DataFrame:
    """Area dossier: gradient to the nearest metro, observed vitality, price and potential.

    ``areas(key, lng, lat, state_price, state_potential)``, ``rollup(key, n_estab, employment, resilience,
    indicators)``, ``metros(metro, lng, lat)``. Areas without businesses keep the modelled values.
    """
    df = nearest(areas, metros, "metro")
    d = F.col("near_dist")
    ring = F.exp(-F.pow((d - 0.22) / 0.22, F.lit(2.0)))
    df = (
        df.withColumn("metro_km", half_even(d * 105))
        .withColumn("_ring", ring)
        .withColumn("_model_price", F.col("state_price") * (0.42 + 0.78 * F.exp(-F.pow(d / 0.30, F.lit(2.0)))))
        .withColumn("_model_pot", clip(0.55 * F.col("state_potential") + 0.50 * ring, 0.02, 1))
        .withColumnRenamed("near_id", "metro")
        .drop("near_dist")
    )
    base = df.withColumn("n_estab", F.lit(0).cast("bigint")).withColumn("employment", F.lit(0.0)).withColumn("resilience", F.lit(0.0)).withColumn("indicators", F.lit(0).cast("bigint"))
    j = override(base, rollup, [key], ["n_estab", "employment", "resilience", "indicators"])
    j = add_min_max(vitality(j, "n_estab", "employment", "_vital"), {"_ind": F.col("indicators").cast("double")})
    has = F.col("n_estab") > 0
    pot = clip(0.45 * F.col("_model_pot") + 0.30 * F.col("_ring") + 0.25 * F.col("_ind"), 0.02, 1)
    return j.select(
        key,
        "metro",
        "metro_km",
        "n_estab",
        "employment",
        "resilience",
        "indicators",
        F.when(has, F.col("_vital")).alias("vitality"),
        half_even(F.when(has, F.col("state_price") * (0.35 + 1.3 * F.col("_vital"))).otherwise(F.col("_model_price"))).alias("price"),
        half_even(F.when(has, pot).otherwise(F.col("_model_pot")), 3).alias("potential"),
    )


def competitor_flag(name: Column, keywords: list[str]) -> Column:
    return text.contains_any(F.upper(F.coalesce(name, F.lit(""))), keywords)


def densest_block(points: DataFrame, street: str, step: float = 0.005) -> DataFrame:
    """Points of each street inside the 3x3 block around its fullest cell (ties: smallest cell)."""
    gx, gy = F.rint(F.col("lng") / step).cast("bigint"), F.rint(F.col("lat") / step).cast("bigint")
    cells = points.groupBy(street, gx.alias("cx"), gy.alias("cy")).agg(F.count("*").alias("c"))
    top = cells.groupBy(street).agg(F.min_by(F.struct("cx", "cy"), F.struct(-F.col("c"), F.col("cx"), F.col("cy"))).alias("_t"))
    near = (F.abs(gx - F.col("_t.cx")) <= 1) & (F.abs(gy - F.col("_t.cy")) <= 1)
    return points.join(top, street).filter(near).drop("_t")


def street_axes(points: DataFrame, street: str, tie: str, minimum: int = 4, vertices: int = 12) -> DataFrame:
    """A clean polyline per street: points projected on their principal axis, up to ``vertices`` evenly ranked.

    The axis of two coordinates has a closed form in the (co)variances, so it is one aggregate. Ranks come
    from range-partitioned positions, so a street with a third of all points is still split.
    """
    from terrametra.operators.ranking import ordered_positions

    enough = points.groupBy(street).agg(F.count("*").alias("_n")).filter(F.col("_n") >= minimum).select(street)
    dense = densest_block(points.join(enough, street, "left_semi"), street)
    axis = (
        dense.groupBy(street)
        .agg(
            F.avg("lng").alias("mx"),
            F.avg("lat").alias("my"),
            F.var_pop("lng").alias("vx"),
            F.var_pop("lat").alias("vy"),
            F.covar_pop("lng", "lat").alias("c"),
            F.count("*").alias("_n"),
        )
        .filter(F.col("_n") >= minimum)
        .withColumn("ang", 0.5 * F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy")))
    )
    proj = (F.col("lng") - F.col("mx")) * F.cos("ang") + (F.col("lat") - F.col("my")) * F.sin("ang")
    placed = dense.join(axis.select(street, "mx", "my", "ang"), street).select(street, "lng", "lat", tie, F.round(proj, 12).alias("proj"))
    ranked = ordered_positions(placed, ["proj", "lng", "lat", tie], keys=[street])
    last = vertices - 1
    slots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: F.floor(k * (F.col("group_rows") - 1) / F.lit(last)).cast("bigint")))
    chosen = ranked.filter(F.array_contains(slots, F.col("position")))
    return chosen.groupBy(street).agg(
        F.array_sort(F.collect_list(F.struct("position", F.bround("lng", 5).alias("lng"), F.bround("lat", 5).alias("lat")))).alias("_p")
    ).select(street, F.transform("_p", lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("path"))


def street_midpoints(streets: DataFrame, street: str, path: str = "path") -> DataFrame:
    m = geo.mean_point(F.col(path))
    return streets.select(street, m["lng"].alias("lng"), m["lat"].alias("lat"))


