"""Annual index panels: growth rates, ensemble forecast, walk-forward evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrametra.functions.constants import BAND_FACTOR, BASE_WEIGHTS, SPATIAL_WEIGHTS
from terrametra.functions.numeric import growth
from terrametra.operators.ranking import exact_quantiles, expanding_quantiles
from terrametra.session import durable
from terrametra.operators.spatial import inverse_distance_mean


def zone_series(panel: DataFrame) -> DataFrame:
    """One row per zone with its yearly index as a map (a few dozen entries) and its first and last year."""
    return panel.filter(F.col("idx").isNotNull()).groupBy("zone").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "idx"))).alias("s")
    )


def growth_rates(panel: DataFrame, first: int, last: int) -> DataFrame:
    """Per zone and origin year t: ``g1``, ``g3``, the level ``x`` and the series; NULL where a year is missing or zero."""
    at = lambda y: F.try_element_at("s", y)
    t = F.col("t")
    grid = zone_series(panel).withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.select(
        "zone",
        "t",
        at(t).alias("x"),
        growth(at(t - 1), at(t), 1).alias("g1"),
        growth(at(t - 3), at(t), 3).alias("g3"),
        "s",
    )


def ensemble_rates(panel: DataFrame, coords: DataFrame, first: int, last: int, horizons: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Modelled yearly rate per zone, origin and horizon.

    Half momentum, trend and national mean; half the same with the distance-weighted neighbours' trend. A
    neighbour without trend, or with exactly zero trend, counts with the national mean.
    """
    rates = growth_rates(panel.join(coords.select("zone"), "zone", "left_semi"), first, last)
    national = rates.groupBy("t").agg(F.avg("g3").alias("nat"))
    r = rates.join(F.broadcast(national), "t")  # one row per year
    filled = F.when(F.col("g3").isNull() | (F.col("g3") == 0), F.col("nat")).otherwise(F.col("g3"))
    spots = r.select("zone", "t", filled.alias("trend")).join(coords.select("zone", "lat", "lng"), "zone")
    near = inverse_distance_mean(spots, "zone", "trend", by=["t"])
    r = r.join(near, ["t", "zone"], "left")
    b1, b2, b3 = BASE_WEIGHTS
    table = F.array(
        *[
            F.struct(F.lit(h).alias("h"), *[F.lit(w).alias(f"w{i}") for i, w in enumerate(SPATIAL_WEIGHTS.get(h, SPATIAL_WEIGHTS[3]))])
            for h in horizons
        ]
    )
    r = r.withColumn("w", F.explode(table))
    g1, g3, nat, nb = F.col("g1"), F.col("g3"), F.col("nat"), F.col("trend_near")
    base = b1 * g1 + b2 * g3 + b3 * nat
    spatial = F.col("w.w0") * g1 + F.col("w.w1") * g3 + F.col("w.w2") * nat + F.col("w.w3") * nb
    rate = F.when(g1.isNotNull() & g3.isNotNull(), 0.5 * base + 0.5 * spatial)
    return r.select("zone", "t", F.col("w.h").alias("h"), rate.alias("rate"), "g1", "nat", "x", F.try_element_at("s", F.col("t") + F.col("w.h")).alias("x_next"))


def evaluate_rows(rates: DataFrame) -> DataFrame:
    """Realised and predicted change with residual, where origin and target both exist."""
    h = F.col("h")
    ok = F.col("x").isNotNull() & F.col("x_next").isNotNull() & F.col("rate").isNotNull()
    real = F.col("x_next") / F.col("x") - 1
    pred = F.pow(1 + F.col("rate"), h) - 1
    return rates.filter(ok).select(
        "zone",
        "t",
        "h",
        real.alias("real"),
        pred.alias("pred"),
        (F.pow(1 + F.col("g1"), h) - 1).alias("persist"),
        (F.pow(1 + F.col("nat"), h) - 1).alias("national"),
        (real - pred).alias("resid"),
    )


def expanding_bands(rows: DataFrame, last: int, minimum: int = 20, strict: bool = True) -> DataFrame:
    """5 / 95 % residual quantiles of earlier origins per (h, t), widened by the band factor.

    ``strict`` uses only residuals whose target year is known at the origin (t' + h <= t); otherwise all
    earlier origins (t' < t). A residual is counted once; only those near a wanted rank are sent to an origin.
    """
    lead = F.col("h") if strict else F.lit(1)
    tails = expanding_quantiles(rows.select("h", (F.col("t") + lead).alias("t"), "resid"), ["h"], "t", last, "resid", {"lo": 0.05, "hi": 0.95})
    k = F.create_map(*[F.lit(x) for kv in BAND_FACTOR.items() for x in kv])
    factor = F.coalesce(F.try_element_at(k, F.col("h")), F.lit(BAND_FACTOR[3]))
    return tails.filter(F.col("n") >= minimum).select("h", "t", (F.col("lo") * factor).alias("lo"), (F.col("hi") * factor).alias("hi"))


def walk_forward(panel: DataFrame, coords: DataFrame, first: int, last: int, horizons: tuple[int, ...] = (1, 3), strict: bool = True, minimum: int = 20) -> DataFrame:
    """Rolling-origin evaluation: error of the model and two baselines in points, and band coverage per horizon."""
    # small (zones x origins x horizons) and read several times below
    rows = durable(evaluate_rows(ensemble_rates(panel, coords, first, last - min(horizons), horizons).filter(F.col("t") + F.col("h") <= last)))
    bands = expanding_bands(rows, last, minimum, strict)
    j = rows.join(bands, ["h", "t"], "left")
    inside = (F.col("real") >= F.col("pred") + F.col("lo")) & (F.col("real") <= F.col("pred") + F.col("hi"))
    return mae_table(j.withColumn("inside", inside))


def mae_table(rows: DataFrame) -> DataFrame:
    """Mean absolute errors (points), rows, origins and share inside the band, per horizon."""
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col("real")) * 100)
    return rows.groupBy("h").agg(
        mae("pred").alias("mae_model"),
        mae("persist").alias("mae_persistence"),
        mae("national").alias("mae_national"),
        F.count("*").alias("n"),
        F.countDistinct("t").alias("origins"),
        (F.avg(F.col("inside").cast("double")) * 100).alias("coverage_pct"),
    )


def forecast(panel: DataFrame, coords: DataFrame, origin: int, first: int, horizons: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Multipliers with bands per zone and horizon from one origin year.

    Horizons 1 and 3 use their own rate and residual band; longer ones extrapolate the three-year rate and
    scale its band by h / 3. The lower bound never falls below 0.5.
    """
    rates = durable(ensemble_rates(panel, coords, first, origin, (1, 3)))
    rows = durable(evaluate_rows(rates.filter(F.col("t") + F.col("h") < origin)))
    k = F.create_map(*[F.lit(x) for kv in BAND_FACTOR.items() for x in kv])
    bands = (
        exact_quantiles(rows, ["h"], "resid", {"lo": 0.05, "hi": 0.95})
        .select(F.col("h").alias("base_h"), (F.col("lo") * k[F.col("h")]).alias("lo"), (F.col("hi") * k[F.col("h")]).alias("hi"))
    )
    targets = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(h if h in (1, 3) else 3).alias("base_h")) for h in horizons])
    now = rates.filter((F.col("t") == origin) & F.col("rate").isNotNull()).select("zone", F.col("h").alias("base_h"), "rate")
    out = now.withColumn("_t", F.explode(targets)).filter(F.col("_t.base_h") == F.col("base_h")).join(F.broadcast(bands), "base_h")  # one row per horizon
    h = F.col("_t.h")
    stretch = F.when(h.isin(1, 3), F.lit(1.0)).otherwise(h / 3.0)
    f = F.pow(1 + F.col("rate"), h)
    return out.select(
        "zone",
        h.alias("h"),
        f.alias("f"),
        F.greatest(f + F.col("lo") * stretch, F.lit(0.5)).alias("lo"),
        (f + F.col("hi") * stretch).alias("hi"),
        F.col("rate").alias("g1"),
    )


def last_valid(series: DataFrame, key: str, date: str, raw: str) -> DataFrame:
    """Last usable observation and its date per series; markers and blanks are missing."""
    v = F.regexp_replace(F.trim(F.col(raw)), ",", "").try_cast("double")
    return series.withColumn("_v", v).filter(F.col("_v").isNotNull()).groupBy(key).agg(
        F.max_by("_v", F.col(date)).alias("value"), F.max(date).alias("as_of")
    )


def year_over_year(series: DataFrame, key: str, date: str, raw: str, lag: int = 12) -> DataFrame:
    """Change of the last valid observation against the one ``lag`` valid observations before, in percent."""
    from terrametra.operators.ranking import top_n_per_group

    v = F.regexp_replace(F.trim(F.col(raw)), ",", "").try_cast("double")
    valid = series.withColumn("_v", v).filter(F.col("_v").isNotNull()).select(key, date, "_v")
    tail = top_n_per_group(valid, [key], [F.col(date).desc()], lag + 1)
    return (
        tail.groupBy(key)
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("_v"))).alias("now"),
            F.max(F.when(F.col("rank") == lag + 1, F.col("_v"))).alias("then"),
            F.max(date).alias("as_of"),
        )
        .filter(F.col("then").isNotNull())
        .select(key, F.bround(100.0 * (F.col("now") / F.col("then") - 1), 2).alias("yoy_pct"), "as_of")
    )
