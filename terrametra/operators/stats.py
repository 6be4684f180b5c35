"""Spatial-lag statistics, regressions and similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrametra.functions.numeric import EPS, add_min_max, add_zscore, half_even, half_up, one_row
from terrametra.operators.ranking import quantile_struct, quantile_value, share_at_or_below
from terrametra.operators.rollups import grid_rollup
from terrametra.operators.spatial import queen_sum, radius_count
from terrametra.session import durable


def spatial_lag(cells: DataFrame, edges: DataFrame, value: str, name: str, key: str = "cell_id", by: list[str] | None = None) -> DataFrame:
    """Mean of the neighbours' values per cell; a cell without neighbours gets 0."""
    by = by or []
    vals = cells.select(*by, F.col(key).alias("dst"), F.col(value).alias("_v"))
    lag = edges.join(vals, "dst").groupBy(*by, F.col("src").alias(key)).agg((F.sum("_v") / F.count("*")).alias(name))
    return cells.join(lag, [*by, key], "left").fillna(0.0, [name])


def local_moran(cells: DataFrame, edges: DataFrame, value: str, key: str = "cell_id") -> DataFrame:
    """z-score, neighbour mean of z, and the low-high front flag (z < -.05 and lag > .15)."""
    z = add_zscore(cells, {"z": value})
    out = spatial_lag(z, edges, "z", "lag", key)
    return out.withColumn("front", (F.col("z") < -0.05) & (F.col("lag") > 0.15))


def moran_index(cells: DataFrame, edges: DataFrame, value: str, key: str = "cell_id") -> DataFrame:
    """Global Moran's I over the directed edge list (pair count, unit weights): one row."""
    mean = cells.agg(F.avg(value)).scalar()
    z = cells.withColumn("_mean", mean).select(F.col(key).alias("_k"), (F.col(value) - F.col("_mean")).alias("_z"))
    cross = (
        edges.join(z.select(F.col("_k").alias("src"), F.col("_z").alias("_zi")), "src")
        .join(z.select(F.col("_k").alias("dst"), F.col("_z").alias("_zj")), "dst")
        .agg(F.sum(F.col("_zi") * F.col("_zj")).alias("cross"), F.count("*").alias("pairs"))
    )
    own = z.agg(F.sum(F.col("_z") * F.col("_z")).alias("own"), F.count("*").alias("cells"))
    out = own.withColumn("_c", one_row(cross))
    return out.select(
        (F.col("cells") / F.col("_c")["pairs"] * F.col("_c")["cross"] / (F.col("own") + F.lit(1e-12))).alias("moran"),
        F.col("cells"),
        F.col("_c")["pairs"].alias("pairs"),
    )


def temperature(cells: DataFrame, edges: DataFrame, value: str, key: str = "cell_id") -> DataFrame:
    """Share of cells at or below the own value, its label, and the position against the neighbours (5 %)."""
    ranked = share_at_or_below(cells, value, "share")
    lag = (
        edges.join(cells.select(F.col(key).alias("dst"), F.col(value).alias("_v")), "dst")
        .groupBy(F.col("src").alias(key))
        .agg(F.avg("_v").alias("near_mean"))
    )
    pct = F.col("share") * 100
    label = F.when(pct >= 67, "caliente").when(pct >= 33, "incubando").otherwise("fría")
    v, m = F.col(value), F.col("near_mean")
    rel = F.when(v < 0.95 * m, "below").when(v > 1.05 * m, "above").when(m.isNotNull(), "level")
    return ranked.join(lag, key, "left").withColumn("temperature", label).withColumn("against_near", rel)


def contagion_test(points: DataFrame, year: str, step: float = 0.0027, prob: float = 0.6, accept: float = 0.25) -> DataFrame:
    """Does the activity of a cell and of its neighbours before the cut predict openings after it?

    One row: cells, cut year, Pearson r of the own and of the neighbours' earlier count with the later count.
    """
    box = one_row(points.agg(F.min("lng").alias("x"), F.min("lat").alias("y")))
    cut = quantile_value(points, year, prob)
    placed = points.withColumn("_o", box).withColumn("_cut", cut)
    early = (F.col(year) <= F.col("_cut")).cast("bigint")
    cells = grid_rollup(
        placed, "lng", "lat", step, {"before": F.sum(early), "after": F.sum(1 - early)}, (F.col("_o")["x"], F.col("_o")["y"])
    )
    out = corr_before_after(cells)
    return out.withColumn("cut_year", cut).withColumn("spatial_term_supported", F.col("r_near") > accept)


def corr_before_after(cells: DataFrame) -> DataFrame:
    """Pearson r of the own and of the eight neighbours' earlier count with the later count, over all cells."""
    near = queen_sum(cells, ["before"], include_self=False, suffix="_near")
    return near.agg(
        F.count("*").alias("cells"), F.corr("before", "after").alias("r_own"), F.corr("before_near", "after").alias("r_near")
    )


def hedonic_gradient(df: DataFrame, km: str, price: str, minimum: int = 40, z: float = 1.645) -> DataFrame:
    """ln(price) against distance after trimming both tails: change per km with a 90 % interval, R2 and size.

    Rows: distance at or below its 0.97 quantile, log price between its 0.02 and 0.98 quantiles. No row when
    fewer than ``minimum`` remain or the distances hardly vary.
    """
    # written once: both quantiles and the fit read it
    base = durable(df.select(F.col(km).alias("km"), F.log(F.col(price)).alias("y")))
    far = quantile_value(base, "km", 0.97)
    tails = quantile_struct(base, "y", {"lo": 0.02, "hi": 0.98})
    cut = base.withColumn("_far", far).withColumn("_t", tails)
    kept = cut.filter((F.col("km") <= F.col("_far")) & (F.col("y") >= F.col("_t")["lo"]) & (F.col("y") <= F.col("_t")["hi"]))
    fit = kept.agg(
        F.count("*").alias("n"),
        F.regr_slope("y", "km").alias("b"),
        F.regr_intercept("y", "km").alias("a"),
        F.regr_r2("y", "km").alias("r2"),
        F.regr_sxx("y", "km").alias("sxx"),
        F.regr_syy("y", "km").alias("syy"),
        F.avg("km").alias("km_mean"),
        F.max("km").alias("km_max"),
        F.stddev_pop("km").alias("sd"),
    )
    res = F.greatest(F.col("syy") * (1 - F.col("r2")), F.lit(0.0))
    se = F.sqrt(res / F.greatest(F.col("n") - 2, F.lit(1)) / F.col("sxx"))
    pct = lambda e: (F.exp(e) - 1) * 100
    return fit.filter((F.col("n") >= minimum) & (F.col("sd") >= 0.2)).select(
        "n",
        pct(F.col("b")).alias("pct_per_km"),
        pct(F.col("b") - z * se).alias("pct_low"),
        pct(F.col("b") + z * se).alias("pct_high"),
        "r2",
        "km_mean",
        "km_max",
        F.exp("a").alias("price_at_anchor"),
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def standardize_vectors(df: DataFrame, vector: str, key: str) -> DataFrame:
    """Per-dimension z-scores of an array column (population deviation + 1e-9).

    Means and deviations come from one aggregate by position, with as many groups as dimensions.
    """
    by_place = df.select(F.posexplode(vector).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    whole = F.array_sort(F.collect_list(F.struct("at", "m", "s")))
    stats = by_place.agg(whole["m"].alias("m"), whole["s"].alias("s"))
    out = df.withColumn("_st", one_row(stats))
    z = F.transform(F.col(vector), lambda x, i: (x - F.get(F.col("_st")["m"], i)) / (F.get(F.col("_st")["s"], i) + F.lit(EPS)))
    return out.select(key, z.alias(vector))


def cosine_twins(df: DataFrame, vector: str, key: str, reference, n: int = 10) -> DataFrame:
    """The ``n`` units most similar to one reference unit on z-scored features (clipped to 0..1).

    The reference vector is one row and travels as a scalar, so the search is a scan with a top-n.
    """
    z = standardize_vectors(df, vector, key)
    ref = z.filter(F.col(key) == reference).select(vector).scalar()
    s = z.withColumn("_r", ref)
    norm = F.sqrt(_dot(F.col(vector), F.col(vector))) * F.sqrt(_dot(F.col("_r"), F.col("_r"))) + F.lit(EPS)
    sim = _dot(F.col(vector), F.col("_r")) / norm
    return (
        s.filter(F.col(key) != reference)
        .select(key, sim.alias("_s"))
        .orderBy(F.col("_s").desc(), key)
        .limit(n)
        .select(key, F.least(F.greatest(F.col("_s"), F.lit(0.0)), F.lit(1.0)).alias("similarity"))
    )


def event_study(anchors: DataFrame, points: DataFrame, year: str, degrees: float = 0.004, minimum: int = 3) -> DataFrame:
    """Opening-rate multiplier after large employers arrive, relative to the whole city's trend.

    ``anchors(anchor_id, lng, lat, year, ...)``. Yearly city totals are one row per year and are broadcast.
    """
    yearly = points.groupBy(F.col(year).alias("_y")).agg(F.count("*").alias("_t"))
    near = radius_count(anchors, points, year, degrees)
    years = anchors.select("year").distinct()
    spread = yearly.select(F.explode(F.array(*[F.struct((F.col("_y") - o).alias("year"), F.lit(o).alias("o")) for o in (-2, -1, 1, 2)])).alias("s"), "_t")
    city = spread.select("s.year", "s.o", "_t").groupBy("year").agg(
        F.sum(F.when(F.col("o") < 0, F.col("_t")).otherwise(0)).alias("before_city"),
        F.sum(F.when(F.col("o") > 0, F.col("_t")).otherwise(0)).alias("after_city"),
    )
    city = years.join(city, "year", "left").fillna(0)
    j = near.join(F.broadcast(city), "year")  # one row per anchor year
    ok = (F.col("before_near") >= minimum) & (F.col("before_city") > 0) & (F.col("after_city") > 0) & (F.col("after_near") > 0)
    mult = (F.col("after_near") / F.col("before_near")) / (F.col("after_city") / F.col("before_city"))
    return j.filter(ok).withColumn("multiplier", half_even(mult, 2))


def composite_score(df: DataFrame, now: str, base: str, potential: str, rate: str) -> DataFrame:
    """0-10 score: .40 growth + .25 potential + .20 rate + .15 (1 - price), all scaled over the frame."""
    grown = df.withColumn("growth", F.col(now) / F.col(base) - 1)
    s = add_min_max(grown, {"_g": F.col("growth"), "_r": F.col(rate), "_p": F.col(now)})
    raw = 0.40 * F.col("_g") + 0.25 * F.col(potential) + 0.20 * F.col("_r") + 0.15 * (1 - F.col("_p"))
    return s.withColumn("score", half_even(10 * F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 1)).drop("_g", "_r", "_p")


# Parts of the zone score, their weight and whether low is good.
ZONE_PARTS = [("appreciation", 0.35, False), ("yield", 0.20, False), ("volatility", 0.20, True), ("days_on_market", 0.10, True), ("opportunity", 0.15, False)]
GRADES = [(80, "A"), (65, "B"), (50, "C")]


def zone_score(zones: DataFrame) -> DataFrame:
    """0-100 zone score and A-D grade from five scaled parts; a part without spread scores 50."""
    aggs = []
    for i, (c, _, _) in enumerate(ZONE_PARTS):
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    out = zones.withColumn("_x", one_row(zones.agg(*aggs)))
    total = F.lit(0.0)
    for i, (c, w, inverted) in enumerate(ZONE_PARTS):
        lo, hi = F.col("_x")[f"lo{i}"], F.col("_x")[f"hi{i}"]
        t = F.try_divide(F.col(c) - lo, hi - lo)
        t = 1 - t if inverted else t
        part = F.when(hi == lo, F.lit(50.0)).otherwise(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * 100)
        out = out.withColumn(f"s_{c}", half_up(part))
        total = total + part * w
    grade = F.lit("D")
    for cut, g in reversed(GRADES):
        grade = F.when(F.col("score") >= cut, g).otherwise(grade)
    return out.withColumn("score", half_up(total)).withColumn("grade", grade).drop("_x")


def compounded(rate_pct: Column, years: int = 3) -> Column:
    """Fallback appreciation in percent when a zone has no forecast."""
    return (F.pow(1 + F.coalesce(rate_pct, F.lit(0.0)) / 100, F.lit(float(years))) - 1) * 100


def compare_units(df: DataFrame, key: str, a, b, metrics: dict[str, bool]) -> DataFrame:
    """Two units side by side, one row per metric; ``metrics`` maps each to whether higher wins. NULLs tie."""
    two = df.filter(F.col(key).isin([a, b])).select(key, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = two.unpivot([key], list(metrics), "metric", "value")
    side = long.groupBy("metric").agg(
        F.max(F.when(F.col(key) == a, F.col("value"))).alias("value_a"), F.max(F.when(F.col(key) == b, F.col("value"))).alias("value_b")
    )
    higher = F.create_map(*[F.lit(x) for kv in metrics.items() for x in kv])[F.col("metric")]
    diff = F.col("value_a") - F.col("value_b")
    winner = F.when(diff.isNull() | (diff == 0), "tie").when((diff > 0) == higher, "a").otherwise("b")
    return side.withColumn("winner", winner)


