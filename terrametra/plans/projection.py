"""Spatial diffusion of values over an edge table and what is read from its trajectories.

``v[t+1] = v[t] * (1 + growth + rho * scale * lag(scaled v[t]) * potential)``. The recursion is sequential in t,
so each step is one edge join, one aggregate and one reliable checkpoint; within a step all cells and scenarios
run in parallel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrametra.functions.numeric import EPS
from terrametra.session import durable

POTENTIAL_MAX = 1.35


def scenario_rows(cells: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Replicate the cells for a short list of scenarios (``scenario, rho, growth_factor, potential_offset``)."""
    rows = F.array(
        *[
            F.struct(
                F.lit(s["scenario"]).alias("scenario"),
                F.lit(float(s["rho"])).alias("rho"),
                F.lit(float(s.get("growth_factor", 1.0))).alias("gf"),
                F.lit(float(s.get("potential_offset", 0.0))).alias("po"),
            )
            for s in scenarios
        ]
    )
    return cells.withColumn("_s", F.explode(rows))


def project(
    cells: DataFrame,
    edges: DataFrame,
    steps: int = 10,
    rho: float = 1.0,
    scale: float = 0.10,
    bump_year: int | None = None,
    bump_strength: float = 0.0,
    scenarios: list[dict] | None = None,
) -> DataFrame:
    """Trajectories ``(scenario, cell_id, t, value)`` for t = 0..steps.

    ``cells(cell_id, value, potential, growth[, bump])``; ``edges(src, dst)`` directed. With ``bump_year`` the
    potential rises by ``bump_strength * bump`` in that year, clipped to 0..1.35. Each step writes its own rows once.
    """
    scenarios = scenarios or [{"scenario": 0, "rho": rho}]
    offset_used = any(s.get("potential_offset") for s in scenarios)
    pot = F.col("potential") + F.col("_s")["po"]
    if offset_used:
        pot = F.least(F.greatest(pot, F.lit(0.0)), F.lit(POTENTIAL_MAX))
    bump = F.col("bump") if "bump" in cells.columns else F.lit(0.0)
    state = scenario_rows(cells, scenarios).select(
        F.col("_s")["scenario"].alias("scenario"),
        "cell_id",
        F.col("value").cast("double").alias("v"),
        pot.alias("p"),
        (F.col("growth") * F.col("_s")["gf"]).alias("g"),
        F.col("_s")["rho"].alias("r"),
        bump.alias("b"),
    )
    links = durable(edges.select("src", "dst").repartition("dst"))
    state = durable(state)
    years = [state.select("scenario", "cell_id", F.lit(0).alias("t"), F.col("v").alias("value"))]
    for t in range(steps):
        p = F.col("p")
        if bump_year is not None and t == bump_year:
            p = F.least(F.greatest(p + F.lit(bump_strength) * F.col("b"), F.lit(0.0)), F.lit(POTENTIAL_MAX))
        span = state.groupBy("scenario").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        spread = F.broadcast(span)  # one row per scenario
        scaled = state.join(spread, "scenario").select(
            "scenario", F.col("cell_id").alias("dst"), ((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(EPS))).alias("x")
        )
        lag = links.join(scaled, "dst").groupBy("scenario", F.col("src").alias("cell_id")).agg((F.sum("x") / F.count("*")).alias("lag"))
        nxt = state.withColumn("p", p).join(lag, ["scenario", "cell_id"], "left")
        v = F.col("v") * (1 + F.col("g") + F.col("r") * F.lit(scale) * F.coalesce("lag", F.lit(0.0)) * F.col("p"))
        state = durable(nxt.select("scenario", "cell_id", v.alias("v"), "p", "g", "r", "b"))
        years.append(state.select("scenario", "cell_id", F.lit(t + 1).alias("t"), F.col("v").alias("value")))
    return reduce(DataFrame.unionByName, years)


def gaussian_bump(cells: DataFrame, lng: float, lat: float, radius: float) -> DataFrame:
    """Add ``bump``: a Gaussian around a chosen point."""
    d = (F.col("lng") - lng) * (F.col("lng") - lng) + (F.col("lat") - lat) * (F.col("lat") - lat)
    return cells.withColumn("bump", F.exp(-d / (2 * radius * radius)))


def growth_attribution(trace: DataFrame, cells: DataFrame, edges: DataFrame, rho: float, scale: float = 0.10, bump_year: int | None = None, bump_strength: float = 0.0):
    """Split every yearly increment into own growth and each neighbour's share.

    Returns (per cell and year ``own, contagion``, per cell and neighbour ``total``).
    """
    steps = trace.agg(F.max("t")).scalar()
    t = trace.select("cell_id", "t", "value")
    span = t.groupBy("t").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    start = t.withColumn("_n", steps).filter(F.col("t") < F.col("_n")).drop("_n").join(F.broadcast(span), "t")  # one row per year
    p = F.col("potential")
    if bump_year is not None:
        raised = F.least(F.greatest(p + F.lit(bump_strength) * F.col("bump"), F.lit(0.0)), F.lit(POTENTIAL_MAX))
        p = F.when(F.col("t") >= bump_year, raised).otherwise(p)
    extra = ["bump"] if "bump" in cells.columns else []
    base = start.join(cells.select("cell_id", "potential", "growth", *extra), "cell_id").select(
        "cell_id", "t", "value", "growth", p.alias("p"), ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(EPS))).alias("x")
    )
    degree = edges.groupBy("src").agg(F.count("*").alias("deg"))
    links = edges.join(degree, "src")
    flows = (
        links.join(base.select(F.col("cell_id").alias("dst"), "t", "x"), "dst")
        .join(base.select(F.col("cell_id").alias("src"), "t", "value", "p"), ["src", "t"])
        .withColumn("amount", F.col("value") * rho * scale * F.col("p") * F.col("x") / F.col("deg"))
    )
    caught = flows.groupBy(F.col("src").alias("cell_id"), "t").agg(F.sum("amount").alias("contagion"))
    yearly = (
        base.join(caught, ["cell_id", "t"], "left")
        .select("cell_id", (F.col("t") + 1).alias("year"), (F.col("value") * F.col("growth")).alias("own"), F.coalesce("contagion", F.lit(0.0)).alias("contagion"))
    )
    by_neighbour = flows.groupBy(F.col("src").alias("cell_id"), F.col("dst").alias("neighbour")).agg(F.sum("amount").alias("total"))
    return yearly, by_neighbour


def scenario_bands(trajectories: DataFrame, probs: tuple[float, ...] = (0.10, 0.50, 0.90)) -> DataFrame:
    """P10/P50/P90 of the value per cell and year over the scenarios (a short list)."""
    return trajectories.groupBy("cell_id", "t").agg(*[F.percentile("value", p).alias(f"p{round(p * 100):02d}") for p in probs])


def calibrate_rho(cells: DataFrame, edges: DataFrame, observed: DataFrame, rhos: list[float], steps: int, scale: float = 0.10) -> DataFrame:
    """Mean absolute percentage error of projected growth for each coupling in the grid.

    ``observed(cell_id, first, last)``; the projection starts at ``first``. All couplings run as scenarios of
    one projection.
    """
    base = cells.join(observed, "cell_id").withColumn("value", F.col("first"))
    runs = project(base, edges, steps=steps, scale=scale, scenarios=[{"scenario": i, "rho": r} for i, r in enumerate(rhos)])
    final = runs.filter(F.col("t") == steps).join(observed, "cell_id")
    real = F.col("last") / F.col("first") - 1
    err = F.abs(F.col("value") / F.col("first") - 1 - real) / (F.abs(real) + F.lit(EPS))
    table = F.array(*[F.lit(float(r)) for r in rhos])
    return final.groupBy("scenario").agg((F.avg(err) * 100).alias("mape")).withColumn("rho", F.get(table, F.col("scenario")))


def best_rho(errors: DataFrame) -> DataFrame:
    """The first coupling with the smallest error."""
    return errors.agg(F.min_by(F.struct("rho", "mape"), F.struct("mape", "scenario")).alias("b")).select("b.*")


def fit_errors(cells_final: DataFrame, observed: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` units with the smallest absolute growth error (percentage points)."""
    j = cells_final.join(observed, "cell_id")
    err = F.abs((F.col("value") / F.col("first") - 1) - (F.col("last") / F.col("first") - 1)) * 100
    return j.select("cell_id", err.alias("error_pp")).orderBy("error_pp", "cell_id").limit(n)


def value_at(trajectories: DataFrame, year: float, steps: int, keys: list[str] | None = None) -> DataFrame:
    """Value at a fractional year, its yearly rate and the start value; one aggregate, no self-join."""
    keys = keys or ["cell_id"]
    t0 = int(min(max(int(year // 1), 0), steps))
    t1 = min(t0 + 1, steps)
    f = min(max(year - t0, 0.0), 1.0)
    at = lambda t: F.max(F.when(F.col("t") == t, F.col("value")))
    wide = trajectories.groupBy(*keys).agg(at(t0).alias("a"), at(t1).alias("b"), at(max(t0 - 1, 0)).alias("c"), at(0).alias("base"))
    rate = (F.col("b") - F.col("a")) / F.col("a") if t1 > t0 else (F.col("a") - F.col("c")) / F.col("c")
    return wide.select(*keys, (F.col("a") * (1 - f) + F.col("b") * f).alias("value"), rate.alias("rate"), "base")


def extend_back(trajectories: DataFrame, years: int = 5, damping: float = 0.8, keys: list[str] | None = None) -> DataFrame:
    """Prepend ``years`` earlier points at a damped first-year growth; t runs from -years."""
    keys = keys or ["cell_id"]
    at = lambda t: F.max(F.when(F.col("t") == t, F.col("value")))
    first = trajectories.filter(F.col("t") <= 1).groupBy(*keys).agg(at(0).alias("a"), at(1).alias("b"))
    r = (F.col("b") / F.col("a") - 1) * damping
    back = first.select(*keys, r.alias("r"), "a", F.explode(F.sequence(F.lit(1), F.lit(years))).alias("k")).select(
        *keys, (-F.col("k")).alias("t"), (F.col("a") / F.pow(1 + F.col("r"), F.col("k"))).alias("value")
    )
    return back.unionByName(trajectories.select(*keys, "t", "value"))


def peak_year(yearly: DataFrame, key: str = "cell_id", amount: str = "increment", year: str = "year") -> DataFrame:
    """Year of the largest increment per unit, the first on ties."""
    return yearly.groupBy(key).agg(F.max_by(year, F.struct(F.col(amount), -F.col(year))).alias("peak_year"))


def leaders(trajectories: DataFrame, steps: int, n: int = 8, key: str = "cell_id") -> DataFrame:
    """All years of the ``n`` units with the largest final growth."""
    ends = trajectories.filter(F.col("t").isin(0, steps)).groupBy(key).agg(
        (F.max(F.when(F.col("t") == steps, F.col("value"))) / F.max(F.when(F.col("t") == 0, F.col("value"))) - 1).alias("growth")
    )
    top = ends.orderBy(F.col("growth").desc(), key).limit(n)
    return trajectories.join(F.broadcast(top), key)  # n rows
