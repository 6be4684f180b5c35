"""Result tables over trajectories and markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrametra.functions import text
from terrametra.functions.numeric import half_even
from terrametra.operators.matching import slug_fallback_join
from terrametra.operators.ranking import threshold_class
from terrametra.operators.stats import composite_score
from terrametra.plans.projection import leaders, value_at


def ranking_table(cells: DataFrame, trajectories: DataFrame, year: float, steps: int, flows: DataFrame | None = None) -> DataFrame:
    """Score, price now and at ``year``, growth, rate and potential of every unit, with inbound flows.

    ``cells(cell_id, name, potential, ...)``; ``flows(target)`` names the unit that receives a flow.
    """
    at = value_at(trajectories, year, steps)
    j = cells.drop("value", "growth").join(at, "cell_id")
    scored = composite_score(j, "value", "base", "potential", "rate")
    if flows is not None:
        inbound = flows.groupBy(F.col("target").alias("cell_id")).agg(F.count("*").alias("inbound"))
        scored = scored.join(inbound, "cell_id", "left").fillna(0, ["inbound"])
    return scored


def top_units(table: DataFrame, n: int = 40) -> DataFrame:
    return table.orderBy(F.col("growth").desc(), "cell_id").limit(n)


def phase_table(cells: DataFrame, trajectories: DataFrame, year: float, steps: int) -> DataFrame:
    """Price against rate per unit with the contagion class (0.85 and 0.55 rate quantiles)."""
    at = value_at(trajectories, year, steps).join(cells.select("cell_id", "name", "potential"), "cell_id")
    return threshold_class(at, "rate", [(0.85, "mutation"), (0.55, "expansion")], "latent", "phase").withColumn("rate_pct", F.col("rate") * 100)


def trajectory_table(trajectories: DataFrame, steps: int, bands: DataFrame | None = None, n: int = 8) -> DataFrame:
    """Every year of the ``n`` fastest units; the leader also carries its band."""
    top = leaders(trajectories, steps, n)
    if bands is None:
        return top
    lead = top.filter(F.col("t") == 0).agg(F.min_by("cell_id", F.struct(-F.col("growth"), F.col("cell_id")))).scalar()
    j = top.join(bands, ["cell_id", "t"], "left").withColumn("_lead", lead)
    keep = [c for c in bands.columns if c not in ("cell_id", "t")]
    for c in keep:
        j = j.withColumn(c, F.when(F.col("cell_id") == F.col("_lead"), F.col(c)))
    return j.drop("_lead")


def live_market_lines(units: DataFrame, key: str, candidates: list[Column], metrics: DataFrame) -> DataFrame:
    """Market median text per unit, empty when no market matches its name.

    ``metrics(slug, pm2_sale, n_sale)``.
    """
    j = slug_fallback_join(units, key, candidates, metrics, "slug")
    count = F.when(F.col("n_sale") > 0, F.concat(F.format_number("n_sale", 0), F.lit(" sales"))).otherwise("list price")
    line = F.concat(text.money(F.col("pm2_sale").cast("double")), F.lit("/m2 ("), count, F.lit(")"))
    return j.withColumn("market_line", F.when(F.col("pm2_sale") > 0, line).otherwise(""))


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    for c, d in digits.items():
        df = df.withColumn(c, half_even(F.col(c), d))
    return df
