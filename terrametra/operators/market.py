"""Listings: search, verdicts, snapshot tracking and the investment basket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrametra.functions.numeric import clip, half_up
from terrametra.operators.cleaning import PRICE_WINDOWS
from terrametra.operators.ranking import keep_last, top_n_per_group, upper_median
from terrametra.session import durable


def price_verdict(listings: DataFrame, zone: str = "zone", pm2: str = "pm2", cut: int = 12) -> DataFrame:
    """Percent against the zone's upper-median sale price per m2, and the verdict.

    Zone medians use sales inside the verdict window; the median table has one row per zone.
    """
    lo, hi = PRICE_WINDOWS["verdict"]
    sales = listings.filter((F.col("operation") == "venta") & (F.col(pm2) > lo) & (F.col(pm2) < hi))
    med = upper_median(sales, [zone], pm2, "zone_median")
    vs = F.when(
        (F.col("zone_median") != 0) & (F.col(pm2) != 0), half_up((F.col(pm2) / F.col("zone_median") - 1.0) * 100.0)
    )
    verdict = F.when(F.col("vs") <= -cut, "oportunidad").when(F.col("vs") >= cut, "sobreprecio").when(F.col("vs").isNotNull(), "justo")
    return listings.join(med, zone, "left").withColumn("vs", vs).withColumn("verdict", verdict)


def search_filter(
    operation: str | None = None,
    kind: str | None = None,
    rooms_min: float | None = None,
    baths_min: float | None = None,
    budget_min: float | None = None,
    budget_max: float | None = None,
    m2_min: float | None = None,
    yield_min: float | None = None,
    zones: list[str] | None = None,
) -> Column:
    """Conjunctive predicate; parameters that are missing or zero do not filter."""
    cond = F.lit(True)
    if operation:
        cond = cond & (F.col("operation") == operation)
    if kind:
        cond = cond & F.coalesce(F.col("kind"), F.lit("")).contains(kind.lower())
    bounds = [("rooms", rooms_min, True), ("baths", baths_min, True), ("price", budget_max, False), ("price", budget_min, True), ("m2_built", m2_min, True)]
    for column, value, at_least in bounds:
        if value:
            cond = cond & ((F.col(column) >= value) if at_least else (F.col(column) <= value))
    if yield_min:
        cond = cond & (F.coalesce(F.col("zone_yield"), F.lit(0.0)) >= yield_min)
    if zones:
        cond = cond & F.col("zone").isin(zones)
    return cond


def search_order(order: str, key: str = "id") -> list[Column]:
    """``yield``, ``price_asc``, ``price_desc`` or ``fair_price`` (unknown verdicts last), then the key."""
    first = {
        "yield": F.coalesce(F.col("zone_yield"), F.lit(0.0)).desc(),
        "price_asc": F.col("price").asc(),
        "price_desc": F.col("price").desc(),
        "fair_price": F.coalesce(F.col("vs"), F.lit(999)).asc(),
    }[order]
    return [first, F.col(key)]


def search(listings: DataFrame, order: str = "fair_price", n: int = 24, key: str = "id", **params) -> DataFrame:
    """The ``n`` best matches of a structured search (a top-k report)."""
    return listings.filter(search_filter(**params)).orderBy(*search_order(order, key)).limit(n)


CHANGE = "array<struct<at:date,from:double,to:double>>"

# Published lengths of a price history, of a zone's closure list and of the monthly index.
PUBLISHED_CHANGES = 10
PUBLISHED_CLOSURES = 500
PUBLISHED_MONTHS = 60


def diff_snapshot(snapshot: DataFrame, tracked: DataFrame, today: str, keys: list[str], max_changes: int | None = None) -> DataFrame:
    """Compare a listing snapshot with the tracker, one row per listing ever seen in either.

    ``snapshot(keys, price, currency)``; ``tracked(keys, first_seen, price, currency, changes)``. Columns of
    the result: ``status`` (new, same, cut, raised, reset, closed), the new tracker fields and, for closed
    listings, the days on the market. A changed currency restarts the listing's history. ``max_changes``, such as
    ``PUBLISHED_CHANGES``, keeps the newest changes only; all by default.
    """
    now = F.to_date(F.lit(today))
    cur = keep_last(
        snapshot.filter((F.col("price") > 0)).withColumn("currency", F.coalesce("currency", F.lit("MXN"))), keys, ["price", "currency"]
    ).withColumnRenamed("price", "_p").withColumnRenamed("currency", "_m")
    old = tracked.filter((F.col("price") > 0) & F.col("first_seen").isNotNull()).select(
        *keys, F.col("first_seen").alias("_f"), F.col("price").alias("_op"), F.col("currency").alias("_om"), F.col("changes").alias("_ch")
    )
    j = cur.join(old, keys, "full_outer")
    kept = F.col("_p").isNotNull() & F.col("_op").isNotNull() & (F.col("_m") == F.col("_om"))
    moved = kept & (F.col("_p") != F.col("_op"))
    change = F.array(F.struct(now.alias("at"), F.col("_op").alias("from"), F.col("_p").alias("to"))).cast(CHANGE)
    history = F.coalesce(F.col("_ch"), F.array().cast(CHANGE))
    longer = F.concat(history, change)
    tail = longer if max_changes is None else F.slice(longer, F.greatest(F.size(longer) - (max_changes - 1), F.lit(1)), max_changes)
    status = (
        F.when(F.col("_p").isNull(), "closed")
        .when(F.col("_op").isNull(), "new")
        .when(~kept, "reset")
        .when(F.col("_p") < F.col("_op"), "cut")
        .when(F.col("_p") > F.col("_op"), "raised")
        .otherwise("same")
    )
    return j.select(
        *keys,
        status.alias("status"),
        F.when(kept | F.col("_p").isNull(), F.col("_f")).otherwise(now).alias("first_seen"),
        F.coalesce("_p", "_op").alias("price"),
        F.coalesce("_m", "_om").alias("currency"),
        F.when(moved, tail).when(kept | F.col("_p").isNull(), history).otherwise(F.array().cast(CHANGE)).alias("changes"),
        F.when(F.col("_p").isNull(), F.greatest(F.datediff(now, F.col("_f")), F.lit(0))).alias("days_on_market"),
    )


def open_listings(diff: DataFrame, keys: list[str]) -> DataFrame:
    return diff.filter(F.col("status") != "closed").select(*keys, "first_seen", "price", "currency", "changes")


def closures(previous: DataFrame, diff: DataFrame, today: str, keys: list[str], zone: str, cap: int | None = None) -> DataFrame:
    """Closure list per zone: reappeared listings leave, new closures enter.

    ``previous(keys, closed_on, price, days)``. ``cap``, such as ``PUBLISHED_CLOSURES``, keeps each zone's newest; all by default.
    """
    alive = diff.filter(F.col("status").isin("new", "reset")).select(*keys)
    fresh = diff.filter(F.col("status") == "closed").select(
        *keys, F.to_date(F.lit(today)).alias("closed_on"), "price", F.col("days_on_market").alias("days")
    )
    stay = previous.join(alive, keys, "left_anti").join(fresh.select(*keys), keys, "left_anti")
    both = stay.select(*fresh.columns).unionByName(fresh)
    if cap is None:
        return both
    rest = [k for k in keys if k != zone]
    return top_n_per_group(both, [zone], [F.col("closed_on").desc(), *[F.col(k) for k in rest]], cap).drop("rank")


def tracker_totals(diff: DataFrame, zone: str) -> DataFrame:
    count = lambda s: F.sum((F.col("status") == s).cast("bigint"))
    return diff.groupBy(zone).agg(
        (count("new") + count("reset")).alias("added"),
        count("cut").alias("cuts"),
        count("closed").alias("closed"),
        F.sum((F.col("status") != "closed").cast("bigint")).alias("tracked"),
    )


def monthly_index(history: DataFrame, current: DataFrame, keys: list[str], month: str, keep: int | None = None) -> DataFrame:
    """Replace the months present in ``current`` and append them.

    ``keep``, such as ``PUBLISHED_MONTHS``, keeps the newest months only; all by default.
    """
    months = current.select(month).distinct()
    old = history.join(months, month, "left_anti")
    both = old.unionByName(current)
    if keep is None:
        return both
    last = both.select(month).distinct().orderBy(F.col(month).desc()).limit(keep)
    return both.join(F.broadcast(last), month, "left_semi")  # at most ``keep`` rows


# Weight of the zone yield by objective.
YIELD_WEIGHT = {"renta": 1.6, "plusvalia": 0.6, "mixto": 1.0}


def basket_scores(listings: DataFrame, budget: float, objective: str | None = None) -> DataFrame:
    """Score affordable sales: discount to the zone, zone yield, price cut and days on the market.

    Expects ``vs, zone_yield, cut_pct, days_listed, price, operation``.
    """
    weight = YIELD_WEIGHT.get(objective or "mixto", 1.0)
    discount = F.coalesce(clip(-F.col("vs"), -40, 40) / 40.0, F.lit(0.0))
    cut = F.when(F.col("cut_pct") < 0, F.least(F.lit(1.0), F.abs(F.col("cut_pct")) / 15.0)).otherwise(0.0)
    wait = F.when(F.col("days_listed").isNotNull(), F.least(F.lit(1.0), F.col("days_listed") / 180.0)).otherwise(0.0)
    score = discount + weight * F.coalesce(F.col("zone_yield"), F.lit(0.0)) / 12.0 + 0.5 * cut + 0.35 * wait
    ok = (F.col("operation") == "venta") & (F.col("price") > 0) & (F.col("price") <= budget)
    return listings.filter(ok).withColumn("score", score)


def undominated(scored: DataFrame, zone: str, key: str, n: int) -> DataFrame:
    """``zone, key, price, score`` without rows that ``n`` or more other keys of their zone beat in rank at no higher price.

    Each partition is sorted by zone and rank and read once, keeping the ``n`` lowest prices so far; nothing is shuffled, and
    fronts of partitions merge by union. A row left out can never be among ``n`` picks: one of those that beat it is
    still free, fits whenever it fits, and comes first.
    """
    fields = [zone, key, "price", "score"]
    ordered = scored.select(*fields).sortWithinPartitions(zone, -F.col("score"), key, "price")

    def front(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, low = object(), {}
        for batch in batches:
            zones, keys, prices = batch[zone].to_numpy(object), batch[key].to_numpy(object), batch["price"].to_numpy(float)
            borders = [0, *(np.flatnonzero(zones[1:] != zones[:-1]) + 1).tolist(), len(zones)]
            kept = []
            for start, end in zip(borders, borders[1:]):
                if start == end:
                    continue
                if zones[start] != at:
                    at, low = zones[start], {}
                i = start
                while i < end:
                    if len(low) == n:
                        cheaper = np.flatnonzero(prices[i:end] < max(low.values()))
                        if not len(cheaper):
                            break
                        i += int(cheaper[0])
                    kept.append(i)
                    k, p = keys[i], prices[i]
                    if p < low.get(k, np.inf):
                        low[k] = p
                        if len(low) > n:
                            del low[max(low, key=low.get)]
                    i += 1
            yield batch.iloc[kept]

    return ordered.mapInPandas(front, ordered.schema)


def greedy_basket(scored: DataFrame, budget: float, zone: str, key: str, n: int = 3) -> DataFrame:
    """Up to ``n`` picks in score order within the budget, one per zone first, then without that rule.

    Scanning a sorted list and taking what still fits equals taking the best remaining fit again and again,
    because the remaining budget only shrinks. The candidates are read once, for the rows that may be picked at all
    (``undominated``); each pick is an aggregate over these, which are written.
    """
    spark = scored.sparkSession
    fields = [zone, key, "price", "score"]
    if n < 1:
        return spark.createDataFrame([], T.StructType([T.StructField("pick", T.IntegerType()), *scored.select(*fields).schema]))
    scored = durable(undominated(scored.filter(F.col("price") <= budget), zone, key, n))
    picks, spent = [], 0.0
    for spread in (True, False):
        while len(picks) < n:
            cand = scored.filter(F.col("price") <= budget - spent)
            if picks:
                cand = cand.filter(~F.col(key).isin([p[key] for p in picks]))
                if spread:
                    cand = cand.filter(~F.col(zone).isin([p[zone] for p in picks]))
            best = cand.agg(F.min_by(F.struct(*fields), F.struct(-F.col("score"), F.col(key), F.col("price"))).alias("b")).first()["b"]
            if best is None:
                break
            picks.append(best)
            spent += best["price"]
    schema = scored.select(*fields).schema
    rows = [(i + 1, *[p[f] for f in fields]) for i, p in enumerate(picks)]
    names = ", ".join(["pick int", *[f"`{f.name}` {f.dataType.simpleString()}" for f in schema]])
    return spark.createDataFrame(rows, names)


def threshold_alerts(alerts: DataFrame, forecast: DataFrame, seen: str | None = None) -> DataFrame:
    """Active alerts against the forecast: baseline on first sight, alert when the change reaches the threshold.

    ``alerts(id, zone, horizon, threshold, active, last_value)``, ``forecast(zone, horizon, f)``.
    """
    now = half_up((F.col("f") - 1.0) * 1000.0) / 10.0
    j = alerts.filter("active").join(forecast.select("zone", "horizon", "f"), ["zone", "horizon"]).filter("f is not null")
    out = j.withColumn("new_value", now).withColumn("delta", F.abs(F.col("new_value") - F.col("last_value")))
    action = F.when(F.col("last_value").isNull(), "baseline").when(F.col("delta") >= F.col("threshold"), "alert").otherwise("quiet")
    out = out.withColumn("action", action).withColumn("delta", half_up(F.col("delta") * 10.0) / 10.0)
    return out.withColumn("last_value_next", F.when(F.col("action") != "quiet", F.col("new_value")).otherwise(F.col("last_value")))


def alert_messages(fired: DataFrame) -> DataFrame:
    """One message per (zone, horizon): the alert with the smallest id speaks for all."""
    a = fired.filter(F.col("action") == "alert")
    one = a.groupBy("zone", "horizon").agg(
        F.min_by(F.struct("last_value", "new_value", "delta"), F.col("id")).alias("_m"), F.count("*").alias("watchers")
    )
    return one.select("zone", "horizon", "watchers", "_m.*")
