"""Rounding, clipping and scaling of numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9


def half_even(c: Column, digits: int = 0) -> Column:
    """Banker's rounding, as numpy and Python do it."""
    return F.bround(c, digits)


def half_up(c: Column, digits: int = 0) -> Column:
    """JavaScript ``Math.round``: floor(x + 0.5), also for negative numbers."""
    if digits == 0:
        return F.floor(c + F.lit(0.5))
    scale = float(10**digits)
    return F.floor(c * scale + F.lit(0.5)) / scale


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    if lo is not None:
        c = F.greatest(c, F.lit(float(lo)))
    if hi is not None:
        c = F.least(c, F.lit(float(hi)))
    return c


def present(c: Column) -> Column:
    """NaN and NULL both count as missing."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def growth(first: Column, last: Column, years) -> Column:
    """Compound yearly rate; missing or zero endpoints and non-positive spans give NULL."""
    span = F.lit(years) if not isinstance(years, Column) else years
    ok = first.isNotNull() & last.isNotNull() & (first != 0) & (last != 0) & (span > 0)
    return F.when(ok, F.pow(last / first, F.lit(1.0) / span) - 1.0)


def one_row(agg: DataFrame) -> Column:
    """The single row of an aggregate as a struct column (an uncorrelated scalar subquery)."""
    return agg.select(F.struct(*[F.col(c) for c in agg.columns])).scalar()


def add_min_max(df: DataFrame, specs: dict[str, Column | str]) -> DataFrame:
    """Add ``(x - min) / (max - min + 1e-9)`` columns over the whole frame.

    All extremes come from one aggregate with map-side combine; it reaches the rows as a scalar
    subquery, so no window without partition and no join is involved.
    """
    exprs = {k: (F.col(v) if isinstance(v, str) else v) for k, v in specs.items()}
    aggs = []
    for i, e in enumerate(exprs.values()):
        aggs += [F.min(e).alias(f"lo{i}"), F.max(e).alias(f"hi{i}")]
    stats = one_row(df.agg(*aggs))
    out = df.withColumn("_mm", stats)
    for i, (name, e) in enumerate(exprs.items()):
        lo, hi = F.col("_mm")[f"lo{i}"], F.col("_mm")[f"hi{i}"]
        out = out.withColumn(name, (e - lo) / (hi - lo + F.lit(EPS)))
    return out.drop("_mm")


def add_zscore(df: DataFrame, specs: dict[str, Column | str]) -> DataFrame:
    """Add ``(x - mean) / (population std + 1e-9)`` columns over the whole frame."""
    exprs = {k: (F.col(v) if isinstance(v, str) else v) for k, v in specs.items()}
    aggs = []
    for i, e in enumerate(exprs.values()):
        aggs += [F.avg(e).alias(f"m{i}"), F.stddev_pop(e).alias(f"s{i}")]
    out = df.withColumn("_zs", one_row(df.agg(*aggs)))
    for i, (name, e) in enumerate(exprs.items()):
        out = out.withColumn(name, (e - F.col("_zs")[f"m{i}"]) / (F.col("_zs")[f"s{i}"] + F.lit(EPS)))
    return out.drop("_zs")


def days_between(later: Column, earlier: Column) -> Column:
    return F.greatest(F.datediff(later, earlier), F.lit(0))


def excel_date(serial: Column) -> Column:
    """Spreadsheet day serial (number or text) to a date; other text gives NULL."""
    n = F.floor(serial.cast("string").try_cast("double")).try_cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), n)
