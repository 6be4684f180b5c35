"""Account tables: saved analyses, favourite zones and zone alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrametra.operators.ranking import keep_first

SAVED_ANALYSES = "id string, user_id string, zona string, horizonte int, inputs string, resumen string, nota string, created_at timestamp"
FAVORITE_ZONES = "id string, user_id string, zona string, created_at timestamp"
ZONE_ALERTS = "id string, user_id string, zona string, horizonte int, umbral_pct double, activa boolean, ultimo_valor double, notificado_en timestamp, created_at timestamp"


def own_rows(df: DataFrame, user) -> DataFrame:
    """Rows a user may see: only their own."""
    return df.filter(F.col("user_id") == F.lit(user))


def unique_zone(df: DataFrame, order: list) -> DataFrame:
    """One row per (user, zone): the first insert wins, as the unique constraint keeps it."""
    return keep_first(df, ["user_id", "zone"], order)


def active_alerts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("active")).select("id", "user_id", "zone", "horizon", "threshold", "last_value")


def with_defaults(df: DataFrame, horizon: int = 5, threshold: float = 5.0) -> DataFrame:
    """Column defaults of the tables for rows that omit them."""
    return (
        df.withColumn("horizon", F.coalesce("horizon", F.lit(horizon)))
        .withColumn("threshold", F.coalesce("threshold", F.lit(threshold)))
        .withColumn("active", F.coalesce("active", F.lit(True)))
    )
