"""Running counters and daily readings over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrametra.functions.numeric import half_up
from terrametra.operators.ranking import keep_last, top_n_per_group

LATENESS = "1 hour"


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; files may hold one without zone (read as UTC by the session)."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def demand_counts(events: DataFrame, every: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Counts by zone and event per day; later rows than the watermark are dropped."""
    e = event_time(events).withWatermark("ts", lateness).filter((F.col("event") != ""))
    return (
        e.groupBy(F.window("ts", every).alias("w"), "zone", "event")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("day"), "zone", "event", "n")
    )


def dimension_counts(events: DataFrame, dimension: str, every: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Counts by one further dimension: ``budget``, ``type`` or ``styles`` (exploded); records without an event do not count."""
    e = event_time(events).withWatermark("ts", lateness)
    if "event" in events.columns:
        e = e.filter(F.col("event") != "")
    value = F.explode(dimension) if dict(events.dtypes)[dimension].startswith("array") else F.col(dimension)
    e = e.select("ts", value.alias("value")).filter(F.coalesce(F.col("value"), F.lit("")) != "")
    return e.groupBy(F.window("ts", every).alias("w"), "value").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "value", "n")


def daily_readings(readings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One score per zone and day; the latest reading of the day wins, the higher of two at one time."""
    s = event_time(readings).withWatermark("ts", lateness).filter((F.coalesce(F.col("zone"), F.lit("")) != "") & F.col("score").isNotNull() & (F.abs("score") < float("inf")))
    zone = F.lower("zone")
    return (
        s.groupBy(F.window("ts", "1 day").alias("w"), zone.alias("zone"))
        .agg(F.max_by(half_up(F.col("score")), F.struct("ts", "score")).alias("score"))
        .select("zone", F.col("w.start").alias("day"), "score")
    )


# Fixed value: the published length of a series of readings.
SERIES_DAYS = 60


def last_days(daily: DataFrame, n: int | None = None) -> DataFrame:
    """The newest ``n`` readings of each zone, such as ``SERIES_DAYS``; all of them by default."""
    return daily if n is None else top_n_per_group(daily, ["zone"], [F.col("day").desc()], n).drop("rank")


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an aggregate in update mode over all available input.

    Every micro-batch writes its changed rows to its own folder and overwrites only that folder, so a batch
    replayed after a failure leaves one copy.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current value per key: the row of its newest batch."""
    return keep_last(spark.read.parquet(path), keys, ["batch"]).drop("batch")


def read_events(spark: SparkSession, folder: str, schema, file: str = "events.parquet", per_trigger: int | None = None) -> DataFrame:
    """Stream one table below a folder, whether it is a single file or a folder of part files."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{folder.rstrip('/')}/{file}")
