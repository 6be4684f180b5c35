"""Keyed state of streams: logs of changes for alerts and the listing tracker, a store of unseen records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrametra.operators import market as M
from terrametra.streaming.counters import write_updates


def _drain(stream: DataFrame, handle, checkpoint: str) -> None:
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _tracker_log(spark: SparkSession, path: str, keys: list[str], batch: int, step: int) -> DataFrame:
    """The newest row of each listing that the log holds before step ``step`` of micro-batch ``batch``."""
    log = spark.read.parquet(f"{path}/log").filter((F.col("batch") < batch) | ((F.col("batch") == batch) & (F.col("step") < step)))
    rest = [c for c in log.columns if c not in (*keys, "batch", "step")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "logged_day").alias("r")).select(*keys, "r.*")


def _day_rows(spark: SparkSession, path: str, since: int, batch: int, on_day) -> DataFrame:
    """The rows of the unfinished day that micro-batches ``since`` to before ``batch`` brought."""
    return spark.read.parquet(*[f"{path}/seen/batch={b}" for b in range(since, batch)]).filter(on_day)


def track_snapshots(stream: DataFrame, path: str, checkpoint: str, keys: list[str], day: str = "day") -> None:
    """Feed listing snapshots ``(keys, price, currency, day)`` to the tracker in date order.

    A day is finished when a row of a later day arrives; only then is its snapshot compared, whole, and what changed
    (new, cut, raised, reset, closed) is appended to a log. The rows of the unfinished day are kept as they came. So what
    a micro-batch writes grows with its rows and with the changes, never with the table, and it writes only folders of
    its own, so a replay leaves one copy. Rows of a finished day, and rows without a day, come too late and do not count.
    ``tracker_state`` reads the table.
    """
    path = path.rstrip("/")
    on = lambda d: F.col(day).cast("date") == F.to_date(F.lit(d))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = [r[0] for r in batch.select(F.col(day).cast("date").cast("string").alias("d")).distinct().collect() if r[0]]  # one row per snapshot date
        last, since = (None, 0) if batch_id == 0 else spark.read.parquet(f"{path}/days/batch={batch_id - 1}").first()
        if batch_id == 0:
            blank = batch.select(*keys, "price", "currency").limit(0)
            _log_rows(M.diff_snapshot(blank, _open(blank.select(*keys, *_blank_state())), "1970-01-01", keys), "1970-01-01").write.mode("overwrite").parquet(f"{path}/log/batch=0/step=0")
        days = sorted({d for d in found if last is None or d >= last} | ({last} if last else set()))
        for step, d in enumerate(days[:-1], 1):
            rows = batch.filter(on(d))
            if d == last:
                rows = rows.unionByName(_day_rows(spark, path, since, batch_id, on(d)))
            diff = M.diff_snapshot(rows, _open(_tracker_log(spark, path, keys, batch_id, step)), d, keys)
            _log_rows(diff, d).write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}/step={step}")
        newest = days[-1] if days else None
        batch.filter(on(newest) if newest else F.lit(False)).write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
        first = since if newest == last else batch_id
        spark.createDataFrame([(newest, first)], "day string, since int").write.mode("overwrite").parquet(f"{path}/days/batch={batch_id}")

    _drain(stream, handle, checkpoint)


def _blank_state() -> list:
    kinds = {"status": "string", "first_seen": "date", "price": "double", "currency": "string", "changes": M.CHANGE}
    return [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]


def _open(state: DataFrame) -> DataFrame:
    return state.filter("status <> 'closed'").drop("status", "days_on_market", "logged_day")


def _log_rows(diff: DataFrame, d: str) -> DataFrame:
    return diff.filter("status <> 'same'").withColumn("logged_day", F.to_date(F.lit(d)))


def tracker_state(spark: SparkSession, path: str, keys: list[str], day: str = "day") -> DataFrame:
    """The tracker's table after all finished micro-batches: the log, and the newest day compared with it.

    The columns of ``diff_snapshot``; listings that closed on an earlier day keep the row of that day.
    """
    path = path.rstrip("/")
    batch, d, since = spark.read.parquet(f"{path}/days").agg(F.max(F.struct("batch", "day", "since")).alias("r")).select("r.*").first()
    state = _tracker_log(spark, path, keys, batch + 1, 0)
    if d is None:
        return state.drop("logged_day")
    rows = _day_rows(spark, path, since, batch + 1, F.col(day).cast("date") == F.to_date(F.lit(d)))
    diff = M.diff_snapshot(rows, _open(state), d, keys)
    gone = state.filter("status = 'closed'").drop("logged_day").join(diff.select(*keys), keys, "left_anti")
    return diff.unionByName(gone)


def watch_forecasts(stream: DataFrame, alerts: DataFrame, log: str, checkpoint: str) -> None:
    """Check each forecast batch ``(zone, horizon, f)`` against the alert table and log what it decides.

    The alert table is only read. A micro-batch appends one row per alert that it meets, in a folder of its own, with the
    baseline that holds from then on; so what is written grows with the forecasts that arrive, not with the table, and a
    replayed batch leaves one copy. An alert's baseline is that of its newest row in the log, else the table's.
    """
    kind = alerts.select("id").schema[0].dataType.simpleString()

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = alerts
        if batch_id > 0:
            moved = alert_states(batch.sparkSession, log, kind, batch_id).select("id", F.col("last_value").alias("_moved"))
            now = alerts.join(moved, "id", "left").withColumn("last_value", F.coalesce("_moved", "last_value")).drop("_moved")
        out = M.threshold_alerts(now, batch).select("id", "action", "delta", "new_value", F.col("last_value_next").alias("last_value"))
        out.write.mode("overwrite").parquet(f"{log.rstrip('/')}/batch={batch_id}")

    _drain(stream, handle, checkpoint)


def alert_states(spark: SparkSession, log: str, kind: str = "bigint", before: int | None = None) -> DataFrame:
    """``id, action, delta, new_value, last_value``: the newest row of each alert (ids of type ``kind``) in the log."""
    rows = spark.read.schema(f"id {kind}, action string, delta double, new_value double, last_value double, batch int").parquet(log)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    newest = rows.groupBy("id").agg(F.max_by(F.struct("action", "delta", "new_value", "last_value"), "batch").alias("r"))
    return newest.select("id", "r.*")


def ingest_unseen(stream: DataFrame, store: str, checkpoint: str, key: str = "key", order: str = "seq") -> None:
    """Append only records whose key never came before; of a micro-batch, the first of each key by ``order``.

    The seen keys are the state of a streaming aggregate, which Spark keeps in its state store by the hash of the key: a
    micro-batch touches the keys that it brings and reads nothing of the store. With very many keys, name the RocksDB
    provider in ``spark.sql.streaming.stateStore.providerClass``, so that the state lies on disk. A record is new in the
    micro-batch whose time its key's first record holds; records without a key count as one key.
    """
    came = stream.withColumn("_came", F.current_timestamp())
    first = came.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct("*"), F.struct("_came", order)).alias("r"))
    write_updates(first.filter(F.col("r._came") == F.current_timestamp()).select("r.*").drop("_came"), store, checkpoint)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).drop("batch")
