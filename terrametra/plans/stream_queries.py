"""Queries that run a stream over the tables to completion and read its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrametra.plans.bindings import EVENTS, LISTINGS, Tables, events, listings
from terrametra.plans.registry import query
from terrametra.session import work_path
from terrametra.streaming import counters as T
from terrametra.streaming import limits as L
from terrametra.streaming import tables as V


class _StreamTables(Tables):
    """The same bindings over a stream of the events file."""

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        batch = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return T.read_events(self.spark, self.folder, batch.schema, f"{name}.parquet")


def _event_stream(t: Tables):
    return events(_StreamTables(t.spark, t.folder))


def _run_updates(t: Tables, df, name: str, keys: list[str]):
    path = work_path(t.spark, name)
    T.write_updates(df, f"{path}/out", f"{path}/checkpoint")
    return T.read_latest(t.spark, f"{path}/out", keys)


@query("demand_stream", f"WITH {EVENTS} SELECT strftime(ts, '%Y-%m-%d') AS day, zone, event, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def demand_stream(t: Tables):
    out = _run_updates(t, T.demand_counts(_event_stream(t)), "demand", ["day", "zone", "event"])
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "zone", "event", "n")


@query(
    "style_stream",
    f"WITH {EVENTS}, s AS (SELECT ts, unnest(styles) AS value FROM ev WHERE event <> '') SELECT strftime(ts, '%Y-%m-%d') AS day, value, count(*) AS n FROM s GROUP BY 1, 2",
)
def style_stream(t: Tables):
    out = _run_updates(t, T.dimension_counts(_event_stream(t), "styles"), "styles", ["day", "value"])
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "value", "n")


@query(
    "daily_last_reading",
    f"""WITH {EVENTS}, d AS (SELECT zone, strftime(ts, '%Y-%m-%d') AS day, arg_max(floor(score + 0.5)::BIGINT, ts) AS score FROM ev WHERE zone <> '' GROUP BY 1, 2)
    SELECT zone, day, score FROM d""",
)
def daily_last_reading(t: Tables):
    out = _run_updates(t, T.daily_readings(_event_stream(t).select("ts", "zone", "score")), "readings", ["zone", "day"])
    return T.last_days(out).select("zone", F.date_format("day", "yyyy-MM-dd").alias("day"), "score")


_WINDOW_MS = 6 * 3600 * 1000
_HITS = f"""h AS (SELECT 'u' || user_id::VARCHAR AS ip, event_id, epoch_ms(ts) AS ms FROM ev),
  w AS (SELECT ip, min(ms) AS s FROM h GROUP BY 1 UNION ALL SELECT w.ip, min(h.ms) FROM w JOIN h ON h.ip = w.ip AND h.ms > w.s + {_WINDOW_MS} GROUP BY w.ip, w.s),
  p AS (SELECT h.ip, h.event_id, h.ms, max(w.s) AS s FROM h JOIN w ON w.ip = h.ip AND w.s <= h.ms GROUP BY 1, 2, 3),
  n AS (SELECT *, row_number() OVER (PARTITION BY ip, s ORDER BY ms, event_id) AS n FROM p)"""


@query("rate_limit_flags", f"WITH RECURSIVE {EVENTS}, {_HITS} SELECT ip, event_id AS hit_id, n, n <= 2 AS allowed FROM n")
def rate_limit_flags(t: Tables):
    path = work_path(t.spark, "limits")
    hits = _event_stream(t).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("ip"), F.col("event_id").alias("hit_id"), "ts")
    L.write_rate_limits(hits, f"{path}/out", f"{path}/checkpoint", _WINDOW_MS)
    return L.rate_limit_flags(t.spark, f"{path}/out", 2).select("ip", "hit_id", "n", "allowed")


@query("tumbling_hits", f"WITH {EVENTS} SELECT 'u' || user_id::VARCHAR AS ip, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) > 1 AS limited FROM ev GROUP BY 1, 2")
def tumbling_hits(t: Tables):
    hits = _event_stream(t).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("ip"), "ts")
    out = _run_updates(t, L.tumbling_hits(hits, 1, "1 hour"), "tumbling", ["ip", "minute"])
    return out.select("ip", F.date_format("minute", "yyyy-MM-dd HH").alias("hour"), "n", "limited")


@query(
    "tracker_stream",
    f"""WITH {LISTINGS}, s AS (SELECT zone, id, floor(price * (1 + ((id + d * 3) % 5 - 2) / 100.0e0)) AS price, d FROM listings, (VALUES (1), (2), (3)) t(d) WHERE rooms <> d),
    w AS (SELECT zone, id, max(price) FILTER (WHERE d = 1) AS p1, max(price) FILTER (WHERE d = 2) AS p2, max(price) FILTER (WHERE d = 3) AS p3 FROM s GROUP BY 1, 2)
    SELECT zone, id, CASE WHEN p3 IS NULL THEN 'closed' WHEN p2 IS NULL THEN 'new' WHEN p3 < p2 THEN 'cut' WHEN p3 > p2 THEN 'raised' ELSE 'same' END AS status, coalesce(p3, p2, p1) AS price,
    CASE WHEN p3 IS NOT NULL AND p2 IS NULL THEN '2001-09-03' WHEN p1 IS NOT NULL AND (p2 IS NOT NULL OR p3 IS NULL) THEN '2001-09-01' ELSE '2001-09-02' END AS first_seen,
    (CASE WHEN p3 IS NULL THEN (p1 IS NOT NULL AND p2 IS NOT NULL AND p1 <> p2)::INT WHEN p2 IS NULL THEN 0 ELSE (p3 <> p2)::INT + (p1 IS NOT NULL AND p1 <> p2)::INT END)::INT AS changes FROM w""",
)
def tracker_stream(t: Tables):
    path = work_path(t.spark, "tracker")
    k, d = F.col("id"), F.col("d")
    snaps = listings(t).select("zone", "id", "price", "rooms", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("d")).filter(F.col("rooms") != d)
    snaps = snaps.select(
        "zone", "id", F.floor(F.col("price") * (1 + ((k + d * 3) % 5 - 2) / 100.0)).cast("double").alias("price"), F.lit("MXN").alias("currency"), F.date_add(F.to_date(F.lit("2001-08-31")), d).alias("day")
    )
    snaps.write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema(snaps.schema).parquet(f"{path}/in")
    V.track_snapshots(stream, f"{path}/table", f"{path}/checkpoint", ["zone", "id"])
    out = V.tracker_state(t.spark, f"{path}/table", ["zone", "id"])
    return out.select("zone", "id", "status", "price", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.size("changes").alias("changes"))


@query(
    "alert_stream",
    f"""WITH {EVENTS}, al AS (SELECT event_id AS id, 'z' || (user_id % 25)::VARCHAR AS zone, CASE WHEN event_id % 3 <> 0 THEN (event_id % 40)::DOUBLE END AS last_value, 1.0e0 + event_id % 5 AS threshold FROM ev WHERE event_id % 7 <> 0),
    f AS (SELECT 'z' || c_nationkey::VARCHAR AS zone, floor(avg(o_totalprice) / 1000) / 1000 AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    j AS (SELECT al.*, floor((1 + f - 1.0e0) * 1000.0e0 + 0.5) / 10.0e0 AS v FROM al JOIN f USING (zone))
    SELECT id, CASE WHEN last_value IS NULL THEN 'baseline' WHEN abs(v - last_value) >= threshold THEN 'alert' ELSE 'quiet' END AS action, CASE WHEN last_value IS NULL OR abs(v - last_value) >= threshold THEN v ELSE last_value END AS last_value FROM j""",
)
def alert_stream(t: Tables):
    path = work_path(t.spark, "alerts")
    k = F.col("event_id")
    al = events(t).select(
        k.alias("id"), F.concat(F.lit("z"), (F.col("user_id") % 25).cast("string")).alias("zone"), F.lit(3).alias("horizon"), (1.0 + k % 5).alias("threshold"), (k % 7 != 0).alias("active"),
        F.when(k % 3 != 0, (k % 40).cast("double")).alias("last_value"),
    )
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    fc = j.groupBy(F.concat(F.lit("z"), F.col("c_nationkey").cast("string")).alias("zone")).agg((1 + F.floor(F.avg("o_totalprice") / 1000) / 1000).alias("f")).withColumn("horizon", F.lit(3))
    fc.write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema(fc.schema).parquet(f"{path}/in")
    V.watch_forecasts(stream, al, f"{path}/log", f"{path}/checkpoint")
    return V.alert_states(t.spark, f"{path}/log").select("id", "action", "last_value")


@query("resumable_ingest", "SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS run FROM orders")
def resumable_ingest(t: Tables):
    path = work_path(t.spark, "ingest")
    o = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"))
    rows = lambda df, run: df.select("key", "seq", F.lit(run).alias("run"))
    first, second = rows(o.filter("status = 'F'"), 1), rows(o.unionByName(o.filter("status = 'O'")), 2)
    for part in (first, second):
        part.write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema(part.schema).parquet(f"{path}/in")
        V.ingest_unseen(stream, f"{path}/store", f"{path}/checkpoint")
    return V.read_store(t.spark, f"{path}/store").select("key", "run")


