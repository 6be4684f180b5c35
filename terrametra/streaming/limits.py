"""Fixed rate-limit windows that open with the first hit of each address."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrametra.streaming.counters import event_time

# Hits allowed per window of one minute.
WINDOW_MS = 60_000
FORM_LIMIT = 12
ROOM_LIMIT = 260

LATENESS_MS = 3_600_000

# A hit has an id and its number, final once the watermark has passed it; a row without ``hit`` is the window an address
# has open at the watermark, one without address the watermark itself.
STEP = "ip string, hit boolean, hit_id bigint, at_ms bigint, n bigint, until bigint, final boolean"
_COLUMNS = [c.split()[0] for c in STEP.split(", ")]


def number_hits(rows: DataFrame, window_ms: int, mark: int) -> DataFrame:
    """Number hits inside their windows; ``rows(ip, hit, hit_id, at_ms, n, until)`` holds hits and open windows.

    Spark sorts each address by time, so the walk keeps two windows, the current one and that at the watermark ``mark``,
    whatever the number of hits. Windows that end before the watermark are not carried on.
    """

    def walk(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ip, until, n, held = None, -1, 0, None
        frame = lambda out: pd.DataFrame(out, columns=_COLUMNS).astype({"hit_id": "Int64"})
        for chunk in chunks:
            out = []
            for row_ip, hit, hit_id, at, row_n, row_until in chunk.itertuples(index=False, name=None):
                if row_ip != ip:
                    if held is not None and held[5] >= mark:
                        out.append(held)
                    ip, until, n, held = row_ip, -1, 0, None
                at = int(at)
                if not hit:
                    until, n = int(row_until), int(row_n)
                elif n == 0 or at > until:
                    until, n = at + window_ms, 1
                else:
                    n += 1
                if hit:
                    out.append((ip, True, hit_id, at, n, until, at <= mark))
                if at <= mark:
                    held = (ip, False, None, at, n, until, False)
            yield frame(out)
        if held is not None and held[5] >= mark:
            yield frame([held])

    order = ["ip", "hit", "at_ms", "hit_id"]  # false first: the open window comes before the hits
    return rows.select(*_COLUMNS[:-1]).repartition("ip").sortWithinPartitions(*order).mapInPandas(walk, STEP)


def write_rate_limits(hits: DataFrame, path: str, checkpoint: str, window_ms: int = WINDOW_MS, lateness_ms: int = LATENESS_MS) -> None:
    """Run a stream of ``hits(ip, hit_id, ts)`` over all available input and store the number of each hit.

    Hits are taken in order of time whatever the micro-batch that brings them, as long as they are not behind the
    watermark, the newest time so far less ``lateness_ms``: a micro-batch numbers the hits after the watermark again,
    together with its own, from the windows that were open at the watermark. A hit behind the watermark counts in the
    window open there, in order of arrival. Hits without address, id or time do not count. Each batch writes its own folder
    from that of the batch before, which holds the hits of the lateness only, so a replayed batch leaves one copy.
    """
    path = path.rstrip("/")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("ip", F.lit(True).alias("hit"), "hit_id", "at_ms", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("until"))
        newest = rows.agg(F.max("at_ms")).first()[0]
        marks = [] if newest is None else [newest - lateness_ms]
        if batch_id > 0:
            before = spark.read.schema(STEP).parquet(f"{path}/batch={batch_id - 1}")
            marks += [r.at_ms for r in before.filter("ip is null").collect()]  # one row
            rows = before.filter("ip is not null and not final").select(*rows.columns).unionByName(rows)
        mark = max(marks, default=-(1 << 62))
        watermark = spark.createDataFrame([(None, False, None, mark, None, None, False)], STEP)
        number_hits(rows, window_ms, mark).unionByName(watermark).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    keyed = event_time(hits).select("ip", F.col("hit_id").cast("bigint").alias("hit_id"), F.unix_millis("ts").alias("at_ms")).dropna()
    q = keyed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def rate_limit_flags(spark: SparkSession, path: str, limit: int = FORM_LIMIT) -> DataFrame:
    """``ip, hit_id, at_ms, n, allowed``: what ``write_rate_limits`` stored, flagged against a limit.

    Numbers behind the watermark are final; those after it are taken from the newest batch.
    """
    done = spark.read.schema(f"{STEP}, batch int").parquet(path)
    newest = done.filter("ip is null").agg(F.max("batch")).scalar()
    return done.filter(F.col("hit") & (F.col("final") | (F.col("batch") == newest))).select("ip", "hit_id", "at_ms", "n", (F.col("n") <= limit).alias("allowed"))


def tumbling_hits(hits: DataFrame, limit: int = FORM_LIMIT, every: str = "1 minute", lateness: str = "1 hour") -> DataFrame:
    """Epoch-aligned approximation: hits per address and minute, flagged above the limit."""
    e = event_time(hits).withWatermark("ts", lateness)
    return (
        e.groupBy(F.window("ts", every).alias("w"), "ip")
        .agg(F.count("*").alias("n"))
        .select("ip", F.col("w.start").alias("minute"), "n", (F.col("n") > limit).alias("limited"))
    )
