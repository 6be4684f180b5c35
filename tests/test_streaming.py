import datetime as dt


from terrametra.streaming import counters as T
from terrametra.streaming import limits as L
from terrametra.streaming import tables as V

BASE = dt.datetime(2024, 5, 1, 12, 0, 0)


def put(spark, rows, schema, path, name):
    """One file per call, so that every call is a micro-batch of its own run."""
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df.write.parquet(f"{path}/{name}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)


def test_demand_counts_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, event string, zone string"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    put(spark, [(BASE, "view", "a"), (BASE, "view", "a"), (BASE, "click", "b")], schema, src, "1")
    run = lambda: T.write_updates(T.demand_counts(stream(spark, src, schema)), out, ck)
    run()
    put(spark, [(BASE + dt.timedelta(days=3), "view", "a"), (BASE + dt.timedelta(hours=1), "view", "a")], schema, src, "2")
    run()
    put(spark, [(BASE, "view", "a"), (BASE + dt.timedelta(days=3, minutes=5), "view", "a")], schema, src, "3")  # the first one is late
    run()
    got = {(str(r.day)[:10], r.zone, r.event): r.n for r in T.read_latest(spark, out, ["day", "zone", "event"]).collect()}
    assert got == {("2024-05-01", "a", "view"): 3, ("2024-05-01", "b", "click"): 1, ("2024-05-04", "a", "view"): 2}


def test_daily_reading_keeps_the_last(spark, tmp_path):
    schema = "ts timestamp, zone string, score double"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = [(BASE + dt.timedelta(days=d, hours=h), "Roma", float(10 * d + h) + 0.5) for d in range(5) for h in (0, 2)]
    put(spark, rows, schema, src, "1")
    T.write_updates(T.daily_readings(stream(spark, src, schema)), out, ck)
    got = [(r.zone, r.day.day, r.score) for r in T.last_days(T.read_latest(spark, out, ["zone", "day"]), 3).orderBy("day").collect()]
    assert got == [("roma", 3, 23), ("roma", 4, 33), ("roma", 5, 43)]


def test_rate_limit_window_opens_with_the_first_hit(spark, tmp_path):
    schema = "ip string, hit_id bigint, ts timestamp"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    secs = [50, 55, 61, 100, 110, 111, 120, 171, 172, 400]
    hits = [("a", i, BASE + dt.timedelta(seconds=s)) for i, s in enumerate(secs)] + [("b", 100, BASE)]
    run = lambda: L.write_rate_limits(stream(spark, src, schema), out, ck)
    put(spark, hits[:4] + hits[-1:], schema, src, "1")
    run()
    put(spark, hits[4:-1], schema, src, "2")  # the window goes on across runs
    run()
    got = {r.hit_id: (r.n, r.allowed) for r in L.rate_limit_flags(spark, out, 3).collect()}
    until, n, want = -1, 0, {}
    for i, s in enumerate(secs):
        if n == 0 or s > until:
            until, n = s + 60, 1
        else:
            n += 1
        want[i] = (n, n <= 3)
    want[100] = (1, True)
    assert got == want


def test_many_hits_of_one_address_in_any_order(spark, tmp_path):
    hits = spark.range(40_000).selectExpr("'a' AS ip", "id AS hit_id", "timestamp_millis(1700000000000 + id * 7) AS ts")
    src = str(tmp_path / "in")
    hits.repartition(4, "hit_id").orderBy("hit_id", ascending=False).coalesce(1).write.parquet(src)
    L.write_rate_limits(stream(spark, src, hits.schema), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.hit_id: r.n for r in L.rate_limit_flags(spark, str(tmp_path / "out")).collect()}
    per = 60_000 // 7 + 1  # the window holds its last millisecond
    assert got == {i: i % per + 1 for i in range(40_000)}


def test_day_spread_over_two_batches(spark, tmp_path):
    schema = "zone string, id int, price double, currency string, day date"
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    table = str(tmp_path / "t")
    rows = lambda d, *ids: [("z", i, 10.0 + d, "MXN", dt.date(2024, 6, d)) for i in ids]
    for name, part in enumerate((rows(1, 1, 2), rows(1, 3, 4) + rows(2, 1, 2), rows(2, 3))):
        put(spark, part, schema, src, str(name))
        V.track_snapshots(stream(spark, src, schema), table, ck, ["zone", "id"])
    got = {r.id: (r.status, str(r.first_seen)) for r in V.tracker_state(spark, table, ["zone", "id"]).collect()}
    assert got == {1: ("raised", "2024-06-01"), 2: ("raised", "2024-06-01"), 3: ("raised", "2024-06-01"), 4: ("closed", "2024-06-01")}


def test_tracker_over_three_runs(spark, tmp_path):
    schema = "zone string, id int, price double, currency string, day date"
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    table = str(tmp_path / "t")
    day = lambda d: dt.date(2024, 6, d)
    snaps = [
        [("z", 1, 10.0, "MXN", day(1)), ("z", 2, 20.0, "MXN", day(1)), ("z", 3, 30.0, "MXN", day(1))],
        [("z", 1, 9.0, "MXN", day(5)), ("z", 3, 30.0, "MXN", day(5))],
        [("z", 1, 9.0, "MXN", day(9)), ("z", 2, 21.0, "MXN", day(9))],
    ]
    for i, rows in enumerate(snaps):
        put(spark, rows, schema, src, str(i))
        V.track_snapshots(stream(spark, src, schema), table, ck, ["zone", "id"])
    got = {r.id: (r.status, str(r.first_seen), len(r.changes), r.days_on_market) for r in V.tracker_state(spark, table, ["zone", "id"]).collect()}
    assert got == {1: ("same", "2024-06-01", 1, None), 2: ("new", "2024-06-09", 0, None), 3: ("closed", "2024-06-01", 0, 8)}


def test_tracker_log_grows_with_changes_and_late_days_do_not_count(spark, tmp_path):
    """Days cut anywhere into micro-batches give the batch comparison; only changed listings are written."""
    from terrametra.operators import market as M

    schema = "zone string, id int, price double, currency string, day date"
    src, ck, table = str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "t")
    keys = ["zone", "id"]
    days = [[("z", i, 100.0 + (i * d) % 7 * (i % 50 == 0), "MXN", dt.date(2024, 6, d)) for i in range(500) if (i + d) % 97 or i % 2] for d in range(1, 6)]
    flat = [r for d in days for r in d]
    cuts = [0, 120, 700, 710, 1900, 2200, len(flat)]  # a batch may end a day, hold two, or bring a few rows of one
    parts = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
    parts[-1] = parts[-1] + [("z", 9999, 1.0, "MXN", dt.date(2024, 6, 2)), ("z", 9998, 1.0, "MXN", None)]
    for i, part in enumerate(parts):
        put(spark, part, schema, src, str(i))
        V.track_snapshots(stream(spark, src, schema), table, ck, keys)
    V.track_snapshots(stream(spark, src, schema), table, ck, keys)  # nothing new
    open_, gone = {}, {}
    for d in days:
        today, now = d[0][4], {(r[0], r[1]): r[2] for r in d}
        for k in set(open_) - set(now):
            gone[k] = ("closed", *open_.pop(k)[1:3])
        state = {}
        for k, price in now.items():
            if k not in open_:
                state[k] = ("new", price, today, 0)
            else:
                _, old, since, n = open_[k]
                state[k] = ("same" if price == old else "cut" if price < old else "raised", price, since, n + (price != old))
            gone.pop(k, None)
        open_ = state
    got = {(r.zone, r.id): r for r in V.tracker_state(spark, table, keys).collect()}
    assert {k: (r.status, r.price, r.first_seen, len(r.changes)) for k, r in got.items() if r.status != "closed"} == open_
    assert {k: (r.status, r.price, r.first_seen) for k, r in got.items() if r.status == "closed"} == gone and gone
    log = spark.read.parquet(f"{table}/log")
    assert log.filter("logged_day > date'2024-06-01'").count() < 120 and "same" not in {r.status for r in log.select("status").distinct().collect()}
    one = M.diff_snapshot(spark.createDataFrame(days[0], schema), log.limit(0), "2024-06-01", keys)
    assert one.count() == log.filter("logged_day = date'2024-06-01'").count()


def test_hits_in_any_batch_are_numbered_in_order_of_time(spark, tmp_path):
    """Shuffled over five micro-batches, hits within the lateness get the numbers of one batch; later ones count at once."""
    import random

    schema = "ip string, hit_id bigint, ts timestamp"
    draw = random.Random(3)
    hits = [(ip, i * 10 + k, BASE + dt.timedelta(seconds=draw.randrange(1500))) for k, ip in enumerate("aab") for i in range(200)]
    hits += [("c", 9_000 + i, BASE + dt.timedelta(seconds=5)) for i in range(3)]
    shuffled = hits[:]
    draw.shuffle(shuffled)
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    put(spark, hits, schema, one, "0")
    for i in range(5):
        put(spark, shuffled[i::5], schema, many, str(i))
    L.write_rate_limits(stream(spark, one, schema), str(tmp_path / "o1"), str(tmp_path / "c1"))
    each = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(many)
    L.write_rate_limits(each, str(tmp_path / "o2"), str(tmp_path / "c2"))
    rows = lambda p: sorted((r.ip, r.hit_id, r.n) for r in L.rate_limit_flags(spark, str(tmp_path / p)).collect())
    assert rows("o1") == rows("o2") and len(rows("o2")) == len(hits)
    want, until, n = [], {}, {}
    for ip, hit, ts in sorted(hits, key=lambda h: (h[0], h[2], h[1])):
        n[ip], until[ip] = (1, ts + dt.timedelta(seconds=60)) if ip not in until or ts > until[ip] else (n[ip] + 1, until[ip])
        want.append((ip, hit, n[ip]))
    assert rows("o1") == sorted(want)
    far = [("a", 50_000, BASE + dt.timedelta(hours=5)), ("b", 50_001, BASE + dt.timedelta(hours=5))]
    for name, part in (("5", far), ("6", [("a", 60_000, BASE)])):  # the last hit is five hours late
        put(spark, part, schema, many, name)
        L.write_rate_limits(stream(spark, many, schema), str(tmp_path / "o2"), str(tmp_path / "c2"))
    after = {r.hit_id: r.n for r in L.rate_limit_flags(spark, str(tmp_path / "o2")).collect()}
    assert (after[50_000], after[60_000], len(after)) == (1, 1, len(hits) + 3)
    carried = spark.read.schema(L.STEP).parquet(str(tmp_path / "o2" / "batch=6")).filter("hit").count()
    assert carried == 3  # the two hits of the lateness and the late one


def test_alert_baselines_move(spark, tmp_path):
    schema = "zone string, horizon int, f double"
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    log = str(tmp_path / "log")
    alerts = spark.createDataFrame([(1, "a", 3, 5.0, True, None)], "id int, zone string, horizon int, threshold double, active boolean, last_value double")
    seen = []
    for i, f in enumerate((1.10, 1.13, 1.20)):
        put(spark, [("a", 3, f)], schema, src, str(i))
        V.watch_forecasts(stream(spark, src, schema), alerts, log, ck)
        r = V.alert_states(spark, log, "int").first()
        seen.append((r.action, r.last_value))
    assert seen == [("baseline", 10.0), ("quiet", 10.0), ("alert", 20.0)]


def test_alert_log_grows_with_what_arrives(spark, tmp_path):
    """Four batches give the alerts of the batch operator step by step, and only alerts that a batch meets are written."""
    from terrametra.operators import market as M

    schema = "zone string, horizon int, f double"
    src, ck, log = (str(tmp_path / x) for x in ("in", "ck", "log"))
    rows = [(i, f"z{i % 50}", 3, 1.0 + i % 4, i % 9 != 0, None if i % 3 else float(i % 40)) for i in range(400)]
    kind = "id int, zone string, horizon int, threshold double, active boolean, last_value double"
    alerts = spark.createDataFrame(rows, kind)
    batches = [[(f"z{z}", 3, 1.0 + (7 * z + 13 * b) % 40 / 1000) for z in range(b, 50, 7)] for b in range(4)]
    for b, rows_b in enumerate(batches):
        put(spark, rows_b, schema, src, str(b))
    one_by_one = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)
    V.watch_forecasts(one_by_one, alerts, log, ck)
    held, want = {r[0]: r for r in rows}, {}
    for b, rows_b in enumerate(batches):
        now = spark.createDataFrame(list(held.values()), kind)
        found = M.threshold_alerts(now, spark.createDataFrame(rows_b, schema)).collect()
        for r in found:
            held[r.id] = (*held[r.id][:5], r.last_value_next)
            want[r.id] = (r.action, r.last_value_next)
        assert spark.read.parquet(f"{log}/batch={b}").count() == len(found) < 100
    assert {r.id: (r.action, r.last_value) for r in V.alert_states(spark, log, "int").collect()} == want


def test_ingest_resumes_and_ignores_known_keys(spark, tmp_path):
    schema = "key string, seq bigint"
    src, ck, store = (str(tmp_path / x) for x in ("in", "ck", "store"))
    for i, rows in enumerate(([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)])):
        put(spark, rows, schema, src, str(i))
        V.ingest_unseen(stream(spark, src, schema), store, ck)
    V.ingest_unseen(stream(spark, src, schema), store, ck)  # nothing new
    assert sorted((r.key, r.seq) for r in V.read_store(spark, store).collect()) == [("a", 1), ("b", 2), ("c", 5)]


def test_ingest_reads_no_earlier_batch(spark, tmp_path):
    """Ten batches with repeats, nulls and earlier order values: each key once, from the batch that brought it first."""
    schema = "key string, seq bigint, body string"
    src, ck, store = (str(tmp_path / x) for x in ("in", "ck", "store"))
    seen = {}
    for i in range(10):
        rows = [(f"k{(i * 7 + j) % 40}" if j else None, 1000 - i * 10 - j, f"{i}-{j}") for j in range(12)]
        put(spark, rows, schema, src, str(i))
        for k, q, body in sorted(rows, key=lambda r: r[1]):
            seen.setdefault(k, (q, body))
    each = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)
    V.ingest_unseen(each, store, ck)
    got = V.read_store(spark, store).collect()
    assert len(got) == len(seen) and {r.key: (r.seq, r.body) for r in got} == seen


def test_tumbling_and_styles(spark, tmp_path):
    schema = "ts timestamp, ip string, styles array<string>"
    src = str(tmp_path / "in")
    put(spark, [(BASE + dt.timedelta(seconds=s), "a", ["x", "y"]) for s in (0, 10, 20, 70)], schema, src, "1")
    T.write_updates(L.tumbling_hits(stream(spark, src, schema), 2), str(tmp_path / "o1"), str(tmp_path / "c1"))
    got = sorted((r.minute.minute, r.n, r.limited) for r in T.read_latest(spark, str(tmp_path / "o1"), ["ip", "minute"]).collect())
    assert got == [(0, 3, True), (1, 1, False)]
    T.write_updates(T.dimension_counts(stream(spark, src, schema), "styles"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert {(r.value, r.n) for r in T.read_latest(spark, str(tmp_path / "o2"), ["day", "value"]).collect()} == {("x", 4), ("y", 4)}


def test_events_in_a_folder_of_parts(spark, tmp_path):
    from terrametra.streaming import counters

    batch = spark.range(1000).selectExpr("id", "timestamp'2024-01-01' AS ts")
    batch.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    stream = counters.read_events(spark, str(tmp_path), batch.schema, per_trigger=1)
    q = stream.writeStream.format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("parts").count() == 1000
