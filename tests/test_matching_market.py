import numpy as np
import pytest
from pyspark.sql import functions as F

from terrametra.functions import text
from terrametra.functions.constants import INDICATOR_SPECIES
from terrametra.operators import market as M
from terrametra.operators import matching as J
from terrametra.operators import rollups as R


def test_entity_resolution_never_guesses(spark):
    names = ["Gral. Trias", "Othón P. Blanco", "La Manzanilla de la Paz", "Silao de la Victoria", "San Juan Norte", "San Juan Sur", "León"]
    asked = ["General Trías", "Othon P Blanco", "De La Paz La Manzanilla", "Silao", "San Juan", "Leon", "Nada"]
    got = {
        r.request: (r.official, r.rule, r.candidates)
        for r in J.resolve_entities(spark.createDataFrame([(a,) for a in asked], "a string"), "a", spark.createDataFrame([(n,) for n in names + names], "n string"), "n").collect()
    }
    assert got["General Trías"] == ("Gral. Trias", 2, 1)
    assert got["Othon P Blanco"] == ("Othón P. Blanco", 2, 1)
    assert got["De La Paz La Manzanilla"] == ("La Manzanilla de la Paz", 3, 1)
    assert got["Silao"] == ("Silao de la Victoria", 4, 1)
    assert got["San Juan"] == (None, 4, 2)
    assert got["Leon"] == ("León", 1, 1)
    assert got["Nada"] == (None, None, 0)


def test_registry_diff_drops_streets_with_only_closures(spark):
    old = spark.createDataFrame([("Café Uno", "Juárez"), ("Taller", "Juárez"), ("Taller", "Madero")], "n string, s string")
    new = spark.createDataFrame([("CAFE UNO", "JUAREZ"), ("Yoga y Café", "Juárez"), ("Fonda", "Hidalgo")], "n string, s string")
    sp = text.all_categories(text.ascii_upper(F.col("n")), INDICATOR_SPECIES)
    got = {r.s: (r.openings, r.closures, r.indicators, r.species) for r in J.registry_diff(new, old, "n", "s", sp).collect()}
    assert got == {"Juárez": (1, 1, 1, "Café de especialidad, Estudio de yoga"), "Hidalgo": (1, 0, 0, "—")}


def test_slug_fallback(spark):
    reg = spark.createDataFrame([("garcia-nuevo-leon", 1), ("merida", 2)], "slug string, x int")
    df = spark.createDataFrame([(1, "García", "Nuevo León"), (2, "Mérida", "Yucatán"), (3, "Otra", "")], "id int, m string, e string")
    got = {r.id: r.x for r in J.slug_fallback_join(df, "id", [F.concat_ws(", ", "m", "e"), F.col("m")], reg, "slug").collect()}
    assert got == {1: 1, 2: 2, 3: None}


def test_containment_equals_brute_force(spark):
    import random

    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("ab é") for _ in range(n))
    texts = [word(draw.randrange(0, 30)) for _ in range(300)] + [None, "", "ab" * 2_000]
    parts = [word(draw.randrange(0, 8)) for _ in range(150)] + [t[3:12] for t in texts[:60]] + [None, "", "zzzz", "zab", texts[0]]
    one = lambda rows: spark.createDataFrame([(r,) for r in rows], "v string")
    got = J.containing(one(texts + texts[:5]), one(parts)).collect()
    want = {(t, p) for t in texts if t for p in parts if p and p in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    long = spark.createDataFrame([("x" * 50 + str(i) * 950,) for i in range(3)], "v string")
    rows = long.select(F.size(J.grams(F.col("v"))).alias("n")).agg(F.max("n")).first()[0]
    assert rows < 3 * 1_000


def test_partial_names(spark):
    mon = spark.createDataFrame([("pachuca de soto", "hidalgo", 2), ("leon", "guanajuato", 1), ("leona vicario", "guanajuato", 5), ("a", "ciudad de mexico", 3), ("b", "ciudad de mexico", 4), ("pachuca", "puebla", 5)], "mun string, ent string, level int")
    zones = spark.createDataFrame([("P", "pachuca", "hidalgo"), ("L", "leon", "guanajuato de x"), ("C", "*", "ciudad de mexico"), ("N", "nada", "hidalgo")], "zone string, mun string, ent string")
    got = J.partial_name_join(zones, mon).groupBy("zone").agg(F.max("level").alias("l")).collect()
    assert {r.zone: r.l for r in got} == {"P": 2, "L": 1, "C": 4}


def test_partial_names_by_totals(spark):
    mon = [("pachuca de soto", "hidalgo", 2), ("leon", "guanajuato", 1), ("leon", "guanajuato", 3), ("leona vicario", "guanajuato", 5), (None, "puebla", 7), ("*", "puebla", 4)]
    mon = spark.createDataFrame(mon + [(f"m{k}", "puebla", k % 3) for k in range(50)], "mun string, ent string, level int")
    zones = [("P", "pachuca", "hidalgo"), ("L", "leon", "guanajuato de x"), ("C", "*", "puebla"), ("C2", "*", "uebl"), ("N", "nada", "hidalgo"), ("P", "*", "guanajuato"), (None, "*", "puebla")]
    zones = spark.createDataFrame(zones, "zone string, mun string, ent string")
    got = J.partial_name_join(zones, mon, [F.max("level").alias("l"), F.count("*").alias("n")])
    want = J.partial_name_join(zones, mon).groupBy("zone").agg(F.max("level").alias("l"), F.count("*").alias("n")).collect()
    totals = got.groupBy("zone").agg(F.max("l").alias("l"), F.sum("n").alias("n")).collect()
    assert {tuple(r) for r in totals} == {tuple(r) for r in want} and len(totals) == 4
    assert got.filter("zone = 'C2'").count() == 2  # the state and the name '*'; its municipalities are not listed


def test_canonical_name_folds_once(spark):
    c = F.concat(F.col("e"), F.lit("-folded"))
    plan = spark.range(1).select(F.lit("x").alias("e")).select(J.canonical_name(c, ["a", "b"]).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("-folded") == 1


def test_canonical_name(spark):
    names = ["coahuila de zaragoza", "michoacan de ocampo", "mexico"]
    df = spark.createDataFrame([("coahuila",), ("edomex",), ("mexico",), ("x",), ("",)], "e string")
    got = [r[0] for r in df.select(J.canonical_name(F.col("e"), names, {"edomex": "mexico"})).collect()]
    assert got == ["coahuila de zaragoza", "mexico", "mexico", None, None]


def test_sources_and_registries(spark):
    exact = spark.createDataFrame([("01000", 1.0, 1.0, 1, 1), ("01000", 2.0, 2.0, 2, 2), ("01000", 3.0, 3.0, 2, 3)], "cp string, lat double, lng double, q int, pos int")
    town = spark.createDataFrame([("01000", 9.0, 9.0, 9, 9), ("02000", 8.0, 8.0, 0, 1)], "cp string, lat double, lng double, q int, pos int")
    got = {r.cp: (r.lat, r.precision) for r in J.rank_sources(exact, town, "cp", "q", "pos").collect()}
    assert got == {"01000": (3.0, 0), "02000": (8.0, 1)}
    a = spark.createDataFrame([("x", "A"), ("", "Z")], "slug string, name string")
    b = spark.createDataFrame([("x", "B"), ("y", "C")], "slug string, name string")
    assert {(r.slug, r.name) for r in J.merge_registries([a, b], "slug", "name").collect()} == {("x", "A"), ("y", "C")}


def test_upper_median_metrics(spark):
    rows = [("z", "venta", False, float(v)) for v in (1, 2, 3, 4, 100, 0)] + [("z", "renta", False, float(v)) for v in (10, 20, 30, 40, 50)]
    df = spark.createDataFrame(rows, "zone string, operation string, is_land boolean, pm2_mxn double").withColumn("land_pm2_mxn", F.lit(0.0))
    r = R.market_metrics(df).first()
    assert (r.pm2_sale, r.n_sale, r.pm2_rent, r.n_rent) == (3, 6, 30, 5)
    assert r.gross_yield == np.floor(30 * 12 / 3 * 1000 + 0.5) / 10
    few = R.market_metrics(df.filter("pm2_mxn <> 50")).first()
    assert few.gross_yield is None


def test_tracker_rules(spark):
    old = spark.createDataFrame(
        [("z", 1, "2024-01-01", 100.0, "MXN"), ("z", 2, "2024-01-01", 100.0, "MXN"), ("z", 3, "2024-01-01", 100.0, "USD"), ("z", 4, "2024-01-10", 50.0, "MXN")],
        "zone string, id int, first_seen string, price double, currency string",
    ).withColumn("first_seen", F.to_date("first_seen")).withColumn("changes", F.array().cast(M.CHANGE))
    snap = spark.createDataFrame([("z", 1, 90.0, "MXN"), ("z", 2, 100.0, None), ("z", 3, 100.0, "MXN"), ("z", 5, 10.0, "MXN"), ("z", 6, 0.0, "MXN")], "zone string, id int, price double, currency string")
    d = {r.id: r for r in M.diff_snapshot(snap, old, "2024-02-01", ["zone", "id"]).collect()}
    assert {k: r.status for k, r in d.items()} == {1: "cut", 2: "same", 3: "reset", 4: "closed", 5: "new"}
    assert [(c["from"], c["to"], str(c["at"])) for c in d[1].changes] == [(100.0, 90.0, "2024-02-01")]
    assert str(d[3].first_seen) == "2024-02-01" and d[4].days_on_market == 22
    tracked = M.open_listings(M.diff_snapshot(snap, old, "2024-02-01", ["zone", "id"]), ["zone", "id"])
    price = 90.0
    for i in range(12):  # all changes stay, fewer on request
        price -= 1
        s = spark.createDataFrame([("z", 1, price, "MXN")], "zone string, id int, price double, currency string")
        tracked = M.open_listings(M.diff_snapshot(s, tracked, f"2024-03-{i + 1:02d}", ["zone", "id"]), ["zone", "id"])
        tracked = spark.createDataFrame(tracked.collect(), tracked.schema)
    last = tracked.first()
    assert len(last.changes) == 13 and last.changes[-1]["to"] == 78.0 and last.changes[0]["from"] == 100.0
    s = spark.createDataFrame([("z", 1, 77.0, "MXN")], "zone string, id int, price double, currency string")
    few = M.diff_snapshot(s, tracked, "2024-04-01", ["zone", "id"], M.PUBLISHED_CHANGES).first().changes
    assert len(few) == 10 and few[-1]["to"] == 77.0 and few[0]["from"] == 87.0


def test_closures_forget_reappeared(spark):
    prev = spark.createDataFrame([("z", 1, "2024-01-01"), ("z", 2, "2024-01-05")], "zone string, id int, closed_on string").select("zone", "id", F.to_date("closed_on").alias("closed_on"), F.lit(1.0).alias("price"), F.lit(3).alias("days"))
    diff = spark.createDataFrame([("z", 1, "new", 5.0, None), ("z", 7, "closed", 6.0, 4)], "zone string, id int, status string, price double, days_on_market int")
    got = sorted(r.id for r in M.closures(prev, diff, "2024-02-01", ["zone", "id"], "zone").collect())
    assert got == [2, 7]
    assert [r.id for r in M.closures(prev, diff, "2024-02-01", ["zone", "id"], "zone", 1).collect()] == [7]


def greedy(rows, budget, n=3):
    picks, used, spent = [], set(), 0
    order = sorted(rows, key=lambda r: (-r[3], r[1]))
    for r in order:
        if len(picks) >= n:
            break
        if r[0] in used or spent + r[2] > budget:
            continue
        picks.append(r)
        used.add(r[0])
        spent += r[2]
    if len(picks) < n:
        for r in order:
            if len(picks) >= n:
                break
            if any(p[1] == r[1] for p in picks) or spent + r[2] > budget:
                continue
            picks.append(r)
            spent += r[2]
    return [p[1] for p in picks]


@pytest.mark.parametrize("seed,budget", [(1, 100.0), (2, 60.0), (3, 20.0), (4, 1.0)])
def test_greedy_basket(spark, seed, budget):
    rng = np.random.default_rng(seed)
    rows = [(f"z{int(rng.integers(0, 4))}", i, float(rng.integers(5, 60)), float(rng.integers(0, 9))) for i in range(25)]
    df = spark.createDataFrame(rows, "zone string, id int, price double, score double")
    got = [r.id for r in M.greedy_basket(df, budget, "zone", "id").orderBy("pick").collect()]
    assert got == greedy(rows, budget)


def test_rows_that_no_basket_can_hold_are_left_out(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"z{i % 30}", i, float(rng.integers(5, 600)), float(rng.integers(0, 90))) for i in range(6000)]
    rows += [("hot", 17, 4.0, 1.0), (None, 9001, 3.0, 2.0)]
    df = spark.createDataFrame(rows, "zone string, id int, price double, score double").repartition(3)
    front = M.undominated(df, "zone", "id", 3).collect()
    assert len(front) < 600
    for budget in (10.0, 200.0, 900.0):
        got = [r.id for r in M.greedy_basket(df.filter("zone is not null and not (id = 17 and price = 4.0)"), budget, "zone", "id").orderBy("pick").collect()]
        assert got == greedy(rows[:6000], budget)
    assert M.greedy_basket(df, 1.0, "zone", "id").count() == 0 and M.greedy_basket(df, 900.0, "zone", "id", n=0).count() == 0


def test_alerts(spark):
    alerts = spark.createDataFrame([(1, "a", 3, 5.0, True, None), (2, "a", 3, 5.0, True, 10.0), (3, "a", 3, 50.0, True, 10.0), (4, "a", 3, 1.0, False, 0.0), (5, "x", 3, 1.0, True, 0.0), (6, "a", 3, 5.0, True, 9.0)], "id int, zone string, horizon int, threshold double, active boolean, last_value double")
    fc = spark.createDataFrame([("a", 3, 1.2346)], "zone string, horizon int, f double")
    out = M.threshold_alerts(alerts, fc)
    got = {r.id: (r.action, r.last_value_next) for r in out.collect()}
    assert got == {1: ("baseline", 23.5), 2: ("alert", 23.5), 3: ("quiet", 10.0), 6: ("alert", 23.5)}
    m = M.alert_messages(out).collect()
    assert len(m) == 1 and (m[0].watchers, m[0].last_value, m[0].delta) == (2, 10.0, 13.5)


def test_search(spark):
    df = spark.createDataFrame([(1, "venta", "Casa sola", 3, 2, 10.0, 50.0, 7.0, "z", -5), (2, "renta", "casa", 3, 2, 5.0, 50.0, 7.0, "z", None), (3, "venta", "casa", None, 2, 7.0, 50.0, None, "y", -20)], "id int, operation string, kind string, rooms int, baths int, price double, m2_built double, zone_yield double, zone string, vs int")
    df = df.withColumn("kind", F.lower("kind"))
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(M.search(df, "fair_price")) == [3, 1, 2]
    assert ids(M.search(df, "yield")) == [1, 2, 3]
    assert ids(M.search(df, "price_asc", operation="venta")) == [3, 1]
    assert ids(M.search(df, "price_desc", rooms_min=2, kind="CASA", budget_max=9)) == [2]
    assert ids(M.search(df, "yield", yield_min=6, zones=["z"])) == [1, 2]


def test_trailing_rate_needs_all_months(spark):
    wide = spark.createDataFrame([("e", "o", 2023) + tuple(["1,000"] + ["1"] * 11), ("e", "o", 2024) + tuple(["5", "6"] + [" "] * 10), ("f", "o", 2024) + tuple(["1"] * 11 + [""])], "entity string, offence string, year int, " + ", ".join(f"m{i} string" for i in range(1, 13)))
    long = R.unpivot_months(wide, ["entity", "offence", "year"], [f"m{i}" for i in range(1, 13)]).withColumn("period", F.col("year") * 100 + F.col("month"))
    pop = spark.createDataFrame([("e", 1000.0), ("f", 10.0)], "entity string, population double")
    got = R.trailing_rate(long, pop).collect()
    assert len(got) == 1 and (got[0].entity, got[0].total, got[0].cut, got[0].rate) == ("e", 5 + 6 + 10, 202402, 2100.0)


def test_contracts(spark):
    rows = [(i, "e", 2020 + i % 6, "mxn" if i % 4 else "usd", None if i % 5 == 0 else float(i)) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "id int, e string, y int, cur string, amt double")
    totals, top = R.contract_rollup(df, "e", "y", F.col("cur") == "mxn", "amt", "id", [])
    t = {r.y: (r.n, r.amount) for r in totals.collect()}
    for y in range(2020, 2026):
        sub = [r for r in rows if r[2] == y]
        assert t[y] == (len(sub), sum(r[4] for r in sub if r[3] == "mxn" and r[4] is not None))
    sums, best = R.contract_window(totals, top, "e", "y", "id")
    win = [r for r in rows if r[2] >= 2021]
    assert (sums.first().n, sums.first().amount) == (len(win), sum(r[4] for r in win if r[3] == "mxn" and r[4] is not None))
    want = sorted([r for r in win if r[3] == "mxn" and r[4] is not None], key=lambda r: -r[4])[:5]
    assert [r.id for r in best.orderBy("rank").collect()] == [w[0] for w in want]


def test_recent_needs_two_cuts(spark):
    df = spark.createDataFrame([("a", "2020"), ("a", "2021"), ("a", "2022"), ("b", "2022")], "st string, d string")
    got = [(r.st, r.d, r.recent) for r in R.recent_flag(df, "d", per=["st"]).orderBy("st", "d").collect()]
    assert got == [("a", "2020", False), ("a", "2021", True), ("a", "2022", True), ("b", "2022", False)]
    assert [r.recent for r in R.recent_flag(df.filter("d = '2022'"), "d").collect()] == [False, False]
