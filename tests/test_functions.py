import math

from pyspark.sql import functions as F

from terrametra.functions import geo, numeric, text


def one(spark, **cols):
    row = spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()
    return row


def test_fold_and_slug(spark):
    r = one(
        spark,
        a=text.fold(F.lit("Québec Ñandú ß Łódź")),
        b=text.slug(F.lit("  Solidaridad / Riviera Maya, Q. Roo ")),
        c=text.ascii_upper(F.lit(" café nº 5 – ñ ")),
        d=text.fold_lower(F.lit(None).cast("string")),
        e=text.slug(F.lit("été")),
    )
    assert r.a == "Quebec Nandu ß Łodz"
    assert r.b == "solidaridad-riviera-maya-q-roo"
    assert r.c == "CAFE NO 5  N"
    assert r.d == ""
    assert r.e == "ete"


def test_names_and_titles(spark):
    r = one(
        spark,
        a=text.normalized_name(F.lit("Gral. Trías")),
        b=text.title_case(F.lit("o'higgins 3rd ÁLAMO")),
        c=text.normalized_name(F.lit("Sta. María (Pte.)")),
    )
    assert r.a == "GENERAL TRIAS"
    assert r.b == "o'higgins 3rd ÁLAMO".title()
    assert r.c == "SANTA MARIA PRESIDENTE"


def test_numbers_in_text(spark):
    r = one(
        spark,
        a=text.amount(F.lit("$1,234,567.89 ")),
        b=text.amount(F.lit("n/d")),
        c=text.first_number(F.lit("cerca de -1,099.5 m 7")),
        h=text.first_number(F.lit("1.2.3")),
        i=text.first_number(F.lit("aprox. 5")),
        d=text.year_in(F.lit("firma 1803, inicio 12/05/2019, fin 2021")),
        e=text.year_in(F.lit("sin fecha")),
        f=text.leading_year(F.lit("2021-05")),
        g=text.amount(F.lit("")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (1234567.89, None, -1099.5, 2019, None, 2021, None)
    assert (r.h, r.i) == (1.2, None)


def test_rounding_flavours(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-1.5,), (-2.5,)], "x double")
    rows = df.select("x", numeric.half_even(F.col("x")).alias("e"), numeric.half_up(F.col("x")).alias("u")).collect()
    assert [r.e for r in rows] == [0, 2, 2, -2, -2]
    assert [r.u for r in rows] == [math.floor(r.x + 0.5) for r in rows]


def test_growth_treats_zero_as_missing(spark):
    df = spark.createDataFrame([(100.0, 121.0, 2), (0.0, 5.0, 1), (5.0, 0.0, 1), (None, 3.0, 1), (4.0, 5.0, 0)], "a double, b double, n int")
    got = [r[0] for r in df.select(numeric.growth(F.col("a"), F.col("b"), F.col("n"))).collect()]
    assert abs(got[0] - 0.1) < 1e-12 and got[1:] == [None] * 4


def test_excel_date_and_days(spark):
    r = one(
        spark,
        a=F.date_format(numeric.excel_date(F.lit("45292")), "yyyy-MM-dd"),
        b=numeric.excel_date(F.lit("2024-01-01")),
        c=numeric.days_between(F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-02-01"))),
    )
    assert (r.a, r.b, r.c) == ("2024-01-01", None, 0)


def test_min_max_and_zscore(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "x double")
    out = sorted(r[0] for r in numeric.add_min_max(df, {"y": "x"}).select("y").collect())
    assert out[0] == 0 and abs(out[2] - 1) < 1e-8
    z = sorted(r[0] for r in numeric.add_zscore(df, {"z": "x"}).select("z").collect())
    assert abs(z[2] - 2 / (math.sqrt(8 / 3) + 1e-9)) < 1e-12
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r[0] for r in numeric.add_min_max(flat, {"y": "x"}).select("y").collect()] == [0.0, 0.0]


def test_haversine(spark):
    r = one(spark, d=geo.haversine_km(F.lit(19.432), F.lit(-99.133), F.lit(20.667), F.lit(-103.347)))
    p = math.pi / 180
    h = math.sin((20.667 - 19.432) * p / 2) ** 2 + math.cos(19.432 * p) * math.cos(20.667 * p) * math.sin((-103.347 + 99.133) * p / 2) ** 2
    assert abs(r.d - 2 * 6371 * math.asin(math.sqrt(h))) < 1e-9


def ring(*pts):
    return F.array(*[F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat")) for x, y in pts])


HORSESHOE = [(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10), (0, 0)]
HOLE = [(4, 0.5), (6, 0.5), (6, 1.5), (4, 1.5), (4, 0.5)]


def test_point_in_rings_with_hole(spark):
    g = F.array(ring(*HORSESHOE), ring(*HOLE))
    at = lambda x, y: geo.inside(g, F.lit(float(x)), F.lit(float(y)))
    r = one(spark, arm=at(1, 9), gap=at(5, 5), hole=at(5, 1), base=at(3, 1), out=at(11, 1))
    assert (r.arm, r.gap, r.hole, r.base, r.out) == (True, False, False, True, False)


def test_interior_point_of_a_horseshoe(spark):
    g = F.array(ring(*HORSESHOE))
    p = geo.interior_point(g)
    r = one(spark, p=p, ok=geo.inside(g, p["lng"], p["lat"]), c=geo.ring_centroid(ring((0, 0), (4, 0), (4, 2), (0, 2), (0, 0))))
    assert r.ok
    assert (round(r.c.lng, 9), round(r.c.lat, 9)) == (2.0, 1.0)


def test_segment_gap(spark):
    seg = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"))])
    r = one(
        spark,
        crossing=geo.segment_gap_sq(seg(0, 0, 2, 2), seg(0, 2, 2, 0)),
        parallel=geo.segment_gap_sq(seg(0, 0, 2, 0), seg(0, 3, 2, 3)),
        point=geo.segment_gap_sq(seg(1, 1, 1, 1), seg(4, 5, 4, 5)),
    )
    assert (r.crossing, r.parallel, r.point) == (0.0, 9.0, 25.0)


def test_drop_repeats_and_mean(spark):
    path = ring((1.000001, 2), (1.000002, 2), (1, 2), (3, 4), (3, 4), (1, 2))
    r = one(spark, a=geo.drop_repeats(path, 5), m=geo.mean_point(ring((0, 0), (2, 4))))
    assert [(p.lng, p.lat) for p in r.a] == [(1.0, 2.0), (3.0, 4.0), (1.0, 2.0)]
    assert (r.m.lng, r.m.lat) == (1.0, 2.0)


def test_distance_text(spark):
    r = one(spark, a=text.distance_text(F.lit(1530.0)), b=text.distance_text(F.lit(410.9)), c=text.distance_text(F.lit(None).cast("double")), d=text.distance_text(F.lit(float("nan"))))
    assert r.a.endswith("1.5 km") and r.b.endswith("410 m") and r.c == r.d


def test_long_rings_take_linear_time(spark):
    import time

    n = 20_000
    ring = [(math.cos(6.283185 * i / n), math.sin(6.283185 * i / n)) for i in range(n)]
    path = [p for p in ring for _ in range(2)]  # every vertex twice
    rows = [(1, [[*ring, ring[0]]], path)]
    df = spark.createDataFrame(rows, "id int, rings array<array<struct<lng double, lat double>>>, path array<struct<lng double, lat double>>")
    out = df.select(F.size(geo.drop_repeats(F.col("path"))).alias("n"), geo.interior_point(F.col("rings")).alias("p"), geo.ring_centroid(F.col("rings")[0]).alias("c"))
    out.collect()
    t = time.perf_counter()
    r = out.first()
    assert time.perf_counter() - t < 4  # a quadratic walk takes minutes
    assert r.n == n and abs(r.p.lng) < 1e-3 and abs(r.c.lng) + abs(r.c.lat) < 1e-6


def test_repeats_at_the_edges(spark):
    rows = [([],), (None,), ([(1.0, 1.0)],), ([(1.0, 1.0), (1.0, 1.0), (2.0, 1.0), (1.0, 1.0)],), ([(0.123456, 0.0), (0.123461, 0.0), (0.2, 0.0)],)]
    df = spark.createDataFrame(rows, "path array<struct<lng double, lat double>>")
    plain, rounded = (df.select(geo.drop_repeats(F.col("path"), d).alias("p")).collect() for d in (None, 4))
    assert [None if r.p is None else len(r.p) for r in plain] == [0, None, 1, 3, 3]
    assert [tuple(p) for p in rounded[4].p] == [(0.1235, 0.0), (0.2, 0.0)]
