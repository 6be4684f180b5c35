import pytest
from pyspark.sql import functions as F

from terrametra.functions import text
from terrametra.functions.constants import BUSINESS_LINES, INDICATOR_SPECIES
from terrametra.operators import cleaning as C


def test_sector_and_band_defaults(spark):
    df = spark.createDataFrame([("722515", "0 a 5 personas"), ("431110", "251 y más personas"), ("99", "?"), (None, None)], "c string, b string")
    rows = df.select(C.sector_of(F.col("c")), C.employment_of(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("Alimentos", 3), ("Comercio", 400), ("Servicios", 3), ("Servicios", 3)]


def test_keys(spark):
    r = spark.range(1).select(C.area_key(F.lit("9"), F.lit("12")).alias("a"), C.postal_key(F.lit("2020.0")).alias("b"), C.postal_key(F.lit("x")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("09012", "02020", None)


def test_street_name(spark):
    df = spark.createDataFrame([("AVENIDA", "avenida juarez"), ("CALLE", "5 de mayo"), (None, "eje 5"), ("CALLE", ""), ("", "ab")], "k string, n string")
    got = [r[0] for r in df.select(C.street_name(F.col("k"), F.col("n"))).collect()]
    assert got == ["Avenida Juarez", "Calle 5 De Mayo", "Eje 5", "Calle", None]


def test_coordinates(spark):
    df = spark.createDataFrame([("19.4", "-99"), ("NaN", "-99"), ("inf", "0"), ("x", "1"), ("91", "0"), ("19", None)], "lat string, lng string")
    assert C.valid_coordinates(df).count() == 1
    assert C.valid_coordinates(df, box=C.NATIONAL_BOX).count() == 1


def test_keyword_classes(spark):
    df = spark.createDataFrame([("Cafetería y Gimnasio Fénix",), ("Nada",)], "n string")
    n = text.ascii_upper(F.col("n"))
    a, b = df.select(text.first_category(n, BUSINESS_LINES), text.all_categories(text.ascii_upper(F.lit("CAFE YOGA BARBER")), INDICATOR_SPECIES)).collect()
    assert a[0] == "Cafetería" and b[0] is None
    assert a[1] == ["Café de especialidad", "Barbería premium", "Estudio de yoga"]


def test_price_windows_are_open(spark):
    df = spark.createDataFrame([(3000.0, 1.0), (3001.0, 1.0), (3001.0 * 15, 15.0), (200000.0 * 20, 20.0), (210000.0 * 20, 20.0)], "p double, m double")
    rows = df.select(*[C.plausible_price(F.col("p"), F.col("m"), u) for u in ("sample", "regression", "verdict")]).collect()
    assert [tuple(r) for r in rows] == [(False, False, False), (False, True, False), (True, True, False), (True, False, False), (True, False, False)]


def test_public_fields_hide_contacts(spark):
    df = spark.createDataFrame([(1, "x@y", "555")], "id int, email string, telefono string")
    assert "email" not in C.public_fields(df).columns and "telefono" not in C.public_fields(df).columns


def test_leads(spark):
    rows = [
        ("Ana Díaz", "55 1234 5678", "", "z" * 300),
        ("Bot", "5512345678", "http://x", ""),
        ("Al", "5512345678", "", ""),
        ("Luis Paz", "123", "", ""),
    ]
    df = spark.createDataFrame(rows, "nombre string, telefono string, website string, ref string").withColumn("secreto", F.lit("x"))
    got = C.clean_leads(df).collect()
    assert [r.rejected for r in got] == [None, "honeypot", "name", "phone"]
    assert len(got[0].ref) == 300 and "secreto" not in got[0].asDict()
    assert len(C.clean_leads(df, width=C.LEAD_WIDTH).first().ref) == 200
    assert [r.rejected for r in C.clean_leads(df, max_bytes=100).collect()][0] == "size"


def test_geo_sanity_limit_is_300_km(spark):
    df = spark.createDataFrame([(1, "a", 19.0, -99.0), (2, "a", 21.6, -99.0), (3, "a", 21.8, -99.0), (4, "b", 40.0, 0.0), (5, "a", None, None)], "id int, st string, lat double, lng double")
    cities = spark.createDataFrame([("a", 19.0, -99.0)], "st string, c_lat double, c_lng double")
    got = {r.id: (r.lat, r.geo_broken) for r in C.geo_sanity(df, cities, "st").collect()}
    assert got[1] == (19.0, False) and got[2] == (21.6, False) and got[3] == (None, True) and got[4] == (40.0, False) and got[5] == (None, False)


def test_unit_price_and_land(spark):
    df = spark.createDataFrame([(100.0, "USD", 8.0, None), (100.0, "MXN", None, 40.0), (None, "MXN", 10.0, None)], "price double, currency string, m2_built double, m2_land double")
    a, b, c = C.with_unit_price(df).collect()
    assert (a.pm2, a.pm2_mxn, a.is_land) == (13, 13 * 17.5, False)
    assert (b.pm2, b.land_pm2_mxn, b.is_land) == (None, 2.5, True)
    assert (c.pm2, c.pm2_mxn) == (None, 0.0)


def test_branches(spark):
    lines = ["lat,lng,name", "19.4,-99.1,Norte", "", "abc,1", "19.5,-99.2", "95,0", "19.6, -99.3, nan", "7"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    got = C.parse_branches(df).collect()
    ok = sorted((r.line_no, r.name, r.lat) for r in got if r.ok)
    assert ok == [(1, "Norte", 19.4), (4, "Branch 2", 19.5), (6, "Branch 3", 19.6)]
    assert len(got) == 6  # attempted


def test_coverage_gate(spark):
    df = spark.createDataFrame([("obra", "x"), ("obra", None), ("otro", None), ("obra", None)], "k string, e string")
    rep = C.coverage_gate(df, F.col("k") == "obra", F.col("e").isNotNull())
    r = rep.first()
    assert (r["rows"], r.eligible, r.unidentified, r.passed) == (4, 3, 2, False)
    with pytest.raises(ValueError):
        C.require_coverage(rep)


def test_tag_entity(spark):
    df = spark.createDataFrame([("México, Morelos, Cuautla",), ("Toluca, Mexico",), ("Repotenciación de la línea",), (None,)], "t string")
    got = [r[0] for r in df.select(C.tag_entity(F.col("t"), {"morelos": "morelos", "mexico": "mexico"})).collect()]
    assert got == ["morelos", "mexico", None, None]


def test_drought(spark):
    towns = spark.createDataFrame([("Mérida", "Yucatán"), ("Nadie", "X")], "t string, s string")
    mon = spark.createDataFrame([("merida", "yucatan", 3)], "mun string, ent string, level int")
    got = {r.t: (r.level, r.drought) for r in C.drought_lookup(towns, mon, "t", "s").collect()}
    assert got["Mérida"][0] == 3 and got["Mérida"][1].startswith("D2") and got["Nadie"] == (None, None)
