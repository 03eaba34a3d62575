import pytest
from pyspark.sql import functions as F

from recordaudit.functions import cell as K, names as N
from recordaudit.functions.elements import constituent_dimension, explode_elements
from recordaudit.functions.measured import format_with_esd, parse_measured, round_half_up


def test_parse_measured(spark):
    rows = spark.createDataFrame([("7.08950(12)",), ("90",), ("6.30 32 (6)",), ("?",), (None,), ("-0.5(1)",)], "t string")
    got = [tuple(r.m) for r in rows.select(parse_measured(F.col("t")).alias("m")).collect()]
    assert got[0][:3] == (7.0895, "7.08950", "12") and got[0][4] == 5
    assert got[0][3] == pytest.approx(0.00012)
    assert got[1] == (90.0, "90", "", None, 0)
    assert got[2][:3] == (6.3032, "6.3032", "6")
    assert got[3][0] is None and got[4][0] is None
    assert got[5][0] == -0.5


def test_half_up_and_uncertainty(spark):
    rows = spark.createDataFrame([(2.675, 2), (0.125, 2), (-2.5, 0), (1.005, 2)], "x double, n int")
    assert [r.v for r in rows.select(round_half_up(F.col("x"), F.col("n")).alias("v")).collect()] == [2.68, 0.13, -3.0, 1.01]
    pairs = spark.createDataFrame([(2.1234, 0.0198), (2.1234, 0.03), (2.1234, None), (2.1234, 0.0014)], "v double, e double")
    assert [r.t for r in pairs.select(format_with_esd(F.col("v"), F.col("e")).alias("t")).collect()] == ["2.123(20)", "2.12(3)", "2.123", "2.1234(14)"]


def test_constituents(spark):
    d = {r.formula: r for r in constituent_dimension(spark.createDataFrame([("Al2O3",), ("H2O(calc)",), ("F",), ("Nb205",), ("Xx2",), ("UO3*",), ("CaCO3",)], "formula string")).collect()}
    assert (d["Al2O3"].element, d["Al2O3"].n_cat, d["Al2O3"].n_o, d["Al2O3"].charge, d["Al2O3"].kind) == ("Al", 2, 3, 3.0, "oxide")
    assert d["Al2O3"].mw == pytest.approx(101.961)
    assert d["H2O"].kind == "water" and d["F"].charge == -1.0 and d["UO3"].charge == 6.0
    assert d["Nb2O5"].n_o == 5 and d["CaCO3"].kind == "other" and "Xx2" not in d


def test_elements_drop_valence(spark):
    f = spark.createDataFrame([(1, "Fe3+2O3"), (2, "CaMg0.5Ca2(OH)")], "id int, f string")
    got = {(r.id, r.element): r.n for r in explode_elements(f, "f", ["id"]).collect()}
    assert got == {(1, "Fe"): 2.0, (1, "O"): 3.0, (2, "Ca"): 3.0, (2, "Mg"): 0.5, (2, "O"): 1.0, (2, "H"): 1.0}


def test_cells(spark):
    one = spark.range(1)
    cubic = [F.lit(5.0)] * 3 + [F.lit(90.0)] * 3
    r = one.select(
        K.cell_volume(*cubic).alias("v"), K.d_spacing(cubic, F.lit(2), F.lit(0), F.lit(0)).alias("d"), K.two_theta(F.lit(0.7), F.lit(1.5406)).alias("none"),
        K.d_spacing([F.lit(4.0), F.lit(4.0), F.lit(6.0), F.lit(90.0), F.lit(90.0), F.lit(120.0)], F.lit(1), F.lit(0), F.lit(0)).alias("hex"),
        K.two_vz(F.lit(1.52), F.lit(1.53), F.lit(1.56)).alias("vz"), K.allowed_systems(cubic).alias("s"),
    ).first()
    assert r.v == pytest.approx(125) and r.d == pytest.approx(2.5) and r.none is None
    assert r.hex == pytest.approx(4 * 3**0.5 / 2)
    assert 55 < r.vz < 65 and "cubic" in r.s


def test_names(spark):
    rows = spark.createDataFrame([("Åsgruvanite-(Ce)",), ("Sørensen",), ("Łukasz-Groß",), ("Dypingite-syn",)], "n string")
    assert [r.x for r in rows.select(N.norm_name(F.col("n")).alias("x")).collect()] == ["asgruvanite-(ce)", "sorensen", "lukasz-gross", "dypingite"]
    pairs = spark.createDataFrame([("ca", "abc", 3), ("calcite", "clacite", 1), ("abcd", "abcd", 0), ("jarosite", "jarsoiet", 2)], "a string, b string, k int")
    assert all(r.d == r.k for r in pairs.withColumn("d", N.osa_distance("a", "b")).collect())
    f = spark.createDataFrame([("Lepersonnite-Gd",), ("gypsum, strontian",), ("Mica-2M",)], "n string").select(N.name_candidates(F.col("n")).alias("c"))
    got = [r.c for r in f.collect()]
    assert got[0][:2] == ["lepersonnite-gd", "lepersonnite-(gd)"] and got[1][-1] == "gypsum" and "mica" in got[2]
