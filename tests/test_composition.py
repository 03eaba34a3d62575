import pytest
from pyspark.sql import functions as F

from recordaudit.operators import composition as C

CONS = [("SiO2", "Si", 1, 2, 4.0, 60.083, "oxide"), ("Al2O3", "Al", 2, 3, 3.0, 101.961, "oxide"), ("CaO", "Ca", 1, 1, 2.0, 56.077, "oxide"), ("FeO", "Fe", 1, 1, 2.0, 71.844, "oxide"),
        ("F", "F", 1, 0, -1.0, 18.998, "element-anion"), ("H2O", "H", 2, 1, 1.0, 18.015, "water"), ("UO2", "U", 1, 2, 4.0, 270.028, "oxide"), ("UO3", "U", 1, 3, 6.0, 286.027, "oxide")]


@pytest.fixture()
def constituents(spark):
    return spark.createDataFrame(CONS, "formula string, element string, n_cat int, n_o int, charge double, mw double, kind string")


def rows_of(spark, constituents, weights):
    points = spark.createDataFrame([("s", p, c, w) for p, c, w in weights], "sample_id string, point int, constituent string, wt double")
    return C.with_constituents(C.replicate_stats(points), constituents)


def test_anorthite_on_eight_oxygens(spark, constituents):
    rows = rows_of(spark, constituents, [(1, "CaO", 20.16), (1, "Al2O3", 36.65), (1, "SiO2", 43.19), (2, "CaO", 20.16), (2, "Al2O3", 36.65), (2, "SiO2", 43.19)])
    red = C.normalise(rows, C.Basis("O", 8.0))
    got = {r.element: r.apfu for r in red.collect()}
    assert got["Ca"] == pytest.approx(1, abs=0.01) and got["Al"] == pytest.approx(2, abs=0.01) and got["Si"] == pytest.approx(2, abs=0.01)
    assert red.first().sample_charge == pytest.approx(0, abs=1e-9)
    assert red.agg(F.sum("o_apfu")).first()[0] == pytest.approx(8)
    assert C.empirical_formula(red).first().formula == "Al2CaSi2O8"


def test_halogen_sums_to_the_basis(spark, constituents):
    red = C.normalise(rows_of(spark, constituents, [(1, "SiO2", 40.0), (1, "CaO", 40.0), (1, "F", 4.0)]), C.Basis("O", 5.0))
    assert red.agg(F.sum("o_apfu")).first()[0] == pytest.approx(5)


def loop(weights, adds, basis_n):
    """Rounds of the plain definition on an anion basis, to a fixed point."""
    info = {c[0]: c for c in CONS}
    mean = dict(weights)
    for formula, _mode, _value in adds:
        mean[formula] = 0.0
    for _ in range(3000):
        tot = 0.0
        for f, w in mean.items():
            _, _, n_cat, n_o, _, mw, kind = info[f]
            tot += w / mw * (n_o if kind == "oxide" else n_cat * 0.5 if kind == "element-anion" else 1)
        fac = basis_n / tot
        corr = sum(w * 15.999 / 18.998 * 0.5 for f, w in mean.items() if f == "F")
        for formula, mode, value in adds:
            _, _, n_cat, _, _, mw, _ = info[formula]
            if mode == "structure":
                mean[formula] = value / (n_cat * fac) * mw
        for formula, mode, _ in adds:
            if mode == "difference":
                mean[formula] = max(0.0, 100 - (sum(w for f, w in mean.items() if f != formula) - corr))
    return mean


@pytest.mark.parametrize("adds", [[("F", "structure", 1.0)], [("H2O", "difference", 0.0)], [("H2O", "structure", 4.0)], [("F", "structure", 0.5), ("H2O", "difference", 0.0)]])
def test_unmeasured_constituents_are_the_fixed_point(spark, constituents, adds):
    weights = {"SiO2": 30.0, "Al2O3": 20.0, "CaO": 25.0}
    info = {c[0]: c for c in CONS}
    rows = rows_of(spark, constituents, [(1, c, w) for c, w in weights.items()])
    out = C.add_unmeasured(rows, C.Basis("O", 12.0), [C.Added(*info[f], mode=m, value=v) for f, m, v in adds])
    got, want = {r.constituent: r.mean for r in out.collect()}, loop(weights, adds, 12.0)
    for f in want:
        assert got[f] == pytest.approx(want[f], abs=1e-4)


def test_unknown_mode_and_basis_raise(spark, constituents):
    rows = rows_of(spark, constituents, [(1, "CaO", 20.0)])
    with pytest.raises(ValueError):
        C.add_unmeasured(rows, C.Basis("O", 1.0), [C.Added("F", "F", 1, 0, -1, 18.998, "element-anion", "guess")])
    with pytest.raises(ValueError):
        C.normalise(rows, C.Basis("moles", 1.0))


def test_conversion_scales_by_mass_per_cation(spark, constituents):
    rows = C.convert(rows_of(spark, constituents, [(1, "UO2", 50.0)]), constituents, [("UO2", "UO3")])
    r = rows.first()
    assert r.constituent == "UO3" and r.mean == pytest.approx(50 * 286.027 / 270.028)


def test_compatibility_category(spark):
    w = spark.createDataFrame([("s", "SiO2", 100.0), ("s", "Xx", 1.0)], "sample_id string, constituent string, wt double")
    o = spark.createDataFrame([("s", 1.545, 2.65)], "sample_id string, n_mean double, density double")
    k = spark.createDataFrame([("SiO2", 0.208)], "constituent string, k double")
    r = C.compatibility_index(w, o, k).first()
    assert r.kc == pytest.approx(0.208) and r.ci == pytest.approx(1 - 0.545 / 2.65 / 0.208) and r.category == "superior" and r.missing == "Xx"


def test_replication_finds_the_basis(spark, constituents):
    rows = rows_of(spark, constituents, [(1, f, 100 * m / 278.204) for f, m in (("CaO", 56.077), ("Al2O3", 101.961), ("SiO2", 120.166))])
    pub = spark.createDataFrame([("s", "Ca", 1.0), ("s", "Al", 2.0), ("s", "Si", 2.0), ("s", "O", 8.0)], "sample_id string, element string, n double")
    best = C.replicate_formula(rows, pub)
    r = best.first()
    assert (r.kind, r.n) == ("O", 8.0) and r.score < 0.001 and r.const_factor is None
    wrong = pub.withColumn("n", F.when(F.col("element") == "Ca", 1.3).otherwise(F.col("n")))
    diffs = C.formula_differences(rows, wrong, C.replicate_formula(rows, wrong)).collect()
    assert "Ca" in {d.element for d in diffs}
