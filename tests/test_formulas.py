import pytest

from recordaudit.operators import formulas as X


def fields(spark, rows):
    return spark.createDataFrame(rows, "entry_id int, field string, formula string")


@pytest.mark.parametrize("formula, want", [
    ("( Na2 Ca )2 Si8 O22", {"Na": 4.0, "Ca": 2.0, "Si": 8.0, "O": 22.0}),
    ("Al ( Si ( O H )3 )2", {"Al": 1.0, "Si": 2.0, "O": 6.0, "H": 6.0}),
    ("[ ( Fe0.78 +3 Al0.22 )2 ( P O4 ) ]3 !2 H2 O", {"Fe": 4.68, "Al": 1.32, "P": 3.0, "O": 14.0, "H": 4.0}),
    ("( ( $XS )0.91 Ca0.07 )$S I0.98 O", {"Ca": 0.07, "O": 1.0}), ("Fe3+2O3", {"Fe": 2.0, "O": 3.0}), ("", {}), (None, {}), ("Ca(Mg", {"Ca": 1.0, "Mg": 1.0}),
])
def test_elements_with_brackets(spark, formula, want):
    got = {r.element: r.n for r in X.elements_of(fields(spark, [(1, "A", formula)])).collect()}
    assert got == pytest.approx(want)


def test_findings(spark):
    f = "( Pb4.71 Zn0.36 Fe0.13 ) ( As1.71 Sb0.26 ) Ge1.92 S12"
    cases = [
        ("Analytical", f, "Analysis", f, None, None), ("Analytical", "( Pb10.8 Na0.3 )2 O", "Analysis", "Pb20.336 Na0.6 O", None, "Pb 21.600 vs 20.336"),
        ("Analytical", "Pb10.8 Na0.3 O", "Analysis", "Pb10.336 Na0.3 O", None, "Pb 10.800 vs 10.336"), ("Analytical", "Na1.00 Ca0.50 O", "Analysis", "Na1.02 Ca0.50 O", None, None),
        ("Analytical", "Na1.00 Ca0.50 Sr0.20 O", "Analysis", "Na1.00 Ca0.50 O", None, "Sr 0.200 vs absent"), ("Analytical", "Al042 Cu0.09 O7.97", "Analysis", None, None, "decimal point: Al042"),
        ("Analytical", "( Mo1:00 O3 )3", "Analysis", None, None, "colon: Mo1:00"), ("Analytical", "[ ( Na2 .86 K0.67 ) ] Mo8", "Analysis", None, None, "blank: Na2 .86"),
        ("Analytical", "Y0.59 Ca0.24 ) Cu6.04", "Analysis", None, None, "brackets: Y0.59 Ca0.24 ) Cu6.04"), ("Analytical", "Sr2.29 ( Ce0.55 T B0.01 Dy0.02 ) Si8", "Analysis", None, None, "the symbol Tb is split in two: T B0.01"),
        ("Analytical", "( N H4 )1.12 ( P O4 )2 ( C O3 )0.82", "Analysis", None, None, None), ("Analytical", "Ca1.0 O", "Analysis", None, "BAO", "BAO should be BaO"), ("Analytical", "Ca1.0 O", "Analysis", None, "P205", "P205 should be P2O5"),
        ("Analytical", "Ca1.0 O", "Analysis", None, "SiO2", None), ("Analytical", "Ca1.0 O", "Analysis", None, "Total", None),
    ]
    rows = [(i, x, y) for i, c in enumerate(cases) for x, y in (c[:2], c[2:4])]
    listed = spark.createDataFrame([(i, c[4]) for i, c in enumerate(cases) if c[4]], "entry_id int, constituent string")
    found = X.formula_findings(fields(spark, rows), listed).collect()
    got = {i: sorted(r.msg.split("disagree: ")[-1] for r in found if r.entry_id == i) for i in range(len(cases))}
    assert got == {i: [c[5]] if c[5] else [] for i, c in enumerate(cases)}


def test_element_of_one_field_alone(spark):
    rows = [(1, "Chemical", "Mn2 Mg5 Si8 O22"), (1, "General", "Mg5 S8 O22"), (1, "Empirical", "H2 Mg5 Mn2 O24 Si8"), (2, "Chemical", "Na Cl"), (2, "Empirical", "K Cl")]
    assert [tuple(r) for r in X.lone_elements(fields(spark, rows)).collect()] == [(1, "General", "S")]


def test_findings_read_a_formula_once_and_deal_it_by_entry(spark):
    rows = [(1, "Analytical", "( Pb1.00 Na0.50 )2 T B0.06"), (1, "Analysis", "Pb2.50 Na1.00 Tb0.06"), (1, "Empirical", "Na Pb08 S"), (2, "Analytical", "( Pb1.00"), (2, "Analysis", "Pb1.00")]
    table, listed = fields(spark, rows), spark.createDataFrame([(1, "BAO")], "entry_id int, constituent string")
    calls, whole = [], X.formula_atoms
    X.formula_atoms = lambda c: calls.append(1) or whole(c)
    try:
        found = X.formula_findings(table, listed)
    finally:
        X.formula_atoms = whole
    assert len(calls) == 1 and "FullOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.entry_id, r.anchor, r.msg) for r in found.collect()) == [
        (1, "analysis", "BAO should be BaO"), (1, "formula:Analytical", "Analytical and Analysis disagree: Pb 2.000 vs 2.500"),
        (1, "formula:Analytical", "the symbol Tb is split in two: T B0.06"), (1, "formula:Empirical", "S stands in no other formula"),
        (1, "formula:Empirical", "decimal point: Pb08"), (2, "formula:Analytical", "brackets: ( Pb1.00")]
