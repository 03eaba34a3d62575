import random

import pytest
from pyspark.sql import functions as F

from recordaudit.operators import structures as X
from recordaudit.plans.structures import FACTORS, PARAMS, operator_rows


@pytest.fixture()
def rutile(spark):
    cells = spark.createDataFrame([(1, 4.5937, 4.5937, 2.9587, 90.0, 90.0, 90.0)], "structure_id int, a double, b double, c double, al double, be double, ga double")
    sites = spark.createDataFrame([(1, "Ti1", "Ti", 4, 1.0, 0.0, 0.0, 0.0), (1, "O1", "O", -2, 1.0, 0.3047, 0.3047, 0.0)], "structure_id int, label string, element string, ox int, occ double, x double, y double, z double")
    return cells, sites, operator_rows(spark).withColumn("structure_id", F.lit(1))


def test_rutile_pattern(spark, rutile):
    cells, sites, ops = rutile
    lines = {(r.h, r.k, r.l): r for r in X.powder_pattern(cells, sites, ops, spark.sql(FACTORS), 1.5406, 1.0).collect()}
    first = max(lines.values(), key=lambda r: r.d)
    assert (first.h, first.k, first.l) == (1, 1, 0) and first.d == pytest.approx(3.248, abs=0.001) and first.i == pytest.approx(100) and first.mult == 4
    assert first.two_theta == pytest.approx(27.44, abs=0.01)
    assert lines[(2, 1, 1)].mult == 16 and (1, 0, 0) not in lines


def test_rutile_bonds(spark, rutile):
    cells, sites, ops = rutile
    near = X.neighbours(sites, ops, cells)
    species = sites.select("structure_id", "label", "element", "ox", "occ")
    bonds = X.bond_valences(near, species, X.best_parameters(spark.sql(PARAMS), ["a"]))
    ti = X.cation_sums(bonds, species).first()
    assert ti.coordination == 6 and ti.bvs == pytest.approx(4, abs=0.15) and ti.expected == 4
    o = X.anion_sums(bonds, X.multiplicities(X.expand_symmetry(sites, ops))).first()
    assert o.s_cat == pytest.approx(ti.bvs / 2)


def brute_contacts(cell, atoms, p, cutoff):
    import math

    out = []
    for q in atoms:
        for i in range(-4, 5):
            for j in range(-4, 5):
                for k in range(-4, 5):
                    d = math.dist((0, 0, 0), [(q[0] + i - p[0]) * cell[0], (q[1] + j - p[1]) * cell[1], (q[2] + k - p[2]) * cell[2]])
                    if 0.3 < d <= cutoff:
                        out.append(round(d, 6))
    return sorted(out)


def test_contacts_lose_nothing(spark, rutile):
    cells, sites, ops = rutile
    images = X.expand_symmetry(sites, ops)
    atoms = [(r.x, r.y, r.z) for r in images.collect()]
    for cutoff in (2.0, 3.2, 6.0):
        centre = sites.where("label = 'O1'").select("structure_id", "label", "x", "y", "z", F.lit(cutoff).alias("cutoff"))
        got = sorted(round(r.dist, 6) for r in X.contacts(centre, images, cells).collect())
        assert got == brute_contacts((4.5937, 4.5937, 2.9587), atoms, (0.3047, 0.3047, 0.0), cutoff)


def test_triclinic_cell_from_its_reflections(spark):
    from recordaudit.functions.cell import d_spacing

    cell = (5.1, 6.2, 7.3, 85.0, 97.0, 103.0)
    rows = spark.range(1).select(F.lit(1).alias("entry_id"), F.lit("triclinic").alias("system"), F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("h"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("NOT (h = 0 AND k = 0 AND l = 0)")
    rows = rows.withColumn("d", d_spacing([F.lit(v) for v in cell], F.col("h"), F.col("k"), F.col("l")))
    fit = X.fit_cell(rows).first()
    assert [fit[c] for c in X.CELL] == pytest.approx(cell, abs=1e-6)
    assert X.fit_cell(rows.limit(6)).count() == 0


def test_absences_of_a_centring(spark):
    ops = spark.createDataFrame([("I", [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [0.5, 0.5, 0.5])], "space_group string, rot array<array<int>>, tr array<double>")
    hkl = spark.createDataFrame([("I", 1, 0, 0), ("I", 1, 1, 0), ("I", 0, 0, 0), ("P", 1, 0, 0)], "space_group string, h int, k int, l int")
    got = {(r.space_group, r.h, r.k, r.l): r.absent for r in X.systematic_absences(hkl, ops).collect()}
    assert got == {("I", 1, 0, 0): True, ("I", 1, 1, 0): False, ("I", 0, 0, 0): False, ("P", 1, 0, 0): False}


def test_first_shell_cut(spark):
    rows = [(1, "C", f"O{n}", 1.28, 1, 1.3, 1.3) for n in range(3)] + [(1, "C", "O9", 2.9, 2, 0.04, 0.04)]
    bonds = spark.createDataFrame(rows, "structure_id int, label string, other string, dist double, n int, s double, s_max double")
    assert {r.other for r in X.first_shell(bonds).collect()} == {"O0", "O1", "O2"}


def test_scaled_columns_are_named(spark):
    rng, computed, printed, kind = random.Random(8), [], [], {}
    for structure in range(300):
        kind[structure] = ("scaled", "slips", "clean")[structure % 3]
        factor = rng.choice([0.85, 0.9, 1.12, 1.25])
        for row in range(rng.randrange(4, 9)):
            s = rng.choice([rng.uniform(0.03, 0.2), rng.uniform(0.2, 1.3)])
            off = s * (factor - 1) if kind[structure] == "scaled" else rng.choice([-1, 1]) * rng.uniform(0.1, 0.3) if kind[structure] == "slips" and rng.random() < 0.5 else 0.0
            computed.append((structure, f"O{row}", "M1", s))
            printed.append((structure, f"O{row}", "M1", round(s + off + rng.uniform(-0.004, 0.004), 3)))
    schema = "structure_id int, row_label string, col_label string, s double"
    told = X.diagnose_columns(X.compare_valence_tables(spark.createDataFrame(computed, schema), spark.createDataFrame(printed, schema))).collect()
    named = {k: sum(r.verdict == "scaled" for r in told if kind[r.structure_id] == k) / 100 for k in ("scaled", "slips", "clean")}
    assert named["scaled"] >= 0.82 and named["slips"] <= 0.05 and named["clean"] == 0


def test_printed_table_against_pattern(spark):
    ops = spark.createDataFrame([(s, [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [0.0, 0.0, 0.0]) for s in (1, 2, 3)], "structure_id int, rot array<array<int>>, tr array<double>")
    schema = "structure_id int, h int, k int, l int, d double, i double"
    pattern = spark.createDataFrame([
        (1, 1, 1, 1, 3.0, 100.0), (1, 1, -1, 1, 2.5, 40.0), (1, 2, 0, 0, 2.0, 5.0),  # a bar is lost in print
        (2, 1, 0, 0, 3.0, 60.0), (2, 0, 1, 0, 3.001, 70.0), (2, 0, 0, 2, 2.0, 100.0),  # two lines printed as their sum
        (3, 1, 0, 0, 3.0, 100.0), (3, 0, 1, 0, 3.001, 50.0), (3, 0, 0, 2, 2.0, 20.0),  # one of two lines left out, in no other's intensity
    ], schema)
    table = spark.createDataFrame([
        (1, 1, 1, 1, 3.0, 100.0), (1, 1, 1, 1, 2.5, 40.0), (1, 2, 0, 0, 2.1, 5.0), (1, 2, 0, 0, 2.1, 5.0), (1, 7, 7, 7, 1.0, 5.0),
        (2, 1, 0, 0, 3.0, 100.0), (2, 0, 0, 2, 2.0, 100 / 1.3), (3, -1, 0, 0, 3.0, 100.0), (3, 0, 0, 2, 2.0, 20.0),
    ], schema)
    got = {r.structure_id: tuple(r)[1:] for r in X.table_vs_pattern(table, pattern, ops).collect()}
    assert got == {1: (5, 4, 2, 0.0, 0), 2: (2, 2, 0, 0.0, 0), 3: (2, 2, 0, 0.0, 1)}
