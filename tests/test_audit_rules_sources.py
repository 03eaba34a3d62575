import pytest
from pyspark.sql import functions as F

from recordaudit.operators import audit as A
from recordaudit.rules import engine as E, pack as P
from recordaudit.sources import readers as R


def test_multiset_difference_gives_the_new_run_back(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, "z")], "entry_id int, token string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (4, "z")], "entry_id int, token string")
    diff = {(r.entry_id, r.token): (r.gained, r.lost) for r in A.token_changes(old, new).collect()}
    assert diff == {(1, "a"): (0, 1), (1, "b"): (1, 0)}
    assert {(r.entry_id, r.change) for r in A.entry_membership(old, new).collect()} == {(3, "removed"), (4, "added")}


def test_triage_current_copy_rules(spark):
    rows = [(1, "f", "a", True, None, None, "l"), (1, "f", "b", False, "confirm", "n", None), (1, "g", "b", False, "dismiss", None, None), (1, "g", "c", False, "confirm", "m", None), (1, "h", "a", True, "look", None, None)]
    t = spark.createDataFrame(rows, "entry_id int, finding_key string, copy string, is_current boolean, verdict string, note string, label string")
    got = {r.finding_key: (r.verdict, r.note, r.label) for r in A.merge_triage(t).collect()}
    assert got == {"f": (None, "n", "l"), "g": ("confirm", "m", None), "h": (None, None, None)}


def test_hints(spark):
    m = spark.createDataFrame([("name should be 'Smithite, Ni'",), ("densities of 5.16, 5.41 and 4.84",), ("add Filter = Beta-Filter, FilterType = Ni.",), ("nothing",)], "m string")
    assert [r.h for r in m.select(A.hints(F.col("m")).alias("h")).collect()] == [[["Smithite", "Ni"]], [["5.16"], ["5.41"], ["4.84"]], [["Beta-Filter", "Ni"]], []]


def test_digit_swap(spark):
    rows = spark.createDataFrame([("3.843",), ("2.555",), ("1.100",), ("4.1",)], "d string")
    assert [r.s for r in rows.select(A.swap_digits(F.col("d")).alias("s")).collect()] == ["3.834", None, "1.010", None]


def test_seeded_slips_are_found(spark):
    from recordaudit.operators.matching import intensity_outliers, missing_lines

    lines = spark.createDataFrame([(e, n, "%.4f" % (5 - 0.31 * n + e * 0.01), 100.0 - 7 * n) for e in range(5) for n in range(12)], "entry_id int, line_no int, d_txt string, i double")
    paper = lines.select("entry_id", F.col("d_txt").cast("double").alias("d"), "i")
    own = lambda kind: A.seed_reflections(lines, kind).select("entry_id", F.col("d_txt").cast("double").alias("d"), "i")
    assert missing_lines(paper, own("drop")).count() == 5
    assert missing_lines(paper, own("scale")).count() == 5
    assert intensity_outliers(paper, own("slip")).count() == 5
    assert missing_lines(paper, paper).count() == 0 and intensity_outliers(paper, paper).count() == 0


def test_anode_and_space_group(spark):
    rows = spark.createDataFrame([("CoKα (Fe filter)",), ("Copper",), ("Cu and Mo",), ("Cu-Kα",), ("Sync",)], "a string")
    assert [r.k for r in rows.select(P.anode_key(F.col("a")).alias("k")).collect()] == ["co", "cu", None, "cu", None]
    groups = spark.createDataFrame([("P 43 21 2",), ("P 41 3 2",), ("R-3mH",), ("P 21/c",), ("C 2/m",), ("P n m a",), ("F d -3 m Z",), ("P -1",), ("P 63/m",), ("xx",)], "s string")
    assert [r.k for r in groups.select(P.space_group_system(F.col("s")).alias("k")).collect()] == ["t", "c", "r", "m", "m", "o", "c", "a", "h", None]


def test_packed_indices(spark):
    rows = spark.createDataFrame([("10", "01", "44"), ("-41", "03", "10"), ("1", "0", "14"), ("", "", "")], "h string, k string, l string")
    got = [[tuple(t) for t in r.c] for r in rows.select(P.candidate_indices(F.col("h"), F.col("k"), F.col("l")).alias("c")).collect()]
    assert got == [[(10, 1, 44), (1, 0, 4), (0, 1, 4)], [(-41, 3, 10), (-4, 0, 1), (1, 3, 0)], [(1, 0, 14)], []]


def test_own_rule_is_run(spark):
    E.register_rule("test_only", lambda entries: entries.select("entry_id", F.lit("test_only").alias("code"), F.lit("note").alias("sev"), F.lit("m").alias("msg"), F.lit("").alias("anchor")))
    with pytest.raises(ValueError):
        E.register_rule("test_only", lambda entries: entries)
    assert E.run_registered(entries=spark.createDataFrame([(1,)], "entry_id int")).first().code == "test_only"


@pytest.mark.parametrize("heading, name", [
    ("CaO (2) Oxide%", "CaO"), ("FeOt", "FeO"), ("Fe2O3tot", "Fe2O3"), ("SiO2wt%", "SiO2"), ("CO2calc", "CO2"), ("SiO2 (Mass%)", "SiO2"), ("(NH4)2O", "N2H8O"), ("H2O+", "H2O"), ("H2O", "H2O"), ("F", "F"), ("Cl wt.%", "Cl"),
    ("Si", "Si"), ("Si (Mass%)", "Si"), ("FeO*", "FeO"), ("Na2O 1", "Na2O"), ("P2O5_wt", "P2O5"), ("UO3", "UO3"), ("V2O5 wt %", "V2O5"),
    ("CORE", None), ("SOURCE", None), ("COUNT", None), ("NOTE", None), ("HOLE", None), ("POSITION", None), ("H2O-", None), ("H2O −", None), ("O=F", None), ("Si %ERR", None), ("Ca k-ratio", None), ("Fe det. lim.", None), ("Al+Cr", None),
    ("Mn2+", None), ("Na2Ca8(UO2)4", None), ("Total", None), ("Comment", None), ("Point", None), ("Sample", None), ("Line", None), ("No", None), ("Cations", None), ("Si apfu", None), ("SiO2 norm", None), ("", None), ("PINK", None), ("Al remain", None),
])
def test_constituent_of_a_heading(heading, name):
    assert R.constituent_label(heading) == name


def test_readers(spark, tmp_path):
    (tmp_path / "probe.csv").write_text("sample,point,CaO (2) Oxide%,SiO2,Total,Std Dev\nA,1,20.1,n.d.,99,1\nA,2,20.3,43.1,99,1\nA,Average,20.2,43.1,99,1\n")
    rows = {(r.point, r.constituent): r.wt for r in R.read_probe_long(spark, str(tmp_path / "probe.csv")).collect()}
    assert rows == {("1", "CaO"): 20.1, ("1", "SiO2"): None, ("2", "CaO"): 20.3, ("2", "SiO2"): 43.1}
    (tmp_path / "peaks.txt").write_text("title\nAngle d(A) I% ( h k l)\n27.4 3.248 100 ( 1 1 0)\n36.1 2.487 50 (-1 0 1)\n")
    peaks = R.read_peak_list(spark, str(tmp_path / "peaks.txt")).orderBy("line_no").collect()
    assert [(p.d, p.i, p.hkl) for p in peaks] == [(3.248, 100.0, [1, 1, 0]), (2.487, 50.0, [-1, 0, 1])]
    (tmp_path / "m.txt").write_text("##NAMES=Quartz\n##RRUFFID=R040031\n##IDEAL CHEMISTRY=SiO_2_\n##FILETYPE=Raman (raw)\n##RAMAN WAVELENGTH=532 nm\n200, 5\n100, 4\n150, nan\n##END=\n")
    meta, spectra = R.read_xy(spark, str(tmp_path / "m.txt"))
    m = meta.first()
    assert (m["name"], m.sample_id, m.kind, m.laser, m.chemistry) == ("Quartz", "R040031", "raw", "532", "SiO2")
    assert spectra.first().x == [100.0, 200.0]
    (tmp_path / "k.json").write_text('{"_about": "note", "SiO2": {"k": 0.208, "source": "T7"}, "CaO": {"k": 0.21}}')
    got = {r.constituent: r.k for r in R.read_dimension_json(spark, str(tmp_path / "k.json"), "k double, source string", "constituent").collect()}
    assert got == {"SiO2": 0.208, "CaO": 0.21}
    entries = spark.createDataFrame([(1, "match")], "entry_id int, cell string")
    findings = spark.createDataFrame([(1, "a", "flag", True)], "entry_id int, code string, sev string, new_template boolean")
    R.write_snapshot(entries, findings, str(tmp_path / "snap"), 3)
    with pytest.raises(Exception):
        R.write_snapshot(entries, findings, str(tmp_path / "snap"), 3)
    back, found = R.read_snapshot(spark, str(tmp_path / "snap"), 3)
    assert back.count() == 1 and found.first().code == "a"
    R.write_report_tables(findings, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/findings")).count() == 1


@pytest.mark.parametrize("title, text, found", [
    ("A New Mineral From Somewhere", "It is new. A new mineral comes from Somewhere.", ["New", "Mineral", "From"]),
    ("A Study of Renewal", "The study of renewals and the newest study.", ["Study"]),  # a part of a word is no word
    ("The Crystal Chemistry of Iron", "Crystal growth. Chemistry matters. Iron rusts.", []),  # only at the start of sentences
    ("On Raman Spectra", "We used Raman spectra, and the raman line; Raman bands are strong.", ["Spectra"]),  # most often a capital
    ("On Nothing", None, []), (None, "a new mineral", []),
])
def test_words_of_a_title(spark, title, text, found):
    rows = spark.createDataFrame([(title, text)], "title string, text string").withColumn("sents", P.F.split(P.F.coalesce("text", P.F.lit("")), r"(?<=[.!?])\s+"))
    assert list(rows.withColumn("mid_words", P.mid_words()).select(P._capitalised()).first()[0]) == found


def test_precision_reads_findings_once_and_deals_them_by_document(spark):
    schema = "doc_id int, content int, code string, sev string, msg string"
    before = spark.createDataFrame([(1, 7, "a", "flag", "d should be '1.5'"), (1, 7, "a", "flag", "d should be '1.5'"), (1, 7, "b", "flag", "odd"), (1, 7, "c", "note", "x"), (2, 7, "a", "flag", "copy")], schema)
    after = spark.createDataFrame([(1, 7, "b", "flag", "odd"), (1, 7, "d", "flag", "new")], schema)
    changes = spark.createDataFrame([(1, "cell", "1.4", "1.5(1)"), (1, "Accept", "", "odd")], "doc_id int, label string, before string, after string")
    got = A.oracle_score(before, after, changes)
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1  # the changes
    assert sorted(tuple(r) for r in got.collect()) == [("a", 2, 2, 0, 2, 2, 0, 0), ("b", 1, 0, 1, 0, 0, 0, 0)]
