import pytest
from pyspark.sql import functions as F

from recordaudit.operators import citations as C, names as D, textjobs as T


def test_citations_of_all_shapes(spark):
    paras = spark.createDataFrame([
        (1, 0, "However, Graeser and Roggiani (1976) and Smith et al. (2019a, b) agree; see Barton's (1980) note."),
        (1, 1, "It was shown (Brown, 1999; Müller and Sørensen, 2001) twice, as in García-Rodríguez et al. 2005."),
        (1, 2, "IMA (2024-012) is no citation."), (1, 3, "References"), (1, 4, "Later (2000) text."),
    ], "doc_id int, para int, text string")
    got = {(tuple(r.names), r.etal, r.year, r.suffix) for r in C.extract_citations(paras).collect()}
    assert got == {
        (("graeser", "roggiani"), False, "1976", None), (("smith",), True, "2019", "a"), (("smith",), True, "2019", "b"), (("barton",), False, "1980", None),
        (("brown",), False, "1999", None), (("muller", "sorensen"), False, "2001", None), (("garciarodriguez",), True, "2005", None),
    }


def test_matching_retries_without_leading_names(spark):
    cites = spark.createDataFrame([(1, 1, ["pgms", "godel", "barnes"], "2008", None, False), (1, 2, ["smyth"], "2010", None, False)], "doc_id int, cite_id int, names array<string>, year string, suffix string, etal boolean")
    refs = spark.createDataFrame([(1, 7, ["godel", "barnes"], "2008", None, 2), (1, 8, ["smith"], "2010", None, 1)], "doc_id int, ref_id int, names array<string>, year string, suffix string, n_authors int")
    m = C.match_citations(cites, refs)
    assert [(r.cite_id, r.ref_id, r.skipped) for r in m.collect()] == [(1, 7, 1)]
    assert [(r.cite_id, r.ref_id, r.score) for r in C.near_miss_pairs(cites, refs, m).collect()] == [(2, 8, 3)]
    assert [r.ref_id for r in C.uncited(refs, m).collect()] == [8]


def test_reference_list(spark):
    lines = spark.createDataFrame([
        (1, 1, "Kampf, A.R., Mills, S.J. and Housley, R.M. (2010) A title. American Mineralogist, 95, 1–2."),
        (1, 2, "——— (2012b) Another title of theirs. American Mineralogist, 97, 3–4."), (1, 3, "[3] Hawthorne, F.C. et al. (1999) Third title. Journal, 1."),
    ], "doc_id int, line_no int, text string")
    r = {x.ref_id: x for x in C.parse_references(lines).collect()}
    assert r[1].names == ["kampf", "mills", "housley"] and r[1].n_authors == 3 and r[1].year == "2010"
    assert r[2].names == r[1].names and r[2].suffix == "b" and r[2].n_authors is None
    assert r[3].number == 3 and r[3].names[0] == "hawthorne" and r[3].n_authors == 3


def test_fuzzy_names(spark):
    species = spark.createDataFrame([("tourmaline",), ("calcite",), ("jarosite",), ("davidite-(la)",), ("magnesio-hastingsite",), ("chromite",)], "norm string")
    tokens = spark.createDataFrame([("jarsoite",), ("calcites",), ("davidite",), ("magnesiohastingsite",), ("chromitite",), ("granite",), ("jarosite",)], "token string")
    how = {(r.token, r.how) for r in D.lookup_tokens(tokens, species).collect()}
    assert how == {("jarosite", "exact"), ("davidite", "root"), ("magnesiohastingsite", "spelling")}
    assert [(r.token, r.norm, r.dist) for r in D.fuzzy_matches(tokens, species).collect()] == [("jarsoite", "jarosite", 1)]


def test_broken_names(spark):
    species = spark.createDataFrame([("tobermorite",), ("magnesio-hastingsite",)], "norm string")
    words = spark.createDataFrame([(1, k, w) for k, w in enumerate("The tobermo- rite and magnesio- hastingsite".split())], "doc_id int, pos int, word string")
    assert {(r.norm, r.pos, r.boxes) for r in D.join_broken_names(words, species).collect()} == {("tobermorite", 1, 2), ("magnesio-hastingsite", 4, 2)}


def test_closure_survives_a_cycle(spark):
    groups = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x")], "gid string, parent string")
    got = {(r.ancestor, r.gid): r.depth for r in D.group_closure(groups).collect()}
    assert got[("a", "d")] == 3 and got[("a", "a")] == 0 and got[("x", "y")] == 1 and ("d", "a") not in got


def test_bands_and_lints(spark):
    text = "The Raman spectrum shows bands at 1012 (sh), 983 and 610 cm−1 due to SO4 stretching. No bands were seen near 3400 cm-1. Bands at 1640 cm-1 were not observed. A band extends from 3550 to 3100 cm-1."
    texts = spark.createDataFrame([(1, text)], "doc_id int, text string")
    b = T.stated_bands(texts).collect()
    assert sorted(r.pos for r in b) == [610.0, 983.0, 1012.0] and {r.family for r in b} == {"SO4"} and {r.technique for r in b} == {"raman"}
    assert sorted(r.lo for r in T.absent_bands(texts).collect()) == [1640.0, 3400.0]
    assert [(r.lo, r.hi) for r in T.band_ranges(texts).collect()] == [(3100.0, 3550.0)]
    ev = spark.createDataFrame([(1, "The formula is Ca2Fe3+2Si3O12 with H2O."), (2, "The formula Fe3+2O3 follows from Mössbauer data.")], "doc_id int, text string")
    assert {(r.doc_id, r.lint) for r in T.evidence_lints(ev).collect()} == {(1, "valence without a method"), (1, "water without evidence")}


@pytest.mark.parametrize("text, stated, absent", [
    ("In the Raman spectrum no band that could be assigned to any sort of stretching vibration of water molecules was found near 3400 cm-1.", [], [3400.0]),
    ("No band lies at 1640 cm-1, but a strong one stands at 1000 cm-1.", [1000.0], [1640.0]),
    ("No bands at 1640 cm-1 or 3400 cm-1 are known.", [], [1640.0, 3400.0]),
    ("Bands at 983 cm-1 are due to SO4, those at 1640 cm-1 were, for reasons that are not known to anyone who looked into it, not observed.", [983.0], [1640.0]),
    ("Without water, as is told, the band at 3400 cm-1 cannot be; the band at 700 cm-1 is weak.", [700.0], [3400.0]),
])
def test_denials_reach_through_their_clause(spark, text, stated, absent):
    texts = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert sorted(r.pos for r in T.stated_bands(texts).collect()) == stated and sorted(r.lo for r in T.absent_bands(texts).collect()) == absent


def test_context(spark):
    far = "Nothing else is said here. " * 200
    cases = [
        ("Powder data were collected. The cell refined from them is a = 5.1.", "powder"),
        ("Powder data exist. The single-crystal study gave the following cell parameters: a = 5.1.", "single"),
        ("A single-crystal start served a Rietveld refinement; next to the single-crystal values it gave a = 5.1.", "powder"),
        ("Single-crystal X-ray diffraction data were collected. " + far + "A powder photograph is shown. a = 5.1.", "single"),  # the section, at any distance
        ("Single-crystal work came first. X-ray powder diffraction data were recorded. " + far + "Unlike the single crystal, a = 5.1.", "powder"),
        ("2.1 Single-crystal work\nCrystals are small.\n2.2 Powder work\nData of the crystals gave a = 5.1.", "powder"),
        ("The single crystals are small. The calculated powder pattern agrees: a = 5.1.", "single"),
        ("Of single crystals little is known. " + far + "On a powder, in the end, a = 5.1.", "powder"),
        ("a = 5.1 was refined from the powder, not from a single crystal.", "powder"),
        ("A Gandolfi camera gave a = 5.1.", "unknown-or-powder"), ("The colour is white; a = 5.1.", "unknown"), (None, "unknown"),
    ]
    texts = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id int, text string")
    marks = spark.createDataFrame([(k, t.index("a = 5.1") + 1 if t else None, f"m{k}") for k, (t, _) in enumerate(cases)], "doc_id int, pos int, name string")
    got = {r.doc_id: r.context for r in T.context_of(marks, texts).collect()}
    assert {k: c for k, c in got.items() if k != 9} == {k: c for k, (_, c) in enumerate(cases) if k != 9} and got[9] == "powder"


def test_radiation_is_the_powder_one(spark):
    t = "The microprobe used the Fe Kα line. Powder diffraction data were recorded with a Gandolfi camera and CoKα radiation. A single-crystal study used MoKα."
    assert T.radiation_in_text(spark.createDataFrame([(1, t)], "doc_id int, text string")).first().anode == "Co"


def test_closure_of_a_deep_chain(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(150)], "gid int, parent int")
    got = D.group_closure(chain).where("ancestor = 0").agg({"gid": "count", "depth": "max"}).first()
    assert sorted(got) == [149, 150]


def test_bands_keep_their_own_places(spark):
    text = "Raman bands lie at 1400 cm-1 (CO3), and others, of a weaker sort, at 400 cm-1 (SO4). Bands at 400 cm-1 are due to ν4 and, far from the others, stand 400 cm-1 bands of ν2."
    got = [(r.sent_no, r.pos, r.family, r.mode) for r in T.stated_bands(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()]
    assert got == [(0, 1400.0, "CO3", None), (0, 400.0, "SO4", None), (1, 400.0, None, "ν4"), (1, 400.0, None, "ν2")]


def test_spans_of_any_length(spark):
    paras = spark.createDataFrame([(1, 1, "Seen in [4–60] and [2].")], "doc_id int, para int, text string")
    assert sorted(r.number for r in C.extract_numeric_citations(paras).collect()) == [2, *range(4, 61)]


def test_features_of_a_text(spark):
    texts = [(1, "Analyses (wt%) gave SiO2, CaO, MgO, FeO."), (2, "SiO2, CaO and MgO in wt%."), (3, "Ca1 0.1 0.2 0.3\nO1 0.5 .25 0.125\nO2 0.1(2) 0.3 -0.4"), (4, None)]
    got = {r.doc_id: r for r in T.feature_flags(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert [got[k].epma for k in range(1, 5)] == [True, False, False, False] and [got[k].coords for k in range(1, 5)] == [False, False, True, False]


def test_programs_are_no_orphans(spark):
    paras = spark.createDataFrame([(1, 1, "Data were reduced with Bruker (2009), as Nobody (2010) says.")], "doc_id int, para int, text string")
    cites = C.extract_citations(paras).withColumn("cite_id", C.F.monotonically_increasing_id())
    none = spark.createDataFrame([], "doc_id int, cite_id bigint")
    assert [r.names for r in C.orphans(cites, none).collect()] == [["nobody"]]
    assert C.orphans(cites, none, ()).count() == 2


def test_short_asks_get_their_names(spark):
    names = ["albite", "alum", "barite", "gold", "halite", "lead", "opal", *[f"a{chr(98 + k)}te" for k in range(15)]]
    species, asked = spark.createDataFrame([(n,) for n in names], "norm string"), spark.createDataFrame([("a",), ("AL",), ("it",), ("z",), ("",), ("alb",)], "asked string")
    got = {}
    for r in sorted(D.search_names(asked, species).collect(), key=lambda r: r.place):
        got.setdefault(r.asked, []).append(r.norm)
    want = {q: sorted((n for n in names if q in n), key=lambda n: (not n.startswith(q), len(n), n))[:12] for q in ("a", "al", "it", "alb")}
    assert got == want


def test_near_misses_work_out_matches_once(spark):
    cites = spark.createDataFrame([(1, 1, ["ann"], False, "1990", None), (1, 2, ["bobson"], False, "1991", None)], "doc_id int, cite_id int, names array<string>, etal boolean, year string, suffix string")
    refs = spark.createDataFrame([(1, 5, ["ann"], "1990", None, 1), (1, 6, ["bobsen"], "1991", None, 1)], "doc_id int, ref_id int, names array<string>, year string, suffix string, n_authors int")
    got = C.near_miss_pairs(cites, refs, C.match_citations(cites, refs))
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(1, 2, 6, 3)]
