"""What went wrong on larger tables: joins that guess a small side, digits and ids that only larger keys bring."""

import pytest
from pyspark.sql import functions as F

from recordaudit.operators import citations as C, names as D, structures as X
from recordaudit.plans import audit, structures as P
from recordaudit.plans.views import spark_sql


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_pattern_broadcasts_nothing_that_grows(spark):
    pattern, _ops = P._pattern(spark, "/root/testdata/sf0.001")
    assert broadcasts(pattern) <= 1  # the scattering factors


def test_table_against_pattern_broadcasts_nothing_that_grows(spark):
    from recordaudit.plans.catalogue import QUERIES

    assert broadcasts(QUERIES["table_vs_pattern"](spark, "/root/testdata/sf0.001")) == 0


def test_relatives_do_not_broadcast_their_offers(spark):
    rows = spark.createDataFrame([(1, "a", 1, ["Ca", "O"], 3.0, 3.0, 3.0, 1.0, True), (2, "b", 1, ["Mg", "O"], 3.0, 3.0, 3.0, 2.0, False)],
                                 "species_id long, norm string, sg int, elements array<string>, a double, b double, c double, volume double, grouped boolean")
    found = D.relatives(rows)
    assert broadcasts(found) <= 1  # the table of swaps
    assert sorted((r["species_id"], r["other_id"], r["swap"], r["size_tracks"]) for r in found.collect()) == [(1, 2, "Ca↔Mg", False), (2, 1, "Mg↔Ca", False)]


def test_citation_rows_of_one_id_give_a_match_once(spark):
    cites = spark.createDataFrame([(1, 7, ["ann"], False, "1990", None), (1, 7, ["ann", "bob"], False, "1990", None)], "doc_id long, cite_id long, names array<string>, etal boolean, year string, suffix string")
    refs = spark.createDataFrame([(1, 5, ["ann", "bob"], "1990", None, 2)], "doc_id long, ref_id long, names array<string>, year string, suffix string, n_authors int")
    matches = C.match_citations(cites, refs)
    assert [tuple(r) for r in matches.collect()] == [(1, 7, 5, 0)]
    # counted twice, the one entry would be two, and the citation's form not looked at
    assert [r["kind"] for r in C.form_findings(cites, refs, matches).collect()] == ["authors"]


@pytest.mark.parametrize("price, digits", [(40325.0, "4.032"), (40745.0, "4.074"), (40335.0, "4.034"), (98765.43, "9.877")])
def test_seeded_digits_are_those_of_the_sql(spark, tmp_path, price, digits):
    import duckdb

    row = spark.range(1).selectExpr("1L AS l_orderkey", "1 AS l_linenumber", "1L AS l_suppkey", "1L AS l_partkey", f"{price}D AS l_extendedprice", "50D AS l_quantity")
    row.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = spark_sql(spark, str(tmp_path), audit.SEED_LINES).first()["d_txt"]
    want = duckdb.sql(audit.SEEDABLE.replace("{lineitem}", f"'{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()[0][2]
    assert got == want == digits


def test_equal_sentences_meet_the_lexicon_once(spark):
    from pyspark.sql import functions as F

    from recordaudit.rules import phrases as W

    one, two = "The powder pattern was collected.", "The cell was not refined from powder data."
    rows = spark.createDataFrame([(1, f"{one} {two}"), (2, f"{one} {one}"), (3, None), (4, "Nothing.")], "entry_id long, text string")
    lexicon = W.lexicon_table(spark, W.LEXICON)
    sort = lambda df: sorted((r["entry_id"], sorted(sorted(x) for x in r["said"])) for r in df.collect())
    assert sort(W.roles_said(rows, lexicon)) == sort(W.said_of(W.phrase_hits(rows, lexicon)))
    many = rows.where("entry_id = 2").crossJoin(spark.range(500)).select(F.col("id").alias("entry_id"), "text")
    asked = []
    whole, W.phrase_hits = W.phrase_hits, lambda texts, *more: asked.append(texts.count()) or whole(texts, *more)
    try:
        assert W.roles_said(many, lexicon).count() == 500
    finally:
        W.phrase_hits = whole
    assert asked == [1]  # one sentence of a thousand


def test_numbers_of_bands_are_read_whole(spark):
    from recordaudit.operators import textjobs as T

    rows = spark.createDataFrame([(1, "The Raman spectrum was recorded. No bands at 11500 cm-1 were seen."), (2, "The Raman spectrum was recorded. Bands at 450 and 13200.5 cm-1 are assigned to SO4 ν1.")], "doc_id long, text string")
    assert [(r["doc_id"], r["lo"], r["hi"]) for r in T.absent_bands(rows).collect()] == [(1, 11500.0, 11500.0)]
    assert sorted(r["pos"] for r in T.stated_bands(rows).collect()) == [450.0, 13200.5]


@pytest.mark.parametrize("at, lints", [(2900, 1), (3200, 0), (13200, 1)])
def test_a_longer_number_is_no_evidence_of_water(spark, at, lints):
    from recordaudit.operators import textjobs as T

    rows = spark.createDataFrame([(1, f"The band lies at {at} cm-1. The formula is Ca(SO4)·2H2O.")], "doc_id long, text string")
    assert T.evidence_lints(rows).count() == lints


def test_lints_read_a_text_once(spark):
    from recordaudit.operators import textjobs as T

    rows = spark.createDataFrame([
        (1, "The O-H band lies at 2900 cm-1 and 2349 cm-1. Spectra used a LabRam with 248 nm light. An inVia with a 532 nm laser has 600 nm gratings."),
        (2, "The FTIR spectrum shows water at 2000 cm-1."), (2, "A diamond cell was used."), (3, "The FTIR spectrum shows water at 2000 cm-1."), (4, None),
    ], "doc_id long, text string")
    found = T.spectroscopy_lints(rows)
    assert sorted((r["doc_id"], r["lint"], r["value"]) for r in found.collect()) == [
        (1, "C-H window", 2900.0), (1, "atmospheric CO2 stretch", 2349.0), (1, "laser not sold with labram", 248.0), (2, "diamond cell", 2000.0)]
    assert T.spectroscopy_lints(rows)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1


def test_techniques_are_carried_within_the_text(spark):
    from recordaudit.operators import textjobs as T

    rows = spark.createDataFrame([(1, "The Raman spectrum (Fig. 2) was taken. A band is at 450 cm-1 (SO4 ν1). The IR spectrum followed. Bands e.g. 600 and 450 cm-1 are PO4 bending.")], "doc_id long, text string")
    bands = T.stated_bands(rows)
    assert sorted((r["sent_no"], r["pos"], r["technique"], r["family"], r["mode"]) for r in bands.collect()) == [
        (1, 450.0, "raman", "SO4", "ν1"), (3, 450.0, "ir", "PO4", "bend"), (3, 600.0, "ir", "PO4", "bend")]
    assert "Window" not in bands._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", ["ab νab", "none", "", "Aabab", None, "ab\ue000ab"])
def test_places_of_matches(spark, text):
    import re

    from recordaudit.operators import textjobs as T

    got = spark.createDataFrame([(text,)], "text string").select(T.spans(F.col("text"), "ab|ν").alias("s")).first()["s"]
    assert [tuple(x) for x in got or []] == [(m.group(), m.start() + 1) for m in re.finditer("ab|ν", text or "")]


def test_equal_paragraphs_are_searched_for_citations_once(spark):
    rows = [(d, p, "As shown by Ann and Bob (2001a, b) and (Cid, 1999).") for d in (1, 2) for p in (1, 2, 2)] + [(3, 1, "No year."), (3, 2, None), (3, 3, "Dee (in press).")]
    found = C.extract_citations(spark.createDataFrame(rows, "doc_id long, para long, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("Aggregate [text")  # what is searched is made distinct first
    got = sorted((r["doc_id"], r["para"], tuple(r["names"]), r["year"], r["suffix"] or "") for r in found.collect())
    each = [(("ann", "bob"), "2001", "a"), (("ann", "bob"), "2001", "b"), (("cid",), "1999", "")]
    assert got == sorted([(d, p, *c) for d in (1, 2) for p in (1, 2, 2) for c in each] + [(3, 3, ("dee",), "in press", "")])


def test_equal_formulas_are_read_once(spark):
    from recordaudit.operators import formulas as Y

    rows = [(e, f, "Pb1.50 ( Al2 Fe0.77 )2 O4") for e in (1, 2) for f in ("Analytical", "Empirical")] + [(3, "Analytical", None), (3, "Analysis", "Mg05Si")]
    table = spark.createDataFrame(rows, "entry_id long, field string, formula string")
    found = Y.elements_of(table)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate [formula")  # what is read is made distinct first
    got = sorted((r["entry_id"], r["field"], r["element"], round(r["n"], 6)) for r in found.collect() if r["entry_id"] < 3)
    assert got == sorted((e, f, el, n) for e in (1, 2) for f in ("Analytical", "Empirical") for el, n in (("Pb", 1.5), ("Al", 4.0), ("Fe", 1.54), ("O", 4.0)))
    assert [tuple(r)[:3] for r in Y.written_faults(table).collect()] == [(3, "Analysis", "decimal point")]


def test_names_are_looked_up_once(spark):
    tokens, species = spark.createDataFrame([("zois-ite",), ("zoisite",)], "token string"), spark.createDataFrame([("zoisite",)], "norm string")
    found = D.lookup_tokens(tokens, species)
    assert sorted(tuple(r) for r in found.collect()) == [("zois-ite", "spelling", "zoisite"), ("zoisite", "exact", "zoisite")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    words = spark.createDataFrame([(1, 0, "zoi-"), (1, 1, "site"), (1, 2, "zoisite"), (2, 0, "zoisite"), (2, 1, "zoisite")], "doc_id long, pos int, word string")
    named = D.join_broken_names(words, species)
    assert sorted((r["doc_id"], r["pos"], r["boxes"]) for r in named.collect()) == [(1, 0, 2), (1, 2, 1), (2, 0, 1), (2, 1, 1)]
    assert "LeftAnti" not in named._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_that_come_again_are_read_once(spark):
    from recordaudit.operators import bandprose as B, textjobs as T

    one, two = "The Raman spectrum (Fig. 2) was taken.", "Bands at 450 (sh), 600 and 13200.5 cm−1 are SO4 ν1 but none at 1640 cm-1 was detected; no bands near 3400 and 3500 cm-1."
    texts = [f"{one} {two} The IR² spectrum (Smith et al. 2001) lacks bands at 990 cm-1. It has one between 1500 and 1600 cm-1; uranyl bending is at 250 cm-1."] * 50
    B.told.cache_clear()
    assert len({tuple(B._stated(t)) for t in texts}) == 1 and B.told.cache_info().misses == 4
    rows = spark.createDataFrame([*((k, t) for k, t in enumerate(texts)), (99, None), (99, "")], "doc_id long, text string")
    bands = T.stated_bands(rows)
    assert "aggregate(" not in bands._jdf.queryExecution().optimizedPlan().toString()  # a text is read in one pass, not fold by fold
    got = {(r["sent_no"], r["pos"], r["shape"], r["technique"], r["family"], r["mode"], r["own"]) for r in bands.collect()}
    assert got == {(1, 450.0, "sh", "raman", "SO4", "ν1", True), (1, 600.0, None, "raman", "SO4", "ν1", True), (1, 13200.5, None, "raman", "SO4", "ν1", True),
                   (1, 1640.0, None, "raman", "SO4", "ν1", True), (3, 250.0, None, "ir", "UO2", "bend", True)}
    assert sorted({(r["sent_no"], r["lo"]) for r in T.absent_bands(rows).collect()}) == [(1, 3400.0), (1, 3500.0), (2, 990.0)]


@pytest.mark.parametrize("text", ["a  b\tc", "x cm−1, y\n cm - 1cm⁻¹ zcm-12 cm-1é", "υ3 — e.g. The al.) (B. vs. A! (C.) ν D? ~5 max. E", None, "", " . \n"])
def test_texts_are_made_plain_as_in_columns(spark, text):
    from recordaudit.operators import bandprose as B, textjobs as T

    row = spark.createDataFrame([(text,)], "text string").select(T.normalise_text(F.col("text")).alias("t"), T.sentences_of(T.normalise_text(F.col("text"))).alias("s")).first()
    assert B.normal(text) == row["t"] and B.sentences(B.normal(text)) == row["s"]
