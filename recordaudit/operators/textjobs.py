"""Jobs over prose: sentences, stated bands, claims, lints, context of a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from recordaudit.functions import spectra as S
from recordaudit.functions.measured import let
from recordaudit.operators import bandprose
from recordaudit.operators.bandprose import ABBREVIATIONS
from recordaudit.operators.matching import range_join

# white space after the end of a sentence and before the start of one; looked at only where white space stands
_BREAK = rf"\s(?<=[.!?]\s|[.!?]\)\s)(?<!{ABBREVIATIONS}\)?\s)\s*(?=[A-ZÀ-Þ(\[ν~∼])"


def normalise_text(text: Column) -> Column:
    """One dash, one unit ``cm-1``, one ν, single spaces."""
    text = F.coalesce(text, F.lit(""))
    # most texts have none of these characters, and their blanks are single already
    out = F.when(text.rlike("[\u00a0\u03c5\u2000-\u2015\u2212]"), F.translate(text, "−–—‐‑υ  ", "-----ν  ")).otherwise(text)
    out = F.regexp_replace(out, r"(?=[\sc])\s*+cm(?:\s*-\s*1\b|⁻¹)", " cm-1")
    return F.regexp_replace(out, r"[ \t]{2,}|\t", " ")


def body_of(text: Column) -> Column:
    """The text before the reference list, when its heading stands in the second half."""
    at = F.expr("length(text) - length(regexp_extract(text, '(?s)(\\\\b(?:References|REFERENCES|Literature cited|Bibliography)\\\\b.*)$', 1))")
    return F.when((at < F.length(text)) & (at > F.length(text) / 2), F.expr("substring(text, 1, length(text) - length(regexp_extract(text, '(?s)(\\\\b(?:References|REFERENCES|Literature cited|Bibliography)\\\\b.*)$', 1)))")).otherwise(text)


def sentences_of(text: Column) -> Column:
    """The sentences of a whole text as an array; abbreviations and decimals end none."""
    return F.filter(F.split(text, _BREAK), lambda p: F.trim(p) != "")


def sentences(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, sent_no, sentence`` of whole texts (column text); abbreviations and decimals end none."""
    return texts.select(key, F.posexplode(sentences_of(F.col("text"))).alias("sent_no", "sentence"))


_OPEN, _CLOSE = "\ue000", "\ue001"  # private characters around a match; a text that has one itself is cut by the pattern


def spans(text: Column, pattern: str) -> Column:
    """Every match of a pattern without groups, with its place: an array of structs (m, at), at counted from 1.

    One pass puts marks around the matches, and the pieces between the marks are added up, so equal matches keep their own places.
    """
    none = F.array().cast("array<struct<m:string,at:int>>")

    def put(state: Column, piece: Column) -> Column:
        """A piece is a match, its closing mark and what follows; only the first piece has no match."""
        m = F.substring_index(piece, _CLOSE, 1)
        closed = F.contains(piece, F.lit(_CLOSE))
        out = F.when(closed, F.concat(state["out"], F.array(F.struct(m.alias("m"), state["next"].alias("at"))))).otherwise(state["out"])
        return F.struct(out.alias("out"), (state["next"] + F.length(piece) - closed.cast("int")).alias("next"))

    marked = F.split(F.regexp_replace(text, f"(?:{pattern})", f"{_OPEN}$0{_CLOSE}"), _OPEN)
    quick = F.aggregate(marked, F.struct(none.alias("out"), F.lit(1).alias("next")), put, lambda state: state["out"])
    return F.when(text.rlike(f"[{_OPEN}{_CLOSE}]"), _spans_by_pieces(text, pattern)).otherwise(quick)


def _spans_by_pieces(text: Column, pattern: str) -> Column:
    """`spans` of any text, in two passes."""
    whole, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    # pieces and matches are paired once; a match's place follows from the last one put down
    pairs = F.filter(F.zip_with(between, whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m"))), lambda x: x["m"].isNotNull())
    done = F.array().cast("array<struct<m:string,at:int>>")

    def put(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        at = F.coalesce(last["at"] + F.length(last["m"]), F.lit(1)) + x["gap"]
        return F.concat(out, F.array(F.struct(x["m"].alias("m"), at.alias("at"))))

    return F.when(text.rlike(pattern), F.aggregate(pairs, done, put)).otherwise(done)


# --- stated bands -------------------------------------------------------------------------------

def technique_of(sentence: Column) -> Column:
    """``raman``, ``ir`` or ``open`` (both named); null when neither is."""
    raman, ir = sentence.rlike(r"\bRaman\b"), sentence.rlike(r"\b(?:[Ii]nfrared|IR|FTIR|FT-IR)\b")
    return F.when(raman & ir, "open").when(raman, "raman").when(ir, "ir")


def carry_technique(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, sent_no, sentence, technique`` of whole texts: the sentence's own, else the last one named before; a sentence naming both leaves it open."""
    none = F.array().cast("array<struct<sentence:string,technique:string>>")

    def put(out: Column, sentence: Column) -> Column:
        standing = F.coalesce(technique_of(sentence), F.try_element_at(out, F.lit(-1))["technique"])
        return F.concat(out, F.array(F.struct(sentence.alias("sentence"), standing.alias("technique"))))

    told = texts.select(key, F.posexplode(F.aggregate(sentences_of(F.col("text")), none, put)).alias("sent_no", "s"))
    return told.select(key, "sent_no", "s.sentence", F.nullif("s.technique", F.lit("open")).alias("technique"))


def stated_bands(texts: DataFrame) -> DataFrame:
    """``doc_id, sent_no, pos, shape, technique, family, mode, own`` of the bands prose states (doc_id, text).

    Runs of numbers closed by cm-1; ranges and runs the sentence says are absent are left out. Every number keeps its own place in
    the sentence; its group and its mode are those named nearest to it. `own` is false where the sentence credits another work.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(bandprose.stated_rows, f"doc_id {kind}, sent_no int, pos double, shape string, technique string, family string, mode string, own boolean")


def absent_bands(texts: DataFrame) -> DataFrame:
    """``doc_id, sent_no, lo, hi`` where the prose says the spectrum shows no band: a run is denied by a word of its own clause."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(bandprose.absent_rows, f"doc_id {kind}, sent_no int, lo double, hi double").distinct()


def band_ranges(texts: DataFrame) -> DataFrame:
    """``doc_id, sent_no, lo, hi`` of stated wavenumber ranges (``from 3550 to 3100 cm-1``, ``1500-1600 cm-1``)."""
    norm = texts.withColumn("text", normalise_text(F.col("text")))
    sents = sentences(norm).where(F.contains(F.col("sentence"), F.lit("cm-1")))
    pattern = rf"(?:(?:from|between)\s+)(\d{{2,4}}(?:\.\d+)?)\s*(?:-|to|and)\s*(\d{{2,4}}(?:\.\d+)?)\s*cm-1|(?<![\d.])(\d{{2,4}})\s?-\s?(\d{{2,4}})\s*cm-1"
    cols = [F.regexp_extract_all("sentence", F.lit(pattern), F.lit(k)) for k in (1, 2, 3, 4)]
    rows = sents.select("doc_id", "sent_no", F.explode(F.arrays_zip(*[c.alias(f"g{k}") for k, c in enumerate(cols)])).alias("m"))
    a = F.when(F.col("m.g0") != "", F.col("m.g0")).otherwise(F.col("m.g2")).cast("double")
    b = F.when(F.col("m.g1") != "", F.col("m.g1")).otherwise(F.col("m.g3")).cast("double")
    return rows.select("doc_id", "sent_no", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def near_copies(pairs: DataFrame, a: str, b: str) -> Column:
    """Two sentences that are one: nine tenths of their words and all their numbers shared."""
    def words(c: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"([a-z]{3,})"), F.lit(1)))

    def numbers(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(r"(\d{3,4})"), F.lit(1))))

    shared = F.size(F.array_intersect(words(a), words(b)))
    return (F.size(words(a)) > 0) & (F.size(words(b)) > 0) & (shared >= 0.9 * F.greatest(F.size(words(a)), F.size(words(b)))) & (numbers(a) == numbers(b))


def assignment_consistency(bands: DataFrame, sents: DataFrame | None = None) -> DataFrame:
    """``doc_id, pos, finding``: a band given two numbered modes of one group, a stretch below a bend, ν1 over ν3.

    Grouped by band and by group, so no pairs of bands are formed.
    """
    own = bands.where("own AND family IS NOT NULL AND mode IS NOT NULL")
    twice = own.where("mode LIKE 'ν%'").groupBy("doc_id", "pos").agg(
        F.count_distinct("family").alias("f"), F.count_distinct("mode").alias("m"), F.count_distinct("sent_no").alias("s")
    ).where("f = 1 AND m >= 2 AND s >= 2").select("doc_id", "pos", F.lit("two modes").alias("finding"))
    per = own.groupBy("doc_id", "family").agg(
        F.min(F.when(F.col("mode").isin("ν1", "ν3"), F.col("pos"))).alias("low_stretch"), F.max(F.when(F.col("mode").isin("ν2", "ν4"), F.col("pos"))).alias("high_bend"),
        F.min(F.when(F.col("mode") == "ν1", F.col("pos"))).alias("low1"), F.max(F.when(F.col("mode") == "ν3", F.col("pos"))).alias("high3"),
    )
    below = per.where("low_stretch < high_bend").select("doc_id", F.col("low_stretch").alias("pos"), F.lit("stretch below bend").alias("finding"))
    swapped = per.where("high3 < low1 AND family NOT IN ('VO4', 'AsO4', 'SeO3', 'TeO3')").select("doc_id", F.col("low1").alias("pos"), F.lit("labels look swapped").alias("finding"))
    return twice.unionByName(below).unionByName(swapped)


def formula_species(formula: Column) -> Column:
    """The hydrogen species and light groups a formula writes."""
    bare = F.regexp_replace(formula, r"\s|<[^>]+>", "")
    rest = F.replace(F.replace(bare, F.lit("H2O"), F.lit("")), F.lit("H3O"), F.lit(""))
    named = [F.when(F.contains(bare, F.lit(g)), g) for g in ("H2O", "H3O", "NH4", "CO3", "NO3")]
    return F.array_compact(F.array(*named, F.when(F.contains(rest, F.lit("OH")), "OH")))


# Where each species of a formula shows a band (cm⁻¹), and how the finding reads.
SPECIES_RANGES = (("H2O", 2800.0, 3800.0, "stretch"), ("H2O", 1550.0, 1750.0, "bend"), ("OH", 2500.0, 3800.0, "stretch"), ("CO3", 1350.0, 1560.0, "ν3"), ("NO3", 1300.0, 1450.0, "ν3"), ("NH4", 1380.0, 1490.0, "ν4"))


def species_evidence(formulas: DataFrame, bands: DataFrame, min_bands: int = 3) -> DataFrame:
    """``doc_id, grp, what, finding``: species of the formula with no band in their range, and bands assigned to a
    species the formula lacks. Documents stating fewer than `min_bands` positions are left alone."""
    own = bands.where("own")
    enough = own.groupBy("doc_id").agg(F.count_distinct("pos").alias("k")).where(F.col("k") >= min_bands).select("doc_id")
    has = formulas.join(enough, "doc_id", "left_semi").select("doc_id", F.explode(formula_species(F.col("formula"))).alias("grp")).distinct()
    ranges = formulas.sparkSession.createDataFrame(SPECIES_RANGES, "grp string, lo double, hi double, what string")
    expected = has.join(ranges, "grp")
    seen = range_join(own.select("doc_id", "pos"), ranges, "pos", "lo", "hi", 200.0).select("doc_id", "grp", "what").distinct()
    lacking = expected.join(seen, ["doc_id", "grp", "what"], "left_anti").select("doc_id", "grp", "what", F.lit("no band").alias("finding"))
    assigned = own.join(enough, "doc_id", "left_semi").where(F.col("family").isin("H2O", "OH", "CO3", "NO3", "NH4")).select("doc_id", F.col("family").alias("grp")).distinct()
    alien = assigned.join(has, ["doc_id", "grp"], "left_anti").join(formulas.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "grp", F.lit("assigned").alias("what"), F.lit("not in formula").alias("finding"))
    return lacking.unionByName(alien)


# --- stated distances ---------------------------------------------------------------------------


def claim_check(claims: DataFrame) -> DataFrame:
    """Distances credited to a relation, against it: ``status`` and ``grade`` per claim.

    `claims`: doc_id, claim_id, relation (bc, lib_oo, lib_ho), dist, decimals, band, mode (1, 3 or null), paired.
    The tolerance is half the last printed decimal and 0.006 Å (0.010 for O–H). A pair the sentence itself makes
    that is off by 0.02 Å or more is a flag where the document reproduces another pair of the relation; so is a
    uranyl distance that the other mode's relation gives.
    """
    uranyl = F.col("relation") == "bc"
    band = F.col("band")
    d1, d3 = S.uranyl_distance_nu1(band), S.uranyl_distance_nu3(band)
    best = F.when(F.abs(d1 - F.col("dist")) <= F.abs(d3 - F.col("dist")), d1).otherwise(d3)
    own = F.when(F.col("mode") == 1, d1).when(F.col("mode") == 3, d3).otherwise(best)
    calc = F.when(uranyl, own).when(F.col("relation") == "lib_ho", S.hydrogen_bond_ho(band)).otherwise(S.hydrogen_bond_oo(band))
    sibling = F.when(uranyl & (F.col("mode") == 1), d3).when(uranyl & (F.col("mode") == 3), d1)
    rows = claims.withColumn("tol", 0.5 * F.pow(F.lit(10.0), -F.col("decimals")) + F.when(uranyl, 0.006).otherwise(0.010)).withColumn("calc", calc)
    gap = F.abs(F.col("calc") - F.col("dist"))
    status = (
        F.when(band.isNull(), F.when(F.col("paired") == "range", "range").otherwise("unpaired"))
        .when(F.coalesce(gap <= F.col("tol"), F.lit(False)), "reproduced")
        .when(F.coalesce((F.abs(sibling - F.col("dist")) <= F.col("tol")) & (gap >= 0.02), F.lit(False)), "sibling")
        .when(~uranyl & F.coalesce(gap < 0.02, F.lit(False)), "reproduced")
        .otherwise("off")
    )
    rows = rows.withColumn("status", status)
    family = F.when(uranyl, "bc").otherwise("lib")
    proves = (F.col("status") == "reproduced") & F.col("paired").isin("band", "list", "ctx", "single")
    rows = rows.withColumn("proved", F.max(F.when(proves, 1).otherwise(0)).over(Window.partitionBy("doc_id", family)))
    of_list = Window.partitionBy("doc_id", "sent_no", family)
    listed = F.col("paired").isin("list", "ctx")
    rows = rows.withColumn("n_list", F.count_if(listed).over(of_list)).withColumn("n_off", F.count_if(listed & (F.col("status") == "off")).over(of_list))
    lone = ~uranyl & listed & (F.col("status") == "off") & (F.col("n_list") >= 3) & (F.col("n_off") == 1)
    grade = (
        F.when((F.col("status") == "sibling") | lone, "flag")
        .when((F.col("status") == "off") & (F.col("paired") == "band") & (F.col("proved") == 1) & F.coalesce(gap >= 0.02, F.lit(False)), "flag")
        .when(F.col("status") == "off", "info")
    )
    return rows.select("doc_id", "claim_id", F.when(lone, "outlier").otherwise(F.col("status")).alias("status"), F.round("calc", 4).alias("calc"), grade.alias("grade"))


def library_bands_beside(stated: DataFrame, library: DataFrame, tol: float = 10.0) -> DataFrame:
    """``doc_id, mineral, technique, pos, said, off``: the library bands of a document's minerals that lie within `tol` of a band
    it states with the same technique, each beside the nearest one.

    `stated`: doc_id, mineral, technique, pos; `library`: mineral, technique, pos. A document's stated bands meet its minerals' library
    through bins of the position, so library bands that nothing comes near are never laid out per document.
    """
    subjects = stated.select("doc_id", "mineral", "technique").distinct()
    said = stated.select("doc_id", "technique", F.col("pos").alias("said")).distinct().join(subjects, ["doc_id", "technique"])
    marks = said.withColumn("lo", F.col("said") - tol).withColumn("hi", F.col("said") + tol)
    bands = library.select("mineral", "technique", F.col("pos").alias("lib_pos")).distinct()
    near = range_join(bands, marks, "lib_pos", "lo", "hi", 2 * tol, ["mineral", "technique"])
    best = near.groupBy("doc_id", "mineral", "technique", "lib_pos").agg(F.min_by("said", F.struct(F.abs(F.col("said") - F.col("lib_pos")), "said")).alias("said"))
    return best.select("doc_id", "mineral", "technique", F.col("lib_pos").alias("pos"), "said", (F.col("said") - F.col("lib_pos")).alias("off"))


# --- lints --------------------------------------------------------------------------------------

# Lines of the air (centre and half width, cm⁻¹), and windows of other matter.
ATMOSPHERIC = (("CO2 stretch", 2349.0, 12.0), ("CO2 bend", 667.0, 6.0), ("N2", 2331.0, 8.0), ("O2", 1555.0, 8.0))
CH_WINDOW, DIAMOND_CELL = (2840.0, 2965.0), (1900.0, 2300.0)
# The laser lines (nm) Raman systems are sold with.
LASERS = {
    "xplora": (532, 638, 785), "labram": (325, 355, 405, 442, 457, 473, 488, 514, 532, 633, 660, 785, 830), "invia": (325, 405, 442, 457, 488, 514, 532, 633, 785, 830),
    "rm1000": (514, 633, 785), "dxr": (455, 532, 633, 780), "alpha300": (488, 532, 633, 785), "senterra": (532, 633, 785), "ntegra": (473, 532, 633),
    "confotec": (532, 633, 785), "rxn": (532, 785), "thermo almega": (532, 780),
}


def _laser_lints(text: Column) -> Column:
    """An array of (lint, value): wavelengths that the system named last before them is not sold with, unless a grating follows in the sentence."""
    sold = F.create_map(*[x for k, v in LASERS.items() for x in (F.lit(k), F.array(*[F.lit(float(nm)) for nm in v]))])
    none = F.array().cast("array<struct<system:string,value:double,behind:int>>")

    def put(state: Column, mark: Column) -> Column:
        light = F.endswith(F.lower(mark["m"]), F.lit("nm"))
        said = F.struct(state["of"].alias("system"), F.regexp_extract(mark["m"], r"^([\d.]+)", 1).try_cast("double").alias("value"), (mark["at"] + F.length(mark["m"])).alias("behind"))
        return F.struct(
            F.when(light, state["of"]).otherwise(F.lower(mark["m"])).alias("of"),
            F.when(light & state["of"].isNotNull(), F.concat(state["out"], F.array(said))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(None).cast("string").alias("of"), none.alias("out"))
    said = F.aggregate(spans(text, r"(?i)" + "|".join(LASERS) + r"|\d{3}(?:\.\d)? ?-?nm\b"), start, put, lambda state: state["out"])
    alien = F.filter(said, lambda x: F.forall(sold[x["system"]], lambda v: F.abs(x["value"] - v) > 2))
    alien = F.filter(alien, lambda x: ~F.substring(text, x["behind"], F.length(text)).rlike(r"(?i)^[^.]*?\bgrating"))
    return F.transform(alien, lambda x: F.struct(F.concat(F.lit("laser not sold with "), x["system"]).alias("lint"), x["value"].alias("value")))


def _band_lints(text: Column) -> Column:
    """An array of (lint, value) over the numbers of sentences about water; a diamond cell is a matter of the whole document."""
    wet = F.filter(sentences_of(text), lambda s: F.contains(s, F.lit("cm-1")) & s.rlike(r"(?i)O-?H|hydroxyl|water|H2O|hydrogen[- ]bond"))

    def of_value(flags: Column, v: Column) -> Column:
        kinds = [F.when(~flags["organic"] & v.between(*CH_WINDOW), "C-H window"), F.when(flags["infrared"] & v.between(*DIAMOND_CELL), "diamond cell")]
        kinds += [F.when(~flags["named"] & v.between(centre - half, centre + half), f"atmospheric {line}") for line, centre, half in ATMOSPHERIC]
        return F.transform(F.array_compact(F.array(*kinds)), lambda kind: F.struct(kind.alias("lint"), v.alias("value")))

    def of_sentence(s: Column) -> Column:
        values = F.transform(F.regexp_extract_all(s, F.lit(r"\b(\d{3,4})\b(?=\s*(?:,|and|cm|\)))"), F.lit(1)), lambda n: n.cast("double"))
        flags = F.struct(
            s.rlike(r"(?i)C-?H\b|organic|grease|epoxy|contamin|adhesive|resin|carbon").alias("organic"),
            s.rlike(r"(?i)atmospher|CO2|carbon dioxide|N2|nitrogen").alias("named"), s.rlike(r"(?i)FTIR|infrared|IR\b").alias("infrared"),
        )
        return let(flags, lambda f: F.flatten(F.transform(values, lambda v: of_value(f, v))))

    return F.flatten(F.transform(wet, of_sentence))


def spectroscopy_lints(texts: DataFrame) -> DataFrame:
    """``doc_id, lint, value``: O–H bands in the C–H window, atmospheric lines, the diamond cell, a laser the system lacks.

    A text is read once; what several texts of one document say of a diamond cell is brought together by the document.
    """
    text = F.col("text")
    cell = F.when(text.rlike("(?i)diamond"), F.array(F.struct(F.lit("").alias("lint"), F.lit(None).cast("double").alias("value")))).otherwise(F.array().cast("array<struct<lint:string,value:double>>"))
    found = texts.select("doc_id", normalise_text(text).alias("text")).select("doc_id", F.inline(F.concat(_band_lints(text), _laser_lints(text), cell)))
    met = found.groupBy("doc_id").agg(F.collect_set(F.struct("lint", "value")).alias("met"), F.max(F.col("lint") == "").alias("cell"))
    return met.select("doc_id", "cell", F.inline("met")).where("lint <> '' AND (cell OR lint <> 'diamond cell')").select("doc_id", "lint", "value")


# What is a property of planes, what runs along an axis, and how a direction is introduced.
PLANE_WORDS = ("cleavage", "cleavages", "parting", "twin plane", "tabular on", "tablets on", "plates on", "flattened on")
AXIS_WORDS = ("prism", "needle", "fiber", "fibre", "lath", "elongat", "striat")
DIRECTIONS = ("along", "parallel to", "down")


def notation_lints(paragraphs: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """``doc_id, lint, what``: a zone symbol for a cleavage, a plane for an elongation, a caption printed twice, and one
    symmetry code with two operators (`codes`: doc_id, label, operator)."""
    indices = r"\s*-?\d\s*-?\d\s*-?\d\s*"
    zone = rf"(?i)\b(?:{'|'.join(PLANE_WORDS)})\b[^.]*?(\[{indices}\])"
    plane = rf"(?i)\b(?:{'|'.join(AXIS_WORDS)})[^.]*?\b(?:{'|'.join(DIRECTIONS)})\s*(\({indices}\))"

    def found(pattern: str, name: str) -> DataFrame:
        return paragraphs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", "–−", "--"), F.lit(pattern), F.lit(1))).alias("what")).select(
            "doc_id", F.lit(name).alias("lint"), F.regexp_replace("what", r"\s", "").alias("what")
        )

    head = r"^\s*(Table|Figure|Fig\.)\s+(\d+)[.:]"
    caps = paragraphs.where(F.col("text").rlike(head)).groupBy(
        "doc_id", F.concat_ws(" ", F.regexp_replace(F.regexp_extract("text", head, 1), r"\.", ""), F.regexp_extract("text", head, 2)).alias("what")
    ).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id", F.lit("caption twice").alias("lint"), "what")
    out = found(zone, "zone for a plane").unionByName(found(plane, "plane for an axis")).distinct().unionByName(caps)
    if codes is not None:
        clash = codes.groupBy("doc_id", "label").agg(F.count_distinct("operator").alias("k")).where("k > 1")
        out = out.unionByName(clash.select("doc_id", F.lit("one code, two operators").alias("lint"), F.col("label").alias("what")))
    return out


_VALENCE = r"(?<![A-Za-z])(Fe|Mn|Ti|V|Cu|Ce|Eu|Cr|Co)\s?\d\s?[+⁺](?!\s?[a-z])"
_VALENCE_METHOD = r"(?i)Mössbauer|Moessbauer|Mossbauer|\bXPS\b|X-ray photoelectron|XANES|XAFS|EXAFS|\bEELS\b|electron energy[- ]loss|wet[- ]chemi|titrat|\bEPR\b|\bESR\b|colorimetr|flank method|spectrophotometr"
_HYDROUS = r"\(OH\)|\bOH\d|H2O|H₂O|H3O\b"
_OH_EVIDENCE = r"(?i)(?<!\d)3[0-7]\d\d\s*cm|O[-–—]?H stretch|thermogravimetr|\bTGA?\b|\bDTA\b|\bDSC\b|weight loss|mass loss|loss on ignition|\bLOI\b|(?:H2O|water) (?:was |content (?:was )?)?calculated|calculated H2O|by difference|Penfield|Karl[- ]Fischer|CHN|hydrogen analys|neutron"


def evidence_lints(texts: DataFrame) -> DataFrame:
    """``doc_id, lint``: a valence assigned with no method that sees it; water in the formula with no evidence of it."""
    t = F.col("text")
    return texts.select("doc_id", F.explode(F.array_compact(F.array(
        F.when(t.rlike(_VALENCE) & ~t.rlike(_VALENCE_METHOD), "valence without a method"),
        F.when(t.rlike(_HYDROUS) & t.rlike("(?i)formula") & ~t.rlike(_OH_EVIDENCE), "water without evidence"),
    ))).alias("lint"))


# The oxides of a composition, and how often one text must name different ones to print an analysis.
OXIDES = r"\b(?:SiO2|Al2O3|CaO|MgO|FeO|Fe2O3|MnO|Na2O|K2O|P2O5|As2O5|SO3|TiO2|UO3|CuO|ZnO|PbO)\b"
# Signs that a text prints the other things.
SIGNS = {
    "bv": r"(?i)bond[- ]valence",
    "gd": r"(?i)gladstone|compatibility index",
    "optics": r"(?i)refractive ind|\b[αβγωεn]\s?=\s?[12]\.\d{2,}",
}


def feature_flags(texts: DataFrame, oxides: int = 4, atoms: int = 3, bands: int = 3) -> DataFrame:
    """``doc_id`` and a boolean per feature, from the whole text (null: none).

    `epma`: at least `oxides` different oxides and a word of analysis; `coords`: at least `atoms` lines of a label and three
    fractions; `bands`: at least `bands` positions; the others by a sign each.
    """
    text = F.coalesce("text", F.lit(""))
    named = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(OXIDES), F.lit(0)))) >= oxides
    rows = F.size(F.regexp_extract_all(text, F.lit(r"(?m)^\s*[A-Z][A-Za-z]?\w*(?:\s+-?[01]?\.\d+(?:\(\d+\))?){3}"), F.lit(0))) >= atoms
    positions = F.size(F.regexp_extract_all(normalise_text(text), F.lit(r"\d{3,4}(?:\.\d+)? cm-1"), F.lit(0))) >= bands
    flags = {"epma": named & text.rlike(r"(?i)wt\.?\s?%|weight|microprobe|analys"), "coords": rows, "bands": positions, **{k: text.rlike(v) for k, v in SIGNS.items()}}
    return texts.select("doc_id", *[flag.alias(name) for name, flag in flags.items()])


def comparison_species(texts: DataFrame, species: DataFrame, own: DataFrame, span: int = 160) -> DataFrame:
    """``doc_id, norm``: known species a sentence about spectra sets its mineral beside.

    Named within `span` characters after a word of comparison, or as ``<species>-like``; the document's own
    mineral (`own`: doc_id, norm) is left out.
    """
    compare = r"(?i)\b(?:compar\w*|similar\w*|resembl\w*|close to|analog\w*|related|typical of|same as|like that of|in contrast|contrast\w*|differ\w*|consistent with|agree\w*|identical)\b"
    sents = sentences(texts).where(F.col("sentence").rlike(r"(?i)spectr|Raman|infrared|cm\s?[-–−]\s?1") & ~F.col("sentence").rlike(r"(?i)reflectance|optical|XANES|XPS|NMR|Mössbauer"))
    after = F.regexp_extract_all("sentence", F.lit(rf"{compare}(.{{0,{span}}})"), F.lit(1))
    spans = sents.select("doc_id", F.explode(after).alias("s"))
    words = spans.select("doc_id", F.explode(F.regexp_extract_all(F.lower(F.col("s")), F.lit(r"([a-z][a-z'’-]{4,}(?:-\([a-z0-9+,]+\))?)"), F.lit(1))).alias("norm"))
    like = sents.select("doc_id", F.explode(F.regexp_extract_all(F.lower(F.col("sentence")), F.lit(r"([a-z][a-z'’]{4,})-(?:like|type)\b"), F.lit(1))).alias("norm"))
    named = words.unionByName(like).distinct().join(species.select("norm").distinct(), "norm", "left_semi")
    return named.join(own.select("doc_id", "norm").distinct(), ["doc_id", "norm"], "left_anti").select("doc_id", "norm")


def unknown_site_labels(paragraphs: DataFrame, sites: DataFrame) -> DataFrame:
    """``doc_id, label, n``: site labels the prose names that the structure has no site for.

    Only elements of the structure count; displacement parameters, common molecules, labels in a space-group
    phrase, citations and reactions are left out, and ``V1`` stands for the one site of its element.
    """
    prose = paragraphs.where(~F.col("text").rlike(r"\bet al\.|→|\b(?:19|20)\d\d\s*[,;)]"))
    cleaned = F.regexp_replace("text", r"(?:space group|setting|\bin)\s+[A-Z]-?\d\S*", " ")
    labels = prose.select("doc_id", F.explode(F.regexp_extract_all(cleaned, F.lit(r"\b((?:OW|OH|Ow|Oh|W|[A-Z][a-z]?)\d{1,2}[A-Za-z]?)\b"), F.lit(1))).alias("label"))
    labels = labels.where(~F.col("label").isin("U11", "U22", "U33", "U12", "U13", "U23", "B11", "B22", "B33", "H2O", "CO2", "SO4", "PO4"))
    head = F.regexp_extract("label", r"^(OW|OH|Ow|Oh|W|[A-Z][a-z]?)", 1)
    counted = labels.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("element", F.when(head.isin("OW", "OH", "Ow", "Oh", "W"), "O").otherwise(head))
    held = sites.groupBy("doc_id", "element").agg(F.count(F.lit(1)).alias("k"))
    named = counted.join(held, ["doc_id", "element"]).join(sites.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_anti")
    return named.where(~(F.col("label").rlike(r"^[A-Z][a-z]?1$") & (F.col("k") == 1))).select("doc_id", "label", "n")


# --- context of a number ------------------------------------------------------------------------

_POWDER = r"(?i)powder|pxrd|xrpd|gandolfi|debye|guinier|rietveld|le ?bail|pawley"
_SINGLE = r"(?i)single[\s-]*crystal|scxrd"


# Words that tell powder work, and words that tell work of another kind, near the radiation they used.
WORK_WORDS = {"powder": r"powder|pxrd|xrpd|gandolfi|guinier|debye", "other": r"single[- ]crystal|structure (?:refinement|solution)|probe|wds|eds|spectromet"}
ANODES = ("Cu", "Mo", "Co", "Cr", "Fe", "Ag")
MENTION = rf"\b(?:{'|'.join(ANODES)})[\s-]*K\s*[αa]"


def radiation_in_text(texts: DataFrame) -> DataFrame:
    """``doc_id, anode, off``: the anode of the powder data, which is that of the Kα mention nearest to a word for powder work.

    A mention belongs to the work whose word is nearest to it, in its own sentence if that has one, before it or after it; `off` is the
    distance in characters, and the first of equally near mentions counts. A text whose mentions all belong to other work has no row.
    """
    said = sentences(texts)
    low = F.lower("sentence")
    at = {kind: F.transform(spans(low, pattern), lambda x: x["at"]) for kind, pattern in WORK_WORDS.items()}
    rows = said.select("doc_id", "sent_no", at["powder"].alias("powder"), at["other"].alias("other"), F.posexplode(spans(F.col("sentence"), MENTION)).alias("k", "m"))
    off = {kind: F.array_min(F.transform(kind, lambda a: F.abs(a - F.col("m.at")))) for kind in WORK_WORDS}
    own = rows.select("doc_id", "sent_no", "k", F.substring("m.m", 1, 2).alias("anode"), off["powder"].alias("off"), off["other"].alias("away"))
    near = own.where(F.col("off") <= F.coalesce("away", F.col("off")))
    return near.groupBy("doc_id").agg(F.min_by(F.struct("anode", "off"), F.struct("off", "sent_no", "k")).alias("b")).select("doc_id", "b.anode", "b.off")


def radiation_candidates(texts: DataFrame) -> DataFrame:
    """``doc_id, sent_no, anode, lam, context, collected`` of every anode a sentence names."""
    sents = sentences(texts)
    hits = sents.select("*", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(r"\b(Cu|Mo|Co|Cr|Fe|Ag)[\s-]*K\s*[αa]"), F.lit(1)))).alias("anode"))
    lam = F.regexp_extract("sentence", r"(?:λ\s*=?\s*|\()\s*([0-2]\.\d{3,6})", 1)
    powder, single = F.col("sentence").rlike(_POWDER), F.col("sentence").rlike(_SINGLE)
    return hits.select(
        "doc_id", "sent_no", F.lower("anode").alias("anode"), F.nullif(lam, F.lit("")).cast("double").alias("lam"),
        F.when(powder & ~single, "powder").when(single & ~powder, "single").otherwise("unknown").alias("context"),
        (powder & F.col("sentence").rlike(r"(?i)collect|record|measur|obtain|gather|acquir")).alias("collected"),
    )


# What opens or names an experiment, on lower-case text with plain hyphens. A section cue is a phrase that defines an
# experiment, or a heading: a short line of its own that names one kind of work.
CUES = {
    "section powder": r"(?:x-?ray powder|powder x-?ray) diffraction|powder diffraction (?:data|pattern|study)|powder xrd\b|(?m)^[ \t]*(?:[0-9.]+[ \t]+)?[^\n.:;,]{0,40}\bpowder\b[^\n.:;,]{0,40}$",
    "section single": r"single[- ]?crystal (?:x-?ray|diffraction|structure|data|study)|(?m)^[ \t]*(?:[0-9.]+[ \t]+)?[^\n.:;,]{0,40}\bsingle[- ]?crystal\b[^\n.:;,]{0,40}$",
    "powder": r"powder|pxrd",
    "single": r"single[\s-]*crystal|sc-?xrd",
    "method": r"le ?bail|rietveld|pawley|whole[- ]?pattern|profile[- ]?fit",
    "powder instrument": r"gandolfi|debye[- ]scherrer|bragg[- ]brentano|guinier",
    "single instrument": r"kappa|four-circle",
    "stop": r"[.!?][\s)]",
}
_CALCULATED = r"((?:calculat|simulat)[a-z]* +(?:x[- ]?ray +)?)(?:powder|pxrd)"


def cue_text(text: Column) -> Column:
    """The text in which cues are sought, place for place: lower case, plain hyphens, single blanks' places kept, calculated powder patterns struck out."""
    out = F.lower(F.translate(text, "−–—‐‑\u00a0\t", "-----  "))
    out = F.regexp_replace(out, _CALCULATED + r"(?<=powder)", "$1######")
    return F.regexp_replace(out, _CALCULATED, "$1####")


def cues(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, at, what``: every cue of `CUES` in a text, with its place from 1. A text is read once for each kind of cue."""
    flat = texts.select(key, cue_text(F.col(text)).alias("t"))

    def placed(what: str) -> Column:
        return F.transform(spans(F.col("t"), CUES[what]), lambda x: F.struct(x["at"].cast("bigint").alias("at"), F.lit(what).alias("what")))

    marked = [placed(what) for what in CUES]
    return flat.select(key, F.inline(F.concat(*marked)))


def context_of(marks: DataFrame, texts: DataFrame, key: str = "doc_id", at: str = "pos") -> DataFrame:
    """Adds ``context`` (powder, single, unknown) to marks (key, pos and any other columns; places from 1) of texts (key, text).

    An as-of join of the marks to the cues of their text, at any distance. A text that never names a single crystal and does name real
    powder work is powder. Else the nearest section cue before the mark decides; else the nearest word before it, where a single
    crystal gives way to a whole-pattern refinement named before it in its own sentence; else the nearest instrument before it,
    then the nearest word and instrument after it. Marks without a place or without a text are unknown. One sort by text and place.
    """
    names = [c for c in marks.columns if c != key]
    events = cues(texts, key).select(key, "at", "what", F.lit(None).cast(T.StructType([marks.schema[c] for c in names])).alias("mark"))
    both = events.unionByName(marks.select(key, F.coalesce(F.col(at).cast("bigint"), F.lit(0)).alias("at"), F.lit(None).cast("string").alias("what"), F.struct(*names).alias("mark")))
    order = Window.partitionBy(key).orderBy("at", F.col("what").isNotNull())
    past, ahead, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(key)
    seen = lambda what: F.when(F.col("what") == what, F.col("at"))
    before = lambda what: F.last(seen(what), ignorenulls=True).over(past)
    after = lambda what: F.first(seen(what), ignorenulls=True).over(ahead)
    rows = both.withColumn("stop", F.coalesce(before("stop"), F.lit(0)))
    in_sentence = lambda what: F.last(F.when(F.col("what") == what, F.col("stop")), ignorenulls=True).over(past)
    rows = rows.select(
        key, "what", "mark", "at", before("section powder").alias("sp"), before("section single").alias("ss"), before("powder").alias("p"), before("single").alias("s"), before("method").alias("m"),
        in_sentence("single").alias("s_stop"), in_sentence("method").alias("m_stop"), before("powder instrument").alias("ip"), before("single instrument").alias("is"),
        after("powder").alias("pa"), after("single").alias("sa"), after("powder instrument").alias("ipa"), after("single instrument").alias("isa"),
        F.max(F.col("what") == "single").over(whole).alias("any_single"), F.max(F.col("what") == "powder").over(whole).alias("any_powder"),
    ).where("mark IS NOT NULL")

    def nearer(powder: str, single: str, sign: int) -> Column:
        """The kind of the nearer of two places (sign 1: the later one); null where neither or both stand."""
        p, q = F.col(powder) * sign, F.col(single) * sign
        return F.when(q.isNull() & p.isNotNull(), "powder").when(p.isNull() & q.isNotNull(), "single").when(p > q, "powder").when(q > p, "single")

    refined = (nearer("p", "s", 1) == "single") & (F.col("m") < F.col("s")) & (F.col("m_stop") == F.col("s_stop"))
    refined |= (nearer("p", "s", 1) == "single") & (F.col("m") > F.col("s"))
    context = F.when(~F.coalesce("any_single", F.lit(False)) & F.coalesce("any_powder", F.lit(False)), "powder").when(F.col("at") == 0, "unknown").otherwise(F.coalesce(
        nearer("sp", "ss", 1), F.when(refined, "powder"), nearer("p", "s", 1), nearer("ip", "is", 1), nearer("pa", "sa", -1), nearer("ipa", "isa", -1), F.lit("unknown")))
    return rows.select(key, *[F.col(f"mark.{c}").alias(c) for c in names], context.alias("context"))
