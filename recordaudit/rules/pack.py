"""The entry rules.

`entries` is wide: entry_id, name, primary_name, class, subclass, chemical, empirical, crystal_system, space_group, cell_a …
cell_ga (as printed), z, anode, lam, spacing_instr, intensity_instr, intensity_type, filter, filter_type, optical, ima,
analysis, temperature, dx, xtl_dx, quality_mark, title, comments (map), text (of the paper, may be null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordaudit.functions import cell as K
from recordaudit.functions.elements import element_counts, element_set
from recordaudit.functions.measured import let, number_value, parse_measured
from recordaudit.operators.matching import missing_lines, intensity_outliers
from recordaudit.rules.engine import Rule

# --- fixed values -------------------------------------------------------------------------------

# emission wavelengths (Å): Kα1, Kα (weighted mean), Kα2
CANONICAL = {
    "cu": (1.540598, 1.541874, 1.544426), "mo": (0.709319, 0.710730, 0.713609), "co": (1.788996, 1.790260, 1.792850),
    "fe": (1.936042, 1.937355, 1.939980), "cr": (2.289760, 2.291000, 2.293663), "ag": (0.559422, 0.560885, 0.563813),
}
ANODE_WORDS = {"copper": "cu", "molybdenum": "mo", "iron": "fe", "cobalt": "co", "chromium": "cr", "silver": "ag"}
SYSTEMS = {
    "anorthic": "a", "triclinic": "a", "monoclinic": "m", "orthorhombic": "o", "tetragonal": "t", "hexagonal": "h", "trigonal": "h", "rhombohedral": "r", "cubic": "c", "isometric": "c",
    "a": "a", "m": "m", "o": "o", "t": "t", "h": "h", "r": "r", "c": "c",
}
CUBIC_GROUPS = (
    "P23 F23 I23 P213 I213 Pm-3 Pn-3 Fm-3 Fd-3 Im-3 Pa-3 Ia-3 P432 P4232 F432 F4132 I432 P4332 P4132 I4132 "
    "P-43m F-43m I-43m P-43n F-43c I-43d Pm-3m Pn-3n Pm-3n Pn-3m Fm-3m Fm-3c Fd-3m Fd-3c Im-3m Ia-3d"
).split()
VOCABULARY = {
    "spacing_instr": ("Diffractometer", "Calculated", "Film", "Camera", "Gandolfi", "Guinier", "Visual", "Image plate", "Other"),
    "intensity_instr": ("Diffractometer", "Calculated", "Film", "Gandolfi", "Guinier", "Visual", "Image plate", "Other"),
    "intensity_type": ("Integrated", "Peak"),
    "filter": ("Monochromator Crystal", "Beta-Filter", "None"),
}
KBETA_FILTER = {"cr": "V", "fe": "Mn", "co": "Fe", "ni": "Co", "cu": "Ni", "mo": "Zr", "ag": "Pd"}
MONOCHROMATORS = ("graph", "graphite", "ge", "si", "quartz", "lif", "diamond")
MEASURED = ("diffractometer", "film", "camera", "gandolfi", "guinier", "debye-scherrer", "visual", "image plate")
RARE_EARTHS = ("La", "Ce", "Pr", "Nd", "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb", "Lu", "Y", "Sc")
POLYTYPES = {"A": "a", "M": "m", "O": "o", "Q": "t", "T": "hr", "H": "hr", "R": "hr", "C": "c"}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def _lower(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


# --- radiation ----------------------------------------------------------------------------------


def anode_key(text: Column) -> Column:
    """The anode of a radiation string: the one symbol or word named; of several, the one with a K line; else null."""
    low = F.lower(text)
    named = F.array_compact(F.array(*[
        F.when(low.rlike(rf"(?<![a-z]){k}(?:\s*[-–]?\s*k|(?![a-z]))") | F.contains(low, F.lit({v: w for w, v in ANODE_WORDS.items()}[k])), k) for k in CANONICAL
    ]))
    lines = F.array_compact(F.array(*[F.when(low.rlike(rf"(?<![a-z]){k}\s*[-–]?\s*k"), k) for k in CANONICAL]))
    return let(named, lambda n: F.when(F.size(n) == 1, F.get(n, F.lit(0))).when(F.size(n) > 1, let(
        F.array_intersect(lines, n), lambda m: F.when(F.size(m) == 1, F.get(m, F.lit(0))))))


def is_synchrotron(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\bsync(?:hrotron)?\b"), F.lit(False))


def canonical_line(anode: Column, lam: Column) -> Column:
    """``struct<off, line, value>`` of the emission line of the anode nearest to a wavelength."""
    table = F.create_map(*[v for k, lines in CANONICAL.items() for v in (F.lit(k), F.array(*[F.struct(F.lit(n).alias("line"), F.lit(x).alias("value")) for n, x in zip(("ka1", "ka", "ka2"), lines)]))])
    return F.array_min(F.transform(table[anode], lambda e: F.struct(F.abs(e["value"] - lam).alias("off"), e["line"].alias("line"), e["value"].alias("value"))))


def mid_words() -> Column:
    """The words of the text (column sents) that do not open a sentence: they show how the paper itself writes a word. Only for titles with capitals."""
    inner = F.transform("sents", lambda s: let(F.filter(F.split(s, r"[^\p{L}'-]+"), lambda w: w != ""), lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1)))))
    return F.when(F.coalesce("title", F.lit("")).rlike(r"\s\p{Lu}\p{Ll}"), F.flatten(inner)).otherwise(F.array().cast("array<string>"))


def prepare(entries: DataFrame) -> DataFrame:
    """What several rules need, worked out once: the numbers, the anode and the paper's sentences."""
    sents = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\b(Figs?|al|ca|e\.g|i\.e|vs|Nos?)\.", "$1"), r"(?<=[.!?])\s+(?=[A-Z(\[])")
    out = entries.withColumn("sents", sents).withColumn("mid_words", mid_words())
    for axis in ("a", "b", "c", "al", "be", "ga"):
        out = out.withColumn(f"v_{axis}", parse_measured(F.col(f"cell_{axis}")))
    out = out.withColumn("lam_v", number_value(F.col("lam"))).withColumn("anode_el", anode_key(F.col("anode")))
    out = out.withColumn("line", F.when(F.col("anode_el").isNotNull() & F.col("lam_v").isNotNull(), canonical_line(F.col("anode_el"), F.col("lam_v"))))
    out = out.withColumn("sys", _map(SYSTEMS)[_lower("crystal_system")]).withColumn("sg_sys", space_group_system(F.col("space_group")))
    for n, k in (("A", "n_a"), ("B", "n_b"), ("Q", "n_q")):
        out = out.withColumn(k, F.expr(f"try_cast(regexp_extract(optical, '\\\\b{n}(?:\\\\([^)]*\\\\))?\\\\s*=\\\\s*(\\\\d+\\\\.\\\\d+)', 1) AS double)"))
    sign = F.regexp_extract("optical", r"Sign\s*=\s*([+\-−–—])", 1)
    return (
        out.withColumn("sign", F.when(sign == "+", "+").when(sign != "", "-"))
        .withColumn("two_v", F.expr("try_cast(regexp_extract(optical, '2V[xz]?(?:\\\\([^)]*\\\\))?\\\\s*=?\\\\s*(\\\\d+(?:\\\\.\\\\d+)?)', 1) AS double)"))
        .withColumn("two_vz", K.two_vz(F.col("n_a"), F.col("n_b"), F.col("n_q")))
        .withColumn("measured", _lower("spacing_instr").isin(*MEASURED))
        .withColumn("calculated", (_lower("spacing_instr") == "calculated") | (_lower("intensity_instr") == "calculated"))
        .withColumn("density", density_ratio(F.col("xtl_dx"), F.col("dx")))
    )


def space_group_system(symbol: Column) -> Column:
    """The crystal system a space-group symbol implies, or null where it cannot be read for certain."""
    s = F.regexp_replace(F.coalesce(symbol, F.lit("")), r"\s+", "")

    def read(t: Column) -> Column:
        bare = F.regexp_replace(t, r"(?<=[^\d-])[HRSZ]$", "")
        rest = F.substring(bare, F.lit(2), F.length(bare))
        core = F.replace(rest, F.lit("/"), F.lit(""))
        planes, twos = F.length(F.regexp_replace(core, "[^mcabnde]", "")), F.length(F.regexp_replace(core, "[^2]", ""))
        return (
            F.when(bare.isin(*CUBIC_GROUPS), "c")
            .when(~bare.rlike("^[PABCFIR].+"), None)
            .when(rest.isin("1", "-1"), "a")
            .when(bare.startswith("R"), "r")
            .when(rest.rlike("^-?[36]") | F.contains(rest, F.lit("6")), "h")
            .when(rest.rlike("-?4"), "t")
            .when(F.contains(rest, F.lit("3")), "c")
            .when((planes >= 2) | (twos >= 2), "o")
            .when((planes >= 1) | (twos >= 1) | core.startswith("1"), "m")
        )

    return let(s, read)


def _family(system: Column) -> Column:
    return F.when(system.isin("r", "h"), "hex").otherwise(system)


def density_ratio(structure: Column, calculated: Column) -> Column:
    """``struct<dev, simple>``: how far the ratio of two densities is from one, and whether it is a simple fraction."""
    r = structure / calculated
    fractions = sorted({p / q for p in (1, 2, 3, 4, 6, 8) for q in (1, 2, 3, 4, 6, 8) if p != q})
    near = F.exists(F.array(*[F.lit(f) for f in fractions]), lambda f: F.abs(r - f) <= 0.04 * f)
    return F.when((structure > 0) & (calculated > 0), F.struct(F.abs(r - 1).alias("dev"), near.alias("simple")))


def _any_sentence(test) -> Column:
    return F.exists("sents", test)


def _closest(field: str) -> Column:
    """The vocabulary word nearest to a field's value, when at least 0.86 of its letters stand."""
    value = F.trim(F.coalesce(F.col(field), F.lit("")))
    words = F.array(*[F.lit(w) for w in VOCABULARY[field]])
    known = F.exists(words, lambda w: F.lower(w) == F.lower(value))
    off = F.array_min(F.transform(words, lambda w: F.struct((F.levenshtein(value, w) / F.greatest(F.length(value), F.length(w))).alias("off"), w.alias("word"))))
    return F.when((value != "") & ~known, let(off, lambda o: F.when(o["off"] <= 0.14, o["word"])))


# --- the rules over one entry -------------------------------------------------------------------

_POWDER = r"(?i)powder|pxrd|xrpd"


def _rhombohedral() -> Column:
    """Equal angles that are not 120°, and not right ones unless the axes are equal too: the rhombohedral setting."""
    angles = (F.col("v_al.value") == F.col("v_be.value")) & (F.col("v_be.value") == F.col("v_ga.value")) & (F.col("v_ga.value") != 120)
    axes = (F.col("v_a.value") == F.col("v_b.value")) & (F.col("v_b.value") == F.col("v_c.value"))
    return F.coalesce(F.col("sys").isin("r", "h") & angles & ((F.abs(F.col("v_ga.value") - 90) > 1) | F.coalesce(axes, F.lit(False))), F.lit(False))


def _axes_differ() -> Column:
    """Axes the symmetry makes equal: a=b for uniaxial systems, a=b=c for cubic; value and uncertainty both count."""
    def same(x: str, y: str) -> Column:
        p, q = F.col(f"v_{x}"), F.col(f"v_{y}")
        return p["value"].isNull() | q["value"].isNull() | ((p["value"] == q["value"]) & (p["esd_digits"] == q["esd_digits"]))

    three = (F.col("sys") == "c") | _rhombohedral()
    return F.when(three, ~(same("a", "b") & same("b", "c"))).when(F.col("sys").isin("t", "h", "r"), ~same("a", "b")).otherwise(False)


def _fixed_angle(axis: str) -> Column:
    hexagonal = F.col("sys").isin("h", "r") & ~_rhombohedral()
    if axis == "ga":
        return F.when(hexagonal, 120.0).when(F.col("sys").isin("m", "o", "t", "c"), 90.0)
    if axis == "al":
        return F.when(F.col("sys").isin("m", "o", "t", "c") | hexagonal, 90.0)
    return F.when(F.col("sys").isin("o", "t", "c") | hexagonal, 90.0)


def _symmetry_rules() -> list[Rule]:
    rules = [Rule("symmetry", "flag", _axes_differ, lambda: F.lit("symmetry-equal axes differ in value or uncertainty"), "cell:a")]
    for axis in ("al", "be", "ga"):
        v = lambda axis=axis: F.col(f"v_{axis}")
        rules.append(Rule("symmetry", "flag", lambda axis=axis, v=v: F.abs(v()["value"] - _fixed_angle(axis)) > 0.01, lambda axis=axis: F.concat(F.lit(f"angle {axis} is fixed by symmetry: "), F.col(f"cell_{axis}")), f"cell:{axis}"))
        rules.append(Rule("symmetry", "flag", lambda axis=axis, v=v: (v()["esd_digits"] != "") & _fixed_angle(axis).isNotNull(), lambda axis=axis: F.concat(F.lit(f"angle {axis} is fixed and carries an uncertainty: "), F.col(f"cell_{axis}")), f"cell:{axis}"))
    for axis in ("a", "b", "c"):
        rules.append(Rule(
            "precision", "flag", lambda axis=axis: (F.col(f"v_{axis}.decimals") >= 3) & (F.col(f"v_{axis}.esd_digits") == ""),
            lambda axis=axis: F.concat(F.col(f"cell_{axis}"), F.lit(" has no stated uncertainty"), F.coalesce(F.expr(
                f"' — the paper prints it with (' || nullif(regexp_extract(coalesce(text, ''), concat('(?<![0-9.])', replace(v_{axis}.mantissa, '.', '[.]'), '[ ]*[(]([0-9]+)[)]'), 1), '') || ')'"), F.lit(""))), f"cell:{axis}",
        ))
    return rules


#: over one entry's fields; what its text says in words is in `phrases.CLAIMS`
ENTRY_RULES: tuple[Rule, ...] = (
    Rule("wavelength", "flag", lambda: F.col("line.off") > 0.0006, lambda: F.concat(F.lit("nonstandard wavelength; nearest is "), F.col("line.line"), F.format_string(" %.6f", F.col("line.value"))), "lam"),
    Rule("wavelength", "note", lambda: (F.col("line.off") <= 0.0006) & F.lower("anode").rlike(r"k[aα]1\b") & (F.col("line.line") == "ka"), lambda: F.lit("labelled Kα1 with the weighted-mean wavelength"), "lam"),
    Rule("misplaced_analysis", "flag", lambda: (F.trim(F.coalesce("analysis", F.lit(""))) == "") & (F.size(F.map_filter("comments", lambda k, v: ~k.isin("Analysis", "Color", "Habit") & v.rlike(r"(?i)wt\.?\s*%|microprobe"))) > 0),
        lambda: F.concat(F.lit("analysis found in "), F.concat_ws(",", F.array_sort(F.map_keys(F.map_filter("comments", lambda k, v: ~k.isin("Analysis", "Color", "Habit") & v.rlike(r"(?i)wt\.?\s*%|microprobe")))))), "analysis"),
    Rule("synthetic", "flag", lambda: F.concat_ws(" ", "name", "primary_name").rlike(r"(?i)-\s*syn\b|\bsyn\b|synthetic") & F.contains(_lower("class"), F.lit("natural")), lambda: F.lit("named synthetic, classed natural"), "name"),
    Rule("synthetic", "note", lambda: F.contains(_lower("class"), F.lit("synth")) & F.contains(_lower("subclass"), F.lit("synth")) & ~F.concat_ws(" ", "name", "primary_name").rlike(r"(?i)-\s*syn\b|\bsyn\b|synthetic"),
        lambda: F.lit("classed synthetic, the name does not say so"), "name"),
    *_symmetry_rules(),
    Rule("optical", "flag", lambda: F.col("sign").isNotNull() & (F.size(_stated_signs()) == 1) & (F.get(_stated_signs(), F.lit(0)) != F.col("sign")), lambda: F.concat(F.lit("optic sign "), F.col("sign"), F.lit(" is not the paper's")), "optical"),
    Rule("ima", "flag", lambda: F.col("ima").rlike(r"(?:19|20)\d{2}\D{1,3}\d") & (F.size(_own_numbers()) == 1) & (F.get(_own_numbers(), F.lit(0)) != _registration(F.col("ima"))),
        lambda: F.concat(F.lit("registration number "), F.col("ima"), F.lit(" is not the paper's")), "ima"),
    Rule("ima", "flag", lambda: ~F.coalesce(F.col("ima"), F.lit("")).rlike(r"(?:19|20)\d{2}\D{1,3}\d") & _any_sentence(lambda s: F.lower(s).rlike("new mineral|approved by the ima") & F.contains(F.lower(s), F.lower("name"))),
        lambda: F.concat(F.lit("no registration number for a new mineral"), F.coalesce(F.concat(F.lit(": "), F.get(_own_numbers(), F.lit(0))), F.lit(""))), "ima"),
    Rule("analysis", "flag", lambda: (F.col("analysis_total") < 94) | (F.col("analysis_total") > 103), lambda: F.format_string("analysis total %.2f", F.col("analysis_total")), "analysis"),
    Rule("analysis", "flag", lambda: (F.col("n_analyses") != F.col("n_analyses_text")) & F.col("n_analyses_text").between(2, 50), lambda: F.format_string("mean of %d analyses, the paper says %d", F.col("n_analyses"), F.col("n_analyses_text")), "analysis"),
    Rule("analysis", "flag", lambda: (F.trim(F.coalesce("analysis", F.lit(""))) == "") & F.col("text").rlike(r"(?i)microprobe\s+anal|electron\s+(?:micro)?probe\s+anal|EPMA\s+(?:anal|data|result)"), lambda: F.lit("the paper reports an analysis, the field is empty"), "analysis"),
    Rule("temperature", "flag", lambda: ((F.col("temp_k") < 283) | (F.col("temp_k") > 310)) & ~F.coalesce(F.array_contains(_stated_temperatures(), F.col("temp_k").cast("int")), F.lit(False)), lambda: F.format_string("%.0f K is not ambient and not in the paper", F.col("temp_k")), "temperature"),
    *[Rule("instr_vocab", "flag", lambda f=f: _closest(f).isNotNull(), lambda f=f: F.concat(F.lit(f"{f} = "), F.col(f), F.lit(" — should be "), _closest(f)), f) for f in VOCABULARY],
    Rule("instr_vocab", "flag", lambda: F.replace(_lower("filter"), F.lit(" "), F.lit("")).startswith("beta") & (_lower("filter_type") != "") & (_lower("filter_type") != F.lower(_map(KBETA_FILTER)[F.col("anode_el")])), lambda: F.concat(F.lit("the Kβ filter is "), _map(KBETA_FILTER)[F.col("anode_el")]), "filter"),
    Rule("instr_vocab", "note", lambda: F.contains(_lower("filter"), F.lit("monochromator")) & (_lower("filter_type") != "") & ~_lower("filter_type").isin(*MONOCHROMATORS), lambda: F.concat(F.lit("no monochromator crystal: "), F.col("filter_type")), "filter"),
    Rule("instr_vocab", "flag", lambda: F.col("measured") & (_lower("anode") == ""), lambda: F.lit("measured data without a radiation"), "radiation"),
    Rule("instr_vocab", "flag", lambda: F.col("measured") & (_lower("intensity_type") == ""), lambda: F.lit("measured data without an intensity type"), "intensity_type"),
    Rule("instr_filter", "flag", lambda: (_lower("filter") == "") & _any_sentence(lambda s: s.rlike(_POWDER) & s.rlike(r"(?i)monochromator|monochromati[sz]ed|\b(?:Ni|Zr|Mn|Fe)[- ]filter")), lambda: F.lit("the paper names a filter for the powder data"), "filter"),
    Rule("name_formula", "flag", lambda: F.col("suffix_el").isNotNull() & (F.col("top_earth") != F.col("suffix_el")), lambda: F.concat(F.lit("the dominant rare earth is "), F.col("top_earth")), "name"),
    Rule("name_formula", "flag", lambda: F.col("sys").isNotNull() & ~F.contains(_map(POLYTYPES)[F.regexp_extract("name", r"-\d+([A-Z])\s*$", 1)], F.col("sys")), lambda: F.lit("polytype letter against the crystal system"), "name"),
    Rule("lambda_stated", "note", lambda: F.col("calculated") & F.col("lam_v").isNotNull() & ~F.col("lam_v").between(1.539, 1.543) & F.col("text").isNotNull() & ~F.exists(_text_numbers(), lambda v: F.abs(v - F.col("lam_v")) <= 0.001), lambda: F.lit("the wavelength of the calculated pattern is not in the paper"), "lam"),
    Rule("name_form", "note", lambda: F.col("primary_name").isNotNull() & (F.col("primary_name") != _normal_name(F.col("primary_name"))), lambda: F.concat(F.lit("primary name should be "), _normal_name(F.col("primary_name"))), "name"),
    Rule("sg_system", "flag", lambda: _family(F.col("sys")) != _family(F.col("sg_sys")), lambda: F.concat(F.lit("space group implies system "), F.col("sg_sys")), "cell:SG"),
    Rule("optical", "flag", lambda: F.col("sign").isNotNull() & (F.abs(F.col("two_vz") - 90) >= 18) & (F.col("sign") != F.when(F.col("two_vz") < 90, "+").otherwise("-")), lambda: F.lit("the indices contradict the optic sign"), "optical"),
    Rule("optical", "flag", lambda: F.abs(F.least(F.col("two_vz"), 180 - F.col("two_vz")) - F.col("two_v")) > 30, lambda: F.format_string("2V = %.0f, the indices give %.0f", F.col("two_v"), F.least(F.col("two_vz"), 180 - F.col("two_vz"))), "optical"),
    Rule("optical", "flag", lambda: F.col("n_a").isNull() & F.col("two_v").isNull() & F.col("sign").isNotNull() & (F.abs(F.col("n_q") - F.col("n_b")) >= 0.004) & (F.when(F.col("n_q") > F.col("n_b"), "+").otherwise("-") != F.col("sign")) & ~F.col("optical").rlike(r"\bA\b|2V"), lambda: F.lit("ω and ε contradict the optic sign"), "optical"),
    Rule("optical", "flag", lambda: (_collapsed() != ""), lambda: F.concat(F.lit("the uncertainty collapsed into the last digit: "), _collapsed()), "optical"),
    Rule("ref_title_case", "flag", lambda: F.size(_capitalised()) >= 2, lambda: F.concat(F.lit("capitalised in the title: "), F.concat_ws(", ", _capitalised())), "reference"),
    Rule("formula", "flag", lambda: _unbalanced(F.col("chemical")) | _unbalanced(F.col("empirical")), lambda: F.lit("unbalanced brackets in a formula"), "formula"),
    Rule("formula", "flag", lambda: F.coalesce("empirical", F.lit("")).rlike(r"(?<![A-Za-z\d.])[A-Z][a-z]?0\d+(?![\d.])|[A-Z][a-z]?\s*\d+:\d+"), lambda: F.lit("a coefficient with its decimal point lost"), "formula"),
    Rule("formula", "note", lambda: (F.size(F.array_except(_essential("chemical"), element_set(F.col("empirical")))) > 0) & (F.size(element_set(F.col("empirical"))) > 0), lambda: F.concat(F.lit("not in the empirical formula: "), F.concat_ws(",", F.array_sort(F.array_except(_essential("chemical"), element_set(F.col("empirical")))))), "formula"),
    Rule("xtl_density", "flag", lambda: (F.col("density.dev") >= 0.12) & ((F.col("density.simple") & (F.col("density.dev") >= 0.25)) | (F.col("density.dev") >= 0.30)), lambda: F.format_string("densities differ by %.0f%%", F.round(F.col("density.dev") * 100)), "density"),
    Rule("xtl_density", "note", lambda: (F.col("density.dev") >= 0.12) & ~((F.col("density.simple") & (F.col("density.dev") >= 0.25)) | (F.col("density.dev") >= 0.30)), lambda: F.format_string("densities differ by %.0f%%", F.round(F.col("density.dev") * 100)), "density"),
    Rule("mean_index", "flag", lambda: F.abs(_mean_index() - F.col("n_paper")) > 2 * F.when(F.col("n_q").isNull(), 0.02).otherwise(0.006), lambda: F.format_string("mean index %.4f, the paper gives %.4f", _mean_index(), F.col("n_paper")), "optical"),
    Rule("quality_mark", "note", lambda: F.trim(F.coalesce("quality_mark", F.lit(""))) == "", lambda: F.lit("the final quality mark is blank"), "quality"),
    Rule("density_blank", "flag", lambda: F.col("dx").isNull() & F.exists(_stated_densities(), lambda d: F.coalesce(F.abs(d - F.col("xtl_dx")) <= 0.15 * F.col("xtl_dx"), F.lit(True))), lambda: F.concat(F.lit("the paper states densities of "), F.concat_ws(", ", F.transform(_stated_densities(), lambda d: d.cast("string")))), "dx"),
    Rule("cell_cif", "flag", lambda: _cell_gap("sorted", 0.05) & ~_rational_cell(), lambda: F.lit("the cell differs from the structure's"), "cell:a"),
    Rule("cell_order", "flag", lambda: ~_cell_gap("sorted", 0.02) & _cell_gap("direct", 0.05), lambda: F.lit("the axes are those of the structure in another order"), "cell:a"),
    Rule("cif_z", "flag", lambda: (F.col("z") != F.col("cif_z")) & ~_contents_agree(), lambda: F.format_string("Z = %d, the structure has %d", F.col("z").cast("int"), F.col("cif_z").cast("int")), "cell:Z"),
)


# --- pieces the rules use -----------------------------------------------------------------------


def _stated_signs() -> Column:
    t = F.translate(F.coalesce("text", F.lit("")), "−–—", "---")
    marks = F.concat(
        F.regexp_extract_all(t, F.lit(r"(?i)(?:uniaxial|biaxial)\s*\(\s*([+-])\s*\)"), F.lit(1)),
        F.transform(F.regexp_extract_all(t, F.lit(r"(?i)optically\s+(positive|negative)"), F.lit(1)), lambda w: F.when(F.lower(w) == "positive", "+").otherwise("-")),
    )
    return F.array_distinct(marks)


def _registration(text: Column) -> Column:
    """``2012-083`` of any way of writing it; a letter is left aside."""
    year, number = F.regexp_extract(text, r"((?:19|20)\d{2})\D{0,3}?(\d{2,3})", 1), F.regexp_extract(text, r"((?:19|20)\d{2})\D{0,3}?(\d{2,3})", 2)
    return F.when(year != "", F.concat(year, F.lit("-"), F.lpad(number, 3, "0")))


def _own_numbers() -> Column:
    """Registration numbers the paper writes within sixty characters of the entry's own name."""
    near = F.expr(r"regexp_extract_all(coalesce(text, ''), concat('(?i)', regexp_replace(name, '([^A-Za-z0-9 ])', '.'), '[^.]{0,60}?IMA\\s*(?:No\\.?)?\\s*((?:19|20)\\d{2}\\s*[-–]\\s*\\d{2,3})'), 1)")
    return F.array_distinct(F.transform(near, _registration))


def _stated_temperatures() -> Column:
    t = F.coalesce("text", F.lit(""))
    kelvin = F.transform(F.regexp_extract_all(t, F.lit(r"\b(\d{2,3})(?:\s*\(\d+\))?\s*K\b"), F.lit(1)), lambda v: v.cast("int"))
    celsius = F.transform(F.regexp_extract_all(t, F.lit(r"(-?\d{1,3})\s*°\s*C\b"), F.lit(1)), lambda v: v.cast("int") + 273)
    room = F.when(t.rlike(r"(?i)\b(?:room|ambient) temperature\b"), F.array(F.lit(293))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.concat(kelvin, celsius, room), lambda v: v.between(80, 500))


def _text_numbers() -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\d+\.\d+)"), F.lit(1)), lambda v: v.cast("double"))


def _stated_densities() -> Column:
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?i)(?:Dcalc|D\s*\(calc\.?\)|calculated density)[^\d.]{0,25}(\d\.\d{2,3})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda v: v.cast("double")))


def _normal_name(name: Column) -> Column:
    """One space for several, the synthetic tag as ``-syn``, a rare-earth suffix in brackets."""
    out = F.regexp_replace(F.trim(name), r"\s+", " ")
    out = F.regexp_replace(out, r"(?i)[\s,-]*\bsyn(?:thetic)?\b\.?$", "-syn")
    return F.regexp_replace(out, rf"-({'|'.join(RARE_EARTHS)})$", "-($1)")


def _collapsed() -> Column:
    """An index with one decimal more than its neighbours and none of their uncertainty, whose last digit is theirs."""
    one = F.regexp_extract("optical", r"\b[ABQ]\s*=\s*(\d+\.\d{4})(?![\d(±])", 1)
    others = F.regexp_extract_all("optical", F.lit(r"\b[ABQ]\s*=\s*(\d+\.\d+\(\d+\))"), F.lit(1))
    twins = F.filter(others, lambda o: o.rlike(r"^\d+\.\d{3}\(") & (F.regexp_extract(o, r"\(\d*(\d)\)", 1) == F.substring(one, -1, 1)))
    return F.coalesce(F.when((one != "") & (F.size(others) > 0) & (F.size(twins) == F.size(others)), one), F.lit(""))


def _capitalised() -> Column:
    """Words of the title past the first that are capitalised there and that the paper, inside its sentences, mostly writes in lower case."""
    titled = F.split(F.coalesce("title", F.lit("")), r"[^\p{L}'-]+")
    words = F.filter(F.slice(titled, F.lit(2), F.size(titled)), lambda w: w.rlike(r"^\p{Lu}\p{Ll}{2,}$"))
    times = lambda w: F.size(F.filter("mid_words", lambda t: t == w))
    return F.filter(words, lambda w: times(F.lower(w)) > times(w))


def _unbalanced(formula: Column) -> Column:
    def count(c: str) -> Column:
        return F.length(formula) - F.length(F.replace(formula, F.lit(c), F.lit("")))

    return (count("(") != count(")")) | (count("[") != count("]"))


def _essential(field: str) -> Column:
    """Elements a formula writes with a coefficient of a quarter or more; hydrogen aside."""
    return F.array_distinct(F.transform(F.filter(element_counts(F.col(field)), lambda e: (e["n"] >= 0.25) & (e["element"] != "H")), lambda e: e["element"]))


def _mean_index() -> Column:
    return K.mean_index(F.col("n_a"), F.col("n_b"), F.col("n_q"), F.col("sign"))


def _lengths(prefix: str) -> Column:
    a, b, c = (F.col(f"{prefix}{x}") for x in ("a", "b", "c"))
    return F.array(a, F.coalesce(b, a), F.coalesce(c, a))


def _own_lengths() -> Column:
    a, b, c = (F.col(f"v_{x}.value") for x in ("a", "b", "c"))
    return F.array(a, F.coalesce(b, a), F.coalesce(c, a))


def _cell_gap(how: str, limit: float) -> Column:
    own, ref = _own_lengths(), _lengths("cif_")
    if how == "sorted":
        own, ref = F.array_sort(own), F.array_sort(ref)
    worst = F.array_max(F.zip_with(own, ref, lambda x, y: F.abs(x - y) / F.greatest(x, y)))
    return F.col("cif_a").isNotNull() & F.col("v_a.value").isNotNull() & (worst > limit)


def _rational_cell() -> Column:
    ratios = F.zip_with(F.array_sort(_own_lengths()), F.array_sort(_lengths("cif_")), lambda x, y: F.greatest(x, y) / F.least(x, y))
    return F.exists(ratios, lambda r: (F.abs(r - 2) / 2 < 0.05) | (F.abs(r - 3) / 3 < 0.05) | (F.abs(r - 4) / 4 < 0.05) | (F.abs(r - 1.5) / 1.5 < 0.05))


def _contents_agree() -> Column:
    """Z times the formula gives the same cell contents: by the oxygen count or by the cations, within a twentieth."""
    def total(field: str, oxygen: bool) -> Column:
        kept = F.filter(element_counts(F.col(field)), lambda e: (e["element"] == "O") if oxygen else ~e["element"].isin("O", "H"))
        return F.aggregate(kept, F.lit(0.0), lambda s, e: s + e["n"])

    def close(oxygen: bool) -> Column:
        x, y = F.col("z") * total("chemical", oxygen), F.col("cif_z") * total("cif_formula", oxygen)
        return (x > 0) & (y > 0) & (F.abs(x - y) <= 0.05 * F.greatest(x, y))

    return F.coalesce(close(True) | close(False), F.lit(False))


def derive(entries: DataFrame) -> DataFrame:
    """The remaining derived columns: analysis total and counts, temperature in kelvin, rare-earth suffix and argmax."""
    earths = F.filter(element_counts(F.col("empirical")), lambda e: e["element"].isin(*RARE_EARTHS))
    ranked = F.array_max(F.transform(earths, lambda e: F.struct(e["n"].alias("n"), e["element"].alias("e"))))
    unique = F.size(F.filter(earths, lambda e: e["n"] == ranked["n"])) == 1
    suffix = F.nullif(F.regexp_extract("name", rf"-\(({'|'.join(RARE_EARTHS)})\)\s*$", 1), F.lit(""))
    count = lambda c: F.expr(f"try_cast(regexp_extract({c}, '(?i)(?:average|mean)\\\\s+of\\\\s+(\\\\d+)', 1) AS int)")
    kelvin = F.expr(r"try_cast(regexp_extract(temperature, '(-?\\d+(?:\\.\\d+)?)\\s*K', 1) AS double)")
    celsius = F.expr(r"try_cast(regexp_extract(temperature, '(-?\\d+(?:\\.\\d+)?)\\s*°\\s*C', 1) AS double)") + 273
    return (
        entries.withColumn("analysis_total", F.expr(r"try_cast(regexp_extract(analysis, '(?i)total\\s*[=:]?\\s*(\\d+\\.\\d+)', 1) AS double)"))
        .withColumn("n_analyses", count("analysis")).withColumn("n_analyses_text", count("text"))
        .withColumn("temp_k", F.coalesce(kelvin, celsius))
        .withColumn("suffix_el", suffix)
        .withColumn("top_earth", F.when((F.size(earths) >= 2) & unique, ranked["e"]))
    )


# --- rules over more than the entry -------------------------------------------------------------


def _finding(rows: DataFrame, code: str, sev, message: Column, anchor: str = "refl") -> DataFrame:
    return rows.select("entry_id", F.lit(code).alias("code"), (F.lit(sev) if isinstance(sev, str) else sev).alias("sev"), message.alias("msg"), F.lit(anchor).alias("anchor"))


def candidate_indices(h: Column, k: Column, l: Column) -> Column:
    """Readings of a row's indices (strings): as written, and — packed columns of equal count — digit by digit."""
    digits = [F.regexp_extract_all(x, F.lit(r"(-?\d)"), F.lit(1)) for x in (h, k, l)]
    packed = F.when(
        (F.size(digits[0]) == F.size(digits[1])) & (F.size(digits[1]) == F.size(digits[2])) & (F.size(digits[0]) > 1),
        F.transform(F.arrays_zip(*[d.alias(n) for d, n in zip(digits, "hkl")]), lambda p: F.struct(*[p[n].cast("int").alias(n) for n in "hkl"])),
    ).otherwise(F.array().cast("array<struct<h:int,k:int,l:int>>"))
    whole = h.rlike(r"^\s*-?\d+\s*$") & k.rlike(r"^\s*-?\d+\s*$") & l.rlike(r"^\s*-?\d+\s*$")
    head = F.when(whole, F.array(F.struct(*[F.trim(x).cast("int").alias(n) for x, n in zip((h, k, l), "hkl")]))).otherwise(F.array().cast("array<struct<h:int,k:int,l:int>>"))
    return F.filter(F.concat(head, packed), lambda t: ~((t["h"] == 0) & (t["k"] == 0) & (t["l"] == 0)))


def rule_indexing(reflections: DataFrame, cells: DataFrame, shown: int | None = None) -> DataFrame:
    """Rows whose best reading of the indices is off the cell by 3 % (5 % for intensities to 35), worst first; with `shown`, only so many are named.

    `reflections`: entry_id, line_no, d, i, h, k, l (strings); `cells`: entry_id, a … ga.
    """
    rows = reflections.withColumn("cand", candidate_indices(F.col("h"), F.col("k"), F.col("l"))).where("size(cand) > 0").join(cells, "entry_id")
    cell = [F.col(c) for c in ("a", "b", "c")] + [F.coalesce(F.col(c), F.lit(90.0)) for c in ("al", "be", "ga")]
    best = F.array_min(F.transform("cand", lambda t: F.struct(F.abs(K.d_spacing(cell, t["h"], t["k"], t["l"]) - F.col("d")).alias("off"), t.alias("t"))))
    rows = rows.withColumn("rel", best["off"] / F.col("d"))
    bad = F.col("rel") > F.when(F.col("i") <= 35, 0.05).otherwise(0.03)
    sums = rows.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad")).where("n_bad > 0")
    place = F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("rel"), "line_no"))
    worst = rows.where(bad).withColumn("place", place).where(F.lit(True) if shown is None else F.col("place") <= shown).groupBy("entry_id").agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("place", F.format_string("%.4f [%.1f%%]", F.col("d"), F.col("rel") * 100).alias("t")))), lambda s: s["t"])).alias("shown"))
    return _finding(sums.join(worst, "entry_id"), "indexing", "flag", F.format_string("%d of %d reflections disagree with the cell: %s", F.col("n_bad"), F.col("n"), F.col("shown")))


def rule_geometry(reflections: DataFrame, entries: DataFrame) -> DataFrame:
    """A d under λ/2, or 2θ beyond 160°, in a measured list."""
    low = reflections.where("d > 0").groupBy("entry_id").agg(F.min("d").alias("dmin"))
    rows = low.join(entries.where("NOT calculated AND lam_v > 0").select("entry_id", "lam_v"), "entry_id")
    tt = K.two_theta(F.col("dmin"), F.col("lam_v"))
    rows = rows.withColumn("msg", F.when(F.col("dmin") < F.col("lam_v") / 2 - 1e-6, F.format_string("d = %.4f is impossible at this wavelength", F.col("dmin"))).when(tt > 160, F.format_string("the list reaches 2θ = %.0f", tt)))
    return _finding(rows.where("msg IS NOT NULL"), "reflection_geom", "flag", F.col("msg"), "radiation")


def rule_granularity(reflections: DataFrame, entries: DataFrame) -> DataFrame:
    """Eight intensities or more, three of them different, all multiples of ten: a visual estimate; all of five: a note."""
    whole = F.floor("i")
    sums = reflections.where("i IS NOT NULL").groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(whole).alias("k"), F.bool_and(whole % 10 == 0).alias("tens"), F.bool_and((whole % 5 == 0) & (F.col("i") == whole)).alias("fives")
    ).where("n >= 8 AND k >= 3")
    rows = sums.join(entries.where("NOT calculated").select("entry_id", F.lower("intensity_type").alias("it"), F.lower(F.coalesce("intensity_instr", F.lit(""))).alias("ii")), "entry_id").where("coalesce(it, '') <> ''")
    visual = rows.where("tens AND it NOT IN ('peak', 'visual')")
    fives = rows.where("NOT tens AND fives AND ii <> 'visual'")
    return _finding(visual, "intensity_type", "flag", F.lit("all intensities are multiples of ten: a visual estimate"), "intensity_type").unionByName(
        _finding(fives, "intensity_type", "note", F.lit("all intensities are multiples of five"), "intensity_type")
    )


def rule_blank_indices(reflections: DataFrame) -> DataFrame:
    """A d entered twice, some row indexed without a mark and some row blank."""
    indexed = F.trim(F.concat_ws("", "h", "k", "l")) != ""
    marked = F.trim(F.coalesce("flag", F.lit(""))) != ""
    bad = reflections.groupBy("entry_id", "d").agg(F.count(F.lit(1)).alias("n"), F.bool_or(indexed).alias("some"), F.bool_or(~indexed).alias("blank"), F.bool_or(indexed & marked).alias("m")).where("n > 1 AND some AND blank AND NOT m")
    return _finding(bad.groupBy("entry_id").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("k")), "hkl_blank", "note", F.format_string("%d lines entered twice, one without indices; first d = %.4f", F.col("k"), F.col("d")))


def rule_two_intensities(reflections: DataFrame, entries: DataFrame) -> DataFrame:
    """One d with several intensities in a measured list."""
    bad = reflections.where("i IS NOT NULL").groupBy("entry_id", "d").agg(F.count_distinct("i").alias("k")).where("k > 1")
    per = bad.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d")).join(entries.where("measured").select("entry_id"), "entry_id", "left_semi")
    return _finding(per, "same_d", "note", F.format_string("%d lines with two intensities; first d = %.4f", F.col("n"), F.col("d")))


def one_keystroke(a: Column, b: Column) -> Column:
    """One character changed, dropped or added, or two neighbours swapped (column of strings)."""
    swaps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))))
    return (a != b) & ((F.levenshtein(a, b) == 1) | ((F.length(a) == F.length(b)) & F.array_contains(swaps, b)))


def rule_strongest_lines(listed: DataFrame, reflections: DataFrame, strong: float = 20.0) -> DataFrame:
    """The paper's list of strongest lines against the reflection list: of the sentences that fit, the best.

    `listed`: entry_id, sent_no, d_txt, i. A line is found within 0.6 of its last decimal or 0.3 %; a sentence with fewer
    than three lines, or misses over a third, says nothing.
    """
    from recordaudit.operators.matching import range_join

    rows = listed.withColumn("v", F.col("d_txt").cast("double")).withColumn("tol", F.greatest(0.6 * F.pow(F.lit(10.0), -F.length(F.substring_index("d_txt", ".", -1))), 0.003 * F.col("d_txt").cast("double")))
    windows = rows.withColumn("lo", F.col("v") - F.col("tol")).withColumn("hi", F.col("v") + F.col("tol")).select("entry_id", "sent_no", "d_txt", "lo", "hi")
    hit = range_join(reflections.select("entry_id", "d"), windows, "d", "lo", "hi", 0.1, ["entry_id"]).select("entry_id", "sent_no", "d_txt").distinct().withColumn("hit", F.lit(1))
    judged = rows.join(hit, ["entry_id", "sent_no", "d_txt"], "left")
    sentences = judged.groupBy("entry_id", "sent_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit").isNull()).alias("miss")).where("n >= 3 AND miss <= greatest(1, floor(n / 3))")
    best = sentences.groupBy("entry_id").agg(F.min_by(F.struct("sent_no", "miss"), F.struct("miss", "sent_no")).alias("b")).where("b.miss > 0").select("entry_id", F.col("b.sent_no").alias("sent_no"))
    lost = judged.where("hit IS NULL").join(best, ["entry_id", "sent_no"])
    per = lost.groupBy("entry_id").agg(F.bool_or(F.col("i") >= strong).alias("s"), F.concat_ws(", ", F.array_sort(F.collect_set("d_txt"))).alias("shown"))
    return _finding(per, "strongest_lines", F.when(F.col("s"), "flag").otherwise("note"), F.concat(F.lit("among the strongest lines and not in the list: "), F.col("shown")))


def rule_printed_lines(reflections: DataFrame, tokens: DataFrame) -> DataFrame:
    """Lines of a list that is printed in the paper's text (all but a handful) and that the text lacks.

    `reflections`: entry_id, d_txt; `tokens`: entry_id, token (decimal numbers of the text). A text number one keystroke
    away is named; candidates are met through their delete neighbourhood.
    """
    from recordaudit.functions.names import deletes

    lines = reflections.select("entry_id", "d_txt").distinct()
    bare = lambda c: F.regexp_replace(F.col(c), r"0+$", "")
    words = tokens.select("entry_id", F.col("token"), bare("token").alias("t")).distinct()
    found = lines.withColumn("t", bare("d_txt")).join(words.select("entry_id", "t").distinct(), ["entry_id", "t"], "left_semi").select("entry_id", "d_txt", F.lit(1).alias("hit"))
    judged = lines.join(found, ["entry_id", "d_txt"], "left")
    sums = judged.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit").isNull()).alias("miss")).where("n >= 8 AND miss > 0 AND miss <= CASE WHEN n < 20 THEN 1 ELSE greatest(2, 0.05 * n) END")
    lost = judged.where("hit IS NULL").join(sums.select("entry_id"), "entry_id", "left_semi").select("entry_id", "d_txt")
    left = lost.select("entry_id", "d_txt", F.explode(deletes(F.col("d_txt"), 1)).alias("x"))
    swapped = lost.select("entry_id", "d_txt", F.explode(F.transform(F.sequence(F.lit(1), F.length("d_txt") - 1), lambda i: F.concat(F.substring("d_txt", F.lit(1), i - 1), F.substring("d_txt", i + 1, F.lit(1)), F.substring("d_txt", i, F.lit(1)), F.substring("d_txt", i + 2, F.length("d_txt"))))).alias("x"))
    near = words.join(sums.select("entry_id"), "entry_id", "left_semi").select("entry_id", "token", F.explode(deletes(F.col("token"), 1)).alias("x"))
    offers = left.unionByName(swapped).join(near, ["entry_id", "x"]).where(one_keystroke(F.col("d_txt"), F.col("token"))).groupBy("entry_id", "d_txt").agg(F.min("token").alias("near"))
    per = lost.join(offers, ["entry_id", "d_txt"], "left").groupBy("entry_id").agg(
        F.bool_or(F.col("near").isNotNull()).alias("s"), F.concat_ws("; ", F.array_sort(F.collect_set(F.concat_ws(" ← ", "d_txt", "near")))).alias("shown")
    )
    return _finding(per, "reflections", F.when(F.col("s"), "flag").otherwise("note"), F.concat(F.lit("not printed in the paper: "), F.col("shown")))


def rule_extinctions(reflections: DataFrame, symops: DataFrame) -> DataFrame:
    """Indexed rows the space group forbids: a flag for one or two among many, else a note. `reflections`: entry_id, line_no,
    space_group, h, k, l (int)."""
    from recordaudit.operators.structures import systematic_absences

    rows = systematic_absences(reflections.where("NOT (h = 0 AND k = 0 AND l = 0)"), symops)
    sums = rows.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("absent").alias("bad")).where("bad > 0 AND n >= 5")
    sev = F.when(F.col("bad") <= F.greatest(F.lit(2), 0.1 * F.col("n")), "flag").otherwise("note")
    return _finding(sums, "extinction", sev, F.format_string("%d of %d indexed reflections are forbidden", F.col("bad"), F.col("n")))


def rule_missing_lines(paper: DataFrame, entry: DataFrame) -> DataFrame:
    per = missing_lines(paper, entry).groupBy("entry_id").agg(F.max("sev").alias("s"), F.min("sev").alias("sev"), F.concat_ws("; ", F.transform(F.array_sort(F.collect_list("d")), lambda d: F.format_string("%.4f", d))).alias("shown"))
    return _finding(per, "lines_missing", F.col("sev"), F.concat(F.lit("absent from the list: "), F.col("shown")))


def rule_intensities(paper: DataFrame, entry: DataFrame) -> DataFrame:
    per = intensity_outliers(paper, entry).groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"))
    return _finding(per, "intensity_paper", "flag", F.format_string("%d intensities are not the paper's; first d = %.4f", F.col("n"), F.col("d")))


def rule_classification(entries: DataFrame, species: DataFrame, groups: DataFrame) -> DataFrame:
    """The group of the entry's species, where the record's classification names none: `species`: norm, groupid; `groups`:
    gid, name."""
    from recordaudit.functions.names import norm_name

    rows = entries.withColumn("norm", norm_name(F.col("name"))).join(species, "norm").join(groups.withColumnRenamed("gid", "groupid").withColumnRenamed("name", "group_name"), "groupid")
    silent = ~F.contains(F.lower(F.coalesce("subclass", F.lit(""))), F.lower("group_name"))
    return _finding(rows.where(silent), "classification", "info", F.concat(F.lit("member of "), F.col("group_name")), "name")


def rule_exported(entries: DataFrame, exported: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields of a record against the exported record, null-safe and without regard to case or spaces."""
    def soft(c: Column) -> Column:
        return F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", ""))

    other = exported.select("entry_id", *[F.col(f).alias(f"x_{f}") for f in fields])
    off = F.array_compact(F.array(*[F.when(~soft(F.col(f)).eqNullSafe(soft(F.col(f"x_{f}"))), F.lit(f)) for f in fields]))
    rows = entries.join(other, "entry_id").withColumn("off", off).where("size(off) > 0")
    return _finding(rows, "dft", "note", F.concat(F.lit("differs from the export: "), F.concat_ws(", ", "off")), "dft")


def radiation_verdict(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``entry_id, verdict, powder_anode, lam_off``: the record's anode against the paper's powder radiation.

    `entries`: entry_id, anode, lam_v, anode_el, calculated; `candidates`: entry_id, anode (element), lam, context, collected.
    A collected powder radiation ranks first, then the record's own anode, then one with a wavelength.
    """
    mine = entries.select("entry_id", F.col("anode").alias("own"), "lam_v", "anode_el", "calculated")
    joined = candidates.join(mine, "entry_id")
    rank = F.struct((~F.coalesce("collected", F.lit(False))).alias("c"), (F.coalesce(F.col("anode") != F.col("anode_el"), F.lit(True))).alias("m"), F.col("lam").isNull().alias("n"), F.col("anode"), F.col("lam").alias("v"))
    per = joined.groupBy("entry_id").agg(
        F.min_by(F.struct("anode", "lam"), F.when(F.col("context") == "powder", rank)).alias("p"),
        F.bool_or(F.coalesce(F.col("anode") == F.col("anode_el"), F.lit(False))).alias("any_match"), F.count_distinct("anode").alias("k"),
    )
    rows = mine.join(per, "entry_id", "left")
    base = (
        F.when(F.col("anode_el").isNull(), F.when(is_synchrotron(F.col("own")), "ok").otherwise("unrec"))
        .when(F.col("p.anode").isNotNull(), F.when(F.col("p.anode") == F.col("anode_el"), "ok").otherwise("flag"))
        .when(F.coalesce("any_match", F.lit(False)), F.when(F.col("k") == 1, "ok").otherwise("verify"))
        .otherwise("flag")
    )
    verdict = F.when(F.col("calculated") & base.isin("flag", "verify"), "calc").otherwise(base)
    off = F.coalesce(F.abs(F.col("p.lam") - F.col("lam_v")) > 0.003, F.lit(False))
    return rows.select("entry_id", verdict.alias("verdict"), F.col("p.anode").alias("powder_anode"), off.alias("lam_off"))
