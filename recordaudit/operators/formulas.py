"""Formulas of one entry against each other: coefficients by a join on elements, symbols against the table of elements.

`formulas` is long: ``entry_id, field, formula``. A formula is read from its end to its beginning in one fold, so that a bracket's
multiplier is known before what it holds; nested brackets multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordaudit.functions.elements import ATOMIC_WEIGHTS, USUAL_OXIDE
from recordaudit.functions.measured import let
from recordaudit.session import cut_lineage

_TOKEN = r"[A-Z][a-z]?\s*(?:\d+(?:\.\d+)?|\.\d+)?|[)\]]\s*(?:\d+(?:\.\d+)?)?|[(\[]"
_ATOMS = "array<struct<element:string,n:double,decimal:boolean>>"
#: a coefficient differs by more than this, or this share of the larger one; smaller coefficients are not compared
GAP_ABS, GAP_REL, SMALLEST = 0.02, 0.03, 0.05


def clean_formula(formula: Column) -> Column:
    """Without charges (``Fe0.78 +3``), vacancy marks (``$XS``) and sums of a site (``)$S I1.05``)."""
    out = F.regexp_replace(F.coalesce(formula, F.lit("")), r"\$S\s*I\s*\d+(?:\.\d+)?", "")
    out = F.regexp_replace(out, r"\$[A-Za-z]{1,2}", "")
    return F.regexp_replace(F.regexp_replace(out, r"\s[+\-−]\s?\d|\s\d[+\-−](?=[\s)\]]|$)", " "), r"(?<=[A-Za-z])\d[+−]", "")


def formula_atoms(formula: Column) -> Column:
    """``array<struct<element, n, decimal>>``: every symbol written, its coefficient times those of the brackets around it.

    `decimal` says that the coefficient is printed with decimals. Parts after ``!``, ``·`` or ``•`` may begin with a number that
    multiplies them. Brackets that are not closed multiply nothing.
    """
    def number(token: Column) -> Column:
        return F.regexp_extract(token, r"(\d*\.?\d+)$", 1)

    def part(text: Column) -> Column:
        lead = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*(?=[A-Z(\[])", 1)
        start = F.when(lead == "", 1.0).otherwise(lead.cast("double"))
        tokens = F.reverse(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)))
        empty = F.struct(F.array(start).alias("by"), F.array().cast(_ATOMS).alias("out"))

        def step(state: Column, token: Column) -> Column:
            by, out, first = state["by"], state["out"], F.substring(token, 1, 1)
            top = F.element_at(by, -1)
            n = F.when(number(token) == "", 1.0).otherwise(number(token).cast("double"))
            return (
                F.when(first.isin(")", "]"), F.struct(F.concat(by, F.array(top * n)).alias("by"), out.alias("out")))
                .when(first.isin("(", "["), F.struct(F.when(F.size(by) > 1, F.slice(by, F.lit(1), F.size(by) - 1)).otherwise(by).alias("by"), out.alias("out")))
                .otherwise(F.struct(by.alias("by"), F.concat(out, F.array(F.struct(
                    F.regexp_extract(token, r"^([A-Z][a-z]?)", 1).alias("element"), (top * n).alias("n"), F.contains(token, F.lit(".")).alias("decimal")))).alias("out")))
            )

        return F.aggregate(tokens, empty, step, lambda s: s["out"])

    return F.flatten(F.transform(F.split(clean_formula(formula), "[!·•]"), part))


def _distinct(formulas: DataFrame) -> DataFrame:
    texts = formulas.where("formula IS NOT NULL").select("formula").distinct()
    return texts.repartition(formulas.sparkSession.sparkContext.defaultParallelism * 4, "formula")  # few bytes, much work


def _read_once(formulas: DataFrame, found: Column | str, name: str, texts: DataFrame | None = None) -> DataFrame:
    """``entry_id, field, formula`` and each item of the array `found`, which is worked out once for equal formulas (or stands in `texts`)."""
    texts = _distinct(formulas) if texts is None else texts
    return formulas.select("entry_id", "field", "formula").join(texts.select("formula", F.explode(found).alias(name)), "formula")


def _totals(atoms: Column) -> Column:
    """The atoms of one formula with those of one element added up."""
    def total(atoms: Column, element: Column) -> Column:
        own = F.filter(atoms, lambda a: a["element"] == element)
        return F.struct(element.alias("element"), F.aggregate(own, F.lit(0.0), lambda s, a: s + a["n"]).alias("n"), F.exists(own, lambda a: a["decimal"]).alias("decimal"))

    return let(atoms, lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda a: a["element"])), lambda e: total(all_, e)))


def elements_of(formulas: DataFrame) -> DataFrame:
    """``entry_id, field, element, n, decimal``: the total of each element of each formula, one aggregation. Equal formulas are read once."""
    atoms = _read_once(formulas, formula_atoms(F.col("formula")), "a")
    return atoms.groupBy("entry_id", "field", F.col("a.element").alias("element")).agg(F.sum("a.n").alias("n"), F.bool_or("a.decimal").alias("decimal"))


def _by_element(formulas: DataFrame, texts: DataFrame | None = None, left: str | None = None, right: str | None = None) -> DataFrame:
    """``entry_id, element``, its totals in the fields `left` and `right`, whether printed with decimals, how many of the entry's elements
    are, and the first and last field that names it. A formula goes to its entry with its atoms in one row; nothing moves after that."""
    def of(field: str, n: str) -> list[Column]:
        here = F.col("field") == field
        return [F.sum(F.when(here, F.col("a.n"))).alias(n), F.bool_or(F.when(here, F.col("a.decimal"))).alias(f"{n}_dec")]

    read = _distinct(formulas).select("formula", _totals(formula_atoms(F.col("formula"))).alias("atoms")) if texts is None else texts.select("formula", "atoms")
    held = formulas.select("entry_id", "field", "formula").join(read, "formula").select("entry_id", "field", "atoms").repartition("entry_id")
    sides = [*of(left, "n_left"), *of(right, "n_right")] if left is not None and right is not None else []
    rows = held.select("entry_id", "field", F.explode("atoms").alias("a")).groupBy("entry_id", F.col("a.element").alias("element")).agg(*sides, F.min("field").alias("first_field"), F.max("field").alias("last_field"))
    of_entry = Window.partitionBy("entry_id")
    return rows.select("*", *[F.count_if(f"{n}_dec").over(of_entry).alias(k) for n, k in (("n_left", "k_left"), ("n_right", "k_right")) if sides])


def coefficient_gaps(formulas: DataFrame, left: str, right: str, elements: DataFrame | None = None) -> DataFrame:
    """``entry_id, element, n_left, n_right``: elements whose coefficients in two fields of one entry disagree.

    One aggregation by entry and element (`elements`, where it is at hand). Coefficients count where they are printed with decimals; an element that one field lacks
    altogether disagrees too. Oxygen and hydrogen are left aside. Entries without either field, or with fewer than two
    decimal coefficients in one of them, are not compared.
    """
    if elements is None:
        elements = _by_element(formulas.where(F.col("field").isin(left, right)), None, left, right)
    both = elements.where("(n_left IS NOT NULL OR n_right IS NOT NULL) AND k_left >= 2 AND k_right >= 2 AND element NOT IN ('O', 'H')")
    larger = F.greatest("n_left", "n_right")
    differ = F.col("n_left_dec") & F.col("n_right_dec") & (F.round(F.abs(F.col("n_left") - F.col("n_right")), 9) > F.greatest(F.lit(GAP_ABS), F.round(GAP_REL * larger, 9)))
    lacking = (F.col("n_left").isNull() & F.col("n_right_dec")) | (F.col("n_right").isNull() & F.col("n_left_dec"))
    return both.where((larger >= SMALLEST) & (F.coalesce(differ, F.lit(False)) | lacking)).select("entry_id", "element", F.round("n_left", 6).alias("n_left"), F.round("n_right", 6).alias("n_right"))


def lone_elements(formulas: DataFrame, least: int = 3, elements: DataFrame | None = None) -> DataFrame:
    """``entry_id, field, element``: elements that one field alone names, in entries with `least` fields or more; O and H aside."""
    if elements is None:
        elements = _by_element(formulas)
    fields = formulas.where("formula IS NOT NULL").groupBy("entry_id").agg(F.count_distinct("field").alias("fields")).where(F.col("fields") >= least)
    alone = elements.where("first_field = last_field AND element NOT IN ('O', 'H')").select("entry_id", "element", F.col("first_field").alias("field"))
    return alone.join(fields, "entry_id").select("entry_id", "field", "element")


def _split_pairs() -> Column:
    """Two capitals before a decimal coefficient."""
    pattern = r"(?<![A-Za-z])([A-Z])\s+([A-Z])(\d*\.\d+)"
    all_of = lambda k: F.regexp_extract_all("formula", F.lit(pattern), F.lit(k))
    return F.arrays_zip(all_of(0).alias("written"), all_of(1).alias("a"), all_of(2).alias("b"))


def split_symbols(formulas: DataFrame, elements: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """``entry_id, field, written, symbol``: an element's symbol that is written as two capitals apart (``T B0.01`` for Tb).

    Two capitals before a decimal coefficient meet the table of elements as one symbol; they are a slip if the first is no element by itself, or if another
    formula of the entry names the joined one.
    """
    spark = formulas.sparkSession
    known = spark.createDataFrame([(e,) for e in ATOMIC_WEIGHTS], "symbol string")
    pairs = _read_once(formulas, _split_pairs() if texts is None else "pairs", "p", texts)
    met = pairs.select("entry_id", "field", "p.written", "p.a", F.concat("p.a", F.lower("p.b")).alias("symbol")).join(known, "symbol")
    first = met.join(known.withColumnRenamed("symbol", "a").withColumn("own", F.lit(True)), "a", "left")
    if elements is None:
        elements = _by_element(formulas)
    elsewhere = elements.select("entry_id", F.col("element").alias("symbol"), "first_field", "last_field")
    other = (F.col("first_field") != F.col("field")) | (F.col("last_field") != F.col("field"))
    slips = ["entry_id", "field", "written", "symbol"]
    named = first.where("own IS NOT NULL").join(elsewhere, ["entry_id", "symbol"]).where(other).select(*slips)
    return first.where("own IS NULL").select(*slips).unionByName(named).distinct()


def recased_constituents(listed: DataFrame) -> DataFrame:
    """``entry_id, constituent, should_be``: names of constituents that are none as written and one when their letters' case, or a zero
    for an O, is put right (``BAO``, ``k2O``, ``P205``). `listed`: entry_id, constituent. An equi-join on the folded name."""
    spark = listed.sparkSession
    fold = lambda c: F.translate(F.lower(c), "0", "o")
    known = spark.createDataFrame([(f,) for f in sorted({*USUAL_OXIDE.values(), "Fe2O3", "Mn2O3", "H2O", "V2O3", "As2O3", "Sb2O5", "Pr2O3", "Sm2O3", "Eu2O3", "Gd2O3", "Dy2O3"})], "should_be string").withColumn("k", fold(F.col("should_be")))
    odd = listed.where(F.col("constituent").rlike(r"^[A-Za-z0-9]{2,9}$") & (F.col("constituent").rlike(r"\d") | (F.upper("constituent") == F.col("constituent")))).withColumn("k", fold(F.col("constituent")))
    return odd.join(known, "k").where("constituent <> should_be").select("entry_id", "constituent", "should_be")


def written_faults(formulas: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``entry_id, field, fault, written``: brackets that do not pair, a lost decimal point, a colon or a blank inside a coefficient."""
    return _read_once(formulas, _faults() if texts is None else "faults", "w", texts).select("entry_id", "field", "w.fault", "w.written")


def _faults() -> Column:
    text = F.col("formula")
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    found = lambda fault, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.struct(F.lit(fault).alias("fault"), w.alias("written")))
    brackets = F.when((count("(") != count(")")) | (count("[") != count("]")), F.array(F.struct(F.lit("brackets").alias("fault"), text.alias("written"))))
    known = "|".join(sorted(ATOMIC_WEIGHTS, key=lambda e: (-len(e), e)))
    return F.array_distinct(F.concat(
        F.coalesce(brackets, F.array().cast("array<struct<fault:string,written:string>>")), found("decimal point", rf"(?<![A-Za-z\d.])(?:{known})0\d+(?![\d.])"),
        found("colon", r"[A-Z][a-z]?\s*\d+:\d+"), found("blank", rf"(?<![A-Za-z])(?:{known})\s*(?:\d+\s+\.\d+|\d+\.\d\s\d(?![\d.]))")))


def formula_findings(formulas: DataFrame, listed: DataFrame, left: str = "Analytical", right: str = "Analysis") -> DataFrame:
    """All of the above as findings: ``entry_id, code, sev, msg, anchor``; elements of a split symbol are not reported again."""
    # a formula's atoms (those of one element together), its split symbols and its faults are read once; an entry's elements three times below
    texts = cut_lineage(_distinct(formulas).select("formula", _totals(formula_atoms(F.col("formula"))).alias("atoms"), _split_pairs().alias("pairs"), _faults().alias("faults")))
    elements = cut_lineage(_by_element(formulas, texts, left, right))
    split = cut_lineage(split_symbols(formulas, elements, texts))
    garbled = split.select("entry_id", F.explode(F.array(F.substring("written", 1, 1), F.regexp_extract("written", r"\s([A-Z])", 1), "symbol")).alias("element")).distinct()
    gaps = coefficient_gaps(formulas, left, right, elements).join(garbled, ["entry_id", "element"], "left_anti").groupBy("entry_id").agg(F.array_sort(F.collect_list(F.concat_ws(
        " ", "element", F.coalesce(F.format_number("n_left", 3), F.lit("absent")), F.lit("vs"), F.coalesce(F.format_number("n_right", 3), F.lit("absent"))))).alias("gaps"))
    lone = lone_elements(formulas, elements=elements).join(garbled, ["entry_id", "element"], "left_anti")
    row = lambda code, msg, anchor: (F.lit(code).alias("code"), F.lit("flag").alias("sev"), msg.alias("msg"), anchor.alias("anchor"))
    of = lambda c: F.concat(F.lit("formula:"), F.col(c))
    parts = [
        gaps.select("entry_id", *row("formula", F.concat(F.lit(f"{left} and {right} disagree: "), F.array_join("gaps", "; ")), F.lit(f"formula:{left}"))),
        lone.select("entry_id", *row("formula", F.concat(F.col("element"), F.lit(" stands in no other formula")), of("field"))),
        split.select("entry_id", *row("formula", F.concat(F.lit("the symbol "), F.col("symbol"), F.lit(" is split in two: "), F.col("written")), of("field"))),
        written_faults(formulas, texts).select("entry_id", *row("formula", F.concat("fault", F.lit(": "), F.substring("written", 1, 120)), of("field"))),
        recased_constituents(listed).select("entry_id", *row("analysis", F.concat("constituent", F.lit(" should be "), F.col("should_be")), F.lit("analysis"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
