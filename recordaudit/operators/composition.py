"""Composition tables: replicate statistics, normalisation to a basis, balances, formula checks.

Points are first reduced to one row per sample and constituent (combined map-side), so what is later
windowed over a sample is its list of constituents, however many points a sample has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordaudit.functions.elements import ATOMIC_WEIGHTS, CHALCOGENS, HALOGENS, atomic_weights, usual_oxides

O_WEIGHT = ATOMIC_WEIGHTS["O"]


def by_sample():
    return Window.partitionBy("sample_id")


@dataclass(frozen=True)
class Basis:
    """What the formula is normalised to: ``O`` (anions), ``cations`` or ``element`` (the sum of some elements)."""

    kind: str
    n: float
    elements: tuple[str, ...] = ()


@dataclass(frozen=True)
class Added:
    """An unmeasured constituent: ``wt`` gives its weight, ``difference`` what is lacking to 100, ``structure`` its apfu."""

    formula: str
    element: str
    n_cat: int
    n_o: int
    charge: float
    mw: float
    kind: str
    mode: str
    value: float = 0.0


def replicate_stats(points: DataFrame) -> DataFrame:
    """Mean, sample deviation, range and count over the points that have a value; none at all gives zeros."""
    return points.groupBy("sample_id", "constituent").agg(
        F.coalesce(F.avg("wt"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp("wt"), F.lit(0.0)).alias("sd"),
        F.coalesce(F.min("wt"), F.lit(0.0)).alias("lo"),
        F.coalesce(F.max("wt"), F.lit(0.0)).alias("hi"),
        F.count("wt").alias("n"),
    )


def with_constituents(stats: DataFrame, constituents: DataFrame) -> DataFrame:
    """Statistics with what is known of each constituent; an unknown one raises when its row is read."""
    joined = stats.join(constituents.withColumnRenamed("formula", "constituent"), "constituent", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown constituent "), F.col("constituent")))
    return joined.withColumn("element", F.when(F.col("element").isNull(), unknown.cast("string")).otherwise(F.col("element")))


def convert(rows: DataFrame, constituents: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Restate constituents as others of the same element (``UO2`` as ``UO3``): weights scale by mass per cation."""
    if not pairs:
        return rows
    spark = rows.sparkSession
    wanted = spark.createDataFrame(list(pairs), "constituent string, target string")
    targets = constituents.select(
        F.col("formula").alias("target"), F.col("n_cat").alias("t_cat"), F.col("n_o").alias("t_o"), F.col("charge").alias("t_charge"), F.col("mw").alias("t_mw"), F.col("kind").alias("t_kind")
    )
    joined = rows.join(wanted.join(targets, "target"), "constituent", "left")
    k = F.coalesce((F.col("t_mw") / F.col("t_cat")) / (F.col("mw") / F.col("n_cat")), F.lit(1.0))
    return joined.select(
        "sample_id",
        F.coalesce("target", "constituent").alias("constituent"),
        *[(F.col(c) * k).alias(c) for c in ("mean", "sd", "lo", "hi")],
        "n",
        "element",
        F.coalesce("t_cat", "n_cat").alias("n_cat"),
        F.coalesce("t_o", "n_o").alias("n_o"),
        F.coalesce("t_charge", "charge").alias("charge"),
        F.coalesce("t_mw", "mw").alias("mw"),
        F.coalesce("t_kind", "kind").alias("kind"),
    )


def _share() -> Column:
    """The oxygen an anion written as an element replaces: half for a halogen, one for a chalcogen."""
    return F.when(F.col("element").isin(*HALOGENS), 0.5).otherwise(1.0)


def _is_anion() -> Column:
    return F.col("kind") == "element-anion"


def _has_oxide() -> Column:
    return F.max(F.when(F.col("kind") == "oxide", 1).otherwise(0)).over(by_sample()) == 1


def _per_mole(water_oh: bool) -> Column:
    """Anions one formula unit of a constituent brings."""
    return (
        F.when(F.col("kind").isin("oxide", "other"), F.col("n_o"))
        .when(_is_anion(), F.col("n_cat"))
        .when(F.col("kind") == "water", 2.0 if water_oh else 1.0)
        .otherwise(0.0)
    )


def _counted(basis: Basis, raw_anions: bool, water_oh: bool) -> Column:
    """What one mole of a constituent adds to the total the basis fixes."""
    if basis.kind == "O":
        net = F.when(_is_anion() & F.col("has_oxide"), F.col("n_cat") * (1.0 - _share())).otherwise(_per_mole(water_oh))
        return _per_mole(water_oh) if raw_anions else net
    if basis.kind == "cations":
        return F.when((F.col("element") != "H") & ~_is_anion(), F.col("n_cat")).otherwise(0.0)
    if basis.kind == "element":
        return F.when(F.col("element").isin(*basis.elements), F.col("n_cat")).otherwise(0.0)
    raise ValueError(f"unknown basis {basis.kind!r}")


def oxygen_equivalent(mean: Column) -> Column:
    """Weight of the oxygen that a halogen or chalcogen of this weight replaces."""
    weights = F.create_map(*[F.lit(x) for e in (*HALOGENS, *CHALCOGENS) for x in (e, ATOMIC_WEIGHTS[e])])
    return F.when(
        _is_anion() & F.col("has_oxide") & F.col("element").isin(*HALOGENS, *CHALCOGENS),
        mean * O_WEIGHT / weights[F.col("element")] * _share(),
    ).otherwise(0.0)


def normalise(rows: DataFrame, basis: Basis, raw_anions: bool = False, water_oh: bool = False) -> DataFrame:
    """Atoms per formula unit of every constituent on a basis.

    Adds mol, cations, anions, factor, apfu, o_apfu, charge (of the sample), corr and total. On an anion
    basis the oxides' oxygen is reported net of what halogens and chalcogens replace, unless `raw_anions`.
    With `water_oh` every water stands for two hydroxyls.
    """
    base = (
        rows.withColumn("has_oxide", _has_oxide())
        .withColumn("mol", F.when(F.col("mw") != 0, F.col("mean") / F.col("mw")).otherwise(0.0))
        .withColumn("cations", F.col("mol") * F.col("n_cat"))
        .withColumn("anions", F.col("mol") * _per_mole(water_oh))
        .withColumn("_total", F.sum(F.col("mol") * _counted(basis, raw_anions, water_oh)).over(by_sample()))
        .withColumn("factor", F.when(F.col("_total") != 0, F.lit(basis.n) / F.col("_total")).otherwise(0.0))
        .withColumn("apfu", F.col("cations") * F.col("factor"))
        .withColumn("o_apfu", F.col("anions") * F.col("factor"))
    )
    oxide = F.col("kind").isin("oxide", "other")
    if basis.kind == "O" and not raw_anions:
        base = (
            base.withColumn("_hal", F.sum(F.when(_is_anion(), F.col("o_apfu") * _share()).otherwise(0.0)).over(by_sample()))
            .withColumn("_ox", F.sum(F.when(oxide, F.col("o_apfu")).otherwise(0.0)).over(by_sample()))
            .withColumn(
                "o_apfu",
                F.when(oxide & F.col("has_oxide") & (F.col("_ox") != 0) & (F.col("_hal") != 0),
                       F.col("o_apfu") * (F.col("_ox") - F.col("_hal")) / F.col("_ox")).otherwise(F.col("o_apfu")),
            )
            .drop("_hal", "_ox")
        )
    balance = F.when(F.col("kind") != "element", F.col("apfu") * F.col("charge")).otherwise(0.0) - F.when(
        F.col("kind").isin("oxide", "other", "water"), 2.0 * F.col("o_apfu")
    ).otherwise(0.0)
    return (
        base.withColumn("sample_charge", F.sum(balance).over(by_sample()))
        .withColumn("corr", F.sum(oxygen_equivalent(F.col("mean"))).over(by_sample()))
        .withColumn("total", F.sum("mean").over(by_sample()) - F.col("corr"))
        .drop("_total", "has_oxide")
    )


def add_unmeasured(rows: DataFrame, basis: Basis, adds: Sequence[Added], raw_anions: bool = False, water_oh: bool = False) -> DataFrame:
    """Rows for unmeasured constituents, at the fixed point of the normalisation they depend on.

    A structure constituent of apfu ``a`` weighs ``a·mw/(n_cat·f)``; the one by difference weighs what is
    lacking to 100. The factor ``f`` obeys ``f·(T0 + tD·D) = N − C`` with T0 the measured total, C what the
    structure constituents count for and tD what a gram of the difference counts for; D is linear in ``1/f``.
    """
    if not adds:
        return rows
    if sum(a.mode == "difference" for a in adds) > 1:
        raise ValueError("only one constituent can be taken by difference")
    unknown = [a.mode for a in adds if a.mode not in ("wt", "difference", "structure")]
    if unknown:
        raise ValueError(f"unknown mode {unknown[0]!r}")
    items = F.array(*[
        F.struct(
            F.lit(a.formula).alias("constituent"), F.lit(a.element).alias("element"), F.lit(a.n_cat).alias("n_cat"), F.lit(a.n_o).alias("n_o"),
            F.lit(float(a.charge)).alias("charge"), F.lit(float(a.mw)).alias("mw"), F.lit(a.kind).alias("kind"), F.lit(a.mode).alias("mode"), F.lit(float(a.value)).alias("value"),
        ) for a in adds
    ])
    zero = F.lit(0.0)
    extra = rows.select("sample_id").distinct().select("sample_id", F.explode(items).alias("x")).select(
        "sample_id", F.col("x.constituent").alias("constituent"),
        F.when(F.col("x.mode") == "wt", F.col("x.value")).otherwise(zero).alias("mean"), zero.alias("sd"),
        F.when(F.col("x.mode") == "wt", F.col("x.value")).otherwise(zero).alias("lo"),
        F.when(F.col("x.mode") == "wt", F.col("x.value")).otherwise(zero).alias("hi"), F.lit(0).cast("bigint").alias("n"),
        *[F.col(f"x.{c}").alias(c) for c in ("element", "n_cat", "n_o", "charge", "mw", "kind")],
        F.col("x.mode").alias("source"), F.col("x.value").alias("want"),
    )
    measured = rows.withColumn("source", F.lit("measured")).withColumn("want", F.lit(None).cast("double"))
    names = extra.columns
    both = measured.join(extra.select("sample_id", "constituent"), ["sample_id", "constituent"], "left_anti").select(*names).unionByName(extra)
    both = both.withColumn("charge", F.col("charge").cast("double")).withColumn("has_oxide", _has_oxide())
    unit = _counted(basis, raw_anions, water_oh)
    known = F.col("source").isin("measured", "wt")
    structure = F.col("source") == "structure"
    difference = F.col("source") == "difference"

    def total(value: Column) -> Column:
        return F.sum(value).over(by_sample())

    def when(test: Column, value: Column) -> Column:
        return F.when(test, value).otherwise(0.0)

    units = F.col("want") / F.col("n_cat")  # formula units of a structure constituent per formula
    solved = (
        both.withColumn("_t0", total(when(known, F.col("mean") / F.col("mw") * unit)))
        .withColumn("_c", total(when(structure, units * unit)))
        .withColumn("_td", total(when(difference, unit / F.col("mw"))))
        .withColumn("_w0", total(when(known, F.col("mean"))))
        .withColumn("_e0", total(when(known, oxygen_equivalent(F.col("mean")))))
        .withColumn("_q", total(when(structure, units * F.col("mw") - oxygen_equivalent(units * F.col("mw")))))
        .withColumn("_ed", total(when(difference, oxygen_equivalent(F.lit(1.0)))))
        .withColumn("_m", F.lit(basis.n) - F.col("_c"))
        .withColumn("_k", 100.0 - F.col("_w0") + F.col("_e0"))
        .withColumn(
            "_d",
            F.greatest(F.lit(0.0), (F.col("_k") - F.col("_q") * F.col("_t0") / F.col("_m")) / (1.0 - F.col("_ed") + F.col("_q") * F.col("_td") / F.col("_m"))),
        )
        .withColumn("_d", when(total(when(difference, F.lit(1.0))) > 0, F.col("_d")))
        .withColumn("_f", F.col("_m") / F.nullif(F.col("_t0") + F.col("_td") * F.col("_d"), F.lit(0.0)))
    )
    mean = (
        F.when(structure, F.when(F.col("_f") > 0, units * F.col("mw") / F.col("_f")).otherwise(0.0))
        .when(difference, F.col("_d"))
        .otherwise(F.col("mean"))
    )
    filled = structure | difference
    return (
        solved.withColumn("_mean", mean)
        .withColumn("mean", F.col("_mean"))
        .withColumn("lo", F.when(filled, F.col("_mean")).otherwise(F.col("lo")))
        .withColumn("hi", F.when(filled, F.col("_mean")).otherwise(F.col("hi")))
        .select(*names[:-1])
    )


def hydrogen_balance(reduced: DataFrame, anions: float) -> DataFrame:
    """Hydrogen a cation-basis formula lacks against the structure's anion total, and the water that is.

    `reduced`: output of `normalise` on a cation or element basis, without H2O.
    """
    halogen = F.sum(F.when(_is_anion() & F.col("element").isin(*HALOGENS), F.col("apfu")).otherwise(0.0))
    plus = F.sum(F.when(F.col("kind").isin("oxide", "other", "element"), F.col("apfu") * F.col("charge")).otherwise(0.0))
    minus = F.sum(F.when(_is_anion(), F.col("apfu") * F.col("charge")).otherwise(0.0))
    sums = reduced.where("kind <> 'water'").groupBy("sample_id").agg(
        F.max("factor").alias("factor"), halogen.alias("x"), plus.alias("p"), minus.alias("m")
    )
    h = F.greatest(F.lit(0.0), 2.0 * (F.lit(anions) - F.col("x")) + F.col("x") - F.col("p"))
    water = 2 * ATOMIC_WEIGHTS["H"] + O_WEIGHT
    return sums.withColumn("h_apfu", h).select(
        "sample_id",
        "factor",
        "h_apfu",
        F.when(F.col("factor") != 0, F.col("h_apfu") / 2 * water / F.col("factor")).otherwise(0.0).alias("h2o_wt"),
        (F.col("p") + F.col("h_apfu") + F.col("m") - 2.0 * (F.lit(anions) - F.col("x"))).alias("charge"),
    )


def iron_balance(reduced: DataFrame, anions: float) -> DataFrame:
    """The share of ferric iron that closes the charge, all iron being analysed as one constituent.

    On a cation or element basis oxidation leaves the cation counts alone, so each Fe³⁺ adds exactly one.
    """
    fe = F.col("element") == "Fe"
    halogen = F.sum(F.when(_is_anion() & F.col("element").isin(*HALOGENS), F.col("apfu")).otherwise(0.0))
    plus = F.sum(
        F.when(fe & (F.col("kind") != "element-anion"), 2.0 * F.col("apfu"))
        .when(F.col("kind").isin("oxide", "other", "element", "water"), F.col("apfu") * F.col("charge"))
        .otherwise(0.0)
    )
    as_feo = F.sum(F.when(fe, F.col("mean") * (71.844 / (F.col("mw") / F.col("n_cat")))).otherwise(0.0))
    sums = reduced.groupBy("sample_id").agg(
        halogen.alias("x"), plus.alias("p"), F.sum(F.when(fe, F.col("apfu")).otherwise(0.0)).alias("fe"), as_feo.alias("feo")
    ).where("fe > 0")
    start = F.col("p") - (2.0 * (F.lit(anions) - F.col("x")) + F.col("x"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.col("c0") / F.col("fe")))
    return sums.withColumn("c0", start).withColumn("ferric", share).select(
        "sample_id",
        "ferric",
        (F.col("fe") * (1 - F.col("ferric"))).alias("fe2_apfu"),
        (F.col("fe") * F.col("ferric")).alias("fe3_apfu"),
        (F.col("feo") * (1 - F.col("ferric"))).alias("feo_wt"),
        (F.col("feo") * F.col("ferric") * (159.687 / (2 * 71.844))).alias("fe2o3_wt"),
        (F.col("c0") + F.col("ferric") * F.col("fe")).alias("charge"),
    )


def _trim_number(value: Column, digits: int) -> Column:
    return F.regexp_replace(F.format_string(f"%.{digits}f", value), r"\.?0+$", "")


def empirical_formula(reduced: DataFrame, order: str = "constituent", digits: int = 2) -> DataFrame:
    """``sample_id, formula``: cations in order, then O, the halogens, and the water after a dot."""
    cation = ~F.col("kind").isin("water", "element-anion")
    number = _trim_number(F.col("apfu"), digits)
    plain = F.concat(F.col("element"), F.when(number == "1", "").otherwise(number))
    anion = F.concat(F.col("element"), number)
    # the lists below hold one item per constituent of the sample
    parts = reduced.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.when(cation, F.struct(F.col(order).alias("o"), plain.alias("t"))))).alias("c"),
        F.array_sort(F.collect_list(F.when(_is_anion(), F.struct(F.col(order).alias("o"), anion.alias("t"))))).alias("a"),
        F.sum(F.when(F.col("kind").isin("oxide", "other"), F.col("o_apfu")).otherwise(0.0)).alias("o"),
        F.sum(F.when(F.col("kind") == "water", F.col("apfu") / 2).otherwise(0.0)).alias("w"),
    )
    return parts.select(
        "sample_id",
        F.concat(
            F.concat_ws("", F.col("c.t")),
            F.when(F.col("o") != 0, F.concat(F.lit("O"), _trim_number(F.col("o"), digits))).otherwise(""),
            F.concat_ws("", F.col("a.t")),
            F.when(F.col("w") != 0, F.concat(F.lit("·"), _trim_number(F.col("w"), digits), F.lit("H2O"))).otherwise(""),
        ).alias("formula"),
    )


def published_table(reduced: DataFrame, ideal: DataFrame | None = None) -> DataFrame:
    """Constituent, mean, range, deviation, normalised and ideal columns; range and deviation need two points."""
    rows = reduced.select(
        "sample_id",
        "constituent",
        F.round("mean", 2).alias("mean"),
        F.when(F.col("n") >= 2, F.round("lo", 2)).alias("lo"),
        F.when(F.col("n") >= 2, F.round("hi", 2)).alias("hi"),
        F.when(F.col("n") >= 2, F.round("sd", 2)).alias("sd"),
        F.when(F.col("total") != 0, F.round(F.col("mean") / F.col("total") * 100, 2)).alias("normalised"),
    )
    if ideal is None:
        return rows
    return rows.join(ideal.select("sample_id", "constituent", F.round("wt", 2).alias("ideal")), ["sample_id", "constituent"], "left")


def ideal_weight_percent(apfu: DataFrame, constituents: DataFrame) -> DataFrame:
    """``sample_id, constituent, wt`` of an ideal formula given as apfu per constituent.

    Water counts by the molecule. The oxygen halogens stand for is deducted as ``O=F,Cl``, never more than
    the oxides carry.
    """
    rows = apfu.join(constituents.withColumnRenamed("formula", "constituent"), "constituent")
    molecules = F.when(F.col("kind") == "water", F.col("apfu")).otherwise(F.col("apfu") / F.col("n_cat"))
    rows = rows.withColumn("mass", molecules * F.col("mw"))
    rows = rows.withColumn("_hal", F.sum(F.when(_is_anion() & F.col("element").isin(*HALOGENS), F.col("apfu") * O_WEIGHT / 2).otherwise(0.0)).over(by_sample()))
    rows = rows.withColumn(
        "_ox", F.sum(F.when(F.col("kind").isin("oxide", "other"), molecules * F.col("n_o") * O_WEIGHT).otherwise(0.0)).over(by_sample())
    )
    rows = rows.withColumn("_corr", F.least("_hal", "_ox"))
    rows = rows.withColumn("_sum", F.sum("mass").over(by_sample()) - F.col("_corr"))
    wt = rows.select("sample_id", "constituent", (F.col("mass") / F.col("_sum") * 100).alias("wt"))
    correction = rows.where("_corr > 0").select("sample_id", F.lit("O=F,Cl").alias("constituent"), (-F.col("_corr") / F.col("_sum") * 100).alias("wt")).distinct()
    return wt.unionByName(correction)


def elements_to_constituents(apfu: DataFrame) -> DataFrame:
    """Apfu by element as apfu by usual constituent: oxygen is implied, two hydrogens make a water."""
    usual = usual_oxides(apfu.sparkSession)
    named = apfu.where("element <> 'O'").join(usual, "element", "left")
    amount = F.when(F.col("element") == "H", F.col("apfu") / 2).otherwise(F.col("apfu"))
    return named.groupBy("sample_id", F.coalesce("formula", "element").alias("constituent")).agg(F.sum(amount).alias("apfu"))


def formula_mass(elements: DataFrame, key: str = "entry_id") -> DataFrame:
    """``key, mass`` from element counts; a formula with an unknown element has none."""
    weights = atomic_weights(elements.sparkSession)
    return (
        elements.join(weights, "element", "left")
        .groupBy(key)
        .agg(F.sum(F.col("n") * F.col("weight")).alias("mass"), F.bool_and(F.col("weight").isNotNull()).alias("known"))
        .where("known AND mass > 0")
        .drop("known")
    )


def ideal_density(mass: Column, z: Column, volume: Column) -> Column:
    """Density in g/cm³ of `z` formula units of mass `mass` in a cell of `volume` Å³."""
    return z * mass / (volume * 0.602214)


def compatibility_category(index: Column) -> Column:
    size = F.abs(index)
    return (
        F.when(size < 0.02, "superior").when(size < 0.04, "excellent").when(size < 0.06, "good").when(size < 0.08, "fair").otherwise("poor")
    )


def compatibility_index(weights: DataFrame, optics: DataFrame, constants: DataFrame) -> DataFrame:
    """``1 − K_P/K_C`` from wt% and refractive constants, mean index and density, with its category.

    `weights`: sample_id, constituent, wt; `optics`: sample_id, n_mean, density; `constants`: constituent, k.
    Constituents without a constant add nothing and are named.
    """
    rows = weights.where("NOT startswith(constituent, 'O=')").join(constants.select("constituent", "k"), "constituent", "left")
    chemical = rows.groupBy("sample_id").agg(
        F.sum((F.coalesce("k", F.lit(0.0)) * F.col("wt") / 100).cast("decimal(28,12)")).cast("double").alias("kc"),  # the order of the rows does not matter
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("k").isNull(), F.col("constituent"))))).alias("missing"),
    )
    return (
        chemical.join(optics, "sample_id")
        .withColumn("kp", (F.col("n_mean") - 1) / F.col("density"))
        .withColumn("ci", F.when(F.col("kc") != 0, 1 - F.col("kp") / F.col("kc")))
        .select("sample_id", "kc", "kp", "ci", compatibility_category(F.col("ci")).alias("category"), "missing")
    )


# --- which basis did the authors use? ----------------------------------------------------------

_NOT_CATIONS = ("H", "O", "F", "Cl", "Br", "I", "S", "Se", "Te")
CALCULATED_ELEMENTS = ("H", "Li", "B", "Be", "C", "N")  # fixed value: what a probe does not give


def basis_candidates(published: DataFrame) -> DataFrame:
    """``sample_id, turn, kind, element, n``: the bases a published formula may have used.

    `published`: sample_id, element, n. Anion totals with and without water and fluorine, the cation total
    where it is nearly whole, every element nearly whole from 0.9 up, and sulfur beside oxygen.
    """
    def of(*names: str) -> Column:
        return F.sum(F.when(F.col("element").isin(*names), F.col("n")).otherwise(0.0))

    cation = ~F.col("element").isin(*_NOT_CATIONS)
    sums = published.groupBy("sample_id").agg(
        of("O", "F", "Cl").alias("anions"), (of("H") / 2).alias("water"), of("F").alias("f"), of("O").alias("o"), of("S").alias("s"),
        of(*CHALCOGENS).alias("chalc"), F.sum(F.when(cation, F.col("n")).otherwise(0.0)).alias("cations"),
        F.concat_ws("+", F.array_sort(F.collect_set(F.when(F.col("element").isin(*CHALCOGENS) & (F.col("n") > 0), F.col("element"))))).alias("chalc_names"),
    )
    rounded = [F.col("anions"), F.col("anions") - F.col("water"), F.col("anions") - F.col("water") - F.col("f")]
    totals = F.array_sort(F.array_distinct(F.transform(F.array(*rounded), lambda x: -F.bround(x))))
    oxygen = sums.select("sample_id", F.posexplode(totals).alias("turn", "m")).where("m < 0").select(
        "sample_id", "turn", F.lit("O").alias("kind"), F.lit("").alias("element"), (-F.col("m")).alias("n")
    )
    whole = sums.where("cations > 0 AND round(abs(cations - bround(cations)), 9) < 0.08").select(
        "sample_id", F.lit(10).alias("turn"), F.lit("cations").alias("kind"), F.lit("").alias("element"), F.bround("cations").alias("n")
    )
    sulfide = sums.where("chalc >= 0.9 AND o = 0").select(
        "sample_id", F.lit(11).alias("turn"), F.lit("element").alias("kind"), F.col("chalc_names").alias("element"), F.bround("chalc").alias("n")
    )
    single = published.where(cation & (F.col("n") >= 0.9) & (F.round(F.abs(F.col("n") - F.bround("n")), 9) < 0.06)).select(
        "sample_id", F.lit(20).alias("turn"), F.lit("element").alias("kind"), "element", F.bround("n").alias("n")
    )
    sulfate = sums.where("s >= 0.9 AND o > 0").select(
        "sample_id", F.lit(30).alias("turn"), F.lit("element").alias("kind"), F.lit("S").alias("element"), F.bround("s").alias("n")
    )
    return oxygen.unionByName(whole).unionByName(sulfide).unionByName(single).unionByName(sulfate)


def replicate_formula(rows: DataFrame, published: DataFrame, water_oh: bool = False) -> DataFrame:
    """The basis on which the weights give the published coefficients best.

    `rows`: statistics with constituents. The misfit on a basis of factor f is rms(f·c/p − 1) over the
    major elements; the mean and variance of c/p give it for every f, so samples are never multiplied by
    bases and elements at once. Misfits equal to a millionth are equal, and the earlier candidate wins. ``const_factor`` is set when all coefficients are off by one
    factor, which means another basis than those tried.
    """
    base = rows.withColumn("has_oxide", _has_oxide()).withColumn("mol", F.when(F.col("mw") != 0, F.col("mean") / F.col("mw")).otherwise(0.0))
    anions = _counted(Basis("O", 1.0), False, water_oh)
    cations = _counted(Basis("cations", 1.0), False, water_oh)
    atoms = base.groupBy("sample_id", "element").agg(
        F.sum(F.col("mol") * F.col("n_cat")).alias("atoms"), F.sum(F.col("mol") * anions).alias("t_o"), F.sum(F.col("mol") * cations).alias("t_c")
    )
    totals = atoms.groupBy("sample_id").agg(F.sum("t_o").alias("t_o"), F.sum("t_c").alias("t_c"))
    compared = published.where("element NOT IN ('H', 'O') AND n >= 0.05").join(atoms.select("sample_id", "element", "atoms"), ["sample_id", "element"])
    compared = compared.withColumn("n_major", F.count_if(F.col("n") >= 0.1).over(by_sample())).where("n >= 0.1 OR n_major < 2")
    q = F.col("atoms") / F.col("n")
    fits = compared.groupBy("sample_id").agg(F.var_pop(q).alias("spread"), F.avg(q).alias("middle"))
    bases = basis_candidates(published).join(fits, "sample_id").join(totals, "sample_id")
    named = (
        bases.where("kind = 'element'")
        .select("sample_id", "turn", "element", F.explode(F.split("element", r"\+")).alias("one"))
        .join(atoms.select("sample_id", F.col("element").alias("one"), "atoms"), ["sample_id", "one"])
        .groupBy("sample_id", "turn", "element")
        .agg(F.sum("atoms").alias("t_e"))
    )
    tried = bases.join(named, ["sample_id", "turn", "element"], "left")
    total = F.when(F.col("kind") == "O", F.col("t_o")).when(F.col("kind") == "cations", F.col("t_c")).otherwise(F.col("t_e"))
    tried = tried.withColumn("factor", F.col("n") / F.nullif(total, F.lit(0.0))).where("factor IS NOT NULL")
    score = F.sqrt(F.pow(F.col("factor"), 2) * F.col("spread") + F.pow(F.col("factor") * F.col("middle") - 1, 2))
    tried = tried.withColumn("score", score)
    best = tried.groupBy("sample_id").agg(
        F.min_by(F.struct("kind", "element", "n", "factor", "score"), F.struct(F.round("score", 6), "turn", "element")).alias("b")
    ).select("sample_id", "b.*")
    ratios = (
        published.where("element NOT IN ('H', 'O', 'F', 'Cl') AND n >= 0.2").withColumnRenamed("n", "want")
        .join(atoms.where("atoms > 0").select("sample_id", "element", "atoms"), ["sample_id", "element"])
        .join(best.select("sample_id", "factor"), "sample_id")
        .withColumn("ratio", F.col("atoms") * F.col("factor") / F.col("want"))
        .groupBy("sample_id")
        .agg(
            F.expr("-percentile_disc(0.5) WITHIN GROUP (ORDER BY -ratio)").alias("med"), F.min("ratio").alias("low"), F.max("ratio").alias("high"), F.count(F.lit(1)).alias("m"),
        )
    )
    constant = (F.col("m") >= 2) & (F.abs(F.col("med") - 1) > 0.02) & (F.abs(F.col("low") / F.col("med") - 1) <= 0.02) & (F.abs(F.col("high") / F.col("med") - 1) <= 0.02)
    return best.join(ratios, "sample_id", "left").select(
        "sample_id", "kind", "element", "n", "factor", "score", F.when(constant, F.col("med")).alias("const_factor")
    )


def formula_differences(rows: DataFrame, published: DataFrame, best: DataFrame, tol_abs: float = 0.02, tol_rel: float = 0.02) -> DataFrame:
    """Published coefficients the weights do not give on the best basis, and elements they lack.

    ``state``: ``differs``, ``not analysed`` (an element a probe cannot give) or ``not in the list``.
    """
    atoms = rows.withColumn("mol", F.when(F.col("mw") != 0, F.col("mean") / F.col("mw")).otherwise(0.0)).groupBy("sample_id", "element").agg(
        F.sum(F.col("mol") * F.col("n_cat")).alias("atoms")
    )
    ammonium = published.groupBy("sample_id").agg(F.sum(F.when(F.col("element") == "N", F.col("n")).otherwise(0.0)).alias("n4"))
    joined = (
        published.where("element <> 'O'").join(best.select("sample_id", "factor", "const_factor"), "sample_id").join(ammonium, "sample_id")
        .join(atoms, ["sample_id", "element"], "left")
        .withColumn("published", F.when(F.col("element") == "H", F.col("n") - 4 * F.col("n4")).otherwise(F.col("n")))
        .withColumn("replicated", F.col("atoms") * F.col("factor") / F.coalesce("const_factor", F.lit(1.0)))
    )
    off = F.abs(F.col("replicated") - F.col("published")) > F.greatest(F.lit(tol_abs), F.lit(tol_rel) * F.col("published"))
    state = (
        F.when(F.col("atoms").isNull() & (F.col("published") >= 0.05), F.when(F.col("element").isin(*CALCULATED_ELEMENTS), "not analysed").otherwise("not in the list"))
        .when(F.col("atoms").isNotNull() & off, "differs")
    )
    return joined.withColumn("state", state).where("state IS NOT NULL").select("sample_id", "element", "published", "replicated", "state")


def basis_sensitivity(reduced: DataFrame) -> DataFrame:
    """Factor and charge on the standard alternatives to a basis: whole anions, whole cations, each major cation.

    Every alternative rescales the same sums, so none is reduced again. ``sample_id, kind, element, n, factor, charge``.
    """
    cation = ~F.col("kind").isin("water", "element-anion")
    sums = reduced.groupBy("sample_id").agg(
        F.sum("o_apfu").alias("o_tot"),
        F.sum(F.when(cation & (F.col("apfu") > 0), F.col("apfu")).otherwise(0.0)).alias("cat_tot"),
        F.sum(F.when((F.col("element") != "H") & ~_is_anion(), F.col("cations")).otherwise(0.0)).alias("t_c"),
        F.sum(F.when(F.col("kind") != "element", F.col("cations") * F.col("charge")).otherwise(0.0)).alias("plus"),
        F.sum(F.when(F.col("kind").isin("oxide", "other", "water"), F.col("anions")).otherwise(0.0)).alias("ox"),
        F.sum("anions").alias("an"),
        F.sum(F.when(_is_anion(), F.col("anions") * _share()).otherwise(0.0)).alias("lost"),
        F.max(F.when(F.col("kind") == "oxide", 1).otherwise(0)).alias("has_oxide"),
    ).withColumn("lost", F.col("lost") * F.col("has_oxide"))
    oxygen = sums.where("o_tot > 0.5").select(
        "sample_id", F.lit("O").alias("kind"), F.lit("").alias("element"), F.bround("o_tot").alias("n"),
        (F.bround("o_tot") / (F.col("an") - F.col("lost"))).alias("factor"), (F.col("plus") - 2 * (F.col("ox") - F.col("lost"))).alias("unit"),
    )
    whole = sums.where("cat_tot > 0.5").select(
        "sample_id", F.lit("cations").alias("kind"), F.lit("").alias("element"), F.bround("cat_tot").alias("n"),
        (F.bround("cat_tot") / F.col("t_c")).alias("factor"), (F.col("plus") - 2 * F.col("ox")).alias("unit"),
    )
    per_element = reduced.where("cations > 0").groupBy("sample_id", "element").agg(
        F.sum("cations").alias("t_e"), F.max(F.when(cation & (F.col("apfu") >= 0.5), F.col("apfu"))).alias("apfu")
    ).where("apfu IS NOT NULL")
    single = per_element.join(sums.select("sample_id", "plus", "ox"), "sample_id").select(
        "sample_id", F.lit("element").alias("kind"), "element", F.greatest(F.lit(1.0), F.bround("apfu")).alias("n"),
        (F.greatest(F.lit(1.0), F.bround("apfu")) / F.col("t_e")).alias("factor"), (F.col("plus") - 2 * F.col("ox")).alias("unit"),
    )
    return oxygen.unionByName(whole).unionByName(single).withColumn("charge", F.col("unit") * F.col("factor")).drop("unit")
