"""Elements and constituents: fixed values, and formula parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Standard atomic weights (IUPAC 2013, abridged), in order of atomic number.
ATOMIC_WEIGHTS = {
    "H": 1.008, "He": 4.0026, "Li": 6.94, "Be": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999,
    "F": 18.998, "Ne": 20.180, "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974,
    "S": 32.06, "Cl": 35.45, "Ar": 39.948, "K": 39.098, "Ca": 40.078, "Sc": 44.956, "Ti": 47.867,
    "V": 50.942, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546,
    "Zn": 65.38, "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904, "Kr": 83.798,
    "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224, "Nb": 92.906, "Mo": 95.95, "Tc": 98.0,
    "Ru": 101.07, "Rh": 102.91, "Pd": 106.42, "Ag": 107.87, "Cd": 112.41, "In": 114.82, "Sn": 118.71,
    "Sb": 121.76, "Te": 127.60, "I": 126.90, "Xe": 131.29, "Cs": 132.91, "Ba": 137.33, "La": 138.91,
    "Ce": 140.12, "Pr": 140.91, "Nd": 144.24, "Pm": 145.0, "Sm": 150.36, "Eu": 151.96, "Gd": 157.25,
    "Tb": 158.93, "Dy": 162.50, "Ho": 164.93, "Er": 167.26, "Tm": 168.93, "Yb": 173.05, "Lu": 174.97,
    "Hf": 178.49, "Ta": 180.95, "W": 183.84, "Re": 186.21, "Os": 190.23, "Ir": 192.22, "Pt": 195.08,
    "Au": 196.97, "Hg": 200.59, "Tl": 204.38, "Pb": 207.2, "Bi": 208.98, "Po": 209.0, "Th": 232.04,
    "Pa": 231.04, "U": 238.03, "Np": 237.0, "Pu": 244.0,
}
ANION_CHARGES = {"F": -1, "Cl": -1, "Br": -1, "I": -1, "S": -2, "Se": -2, "Te": -2, "O": -2}
HALOGENS = ("F", "Cl", "Br", "I")
CHALCOGENS = ("S", "Se", "Te")

# The constituent an element is reported as.
USUAL_OXIDE = {
    "H": "H2O", "Li": "Li2O", "Na": "Na2O", "K": "K2O", "Rb": "Rb2O", "Cs": "Cs2O", "Tl": "Tl2O", "Ag": "Ag2O",
    "Be": "BeO", "Mg": "MgO", "Ca": "CaO", "Sr": "SrO", "Ba": "BaO", "Mn": "MnO", "Fe": "FeO", "Co": "CoO",
    "Ni": "NiO", "Cu": "CuO", "Zn": "ZnO", "Cd": "CdO", "Hg": "HgO", "Pb": "PbO", "B": "B2O3", "Al": "Al2O3",
    "Cr": "Cr2O3", "Ga": "Ga2O3", "Bi": "Bi2O3", "Y": "Y2O3", "La": "La2O3", "Ce": "Ce2O3", "Nd": "Nd2O3",
    "Sb": "Sb2O3", "Si": "SiO2", "Ti": "TiO2", "Zr": "ZrO2", "Sn": "SnO2", "Ge": "GeO2", "Te": "TeO2", "Se": "SeO2",
    "C": "CO2", "P": "P2O5", "As": "As2O5", "V": "V2O5", "Nb": "Nb2O5", "Ta": "Ta2O5", "S": "SO3", "Cr6": "CrO3",
    "Mo": "MoO3", "W": "WO3", "U": "UO3", "Th": "ThO2", "F": "F", "Cl": "Cl", "Br": "Br",
}

_VALENCE = r"(?<=[A-Za-z])\d[+−]|(?<=[A-Za-z])\d-(?![\dx])"
_ATOM = r"([A-Z][a-z]?)\s*(\d+(?:\.\d+)?)?"


def without_valence(formula: Column) -> Column:
    """The formula without valence superscripts: ``Fe3+2O3`` reads ``Fe2O3``, a range ``Ca1-2`` stays."""
    return F.regexp_replace(formula, _VALENCE, "")


def element_counts(formula: Column) -> Column:
    """``array<struct<element, count>>`` of a flat formula, one item per symbol written; no number counts one."""
    text = without_valence(F.coalesce(formula, F.lit("")))
    symbols = F.regexp_extract_all(text, F.lit(_ATOM), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(_ATOM), F.lit(2))
    return F.zip_with(
        symbols,
        numbers,
        lambda s, n: F.struct(s.alias("element"), F.when(n == "", 1.0).otherwise(n.cast("double")).alias("n")),
    )


def explode_elements(rows: DataFrame, formula: str, keys: list[str]) -> DataFrame:
    """``keys, element, n`` with repeated symbols of a formula added up."""
    return (
        rows.select(*keys, F.explode(element_counts(F.col(formula))).alias("e"))
        .groupBy(*keys, F.col("e.element").alias("element"))
        .agg(F.sum("e.n").alias("n"))
    )


def element_set(formula: Column) -> Column:
    return F.array_distinct(F.transform(element_counts(formula), lambda e: e["element"]))


def atomic_weights(spark: SparkSession) -> DataFrame:
    """``element, weight``: a fixed table, small by construction."""
    return spark.createDataFrame(list(ATOMIC_WEIGHTS.items()), "element string, weight double")


def usual_oxides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(USUAL_OXIDE.items()), "element string, formula string")


def constituent_dimension(formulas: DataFrame, column: str = "formula") -> DataFrame:
    """``formula, element, n_cat, n_o, charge, mw, kind`` of distinct constituent formulas.

    A qualifier in brackets and ``*`` are dropped and a zero typed for the oxygen is read as one. A
    formula with an unknown element, or with characters no symbol covers, gives no row.
    """
    spark = formulas.sparkSession
    tidy = F.regexp_replace(F.regexp_replace(F.translate(F.col(column), "*", ""), r"\([^)]*\)", ""), r"\s+", "")
    tidy = F.regexp_replace(tidy, r"^([A-Z][a-z]?\d?)0(\d)$", "$1O$2")
    base = formulas.select(tidy.alias("formula")).distinct().where(F.col("formula").rlike(r"^(?:[A-Z][a-z]?\d*)+$"))
    atoms = base.select("formula", F.posexplode(element_counts(F.col("formula"))).alias("pos", "e")).select(
        "formula", "pos", F.col("e.element").alias("el"), F.col("e.n").alias("n")
    )
    atoms = atoms.groupBy("formula", "el").agg(F.min("pos").alias("pos"), F.sum("n").alias("n"))
    weighed = atoms.join(atomic_weights(spark), F.col("el") == F.col("element"), "left")
    cation = F.struct("pos", "el", "n")
    whole = weighed.groupBy("formula").agg(
        F.sum(F.col("weight") * F.col("n")).alias("mw"),
        F.bool_and(F.col("weight").isNotNull()).alias("known"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.when(F.col("el") == "O", F.col("n")).otherwise(0.0)).alias("n_o"),
        F.sum(F.when(F.col("el") == "H", F.col("n")).otherwise(0.0)).alias("n_h"),
        F.min(F.when(F.col("el") != "O", cation)).alias("cat"),
        F.min(cation).alias("first"),
    ).where("known")
    water = (F.col("k") == 2) & (F.col("n_h") > 0) & (F.col("n_h") == 2 * F.col("n_o"))
    charges = F.create_map(*[F.lit(x) for p in ANION_CHARGES.items() for x in p])
    head = F.when(F.col("k") == 2, F.coalesce("cat", "first")).otherwise(F.col("first"))
    rows = whole.withColumn("head", head)
    kind = (
        F.when(water, "water")
        .when((F.col("k") == 1) & charges[F.col("head.el")].isNotNull(), "element-anion")
        .when(F.col("k") == 1, "element")
        .when((F.col("k") == 2) & (F.col("n_o") > 0), "oxide")
        .otherwise("other")
    )
    rows = rows.withColumn("kind", kind)
    alone = F.col("kind").isin("element", "element-anion")
    charge = (
        F.when(F.col("kind") == "water", 1.0)
        .when(F.col("kind") == "element-anion", charges[F.col("head.el")].cast("double"))
        .when(F.col("kind") == "element", 0.0)
        .otherwise(2.0 * F.col("n_o") / F.col("head.n"))
    )
    return rows.select(
        "formula",
        F.when(F.col("kind") == "water", "H").otherwise(F.col("head.el")).alias("element"),
        F.when(F.col("kind") == "water", F.col("n_h")).otherwise(F.col("head.n")).cast("int").alias("n_cat"),
        F.when(alone, 0.0).otherwise(F.col("n_o")).cast("int").alias("n_o"),
        charge.alias("charge"),
        "mw",
        "kind",
    )
