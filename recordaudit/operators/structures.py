"""Crystal structures at corpus scale: symmetry, neighbours, bond valences, powder patterns, checks.

Tables: `cells` (structure_id, a, b, c, al, be, ga), `sites` (structure_id, label, element, ox, occ, x, y, z),
`symops` (structure_id, op_no, rot array<array<int>>, tr array<double>). What is gathered into an array below is
bounded by one structure: its operators (192 at most) or the atoms of its cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from recordaudit.functions.cell import cell_volume, d_spacing, inv_d2, metric, metric_length
from recordaudit.functions.elements import ATOMIC_WEIGHTS
from recordaudit.session import cut_lineage

CELL = ("a", "b", "c", "al", "be", "ga")
# How far (Å) a cation's neighbours are looked for; 3.2 otherwise.
CUTOFFS = {
    "K": 3.6, "Rb": 3.7, "Cs": 3.9, "Ba": 3.6, "Sr": 3.4, "Pb": 3.6, "Tl": 3.6, "NH": 3.4, "Bi": 3.4, "Ag": 3.4, "Na": 3.3, "Ca": 3.3, "La": 3.3, "Ce": 3.3,
    "Pr": 3.3, "Nd": 3.3, "Sm": 3.3, "Eu": 3.3, "Gd": 3.3, "Tb": 3.3, "Dy": 3.3, "Ho": 3.3, "Er": 3.3, "Tm": 3.3, "Yb": 3.3, "Lu": 3.3, "Y": 3.3,
    "Hg": 3.4, "Cd": 3.3, "Th": 3.3, "U": 3.3, "H": 2.4,
}
MIN_VALENCE, SHELL_GAP, SHELL_MIN, SHELL_VALENCE = 0.025, 1.35, 3, 0.05  # fixed values of the bond test


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def _cell() -> list[Column]:
    return [F.col(c) for c in CELL]


def by_shuffle(df: DataFrame) -> DataFrame:
    """Marks a side that grows with the structures: the size guessed from its file says little of its arrays, so it is never broadcast."""
    return df.hint("merge")


def _axis(rot: str, tr: str, row: int) -> Column:
    r = F.col(rot)[row]
    return r[0] * F.col("x") + r[1] * F.col("y") + r[2] * F.col("z") + F.col(tr)[row]


def expand_symmetry(sites: DataFrame, symops: DataFrame) -> DataFrame:
    """``structure_id, label, image, x, y, z, mult``: distinct images of every site in the cell.

    Images equal to four decimals (wrapped into the cell) are one; `mult` counts them.
    """
    moved = sites.join(by_shuffle(symops), "structure_id").select(
        "structure_id", "label", "op_no", *[F.pmod(_axis("rot", "tr", k), F.lit(1.0)).alias(n) for k, n in enumerate(("px", "py", "pz"))]
    )
    keys = [F.pmod(F.round(p, 4), F.lit(1.0)).alias(f"k{p}") for p in ("px", "py", "pz")]
    kept = moved.groupBy("structure_id", "label", *keys).agg(F.min_by(F.struct("px", "py", "pz"), "op_no").alias("p"), F.min("op_no").alias("image"))
    return kept.select(
        "structure_id", "label", "image", F.col("p.px").alias("x"), F.col("p.py").alias("y"), F.col("p.pz").alias("z"),
        F.count(F.lit(1)).over(Window.partitionBy("structure_id", "label")).alias("mult"),
    )


def multiplicities(images: DataFrame) -> DataFrame:
    return images.groupBy("structure_id", "label").agg(F.count(F.lit(1)).alias("mult"))


def contacts(centres: DataFrame, images: DataFrame, cells: DataFrame) -> DataFrame:
    """``structure_id, label, other, image, qx, qy, qz, dist``: every image within a centre's cutoff.

    `centres`: structure_id, label, x, y, z, cutoff. An atom can lie within the cutoff only if, along each axis, its
    lattice plane does: the first axis is met by an equi-join on slabs of the cutoff's width, the other two by bounded
    sequences, and only then is a distance formed.
    """
    geo = cells.withColumn("vol", cell_volume(*_cell())).select(
        "structure_id", metric(_cell()).alias("g"),
        (F.col("vol") / (F.col("b") * F.col("c") * F.sin(F.radians("al")))).alias("wx"),
        (F.col("vol") / (F.col("a") * F.col("c") * F.sin(F.radians("be")))).alias("wy"),
        (F.col("vol") / (F.col("a") * F.col("b") * F.sin(F.radians("ga")))).alias("wz"),
    )
    reach = centres.groupBy("structure_id").agg(F.max("cutoff").alias("most"))
    # one epsilon wider than the cutoff, so that rounding never loses a contact; the distance decides
    slab = (F.col("most") + 1e-6) / F.col("wx")
    q = images.join(reach, "structure_id").join(geo.select("structure_id", "wx"), "structure_id").withColumn("slab", slab)
    q = q.withColumn("i", F.explode(F.sequence(F.ceil(-F.col("slab") - F.col("x")), F.floor(1 + F.col("slab") - F.col("x"))))).select(
        "structure_id", F.col("label").alias("other"), "image", (F.col("x") + F.col("i")).alias("qx"), F.col("y").alias("qy0"), F.col("z").alias("qz0"),
        F.floor((F.col("x") + F.col("i")) / F.col("slab")).alias("bin"),
    )
    p = centres.join(reach, "structure_id").join(geo, "structure_id").withColumn("slab", slab)
    p = p.withColumn("own", F.floor(F.col("x") / F.col("slab"))).withColumn("bin", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1)))
    pairs = p.join(q, ["structure_id", "bin"])

    def shifts(axis: str, other: str, width: str) -> Column:
        lim = (F.col("cutoff") + 1e-6) / F.col(width)
        lo, hi = F.ceil(F.col(axis) - F.col(other) - lim), F.floor(F.col(axis) - F.col(other) + lim)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    pairs = pairs.withColumn("j", F.explode(shifts("y", "qy0", "wy"))).withColumn("k", F.explode(shifts("z", "qz0", "wz")))
    pairs = pairs.withColumn("qy", F.col("qy0") + F.col("j")).withColumn("qz", F.col("qz0") + F.col("k"))
    dist = metric_length(F.col("g"), F.col("qx") - F.col("x"), F.col("qy") - F.col("y"), F.col("qz") - F.col("z"))
    return pairs.withColumn("dist", dist).where("dist > 0.3 AND dist <= cutoff").select("structure_id", "label", "other", "image", "qx", "qy", "qz", "dist")


def neighbours(sites: DataFrame, symops: DataFrame, cells: DataFrame, cutoff: float | None = None) -> DataFrame:
    """``structure_id, label, other, dist, n``: neighbours of one atom of each site, distances within 0.0015 Å merged."""
    images = expand_symmetry(sites, symops)
    reach = F.lit(cutoff) if cutoff else F.coalesce(_map(CUTOFFS)[F.col("element")], F.lit(3.2))
    centres = sites.withColumn("cutoff", reach).groupBy("structure_id", "label").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.min("z").alias("z"), F.max("cutoff").alias("cutoff")
    )
    found = contacts(centres, images, cells)
    of = Window.partitionBy("structure_id", "label", "other").orderBy("dist")
    step = F.when(F.col("dist") - F.lag("dist").over(of) < 0.0015, 0).otherwise(1)
    return (
        found.withColumn("_s", step).withColumn("_p", F.sum("_s").over(of.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("structure_id", "label", "other", "_p").agg(F.min("dist").alias("dist"), F.count(F.lit(1)).alias("n")).drop("_p")
    )


# --- bond valence -------------------------------------------------------------------------------


def best_parameters(params: DataFrame, preferred: list[str]) -> DataFrame:
    """One (r0, b) per pair of ions: the preferred references in order, then any. `params`: cation, cation_ox, anion,
    anion_ox, r0, b, ref, line_no."""
    rank = F.coalesce(_map({r: k for k, r in enumerate(preferred)})[F.col("ref")], F.lit(len(preferred)))
    return params.groupBy("cation", "cation_ox", "anion", "anion_ox").agg(
        F.min_by(F.struct("r0", "b", "ref"), F.struct(rank, F.col("line_no"))).alias("p")
    ).select("cation", "cation_ox", "anion", "anion_ox", "p.r0", "p.b", "p.ref")


def bond_valences(near: DataFrame, species: DataFrame, params: DataFrame, explicit: bool = False) -> DataFrame:
    """``structure_id, label, other, dist, n, s, s_max, an_occ``: valence of every cation–anion bond.

    `species`: structure_id, label, element, ox, occ (a mixed site has several rows). Weighted over the cation's and
    the anion's species; parameters for an unspecified oxidation state (9) stand in. Unless the cutoff was `explicit`,
    bonds too weak to be listed are left out, and those past the first shell.
    """
    cat = species.where("ox > 0").select("structure_id", "label", F.col("element").alias("cation"), F.col("ox").alias("cation_ox"), F.col("occ").alias("c_occ"))
    an = species.where("ox < 0").select("structure_id", F.col("label").alias("other"), F.col("element").alias("anion"), F.col("ox").alias("anion_ox"), F.col("occ").alias("a_occ"))
    totals = cat.groupBy("structure_id", "label").agg(F.sum("c_occ").alias("c_tot"))
    an_totals = an.groupBy("structure_id", "other").agg(F.sum("a_occ").alias("a_tot"))
    pairs = near.join(cat, ["structure_id", "label"]).where("cation <> 'H'").join(an, ["structure_id", "other"])
    pairs = pairs.join(totals, ["structure_id", "label"]).join(an_totals, ["structure_id", "other"])
    loose = params.where("cation_ox = 9").select("cation", "anion", "anion_ox", F.col("r0").alias("r9"), F.col("b").alias("b9"))
    valued = pairs.join(params.select("cation", "cation_ox", "anion", "anion_ox", "r0", "b"), ["cation", "cation_ox", "anion", "anion_ox"], "left").join(
        loose, ["cation", "anion", "anion_ox"], "left"
    )
    valued = valued.withColumn("v", F.exp((F.coalesce("r0", "r9") - F.col("dist")) / F.coalesce("b", "b9")))
    per_species = valued.groupBy("structure_id", "label", "other", "dist", "n", "cation", "cation_ox", "c_occ", "c_tot", "a_tot").agg(F.sum(F.col("a_occ") / F.col("a_tot") * F.col("v")).alias("v"))
    bonds = per_species.groupBy("structure_id", "label", "other", "dist", "n", F.col("a_tot").alias("an_occ"), F.col("c_tot").alias("cat_occ")).agg(
        F.sum(F.col("c_occ") / F.col("c_tot") * F.coalesce("v", F.lit(0.0))).alias("s"), F.max("v").alias("s_max")
    ).where("s_max IS NOT NULL")
    return bonds if explicit else first_shell(bonds.where(F.col("s_max") >= MIN_VALENCE))


def first_shell(bonds: DataFrame) -> DataFrame:
    """Bonds up to the first gap of 1.35 times the distance before it, after three bonds, when all beyond is weak."""
    of = Window.partitionBy("structure_id", "label").orderBy("dist", "other")
    # the strongest bond from here outwards: read the other way round, a running maximum
    inward = Window.partitionBy("structure_id", "label").orderBy(F.desc("dist"), F.desc("other"))
    beyond = F.max("s_max").over(inward.rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("n").over(of.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("dist") >= SHELL_GAP * F.lag("dist").over(of)
    cut = (before >= SHELL_MIN) & gap & (F.col("_beyond") < SHELL_VALENCE)
    marked = bonds.withColumn("_beyond", beyond).withColumn("_cut", F.when(cut, 1).otherwise(0))
    return marked.withColumn("_out", F.max("_cut").over(of.rowsBetween(Window.unboundedPreceding, 0))).where("_out = 0").drop("_beyond", "_cut", "_out")


def cation_sums(bonds: DataFrame, species: DataFrame) -> DataFrame:
    """``structure_id, label, bvs, expected, coordination, mean_dist`` per cation site."""
    expected = species.where("ox > 0").groupBy("structure_id", "label").agg((F.sum(F.col("occ") * F.col("ox")) / F.sum("occ")).alias("expected"))
    sums = bonds.groupBy("structure_id", "label").agg(
        F.sum(F.least(F.col("an_occ"), F.lit(1.0)) * F.col("s") * F.col("n")).alias("bvs"), F.sum("n").alias("coordination"),
        (F.sum(F.col("dist") * F.col("n")) / F.sum("n")).alias("mean_dist"),
    )
    return sums.join(expected, ["structure_id", "label"])


def anion_sums(bonds: DataFrame, mults: DataFrame) -> DataFrame:
    """``structure_id, label, s_cat``: what each anion receives from cations; multiplicities give bonds per anion."""
    c = mults.select("structure_id", "label", F.col("mult").alias("mc"))
    a = mults.select("structure_id", F.col("label").alias("other"), F.col("mult").alias("ma"))
    across = F.col("n") * F.col("mc") / F.col("ma")
    return bonds.join(c, ["structure_id", "label"]).join(a, ["structure_id", "other"]).groupBy("structure_id", F.col("other").alias("label")).agg(
        F.sum(F.col("s") * across * F.least(F.col("cat_occ"), F.lit(1.0))).alias("s_cat")
    )


def hydrogen_bond_valence(d: Column) -> Column:
    """What an acceptor receives over a donor–acceptor distance of 2.45–3.2 Å; null outside."""
    return F.when(d.between(2.45, 3.2), F.pow(d / 2.17, -8.2) + 0.06)


def donors_by_label(label: Column) -> Column:
    """Hydrogens a label states: one for OH1, O6H; two for OW1, W4, Wat1, O7W."""
    return (
        F.when(label.rlike(r"^(?:OH|Oh)\d*[a-zA-Z]?$|^O\d+[Hh]$"), 1)
        .when(label.rlike(r"^(?:OW|Ow|Wat|W\d|H2O|Hw|OH2)|^O\d+[Ww]$"), 2)
        .otherwise(0)
    )


def accepted_bonds(near: DataFrame, pairs: DataFrame, mults: DataFrame) -> DataFrame:
    """``structure_id, label, s_hb``: hydrogen-bond valence each acceptor receives over known donor–acceptor pairs
    (structure_id, donor, acceptor)."""
    d = near.join(pairs, (near.structure_id == pairs.structure_id) & (near.label == pairs.donor) & (near.other == pairs.acceptor)).select(
        near.structure_id, near.label, near.other, "dist", "n"
    )
    md = mults.select("structure_id", "label", F.col("mult").alias("md"))
    ma = mults.select("structure_id", F.col("label").alias("other"), F.col("mult").alias("ma"))
    s = hydrogen_bond_valence(F.col("dist"))
    return d.where(s.isNotNull()).join(md, ["structure_id", "label"]).join(ma, ["structure_id", "other"]).groupBy("structure_id", F.col("other").alias("label")).agg(
        F.sum(s * F.col("n") * F.col("md") / F.col("ma")).alias("s_hb")
    )


def instability_index(sums: DataFrame) -> DataFrame:
    """Root mean square of (sum − formal valence) over a structure's sites. `sums`: structure_id, bvs, expected, mult."""
    return sums.groupBy("structure_id").agg(
        F.sqrt(F.sum(F.col("mult") * F.pow(F.col("bvs") - F.col("expected"), 2)) / F.sum("mult")).alias("gii"), F.count(F.lit(1)).alias("n_sites")
    )


def anion_assignment(oxygens: DataFrame) -> DataFrame:
    """``structure_id, label, finding``: oxygens whose sum disagrees with what they are called.

    `oxygens`: structure_id, label, occ, s_cat, s_total, n_h (hydrogens located). Partly occupied sites are left alone.
    """
    plain = F.col("label").rlike(r"^O\d+$")
    finding = (
        F.when((F.col("n_h") == 0) & plain & (F.col("s_cat") < 1.70) & (F.col("s_total") < 1.80), "under-bonded O")
        .when(((F.col("n_h") == 1) | ((F.col("n_h") == 0) & F.col("label").rlike("(?i)^OH"))) & (F.col("s_cat") > 1.85), "over-bonded OH")
        .when(((F.col("n_h") == 2) | ((F.col("n_h") == 0) & F.col("label").rlike(r"^(?:OW|Ow|W\d|Wat|H2O)"))) & (F.col("s_cat") > 0.60), "over-bonded water")
    )
    return oxygens.where("occ >= 0.98 AND s_cat <= 4").withColumn("finding", finding).where("finding IS NOT NULL").select("structure_id", "label", "finding")


def oxygen_kind(s_cat: Column) -> Column:
    return F.when(s_cat < 0.5, "H2O").when(s_cat < 1.5, "OH").otherwise("O")


def hydrogen_budget(oxygens: DataFrame, formula_units: DataFrame, h_contacts: DataFrame | None = None) -> DataFrame:
    """Hydroxyl, water and hydrogen per formula unit that the anion sums imply, and the hydrogen located on oxygen.

    `oxygens`: structure_id, label, mult, occ, s_cat; `formula_units`: structure_id, z; `h_contacts`: structure_id,
    label (the oxygen), occ (of the hydrogen), n — within 1.3 Å; an oxygen holds two at most.
    """
    w = F.col("mult") * F.least(F.col("occ"), F.lit(1.0))
    kind = oxygen_kind(F.col("s_cat"))
    implied = oxygens.groupBy("structure_id").agg(
        F.sum(F.when(kind == "OH", w).otherwise(0.0)).alias("oh"), F.sum(F.when(kind == "H2O", w).otherwise(0.0)).alias("wat")
    )
    out = implied.join(formula_units, "structure_id")
    if h_contacts is None:
        out = out.withColumn("loc", F.lit(None).cast("double"))
    else:
        held = h_contacts.groupBy("structure_id", "label").agg(F.least(F.sum(F.col("occ") * F.col("n")), F.lit(2.0)).alias("h"))
        located = oxygens.join(held, ["structure_id", "label"]).groupBy("structure_id").agg(F.sum(F.col("h") * w).alias("loc"))
        out = out.join(located, "structure_id", "left")
    return out.select(
        "structure_id", "z", F.round(F.col("oh") / F.col("z"), 2).alias("oh"), F.round(F.col("wat") / F.col("z"), 2).alias("h2o"),
        F.round((F.col("oh") + 2 * F.col("wat")) / F.col("z"), 2).alias("h"), F.round(F.col("loc") / F.col("z"), 2).alias("located"),
    )


def site_totals(species: DataFrame, mults: DataFrame) -> DataFrame:
    """``structure_id, element, atoms``: atoms per cell, multiplicity × occupancy."""
    return species.join(mults, ["structure_id", "label"]).groupBy("structure_id", "element").agg(F.sum(F.col("mult") * F.col("occ")).alias("atoms"))


def formula_units(totals: DataFrame, formula: DataFrame) -> DataFrame:
    """``structure_id, z``: the median over the elements (H aside) of cell total / formula count, when they agree
    within a quarter. `formula`: structure_id, element, n."""
    ratios = totals.join(formula.where("n >= 0.5 AND element <> 'H'"), ["structure_id", "element"]).where("atoms > 0").withColumn("r", F.col("atoms") / F.col("n"))
    z = ratios.groupBy("structure_id").agg(F.median("r").alias("m"), F.count(F.lit(1)).alias("k"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    return z.where("k >= 2 AND m >= 0.5 AND greatest(hi - m, m - lo) <= 0.25 * m").select("structure_id", F.bround("m").alias("z"))


NO_COMPARE = ("O", "H", "F", "Cl", "Br", "I", "N", "NH")


def site_formula_check(totals: DataFrame, formula: DataFrame, units: DataFrame) -> DataFrame:
    """``structure_id, element, from_sites, from_formula, state``: cations off by more than 0.05 and 5 %, or absent."""
    per = totals.join(units, "structure_id").select("structure_id", "element", (F.col("atoms") / F.col("z")).alias("from_sites"))
    want = formula.join(units.select("structure_id"), "structure_id", "left_semi").select("structure_id", "element", F.col("n").alias("from_formula"))
    both = per.join(want, ["structure_id", "element"], "full_outer").where(~F.col("element").isin(*NO_COMPARE))
    h, w = F.coalesce("from_sites", F.lit(0.0)), F.coalesce("from_formula", F.lit(0.0))
    state = (
        F.when((h == 0) & (w > 0), "absent")
        .when(F.col("from_formula").isNull() & (h >= 0.05), "not in formula")
        .when(F.col("from_formula").isNotNull() & (F.abs(h - w) > F.greatest(F.lit(0.05), 0.05 * w)), "differs")
    )
    return both.withColumn("state", state).where("state IS NOT NULL").select("structure_id", "element", F.round(h, 4).alias("from_sites"), F.round(w, 4).alias("from_formula"), "state")


ELEMENT_ORDER = tuple(ATOMIC_WEIGHTS)  # in order of atomic number from hydrogen


def atomic_number(element: Column) -> Column:
    numbers = {e: k + 1 for k, e in enumerate(ELEMENT_ORDER[:83])}
    numbers.update({"Bi": 83, "Po": 84, "Th": 90, "Pa": 91, "U": 92, "Np": 93, "Pu": 94})
    return _map(numbers)[element]


def totals_check(totals: DataFrame, stated: DataFrame, coefficients: DataFrame) -> DataFrame:
    """F(000), absorption and density from the sites against the stated ones.

    `stated`: structure_id, f000, mu, density, volume; `coefficients`: element, mu_rho (cm²/g, at the wavelength).
    Off beyond 2 %, 10 % and 0.01 g/cm³. Absorption is null where an element has no coefficient.
    """
    weights = _map(ATOMIC_WEIGHTS)
    sums = totals.join(coefficients, "element", "left").groupBy("structure_id").agg(
        F.sum(F.col("atoms") * F.coalesce(atomic_number(F.col("element")), F.lit(0))).alias("electrons"),
        F.sum(F.col("atoms") * weights[F.col("element")] * F.col("mu_rho")).alias("absorbed"),
        F.bool_and(F.col("mu_rho").isNotNull()).alias("known"), F.sum(F.col("atoms") * weights[F.col("element")]).alias("mass"),
    )
    rows = sums.join(stated, "structure_id").withColumn(
        "mu_sites", F.when(F.col("known"), 0.1 * F.col("absorbed") / (0.602214076 * F.col("volume")))
    ).withColumn("density_sites", F.col("mass") / (F.col("volume") * 0.602214))
    return rows.select(
        "structure_id", F.round("electrons", 4).alias("electrons"), F.round("mu_sites", 6).alias("mu_sites"), F.round("density_sites", 6).alias("density_sites"),
        (F.abs(F.col("electrons") - F.col("f000")) > 0.02 * F.col("f000")).alias("f000_off"), (F.abs(F.col("mu_sites") - F.col("mu")) > 0.10 * F.col("mu_sites")).alias("mu_off"),
        (F.abs(F.col("density_sites") - F.col("density")) > 0.01).alias("density_off"),
    )


def closure(totals: DataFrame, formula: DataFrame) -> DataFrame:
    """``structure_id, ratio_off, mean_off``: how the contents of a structure built from a table meet the formula.

    The cation/anion ratio with hydrogen left out, and the mean relative difference with the totals scaled to the most
    abundant shared element; elements absent from the sites below a fifth of the formula's largest are skipped.
    """
    anion = F.col("element").isin("O", "F", "Cl", "Br", "I", "S", "Se", "Te")
    both = totals.join(formula, ["structure_id", "element"], "full_outer").where("element <> 'H'").withColumn("atoms", F.coalesce("atoms", F.lit(0.0))).withColumn("n", F.coalesce("n", F.lit(0.0)))
    of = Window.partitionBy("structure_id")
    both = both.withColumn("top", F.max("n").over(of)).withColumn(
        "ref", F.max(F.when((F.col("atoms") > 0) & (F.col("n") > 0), F.struct(F.col("n").alias("n"), F.col("element").alias("e"), F.col("atoms").alias("a")))).over(of)
    ).where("ref IS NOT NULL")
    scaled = F.col("atoms") * F.col("ref.n") / F.col("ref.a")
    counted = ~((F.col("atoms") == 0) & (F.col("n") < 0.2 * F.col("top")))
    sums = both.groupBy("structure_id").agg(
        F.sum(F.when(anion, 0.0).otherwise(F.col("atoms"))).alias("c1"), F.sum(F.when(anion, F.col("atoms")).otherwise(0.0)).alias("a1"),
        F.sum(F.when(anion, 0.0).otherwise(F.col("n"))).alias("c2"), F.sum(F.when(anion, F.col("n")).otherwise(0.0)).alias("a2"),
        F.avg(F.when(counted, F.abs(scaled - F.col("n")) / F.greatest(F.col("n"), F.lit(0.05)))).alias("mean_off"),
    ).where("a1 > 0 AND a2 > 0 AND c2 > 0")
    return sums.select("structure_id", F.round(F.abs(F.col("c1") / F.col("a1") - F.col("c2") / F.col("a2")) / (F.col("c2") / F.col("a2")), 6).alias("ratio_off"), F.round("mean_off", 6).alias("mean_off"))


# --- tables against the structure ---------------------------------------------------------------


def geometry_self_check(near: DataFrame, listed: DataFrame) -> DataFrame:
    """``structure_id, label, other, listed, off``: listed distances no computed one reproduces (0.003 Å, 0.01 with H).

    `listed`: structure_id, label, other, dist. The smallest deviation per listed row is an aggregate.
    """
    both = near.select("structure_id", "label", "other", F.col("dist").alias("d")).unionByName(near.select("structure_id", F.col("other").alias("label"), F.col("label").alias("other"), F.col("dist").alias("d"))).distinct()
    best = listed.join(both, ["structure_id", "label", "other"]).groupBy("structure_id", "label", "other", F.col("dist").alias("listed")).agg(F.min(F.abs(F.col("dist") - F.col("d"))).alias("off"))
    tol = F.when(F.col("label").startswith("H") | F.col("other").startswith("H"), 0.01).otherwise(0.003)
    return best.where(F.col("off") > tol)


def printed_bonds_check(sites: DataFrame, symops: DataFrame, cells: DataFrame, printed: DataFrame, tol: float = 0.01) -> DataFrame:
    """Printed (label, other, op_no, shift, dist) against the distance to that symmetry image: ``calc, off, agrees``."""
    p = sites.select("structure_id", "label", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"))
    q = sites.select("structure_id", F.col("label").alias("other"), "x", "y", "z")
    rows = printed.join(p, ["structure_id", "label"]).join(q, ["structure_id", "other"]).join(symops, ["structure_id", "op_no"]).join(cells, "structure_id")
    moved = [_axis("rot", "tr", k) + F.col("shift")[k] for k in range(3)]
    rows = rows.withColumn("calc", metric_length(metric(_cell()), moved[0] - F.col("x0"), moved[1] - F.col("y0"), moved[2] - F.col("z0")))
    return rows.select("structure_id", "label", "other", "op_no", "dist", F.round("calc", 6).alias("calc"), (F.abs(F.col("dist") - F.col("calc")) <= tol).alias("agrees"))


def cooccurring_bond_hits(printed: DataFrame, near: DataFrame, tol: float = 0.01) -> DataFrame:
    """Per cation–anion pair: printed distances, and how many some computed one reproduces (a semi join)."""
    from recordaudit.operators.matching import Tolerance, near_join

    rows = printed.withColumn("row", F.monotonically_increasing_id())
    got = near_join(rows, near.select("structure_id", "label", "other", F.col("dist").alias("near_d")), ["structure_id", "label", "other"], "dist", "near_d", Tolerance(abs=tol), 0.1, "left_semi")
    hits = got.groupBy("label", "other").agg(F.count(F.lit(1)).alias("hits"))
    return rows.groupBy("label", "other").agg(F.count(F.lit(1)).alias("n")).join(hits, ["label", "other"], "left").select(
        "label", "other", "n", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 4).alias("share")
    )


def compare_valence_tables(computed: DataFrame, printed: DataFrame) -> DataFrame:
    """Cells of a printed bond-valence table against the computed: ``agrees``, ``differs``, ``only printed`` or
    ``only computed`` (from 0.10 vu up). Tolerance 0.015 vu and 2.5 % of the printed value."""
    both = computed.select("structure_id", "row_label", "col_label", F.col("s").alias("computed")).join(
        printed.select("structure_id", "row_label", "col_label", F.col("s").alias("printed")), ["structure_id", "row_label", "col_label"], "full_outer"
    )
    state = (
        F.when(F.col("computed").isNull(), "only printed")
        .when(F.col("printed").isNull(), F.when(F.col("computed") >= 0.10, "only computed"))
        .when(F.abs(F.col("computed") - F.col("printed")) <= 0.015 + 0.025 * F.abs("printed"), "agrees")
        .otherwise("differs")
    )
    return both.withColumn("state", state).where("state IS NOT NULL")


def diagnose_columns(cells: DataFrame, axis: str = "col_label", least: int = 3) -> DataFrame:
    """``structure_id, axis, n, n_differ, scale, explained, verdict`` of each column (or row) of compared tables.

    `cells` are those of `compare_valence_tables`. `scale` is the median of printed over computed, from cells of 0.05 vu up;
    `explained` is the share of cells that agree once the computed ones are multiplied by it. A column whose differences go one way and
    are explained by a scale that is not one is ``scaled``, although its small cells lie within the tolerance as they are; one
    that mostly differs without that is ``another``, one with some differences ``cells``, else ``agrees``. Two aggregations
    on one key; no column is gathered.
    """
    key = ["structure_id", axis]
    both = cells.where("computed IS NOT NULL AND printed IS NOT NULL").select(*key, "computed", "printed", (F.col("state") == "differs").alias("off"))
    scales = both.groupBy(*key).agg(F.median(F.when(F.col("computed") >= 0.05, F.col("printed") / F.col("computed"))).alias("scale"))
    fits = F.round(F.abs(F.col("printed") - F.col("scale") * F.col("computed")), 9) <= F.round(0.015 + 0.025 * F.abs("printed"), 9)
    rows = both.join(scales, key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("off").alias("n_differ"), F.first("scale").alias("scale"), (F.count_if(fits) / F.count(F.lit(1))).alias("explained"),
        F.count_if(F.col("off") & (F.col("printed") > F.col("computed"))).alias("over"),
    )
    one_way = (F.col("over") == 0) | (F.col("over") == F.col("n_differ"))
    scaled = (F.col("n") >= least) & (F.col("n_differ") >= F.greatest(F.lit(2), F.ceil(0.4 * F.col("n")))) & one_way & (F.col("explained") >= 0.8) & (F.round(F.abs(F.col("scale") - 1), 9) > 0.03)
    verdict = F.when(F.coalesce(scaled, F.lit(False)), "scaled").when((F.col("n_differ") >= least) & (F.col("n_differ") >= 0.6 * F.col("n")), "another").when(F.col("n_differ") > 0, "cells").otherwise("agrees")
    return rows.select(*key, "n", "n_differ", "scale", "explained", verdict.alias("verdict"))


def compare_refinement_numbers(text_numbers: DataFrame, items: DataFrame) -> DataFrame:
    """Numbers a manuscript states against the structure file: off ones, a flag from a table, else a note.

    `text_numbers`: structure_id, item, how, value, esd, decimals, place (table or prose); `items`: structure_id, item,
    ref, ref_esd. Tolerances: cell three uncertainties or half the last digit, R 0.0006, goodness of fit 0.006, integers
    0.5, F(000) 1, else 0.006 or 0.2 %.
    """
    rows = text_numbers.join(items, ["structure_id", "item"])
    tol = (
        F.when(F.col("how") == "cell", F.greatest(3 * F.coalesce("esd", F.lit(0.0)), 3 * F.coalesce("ref_esd", F.lit(0.0)), F.pow(F.lit(10.0), -F.col("decimals")) / 2))
        .when(F.col("how") == "r", 0.0006).when(F.col("how") == "gof", 0.006).when(F.col("how") == "int", 0.5).when(F.col("how") == "f000", 1.0)
        .otherwise(F.greatest(F.lit(0.006), 0.002 * F.abs("ref")))
    )
    off = rows.where(F.abs(F.col("value") - F.col("ref")) > tol)
    return off.groupBy("structure_id", "item", "value", "ref").agg(F.when(F.bool_or(F.col("place") == "table"), "flag").otherwise("note").alias("sev"))


def refinement_triage(refinements: DataFrame) -> DataFrame:
    """``structure_id, finding, sev`` from refinement numbers (nulls abstain)."""
    c = F.col
    floor = F.exp(-2.0 * c("mu") * c("dmax"))
    physical = F.lower(F.coalesce("absorption", F.lit(""))).rlike("analyt|numer|integrat|gauss|sphere|cylind")
    findings = F.array_compact(F.array(
        F.when(c("r1") > F.greatest(3.0 * c("rint"), F.lit(0.06)), F.struct(F.lit("R1 against Rint").alias("f"), F.lit("note").alias("s"))),
        F.when(c("wr2") / c("r1") > 3.5, F.struct(F.lit("wR2 against R1").alias("f"), F.lit("note").alias("s"))),
        F.when(c("completeness") < 0.95, F.struct(F.lit("completeness").alias("f"), F.lit("note").alias("s"))),
        F.when(c("n_observed") / c("n_total") < 0.5, F.struct(F.lit("observed fraction").alias("f"), F.lit("note").alias("s"))),
        F.when(c("n_total") / c("n_parameters") < 8.0, F.struct(F.lit("data per parameter").alias("f"), F.lit("note").alias("s"))),
        F.when(c("flack").between(0.15, 0.85) & F.coalesce(c("flack_esd") < 0.15, F.lit(True)), F.struct(F.lit("Flack parameter").alias("f"), F.lit("note").alias("s"))),
        F.when(c("tmin") / c("tmax") < floor * 0.999, F.struct(F.lit("transmission range").alias("f"), F.when(physical, "flag").otherwise("note").alias("s"))),
    ))
    return refinements.select("structure_id", F.explode(findings).alias("x")).select("structure_id", F.col("x.f").alias("finding"), F.col("x.s").alias("sev"))


# --- bonds --------------------------------------------------------------------------------------


def bond_statistics(bonds: DataFrame, params: DataFrame) -> DataFrame:
    """Count, mean distance and valence sum per cation of a printed bond list (no coordinates, so no anion sums).
    `bonds`: structure_id, label, cation, cation_ox, other, anion, anion_ox, dist, n."""
    valued = bonds.join(params.select("cation", "cation_ox", "anion", "anion_ox", "r0", "b"), ["cation", "cation_ox", "anion", "anion_ox"], "left")
    return valued.groupBy("structure_id", "label").agg(
        F.sum("n").alias("coordination"), (F.sum(F.col("dist") * F.col("n")) / F.sum("n")).alias("mean_dist"),
        F.sum(F.exp((F.col("r0") - F.col("dist")) / F.col("b")) * F.col("n")).alias("bvs"), F.count_if(F.col("r0").isNull()).alias("no_parameters"),
    )


def coordination_summary(bonds: DataFrame) -> DataFrame:
    """Bonds of each cation with equal distances (to three decimals) merged as ×n, the number and the weighted mean."""
    merged = bonds.groupBy("structure_id", "label", "other", F.round("dist", 3).alias("dist")).agg(F.sum("n").alias("n"))
    of = Window.partitionBy("structure_id", "label")
    return merged.withColumn("number", F.sum("n").over(of)).withColumn("mean_dist", F.round(F.sum(F.col("dist") * F.col("n")).over(of) / F.sum("n").over(of), 3)).withColumn(
        "text", F.concat(F.format_string("%s–%s %.3f", F.col("label"), F.col("other"), F.col("dist")), F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n"))).otherwise(""))
    )


def uranyl_sites(near: DataFrame, elements: DataFrame) -> DataFrame:
    """Uranium sites with two short bonds set apart: both under 1.95 Å, the third at least 0.20 Å longer.
    ``structure_id, label, mean_dist, nu1, nu3``."""
    from recordaudit.functions import spectra as S

    oxygen = elements.where("element = 'O'").select("structure_id", F.col("label").alias("other"))
    u = near.join(elements.where("element = 'U'").select("structure_id", "label"), ["structure_id", "label"], "left_semi").join(oxygen, ["structure_id", "other"], "left_semi")
    single = u.withColumn("one", F.explode(F.expr("sequence(1, least(n, 3))")))
    of = Window.partitionBy("structure_id", "label").orderBy("dist", "other", "one")
    three = single.withColumn("k", F.row_number().over(of)).where("k <= 3").groupBy("structure_id", "label").agg(*[F.max(F.when(F.col("k") == k, F.col("dist"))).alias(f"d{k}") for k in (1, 2, 3)])
    mean = (F.col("d1") + F.col("d2")) / 2
    return three.where("d2 < 1.95 AND (d3 IS NULL OR d3 - d2 >= 0.20)").select(
        "structure_id", "label", F.round(mean, 6).alias("mean_dist"), F.round(S.uranyl_nu1(mean), 4).alias("nu1"), F.round(S.uranyl_nu3(mean), 4).alias("nu3")
    )


def hbond_geometry(sites: DataFrame, symops: DataFrame, cells: DataFrame) -> DataFrame:
    """``structure_id, donor, hydrogen, acceptor, dh, ha, da, angle``: D–H⋯A from located hydrogens.

    The donor is the nearest O, F, N or Cl within 1.25 Å, acceptors lie within 2.6 Å of H at 110° or more.
    """
    heavy = sites.where(F.col("element").isin("O", "F", "N", "Cl"))
    images = expand_symmetry(heavy, symops)
    h = sites.where("element = 'H'").select("structure_id", "label", "x", "y", "z", F.lit(2.6).alias("cutoff"))
    near = contacts(h, images, cells)
    of = Window.partitionBy("structure_id", "label").orderBy("dist", "other", "qx", "qy", "qz")
    ranked = near.withColumn("k", F.row_number().over(of))
    donor = ranked.where("k = 1 AND dist <= 1.25").select("structure_id", "label", F.col("other").alias("donor"), F.col("dist").alias("dh"), *[F.col(f"q{v}").alias(f"d{v}") for v in "xyz"])
    rows = ranked.where("k > 1").join(donor, ["structure_id", "label"]).join(cells, "structure_id")
    rows = rows.withColumn("da", metric_length(metric(_cell()), *[F.col(f"q{v}") - F.col(f"d{v}") for v in "xyz"]))
    cosine = (F.col("dh") * F.col("dh") + F.col("dist") * F.col("dist") - F.col("da") * F.col("da")) / (2 * F.col("dh") * F.col("dist"))
    rows = rows.withColumn("angle", F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))))
    return rows.where("angle >= 110").select("structure_id", "donor", F.col("label").alias("hydrogen"), F.col("other").alias("acceptor"), "dh", F.col("dist").alias("ha"), "da", "angle")


def distance_esd(bonds: DataFrame, sites: DataFrame, cells: DataFrame) -> DataFrame:
    """Distance of a bond and its uncertainty from those of coordinates and cell, added in quadrature.

    `bonds`: structure_id, label, other, tx, ty, tz (the other atom's position is its own plus this shift); `sites` and
    `cells` carry ``s_`` columns with the uncertainties. Each parameter is moved by its own uncertainty.
    """
    p = sites.select("structure_id", "label", *[F.col(c).alias(f"p_{c}") for c in ("x", "y", "z", "s_x", "s_y", "s_z")])
    q = sites.select("structure_id", F.col("label").alias("other"), *[F.col(c).alias(f"q_{c}") for c in ("x", "y", "z", "s_x", "s_y", "s_z")])
    rows = bonds.join(p, ["structure_id", "label"]).join(q, ["structure_id", "other"]).join(cells, "structure_id")
    delta = [F.col(f"q_{v}") + F.col(f"t{v}") - F.col(f"p_{v}") for v in "xyz"]

    def dist(shift: dict | None = None, cell_shift: dict | None = None) -> Column:
        d = [x + (shift or {}).get(k, F.lit(0.0)) for k, x in enumerate(delta)]
        return metric_length(metric([F.col(c) + (cell_shift or {}).get(c, F.lit(0.0)) for c in CELL]), *d)

    rows = rows.withColumn("dist", dist())
    variance = F.lit(0.0)
    for k, v in enumerate("xyz"):
        for side, sign in (("p", -1.0), ("q", 1.0)):
            variance = variance + F.pow(dist({k: sign * F.coalesce(F.col(f"{side}_s_{v}"), F.lit(0.0))}) - F.col("dist"), 2)
    for c in CELL:
        variance = variance + F.pow(dist(None, {c: F.coalesce(F.col(f"s_{c}"), F.lit(0.0))}) - F.col("dist"), 2)
    return rows.withColumn("v", variance).select("structure_id", "label", "other", "dist", F.when(F.col("v") > 0, F.sqrt("v")).alias("esd"))


# --- reflections --------------------------------------------------------------------------------


def operator_arrays(symops: DataFrame, key: str = "structure_id") -> DataFrame:
    """One row per structure or space group with its operators (192 at most)."""
    return symops.groupBy(key).agg(F.collect_list(F.struct("rot", "tr")).alias("ops"))


def _turned(rot: Column, col: int) -> Column:
    return F.col("h") * rot[0][col] + F.col("k") * rot[1][col] + F.col("l") * rot[2][col]


def systematic_absences(reflections: DataFrame, symops: DataFrame, key: str = "space_group") -> DataFrame:
    """Adds ``absent``: some operator keeps (hkl) and shifts its phase by a part of a turn."""
    def forbids(op: Column) -> Column:
        rot, tr = op["rot"], op["tr"]
        phase = F.col("h") * tr[0] + F.col("k") * tr[1] + F.col("l") * tr[2]
        keeps = (_turned(rot, 0) == F.col("h")) & (_turned(rot, 1) == F.col("k")) & (_turned(rot, 2) == F.col("l"))
        return keeps & (F.abs(phase - F.round(phase)) > 1e-6)

    rows = reflections.join(operator_arrays(symops, key), key, "left")
    zero = (F.col("h") == 0) & (F.col("k") == 0) & (F.col("l") == 0)
    return rows.withColumn("absent", F.when(zero, False).otherwise(F.coalesce(F.exists("ops", forbids), F.lit(False)))).drop("ops")


def canonical_hkl(ops: Column) -> Column:
    """The largest (h, k, l) among the equivalents under the operators' rotations and their inverses."""
    def forms(op: Column) -> Column:
        v = [_turned(op["rot"], c) for c in range(3)]
        return F.array(F.struct(*[x.cast("int").alias(n) for x, n in zip(v, "hkl")]), F.struct(*[(-x).cast("int").alias(n) for x, n in zip(v, "hkl")]))

    return F.array_max(F.flatten(F.transform(ops, forms)))


def powder_pattern(cells: DataFrame, sites: DataFrame, symops: DataFrame, factors: DataFrame, lam: float = 1.5406, dmin: float = 1.0, polarisation: float = 1.0) -> DataFrame:
    """``structure_id, h, k, l, d, two_theta, mult, f2, i``: the lines of each structure's powder pattern.

    `sites` may carry ``biso``; `factors`: element, a array<double>, b array<double>, c. Every line down to
    `dmin` is there, however large the cell. The structure factor of a reflection is a fold over the
    cell's atoms, so reflections and atoms never multiply into rows.
    """
    biso = F.coalesce(F.col("biso"), F.lit(0.0)) if "biso" in sites.columns else F.lit(0.0)
    images = expand_symmetry(sites.select("structure_id", "label", "x", "y", "z").distinct(), symops).select("structure_id", "label", "x", "y", "z")
    kinds = sites.select("structure_id", "label", "element", "occ", biso.alias("biso")).join(factors, "element").where("occ > 0")
    atoms = images.join(by_shuffle(kinds), ["structure_id", "label"]).groupBy("structure_id").agg(
        F.collect_list(F.struct("x", "y", "z", "occ", "biso", F.col("a").alias("fa"), F.col("b").alias("fb"), F.col("c").alias("fc"))).alias("atoms")
    )
    # |h| of a lattice plane is at most the length of its axis over its spacing, so these boxes hold every line down to dmin. One
    # slab of h at a time: k and l are laid out row by row, and lines outside the sphere go before the operators are joined.
    span = lambda axis: F.sequence(-F.floor(F.col(axis) / dmin).cast("int"), F.floor(F.col(axis) / dmin).cast("int"))
    hkl = cells.withColumn("h", F.explode(span("a"))).withColumn("k", F.explode(span("b"))).withColumn("l", F.explode(span("c"))).where("NOT (h = 0 AND k = 0 AND l = 0)")
    hkl = hkl.withColumn("q", inv_d2(_cell(), F.col("h"), F.col("k"), F.col("l"))).withColumn("d", 1 / F.sqrt(F.when(F.col("q") > 0, F.col("q")))).where((F.col("d") >= dmin) & (lam / (2 * F.col("d")) < 1))
    hkl = hkl.join(by_shuffle(operator_arrays(symops)), "structure_id")
    # one representative per class under the Laue group: its members are counted before any structure factor is formed
    classes = hkl.withColumn("top", canonical_hkl(F.col("ops"))).groupBy("structure_id", "top").agg(F.count(F.lit(1)).alias("mult"), F.first("q").alias("q"), F.first("d").alias("d"))
    rows = classes.join(by_shuffle(atoms), "structure_id").select("structure_id", "mult", "q", "d", F.col("top.h").alias("h"), F.col("top.k").alias("k"), F.col("top.l").alias("l"), "atoms")

    def weight(at: Column) -> Column:
        s2 = F.col("q") / 4
        f = F.aggregate(F.zip_with(at["fa"], at["fb"], lambda a, b: a * F.exp(-b * s2)), F.lit(0.0), lambda s, v: s + v) + at["fc"]
        return at["occ"] * f * F.exp(-at["biso"] * s2)

    phase = lambda at: 2 * np.pi * (F.col("h") * at["x"] + F.col("k") * at["y"] + F.col("l") * at["z"])
    parts = F.transform("atoms", lambda at: F.struct((weight(at) * F.cos(phase(at))).alias("re"), (weight(at) * F.sin(phase(at))).alias("im")))
    start = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    total = F.aggregate(parts, start, lambda s, p: F.struct((s["re"] + p["re"]).alias("re"), (s["im"] + p["im"]).alias("im")), lambda s: s["re"] * s["re"] + s["im"] * s["im"])
    rows = rows.withColumn("f2", total).where("f2 >= 1e-6").withColumn("theta", F.asin(lam / (2 * F.col("d"))))
    lp = (1 + polarisation * F.pow(F.cos(2 * F.col("theta")), 2)) / (F.pow(F.sin("theta"), 2) * F.cos("theta"))
    rows = rows.withColumn("raw", F.col("mult") * F.col("f2") * lp)
    return rows.select(
        "structure_id", "h", "k", "l", "d", F.degrees(2 * F.col("theta")).alias("two_theta"), "mult", "f2",
        (100.0 * F.col("raw") / F.max("raw").over(Window.partitionBy("structure_id"))).alias("i"),
    )


SAME_D = 0.0015  # fixed value: two d spacings within this part of the smaller are one line
CARRIED = 0.004  # fixed value: how far off in d a printed line may carry the intensity of another


def _lines_of_one_d(pattern: DataFrame) -> DataFrame:
    """Adds ``pile``: lines taken from the largest d down lie in one pile while they are within `SAME_D` of its first."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, head, pile = None, 0.0, -1
        for batch in batches:
            piles = []
            for structure, d in zip(batch["structure_id"], batch["d"]):
                if structure != at or head - d > SAME_D * d:
                    at, head, pile = structure, d, pile + 1
                piles.append(pile)
            yield batch.assign(pile=piles)

    rows = pattern.select("structure_id", "h", "k", "l", "d", "i").repartition("structure_id").sortWithinPartitions("structure_id", F.desc("d"))
    return rows.mapInPandas(deal, T.StructType([*rows.schema.fields, T.StructField("pile", T.LongType())]))


def table_vs_pattern(table: DataFrame, pattern: DataFrame, symops: DataFrame, strong: float = 10.0, least: int = 1) -> DataFrame:
    """A printed calculated table against the computed pattern, per structure: lines found, d off (beyond 0.15 %), the rms
    difference of intensities on a scale of 100, and strong computed lines the table lacks.

    `table`: structure_id, h, k, l, d, i. A row names the line of its equivalent indices; where that line's d is not the printed one,
    the sign variant of the index whose d is (bars over indices get lost). Intensities are scaled to the strongest listed line.
    Lines of one d of which the table lists a single one are taken apart and summed, and the sum stands where the column clearly
    follows it: an rms (of `least` pairs or more) a quarter lower and by more than half a point. A computed line of `strong` or more,
    above the table's own floor, is lacking unless a line within 0.4 % of its d prints half of it beyond its own intensity.
    """
    from recordaudit.operators.matching import Tolerance, near_join

    line = ["structure_id", "h", "k", "l"]
    computed = pattern.select("structure_id", F.struct("h", "k", "l").alias("top"), F.col("d").alias("p_d"), F.col("i").alias("p_i"))
    # equal rows are one with a count; -h -k -l is the same line as h k l, so four signs are all
    said = table.groupBy("structure_id", "h", "k", "l", "d", "i").agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({"d": "t_d", "i": "t_i"})
    signs = [F.struct(F.lit(turn).alias("turn"), F.col("h"), (F.col("k") * sk).alias("k"), (F.col("l") * sl).alias("l")) for turn, (sk, sl) in enumerate(((1, 1), (1, -1), (-1, 1), (-1, -1)))]
    signed = said.select("structure_id", F.struct("h", "k", "l").alias("row"), "t_d", "t_i", "n", F.inline(F.array(*signs)))
    signed = signed.join(by_shuffle(operator_arrays(symops)), "structure_id").withColumn("top", canonical_hkl(F.col("ops"))).drop("ops", "h", "k", "l")
    off = F.abs(F.col("p_d") - F.col("t_d"))
    near = F.coalesce(off <= SAME_D * F.col("t_d"), F.lit(False))
    rank = F.when(near & (F.col("turn") == 0), 0).when(near, 1).when(F.col("turn") == 0, 2)
    met = signed.join(by_shuffle(computed), ["structure_id", "top"], "left").withColumn("rank", rank).where("rank IS NOT NULL")
    met = met.groupBy("structure_id", "row", "t_d", "t_i", "n").agg(F.min(F.struct("rank", off.alias("off"), "turn", "top", "p_d", "p_i")).alias("m"))
    met = cut_lineage(met.select("structure_id", "t_d", "t_i", "n", "m.top.*", F.col("m.p_d").alias("d"), F.col("m.p_i").alias("i")))
    listed = met.select(*line).distinct()

    piles = _lines_of_one_d(pattern).join(by_shuffle(listed.withColumn("listed", F.lit(True))), line, "left")
    piles = piles.groupBy("structure_id", "pile").agg(F.count(F.lit(1)).alias("of"), F.count("listed").alias("told"), F.sum("i").alias("total"), F.max(F.when(F.col("listed"), F.struct("h", "k", "l"))).alias("top"))
    summed = piles.where("of > 1 AND told = 1").select("structure_id", "top.*", "total")

    whole = Window.partitionBy("structure_id")
    rows = met.join(by_shuffle(summed), line, "left").withColumn("total", F.coalesce("total", "i"))
    pair = F.col("i").isNotNull() & F.col("t_i").isNotNull()
    scale = lambda c: F.nullif(F.max(c).over(whole), F.lit(0.0))
    rows = rows.withColumn("top_i", scale("i")).withColumn("top_total", scale("total")).withColumn("t_pairs", F.coalesce(scale(F.when(pair, F.col("t_i"))), F.lit(1.0)))

    def rms(c: str, top: str) -> Column:
        gap = 100 * F.col("t_i") / F.col("t_pairs") - 100 * F.col(c) / F.col(top)
        pairs = F.sum(F.when(pair, F.col("n")))
        return F.when(pairs >= least, F.sqrt(F.sum(F.when(pair, F.col("n") * F.pow(gap, 2))) / pairs))

    sums = rows.groupBy("structure_id").agg(
        F.sum("n").alias("lines"), F.coalesce(F.sum(F.when(F.col("d").isNotNull(), F.col("n"))), F.lit(0)).alias("found"),
        F.coalesce(F.sum(F.when(F.abs(F.col("t_d") - F.col("d")) > SAME_D * F.col("d"), F.col("n"))), F.lit(0)).alias("d_off"),
        rms("i", "top_i").alias("rms_apart"), rms("total", "top_total").alias("rms_summed"), F.max("top_i").alias("top_i"), F.max("top_total").alias("top_total"),
        F.max("t_i").alias("t_top"), F.min("t_i").alias("t_least"),
    )
    strongest = pattern.groupBy("structure_id").agg(F.nullif(F.max("i"), F.lit(0.0)).alias("strongest"))
    follows = F.coalesce((F.col("rms_summed") < 0.75 * F.col("rms_apart")) & (F.col("rms_summed") < F.col("rms_apart") - 0.5), F.lit(False))
    sums = sums.join(by_shuffle(strongest), "structure_id", "left").withColumn("rms_i", F.when(follows, F.col("rms_summed")).otherwise(F.col("rms_apart")))
    sums = cut_lineage(sums.withColumn("top", F.coalesce(F.when(follows, F.col("top_total")).otherwise(F.col("top_i")), "strongest", F.lit(1.0))))

    # what a line must reach to be missed: more than the table's weakest line, by more than the two disagree
    floor = F.greatest(2 * F.col("t_least"), F.col("t_least") + F.coalesce("rms_i", F.lit(0.0)), F.lit(1.0), F.lit(strong))
    scales = by_shuffle(sums.select("structure_id", "top", F.coalesce(F.nullif("t_top", F.lit(0.0)), F.lit(1.0)).alias("t_top"), F.when(F.col("t_least").isNotNull(), floor).alias("floor")))
    rest = pattern.join(scales, "structure_id").withColumn("own_i", 100 * F.col("i") / F.col("top")).where("own_i >= floor").select(*line, F.col("d").alias("own_d"), "own_i")
    rest = rest.join(by_shuffle(listed), line, "left_anti")
    spare = met.join(scales, "structure_id").select("structure_id", "d", (100 * F.col("t_i") / F.col("t_top") - 100 * F.col("i") / F.col("top")).alias("spare")).where("spare > 0")
    carried = near_join(rest, by_shuffle(spare), ["structure_id"], "own_d", "d", Tolerance(rel=CARRIED), 0.05).where("spare >= 0.5 * own_i").select(*line).distinct()
    gone = rest.join(by_shuffle(carried), line, "left_anti").groupBy("structure_id").agg(F.count(F.lit(1)).alias("omitted"))
    return sums.join(by_shuffle(gone), "structure_id", "left").select(
        "structure_id", "lines", "found", "d_off", F.round("rms_i", 4).alias("rms_i"), F.coalesce("omitted", F.lit(0)).cast("bigint").alias("omitted")
    )


def cell_consistency(reflections: DataFrame, cells: DataFrame, key: str = "structure_id", tol: float = 0.005) -> DataFrame:
    """Rows with a computable d, and rows within half a per cent of the printed one. `reflections`: key, h, k, l, d."""
    rows = reflections.join(cells, key).where("NOT (h = 0 AND k = 0 AND l = 0) AND d > 0")
    calc = d_spacing(_cell(), F.col("h"), F.col("k"), F.col("l"))
    rows = rows.withColumn("calc", calc).where("calc IS NOT NULL")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("calc") - F.col("d")) / F.col("d") <= tol).alias("ok"))


# --- cell from reflections ----------------------------------------------------------------------

# The terms of 1/d² per system, as products of index pairs (hh, kk, ll, hk, hl, kl) with weights.
BASES = {
    "cubic": [{"hh": 1, "kk": 1, "ll": 1}],
    "tetragonal": [{"hh": 1, "kk": 1}, {"ll": 1}],
    "hexagonal": [{"hh": 1, "hk": 1, "kk": 1}, {"ll": 1}],
    "orthorhombic": [{"hh": 1}, {"kk": 1}, {"ll": 1}],
    "monoclinic-b": [{"hh": 1}, {"kk": 1}, {"ll": 1}, {"hl": 1}],
    "monoclinic-a": [{"hh": 1}, {"kk": 1}, {"ll": 1}, {"kl": 1}],
    "monoclinic-c": [{"hh": 1}, {"kk": 1}, {"ll": 1}, {"hk": 1}],
    "triclinic": [{"hh": 1}, {"kk": 1}, {"ll": 1}, {"hk": 1}, {"hl": 1}, {"kl": 1}],
}
PAIRS = ("hh", "kk", "ll", "hk", "hl", "kl")


def fit_cell(rows: DataFrame, key: str = "entry_id") -> DataFrame:
    """``key, n, a, b, c, al, be, ga, s_a … s_ga``: the cell a column of d follows from, by least squares on 1/d².

    `rows`: key, system, h, k, l, d. Each entry is reduced to the sums of products of its rows (combined map-side) —
    27 numbers however long its list — and the system of at most six unknowns is solved from those.
    Entries with fewer than two rows more than unknowns, or a solution that is no cell, give none.
    """
    idx = {"h": F.col("h").cast("double"), "k": F.col("k").cast("double"), "l": F.col("l").cast("double")}
    base = rows.where("d > 0 AND h IS NOT NULL").select(key, "system", *[(idx[p[0]] * idx[p[1]]).alias(p) for p in PAIRS], (1 / (F.col("d") * F.col("d"))).alias("y"))
    sums = [F.sum(F.col(p) * F.col(q)).alias(f"{p}_{q}") for i, p in enumerate(PAIRS) for q in PAIRS[i:]]
    sums += [F.sum(F.col(p) * F.col("y")).alias(f"{p}_y") for p in PAIRS] + [F.sum(F.col("y") * F.col("y")).alias("y_y"), F.count(F.lit(1)).alias("n")]
    names = [f"{p}_{q}" for i, p in enumerate(PAIRS) for q in PAIRS[i:]]
    out = [*CELL, *[f"s_{c}" for c in CELL]]

    def cells_of(par: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The cells of stacked reciprocal tensors given by their parameters; NaN where a tensor has no inverse."""
        v = par @ t
        g = np.stack([np.stack([v[:, 0], v[:, 3] / 2, v[:, 4] / 2], 1), np.stack([v[:, 3] / 2, v[:, 1], v[:, 5] / 2], 1), np.stack([v[:, 4] / 2, v[:, 5] / 2, v[:, 2]], 1)], 1)
        flat = np.linalg.det(g) == 0
        g[flat] = np.eye(3)
        direct = np.linalg.inv(g)
        lengths = np.sqrt(np.diagonal(direct, axis1=1, axis2=2))
        angles = [np.degrees(np.arccos(direct[:, i, j] / (lengths[:, i] * lengths[:, j]))) for i, j in ((1, 2), (0, 2), (0, 1))]
        return np.where(flat[:, None], np.nan, np.column_stack([lengths, *angles]))

    def of_system(rows: pd.DataFrame, terms) -> pd.DataFrame:
        """All entries of one crystal system, their normal equations stacked."""
        t = np.array([[term.get(p, 0) for p in PAIRS] for term in terms], dtype=float)
        full = np.empty((len(rows), 6, 6))
        for i, p in enumerate(PAIRS):
            for j in range(i, 6):
                full[:, i, j] = full[:, j, i] = rows[f"{p}_{PAIRS[j]}"]
        normal, right = t @ full @ t.T, rows[[f"{p}_y" for p in PAIRS]].to_numpy(dtype=float) @ t.T
        solvable = np.abs(np.linalg.det(normal)) >= 1e-14
        rows, normal, right = rows[solvable], normal[solvable], right[solvable]
        par = np.linalg.solve(normal, right[:, :, None])[:, :, 0]
        rest = np.maximum(rows["y_y"].to_numpy() - (par * right).sum(axis=1), 0.0) / np.maximum(1, rows["n"].to_numpy() - len(terms))
        sigma = np.sqrt(np.maximum(rest[:, None] * np.diagonal(np.linalg.inv(normal), axis1=1, axis2=2), 0.0))
        with np.errstate(all="ignore"):
            cell = cells_of(par, t)
            shifts = [cells_of(par + sigma * (np.arange(len(terms)) == j), t) - cell for j in range(len(terms))]
        esd = np.sqrt(np.square(shifts).sum(axis=0))
        good = (par[:, :3] > 0).all(axis=1) & np.isfinite(cell).all(axis=1)
        return pd.DataFrame(np.column_stack([cell, esd])[good], columns=out).assign(**{key: rows[key].to_numpy()[good], "n": rows["n"].to_numpy()[good]})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [pd.DataFrame({key: [], "n": [], **{c: [] for c in out}})]
            for system, rows in batch.groupby("system"):
                rows = rows[rows["n"] >= len(BASES.get(system, ())) + 2]
                if system in BASES and len(rows):
                    done.append(of_system(rows, BASES[system]))
            yield pd.concat(done)[[key, "n", *out]]

    kind = dict(rows.dtypes)[key]
    grouped = base.groupBy(key, "system").agg(*sums).select(key, "system", "n", "y_y", *names, *[f"{p}_y" for p in PAIRS])
    return grouped.mapInPandas(solve, f"{key} {kind}, n bigint, " + ", ".join(f"{c} double" for c in out))


def fit_residuals(rows: DataFrame, fits: DataFrame, key: str = "entry_id") -> DataFrame:
    """The rows with their ``calc`` d and ``dev`` from the fitted cell."""
    joined = rows.join(fits.select(key, *CELL), key)
    return joined.withColumn("calc", d_spacing(_cell(), F.col("h"), F.col("k"), F.col("l"))).withColumn("dev", F.abs(F.col("calc") - F.col("d"))).drop(*CELL)


def trimmed_fit(rows: DataFrame, key: str = "entry_id") -> DataFrame:
    """`fit_cell` with mistyped rows set aside: those off the first fit by more than ten medians and twenty roundings,
    when they are a tenth of the list at most. Adds ``set_aside`` and ``rms``."""
    first = fit_residuals(rows, fit_cell(rows, key), key)
    rounding = 0.5 * F.pow(F.lit(10.0), -F.coalesce(F.col("decimals"), F.lit(3))) if "decimals" in rows.columns else F.lit(0.0005)
    middle = first.groupBy(key).agg(F.median("dev").alias("med"), F.count(F.lit(1)).alias("n_rows"))
    marked = first.join(middle, key).withColumn("off", F.col("dev") > F.greatest(10 * F.col("med"), 20 * rounding))
    counts = marked.groupBy(key).agg(F.count_if("off").alias("n_off"), F.max("n_rows").alias("n_rows"))
    marked = marked.join(counts.select(key, "n_off"), key).where("NOT off OR n_off > 0.1 * n_rows")
    kept = marked.select(*rows.columns)
    fit = fit_cell(kept, key)
    rms = fit_residuals(kept, fit, key).groupBy(key).agg(F.sqrt(F.avg(F.pow("dev", F.lit(2)))).alias("rms"))
    aside = counts.select(key, F.when(F.col("n_off") <= 0.1 * F.col("n_rows"), F.col("n_off")).otherwise(0).alias("set_aside"))
    return fit.join(rms, key).join(aside, key)


def cell_matches(fits: DataFrame, printed: DataFrame, key: str = "entry_id", slack: float = 0.0002) -> DataFrame:
    """Does a printed cell agree with the back-fitted one? The tolerance per parameter is three quarters of its last
    printed digit, three fit uncertainties, or `slack` of its size. `printed`: key, p_a … p_ga, d_a … d_ga (decimals)."""
    rows = fits.join(printed, key)
    tests, devs = [], []
    for n, c in enumerate(CELL):
        dev = F.abs(F.col(c) - F.col(f"p_{c}"))
        tol = F.greatest(0.75 * F.pow(F.lit(10.0), -F.coalesce(F.col(f"d_{c}"), F.lit(3))), 3 * F.col(f"s_{c}"), slack * F.col(f"p_{c}"))
        right = (F.abs(F.col(f"p_{c}") - 90) < 1e-6) & (F.abs(F.col(c) - 90) < 0.05) if n >= 3 else F.lit(False)
        tests.append(F.when(right, True).otherwise(dev <= tol))
        devs.append(F.when(right, 0.0).otherwise(dev / F.col(f"p_{c}")))
    ok = tests[0]
    for t in tests[1:]:
        ok = ok & t
    return rows.select(key, ok.alias("matches"), F.greatest(*devs).alias("worst"))
