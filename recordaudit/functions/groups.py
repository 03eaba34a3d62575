"""Which chemical groups a formula holds, by a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recordaudit.functions.measured import let

# A group, how a formula writes it, what speaks against it, and whether the formula must hold oxygen.
GROUPS = (
    ("UO2", "UO2", "^UO2$", False), ("SO4", "SO4", "", False), ("PO4", r"PO4|PO3OH|PO3\(OH\)|PO2\(OH\)2|PO3F", "", False),
    ("P-OH", r"PO3OH|PO3\(OH\)|PO2\(OH\)2|H2?PO4", "", False), ("AsO4", r"AsO4|AsO3OH|AsO3\(OH\)|AsO2\(OH\)2", "", False),
    ("As-OH", r"AsO3OH|AsO3\(OH\)|AsO2\(OH\)2|H2?AsO4", "", False), ("AsO3", r"AsO3(?!OH|\(OH\))", "", False), ("VO4", "VO4", "", False),
    ("V-O", "V(?![a-z])", "VO4", True), ("SiO4", "SiO4", "", False), ("Si-O", "Si(?![a-z])", "SiO4", True), ("CO3", "CO3", "", False), ("C2O4", "C2O4", "", False),
    ("NO3", "NO3", "", False), ("BO3", "B(?![a-z])", r"BO4|B\(OH\)4", True), ("BO4", "B(?![a-z])", r"BO3(?![\dO])", True), ("MoO4", "MoO4", "", False),
    ("Mo-O", "Mo(?![a-z])", "MoO4", True), ("WO4", "WO4", "", False), ("W-O", "W(?![a-z])", "WO4", True), ("Ti-O", "Ti(?![a-z])", "", True),
    ("Nb-O", "Nb|Ta(?![a-z])", "", True), ("CrO4", "CrO4", "", False), ("SeO4", "SeO4", "", False), ("SeO3", "SeO3", "", False), ("TeO3", "TeO3", "", False),
    ("TeO6", r"TeO6|Te\(OH\)6", "", False), ("IO3", "IO3", "", False), ("SO3", r"SO3(?!S|OH|\(OH\))", "", False), ("NH4", "NH4", "", False),
    ("H3O", "H3O", "", False), ("H2O", "H2O", "", False),
)
# Valences that tell two groups apart which the bare formula does not, and what makes a formula without oxygen a sulfide.
SHOWN_BY, DENIED_BY = {"TeO6": r"Te6\+"}, {"AsO3": r"As5\+"}
SULFIDES = ("S", "Se", "Te", "As", "Sb", "Bi")
_MINOR = r"0?\.(?:[01]\d*|2(?:[0-4]\d*)?)(?!\d)"  # a coefficient under a quarter
_BRACKET = r"[(\[{](?:[^()\[\]{}]|[(\[{][^()\[\]{}]*[)\]}])*[)\]}]"


def bare_formula(formula: Column) -> Column:
    """A formula without markup, spaces and empty sites, its subscripts as digits; valences stay."""
    plain = F.translate(F.coalesce(formula, F.lit("")), "₀₁₂₃₄₅₆₇₈₉−", "0123456789-")
    return F.regexp_replace(plain, r"<[^>]+>|&#?\w+;|[\s\x00-\x1f□◻]", "")


def _dominant(site: Column) -> Column:
    """A mixed site before its oxygens, as its most frequent atom with them: (Se0.8S0.2)O4 is (SeO4)."""
    inner = F.regexp_extract(site, r"^\(([^()]*)\)", 1)
    atoms = F.transform(F.regexp_extract_all(inner, F.lit(r"[A-Z][a-z]?[\d.]*"), F.lit(0)), lambda a: F.struct(
        F.coalesce(F.regexp_extract(a, r"([\d.]+)$", 1).try_cast("double"), F.lit(1.0)).alias("n"), F.regexp_extract(a, r"^([A-Z][a-z]?)", 1).alias("element")))
    return F.when(F.size(atoms) > 1, F.concat(F.lit("("), F.array_max(atoms)["element"], F.lit("O"), F.substring(site, -1, 1), F.lit(")"))).otherwise(site)


def _major(bare: Column) -> Column:
    """The bare formula without valences, its mixed sites resolved, and without what it writes with a coefficient under a quarter."""
    plain = F.regexp_replace(bare, r"(?<=[A-Za-z])\d\+|(?<=[A-Za-z])\d-(?![\dx])", "")
    sites = F.regexp_extract_all(plain, F.lit(r"\([^()]*\)(?:Σ[\d.]+)?\)?O[34]"), F.lit(0))
    solved = F.aggregate(sites, plain, lambda f, site: F.replace(f, site, _dominant(site)))
    return F.regexp_replace(F.regexp_replace(solved, _BRACKET + _MINOR, ""), r"[A-Z][a-z]?" + _MINOR, "")


def groups_of(formula: Column) -> Column:
    """``array<string>`` of the groups a formula holds, in the order of the table; null and empty formulas hold none."""

    def judged(bare: Column) -> Column:
        def rules(f: Column) -> Column:
            elements = F.regexp_extract_all(f, F.lit("[A-Z][a-z]?"), F.lit(0))
            oxygen = F.array_contains(elements, "O")
            found = []
            for key, shown, against, with_o in GROUPS:
                hit = f.rlike(shown) | bare.rlike(SHOWN_BY[key]) if key in SHOWN_BY else f.rlike(shown)
                hit = hit & ~f.rlike(against) if against else hit
                hit = hit & ~bare.rlike(DENIED_BY[key]) if key in DENIED_BY else hit
                found.append(F.when(hit & oxygen if with_o else hit, key))
            rest = F.regexp_replace(f, "H2O|H3O", "")
            found.append(F.when(F.contains(rest, F.lit("OH")), "OH"))
            found.append(F.when(~oxygen & F.arrays_overlap(elements, F.array(*[F.lit(e) for e in SULFIDES])), "sulfide"))
            return F.array_compact(F.array(*found))

        return let(_major(bare), rules)

    return let(bare_formula(formula), judged)
