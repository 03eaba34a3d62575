"""Named queries over the rule pack: an entry per order, its reflection list from the order's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordaudit.operators import formulas as Y
from recordaudit.plans.matching import INTENSITY_OUTLIERS, MISSING_LINES, _lists
from recordaudit.plans.registry import ORACLES, query
from recordaudit.plans.structures import operator_rows
from recordaudit.plans.views import other_sql, spark_sql, spread, spread_sql
from recordaudit.rules import pack as P
from recordaudit.rules import phrases as W
from recordaudit.rules.engine import run_rules

ENTRIES = """
SELECT k AS entry_id, CASE k % 6 WHEN 0 THEN 'Alphaite' WHEN 1 THEN 'Betaite-(Ce)' WHEN 2 THEN 'Gammaite-2M' WHEN 3 THEN 'Deltaite-syn' WHEN 4 THEN 'Epsilonite' ELSE 'Zetaite' END AS name,
  CASE k % 7 WHEN 0 THEN 'Alpha  ite' WHEN 1 THEN 'Betaite-Ce' WHEN 2 THEN 'Deltaite, synthetic' ELSE 'Zetaite' END AS primary_name, CASE k % 3 WHEN 0 THEN 'Natural' ELSE 'Synthetic' END AS class, CASE k % 4 WHEN 0 THEN 'Synthetic' ELSE 'Rock-forming' END AS subclass,
  CASE k % 5 WHEN 0 THEN 'CaMgSi2O6' WHEN 1 THEN 'Ce0.6La0.4PO4' WHEN 2 THEN 'FeSO4H8O4' WHEN 3 THEN 'Ca(Mg' ELSE 'NaCl' END AS chemical, CASE c % 4 WHEN 0 THEN 'CaMgSi2O6' WHEN 1 THEN 'Ce0.4La0.6PO4' WHEN 2 THEN 'FeSO4' ELSE 'Mg05Si' END AS empirical,
  CASE k % 6 WHEN 0 THEN 'Anorthic' WHEN 1 THEN 'Monoclinic' WHEN 2 THEN 'Orthorhombic' WHEN 3 THEN 'Tetragonal' WHEN 4 THEN 'Hexagonal' ELSE 'Cubic' END AS crystal_system,
  CASE c % 6 WHEN 0 THEN 'P -1' WHEN 1 THEN 'P 21/c' WHEN 2 THEN 'P n m a' WHEN 3 THEN 'P 42/m n m' WHEN 4 THEN 'P 63/m' ELSE 'F m -3 m' END AS space_group,
  CASE c % 3 WHEN 0 THEN '5.120' ELSE '5.120(3)' END AS cell_a, CASE c % 5 WHEN 0 THEN '5.121(3)' ELSE '5.120(3)' END AS cell_b, CASE c % 7 WHEN 0 THEN '7.250' WHEN 1 THEN '5.12' ELSE '5.120(3)' END AS cell_c,
  '90' AS cell_al, CASE k % 8 WHEN 0 THEN '91.2(1)' ELSE '90' END AS cell_be, CASE c % 4 WHEN 0 THEN '120' ELSE '90' END AS cell_ga, CAST(1 + k % 4 AS DOUBLE) AS z,
  CASE k % 7 WHEN 0 THEN 'CuKa1' WHEN 1 THEN 'Cu Kα' WHEN 2 THEN 'MoKα' WHEN 3 THEN 'CoKα (Fe filter)' WHEN 4 THEN 'Sync' WHEN 5 THEN 'Copper' ELSE '' END AS anode, CASE c % 4 WHEN 0 THEN '1.540598' WHEN 1 THEN '1.5418' WHEN 2 THEN '0.7107' ELSE '1.7902' END AS lam,
  CASE c % 6 WHEN 0 THEN 'Diffractometer' WHEN 1 THEN 'Calculated' WHEN 2 THEN 'Other' WHEN 3 THEN '' WHEN 4 THEN 'Gandolfi' ELSE 'Difractometer' END AS spacing_instr, 'Diffractometer' AS intensity_instr,
  CASE k % 4 WHEN 0 THEN 'Integrated' WHEN 1 THEN 'Peak' WHEN 2 THEN '' ELSE 'Integratd' END AS intensity_type, CASE k % 3 WHEN 0 THEN 'Beta-Filter' WHEN 1 THEN 'Monochromator Crystal' ELSE '' END AS filter, CASE c % 3 WHEN 0 THEN 'Ni' WHEN 1 THEN 'Graph' ELSE 'Fe' END AS filter_type,
  concat('A=1.', CAST(600 + c % 10 AS STRING), ' B=1.', CAST(620 + k % 25 AS STRING), ' Q=1.', CAST(650 + c % 7 AS STRING), ' Sign=', CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END, ' 2V=', CAST(c % 90 AS STRING)) AS optical,
  CASE c % 3 WHEN 0 THEN '2012-083' WHEN 1 THEN '' ELSE '2011-070' END AS ima, CASE k % 5 WHEN 0 THEN '' ELSE concat('Average of ', CAST(2 + c % 6 AS STRING), '. Total ', CAST(90 + c % 17 AS STRING), '.50') END AS analysis,
  CASE c % 5 WHEN 0 THEN '293 K' WHEN 1 THEN '100 K' WHEN 2 THEN '-50 °C' ELSE '' END AS temperature, CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(300 + c % 50 AS DOUBLE) / 100 END AS dx, CAST(300 + k % 700 AS DOUBLE) / 100 AS xtl_dx,
  CASE WHEN c % 8 = 0 THEN '' ELSE 'S' END AS quality_mark, CASE k % 4 WHEN 0 THEN 'A New Mineral From Somewhere' ELSE 'A new mineral from Somewhere' END AS title,
  concat('The new mineral Alphaite (IMA 2012-083) comes from Somewhere. Powder data were collected on a diffractometer with a graphite monochromator at 100 K. It is optically positive. Mean of 5 microprobe analyses is given; a new crystal and a mineral from afar. Dcalc = 3.20 g/cm3, λ = ', CASE WHEN c % 2 = 0 THEN '0.7107' ELSE '1.5418' END, ' Å.') AS text,
  CAST(512 AS DOUBLE) / 100 AS cif_a, CAST(CASE WHEN c % 5 = 1 THEN 725 ELSE 512 END AS DOUBLE) / 100 AS cif_b, CAST(512 AS DOUBLE) / 100 AS cif_c, CAST(4 AS DOUBLE) AS cif_z, 'CaMgSi2O6' AS cif_formula, CAST(16003 + k % 60 * 10 AS DOUBLE) / 10000 AS n_paper, k, c
FROM (SELECT o_orderkey AS k, o_custkey AS c FROM {orders}) o"""
E_SQL = f"e AS ({other_sql(ENTRIES)})"


def _entries(spark, sf):
    comments = F.create_map(F.lit("Habit"), F.lit("tabular"), F.lit("General"), F.when(F.col("c") % 2 == 0, "CaO 20 wt.%").otherwise("none"))
    return P.prepare(P.derive(spread(spark_sql(spark, sf, ENTRIES)).withColumn("comments", comments)))


def _code(spark, sf, *codes, anchor=None):
    rules = [r for r in P.ENTRY_RULES if r.code in codes and (anchor is None or r.anchor == anchor)]
    return run_rules(_entries(spark, sf), rules)


def _counts(df):
    return df.groupBy("code", "sev").agg(F.count(F.lit(1)).alias("n"), F.sum("entry_id").alias("ids"))


def _sql(*parts):
    """Parts: (code, severity, condition) each over the entries."""
    union = " UNION ALL ".join(f"SELECT '{c}' AS code, '{s}' AS sev, k FROM x WHERE {w}" for c, s, w in parts)
    return f"SELECT code, sev, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids FROM ({union}) GROUP BY 1, 2"


CANON = "CASE k % 7 WHEN 0 THEN 'cu' WHEN 1 THEN 'cu' WHEN 2 THEN 'mo' WHEN 3 THEN 'co' WHEN 5 THEN 'cu' END"
OFFS = " ".join(f"WHEN el = '{a}' THEN least({', '.join(f'abs(lv - {v})' for v in P.CANONICAL[a])})" for a in ("cu", "mo", "co"))


@query("rule_wavelength", f"WITH {E_SQL}, y AS (SELECT *, {CANON} AS el, CAST(lam AS DOUBLE) AS lv FROM e), x AS (SELECT *, CASE {OFFS} END AS off FROM y) " + _sql(("wavelength", "flag", "off > 0.0006"), ("wavelength", "note", "off <= 0.0006 AND k % 7 = 0 AND abs(lv - 1.541874) = off")))
def _(spark, sf):
    return _counts(_code(spark, sf, "wavelength"))


@query("rule_synthetic", f"WITH {E_SQL}, x AS (SELECT *, regexp_matches(name || ' ' || primary_name, '(?i)-\\s*syn\\b|\\bsyn\\b|synthetic') AS syn FROM e) " + _sql(("synthetic", "flag", "syn AND class = 'Natural'"), ("synthetic", "note", "class = 'Synthetic' AND subclass = 'Synthetic' AND NOT syn")))
def _(spark, sf):
    return _counts(_code(spark, sf, "synthetic"))


@query("rule_symmetry", f"""WITH {E_SQL}, x AS (SELECT *, k % 6 AS s, c % 3 = 0 AS na, CASE WHEN c % 5 = 0 THEN 1 ELSE 0 END AS b1, c % 7 AS cc, k % 6 = 4 AND k % 8 <> 0 AND c % 4 <> 0 AND c % 5 <> 0 AND c % 7 <> 0 AS rh FROM e) """ + _sql(
    ("symmetry", "flag", "s IN (3, 4) AND CASE WHEN rh THEN na OR cc = 1 ELSE na OR b1 = 1 END"), ("symmetry", "flag", "s = 5 AND (na OR b1 = 1 OR cc IN (0, 1))"),
    ("symmetry", "flag", "s IN (2, 3, 4, 5) AND k % 8 = 0"), ("symmetry", "flag", "s IN (2, 3, 4, 5) AND k % 8 = 0"), ("symmetry", "flag", "(s = 4 AND c % 4 <> 0 AND NOT rh) OR (s IN (1, 2, 3, 5) AND c % 4 = 0)")))
def _(spark, sf):
    return _counts(_code(spark, sf, "symmetry"))


@query("rule_precision", f"WITH {E_SQL}, x AS (SELECT * FROM e) " + _sql(("precision", "flag", "c % 3 = 0"), ("precision", "flag", "c % 7 = 0")))
def _(spark, sf):
    return _counts(_code(spark, sf, "precision"))


@query("rule_sg_system", f"WITH {E_SQL}, x AS (SELECT * FROM e) " + _sql(("sg_system", "flag", "k % 6 <> c % 6")))
def _(spark, sf):
    return _counts(_code(spark, sf, "sg_system"))


@query("rule_optics", f"""WITH {E_SQL}, v AS (SELECT *, 1 + (600 + c % 10) / 1000.0 AS a, 1 + (620 + k % 25) / 1000.0 AS b, 1 + (650 + c % 7) / 1000.0 AS q FROM e), w AS (SELECT *, CAST(a AS DOUBLE) AS x1, CAST(b AS DOUBLE) AS x2, CAST(q AS DOUBLE) AS x3 FROM v WHERE b - a >= 0.004 AND q - b >= 0.004),
 t AS (SELECT *, 2 * degrees(acos(sqrt(least(greatest((1 / (x2 * x2) - 1 / (x3 * x3)) / (1 / (x1 * x1) - 1 / (x3 * x3)), 0), 1)))) AS vz FROM w), x AS (SELECT * FROM t) """ + _sql(
    ("optical", "flag", "abs(vz - 90) >= 18 AND (k % 2 = 0) <> (vz < 90)"), ("optical", "flag", "abs(least(vz, 180 - vz) - c % 90) > 30")))
def _(spark, sf):
    rules = [r for r in P.ENTRY_RULES if r.code == "optical"][1:3]
    return _counts(run_rules(_entries(spark, sf), rules))


@query("rule_optic_sign_text", f"WITH {E_SQL}, x AS (SELECT * FROM e) " + _sql(("optical", "flag", "k % 2 = 1")))
def _(spark, sf):
    return _counts(run_rules(_entries(spark, sf), [r for r in P.ENTRY_RULES if r.code == "optical"][:1]))


RATIOS_SQL = ", ".join(f"{p}.0/{q}" for p in (1, 2, 3, 4, 6, 8) for q in (1, 2, 3, 4, 6, 8) if p != q)


@query("rule_density_ratio", f"""WITH {E_SQL}, y AS (SELECT *, xtl_dx / dx AS r FROM e WHERE dx IS NOT NULL), x AS (SELECT *, abs(r - 1) AS dev, len(list_filter([{RATIOS_SQL}], lambda f: abs(r - f) <= 0.04 * f)) > 0 AS simple FROM y) """ + _sql(
    ("xtl_density", "flag", "dev >= 0.12 AND ((simple AND dev >= 0.25) OR dev >= 0.30)"), ("xtl_density", "note", "dev >= 0.12 AND NOT ((simple AND dev >= 0.25) OR dev >= 0.30)")))
def _(spark, sf):
    return _counts(_code(spark, sf, "xtl_density"))


@query("rule_temperature", f"WITH {E_SQL}, x AS (SELECT * FROM e) " + _sql(("temperature", "flag", "c % 5 = 2")))
def _(spark, sf):
    return _counts(_code(spark, sf, "temperature"))


@query("rule_analysis", f"WITH {E_SQL}, x AS (SELECT *, 90 + c % 17 + 0.5 AS t FROM e) " + _sql(("analysis", "flag", "k % 5 > 0 AND (t < 94 OR t > 103)"), ("analysis", "flag", "k % 5 > 0 AND 2 + c % 6 <> 5"), ("analysis", "flag", "k % 5 = 0"), ("misplaced_analysis", "flag", "k % 5 = 0 AND c % 2 = 0")))
def _(spark, sf):
    return _counts(_code(spark, sf, "analysis", "misplaced_analysis"))


@query("rule_registration", f"WITH {E_SQL}, x AS (SELECT * FROM e) " + _sql(("ima", "flag", "k % 6 = 0 AND c % 3 = 2"), ("ima", "flag", "c % 3 = 1 AND k % 6 = 0")))
def _(spark, sf):
    return _counts(_code(spark, sf, "ima"))


@query("rule_vocabulary", f"WITH {E_SQL}, x AS (SELECT * FROM e) " + _sql(
    ("instr_vocab", "flag", "c % 6 = 5"), ("instr_vocab", "flag", "k % 4 = 3"), ("instr_vocab", "flag", "k % 3 = 0 AND CASE k % 7 WHEN 0 THEN 'Ni' WHEN 1 THEN 'Ni' WHEN 5 THEN 'Ni' WHEN 2 THEN 'Zr' WHEN 3 THEN 'Fe' END <> filter_type"),
    ("instr_vocab", "note", "k % 3 = 1 AND c % 3 <> 1"), ("instr_vocab", "flag", "c % 6 IN (0, 4) AND k % 7 = 6"), ("instr_vocab", "flag", "c % 6 IN (0, 4) AND k % 4 = 2")))
def _(spark, sf):
    return _counts(_code(spark, sf, "instr_vocab"))


@query("rule_instrument_text", f"WITH {E_SQL}, x AS (SELECT * FROM e) " + _sql(("instr_class", "flag", "c % 6 IN (2, 3)"), ("instr_filter", "flag", "k % 3 = 2")))
def _(spark, sf):
    return _counts(_code(spark, sf, "instr_filter").unionByName(W.claim_findings(_entries(spark, sf))))


# what a text says, put together from sentences that differ by entry
SAID = """
SELECT o_orderkey AS entry_id, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Other' WHEN 2 THEN 'Diffractometer' ELSE 'Calculated' END AS spacing_instr, CASE o_custkey % 3 WHEN 0 THEN 'Other' ELSE 'Film' END AS intensity_instr,
  concat_ws(' ', CASE o_orderkey % 5 WHEN 0 THEN 'Powder X-ray diffraction data were collected on an R-AXIS Rapid II.' WHEN 1 THEN 'The PXRD pattern was recorded with the same diffractometer.' WHEN 2 THEN 'A capillary was used for the diffraction experiment.'
      WHEN 3 THEN 'Powder data calculated from the single-crystal diffractometer data were obtained.' ELSE 'Neutron powder diffraction should be measured in future.' END,
    CASE o_custkey % 7 WHEN 0 THEN 'The unit-cell parameters were not refined.' WHEN 1 THEN 'Lattice constants taken from the single-crystal study were used.' WHEN 2 THEN 'These agree with the unit cell derived from single-crystal data.' WHEN 3 THEN 'The density was obtained with the cell from SAED.'
      WHEN 4 THEN 'Atom displacement parameters were not refined in this lattice.' WHEN 5 THEN 'The cell dimensions come from single crystal data.' ELSE 'Nothing is said here.' END,
    CASE (o_orderkey + o_custkey) % 6 WHEN 0 THEN 'The powder pattern was calculated from the crystal structure.' WHEN 1 THEN 'A powder pattern simulated with atomic coordinates matches the observed one.' WHEN 2 THEN 'X-ray powder diffraction data were not collected.'
      WHEN 3 THEN 'Unit-cell parameters refined from the powder data by Le Bail fitting are given.' WHEN 4 THEN 'The theoretical powder pattern was computed from the CIF.' ELSE 'The colour is white.' END) AS text FROM {orders}"""


def _claims_sql() -> str:
    """The claims over the same lexicon, sentence by sentence: a phrase stands in a sentence as a run of stems."""
    rows = ", ".join(f"('{role}', '{phrase}')" for role, phrases in W.LEXICON.items() for phrase in phrases)
    stem = lambda words: f"array_to_string(list_transform(list_filter(regexp_split_to_array(lower({words}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^([a-z0-9]*?[a-z]{{4}})(?:{'|'.join(W.ENDINGS)})$', '\\1')), ' ')"
    low = lambda c: f"lower(trim(coalesce({c}, '')))"
    has = lambda roles: " AND ".join(f"list_contains(r, '{x}')" for x in roles)
    one = lambda p: "(" + has(p.has) + "".join(f" AND NOT list_contains(r, '{x}')" for x in p.lacks) + ")"
    said = lambda ps: f"len(list_filter(said, lambda r: {' OR '.join(map(one, ps))})) > 0"
    when = (f"{low('spacing_instr')} IN ('', 'other')", f"{low('spacing_instr')} <> 'calculated' AND {low('intensity_instr')} IN ('', 'other')", f"{low('spacing_instr')} IN ('', 'other')", "true",
            *[f"{low('spacing_instr')} <> 'calculated' AND {low('intensity_instr')} <> 'calculated'"] * 2)
    parts = []
    for c, w in zip(W.CLAIMS, when, strict=True):
        quiet = f" AND (NOT {said(c.silenced)}{f' OR {said(c.despite)}' if c.despite else ''})" if c.silenced else ""
        parts.append(f"SELECT '{c.code}' AS code, '{c.sev}' AS sev, '{c.anchor}' AS anchor, entry_id FROM j WHERE {said(c.says)} AND {w}{quiet}")
    return f"""WITH e AS ({other_sql(SAID)}), lex AS (SELECT DISTINCT role, {stem('words')} AS phrase FROM (VALUES {rows}) AS t(role, words)),
 s AS (SELECT entry_id, unnest(regexp_split_to_array(text, '[.!?] ')) AS sentence FROM e), u AS (SELECT sentence, {stem('sentence')} AS st FROM (SELECT DISTINCT sentence FROM s)),
 q AS (SELECT sentence, list(DISTINCT role) AS roles FROM u JOIN lex ON contains(' ' || st || ' ', ' ' || phrase || ' ') GROUP BY sentence), j AS (SELECT e.*, said FROM e JOIN (SELECT entry_id, list(roles) AS said FROM s JOIN q USING (sentence) GROUP BY entry_id) USING (entry_id))
SELECT code, sev, anchor, count(*) AS n, CAST(sum(entry_id) AS BIGINT) AS ids FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"""


@query("rule_phrases", _claims_sql())
def _(spark, sf):
    found = W.claim_findings(spark_sql(spark, sf, SAID))
    return found.groupBy("code", "sev", "anchor").agg(F.count(F.lit(1)).alias("n"), F.sum("entry_id").alias("ids"))


@query("rule_names", f"WITH {E_SQL}, x AS (SELECT * FROM e) " + _sql(
    ("name_formula", "flag", "k % 6 = 1 AND c % 4 = 1"), ("name_formula", "flag", "k % 6 = 2"), ("name_form", "note", "k % 7 IN (0, 1, 2)")))
def _(spark, sf):
    return _counts(_code(spark, sf, "name_formula", "name_form"))


@query("rule_formula", f"WITH {E_SQL}, x AS (SELECT *, CASE k % 5 WHEN 0 THEN ['Ca','Mg','Si','O'] WHEN 1 THEN ['Ce','La','P','O'] WHEN 2 THEN ['Fe','S','O'] WHEN 3 THEN ['Ca','Mg'] ELSE ['Na','Cl'] END AS a, CASE c % 4 WHEN 0 THEN ['Ca','Mg','Si','O'] WHEN 1 THEN ['Ce','La','P','O'] WHEN 2 THEN ['Fe','S','O'] ELSE ['Mg','Si'] END AS b FROM e) " + _sql(
    ("formula", "flag", "k % 5 = 3"), ("formula", "flag", "c % 4 = 3"), ("formula", "note", "len(list_filter(a, lambda v: NOT list_contains(b, v))) > 0")))
def _(spark, sf):
    return _counts(_code(spark, sf, "formula"))


@query("rule_marks_and_titles", f"WITH {E_SQL}, x AS (SELECT * FROM e) " + _sql(("quality_mark", "note", "c % 8 = 0"), ("density_blank", "flag", "k % 9 = 0 AND abs(3.2 - xtl_dx) <= 0.15 * xtl_dx"), ("ref_title_case", "flag", "k % 4 = 0"), ("lambda_stated", "note", "c % 6 = 1 AND c % 4 IN (2, 3) AND CASE c % 4 WHEN 2 THEN c % 2 <> 0 ELSE true END")))
def _(spark, sf):
    return _counts(_code(spark, sf, "quality_mark", "density_blank", "ref_title_case", "lambda_stated"))


@query("rule_mean_index", f"WITH {E_SQL}, x AS (SELECT *, (1 + (600 + c % 10) / 1000.0 + 1 + (620 + k % 25) / 1000.0 + 1 + (650 + c % 7) / 1000.0) / 3 AS m FROM e) " + _sql(("mean_index", "flag", "abs(CAST(m AS DOUBLE) - n_paper) > 0.012")))
def _(spark, sf):
    return _counts(_code(spark, sf, "mean_index"))


@query("rule_cell_sources", f"""WITH {E_SQL}, y AS (SELECT *, [5.12, CASE WHEN c % 5 = 0 THEN 5.121 ELSE 5.12 END, CASE WHEN c % 7 = 0 THEN 7.25 ELSE 5.12 END] AS own, [5.12, CASE WHEN c % 5 = 1 THEN 7.25 ELSE 5.12 END, 5.12] AS ref FROM e),
 g AS (SELECT *, list_sort(own) AS so, list_sort(ref) AS sr FROM y), x AS (SELECT *, greatest(abs(so[1] - sr[1]) / greatest(so[1], sr[1]), abs(so[2] - sr[2]) / greatest(so[2], sr[2]), abs(so[3] - sr[3]) / greatest(so[3], sr[3])) AS sd, greatest(abs(own[1] - ref[1]) / greatest(own[1], ref[1]), abs(own[2] - ref[2]) / greatest(own[2], ref[2]), abs(own[3] - ref[3]) / greatest(own[3], ref[3])) AS dd,
   len(list_filter([greatest(so[1], sr[1]) / least(so[1], sr[1]), greatest(so[2], sr[2]) / least(so[2], sr[2]), greatest(so[3], sr[3]) / least(so[3], sr[3])], lambda r: abs(r - 2) / 2 < 0.05 OR abs(r - 1.5) / 1.5 < 0.05)) > 0 AS rt,
   CASE k % 5 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 0 END * z AS ox, CASE k % 5 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 2 END * z AS ct FROM g) """ + _sql(
    ("cell_cif", "flag", "sd > 0.05 AND NOT rt"), ("cell_order", "flag", "NOT sd > 0.02 AND dd > 0.05"), ("cif_z", "flag", "z <> 4 AND NOT ((ox > 0 AND abs(ox - 24) <= 0.05 * greatest(ox, 24)) OR abs(ct - 16) <= 0.05 * greatest(ct, 16))")))
def _(spark, sf):
    return _counts(_code(spark, sf, "cell_cif", "cell_order", "cif_z"))


# --- rules over reflection lists -------------------------------------------------------------

LINES = """
SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS entry_id, row_number() OVER (PARTITION BY floor(l_orderkey / 4) ORDER BY l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice) AS line_no,
  CAST(9000 + (l_partkey % 300) * 100 AS DOUBLE) / 10000 AS d, floor(l_quantity / CASE WHEN floor(l_orderkey / 4) % 3 = 0 THEN 5 ELSE 1 END) * CASE WHEN floor(l_orderkey / 4) % 3 = 0 THEN 10 WHEN floor(l_orderkey / 4) % 3 = 1 THEN 5 ELSE 1 END AS i,
  CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE CAST(l_suppkey % 4 AS STRING) END AS h, CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE CAST(l_partkey % 3 AS STRING) END AS k, CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE CAST(l_linenumber AS STRING) END AS l,
  CASE WHEN l_discount > 0.08 THEN 'M' ELSE '' END AS flag FROM {lineitem}"""
L_SQL = f"r AS ({other_sql(LINES)})"


@query("rule_indexing", f"""WITH {L_SQL}, t AS (SELECT entry_id, line_no, d, i, CASE WHEN h <> '' THEN CAST(h AS INT) END AS h, CASE WHEN h <> '' THEN CAST(k AS INT) END AS k, CASE WHEN h <> '' THEN CAST(l AS INT) END AS l FROM r WHERE h <> ''),
 c AS (SELECT *, abs(1 / sqrt((h * h + k * k) / power(4.0 + entry_id % 5, 2) + l * l / 36.0) - d) / d AS rel FROM t), s AS (SELECT entry_id, count(*) AS n, count(*) FILTER (WHERE rel > CASE WHEN i <= 35 THEN 0.05 ELSE 0.03 END) AS bad FROM c GROUP BY 1)
SELECT entry_id, 'indexing' AS code, 'flag' AS sev, n, bad FROM s WHERE bad > 0""")
def _(spark, sf):
    lines = spark_sql(spark, sf, LINES)
    side = F.lit(4.0) + F.col("entry_id") % 5
    cells = lines.select("entry_id").distinct().select("entry_id", side.alias("a"), side.alias("b"), F.lit(6.0).alias("c"), *[F.lit(90.0).alias(x) for x in ("al", "be", "ga")])
    found = P.rule_indexing(lines, cells)
    return found.select("entry_id", "code", "sev", F.regexp_extract("msg", r"of (\d+)", 1).cast("bigint").alias("n"), F.regexp_extract("msg", r"^(\d+)", 1).cast("bigint").alias("bad"))


def _list_entries(spark, sf):
    return _entries(spark, sf)


@query("rule_reflection_geometry", f"WITH {L_SQL}, {E_SQL}, m AS (SELECT entry_id, min(d) AS d FROM r GROUP BY 1), j AS (SELECT m.entry_id, d, CAST(lam AS DOUBLE) AS lv FROM m JOIN e ON e.entry_id = m.entry_id WHERE c % 6 <> 1) SELECT entry_id, 'reflection_geom' AS code, 'flag' AS sev FROM j WHERE d < lv / 2 - 1e-6 OR 2 * degrees(asin(least(lv / 2 / d, 1))) > 160")
def _(spark, sf):
    return P.rule_geometry(spark_sql(spark, sf, LINES), _list_entries(spark, sf)).select("entry_id", "code", "sev")


@query("rule_intensity_granularity", f"""WITH {L_SQL}, {E_SQL}, s AS (SELECT entry_id, count(*) AS n, count(DISTINCT floor(i)) AS k, bool_and(floor(i) % 10 = 0) AS tens, bool_and(floor(i) % 5 = 0) AS fives FROM r GROUP BY 1 HAVING count(*) >= 8 AND count(DISTINCT floor(i)) >= 3),
 j AS (SELECT s.*, lower(intensity_type) AS it FROM s JOIN e ON e.entry_id = s.entry_id WHERE c % 6 <> 1 AND intensity_type <> '')
SELECT entry_id, 'intensity_type' AS code, 'flag' AS sev FROM j WHERE tens AND it NOT IN ('peak', 'visual') UNION ALL SELECT entry_id, 'intensity_type', 'note' FROM j WHERE NOT tens AND fives""")
def _(spark, sf):
    return P.rule_granularity(spark_sql(spark, sf, LINES), _list_entries(spark, sf)).select("entry_id", "code", "sev")


@query("rule_blank_indices", f"""WITH {L_SQL}, b AS (SELECT entry_id, d FROM r GROUP BY 1, 2 HAVING count(*) > 1 AND bool_or(h <> '') AND bool_or(h = '') AND NOT bool_or(h <> '' AND flag <> '')) SELECT entry_id, 'hkl_blank' AS code, 'note' AS sev, count(*) AS n FROM b GROUP BY 1""")
def _(spark, sf):
    return P.rule_blank_indices(spark_sql(spark, sf, LINES)).select("entry_id", "code", "sev", F.regexp_extract("msg", r"^(\d+)", 1).cast("bigint").alias("n"))


@query("rule_two_intensities", f"WITH {L_SQL}, {E_SQL}, b AS (SELECT entry_id, d FROM r GROUP BY 1, 2 HAVING count(DISTINCT i) > 1) SELECT b.entry_id, 'same_d' AS code, 'note' AS sev, count(*) AS n FROM b JOIN e ON e.entry_id = b.entry_id WHERE c % 6 IN (0, 4) GROUP BY 1")
def _(spark, sf):
    return P.rule_two_intensities(spark_sql(spark, sf, LINES), _list_entries(spark, sf)).select("entry_id", "code", "sev", F.regexp_extract("msg", r"^(\d+)", 1).cast("bigint").alias("n"))


LISTED = """SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS entry_id, CAST(l_linenumber % 2 AS INT) AS sent_no, CAST(CAST((9000 + (l_partkey % 300) * 100 + CASE WHEN l_suppkey % 9 = 0 THEN 700 ELSE 10 END) / 10000 AS DECIMAL(6,3)) AS STRING) AS d_txt, l_quantity AS i FROM {lineitem}"""


@query("rule_strongest_lines", f"""WITH {L_SQL}, q AS ({other_sql(LISTED)}), w AS (SELECT *, CAST(d_txt AS DOUBLE) AS v, greatest(0.0006, 0.003 * CAST(d_txt AS DOUBLE)) AS tol FROM q),
 j AS (SELECT w.*, EXISTS (SELECT 1 FROM r WHERE r.entry_id = w.entry_id AND r.d BETWEEN w.v - w.tol AND w.v + w.tol) AS hit FROM w), s AS (SELECT entry_id, sent_no, count(*) AS n, count(*) FILTER (WHERE NOT hit) AS miss FROM j GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) FILTER (WHERE NOT hit) <= greatest(1, count(*) // 3)),
 b AS (SELECT entry_id, first(sent_no ORDER BY miss, sent_no) AS sent_no, min(miss) AS m FROM s GROUP BY 1 HAVING min(miss) > 0)
SELECT j.entry_id, 'strongest_lines' AS code, CASE WHEN bool_or(i >= 20) THEN 'flag' ELSE 'note' END AS sev FROM j JOIN b ON b.entry_id = j.entry_id AND b.sent_no = j.sent_no WHERE NOT hit GROUP BY 1""")
def _(spark, sf):
    return P.rule_strongest_lines(spark_sql(spark, sf, LISTED), spark_sql(spark, sf, LINES)).select("entry_id", "code", "sev")


@query("rule_printed_lines", f"""WITH {L_SQL}, ln AS (SELECT entry_id, line_no, format('{{:.4f}}', d) AS d_txt FROM r), tk AS (SELECT DISTINCT entry_id, CASE WHEN line_no % 40 = 3 THEN regexp_replace(d_txt, '^(\\d+\\.)(\\d)(\\d)', '\\1\\3\\2') ELSE d_txt END AS token FROM ln),
 ds AS (SELECT DISTINCT entry_id, d_txt FROM ln), jd AS (SELECT ds.*, EXISTS (SELECT 1 FROM tk WHERE tk.entry_id = ds.entry_id AND rtrim(tk.token, '0') = rtrim(ds.d_txt, '0')) AS hit FROM ds),
 sm AS (SELECT entry_id, count(*) AS n, count(*) FILTER (WHERE NOT hit) AS miss FROM jd GROUP BY 1 HAVING count(*) >= 8 AND count(*) FILTER (WHERE NOT hit) BETWEEN 1 AND CASE WHEN count(*) < 20 THEN 1 ELSE greatest(2, 0.05 * count(*)) END),
 lo AS (SELECT jd.entry_id, d_txt, (SELECT min(token) FROM tk WHERE tk.entry_id = jd.entry_id AND damerau_levenshtein(tk.token, jd.d_txt) = 1) AS near FROM jd JOIN sm USING (entry_id) WHERE NOT hit)
SELECT entry_id, 'reflections' AS code, CASE WHEN bool_or(near IS NOT NULL) THEN 'flag' ELSE 'note' END AS sev, 'not printed in the paper: ' || string_agg(concat_ws(' ← ', d_txt, near), '; ' ORDER BY concat_ws(' ← ', d_txt, near)) AS msg, 'refl' AS anchor FROM lo GROUP BY entry_id""")
def _(spark, sf):
    lines = spark_sql(spark, sf, LINES).select("entry_id", "line_no", F.format_string("%.4f", "d").alias("d_txt"))
    # the paper prints all of the list but one line in forty, that one with two digits swapped
    token = F.when(F.col("line_no") % 40 == 3, F.regexp_replace("d_txt", r"^(\d+\.)(\d)(\d)", "$1$3$2")).otherwise(F.col("d_txt"))
    return P.rule_printed_lines(lines.select("entry_id", "d_txt"), lines.select("entry_id", token.alias("token")))


@query("rule_extinctions", f"""WITH {L_SQL}, t AS (SELECT entry_id, CAST(h AS INT) AS h, CAST(k AS INT) AS k, CAST(l AS INT) AS l FROM r WHERE h <> ''), s AS (SELECT entry_id, count(*) AS n, count(*) FILTER (WHERE (h = 0 AND (k + l) % 2 = 1) OR (k = 0 AND (h + l) % 2 = 1)) AS bad FROM t GROUP BY 1)
SELECT entry_id, 'extinction' AS code, CASE WHEN bad <= greatest(2, 0.1 * n) THEN 'flag' ELSE 'note' END AS sev FROM s WHERE bad > 0 AND n >= 5""")
def _(spark, sf):
    rows = spark_sql(spark, sf, LINES).where("h <> ''").select("entry_id", "line_no", F.lit("P42/mnm").alias("space_group"), *[F.col(x).cast("int").alias(x) for x in "hkl"])
    ops = operator_rows(spark).withColumn("space_group", F.lit("P42/mnm"))
    return P.rule_extinctions(rows, ops).select("entry_id", "code", "sev")


@query("rule_missing_lines", f"SELECT entry_id, 'lines_missing' AS code, min(sev) AS sev, 'absent from the list: ' || string_agg(format('{{:.4f}}', d), '; ' ORDER BY d) AS msg, 'refl' AS anchor FROM ({MISSING_LINES}) GROUP BY entry_id")
def _(spark, sf):
    return P.rule_missing_lines(*_lists(spark, sf))


@query("rule_intensities", f"SELECT entry_id, 'intensity_paper' AS code, 'flag' AS sev, count(*) || ' intensities are not the paper''s; first d = ' || format('{{:.4f}}', min(d)) AS msg, 'refl' AS anchor FROM ({INTENSITY_OUTLIERS}) GROUP BY entry_id")
def _(spark, sf):
    return P.rule_intensities(*_lists(spark, sf))


RADIATIONS = """SELECT l_orderkey AS entry_id, CASE l_suppkey % 4 WHEN 0 THEN 'cu' WHEN 1 THEN 'mo' WHEN 2 THEN 'co' ELSE 'fe' END AS anode, CASE WHEN l_linenumber % 2 = 0 THEN 1.5418 END AS lam, CASE l_returnflag WHEN 'A' THEN 'powder' WHEN 'N' THEN 'single' ELSE 'unknown' END AS context, l_quantity > 40 AS collected FROM {lineitem}"""


@query("radiation_verdict", f"""WITH {E_SQL}, y AS (SELECT entry_id, {CANON} AS el, CAST(lam AS DOUBLE) AS lv, k % 7 = 4 AS syn, c % 6 = 1 AS calc FROM e), q AS ({other_sql(RADIATIONS)}),
 j AS (SELECT q.entry_id, q.anode, CAST(q.lam AS DOUBLE) AS lam, context, collected, el FROM q JOIN y ON y.entry_id = q.entry_id),
 p AS (SELECT entry_id, first(anode ORDER BY NOT collected, coalesce(anode <> el, true), lam IS NULL, anode, lam) AS pa, first(lam ORDER BY NOT collected, coalesce(anode <> el, true), lam IS NULL, anode, lam) AS pl FROM j WHERE context = 'powder' GROUP BY 1),
 a AS (SELECT entry_id, bool_or(coalesce(anode = el, false)) AS am, count(DISTINCT anode) AS k FROM j GROUP BY 1),
 v AS (SELECT y.entry_id, calc, pa, pl, lv, CASE WHEN el IS NULL THEN CASE WHEN syn THEN 'ok' ELSE 'unrec' END WHEN pa IS NOT NULL THEN CASE WHEN pa = el THEN 'ok' ELSE 'flag' END WHEN coalesce(am, false) THEN CASE WHEN a.k = 1 THEN 'ok' ELSE 'verify' END ELSE 'flag' END AS b
   FROM y LEFT JOIN p ON p.entry_id = y.entry_id LEFT JOIN a ON a.entry_id = y.entry_id)
SELECT entry_id, CASE WHEN calc AND b IN ('flag', 'verify') THEN 'calc' ELSE b END AS verdict, pa AS powder_anode, coalesce(abs(pl - lv) > 0.003, false) AS lam_off FROM v""")
def _(spark, sf):
    rads = spark_sql(spark, sf, RADIATIONS).withColumn("lam", F.col("lam").cast("double"))
    return P.radiation_verdict(_entries(spark, sf), rads)


@query("rule_classification", f"WITH {E_SQL} SELECT entry_id, 'classification' AS code, 'info' AS sev FROM e WHERE k % 6 IN (0, 3, 5)")
def _(spark, sf):
    species = spark.sql("SELECT * FROM (VALUES ('alphaite', 'g1'), ('zetaite', 'g2'), ('deltaite', 'g3')) AS t(norm, groupid)")
    groups = spark.sql("SELECT * FROM (VALUES ('g1', 'Alpha group'), ('g2', 'Zeta supergroup'), ('g3', 'Delta group')) AS t(gid, name)")
    return P.rule_classification(_entries(spark, sf), species, groups).select("entry_id", "code", "sev")


@query("rule_exported_record", f"WITH {E_SQL} SELECT entry_id, 'dft' AS code, 'note' AS sev FROM e WHERE k % 10 = 0 OR c % 11 = 0")
def _(spark, sf):
    e = _entries(spark, sf)
    exported = e.select("entry_id", F.upper("name").alias("name"), F.expr("CASE WHEN k % 10 = 0 THEN 'other' ELSE space_group END").alias("space_group"), F.expr("CASE WHEN c % 11 = 0 THEN NULL ELSE lam END").alias("lam"))
    return P.rule_exported(e, exported, ("name", "space_group", "lam")).select("entry_id", "code", "sev")


# the whole pack in one pass, against the SQL of its rules one by one
# --- formulas of one entry against each other ---------------------------------------------------------


def _hundredths(x: str) -> str:
    return f"concat(CAST(CAST(floor({x} / 100) AS BIGINT) AS STRING), '.', lpad(CAST({x} % 100 AS STRING), 2, '0'))"


# coefficients in hundredths, and formulas that print them: bracketed in one field, multiplied out in the other
COEFFICIENTS = """SELECT o_orderkey AS k, o_custkey AS c, 780 + o_orderkey % 30 AS pb, 10 + o_custkey % 9 AS na, 200 + o_orderkey % 7 AS al, 1560 + o_custkey % 120 AS pb2, 200 + o_orderkey % 7 + o_custkey % 23 - 11 AS al2 FROM {orders}"""
FIELDS = f"""SELECT k AS entry_id, 'Analytical' AS field, concat('( Pb', {_hundredths('pb')}, ' Na', {_hundredths('na')}, ' )2 ( Al', {_hundredths('al')}, ' Fe0.77 +2 ) Si8 O27', CASE WHEN k % 9 = 0 THEN ' T B0.06' ELSE '' END, CASE WHEN c % 13 = 0 THEN ' )' ELSE '' END) AS formula FROM ({COEFFICIENTS}) x
UNION ALL SELECT k, 'Analysis', concat('Pb', {_hundredths('pb2')}, ' Na', {_hundredths('2 * na')}, ' Al', {_hundredths('al2')}, CASE WHEN k % 4 = 0 THEN ' Zn0.77' ELSE ' Fe0.77' END, ' Si8 O27') FROM ({COEFFICIENTS}) y
UNION ALL SELECT k, 'Empirical', CASE c % 5 WHEN 0 THEN 'Al2 Fe Na O27 Pb8 S8' WHEN 1 THEN 'Al042 Fe Na Pb8 Si8 O27' ELSE 'Al2 Fe Na O27 Pb8 Si8' END FROM ({COEFFICIENTS}) z"""
NAMED = "SELECT o_orderkey AS entry_id, CASE o_custkey % 6 WHEN 0 THEN 'BAO' WHEN 1 THEN 'k2O' WHEN 2 THEN 'P205' WHEN 3 THEN 'SiO2' WHEN 4 THEN 'Total' ELSE 'CaO' END AS constituent FROM {orders}"
GAPS_SQL = f"""g AS ({other_sql(COEFFICIENTS)}), gaps AS (SELECT k AS entry_id, 'Pb' AS element, 2 * pb AS l, pb2 AS r FROM g UNION ALL SELECT k, 'Na', 2 * na, 2 * na FROM g UNION ALL SELECT k, 'Al', al, al2 FROM g UNION ALL SELECT k, 'Fe', 77, CASE WHEN k % 4 <> 0 THEN 77 END FROM g
 UNION ALL SELECT k, 'Zn', NULL, 77 FROM g WHERE k % 4 = 0 UNION ALL SELECT k, 'B', 6, NULL FROM g WHERE k % 9 = 0), wide AS (SELECT * FROM gaps WHERE l IS NULL OR r IS NULL OR abs(l - r) > greatest(2, 0.03 * greatest(l, r)))"""


@query("formula_coefficients", f"WITH {GAPS_SQL} SELECT entry_id, element, round(l / 100.0::DOUBLE, 6) AS n_left, round(r / 100.0::DOUBLE, 6) AS n_right FROM wide")
def _(spark, sf):
    return Y.coefficient_gaps(spread(spark_sql(spark, sf, FIELDS)), "Analytical", "Analysis")


@query("formula_findings", f"""WITH {GAPS_SQL}, f AS (SELECT DISTINCT entry_id, 'formula' AS code, 'formula:Analytical' AS anchor FROM wide WHERE element <> 'B' UNION ALL SELECT k, 'formula', 'formula:Analytical' FROM g WHERE k % 9 = 0 UNION ALL SELECT k, 'formula', 'formula:Analytical' FROM g WHERE c % 13 = 0
 UNION ALL SELECT k, 'formula', 'formula:Empirical' FROM g WHERE c % 5 IN (0, 1) UNION ALL SELECT k, 'formula', 'formula:Analysis' FROM g WHERE k % 4 = 0 UNION ALL SELECT k, 'analysis', 'analysis' FROM g WHERE c % 6 IN (0, 1, 2))
SELECT code, anchor, count(*) AS n, CAST(sum(entry_id) AS BIGINT) AS ids FROM f GROUP BY ALL""")
def _(spark, sf):
    found = Y.formula_findings(spread_sql(spark, sf, FIELDS), spark_sql(spark, sf, NAMED))
    return found.groupBy("code", "anchor").agg(F.count(F.lit(1)).alias("n"), F.sum("entry_id").alias("ids"))


PACK_SQL = " UNION ALL ".join(f"SELECT code, sev, n FROM ({sql})" for name, sql in ORACLES.items() if name.startswith("rule_") and name != "rule_phrases" and "FROM x WHERE" in sql)


@query("rule_pack", f"SELECT code, sev, CAST(sum(n) AS BIGINT) AS n FROM ({PACK_SQL}) GROUP BY 1, 2")
def _(spark, sf):
    entries = _entries(spark, sf)
    return run_rules(entries, P.ENTRY_RULES).unionByName(W.claim_findings(entries)).groupBy("code", "sev").agg(F.count(F.lit(1)).alias("n"))
