"""Named queries over the composition operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordaudit.functions import elements as E
from recordaudit.operators import composition as C
from recordaudit.plans.registry import query
from recordaudit.plans.views import other_sql, spark_sql, view, with_views

STATS_SQL = """
, stats AS (SELECT sample_id, constituent, coalesce(avg(wt), 0) AS mean, coalesce(stddev_samp(wt), 0) AS sd, coalesce(min(wt), 0) AS lo, coalesce(max(wt), 0) AS hi, count(wt) AS n
  FROM d_probe_points GROUP BY sample_id, constituent),
rows_ AS (SELECT s.*, c.element, c.n_cat, c.n_o, c.charge, c.mw, c.kind, bool_or(c.kind = 'oxide') OVER (PARTITION BY sample_id) AS has_oxide,
   mean / c.mw AS mol, mean / c.mw * c.n_cat AS cations, mean / c.mw * CASE WHEN c.kind = 'oxide' THEN c.n_o WHEN c.kind = 'element-anion' THEN c.n_cat ELSE 1 END AS anions
   FROM stats s JOIN d_constituents c ON c.formula = s.constituent)"""


def red_sql(kind: str, n: float, elements: str = "", src: str = "rows_", out: str = "red") -> str:
    counted = {
        "O": "anions - CASE WHEN kind = 'element-anion' AND has_oxide THEN anions * 0.5 ELSE 0 END",
        "cations": "CASE WHEN element <> 'H' AND kind <> 'element-anion' THEN cations ELSE 0 END",
        "element": f"CASE WHEN element IN ({elements}) THEN cations ELSE 0 END",
    }[kind]
    net = "CASE WHEN kind = 'oxide' AND has_oxide AND ox <> 0 AND hal <> 0 THEN anions * factor * (ox - hal) / ox ELSE anions * factor END" if kind == "O" else "anions * factor"
    return f"""
, {out}_t AS (SELECT *, sum({counted}) OVER (PARTITION BY sample_id) AS t FROM {src}),
{out}_f AS (SELECT *, CASE WHEN t <> 0 THEN {n} / t ELSE 0 END AS factor FROM {out}_t),
{out}_h AS (SELECT *, sum(CASE WHEN kind = 'element-anion' THEN anions * factor * 0.5 ELSE 0 END) OVER (PARTITION BY sample_id) AS hal,
   sum(CASE WHEN kind = 'oxide' THEN anions * factor ELSE 0 END) OVER (PARTITION BY sample_id) AS ox FROM {out}_f),
{out}_o AS (SELECT *, cations * factor AS apfu, {net} AS o_apfu FROM {out}_h),
{out} AS (SELECT *, sum(apfu * charge - CASE WHEN kind IN ('oxide','water') THEN 2 * o_apfu ELSE 0 END) OVER (PARTITION BY sample_id) AS sample_charge,
   sum(CASE WHEN element = 'F' AND has_oxide THEN mean * 15.999 / 18.998 * 0.5 ELSE 0 END) OVER (PARTITION BY sample_id) AS corr, sum(mean) OVER (PARTITION BY sample_id) AS raw_total FROM {out}_o)"""


def _rows(spark, sf):
    return C.with_constituents(C.replicate_stats(view(spark, sf, "d_probe_points")), view(spark, sf, "d_constituents"))


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


SQL_IN = "d_probe_points d_constituents"


@query("replicate_stats", with_views("d_probe_points", """
SELECT sample_id, constituent, round(avg(wt), 6) AS mean, round(coalesce(stddev_samp(wt), 0), 6) AS sd, min(wt) AS lo, max(wt) AS hi, count(wt) AS n FROM d_probe_points GROUP BY sample_id, constituent"""))
def _(spark, sf):
    s = C.replicate_stats(view(spark, sf, "d_probe_points"))
    return s.select("sample_id", "constituent", *_r("mean", "sd"), "lo", "hi", "n")


NORM_OUT = "SELECT sample_id, constituent, round(factor, 6) AS factor, round(apfu, 6) AS apfu, round(o_apfu, 6) AS o_apfu, round(sample_charge, 6) AS sample_charge, round(corr, 6) AS corr, round(raw_total - corr, 6) AS total FROM red"


def _norm(df):
    return df.select("sample_id", "constituent", *_r("factor", "apfu", "o_apfu", "sample_charge", "corr", "total"))


@query("normalise_to_anions", with_views(SQL_IN, STATS_SQL + red_sql("O", 8) + NORM_OUT))
def _(spark, sf):
    return _norm(C.normalise(_rows(spark, sf), C.Basis("O", 8.0)))


@query("normalise_to_cations", with_views(SQL_IN, STATS_SQL + red_sql("cations", 5) + NORM_OUT))
def _(spark, sf):
    return _norm(C.normalise(_rows(spark, sf), C.Basis("cations", 5.0)))


@query("normalise_to_elements", with_views(SQL_IN, STATS_SQL + red_sql("element", 4, "'Si','Al'") + NORM_OUT))
def _(spark, sf):
    return _norm(C.normalise(_rows(spark, sf), C.Basis("element", 4.0, ("Si", "Al"))))


# the loop the closed form stands for, unrolled: forty rounds on both unknowns, from zero
ADDS_SQL = STATS_SQL.replace("FROM d_probe_points GROUP BY", "FROM d_probe_points WHERE constituent NOT IN ('H2O', 'F') GROUP BY") + """
, t AS (SELECT sample_id, sum(CASE WHEN kind = 'oxide' THEN anions ELSE 0 END) AS t0, sum(mean) AS w0 FROM rows_ GROUP BY sample_id),
it AS (SELECT sample_id, t0, w0, 0 AS k, CAST(0 AS DOUBLE) AS f_wt, CAST(0 AS DOUBLE) AS h_wt, 24.0 / t0 AS f FROM t
  UNION ALL SELECT sample_id, t0, w0, k + 1, f_new, h_new, 24.0 / (t0 + f_new / 18.998 * 0.5 + h_new / 18.015) FROM (
    SELECT *, 1.0 * 18.998 / f AS f_new, greatest(0, 100 - (w0 + 1.0 * 18.998 / f - 1.0 * 18.998 / f * 15.999 / 18.998 * 0.5)) AS h_new FROM it WHERE k < 200))
SELECT sample_id, 'F' AS constituent, round(f_wt, 4) AS mean FROM it WHERE k = 200 UNION ALL SELECT sample_id, 'H2O', round(h_wt, 4) FROM it WHERE k = 200"""


@query("add_unmeasured", with_views(SQL_IN, ADDS_SQL, recursive=True))
def _(spark, sf):
    rows = C.with_constituents(
        C.replicate_stats(view(spark, sf, "d_probe_points").where("constituent NOT IN ('H2O', 'F')")), view(spark, sf, "d_constituents")
    )
    adds = [C.Added("F", "F", 1, 0, -1, 18.998, "element-anion", "structure", 1.0), C.Added("H2O", "H", 2, 1, 1, 18.015, "water", "difference")]
    out = C.add_unmeasured(rows, C.Basis("O", 24.0), adds)
    return out.where("constituent IN ('F', 'H2O')").select("sample_id", "constituent", F.round("mean", 4).alias("mean"))


@query("hydrogen_balance", with_views(SQL_IN, STATS_SQL + red_sql("cations", 5, src="(SELECT * FROM rows_ WHERE constituent <> 'H2O')") + """
, s AS (SELECT sample_id, max(factor) AS factor, sum(CASE WHEN element = 'F' THEN apfu ELSE 0 END) AS x, sum(CASE WHEN kind = 'oxide' THEN apfu * charge ELSE 0 END) AS p FROM red GROUP BY sample_id),
h AS (SELECT *, greatest(0, 2 * (12 - x) + x - p) AS h FROM s)
SELECT sample_id, round(factor, 6) AS factor, round(h, 6) AS h_apfu, round(CASE WHEN factor <> 0 THEN h / 2 * 18.015 / factor ELSE 0 END, 4) AS h2o_wt, round(p + h - x - 2 * (12 - x), 6) AS charge FROM h"""))
def _(spark, sf):
    rows = _rows(spark, sf).where("constituent <> 'H2O'")
    b = C.hydrogen_balance(C.normalise(rows, C.Basis("cations", 5.0)), 12.0)
    return b.select("sample_id", *_r("factor", "h_apfu"), F.round("h2o_wt", 4).alias("h2o_wt"), *_r("charge"))


@query("iron_balance", with_views(SQL_IN, STATS_SQL + red_sql("cations", 5) + """
, s AS (SELECT sample_id, sum(CASE WHEN element = 'F' THEN apfu ELSE 0 END) AS x, sum(CASE WHEN kind IN ('oxide', 'water') THEN apfu * charge ELSE 0 END) AS p,
   sum(CASE WHEN element = 'Fe' THEN apfu ELSE 0 END) AS fe, sum(CASE WHEN element = 'Fe' THEN mean ELSE 0 END) AS feo FROM red GROUP BY sample_id HAVING sum(CASE WHEN element = 'Fe' THEN apfu ELSE 0 END) > 0),
c AS (SELECT *, p - (2 * (8 - x) + x) AS c0 FROM s), g AS (SELECT *, least(1, greatest(0, -c0 / fe)) AS r FROM c)
SELECT sample_id, round(r, 6) AS ferric, round(fe * (1 - r), 6) AS fe2_apfu, round(fe * r, 6) AS fe3_apfu, round(feo * (1 - r), 6) AS feo_wt, round(feo * r * (159.687 / (2 * 71.844)), 6) AS fe2o3_wt, round(c0 + r * fe, 6) AS charge FROM g"""))
def _(spark, sf):
    b = C.iron_balance(C.normalise(_rows(spark, sf), C.Basis("cations", 5.0)), 8.0)
    return b.select("sample_id", *_r("ferric", "fe2_apfu", "fe3_apfu", "feo_wt", "fe2o3_wt", "charge"))


def _fmt(v):
    return f"regexp_replace(format('{{:.2f}}', {v}), '\\.?0+$', '')"


@query("empirical_formula", with_views(SQL_IN, STATS_SQL + red_sql("O", 8) + f"""
SELECT sample_id, coalesce(string_agg(element || CASE WHEN {_fmt('apfu')} = '1' THEN '' ELSE {_fmt('apfu')} END, '' ORDER BY constituent) FILTER (WHERE kind = 'oxide'), '')
  || CASE WHEN sum(CASE WHEN kind = 'oxide' THEN o_apfu ELSE 0 END) <> 0 THEN 'O' || {_fmt("sum(CASE WHEN kind = 'oxide' THEN o_apfu ELSE 0 END)")} ELSE '' END
  || coalesce(string_agg(element || {_fmt('apfu')}, '' ORDER BY constituent) FILTER (WHERE kind = 'element-anion'), '')
  || CASE WHEN sum(CASE WHEN kind = 'water' THEN apfu / 2 ELSE 0 END) <> 0 THEN '·' || {_fmt("sum(CASE WHEN kind = 'water' THEN apfu / 2 ELSE 0 END)")} || 'H2O' ELSE '' END AS formula
FROM red GROUP BY sample_id"""))
def _(spark, sf):
    return C.empirical_formula(C.normalise(_rows(spark, sf), C.Basis("O", 8.0)))


@query("published_table", with_views(SQL_IN, STATS_SQL + red_sql("O", 8) + """
SELECT sample_id, constituent, round(mean, 2) AS mean, CASE WHEN n >= 2 THEN round(lo, 2) END AS lo, CASE WHEN n >= 2 THEN round(hi, 2) END AS hi,
  CASE WHEN n >= 2 THEN round(sd, 2) END AS sd, round(mean / (raw_total - corr) * 100, 2) AS normalised FROM red"""))
def _(spark, sf):
    return C.published_table(C.normalise(_rows(spark, sf), C.Basis("O", 8.0)))


IDEAL = "SELECT l_orderkey AS sample_id, CASE l_linenumber WHEN 1 THEN 'SiO2' WHEN 2 THEN 'Al2O3' WHEN 3 THEN 'CaO' WHEN 4 THEN 'MgO' WHEN 5 THEN 'FeO' WHEN 6 THEN 'F' ELSE 'H2O' END AS constituent, max(1 + l_partkey % 6) * 1.0 AS apfu FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


@query("ideal_weight_percent", with_views("d_constituents", f"""
, i AS ({other_sql(IDEAL)}), m AS (SELECT sample_id, constituent, kind, element, n_o, CASE WHEN kind = 'water' THEN CAST(apfu AS DOUBLE) ELSE CAST(apfu AS DOUBLE) / n_cat END AS u, mw, CAST(apfu AS DOUBLE) AS a FROM i JOIN d_constituents c ON c.formula = i.constituent),
s AS (SELECT *, u * mw AS mass, sum(u * mw) OVER w AS tot, sum(CASE WHEN element = 'F' THEN a * 15.999 / 2 ELSE 0 END) OVER w AS hal, sum(CASE WHEN kind = 'oxide' THEN u * n_o * 15.999 ELSE 0 END) OVER w AS ox FROM m WINDOW w AS (PARTITION BY sample_id))
SELECT sample_id, constituent, round(mass / (tot - least(hal, ox)) * 100, 6) AS wt FROM s UNION ALL
SELECT DISTINCT sample_id, 'O=F,Cl', round(-least(hal, ox) / (tot - least(hal, ox)) * 100, 6) FROM s WHERE least(hal, ox) > 0"""))
def _(spark, sf):
    apfu = spark_sql(spark, sf, IDEAL).withColumn("apfu", F.col("apfu").cast("double"))
    return C.ideal_weight_percent(apfu, view(spark, sf, "d_constituents")).withColumn("wt", F.round("wt", 6))


# fixed values: refractive constants of the constituents in the test view
GD = "SELECT * FROM (VALUES ('SiO2', 0.208D), ('Al2O3', 0.207D), ('CaO', 0.21D), ('MgO', 0.2D), ('F', 0.047D), ('H2O', 0.34D)) AS t(constituent, k)"
OPTICS = "SELECT o_orderkey AS sample_id, 1.5 + (o_custkey % 200) / 1000.0D AS n_mean, 2.0 + (o_custkey % 170) / 100.0D AS density FROM {orders}"


@query("compatibility_index", with_views("d_probe_points", f"""
, w AS (SELECT sample_id, constituent, avg(wt) AS wt FROM d_probe_points GROUP BY ALL), g AS ({GD.replace('D)', ')')}), o AS ({other_sql(OPTICS).replace('0.0D', '0.0')}),
c AS (SELECT sample_id, CAST(sum(CAST(coalesce(CAST(k AS DOUBLE), 0) * wt / 100 AS DECIMAL(28,12))) AS DOUBLE) AS kc, coalesce(string_agg(CASE WHEN k IS NULL THEN w.constituent END, ','), '') AS missing FROM w LEFT JOIN g ON g.constituent = w.constituent GROUP BY sample_id),
r AS (SELECT c.sample_id, kc, missing, (CAST(n_mean AS DOUBLE) - 1) / CAST(density AS DOUBLE) AS kp FROM c JOIN o ON o.sample_id = c.sample_id), q AS (SELECT *, CASE WHEN kc <> 0 THEN 1 - kp / kc END AS ci FROM r)
SELECT sample_id, CAST(round(CAST(kc AS DECIMAL(20,10)), 6) AS DOUBLE) AS kc, CAST(round(CAST(kp AS DECIMAL(20,10)), 6) AS DOUBLE) AS kp, CAST(round(CAST(ci AS DECIMAL(20,10)), 6) AS DOUBLE) AS ci, CASE WHEN abs(ci) < 0.02 THEN 'superior' WHEN abs(ci) < 0.04 THEN 'excellent' WHEN abs(ci) < 0.06 THEN 'good' WHEN abs(ci) < 0.08 THEN 'fair' ELSE 'poor' END AS category, missing FROM q"""))
def _(spark, sf):
    weights = view(spark, sf, "d_probe_points").groupBy("sample_id", "constituent").agg(F.avg("wt").alias("wt"))
    optics = spark_sql(spark, sf, OPTICS).select("sample_id", F.col("n_mean").cast("double").alias("n_mean"), F.col("density").cast("double").alias("density"))
    ci = C.compatibility_index(weights, optics, spark.sql(GD))
    # rounded as decimals, so that a last bit of the double cannot fall on either side of a half
    return ci.select("sample_id", *[F.round(F.col(c).cast("decimal(20,10)"), 6).cast("double").alias(c) for c in ("kc", "kp", "ci")], "category", "missing")


# published coefficients: the reduction on a basis of six to nine anions, one coefliicient in eleven off by a tenth
PUB_SQL = STATS_SQL + red_sql("O", 1) + """
, pub AS (SELECT sample_id, element, round(sum(apfu) * (6 + sample_id % 4) * CASE WHEN sample_id % 11 = 0 AND element = 'Ca' THEN 1.1 ELSE 1 END, 2) AS n FROM red WHERE kind <> 'element-anion' GROUP BY sample_id, element
  UNION ALL SELECT sample_id, 'O', CAST(6 + sample_id % 4 AS DOUBLE) FROM (SELECT DISTINCT sample_id FROM red) WHERE sample_id % 13 <> 0),
bs AS (SELECT sample_id, sum(CASE WHEN element IN ('O','F','Cl') THEN n ELSE 0 END) AS an, sum(CASE WHEN element = 'H' THEN n ELSE 0 END) / 2 AS w, sum(CASE WHEN element = 'F' THEN n ELSE 0 END) AS f,
   sum(CASE WHEN element NOT IN ('H','O','F','Cl','Br','I','S','Se','Te') THEN n ELSE 0 END) AS ct FROM pub GROUP BY sample_id),
cand AS (SELECT sample_id, turn, 'O' AS kind, '' AS element, v AS n FROM (SELECT sample_id, v, row_number() OVER (PARTITION BY sample_id ORDER BY v DESC) - 1 AS turn FROM (
     SELECT DISTINCT sample_id, unnest([round_even(an, 0), round_even(an - w, 0), round_even(an - w - f, 0)]) AS v FROM bs)) WHERE v > 0
  UNION ALL SELECT sample_id, 10, 'cations', '', round_even(ct, 0) FROM bs WHERE ct > 0 AND round(abs(ct - round_even(ct, 0)), 9) < 0.08
  UNION ALL SELECT sample_id, 20, 'element', element, round_even(n, 0) FROM pub WHERE element NOT IN ('H','O','F','Cl','Br','I','S','Se','Te') AND n >= 0.9 AND round(abs(n - round_even(n, 0)), 9) < 0.06),
atoms AS (SELECT sample_id, element, sum(cations) AS atoms, sum(anions - CASE WHEN kind = 'element-anion' AND has_oxide THEN anions * 0.5 ELSE 0 END) AS t_o, sum(CASE WHEN element <> 'H' AND kind <> 'element-anion' THEN cations ELSE 0 END) AS t_c FROM rows_ GROUP BY sample_id, element),
tot AS (SELECT sample_id, sum(t_o) AS t_o, sum(t_c) AS t_c FROM atoms GROUP BY sample_id),
cmp0 AS (SELECT p.sample_id, p.element, p.n, a.atoms, count(*) FILTER (WHERE p.n >= 0.1) OVER (PARTITION BY p.sample_id) AS mj FROM pub p JOIN atoms a USING (sample_id, element) WHERE element NOT IN ('H','O') AND p.n >= 0.05),
cmp AS (SELECT * FROM cmp0 WHERE n >= 0.1 OR mj < 2),
tried AS (SELECT c.*, c.n / nullif(CASE c.kind WHEN 'O' THEN t_o WHEN 'cations' THEN t_c ELSE (SELECT sum(atoms) FROM atoms a WHERE a.sample_id = c.sample_id AND a.element = c.element) END, 0) AS factor FROM cand c JOIN tot USING (sample_id)),
scored AS (SELECT t.sample_id, t.turn, t.kind, t.element, t.n, t.factor, sqrt(avg(power((m.atoms * t.factor - m.n) / m.n, 2))) AS score FROM tried t JOIN cmp m USING (sample_id) WHERE t.factor IS NOT NULL GROUP BY ALL),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 6), turn, element) = 1)"""


def _published(spark, sf):
    red = C.normalise(_rows(spark, sf), C.Basis("O", 1.0)).where("kind <> 'element-anion'").groupBy("sample_id", "element").agg(F.sum("apfu").alias("a"))
    pub = red.select("sample_id", "element", F.expr("round(a * (6 + sample_id % 4) * CASE WHEN sample_id % 11 = 0 AND element = 'Ca' THEN 1.1D ELSE 1D END, 2)").alias("n"))
    oxygen = red.where("sample_id % 13 <> 0").select("sample_id", F.lit("O").alias("element"), F.expr("CAST(6 + sample_id % 4 AS DOUBLE)").alias("n")).distinct()
    return pub.unionByName(oxygen)


@query("replicate_formula", with_views(SQL_IN, PUB_SQL + """
SELECT b.sample_id, b.kind, b.element, b.n, round(b.factor, 6) AS factor, round(b.score, 5) AS score FROM best b"""))
def _(spark, sf):
    best = C.replicate_formula(_rows(spark, sf), _published(spark, sf))
    return best.select("sample_id", "kind", "element", "n", F.round("factor", 6).alias("factor"), F.round("score", 5).alias("score"))


@query("formula_differences", with_views(SQL_IN, PUB_SQL + """
, rt AS (SELECT p.sample_id, a.atoms * b.factor / p.n AS r FROM pub p JOIN best b ON b.sample_id = p.sample_id JOIN atoms a ON a.sample_id = p.sample_id AND a.element = p.element WHERE p.element NOT IN ('H','O','F','Cl') AND p.n >= 0.2 AND a.atoms > 0),
cf AS (SELECT sample_id, CASE WHEN count(*) >= 2 AND abs(-quantile_disc(-r, 0.5) - 1) > 0.02 AND abs(min(r) / -quantile_disc(-r, 0.5) - 1) <= 0.02 AND abs(max(r) / -quantile_disc(-r, 0.5) - 1) <= 0.02 THEN -quantile_disc(-r, 0.5) ELSE 1 END AS f FROM rt GROUP BY 1),
fd AS (SELECT p.sample_id, p.element, p.n AS published, a.atoms * b.factor / coalesce((SELECT f FROM cf WHERE cf.sample_id = p.sample_id), 1) AS replicated, a.atoms FROM pub p JOIN best b ON b.sample_id = p.sample_id LEFT JOIN atoms a ON a.sample_id = p.sample_id AND a.element = p.element WHERE p.element <> 'O'),
fs AS (SELECT *, CASE WHEN atoms IS NULL AND published >= 0.05 THEN CASE WHEN element IN ('H','Li','B','Be','C','N') THEN 'not analysed' ELSE 'not in the list' END WHEN atoms IS NOT NULL AND abs(replicated - published) > greatest(0.02, 0.02 * published) THEN 'differs' END AS state FROM fd)
SELECT sample_id, element, round(published, 6) AS published, round(replicated, 6) AS replicated, state FROM fs WHERE state IS NOT NULL"""))
def _(spark, sf):
    rows, pub = _rows(spark, sf), _published(spark, sf)
    d = C.formula_differences(rows, pub, C.replicate_formula(rows, pub))
    return d.select("sample_id", "element", *_r("published", "replicated"), "state")


@query("basis_sensitivity", with_views(SQL_IN, STATS_SQL + red_sql("O", 8) + """
, s AS (SELECT sample_id, sum(o_apfu) AS o, sum(CASE WHEN kind = 'oxide' THEN apfu ELSE 0 END) AS c FROM red GROUP BY sample_id),
al AS (SELECT sample_id, 'O' AS kind, '' AS element, round_even(o, 0) AS n FROM s WHERE o > 0.5 UNION ALL SELECT sample_id, 'cations', '', round_even(c, 0) FROM s WHERE c > 0.5
  UNION ALL SELECT sample_id, 'element', element, greatest(1, round_even(apfu, 0)) FROM red WHERE kind = 'oxide' AND apfu >= 0.5),
u AS (SELECT sample_id, sum(cations * charge) AS plus, sum(CASE WHEN kind IN ('oxide','water') THEN anions ELSE 0 END) AS ox, sum(anions) AS an, sum(CASE WHEN kind = 'element-anion' AND has_oxide THEN anions * 0.5 ELSE 0 END) AS lost,
   sum(CASE WHEN kind = 'oxide' THEN cations ELSE 0 END) AS tc FROM red GROUP BY sample_id),
f AS (SELECT al.*, u.plus, u.ox, u.lost, al.n / CASE al.kind WHEN 'O' THEN an - lost WHEN 'cations' THEN tc ELSE (SELECT sum(cations) FROM red r WHERE r.sample_id = al.sample_id AND r.element = al.element) END AS factor FROM al JOIN u USING (sample_id))
SELECT sample_id, kind, element, n, round(factor, 6) AS factor, round((plus - 2 * (ox - CASE WHEN kind = 'O' THEN lost ELSE 0 END)) * factor, 6) AS charge FROM f"""))
def _(spark, sf):
    b = C.basis_sensitivity(C.normalise(_rows(spark, sf), C.Basis("O", 8.0)))
    return b.select("sample_id", "kind", "element", "n", *_r("factor", "charge"))


# --- formulas --------------------------------------------------------------------------------

FORMULAS = """
SELECT l_orderkey * 8 + l_linenumber AS entry_id, concat(CASE l_suppkey % 4 WHEN 0 THEN 'Ca' WHEN 1 THEN 'Fe3+2' WHEN 2 THEN 'Mg0.5' ELSE 'Al2' END, CASE l_partkey % 3 WHEN 0 THEN 'Si' WHEN 1 THEN 'P' ELSE 'S' END,
  'O', CAST(2 + l_linenumber AS STRING), CASE WHEN l_quantity > 30 THEN 'H2O' ELSE '' END) AS formula FROM {lineitem}"""
# the oracle writes the same parts as counts
PARTS = """
p AS (SELECT l_orderkey * 8 + l_linenumber AS entry_id, l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity FROM lineitem),
el AS (SELECT entry_id, CASE l_suppkey % 4 WHEN 0 THEN 'Ca' WHEN 1 THEN 'Fe' WHEN 2 THEN 'Mg' ELSE 'Al' END AS element, CASE l_suppkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 0.5 ELSE 2.0 END AS n FROM p
 UNION ALL SELECT entry_id, CASE l_partkey % 3 WHEN 0 THEN 'Si' WHEN 1 THEN 'P' ELSE 'S' END, 1.0 FROM p
 UNION ALL SELECT entry_id, 'O', 2.0 + l_linenumber + CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END FROM p UNION ALL SELECT entry_id, 'H', 2.0 FROM p WHERE l_quantity > 30),
els AS (SELECT entry_id, element, sum(CAST(n AS DOUBLE)) AS n FROM el GROUP BY ALL)"""


@query("formula_elements", f"WITH {PARTS} SELECT entry_id, element, n FROM els")
def _(spark, sf):
    return E.explode_elements(spark_sql(spark, sf, FORMULAS), "formula", ["entry_id"])


W_SQL = "(VALUES ('Ca',40.078),('Fe',55.845),('Mg',24.305),('Al',26.982),('Si',28.085),('P',30.974),('S',32.06),('O',15.999),('H',1.008)) AS w(element, weight)"


@query("formula_mass_density", f"""WITH {PARTS} SELECT entry_id, round(sum(n * CAST(weight AS DOUBLE)), 6) AS mass, round(4 * sum(n * CAST(weight AS DOUBLE)) / (500 * 0.602214), 6) AS density
FROM els JOIN {W_SQL} ON w.element = els.element GROUP BY entry_id""")
def _(spark, sf):
    els = E.explode_elements(spark_sql(spark, sf, FORMULAS), "formula", ["entry_id"])
    mass = C.formula_mass(els)
    return mass.select("entry_id", F.round("mass", 6).alias("mass"), F.round(C.ideal_density(F.col("mass"), F.lit(4), F.lit(500)), 6).alias("density"))


@query("constituent_dimension", other_sql("""
SELECT formula, element, n_cat, n_o, CAST(charge AS DOUBLE) AS charge, CAST(mw AS DOUBLE) AS mw, kind FROM (VALUES ('Al2O3','Al',2,3,3,101.961,'oxide'),('CaO','Ca',1,1,2,56.077,'oxide'),('F','F',1,0,-1,18.998,'element-anion'),
 ('FeO','Fe',1,1,2,71.844,'oxide'),('H2O','H',2,1,1,18.015,'water'),('MgO','Mg',1,1,2,40.304,'oxide'),('SiO2','Si',1,2,4,60.083,'oxide')) AS t(formula,element,n_cat,n_o,charge,mw,kind)"""))
def _(spark, sf):
    points = view(spark, sf, "d_probe_points").select(F.concat(F.col("constituent"), F.lit("*")).alias("formula"))
    d = E.constituent_dimension(points)
    return d.withColumn("mw", F.round("mw", 3))


@query("elements_to_constituents", f"""WITH {PARTS}, u AS (SELECT * FROM (VALUES ('Ca','CaO'),('Fe','FeO'),('Mg','MgO'),('Al','Al2O3'),('Si','SiO2'),('P','P2O5'),('S','SO3'),('H','H2O')) AS t(element, formula))
SELECT entry_id AS sample_id, u.formula AS constituent, sum(CASE WHEN els.element = 'H' THEN n / 2 ELSE n END) AS apfu FROM els JOIN u ON u.element = els.element GROUP BY ALL""")
def _(spark, sf):
    els = E.explode_elements(spark_sql(spark, sf, FORMULAS), "formula", ["entry_id"])
    return C.elements_to_constituents(els.select(F.col("entry_id").alias("sample_id"), "element", F.col("n").alias("apfu")))
