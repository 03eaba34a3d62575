"""Named queries over the spectra operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordaudit.functions.groups import groups_of
from recordaudit.functions import spectra as S
from recordaudit.operators import spectra as P
from recordaudit.plans.registry import query
from recordaudit.plans.views import other_sql, spark_sql, view, with_views

ARRAYS = """
SELECT vec_id AS spectrum_id, label AS grp, transform(sequence(0, size(embedding) - 1), i -> CAST(100 + 2 * i AS DOUBLE)) AS x,
  transform(embedding, v -> CAST(v AS DOUBLE)) AS y FROM {embeddings}"""


def _arrays(spark, sf):
    return spark_sql(spark, sf, ARRAYS)


def _points(df, value):
    return P.as_points(df, ("spectrum_id",), value).select("spectrum_id", F.col("idx").cast("bigint").alias("idx"), F.round("y", 6).alias("y"))


@query("noise_sigma", with_views("d_spectra", """
, d AS (SELECT spectrum_id, lag(y) OVER w - 2 * y + lead(y) OVER w AS v FROM d_spectra WINDOW w AS (PARTITION BY spectrum_id ORDER BY idx)),
m AS (SELECT spectrum_id, median(v) AS med FROM d WHERE v IS NOT NULL GROUP BY 1)
SELECT d.spectrum_id, round(1.4826 * median(abs(v - med)) / sqrt(6), 6) AS sigma FROM d JOIN m ON m.spectrum_id = d.spectrum_id WHERE v IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    return _arrays(spark, sf).select("spectrum_id", F.round(S.noise_sigma(F.col("y")), 6).alias("sigma"))


def _savgol_sql(window, order, deriv):
    h = window // 2
    def dot(weights, first):
        return " + ".join(f"({w!r}) * ys[{first} + {k}]" for k, w in enumerate(weights))
    cases = [f"WHEN k = {i + 1} THEN {dot(S.savgol_weights(window, order, deriv, i - h), 1)}" for i in range(h)]
    cases += [f"WHEN k = n - {h - 1 - i} THEN {dot(S.savgol_weights(window, order, deriv, i + 1), f'n - {window - 1}')}" for i in range(h)]
    return f"CASE {' '.join(cases)} ELSE {dot(S.savgol_weights(window, order, deriv), f'k - {h}')} END"


def _smooth_sql(deriv):
    return with_views("d_spectra", f"""
, a AS (SELECT spectrum_id, list(y ORDER BY idx) AS ys FROM d_spectra GROUP BY 1), i AS (SELECT spectrum_id, ys, len(ys) AS n, unnest(range(1, len(ys) + 1)) AS k FROM a)
SELECT spectrum_id, CAST(k - 1 AS BIGINT) AS idx, round({_savgol_sql(7, 3 if deriv else 2, deriv)}, 6) AS y FROM i""")


@query("savgol_smooth", _smooth_sql(0))
def _(spark, sf):
    return _points(_arrays(spark, sf).withColumn("s", S.savgol(F.col("y"), 7, 2)), "s")


@query("savgol_second_derivative", _smooth_sql(2))
def _(spark, sf):
    return _points(_arrays(spark, sf).withColumn("s", S.savgol(F.col("y"), 7, 3, 2)), "s")


def _snip_sql(hw):
    steps, last = [], "d_spectra"
    for p in range(hw, 0, -1):
        steps.append(f"s{p} AS (SELECT spectrum_id, idx, CASE WHEN lag(y, {p}) OVER w IS NOT NULL AND lead(y, {p}) OVER w IS NOT NULL THEN least(y, 0.5 * (lag(y, {p}) OVER w + lead(y, {p}) OVER w)) ELSE y END AS y FROM {last} WINDOW w AS (PARTITION BY spectrum_id ORDER BY idx))")
        last = f"s{p}"
    return ", " + ",\n".join(steps) + f" SELECT spectrum_id, CAST(idx AS BIGINT) AS idx, round(y, 6) AS y FROM {last}"


@query("baseline_snip", with_views("d_spectra", _snip_sql(10)))
def _(spark, sf):
    return _points(_arrays(spark, sf).withColumn("s", S.baseline_snip(F.col("y"), 10)), "s")


@query("baseline_anchors", with_views("d_spectra", """
, m AS (SELECT spectrum_id, median(CASE WHEN idx BETWEEN 7 AND 13 THEN y END) AS a, median(CASE WHEN idx BETWEEN 37 AND 43 THEN y END) AS b FROM d_spectra GROUP BY 1)
SELECT d.spectrum_id, CAST(idx AS BIGINT) AS idx, round(CASE WHEN x <= 120 THEN a WHEN x >= 180 THEN b ELSE a + (b - a) * (x - 120) / 60.0 END, 6) AS y FROM d_spectra d JOIN m ON m.spectrum_id = d.spectrum_id"""))
def _(spark, sf):
    return _points(_arrays(spark, sf).withColumn("s", S.baseline_anchors(F.col("x"), F.col("y"), [180.3, 119.6])), "s")


@query("to_absorbance", with_views("d_spectra", """
, p AS (SELECT spectrum_id, idx, abs(y) * 200 AS y FROM d_spectra), t AS (SELECT spectrum_id, CASE WHEN max(y) > 1.5 THEN 100.0 ELSE 1.0 END AS sc FROM p GROUP BY 1)
SELECT p.spectrum_id, CAST(idx AS BIGINT) AS idx, round(-log10(greatest(y, sc * 1e-4) / sc), 6) AS y FROM p JOIN t ON t.spectrum_id = p.spectrum_id"""))
def _(spark, sf):
    y = F.transform("y", lambda v: F.abs(v) * 200)
    return _points(_arrays(spark, sf).withColumn("s", S.to_absorbance(y)), "s")


@query("axis_units", with_views("d_spectra", """
SELECT spectrum_id, count(*) AS n, round(min(1e7 / 532 - 1e7 / (532 + x)), 6) AS first_shift, round(max(1e7 / 532 - 1e7 / (532 + x)), 6) AS last_shift,
  round(min(1e4 / x), 6) AS low_wavenumber, round(arg_max(y, 1e4 / x), 6) AS y_at_top FROM d_spectra WHERE x BETWEEN 110 AND 200 GROUP BY 1"""))
def _(spark, sf):
    a = _arrays(spark, sf).withColumn("c", S.crop(F.col("x"), F.col("y"), 110, 200))
    shifted = S.raman_shift(F.transform("c.x", lambda v: v + 532), F.col("c.y"), 532.0)
    a = a.withColumn("r", shifted).withColumn("w", S.wavenumber(F.col("c.x"), F.col("c.y")))
    return a.select("spectrum_id", F.size("c").cast("bigint").alias("n"), F.round(F.col("r")[0]["x"], 6).alias("first_shift"), F.round(F.element_at("r", -1)["x"], 6).alias("last_shift"),
                    F.round(F.col("w")[0]["x"], 6).alias("low_wavenumber"), F.round(F.element_at("w", -1)["y"], 6).alias("y_at_top"))


@query("despike")
def _(spark, sf):
    # every seventh spectrum gets a one-point event
    a = _arrays(spark, sf).withColumn("y", F.transform("y", lambda v, i: v + F.when((F.col("spectrum_id") % 7 == 0) & (i == 20 + F.col("spectrum_id") % 20), 9.0).otherwise(0.0)))
    a = a.withColumn("spikes", S.despike(F.col("x"), F.col("y"))).withColumn("s", S.bridge(F.col("y"), F.col("spikes")))
    return _points(a, "s")


RESAMPLED = """
, sg AS (SELECT spectrum_id, x AS x0, lead(x) OVER w AS x1, y AS y0, lead(y) OVER w AS y1, idx FROM d_spectra WINDOW w AS (PARTITION BY spectrum_id ORDER BY idx)),
g AS (SELECT CAST(unnest(range(0, 60)) AS BIGINT) AS step_no)"""


@query("resample_linear", with_views("d_spectra", RESAMPLED + """
SELECT spectrum_id, step_no, CAST(95.0 + step_no * 3.0 AS DOUBLE) AS x, round(y0 + (y1 - y0) * (95.0 + step_no * 3.0 - x0) / (x1 - x0), 6) AS y FROM sg JOIN g ON
 (95.0 + step_no * 3.0 > x0 AND 95.0 + step_no * 3.0 <= x1) OR (idx = 0 AND 95.0 + step_no * 3.0 = x0)"""))
def _(spark, sf):
    return P.resample(_arrays(spark, sf), 95.0, 95.0 + 59 * 3.0, 3.0).select("spectrum_id", "step_no", "x", F.round("y", 6).alias("y"))


@query("composite_median", with_views("d_spectra", RESAMPLED + """
, r AS (SELECT spectrum_id, step_no, 95.0 + step_no * 3.0 AS x, y0 + (y1 - y0) * (95.0 + step_no * 3.0 - x0) / (x1 - x0) AS y FROM sg JOIN g ON (95.0 + step_no * 3.0 > x0 AND 95.0 + step_no * 3.0 <= x1) OR (idx = 0 AND 95.0 + step_no * 3.0 = x0)),
e AS (SELECT spectrum_id, min(y) AS f, max(y) AS t FROM r GROUP BY 1), m AS (SELECT DISTINCT spectrum_id, grp FROM d_spectra),
s AS (SELECT m.grp, step_no, x, (y - f) / (t - f) AS v FROM r JOIN e ON e.spectrum_id = r.spectrum_id JOIN m ON m.spectrum_id = r.spectrum_id), c AS (SELECT grp, count(*) AS minerals FROM m GROUP BY 1)
SELECT s.grp, step_no, CAST(x AS DOUBLE) AS x, round(median(v), 3) AS y, minerals FROM s JOIN c ON c.grp = s.grp GROUP BY ALL HAVING count(*) >= 3 AND minerals >= 3"""))
def _(spark, sf):
    a = _arrays(spark, sf).withColumn("mineral", F.col("spectrum_id"))
    return P.composite_median(a, 95.0, 95.0 + 59 * 3.0, 3.0)


@query("curve_features", with_views("d_spectra", f"""
, a AS (SELECT spectrum_id, list(x ORDER BY idx) AS xs, list(y ORDER BY idx) AS ys FROM d_spectra GROUP BY 1), i AS (SELECT spectrum_id, ys, len(ys) AS n, unnest(range(1, len(ys) + 1)) AS k FROM a),
sm AS (SELECT spectrum_id, k - 1 AS k, {_savgol_sql(5, 2, 0)} AS y FROM i), rg AS (SELECT spectrum_id, max(y) - min(y) AS r, max(k) AS top FROM sm GROUP BY 1),
mx AS (SELECT s.*, lag(y) OVER w AS a, lead(y) OVER w AS c, r, top FROM sm s JOIN rg USING (spectrum_id) WINDOW w AS (PARTITION BY spectrum_id ORDER BY k)),
pk AS (SELECT * FROM mx WHERE k BETWEEN 2 AND top - 2 AND y >= a AND y > c),
sd AS (SELECT p.*, (SELECT coalesce(max(q.k), -1) FROM sm q WHERE q.spectrum_id = p.spectrum_id AND q.k < p.k AND q.y > p.y) AS l, (SELECT coalesce(min(q.k), p.top + 1) FROM sm q WHERE q.spectrum_id = p.spectrum_id AND q.k > p.k AND q.y > p.y) AS h FROM pk p),
fl AS (SELECT d.*, (SELECT min(q.y) FROM sm q WHERE q.spectrum_id = d.spectrum_id AND q.k > l AND q.k <= d.k) AS lo_l, (SELECT min(q.y) FROM sm q WHERE q.spectrum_id = d.spectrum_id AND q.k < h AND q.k >= d.k) AS lo_r FROM sd d)
SELECT spectrum_id, round(100 + 2 * k + CASE WHEN a - 2 * y + c <> 0 THEN least(greatest(0.5 * (a - c) / (a - 2 * y + c), -1), 1) ELSE 0 END * 2, 5) AS pos FROM fl WHERE y - greatest(lo_l, lo_r) > 0.015 * CASE WHEN r <> 0 THEN r ELSE 1 END"""))
def _(spark, sf):
    return _arrays(spark, sf).select("spectrum_id", F.explode(S.apexes(F.col("x"), F.col("y"))).alias("p")).select("spectrum_id", F.round("p.x", 5).alias("pos"))


# broad bands: neighbouring values joined up, so that the search has something to find
def _bands(spark, sf):
    return P.find_bands(_arrays(spark, sf), min_snr=1.0)


@query("find_bands")
def _(spark, sf):
    return _bands(spark, sf).select("spectrum_id", "pos", *[F.round(c, 6).alias(c) for c in ("height", "fwhm", "snr", "scale")])


@query("strong_bands")
def _(spark, sf):
    return P.strong_bands(_bands(spark, sf), lattice=110.0).select("spectrum_id", "pos", F.round("height", 6).alias("height"))


PEAKS = "SELECT user_id * 7 + event_id % 7 AS spectrum_id, event_id AS band_no, CASE WHEN event_type = 'click' THEN 'g1' WHEN event_type = 'view' THEN 'g2' WHEN event_type = 'error' THEN 'g3' ELSE 'g4' END AS grp, round(300 + value * 20, 1) AS pos, CAST(10 + event_id % 60 AS DOUBLE) AS fwhm, CAST(1 + event_id % 97 AS DOUBLE) AS height FROM {events}"


@query("regions_of", f"""WITH b AS ({other_sql(PEAKS)}), c AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 80 THEN 0 ELSE 1 END AS nw FROM b WINDOW w AS (PARTITION BY spectrum_id ORDER BY pos, fwhm)),
 d AS (SELECT *, sum(nw) OVER (PARTITION BY spectrum_id ORDER BY pos, fwhm ROWS UNBOUNDED PRECEDING) AS cl FROM c),
 s AS (SELECT spectrum_id, cl, greatest(100.0, min(pos) - greatest(40.0, first(fwhm ORDER BY pos, fwhm))) AS a, least(4000.0, max(pos) + greatest(40.0, last(fwhm ORDER BY pos, fwhm))) AS b FROM d GROUP BY 1, 2),
 m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY spectrum_id ORDER BY cl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM s),
 g AS (SELECT *, sum(nw) OVER (PARTITION BY spectrum_id ORDER BY cl ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT spectrum_id, min(a) AS lo, max(b) AS hi FROM g GROUP BY spectrum_id, k""")
def _(spark, sf):
    return P.regions_of(spark_sql(spark, sf, PEAKS), F.lit(100.0), F.lit(4000.0))


WINDOWS = """
, v AS (SELECT grp, technique, pos, paper FROM d_bands), m AS (SELECT grp, technique, median(pos) AS med, count(*) AS total FROM v GROUP BY 1, 2),
o AS (SELECT v.*, abs(pos - med) AS off, total FROM v JOIN m USING (grp, technique)), s AS (SELECT grp, technique, 1.4826 * median(off) AS sigma FROM o GROUP BY 1, 2),
k AS (SELECT o.* FROM o JOIN s USING (grp, technique) WHERE total < 4 OR off <= 3.0 * CASE WHEN sigma = 0 THEN 1.0 ELSE sigma END),
w AS (SELECT grp, technique, quantile_cont(pos, 0.05) AS p5, quantile_cont(pos, 0.25) AS p25, quantile_cont(pos, 0.5) AS p50, quantile_cont(pos, 0.75) AS p75, quantile_cont(pos, 0.95) AS p95,
  count(*) AS n, count(DISTINCT paper) AS sources, max(total) - count(*) AS dropped FROM k GROUP BY 1, 2 HAVING count(DISTINCT paper) >= 3)"""


def _windows(spark, sf):
    return P.trimmed_windows(view(spark, sf, "d_bands"), ["grp", "technique"])


@query("trimmed_windows", with_views("d_bands", WINDOWS + "SELECT grp, technique, " + ", ".join(f"round({p}, 6) AS {p}" for p in ("p5", "p25", "p50", "p75", "p95")) + ", n, sources, dropped FROM w"))
def _(spark, sf):
    return _windows(spark, sf).select("grp", "technique", *[F.round(p, 6).alias(p) for p in ("p5", "p25", "p50", "p75", "p95")], "n", "sources", "dropped")


@query("window_verdict", with_views("d_bands", WINDOWS + """
, r AS (SELECT grp, technique, round_even(p5, 0) AS p5, round_even(p50, 0) AS p50, round_even(p95, 0) AS p95, CASE technique WHEN 'ir' THEN 17.0 ELSE 0.0 END AS lo, CASE technique WHEN 'ir' THEN 30.0 ELSE 9.0 END AS hi FROM w),
b AS (SELECT *, CASE WHEN p5 < lo - 15 THEN 'runs ' || CAST(lo - p5 AS INT) || ' below the range' END AS x, CASE WHEN p95 > hi + 15 THEN 'runs ' || CAST(p95 - hi AS INT) || ' above the range' END AS y,
  CASE WHEN p50 < lo OR p50 > hi THEN CAST(p50 AS INT) END AS z FROM r)
SELECT grp, technique, CASE WHEN x IS NULL AND y IS NULL AND z IS NULL THEN 'agrees' WHEN x IS NULL AND y IS NULL THEN 'inside but the median ' || z || ' is outside the range'
  ELSE concat_ws('; ', x, y, 'median ' || z || ' outside the range') END AS verdict FROM b"""))
def _(spark, sf):
    w = P.rounded_windows(_windows(spark, sf)).withColumn("lo", F.expr("CASE technique WHEN 'ir' THEN 17.0D ELSE 0.0D END")).withColumn("hi", F.expr("CASE technique WHEN 'ir' THEN 30.0D ELSE 9.0D END"))
    return P.window_verdict(w).select("grp", "technique", "verdict")


LIB_SQL = WINDOWS + """
, lib AS (SELECT grp, technique AS mode, round_even(p50, 0) - 8 AS lo, round_even(p50, 0) + 8 AS hi, CASE technique WHEN 'ir' THEN round_even(p50, 0) END AS free, technique = 'ir' AND grp = 'click' AS broad,
  CASE WHEN grp <> 'view' THEN p5 END AS p5, CASE WHEN grp <> 'view' THEN p25 END AS p25, CASE WHEN grp <> 'view' THEN p50 END AS p50, CASE WHEN grp <> 'view' THEN p75 END AS p75, CASE WHEN grp <> 'view' THEN p95 END AS p95 FROM w),
hit AS (SELECT b.band_id, b.paper AS entry_id, b.pos, l.*, l.grp = CASE WHEN b.paper % 3 = 0 THEN 'click' ELSE 'view' END AS in_formula,
   CAST(round(CAST(CASE WHEN p50 IS NOT NULL THEN abs(b.pos - p50) / greatest(10.0, p75 - p25) ELSE abs(b.pos - CASE WHEN free BETWEEN lo AND hi THEN free ELSE (lo + hi) / 2 END) / greatest(10.0, (hi - lo) / 2.4) END AS DECIMAL(18,9)), 2) AS DOUBLE) AS score
   FROM d_bands b JOIN lib l ON b.pos BETWEEN lo AND hi OR b.pos BETWEEN p5 AND p95),
al AS (SELECT band_id, entry_id, pos, grp, mode, in_formula, broad, score, 0 AS last FROM hit UNION ALL SELECT band_id, paper, pos, 'lattice', 'any', NULL, true, NULL, 1 FROM d_bands WHERE pos BETWEEN 1 AND 6),
idd AS (SELECT *, CAST(row_number() OVER (PARTITION BY band_id ORDER BY last, coalesce(in_formula, false) DESC, broad, score, grp, mode) AS INT) AS place FROM al)"""


def _library(spark, sf):
    w = _windows(spark, sf).withColumn("mid", F.bround("p50"))
    cut = [F.when(F.col("grp") != "view", F.col(p)).alias(p) for p in ("p5", "p25", "p50", "p75", "p95")]
    return w.select("grp", F.col("technique").alias("mode"), (F.col("mid") - 8).alias("lo"), (F.col("mid") + 8).alias("hi"), F.expr("CASE technique WHEN 'ir' THEN mid END").alias("free"),
                    F.expr("technique = 'ir' AND grp = 'click'").alias("broad"), *cut)


# the golden formulas and the groups they hold
FORMULAS = {
    "Ca(UO2)2(PO4)2·11H2O": "UO2,PO4,H2O", "Cu4(SO4)(OH)6": "SO4,OH", "Cu<sub>4</sub>(SO<sub>4</sub>)(OH)<sub>6</sub> · 2H<sub>2</sub>O": "SO4,H2O,OH",
    "Mn2+Cu2+2(As5+O4)2(OH)4(H2O)4": "AsO4,H2O,OH", "(N3-H4)2Mn2+[(U6+O2)4O4(S6+O4)2](H2O)4": "UO2,SO4,NH4,H2O", "Mn(PO3OH)(H2O)3": "PO4,P-OH,H2O,OH",
    "Pb(As3+O3)Cl": "AsO3", "Ca(As5+O3OH)·2H2O": "AsO4,As-OH,H2O,OH", "UO2": "", "Mg(H2O)6·H2OH2O": "H2O", "BaSO4": "SO4", "TiSi2": "", "FeS2": "sulfide",
    "PbCu[(Se0.8S0.2)Σ1.0O4](OH)2": "SeO4,OH", "Cu3Al2(SO4)0.95(SiO4)0.04(AsO4)0.01(OH)12·3H2O": "SO4,H2O,OH", "Ca2(SO4)0.39(OH)8": "SO4,OH",
    "[Mg4Al2(OH)12](CO3)[Na(H2O)6]0.05[Si(OH)6]0.10·3H2O": "CO3,H2O,OH", "": "",
}
FORMULA_ROWS = "SELECT o_orderkey AS entry_id, CASE o_orderkey % @ " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(FORMULAS)) + " END AS formula FROM {orders}"
FORMULA_ROWS = FORMULA_ROWS.replace("@", str(len(FORMULAS) + 1))


@query("formula_groups", "SELECT o_orderkey AS entry_id, CASE o_orderkey % " + f"{len(FORMULAS) + 1} " + " ".join(f"WHEN {k} THEN '{g}'" for k, g in enumerate(FORMULAS.values())) + " ELSE '' END AS groups FROM orders")
def _(spark, sf):
    return spark_sql(spark, sf, FORMULA_ROWS).select("entry_id", F.concat_ws(",", groups_of(F.col("formula"))).alias("groups"))


def _identified(spark, sf):
    bands = view(spark, sf, "d_bands").select("band_id", F.col("paper").alias("entry_id"), "pos")
    # the groups of an entry are read from its formula; the learned windows are named after the events of the table
    formulas = bands.select("entry_id", F.expr("CASE WHEN entry_id % 3 = 0 THEN 'CaSO4·2H2O' ELSE 'Ca2(CO3)0.9(SO4)0.1' END").alias("formula")).distinct()
    held = formulas.select("entry_id", F.explode(groups_of(F.col("formula"))).alias("held"))
    groups = held.select("entry_id", F.expr("CASE held WHEN 'SO4' THEN 'click' WHEN 'CO3' THEN 'view' END").alias("grp")).where("grp IS NOT NULL")
    always = spark.sql("SELECT 'lattice' AS grp, 'any' AS mode, 1.0D AS lo, 6.0D AS hi")
    return P.identify(bands, _library(spark, sf), groups, always, width=4.0)


@query("identify_bands", with_views("d_bands", LIB_SQL + "SELECT entry_id, band_id, pos, grp, mode, in_formula, broad, score, place FROM idd"))
def _(spark, sf):
    return _identified(spark, sf)


@query("identification_accuracy", with_views("d_bands", LIB_SQL + """
, t AS (SELECT band_id, grp, technique AS mode FROM d_bands), j AS (SELECT t.grp, t.mode, i.grp AS sg, i.mode AS sm FROM t LEFT JOIN idd i ON i.band_id = t.band_id AND i.place = 1)
SELECT grp, count(*) AS n, round(100.0 * count(*) FILTER (WHERE sg = grp AND sm = mode) / count(*), 4) AS mode_pct, round(100.0 * count(*) FILTER (WHERE sg = grp) / count(*), 4) AS group_pct FROM j GROUP BY grp"""))
def _(spark, sf):
    truth = view(spark, sf, "d_bands").select("band_id", "grp", F.col("technique").alias("mode"))
    return P.identification_accuracy(_identified(spark, sf), truth)


MEASURED = "SELECT user_id AS mineral, CASE WHEN event_id % 2 = 0 THEN 'raman' ELSE 'ir' END AS technique, value * 20 AS pos, CAST(1 + event_id % 97 AS DOUBLE) AS height FROM {events}"
MODES = "SELECT * FROM (VALUES ('g0','a',100.0D,300.0D,'R'),('g0','b',450.0D,520.0D,'IR'),('g1','a',200.0D,260.0D,'R+IR'),('g1','b',700.0D,1200.0D,'R+IR'),('g2','a',1500.0D,1600.0D,'R+IR')) AS t(grp, mode, lo, hi, active)"


@query("activity_share", f"""WITH b AS ({other_sql(MEASURED)}), md AS ({MODES.replace('D,', ',')}), mi AS (SELECT DISTINCT mineral, 'g' || (mineral % 3) AS grp FROM b),
 both_ AS (SELECT mineral FROM b GROUP BY 1 HAVING count(DISTINCT technique) = 2), pool AS (SELECT * FROM mi WHERE mineral IN (SELECT mineral FROM both_)),
 st AS (SELECT b.*, max(height) OVER (PARTITION BY mineral, technique) AS top FROM b), sn AS (SELECT DISTINCT p.grp, m.mode, p.mineral, s.technique FROM st s JOIN pool p USING (mineral) JOIN md m ON m.grp = p.grp AND s.pos BETWEEN m.lo AND m.hi WHERE height >= 0.08 * top),
 sz AS (SELECT grp, count(*) AS minerals FROM pool GROUP BY 1 HAVING count(*) >= 3),
 r AS (SELECT md.*, minerals, (SELECT count(*) FROM sn WHERE sn.grp = md.grp AND sn.mode = md.mode AND technique = 'raman') / minerals AS rs, (SELECT count(*) FROM sn WHERE sn.grp = md.grp AND sn.mode = md.mode AND technique = 'ir') / minerals AS si FROM md JOIN sz USING (grp))
SELECT grp, mode, active, minerals, round(rs, 4) AS raman_share, round(si, 4) AS ir_share, CASE WHEN active = 'IR' AND rs >= 0.5 THEN 'listed infrared only, seen in Raman' WHEN active = 'R' AND si >= 0.5 AND lo >= 400 THEN 'listed Raman only, seen in infrared'
  WHEN active = 'R+IR' AND rs < 0.2 THEN 'listed both, seldom seen in Raman' WHEN active = 'R+IR' AND si < 0.2 AND lo >= 400 THEN 'listed both, seldom seen in infrared' ELSE '' END AS note FROM r""")
def _(spark, sf):
    bands = spark_sql(spark, sf, MEASURED)
    minerals = bands.select("mineral").distinct().withColumn("grp", F.expr("concat('g', mineral % 3)"))
    return P.activity_share(spark.sql(MODES), bands, minerals)


META = """SELECT DISTINCT user_id * 8 + event_id % 5 AS spectrum_id, user_id AS sample_id, concat('g', CAST(user_id % 3 AS STRING)) AS grp, 'raman' AS technique, CASE WHEN event_id % 5 = 1 THEN 'raw' ELSE 'processed' END AS kind,
  CASE WHEN event_id % 5 = 2 THEN 'excellent' ELSE 'fair' END AS quality, CASE WHEN event_id % 5 = 0 THEN 'unoriented' ELSE 'oriented' END AS orient, CASE WHEN event_id % 5 = 3 THEN '785' ELSE '532' END AS laser FROM {events}"""
ORIENTED = "SELECT user_id * 8 + event_id % 5 AS spectrum_id, value * 20 AS pos, CAST(1 + event_id % 97 AS DOUBLE) AS height FROM {events}"


@query("best_spectrum", f"""WITH m AS ({other_sql(META)}) SELECT sample_id, first(spectrum_id ORDER BY kind <> 'processed', CASE quality WHEN 'excellent' THEN 0 ELSE 1 END, orient = 'oriented', CASE laser WHEN '532' THEN 0 ELSE 1 END, spectrum_id) AS spectrum_id FROM m GROUP BY sample_id""")
def _(spark, sf):
    return P.best_spectrum(spark_sql(spark, sf, META))


@query("orientation_spread", f"""WITH m AS ({other_sql(META)}), b AS ({other_sql(ORIENTED)}), en AS (SELECT sample_id FROM m WHERE orient = 'oriented' GROUP BY 1 HAVING count(*) >= 3),
 bs AS (SELECT sample_id, first(spectrum_id ORDER BY kind <> 'processed', CASE quality WHEN 'excellent' THEN 0 ELSE 1 END, orient = 'oriented', CASE laser WHEN '532' THEN 0 ELSE 1 END, spectrum_id) AS spectrum_id FROM m WHERE sample_id IN (SELECT sample_id FROM en) GROUP BY 1),
 rk AS (SELECT sample_id, pos, row_number() OVER (PARTITION BY sample_id ORDER BY height DESC, pos) AS k FROM b JOIN bs USING (spectrum_id)), tw AS (SELECT sample_id, min(pos) AS p1, max(pos) AS p2 FROM rk WHERE k <= 2 GROUP BY 1 HAVING count(*) = 2),
 pr AS (SELECT sample_id, grp, b.spectrum_id, 0.05 * max(height) AS fl, max(height) FILTER (WHERE abs(pos - p1) <= 6) AS h1, max(height) FILTER (WHERE abs(pos - p2) <= 6) AS h2 FROM b JOIN m USING (spectrum_id) JOIN tw USING (sample_id) WHERE orient = 'oriented' GROUP BY 1, 2, 3),
 rt AS (SELECT sample_id, grp, greatest(coalesce(h1, 0), fl) / greatest(coalesce(h2, 0), fl) AS r FROM pr), sp AS (SELECT sample_id, grp, max(r) / min(r) AS s FROM rt GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT grp, round(median(s), 1) AS median, round(quantile_cont(s, 0.75), 1) AS p75, count(*) AS samples FROM sp GROUP BY grp HAVING count(*) >= 3""")
def _(spark, sf):
    return P.orientation_spread(spark_sql(spark, sf, ORIENTED), spark_sql(spark, sf, META))


COMPS = "SELECT event_id AS comp_id, concat('g', CAST(user_id % 3 AS STRING)) AS grp, value * 20 AS pos, CAST(event_id % 311 AS DOUBLE) / 10 AS fwhm, CAST(event_id % 19 AS DOUBLE) / 100 AS share FROM {events}"


@query("width_percentiles", f"""WITH c AS ({other_sql(COMPS)}), md AS ({MODES.replace('D,', ',')}), p AS (SELECT comp_id, c.grp, fwhm, min(mode) AS mode FROM c JOIN md ON md.grp = c.grp AND pos BETWEEN lo AND hi WHERE share >= 0.05 GROUP BY 1, 2, 3 HAVING count(*) = 1),
 l AS (SELECT grp, mode, list(fwhm ORDER BY fwhm) AS v, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 8)
SELECT grp, mode, """ + ", ".join(f"round(v[CAST(least(n - 1, round_even((n - 1) * {q} / 100.0, 0)) AS INT) + 1], 1) AS p{q}" for q in (5, 25, 50, 75, 95)) + ", n FROM l")
def _(spark, sf):
    return P.width_percentiles(spark_sql(spark, sf, COMPS), spark.sql(MODES))


@query("fit_coverage", f"""WITH s AS ({other_sql(PEAKS)}), d AS (SELECT DISTINCT spectrum_id, pos, fwhm FROM s), c AS (SELECT user_id * 7 + event_id % 7 AS spectrum_id, round(300 + value * 20, 1) + CASE WHEN event_id % 3 = 0 THEN 5 ELSE 500 END AS pos FROM events)
SELECT count(*) AS strong, count(*) FILTER (WHERE ok) AS covered, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 1) AS coverage_pct FROM (
  SELECT d.*, EXISTS (SELECT 1 FROM c JOIN d e ON e.spectrum_id = c.spectrum_id WHERE e.spectrum_id = d.spectrum_id AND e.pos = d.pos AND c.pos BETWEEN e.pos - least(20.0, greatest(6.0, e.fwhm / 2)) AND e.pos + least(20.0, greatest(6.0, e.fwhm / 2))) AS ok FROM d)""")
def _(spark, sf):
    strong = spark_sql(spark, sf, PEAKS).select("spectrum_id", "pos", "fwhm").distinct()
    comps = spark_sql(spark, sf, "SELECT user_id * 7 + event_id % 7 AS spectrum_id, round(300 + value * 20, 1) + CASE WHEN event_id % 3 = 0 THEN 5 ELSE 500 END AS pos FROM {events}")
    return P.fit_coverage(strong, comps)


FREE = "SELECT * FROM (VALUES ('g1','ν1',983.0D),('g1','ν3',1105.0D),('g1','ν4',611.0D),('g1','ν2',450.0D),('g2','ν1',1063.0D),('g2','ν3',1415.0D),('g2','ν2',879.0D),('g2','ν4',680.0D),('g3','ν1',938.0D),('g3','ν3',1017.0D),('g3','ν4',567.0D),('g3','ν2',420.0D),('g4','ν1',837.0D),('g4','ν3',878.0D),('g4','ν4',463.0D),('g4','ν2',349.0D)) AS t(grp, mode, free)"


@query("assign_modes", f"""WITH b0 AS ({other_sql(PEAKS)}), b AS (SELECT spectrum_id * 10 + CAST(substr(grp, 2) AS INT) AS spectrum_id, grp, pos, height, 300.0 AS floor FROM b0), f AS ({FREE.replace('D)', ')')}),
 t AS (SELECT *, max(height) OVER (PARTITION BY spectrum_id) AS top FROM b), n AS (SELECT spectrum_id, first(pos ORDER BY height DESC, pos) AS nu1 FROM b WHERE pos >= floor GROUP BY 1),
 r AS (SELECT t.*, nu1, CAST(free AS DOUBLE) AS free1 FROM t JOIN n USING (spectrum_id) JOIN f ON f.grp = t.grp AND f.mode = 'ν1')
SELECT spectrum_id, pos, CASE WHEN abs(nu1 / free1 - 1) > 0.20 THEN '(ν1 not dominant)' ELSE 'ν1' END AS mode FROM r WHERE pos = nu1 UNION ALL
SELECT spectrum_id, pos, CASE WHEN (SELECT min(abs(r.pos / (CAST(free AS DOUBLE) * nu1 / free1) - 1)) FROM f WHERE f.grp = r.grp AND f.mode <> 'ν1') <= 0.12 THEN (SELECT arg_min(mode, (abs(r.pos / (CAST(free AS DOUBLE) * nu1 / free1) - 1), mode)) FROM f WHERE f.grp = r.grp AND f.mode <> 'ν1') ELSE '(unassigned)' END
FROM r WHERE abs(nu1 / free1 - 1) <= 0.20 AND height >= 0.08 * top AND abs(pos - nu1) > 0.02 * nu1""")
def _(spark, sf):
    b = spark_sql(spark, sf, PEAKS).withColumn("spectrum_id", F.expr("spectrum_id * 10 + CAST(substr(grp, 2) AS INT)")).withColumn("floor", F.lit(300.0))
    return P.assign_modes(b.select("spectrum_id", "grp", "floor", "pos", "height"), spark.sql(FREE))


@query("split_bends", f"""WITH b AS ({other_sql(PEAKS)}), s AS (SELECT *, lead(pos) OVER (PARTITION BY spectrum_id ORDER BY pos) - pos AS st FROM b), c AS (SELECT spectrum_id, first(pos ORDER BY st DESC, pos DESC) AS cut FROM s WHERE st >= 40 GROUP BY 1)
SELECT b.spectrum_id, band_no, CASE WHEN cut IS NOT NULL THEN CASE WHEN pos > cut THEN 'upper' ELSE 'lower' END END AS part FROM b LEFT JOIN c ON c.spectrum_id = b.spectrum_id""")
def _(spark, sf):
    return P.split_bends(spark_sql(spark, sf, PEAKS)).select("spectrum_id", "band_no", "part")


@query("runs_test", with_views("d_spectra", """
, s AS (SELECT spectrum_id, y > 0 AS up, lag(y > 0) OVER (PARTITION BY spectrum_id ORDER BY idx) AS pr FROM d_spectra WHERE y <> 0),
c AS (SELECT spectrum_id, CAST(count(*) FILTER (WHERE up) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE NOT up) AS DOUBLE) AS n2, 1 + count(*) FILTER (WHERE up <> pr) AS runs FROM s GROUP BY 1),
v AS (SELECT *, 2 * n1 * n2 / (n1 + n2) + 1 AS mu, 2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / (power(n1 + n2, 2) * (n1 + n2 - 1)) AS va FROM c)
SELECT spectrum_id, round(CASE WHEN n1 < 8 OR n2 < 8 OR va <= 0 THEN 0 ELSE (runs - mu) / sqrt(va) END, 6) AS z FROM v"""))
def _(spark, sf):
    return _arrays(spark, sf).select("spectrum_id", F.round(S.runs_z(F.col("y")), 6).alias("z"))


FITS = "SELECT user_id * 7 + event_id % 7 AS spectrum_id, 300.0D AS lo, 2300.0D AS hi, 2000 AS n, 2.0D AS sigma, CASE WHEN (user_id * 7 + event_id % 7) % 2 = 0 THEN 4.0D END AS resolution FROM {events} GROUP BY user_id * 7 + event_id % 7"


@query("fit_quality_flags", f"""WITH b0 AS ({other_sql(PEAKS)}), b AS (SELECT spectrum_id, pos, max(fwhm) AS fwhm, max(height) AS height, (max(band_no) % 9) / 2.0 AS esd FROM b0 GROUP BY 1, 2),
 p AS (SELECT *, lag(pos) OVER w AS pp, lag(fwhm) OVER w AS pf, lag(esd) OVER w AS pe, CASE WHEN spectrum_id % 2 = 0 THEN 4.0 END AS res FROM b WINDOW w AS (PARTITION BY spectrum_id ORDER BY pos)),
 q AS (SELECT *, pos - pp AS sep, least(fwhm, pf) AS nar, greatest(fwhm, pf) AS bro FROM p)
SELECT spectrum_id, pos, 'closer than the resolution' AS flag FROM q WHERE sep < res UNION ALL SELECT spectrum_id, pos, 'closer than half a width' FROM q WHERE coalesce(NOT sep < res, true) AND sep < 0.5 * nar AND bro < 2 * nar
UNION ALL SELECT spectrum_id, pos, 'as uncertain as they are apart' FROM q WHERE sqrt(esd * esd + pe * pe) > 0.5 * sep AND bro < 2 * nar
UNION ALL SELECT spectrum_id, pos, 'narrower than the resolution' FROM q WHERE fwhm < res UNION ALL SELECT spectrum_id, pos, 'two or three points wide' FROM q WHERE coalesce(NOT fwhm < res, true) AND fwhm <= 2.5 * 2000.0 / 1999
UNION ALL SELECT spectrum_id, pos, 'under three noise deviations' FROM q WHERE height < 6 UNION ALL SELECT spectrum_id, pos, 'a background hump' FROM q WHERE fwhm >= 1000
UNION ALL SELECT spectrum_id, pos, 'on the edge of the region' FROM q WHERE pos - 300 < 0.25 * fwhm OR 2300 - pos < 0.25 * fwhm""")
def _(spark, sf):
    b = spark_sql(spark, sf, PEAKS).groupBy("spectrum_id", "pos").agg(F.max("fwhm").alias("fwhm"), F.max("height").alias("height"), F.expr("(max(band_no) % 9) / 2.0D").alias("pos_esd"))
    return P.fit_flags(b, spark_sql(spark, sf, FITS))


@query("curve_agreement")
def _(spark, sf):
    truth = _arrays(spark, sf).withColumnRenamed("spectrum_id", "curve_id")
    traced = truth.withColumn("x", F.transform("x", lambda v: v + 0.3)).withColumn("y", F.transform("y", lambda v: F.round(v, 2)))
    return P.curve_agreement(traced, truth).select("curve_id", "peaks", "matched", F.round("bias", 6).alias("bias"), F.round("r2", 6).alias("r2"))


@query("correlation_curves", with_views("d_bands", """
SELECT band_id, round(106.5 * power(700 + pos, -2.0 / 3.0) + 0.575, 6) AS d_nu1, round(91.41 * power(700 + pos, -2.0 / 3.0) + 0.804, 6) AS d_nu3,
  round(CASE WHEN 3000 + pos * 10 < 3592 THEN -0.1321 * ln((3592 - 3000 - pos * 10) / 304e9) END, 6) AS d_oo, round(CASE WHEN 3000 + pos * 10 < 3632 THEN -0.2146 * ln((3632 - 3000 - pos * 10) / 1.79e6) END, 6) AS d_ho,
  round(3592 - 304e9 * exp(-(2.6 + pos / 200) / 0.1321), 3) AS nu_oo, round(power(106.5 / (1.7 + pos / 500 - 0.575), 1.5), 6) AS nu1 FROM d_bands"""))
def _(spark, sf):
    pos = F.col("pos")
    return view(spark, sf, "d_bands").select(
        "band_id", F.round(S.uranyl_distance_nu1(700 + pos), 6).alias("d_nu1"), F.round(S.uranyl_distance_nu3(700 + pos), 6).alias("d_nu3"), F.round(S.hydrogen_bond_oo(3000 + pos * 10), 6).alias("d_oo"),
        F.round(S.hydrogen_bond_ho(3000 + pos * 10), 6).alias("d_ho"), F.round(S.stretch_from_oo(2.6 + pos / 200), 3).alias("nu_oo"), F.round(S.uranyl_nu1(1.7 + pos / 500), 6).alias("nu1"))
