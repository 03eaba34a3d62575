"""Named queries over the matching operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordaudit.operators import matching as M
from recordaudit.plans.registry import query
from recordaudit.plans.views import other_sql, spark_sql, view, with_views

# The recursive oracle takes the edges of an entry one by one, closest first; the lists carry how many
# copies of each value are used.
PAIR_SQL = """
, sides AS (SELECT entry_id, d, count(*) FILTER (WHERE side = 'L') AS nl, count(*) FILTER (WHERE side = 'R') AS nr FROM lists GROUP BY entry_id, d),
edges AS (SELECT a.entry_id, a.d AS l, b.d AS r, a.nl, b.nr, abs(a.d - b.d) AS dev,
   row_number() OVER (PARTITION BY a.entry_id ORDER BY abs(a.d - b.d), a.d DESC, b.d DESC) AS k
   FROM sides a JOIN sides b ON a.entry_id = b.entry_id AND a.nl > 0 AND b.nr > 0 AND abs(a.d - b.d) <= 0.0015 * greatest(a.d, 1.0) + 0.0006),
walk AS (SELECT DISTINCT entry_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(l DOUBLE, r DOUBLE, n BIGINT, lf BIGINT, rf BIGINT)[]) AS done FROM edges
  UNION ALL
  SELECT entry_id, k, CASE WHEN least(nl - ul, nr - ur) > 0 THEN list_append(done, {'l': l, 'r': r, 'n': least(nl - ul, nr - ur), 'lf': ul, 'rf': ur}) ELSE done END FROM (
    SELECT w.entry_id, e.k, w.done, e.l, e.r, e.nl, e.nr,
      CAST(coalesce(list_sum(list_transform(list_filter(w.done, lambda p: p.l = e.l), lambda p: p.n)), 0) AS BIGINT) AS ul,
      CAST(coalesce(list_sum(list_transform(list_filter(w.done, lambda p: p.r = e.r), lambda p: p.n)), 0) AS BIGINT) AS ur
    FROM walk w JOIN edges e ON e.entry_id = w.entry_id AND e.k = w.k + 1)),
pairs AS (SELECT entry_id, unnest(arg_max(done, k), recursive := true) FROM walk GROUP BY entry_id)
"""


@query("one_to_one_match", with_views("d_reflections", """
, lists AS (SELECT entry_id, d, CASE source WHEN 'obs' THEN 'L' ELSE 'R' END AS side FROM d_reflections)""" + PAIR_SQL + """
, lr AS (SELECT entry_id, line_no, d, row_number() OVER (PARTITION BY entry_id, d ORDER BY line_no) - 1 AS k FROM d_reflections WHERE source = 'obs'),
rr AS (SELECT entry_id, line_no, d, row_number() OVER (PARTITION BY entry_id, d ORDER BY line_no) - 1 AS k FROM d_reflections WHERE source = 'calc')
SELECT p.entry_id, lr.line_no AS obs_no, rr.line_no AS calc_no, round(abs(p.l - p.r), 6) AS dev FROM pairs p
JOIN lr ON lr.entry_id = p.entry_id AND lr.d = p.l AND lr.k >= p.lf AND lr.k < p.lf + p.n
JOIN rr ON rr.entry_id = p.entry_id AND rr.d = p.r AND rr.k = p.rf + lr.k - p.lf""", recursive=True))
def _(spark, sf):
    lines = view(spark, sf, "d_reflections").withColumn("line_no", F.col("line_no").cast("bigint"))
    obs = lines.where("source = 'obs'").select("entry_id", F.col("line_no").alias("obs_no"), "d")
    calc = lines.where("source = 'calc'").select("entry_id", F.col("line_no").alias("calc_no"), "d")
    return M.match_one_to_one(obs, calc, "entry_id", "obs_no", "calc_no", "d", "d").withColumn("dev", F.round("dev", 6))


# A paper's list and the list typed from it: some lines dropped, some intensities off, all d a touch away.
LISTS = """
SELECT CAST(floor(l_orderkey / 5) AS BIGINT) AS entry_id, 'L' AS side, CAST(10000 + (l_partkey % 400) * 100 + CAST(round(l_discount * 100) AS BIGINT) * 2 AS DOUBLE) / 10000 AS d, l_quantity * 2 AS i FROM {lineitem}
UNION ALL
SELECT CAST(floor(l_orderkey / 5) AS BIGINT), 'R', CAST(10003 + (l_partkey % 400) * 100 + CAST(round(l_discount * 100) AS BIGINT) * 2 AS DOUBLE) / 10000,
  CASE WHEN l_partkey % 37 = 0 THEN l_quantity * 0.2 ELSE l_quantity END FROM {lineitem} WHERE l_suppkey % 19 <> 0"""


def _lists(spark, sf):
    both = spark_sql(spark, sf, LISTS)
    return both.where("side = 'L'").drop("side"), both.where("side = 'R'").drop("side")


MISSING_SQL = PAIR_SQL + """
, obs AS (SELECT entry_id, d, max(i) AS i FROM lists WHERE side = 'L' GROUP BY ALL), own AS (SELECT entry_id, d, max(i) AS i FROM lists WHERE side = 'R' GROUP BY ALL),
sz AS (SELECT o.*, n_own, max_own, min_own, n_rows, n_pairs, max_own / max_obs AS scale FROM (SELECT entry_id, count(*) AS n_obs, max(i) AS max_obs FROM obs GROUP BY 1) o
  JOIN (SELECT entry_id, count(*) AS n_own, max(i) AS max_own, min(i) AS min_own FROM own GROUP BY 1) w USING (entry_id)
  JOIN (SELECT entry_id, count(*) AS n_rows FROM lists WHERE side = 'R' GROUP BY 1) q USING (entry_id)
  JOIN (SELECT entry_id, sum(1) AS n_pairs FROM dpairs GROUP BY 1) p USING (entry_id)
  WHERE n_obs >= 8 AND n_rows >= 8 AND n_pairs >= 0.9 * n_own AND n_obs - n_pairs BETWEEN 1 AND 4),
ab AS (SELECT o.*, sz.scale, sz.max_obs FROM obs o JOIN sz USING (entry_id) WHERE NOT EXISTS (SELECT 1 FROM dpairs p WHERE p.entry_id = o.entry_id AND p.l = o.d) AND o.i * sz.scale >= sz.min_own - 1e-9),
st AS (SELECT w.* FROM own w JOIN sz USING (entry_id) WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.entry_id = w.entry_id AND abs(w.d - o.d) <= 0.0015 * greatest(w.d, 1.0) + 0.0006)),
fd AS (SELECT ab.*, (SELECT max(st.d) FROM st WHERE st.entry_id = ab.entry_id AND abs(st.d - ab.d) / ab.d < 0.03 AND abs(st.i - ab.i * ab.scale) <= 0.02 * greatest(st.i, 1.0) + 0.5) AS twin FROM ab)
SELECT entry_id, d, i, twin, CASE WHEN bool_or(twin IS NOT NULL OR 100.0 * i / max_obs >= 5) OVER (PARTITION BY entry_id) THEN 'flag' ELSE 'note' END AS sev FROM fd"""

# both sides are lists of distinct d here, so the pairs are taken on a deduplicated copy
DISTINCT_PAIRS = PAIR_SQL.replace("FROM lists GROUP BY entry_id, d)", "FROM (SELECT DISTINCT entry_id, side, d FROM plist) GROUP BY entry_id, d)").replace("pairs AS (", "dpairs AS (")


MISSING_LINES = f"WITH RECURSIVE lists AS ({other_sql(LISTS)}), plist AS (SELECT * FROM lists)" + DISTINCT_PAIRS + MISSING_SQL[len(PAIR_SQL):]


@query("missing_lines", MISSING_LINES)
def _(spark, sf):
    return M.missing_lines(*_lists(spark, sf))


INTENSITY_OUTLIERS = f"""WITH RECURSIVE lists AS ({other_sql(LISTS)}), obs AS (SELECT entry_id, d, max(i) AS pi FROM lists WHERE side = 'L' GROUP BY ALL HAVING count(*) = 1),
 own AS (SELECT entry_id, d, max(i) AS oi FROM lists WHERE side = 'R' GROUP BY ALL HAVING max(i) = min(i)),
 plist AS (SELECT entry_id, 'L' AS side, d FROM obs UNION ALL SELECT entry_id, 'R', d FROM own)""" + DISTINCT_PAIRS + """
, ln AS (SELECT p.entry_id, p.r AS d, oi, pi, oi / pi AS ratio FROM dpairs p JOIN obs ON obs.entry_id = p.entry_id AND obs.d = p.l JOIN own ON own.entry_id = p.entry_id AND own.d = p.r),
rk AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY ratio) - 1 AS k, count(*) OVER (PARTITION BY entry_id) AS n, max(oi) OVER (PARTITION BY entry_id) AS top FROM ln),
sc AS (SELECT entry_id, ratio AS scale, n, top FROM rk WHERE k = n // 2 AND n >= 8),
us AS (SELECT sc.* FROM sc JOIN (SELECT entry_id, count(*) AS n_own FROM own GROUP BY 1) a USING (entry_id) JOIN (SELECT entry_id, count(*) AS n_obs FROM obs GROUP BY 1) b USING (entry_id)
  WHERE n_own >= 8 AND n_obs >= 8 AND n >= 0.9 * n_own),
jd AS (SELECT ln.*, pi * scale AS want, abs(oi - pi * scale) <= greatest(0.15 * greatest(oi, pi * scale), 2.0 * top / 100.0) AS near,
   greatest(oi, pi * scale) >= 2 * greatest(least(oi, pi * scale), 1e-9) AND abs(oi - pi * scale) >= 10.0 * top / 100.0 AS off FROM ln JOIN us USING (entry_id)),
kp AS (SELECT entry_id FROM jd GROUP BY entry_id HAVING count(*) FILTER (WHERE near) >= 0.8 * count(*) AND count(*) FILTER (WHERE off) BETWEEN 1 AND 3)
SELECT entry_id, d, oi AS own_i, round(want, 1) AS want_i FROM jd WHERE off AND entry_id IN (SELECT entry_id FROM kp)"""


@query("intensity_outliers", INTENSITY_OUTLIERS)
def _(spark, sf):
    return M.intensity_outliers(*_lists(spark, sf))


POWDER = """
SELECT CAST(floor(l_orderkey / 5) AS BIGINT) AS entry_id, l_linestatus AS st,
  row_number() OVER (PARTITION BY floor(l_orderkey / 5), l_linestatus ORDER BY l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice) AS line_no,
  CAST(10000 + (l_partkey % 400) * 100 AS DOUBLE) / 10000 AS d, l_quantity * 2 AS i, CASE WHEN l_quantity < 30 THEN CAST(l_suppkey % 4 AS INT) END AS h,
  CASE WHEN l_quantity < 30 THEN CAST(l_partkey % 3 AS INT) END AS k, CASE WHEN l_quantity < 30 THEN CAST(l_linenumber AS INT) END AS l FROM {lineitem}"""


# the walk takes the unindexed lines of an entry in their turns; an offer is shut from the turn at which its own index takes it
MERGE_SQL = f"""WITH RECURSIVE lines AS ({other_sql(POWDER)}),
 o AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY peak_no, line_no) AS turn FROM (
   SELECT entry_id, line_no, d, i, h, k, l, min(line_no) OVER w AS peak_no, first_value(d) OVER (w ORDER BY line_no) AS peak_d, first_value(i) OVER (w ORDER BY line_no) AS peak_i
   FROM lines WHERE st = 'O' WINDOW w AS (PARTITION BY entry_id, round(d, 4), round(i, 2)))),
 c AS (SELECT entry_id, line_no AS calc_no, d AS d_calc, i AS i_calc, h AS ch, k AS ck, l AS cl FROM lines WHERE st = 'F'),
 fh AS (SELECT entry_id, ch AS h, ck AS k, cl AS l, min(calc_no) AS own_no FROM c WHERE ch IS NOT NULL GROUP BY ALL),
 oi AS (SELECT o.*, own_no FROM o LEFT JOIN fh USING (entry_id, h, k, l)),
 sh AS (SELECT entry_id, own_no AS calc_no, min(turn) AS shut FROM oi WHERE own_no IS NOT NULL GROUP BY ALL),
 f AS (SELECT c.*, shut FROM c LEFT JOIN sh USING (entry_id, calc_no)),
 a AS (SELECT entry_id, line_no, d, turn, row_number() OVER (PARTITION BY entry_id ORDER BY turn) AS step FROM oi WHERE own_no IS NULL),
 walk AS (SELECT entry_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS line_no, CAST(NULL AS BIGINT) AS got, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT entry_id FROM a)
   UNION ALL
   SELECT entry_id, step, line_no, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END FROM (
     SELECT w.entry_id, a.step, a.line_no, w.used, (SELECT arg_min(f.calc_no, (abs(f.d_calc - a.d), f.calc_no)) FROM f
        WHERE f.entry_id = a.entry_id AND abs(f.d_calc - a.d) <= 0.012::DOUBLE * greatest(a.d, 0.0) AND coalesce(a.turn < f.shut, true) AND NOT list_contains(w.used, f.calc_no)) AS got
     FROM walk w JOIN a ON a.entry_id = w.entry_id AND a.step = w.step + 1)),
 t AS (SELECT oi.*, coalesce(own_no, w.got) AS calc_no FROM oi LEFT JOIN walk w ON w.entry_id = oi.entry_id AND w.line_no = oi.line_no),
 ob AS (SELECT t.entry_id, peak_no, i AS i_obs, d AS d_obs, d_calc, i_calc, CASE WHEN ch IS NOT NULL THEN ch ELSE h END AS h, CASE WHEN ch IS NOT NULL THEN ck ELSE k END AS k, CASE WHEN ch IS NOT NULL THEN cl ELSE l END AS l
   FROM t LEFT JOIN c ON c.entry_id = t.entry_id AND c.calc_no = t.calc_no),
 fr AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.entry_id = c.entry_id AND t.calc_no = c.calc_no)),
 pk AS (SELECT DISTINCT entry_id, peak_no, peak_d, peak_i FROM o WHERE peak_i >= 3.5),
 att AS (SELECT fr.entry_id, fr.calc_no, arg_min({{'no': peak_no, 'd': peak_d, 'i': peak_i}}, (abs(peak_d - d_calc), peak_no)) AS p FROM fr JOIN pk ON pk.entry_id = fr.entry_id AND abs(peak_d - d_calc) <= 0.012::DOUBLE * greatest(peak_d, 0.0) GROUP BY ALL),
 rw AS (SELECT * FROM ob UNION ALL SELECT fr.entry_id, p.no, p.i, p.d, d_calc, i_calc, ch, ck, cl FROM fr LEFT JOIN att USING (entry_id, calc_no)),
 st AS (SELECT *, bool_or(coalesce(i_calc >= 3.5, false)) OVER (PARTITION BY entry_id, peak_no) AS strong,
   max({{'i': coalesce(i_calc, -1.0), 'd': -coalesce(d_calc, 0.0)}}) OVER (PARTITION BY entry_id, peak_no) AS top FROM rw),
 bs AS (SELECT entry_id, peak_no, arg_max({{'h': h, 'k': k, 'l': l}}, (coalesce(i_calc, -1.0), -coalesce(d_calc, 0.0), coalesce(h, -99), coalesce(k, -99), coalesce(l, -99))) AS best FROM rw WHERE peak_no IS NOT NULL GROUP BY ALL),
 jd AS (SELECT st.*, best, i_obs IS NOT NULL AND coalesce(i_calc < 3.5, true) AS weak FROM st LEFT JOIN bs ON bs.entry_id = st.entry_id AND bs.peak_no = st.peak_no WHERE greatest(coalesce(i_obs, 0), coalesce(i_calc, 0)) >= 3.5)
SELECT entry_id, peak_no, i_obs, d_obs, CASE WHEN NOT weak THEN d_calc END AS d_calc, CASE WHEN NOT weak THEN i_calc END AS i_calc, h, k, l FROM jd WHERE NOT weak OR (NOT strong AND h IS NOT DISTINCT FROM best.h AND k IS NOT DISTINCT FROM best.k AND l IS NOT DISTINCT FROM best.l)"""


@query("merge_obs_calc", MERGE_SQL)
def _(spark, sf):
    lines = spark_sql(spark, sf, POWDER)
    return M.merge_obs_calc(lines.where("st = 'O'").drop("st"), lines.where("st = 'F'").drop("st"))


@query("strongest_peaks", with_views("d_reflections", """
SELECT entry_id, line_no AS peak_no, i AS i_obs, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY i DESC, line_no) AS INT) AS place FROM d_reflections WHERE source = 'obs' QUALIFY place <= 8"""))
def _(spark, sf):
    rows = view(spark, sf, "d_reflections").where("source = 'obs'").select("entry_id", F.col("line_no").cast("bigint").alias("peak_no"), F.col("i").alias("i_obs"))
    return M.strongest_peaks(rows)


STATED = """
SELECT user_id AS doc_id, event_id AS no, event_type IN ('view', 'error') AS said, floor(value * 400) / 20 AS pos FROM {events}"""


@query("stated_against_fitted", f"""WITH RECURSIVE s AS ({other_sql(STATED)}), f AS (SELECT doc_id, no AS fit_no, pos AS fit_pos FROM s WHERE NOT said),
 a AS (SELECT doc_id, no AS said_no, pos AS said_pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos, no) AS turn FROM s WHERE said),
 walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS got, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT doc_id FROM a)
   UNION ALL
   SELECT doc_id, turn, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END FROM (
     SELECT w.doc_id, a.turn, w.used, (SELECT arg_min(f.fit_no, (abs(f.fit_pos - a.said_pos), f.fit_no)) FROM f WHERE f.doc_id = a.doc_id AND abs(f.fit_pos - a.said_pos) <= 6.0 AND NOT list_contains(w.used, f.fit_no)) AS got
     FROM walk w JOIN a ON a.doc_id = w.doc_id AND a.turn = w.turn + 1)),
 p AS (SELECT a.doc_id, a.said_no, a.said_pos, w.got AS fit_no FROM a JOIN walk w ON w.doc_id = a.doc_id AND w.turn = a.turn)
SELECT coalesce(p.doc_id, f.doc_id) AS doc_id, said_no, said_pos, coalesce(p.fit_no, f.fit_no) AS fit_no, fit_pos, CASE WHEN said_no IS NULL THEN 'not_stated' WHEN f.fit_no IS NULL THEN 'not_fitted' ELSE 'matched' END AS state
FROM p FULL JOIN f ON f.doc_id = p.doc_id AND f.fit_no = p.fit_no""")
def _(spark, sf):
    s = spark_sql(spark, sf, STATED)
    fitted = s.where("NOT said").select("doc_id", F.col("no").alias("fit_no"), F.col("pos").alias("fit_pos"))
    stated = s.where("said").select("doc_id", F.col("no").alias("said_no"), F.col("pos").alias("said_pos"))
    return M.match_stated(fitted, stated, "doc_id")


CELLS = "SELECT p_partkey AS entry_id, p_name AS name, CAST(3000 + (p_size % 17) * 250 AS DOUBLE) / 1000 AS a, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(3000 + (p_partkey % 13) * 250 AS DOUBLE) / 1000 END AS b, CAST(3000 + (p_partkey % 11) * 250 AS DOUBLE) / 1000 AS c FROM {part}"
STATED_CELLS = """
SELECT l_orderkey * 8 + l_linenumber AS cand_id, l_partkey AS entry_id, CASE WHEN l_suppkey % 4 = 0 THEN 'small ring' ELSE 'other phase' END AS phase, CASE l_returnflag WHEN 'A' THEN 'powder' WHEN 'N' THEN 'single' ELSE 'unknown' END AS context,
  CAST(3000 + (p_size % 17) * 250 + q AS DOUBLE) / 1000 AS ca, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(3000 + (l_partkey % 13) * 250 + q * 2 AS DOUBLE) / 1000 END AS cb, CAST(3000 + (l_partkey % 11) * 250 - q AS DOUBLE) / 1000 AS cc
FROM (SELECT *, CAST(l_quantity AS BIGINT) % 23 - 4 AS q FROM {lineitem}) x JOIN {part} ON p_partkey = l_partkey"""
BEST_SQL = f"""e AS ({other_sql(CELLS)}), k AS ({other_sql(STATED_CELLS)}),
 j AS (SELECT e.*, k.cand_id, k.phase, k.context, k.ca, coalesce(k.cb, k.ca) AS cb, k.cc FROM k JOIN e USING (entry_id)),
 s AS (SELECT *, list_sort(list_filter([a, b, c], lambda v: v IS NOT NULL)) AS own, list_sort([ca, cb, cc]) AS theirs FROM j),
 md AS (SELECT entry_id, cand_id, name, phase, context, 'direct' AS mode, CASE WHEN b IS NULL THEN [a, c] ELSE [a, b, c] END AS x, CASE WHEN b IS NULL THEN [ca, cc] ELSE [ca, cb, cc] END AS y FROM s
   UNION ALL SELECT entry_id, cand_id, name, phase, context, 'reordered', own, theirs FROM s WHERE len(own) = len(theirs)),
 sc AS (SELECT *, len(x) AS n_comparable, CASE WHEN len(x) = 3 THEN abs(x[1] - y[1]) + abs(x[2] - y[2]) + abs(x[3] - y[3]) ELSE abs(x[1] - y[1]) + abs(x[2] - y[2]) END AS dev,
   CAST(abs(x[1] - y[1]) <= 0.004 AS INT) + CAST(abs(x[2] - y[2]) <= 0.004 AS INT) + CASE WHEN len(x) = 3 THEN CAST(abs(x[3] - y[3]) <= 0.004 AS INT) ELSE 0 END AS n_match,
   CASE WHEN regexp_replace(lower(name), '[^a-z]', '', 'g')[1:6] = regexp_replace(lower(phase), '[^a-z]', '', 'g')[1:6] THEN 1 ELSE 0 END AS ph FROM md),
 best AS (SELECT entry_id, cand_id, mode, n_match, n_comparable, dev FROM sc QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY n_match DESC, round(dev, 3), ph DESC, dev, context = 'powder' DESC, cand_id, mode = 'direct' DESC) = 1)"""


@query("best_candidate", f"WITH {BEST_SQL} SELECT entry_id, cand_id, mode, CAST(n_match AS INT) AS n_match, CAST(n_comparable AS INT) AS n_comparable, round(dev, 6) AS dev FROM best")
def _(spark, sf):
    return M.best_candidate(spark_sql(spark, sf, CELLS), spark_sql(spark, sf, STATED_CELLS)).withColumn("dev", F.round("dev", 6))


@query("powder_conflict", f"""WITH {BEST_SQL}, pw AS (SELECT s.entry_id, s.cand_id,
   abs(theirs[1] - own[1]) <= 0.004 AND abs(theirs[2] - own[2]) <= 0.004 AND abs(theirs[3] - own[3]) <= 0.004 AS eq,
   abs(theirs[1] - own[1]) <= 0.10 * own[1] AND abs(theirs[2] - own[2]) <= 0.10 * own[2] AND abs(theirs[3] - own[3]) <= 0.10 * own[3] AS same, b.cand_id AS chosen
   FROM (SELECT s2.*, k.cb AS raw_b FROM s s2 JOIN k ON k.cand_id = s2.cand_id AND k.entry_id = s2.entry_id) s LEFT JOIN best b ON b.entry_id = s.entry_id WHERE context = 'powder' AND len(own) = 3 AND raw_b IS NOT NULL)
SELECT entry_id, min(cand_id) FILTER (WHERE same AND NOT eq AND cand_id IS DISTINCT FROM chosen) AS cand_id FROM pw GROUP BY entry_id HAVING NOT bool_or(eq) AND min(cand_id) FILTER (WHERE same AND NOT eq AND cand_id IS DISTINCT FROM chosen) IS NOT NULL""")
def _(spark, sf):
    entries, stated = spark_sql(spark, sf, CELLS), spark_sql(spark, sf, STATED_CELLS)
    return M.powder_conflict(entries, stated, M.best_candidate(entries, stated))


BONDS = "SELECT l_suppkey AS cation, l_returnflag AS anion, floor(l_extendedprice / 7) / 10000 + 1.5 AS dist, CAST(l_linenumber AS BIGINT) AS n FROM {lineitem}"


@query("merge_close_bonds", f"""WITH b AS ({other_sql(BONDS)}), g AS (SELECT *, CASE WHEN dist - lag(dist) OVER w > 0.0015 THEN 1 ELSE 0 END AS br FROM b WINDOW w AS (PARTITION BY cation, anion ORDER BY dist)),
 p AS (SELECT *, sum(br) OVER (PARTITION BY cation, anion ORDER BY dist ROWS UNBOUNDED PRECEDING) AS piece FROM g)
SELECT cation, anion, round(min(dist), 6) AS dist, CAST(sum(n) AS BIGINT) AS n, count(*) AS "rows" FROM p GROUP BY cation, anion, piece""")
def _(spark, sf):
    return M.merge_close_rows(spark_sql(spark, sf, BONDS), ("cation", "anion")).withColumn("dist", F.round("dist", 6))
