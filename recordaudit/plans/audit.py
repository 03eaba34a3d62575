"""Named queries over the audit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordaudit.operators import audit as A, reconcile as R
from recordaudit.plans.registry import query
from recordaudit.plans.views import other_sql, spark_sql, spread, view, with_views
from recordaudit.session import cut_lineage

# --- reconciling printed numbers -------------------------------------------------------------

PARSED = r"""
, parsed AS (
  SELECT *, regexp_extract(regexp_replace(left_txt, '\(\d+\)', ''), '^(-?\d+(?:\.\d+)?)', 1) AS lm,
    regexp_extract(regexp_replace(right_txt, '\(\d+\)', ''), '^(-?\d+(?:\.\d+)?)', 1) AS rm,
    regexp_extract(left_txt, '\((\d+)\)', 1) AS le, regexp_extract(right_txt, '\((\d+)\)', 1) AS re FROM d_printed),
placed AS (
  SELECT *, length(split_part(lm, '.', 2)) AS ld, length(split_part(rm, '.', 2)) AS rd FROM parsed),
compared AS (
  SELECT *, CASE least(ld, rd)
     WHEN 2 THEN round(CAST(lm AS DECIMAL(18,6)), 2) <> round(CAST(rm AS DECIMAL(18,6)), 2)
     WHEN 3 THEN round(CAST(lm AS DECIMAL(18,6)), 3) <> round(CAST(rm AS DECIMAL(18,6)), 3) END AS differ FROM placed),
issues AS (
  SELECT entry_id, item, left_txt, right_txt, 'value' AS kind FROM compared WHERE differ
  UNION ALL SELECT entry_id, item, left_txt, right_txt, 'precision' FROM compared WHERE NOT differ AND ld <> rd
  UNION ALL SELECT entry_id, item, left_txt, right_txt, 'esd' FROM compared WHERE NOT differ AND le <> '' AND re <> '' AND le <> re)
"""


@query("reconcile_printed", with_views("d_printed", PARSED + "SELECT entry_id, item, kind, left_txt, right_txt FROM issues"))
def _(spark, sf):
    return R.reconcile_values(spread(view(spark, sf, "d_printed"))).select("entry_id", "item", "kind", "left_txt", "right_txt")


@query("reconcile_fire_table", with_views("d_printed", PARSED + """
SELECT kind AS code, count(*) AS total, count(*) FILTER (WHERE entry_id % 3 <> 0) AS new_tpl,
  count(*) FILTER (WHERE entry_id % 3 = 0) AS old_tpl, count(*) AS flags FROM issues GROUP BY kind"""))
def _(spark, sf):
    issues = R.reconcile_values(spread(view(spark, sf, "d_printed")))
    return A.fire_table(issues.withColumn("code", F.col("kind")).withColumn("new_template", F.expr("entry_id % 3 <> 0")))


@query("measured_numbers", with_views("d_printed", PARSED + """
SELECT rd AS decimals, count(*) AS n, count(*) FILTER (WHERE re <> '') AS with_esd, round(sum(CAST(rm AS DOUBLE)), 3) AS total,
  round(sum(CASE WHEN re <> '' THEN CAST(re AS DOUBLE) * power(10.0, -rd) END), 3) AS total_esd FROM placed GROUP BY rd"""))
def _(spark, sf):
    from recordaudit.functions.measured import parse_measured

    m = view(spark, sf, "d_printed").select(parse_measured(F.col("right_txt")).alias("m")).select("m.*")
    return m.groupBy(F.col("decimals").cast("bigint").alias("decimals")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("esd").alias("with_esd"),
        F.round(F.sum("value"), 3).alias("total"),
        F.round(F.sum("esd"), 3).alias("total_esd"),
    )


@query("half_up_rounding", other_sql("""
SELECT l_orderkey AS entry_id, l_linenumber AS item, l_suppkey AS supp, l_extendedprice AS price,
  CASE l_linenumber % 3 WHEN 0 THEN CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)), 0) AS DOUBLE)
    WHEN 1 THEN CAST(round(CAST(l_extendedprice / 8 AS DECIMAL(18,5)), 1) AS DOUBLE)
    ELSE CAST(round(CAST(l_extendedprice / 8 AS DECIMAL(18,5)), 2) AS DOUBLE) END AS rounded FROM {lineitem}"""))
def _(spark, sf):
    from recordaudit.functions.measured import round_half_up

    rows = spark_sql(spark, sf, """
        SELECT l_orderkey AS entry_id, l_linenumber AS item, l_suppkey AS supp, l_extendedprice AS price,
          CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice ELSE l_extendedprice / 8 END AS v, l_linenumber % 3 AS k FROM {lineitem}""")
    exact = F.col("v").cast("decimal(18,5)").cast("double")
    return rows.select("entry_id", "item", "supp", "price", round_half_up(exact, F.col("k")).alias("rounded"))


CELL_STRINGS = """
SELECT l_orderkey AS entry_id, CASE l_linenumber WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' WHEN 4 THEN 'al' WHEN 5 THEN 'be' ELSE 'ga' END AS axis,
  min(CASE WHEN l_linenumber >= 4 AND l_suppkey % 2 = 0 THEN '90' ELSE CAST(CAST(5 + (l_orderkey % 7) AS DECIMAL(6,2)) AS STRING) END) AS left_txt,
  min(CASE WHEN l_linenumber >= 4 AND l_suppkey % 3 = 0 THEN CAST(NULL AS STRING) WHEN l_linenumber >= 4 AND l_suppkey % 3 = 1 THEN '90'
      ELSE concat(CAST(CAST(5 + (l_orderkey % 7) AS DECIMAL(6,3)) AS STRING), '(2)') END) AS right_txt
FROM {lineitem} GROUP BY l_orderkey, CASE l_linenumber WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' WHEN 4 THEN 'al' WHEN 5 THEN 'be' ELSE 'ga' END"""


@query("reconcile_cells", f"""WITH cells AS ({other_sql(CELL_STRINGS)}),
k AS (SELECT *, CASE axis WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'c' THEN 3 WHEN 'al' THEN 4 WHEN 'be' THEN 5 ELSE 6 END AS k,
   TRY_CAST(regexp_replace(left_txt, '\\(\\d+\\)', '') AS DOUBLE) AS lv, TRY_CAST(regexp_replace(right_txt, '\\(\\d+\\)', '') AS DOUBLE) AS rv FROM cells),
g AS (SELECT entry_id, left_txt, right_txt, lv, rv, string_agg(axis, '=' ORDER BY k) AS label, min_by(axis, k) AS anchor FROM k
  WHERE NOT coalesce(k >= 4 AND lv IN (90, 120) AND (rv IS NULL OR rv = lv), false) GROUP BY entry_id, left_txt, right_txt, lv, rv),
d AS (SELECT *, length(split_part(regexp_replace(left_txt, '\\(\\d+\\)', ''), '.', 2)) AS ld,
   length(split_part(regexp_replace(right_txt, '\\(\\d+\\)', ''), '.', 2)) AS rd FROM g WHERE rv IS NOT NULL)
SELECT entry_id, label, anchor, CASE WHEN round(lv, CAST(least(ld, rd) AS INT)) <> round(rv, CAST(least(ld, rd) AS INT)) THEN 'value' ELSE 'precision' END AS kind, left_txt, right_txt
FROM d WHERE round(lv, CAST(least(ld, rd) AS INT)) <> round(rv, CAST(least(ld, rd) AS INT)) OR ld <> rd""")
def _(spark, sf):
    return R.reconcile_cells(spark_sql(spark, sf, CELL_STRINGS))


@query("vouch_join", with_views("d_printed", PARSED + """
SELECT i.kind, CASE WHEN i.kind <> 'value' AND i.left_txt = CASE WHEN i.item % 2 = 0 THEN i.left_txt ELSE i.right_txt END THEN 'note' ELSE 'flag' END AS sev,
  count(*) AS n FROM issues i GROUP BY ALL"""))
def _(spark, sf):
    pairs = view(spark, sf, "d_printed").withColumn("third", F.expr("CASE WHEN item % 2 = 0 THEN left_txt ELSE right_txt END"))
    return R.reconcile_values(pairs, vouch="third").groupBy("kind", "sev").agg(F.count(F.lit(1)).alias("n"))


# --- fire tables and snapshot comparison -----------------------------------------------------


@query("fire_table", with_views("d_findings", """
SELECT run_id, code, count(*) AS total, count(*) FILTER (WHERE new_template) AS new_tpl, count(*) FILTER (WHERE NOT new_template) AS old_tpl,
  count(*) FILTER (WHERE sev = 'flag') AS flags FROM d_findings GROUP BY run_id, code"""))
def _(spark, sf):
    return A.fire_table(view(spark, sf, "d_findings"), ("run_id", "code"))


ENTRIES = """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS run_id, o_orderkey AS entry_id, o_orderkey % 3 <> 0 AS new_template,
  CASE o_orderstatus WHEN 'O' THEN 'match' WHEN 'F' THEN 'mismatch' ELSE NULL END AS cell,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'a' END AS article, CASE WHEN o_custkey % 3 = 0 THEN 's' END AS structure,
  CASE WHEN o_totalprice < 20000 THEN 'KeyError' END AS error,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'flag' WHEN o_orderpriority LIKE '2%' THEN 'verify' WHEN o_orderpriority LIKE '3%' THEN 'ok' END AS lam FROM {orders}"""


@query("verdict_distribution", f"WITH e AS ({other_sql(ENTRIES)}) SELECT cell AS verdict, count(*) AS n FROM e WHERE cell IS NOT NULL GROUP BY cell")
def _(spark, sf):
    return A.verdict_distribution(spark_sql(spark, sf, ENTRIES), "cell")


@query("snapshot_meta", f"""WITH e AS ({other_sql(ENTRIES)}) SELECT run_id, count(*) AS n_entries, count(*) FILTER (WHERE new_template) AS n_new_template,
  count(article) AS n_article, count(structure) AS n_structure, count(error) AS n_crash FROM e GROUP BY run_id""")
def _(spark, sf):
    return A.snapshot_meta(spark_sql(spark, sf, ENTRIES))


def _runs(spark, sf):
    f = view(spark, sf, "d_findings").withColumn("token", F.concat_ws("/", "code", "sev"))
    return f.where("run_id = 1"), f.where("run_id = 2")


@query("code_deltas", with_views("d_findings", """
SELECT code, CAST(sum(CASE run_id WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS before, CAST(sum(CASE run_id WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS after,
  CAST(sum(CASE run_id WHEN 1 THEN -1 ELSE 1 END) AS BIGINT) AS delta FROM d_findings GROUP BY code HAVING sum(CASE run_id WHEN 1 THEN -1 ELSE 1 END) <> 0"""))
def _(spark, sf):
    return A.code_deltas(*_runs(spark, sf))


@query("snapshot_diff", with_views("d_findings", """
, t AS (SELECT run_id, entry_id, code || '/' || sev AS token, count(*) AS n FROM d_findings GROUP BY ALL),
 o AS (SELECT * FROM t WHERE run_id = 1), w AS (SELECT * FROM t WHERE run_id = 2)
SELECT coalesce(o.entry_id, w.entry_id) AS entry_id, coalesce(o.token, w.token) AS token,
  CAST(greatest(coalesce(w.n, 0) - coalesce(o.n, 0), 0) AS BIGINT) AS gained, CAST(greatest(coalesce(o.n, 0) - coalesce(w.n, 0), 0) AS BIGINT) AS lost
FROM o FULL JOIN w ON o.entry_id = w.entry_id AND o.token = w.token
WHERE coalesce(o.n, 0) <> coalesce(w.n, 0) AND coalesce(o.entry_id, w.entry_id) IN (SELECT entry_id FROM o) AND coalesce(o.entry_id, w.entry_id) IN (SELECT entry_id FROM w)"""))
def _(spark, sf):
    return A.token_changes(*_runs(spark, sf))


@query("snapshot_membership", with_views("d_findings", """
SELECT entry_id, CASE WHEN max(run_id) = 2 THEN 'added' ELSE 'removed' END AS change FROM d_findings GROUP BY entry_id HAVING min(run_id) = max(run_id)"""))
def _(spark, sf):
    return A.entry_membership(*_runs(spark, sf))


@query("crash_changes", f"""WITH e AS ({other_sql(ENTRIES)}), o AS (SELECT DISTINCT entry_id // 4 AS k FROM e WHERE run_id = 1 AND error IS NOT NULL),
 n AS (SELECT DISTINCT entry_id // 4 AS k FROM e WHERE run_id = 2 AND error IS NOT NULL)
SELECT coalesce(o.k, n.k) AS entry_id, CASE WHEN o.k IS NULL THEN 'new' ELSE 'resolved' END AS crash FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL""")
def _(spark, sf):
    e = spark_sql(spark, sf, ENTRIES).withColumn("entry_id", F.expr("entry_id div 4"))
    return A.crash_changes(e.where("run_id = 1"), e.where("run_id = 2"))


@query("run_diff_by_signature", with_views("d_findings", """
, t AS (SELECT entry_id, code, sev, count(*) FILTER (WHERE run_id = 1) AS o, count(*) FILTER (WHERE run_id = 2) AS n FROM d_findings GROUP BY ALL)
SELECT entry_id, CASE WHEN sum(o) = 0 THEN 'added' WHEN sum(n) = 0 THEN 'gone' ELSE 'changed' END AS change, CAST(sum(o) AS BIGINT) AS n_old, CAST(sum(n) AS BIGINT) AS n_new
FROM t GROUP BY entry_id HAVING count(*) FILTER (WHERE o <> n) > 0"""))
def _(spark, sf):
    old, new = _runs(spark, sf)
    return A.run_diff(old, new, "entry_id", ("code", "sev"))


STATUSES = """
SELECT CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS run_id, l_suppkey AS doc_id, concat('field', CAST(l_linenumber AS STRING)) AS field,
  CASE sum(l_partkey) % 3 WHEN 0 THEN 'agrees' WHEN 1 THEN 'disagrees' ELSE 'unverified' END AS status FROM {lineitem}
GROUP BY l_linestatus, l_suppkey, l_linenumber HAVING sum(l_orderkey) % 7 <> 0"""


@query("reader_transitions", f"""WITH s AS ({other_sql(STATUSES)}), docs AS (SELECT doc_id FROM s GROUP BY doc_id HAVING count(DISTINCT run_id) = 2),
 f AS (SELECT doc_id, field, coalesce(max(status) FILTER (WHERE run_id = 1), 'none') AS old_status, coalesce(max(status) FILTER (WHERE run_id = 2), 'none') AS new_status
   FROM s WHERE doc_id IN (SELECT doc_id FROM docs) GROUP BY doc_id, field)
SELECT field, old_status, new_status, count(*) AS n, min(doc_id) AS example FROM f WHERE old_status <> new_status GROUP BY ALL""")
def _(spark, sf):
    s = spark_sql(spark, sf, STATUSES)
    return A.status_transitions(s.where("run_id = 1"), s.where("run_id = 2"))


FEATURES = "SELECT s_suppkey AS doc_id, concat('field', CAST(k AS STRING)) AS field, (s_suppkey + k) % 3 <> 0 AS present FROM (SELECT s_suppkey, explode(sequence(1, 7)) AS k FROM {supplier}) t"
FEATURES_SQL = other_sql(FEATURES).replace("explode(sequence(1, 7))", "unnest(range(1, 8))")


@query("verified_rate", f"""WITH s AS ({other_sql(STATUSES)}), p AS ({FEATURES_SQL}),
 j AS (SELECT p.field, coalesce(s.status, 'none') AS status FROM p LEFT JOIN s ON s.run_id = 1 AND s.doc_id = p.doc_id AND s.field = p.field WHERE p.present)
SELECT field, count(*) AS n, count(*) FILTER (WHERE status = 'agrees') AS agrees, count(*) FILTER (WHERE status = 'disagrees') AS disagrees,
  count(*) FILTER (WHERE status = 'unverified') AS unverified, count(*) FILTER (WHERE status = 'nooracle') AS nooracle, count(*) FILTER (WHERE status = 'none') AS "none",
  round(100.0 * count(*) FILTER (WHERE status = 'agrees') / count(*), 4) AS agree_pct FROM j GROUP BY field""")
def _(spark, sf):
    return A.verified_rate(spark_sql(spark, sf, STATUSES).where("run_id = 1"), spark_sql(spark, sf, FEATURES))


@query("all_agree_rate", f"""WITH s AS ({other_sql(STATUSES)}), p AS ({FEATURES_SQL}),
 w AS (SELECT doc_id FROM p WHERE present AND field IN ('field1','field3') GROUP BY doc_id HAVING count(DISTINCT field) = 2),
 a AS (SELECT doc_id FROM s WHERE run_id = 1 AND status = 'agrees' AND field IN ('field1','field3') GROUP BY doc_id HAVING count(DISTINCT field) = 2)
SELECT count(*) AS n, count(a.doc_id) AS all_agree FROM w LEFT JOIN a ON a.doc_id = w.doc_id""")
def _(spark, sf):
    return A.all_agree_rate(spark_sql(spark, sf, STATUSES).where("run_id = 1"), spark_sql(spark, sf, FEATURES), ("field1", "field3"))


# --- triage ----------------------------------------------------------------------------------

NUMBERED = """
SELECT l_orderkey AS entry_id, concat('chk', CAST(l_linenumber % 3 AS STRING)) AS code, 'cell:a' AS anchor, concat(repeat('a long message ', 12), l_returnflag) AS msg,
  l_suppkey AS ord, l_partkey AS ord2, l_extendedprice AS ord3 FROM {lineitem}"""


@query("finding_keys", f"""WITH f AS ({other_sql(NUMBERED)}), k AS (SELECT entry_id, code, 'f:' || sha1(code || '|' || anchor || '|' || msg) AS b, ord, ord2, ord3 FROM f),
 r AS (SELECT *, row_number() OVER (PARTITION BY entry_id, b ORDER BY ord, ord2, ord3) AS c FROM k)
SELECT entry_id, code, CASE WHEN c = 1 THEN b ELSE b || '#' || c END AS finding_key FROM r""")
def _(spark, sf):
    return A.number_keys(spark_sql(spark, sf, NUMBERED), ("ord", "ord2", "ord3")).select("entry_id", "code", "finding_key")


TRIAGE = """
SELECT l_orderkey AS entry_id, concat('chk', CAST(l_linenumber AS STRING)) AS finding_key, concat('copy', CAST(l_suppkey AS STRING)) AS copy,
  l_linestatus = 'O' AS is_current, max(CASE l_returnflag WHEN 'A' THEN 'confirm' WHEN 'N' THEN 'dismiss' ELSE 'look' END) AS verdict,
  max(CASE WHEN l_quantity > 25 THEN concat('n', CAST(l_partkey AS STRING)) END) AS note, 'lab' AS label FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_suppkey, l_linestatus"""

MERGED = f"""t AS ({other_sql(TRIAGE)}), r AS (SELECT *, CASE verdict WHEN 'confirm' THEN 2 WHEN 'dismiss' THEN 1 ELSE 0 END AS rank FROM t),
 m AS (SELECT entry_id, finding_key, bool_or(is_current) AS said, max(rank) FILTER (WHERE is_current) AS own, max(rank) AS top,
    first(note ORDER BY is_current DESC, copy) FILTER (WHERE note IS NOT NULL) AS note, min(label) AS label FROM r GROUP BY entry_id, finding_key),
 merged AS (SELECT entry_id, finding_key, CASE CASE WHEN said THEN own ELSE top END WHEN 2 THEN 'confirm' WHEN 1 THEN 'dismiss' END AS verdict, note, label FROM m)"""


@query("triage_merge", f"WITH {MERGED} SELECT * FROM merged")
def _(spark, sf):
    return A.merge_triage(spark_sql(spark, sf, TRIAGE))


@query("triage_apply", f"""WITH {MERGED}, f AS (SELECT l_orderkey AS entry_id, 'chk' || l_linenumber AS finding_key, 'm' || l_returnflag AS msg FROM lineitem)
SELECT f.entry_id, f.finding_key, CASE WHEN n.note IS NOT NULL THEN f.msg || '  · reviewer: ' || n.note ELSE f.msg END AS msg
FROM f LEFT JOIN merged n ON n.entry_id = f.entry_id AND n.finding_key = f.finding_key AND n.verdict = 'confirm' AND n.note <> ''
WHERE NOT EXISTS (SELECT 1 FROM merged d WHERE d.entry_id = f.entry_id AND d.finding_key = f.finding_key AND d.verdict = 'dismiss')""")
def _(spark, sf):
    findings = spark_sql(spark, sf, "SELECT l_orderkey AS entry_id, concat('chk', CAST(l_linenumber AS STRING)) AS finding_key, concat('m', l_returnflag) AS msg FROM {lineitem}")
    return A.apply_triage(findings, A.merge_triage(spark_sql(spark, sf, TRIAGE))).select("entry_id", "finding_key", "msg")


@query("incremental_refresh", other_sql("""
SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END AS fp,
  CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 THEN 'fresh' ELSE 'cached' END AS result FROM {orders}"""))
def _(spark, sf):
    entries = spark_sql(spark, sf, "SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END AS fp FROM {orders}")
    cache = spark_sql(spark, sf, "SELECT o_orderkey AS entry_id, o_custkey AS fp, 'cached' AS result, false AS unreadable FROM {orders} WHERE o_orderkey % 5 <> 0")
    fresh = A.incremental_refresh(entries, cache, lambda e: e.withColumn("result", F.lit("fresh")).withColumn("unreadable", F.lit(False)))
    return fresh.select("entry_id", "fp", "result")


@query("union_libraries", other_sql("""
SELECT c_custkey AS sample_id, 'fetched' AS origin FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'copy' FROM {customer} WHERE c_custkey % 3 <> 0"""))
def _(spark, sf):
    first = spark_sql(spark, sf, "SELECT c_custkey AS sample_id, 'fetched' AS origin FROM {customer} WHERE c_custkey % 3 = 0")
    second = spark_sql(spark, sf, "SELECT c_custkey AS sample_id, 'copy' AS origin FROM {customer}")
    return A.union_by_precedence(first, second, ("sample_id",))


@query("severity_gate", with_views("d_findings", f"""
, e AS ({other_sql(ENTRIES)}), p AS (SELECT entry_id, count(*) FILTER (WHERE sev = 'flag') AS w FROM d_findings GROUP BY entry_id)
SELECT e.entry_id, coalesce(w, 0) AS n_writable, coalesce(e.cell = 'match' AND coalesce(e.lam <> 'flag', true) AND coalesce(w, 0) = 0, CASE WHEN coalesce(e.lam <> 'flag', true) AND coalesce(w, 0) = 0 THEN NULL ELSE false END) AS clean
FROM e LEFT JOIN p ON p.entry_id = e.entry_id"""))
def _(spark, sf):
    findings = view(spark, sf, "d_findings").withColumn("anchor", F.lit("refl"))
    return A.severity_gate(findings, spark_sql(spark, sf, ENTRIES))


# --- precision and recall --------------------------------------------------------------------


@query("oracle_score", with_views("d_printed", """
, b AS (SELECT p.entry_id AS doc_id, p.entry_id AS content, 'chk' || p.item AS code, CASE WHEN l.l_discount > 0.02 THEN 'flag' ELSE 'note' END AS sev,
    'a should be ''' || p.right_txt || '''' AS msg, p.right_txt AS hint, l.l_tax > 0.04 AS keeps FROM d_printed p JOIN (SELECT DISTINCT l_orderkey, l_linenumber,
    first(l_discount ORDER BY l_suppkey, l_partkey, l_extendedprice) OVER w AS l_discount, first(l_tax ORDER BY l_suppkey, l_partkey, l_extendedprice) OVER w AS l_tax FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber)) l
    ON p.entry_id = l.l_orderkey AND p.item = l.l_linenumber),
 after AS (SELECT DISTINCT doc_id, code, msg FROM b WHERE keeps),
 ch AS (SELECT entry_id AS doc_id, lower(left_txt) AS was, lower(CASE WHEN item % 2 = 0 THEN right_txt ELSE left_txt || 'x' END) AS became FROM d_printed WHERE item <> 7),
 j AS (SELECT b.code, NOT EXISTS (SELECT 1 FROM after a WHERE a.doc_id = b.doc_id AND a.code = b.code AND a.msg = b.msg) AS gone,
    EXISTS (SELECT 1 FROM ch WHERE ch.doc_id = b.doc_id AND contains(ch.became, b.hint) AND NOT contains(ch.was, b.hint)) AS ok FROM b WHERE sev = 'flag')
SELECT code, count(*) AS flags, count(*) FILTER (WHERE gone) AS resolved, count(*) FILTER (WHERE NOT gone) AS persists, count(*) AS hinted,
  count(*) FILTER (WHERE ok) AS confirmed, count(*) FILTER (WHERE NOT ok AND gone) AS other, count(*) FILTER (WHERE NOT ok AND NOT gone) AS left_alone FROM j GROUP BY code"""))
def _(spark, sf):
    printed = view(spark, sf, "d_printed")
    facts = spark_sql(spark, sf, """
        SELECT l_orderkey AS entry_id, l_linenumber AS item, min_by(l_discount, struct(l_suppkey, l_partkey, l_extendedprice)) AS disc,
          min_by(l_tax, struct(l_suppkey, l_partkey, l_extendedprice)) AS tax FROM {lineitem} GROUP BY l_orderkey, l_linenumber""")
    before = printed.join(facts, ["entry_id", "item"]).select(
        F.col("entry_id").alias("doc_id"), F.col("entry_id").alias("content"), F.expr("concat('chk', item)").alias("code"),
        F.expr("CASE WHEN disc > 0.02 THEN 'flag' ELSE 'note' END").alias("sev"), F.expr("concat('a should be \\'', right_txt, '\\'')").alias("msg"), "tax")
    before = cut_lineage(before)
    changes = printed.select(F.col("entry_id").alias("doc_id"), F.expr("CASE WHEN item = 7 THEN 'Accept' ELSE 'cell' END").alias("label"),
        F.col("left_txt").alias("before"), F.expr("CASE WHEN item % 2 = 0 THEN right_txt ELSE concat(left_txt, 'x') END").alias("after"))
    return A.oracle_score(before.drop("tax"), before.where("tax > 0.04"), changes)


RUNS = """
SELECT CASE event_type WHEN 'click' THEN 'd-swap' WHEN 'view' THEN 'drop' WHEN 'error' THEN 'I-slip' ELSE 'dx-blank' END AS kind,
  CASE WHEN value < 3 THEN 'CAUGHT' WHEN value < 6 THEN 'VAGUE' WHEN value < 10 THEN 'NOTED' WHEN value < 40 THEN 'MISSED' ELSE 'ERROR' END AS outcome,
  CASE WHEN user_id % 10 = 0 THEN 0.5 ELSE 0.95 END AS printed, concat('code', CAST(user_id % 9 AS STRING)) AS code FROM {events}"""


@query("recall_table", f"""WITH r AS ({other_sql(RUNS)}) SELECT CASE WHEN printed >= 0.9 THEN 'printed' ELSE 'not printed' END AS stratum, kind, count(*) AS n,
""" + ", ".join(f"round(count(*) FILTER (WHERE outcome = '{o}') * 100.0 / count(*), 4) AS {o.lower()}_pct" for o in A.OUTCOMES) + " FROM r GROUP BY 1, 2")
def _(spark, sf):
    runs = spark_sql(spark, sf, RUNS).withColumn("stratum", A.printed_stratum(F.col("printed")))
    return A.recall_table(runs, ("stratum", "kind"))


@query("recall_top_codes", f"""WITH r AS ({other_sql(RUNS)}), c AS (SELECT kind, code, count(*) AS n FROM r GROUP BY kind, code)
SELECT kind, code, n, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, code) AS INT) AS place FROM c QUALIFY place <= 6""")
def _(spark, sf):
    return A.top_codes(spark_sql(spark, sf, RUNS))


LADDER = """
SELECT event_type AS kind, CAST(user_id % 4 AS BIGINT) AS size, CASE WHEN value < 5 THEN 'caught' WHEN value < 15 THEN 'noted' ELSE 'missed' END AS outcome FROM {events}"""


@query("detection_curve", f"""WITH r AS ({other_sql(LADDER)}) SELECT kind, size, count(*) FILTER (WHERE outcome = 'caught') AS caught,
  count(*) FILTER (WHERE outcome = 'noted') AS noted, count(*) FILTER (WHERE outcome = 'missed') AS missed, count(*) AS n,
  round(count(*) FILTER (WHERE outcome = 'caught') * 100.0 / count(*), 4) AS caught_pct FROM r GROUP BY ROLLUP(kind, size)""")
def _(spark, sf):
    return A.detection_curve(spark_sql(spark, sf, LADDER))


SEEDABLE = """
SELECT l_orderkey AS entry_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS BIGINT) AS line_no,
  CAST(CAST(l_extendedprice / 10000 AS DECIMAL(8,3)) AS STRING) AS d_txt, l_quantity * 2 AS i FROM {lineitem}"""
# Spark rounds the decimal a double prints as, the other engine the double times a thousand: the digits are those of the latter
SEED_LINES = SEEDABLE.replace("CAST(l_extendedprice / 10000 AS DECIMAL(8,3))", "CAST(round(l_extendedprice / 10000 * 1000) / 1000 AS DECIMAL(8,3))")
SEED_TOP = f"s AS ({other_sql(SEEDABLE)}), t AS (SELECT entry_id, first(d_txt ORDER BY i DESC, line_no) AS hit_d, first(line_no ORDER BY i DESC, line_no) AS hit_no, max(i) AS hit_i FROM s GROUP BY entry_id), j AS (SELECT * FROM s JOIN t USING (entry_id))"


@query("seed_drop", f"WITH {SEED_TOP} SELECT entry_id, line_no, d_txt, i FROM j WHERE d_txt <> hit_d")
def _(spark, sf):
    return A.seed_reflections(spark_sql(spark, sf, SEED_LINES), "drop").select("entry_id", "line_no", "d_txt", "i")


@query("seed_intensity_slip", f"WITH {SEED_TOP} SELECT entry_id, line_no, d_txt, CASE WHEN d_txt = hit_d AND hit_i >= 90 THEN 10.0 ELSE i END AS i FROM j")
def _(spark, sf):
    return A.seed_reflections(spark_sql(spark, sf, SEED_LINES), "slip").select("entry_id", "line_no", "d_txt", "i")


@query("seed_digit_swap", f"""WITH {SEED_TOP} SELECT entry_id, line_no, i, CASE WHEN line_no <> hit_no THEN d_txt
  WHEN d_txt[-1] <> d_txt[-2] THEN d_txt[:-3] || d_txt[-1] || d_txt[-2]
  WHEN d_txt[-2] <> d_txt[-3] THEN d_txt[:-4] || d_txt[-2] || d_txt[-3] || d_txt[-1] ELSE d_txt END AS d_txt FROM j""")
def _(spark, sf):
    return A.seed_reflections(spark_sql(spark, sf, SEED_LINES), "swap").select("entry_id", "line_no", "d_txt", "i")


@query("seed_weight", with_views("d_probe_points", """
, m AS (SELECT sample_id, constituent, round(avg(wt), 4) AS wt FROM d_probe_points GROUP BY ALL)
SELECT sample_id, constituent, CASE WHEN row_number() OVER (PARTITION BY sample_id ORDER BY wt DESC, constituent DESC) = 1 THEN round(wt * 1.1, 4) ELSE wt END AS wt FROM m"""))
def _(spark, sf):
    means = view(spark, sf, "d_probe_points").groupBy("sample_id", "constituent").agg(F.round(F.avg("wt"), 4).alias("wt"))
    return A.seed_weight(means, 0.1).select("sample_id", "constituent", "wt")


@query("seed_basis", other_sql("SELECT o_orderkey AS sample_id, CAST(o_custkey % 24 - 1 AS BIGINT) AS n FROM {orders} WHERE o_custkey % 24 - 1 > 0"))
def _(spark, sf):
    return A.seed_basis(spark_sql(spark, sf, "SELECT o_orderkey AS sample_id, CAST(o_custkey % 24 AS BIGINT) AS n FROM {orders}"), "-1")


DETAILS = """
SELECT user_id AS doc_id, event_type AS field, CASE WHEN value < 10 THEN 'agrees' ELSE 'disagrees' END AS status,
  concat('Fe', CAST(user_id % 7 AS STRING), ' column ', CAST(value AS STRING), ' against ', props, repeat(' and more', 12)) AS detail FROM {events}"""


@query("failure_classes", f"""WITH r AS ({other_sql(DETAILS)}), c AS (SELECT *, regexp_replace(regexp_replace(detail, '\\d+(\\.\\d+)?', 'N', 'g'),
  '\\b[A-Z][a-z]?\\d*(?:/[A-Z][a-z]?\\d*)*\\b', 'X', 'g') AS detail_class FROM r)
SELECT field, status, detail_class, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS example FROM c GROUP BY field, status, detail_class""")
def _(spark, sf):
    return A.failure_classes(spark_sql(spark, sf, DETAILS))


SHEETS = """
SELECT CASE l_linenumber % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'wt' WHEN 2 THEN 'basis' WHEN 3 THEN 'valence' ELSE 'two' END AS kind, 'Fe' AS target,
  CASE l_suppkey % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'many' ELSE 'none' END AS standing, CASE WHEN l_partkey % 2 = 0 THEN 'Fe' ELSE 'Mg' END AS named,
  CASE l_partkey % 5 WHEN 0 THEN 'basis' WHEN 1 THEN 'shift' WHEN 2 THEN 'ok' WHEN 3 THEN 'scatter' ELSE 'few' END AS factor,
  CASE l_orderkey % 6 WHEN 0 THEN 'Fe' WHEN 1 THEN 'Mg' END AS valence_named, l_quantity AS basis_needed, CAST(24 AS DOUBLE) AS basis_true,
  l_returnflag = 'A' AS whole, CASE WHEN l_discount < 0.03 THEN '' WHEN l_discount < 0.06 THEN 'Fe' ELSE 'Mg' END AS red_txt FROM {lineitem}"""


@query("diagnosis_confusion", f"""WITH s AS ({other_sql(SHEETS)}), d AS (SELECT kind, CASE kind
 WHEN 'none' THEN CASE WHEN red_txt = '' AND factor IN ('ok','few','shift') AND standing = 'none' THEN 'RIGHT' ELSE 'FALSE-ALARM' END
 WHEN 'wt' THEN CASE WHEN standing = 'one' AND named = target THEN 'RIGHT' WHEN standing = 'one' THEN 'WRONG-NAME' WHEN factor = 'basis' OR valence_named IS NOT NULL THEN 'WRONG-KIND'
   WHEN red_txt = target THEN 'PARTIAL' WHEN red_txt = '' THEN 'MISSED' ELSE 'WRONG-NAME' END
 WHEN 'basis' THEN CASE WHEN factor = 'basis' AND abs(basis_needed - 24) <= 0.48 AND (whole OR valence_named IS NULL) THEN 'RIGHT' WHEN factor = 'basis' THEN 'PARTIAL'
   WHEN factor = 'shift' AND abs(basis_needed - 24) <= 0.48 THEN 'PARTIAL' WHEN factor = 'shift' THEN 'MISSED' WHEN standing = 'one' OR valence_named IS NOT NULL THEN 'WRONG-KIND' WHEN red_txt <> '' THEN 'PARTIAL' ELSE 'MISSED' END
 WHEN 'valence' THEN CASE WHEN valence_named = target AND NOT whole THEN 'RIGHT' WHEN valence_named IS NOT NULL THEN 'PARTIAL' WHEN standing = 'one' THEN 'WRONG-KIND' WHEN factor IN ('basis','shift') THEN 'PARTIAL'
   WHEN red_txt = '' THEN 'MISSED' ELSE 'WRONG-KIND' END
 ELSE CASE WHEN standing = 'one' THEN 'WRONG-NAME' WHEN standing = 'many' OR factor = 'scatter' THEN 'RIGHT' WHEN factor = 'basis' OR valence_named IS NOT NULL THEN 'WRONG-KIND' WHEN red_txt <> '' THEN 'PARTIAL' ELSE 'MISSED' END END AS g FROM s)
SELECT kind, """ + ", ".join(f"count(*) FILTER (WHERE g = '{o}') AS \"{o}\"" for o in A.DIAGNOSES) + " FROM d GROUP BY kind")
def _(spark, sf):
    reports = spark_sql(spark, sf, SHEETS).withColumn("red", F.expr("filter(array(red_txt), x -> x <> '')"))
    return A.diagnosis_confusion(reports)


CONTRADICTION_RULES = """SELECT * FROM (VALUES ('epma','silent','flags','record flags, report silent'), ('epma','red','agrees','record agrees, report red'),
  ('gd','red','agrees','record agrees, report red'), ('gd','ok','flags','record red, report ok')) AS t(topic, report_state, record_state, kind)"""
SHEET_STATES = """
SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN 'epma' ELSE 'gd' END AS topic, min(CASE l_returnflag WHEN 'A' THEN 'red' WHEN 'N' THEN 'silent' ELSE 'ok' END) AS report_state,
  max(CASE WHEN l_quantity > 25 THEN 'flags' ELSE 'agrees' END) AS record_state FROM {lineitem} GROUP BY l_orderkey, l_linenumber % 2"""


@query("contradictions", f"""WITH s AS ({other_sql(SHEET_STATES)}), r AS ({CONTRADICTION_RULES})
SELECT r.kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM s JOIN r ON s.topic = r.topic AND s.report_state = r.report_state AND s.record_state = r.record_state GROUP BY r.kind""")
def _(spark, sf):
    s = spark_sql(spark, sf, SHEET_STATES)
    return A.contradictions(s.drop("record_state"), s.drop("report_state"), spark.sql(CONTRADICTION_RULES))


SUMS = """
SELECT l_suppkey AS structure_id, l_quantity / 20 AS printed, (l_quantity + l_linenumber - 3) / 20 AS s_anion, (l_quantity + l_linenumber) / 20 AS s_all,
  (l_quantity + l_linenumber - 6) / 20 AS s_net FROM {lineitem}"""


@query("agreement_rate", f"""WITH s AS ({other_sql(SUMS)}), o AS (SELECT structure_id, least(abs(s_anion - printed), abs(s_all - printed), abs(s_net - printed)) AS off,
  CASE WHEN abs(s_anion - printed) <= abs(s_all - printed) AND abs(s_anion - printed) <= abs(s_net - printed) THEN 's_anion' WHEN abs(s_all - printed) <= abs(s_net - printed) THEN 's_all' ELSE 's_net' END AS c FROM s),
 v AS (SELECT structure_id, c, count(*) AS k, count(*) FILTER (WHERE off > 0.06) AS bad FROM o GROUP BY structure_id, c)
SELECT structure_id, CAST(sum(k) AS BIGINT) AS compared, CAST(sum(bad) AS BIGINT) AS disagree, first(c ORDER BY k DESC, c DESC) AS convention FROM v GROUP BY structure_id""")
def _(spark, sf):
    return A.agreement_rate(spark_sql(spark, sf, SUMS), 0.06)


ALERTS = """
SELECT l_suppkey AS report_id, CASE l_partkey % 9 WHEN 0 THEN 'PLAT965' WHEN 1 THEN 'PLAT083' WHEN 2 THEN 'PUBL001' WHEN 3 THEN 'PLAT975' WHEN 4 THEN 'PLAT933' WHEN 5 THEN 'PLAT794' ELSE 'PLAT029' END AS code,
  CASE l_linenumber % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'G' END AS level,
  concat('Check Calcd Resid. Dens.  ', CAST(CAST(l_quantity / 30 AS DECIMAL(4,2)) AS STRING), 'Ang From ', CASE WHEN l_discount < 0.05 THEN 'Ow4' ELSE 'Fe1' END) AS desc FROM {lineitem}"""


@query("alert_triage", f"""WITH a AS ({other_sql(ALERTS.replace(' AS desc ', ' AS "desc" '))}), s AS (SELECT *, CASE code WHEN 'PLAT965' THEN 0 WHEN 'PLAT083' THEN 1 WHEN 'PLAT933' THEN 2 WHEN 'PLAT794' THEN 3 END AS rank FROM a)
SELECT report_id, count(*) FILTER (WHERE level = 'A') AS level_a, count(*) FILTER (WHERE level = 'B') AS level_b, count(*) FILTER (WHERE level = 'C') AS level_c, count(*) FILTER (WHERE level = 'G') AS level_g,
  count(rank) AS elevated, count(*) FILTER (WHERE code = 'PUBL001') AS demoted,
  count(*) FILTER (WHERE code = 'PLAT975' AND CAST(regexp_extract("desc", '(\\d+\\.\\d+)Ang', 1) AS DOUBLE) BETWEEN 0.6 AND 1.05 AND "desc" LIKE '%From Ow4') AS h_peaks,
  CASE min(rank) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'FLAG' WHEN 2 THEN 'SURFACE' WHEN 3 THEN 'BVS' END AS worst FROM s GROUP BY report_id""")
def _(spark, sf):
    return A.alert_triage(spark_sql(spark, sf, ALERTS))
