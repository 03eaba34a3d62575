"""Named queries over the readers' parsing halves, fed with text that Spark makes from the tables."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from recordaudit.functions.elements import element_set
from recordaudit.functions.measured import format_with_esd
from recordaudit.operators import names as D, textjobs as T
from recordaudit.plans.registry import query
from recordaudit.plans.views import load, other_sql, spark_sql, spread, view, with_views
from recordaudit.rules import engine as E
from recordaudit.session import shared_path
from recordaudit.sources import readers as R

REPORTS = """
SELECT o_orderkey AS report_id, concat('Header line\nPLAT', lpad(CAST(o_custkey % 900 AS STRING), 3, '0'), '_ALERT_', CAST(1 + o_custkey % 4 AS STRING), '_', CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'G' END, ' Large value of ', CAST(10 + o_custkey % 80 AS STRING), ' found\n',
  'PLAT029_ALERT_3_B  Low fraction ....... 0.', CAST(10 + o_orderkey % 80 AS STRING), ' Why?\nPLAT029_ALERT_3_B  Low fraction ....... 0.', CAST(10 + o_orderkey % 80 AS STRING), ' Why?') AS text FROM {orders}"""


@query("parse_alerts", other_sql("""
SELECT o_orderkey AS report_id, 'PLAT' || lpad(CAST(o_custkey % 900 AS STRING), 3, '0') AS code, CAST(1 + o_custkey % 4 AS INT) AS type, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'G' END AS level, CAST(10 + o_custkey % 80 AS STRING) AS val FROM {orders}
UNION ALL SELECT o_orderkey, 'PLAT029', 3, 'B', '0.' || CAST(10 + o_orderkey % 80 AS STRING) FROM {orders}"""))
def _(spark, sf):
    return R.parse_alerts(spread(spark_sql(spark, sf, REPORTS))).select("report_id", "code", "type", "level", "val")


FILES = """
SELECT concat('/a/I', lpad(CAST(s_suppkey AS STRING), 5, '0'), '_name.docx') AS path, s_suppkey % 2 AS human_marks FROM {supplier}
UNION ALL SELECT concat('/b/I', lpad(CAST(s_suppkey AS STRING), 5, '0'), '_name_edited.docx'), CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE s_suppkey % 2 END FROM {supplier}
UNION ALL SELECT concat('/c/I', lpad(CAST(s_suppkey AS STRING), 5, '0'), '-I', lpad(CAST(s_suppkey + 2 AS STRING), 5, '0'), ' paper.pdf'), 0 FROM {supplier} WHERE s_suppkey % 5 = 0
UNION ALL SELECT concat('/c/I', lpad(CAST(s_suppkey AS STRING), 5, '0'), '_supp.pdf'), 0 FROM {supplier} UNION ALL SELECT concat('/d/i', lpad(CAST(s_suppkey AS STRING), 5, '0'), '.cif'), 0 FROM {supplier} WHERE s_suppkey % 4 = 0"""


@query("pair_sources", other_sql("""WITH n AS (SELECT s_suppkey AS k FROM {supplier}), p AS (SELECT k, unnest([k, k + 1, k + 2]) AS id FROM n WHERE k % 5 = 0), i AS (SELECT k AS id FROM n UNION SELECT id FROM p)
SELECT 'I' || lpad(CAST(i.id AS STRING), 5, '0') AS entry_id, CASE WHEN n.k IS NULL THEN NULL WHEN i.id % 3 = 0 THEN '/b/I' || lpad(CAST(i.id AS STRING), 5, '0') || '_name_edited.docx' ELSE '/a/I' || lpad(CAST(i.id AS STRING), 5, '0') || '_name.docx' END AS record,
  (SELECT min('/c/I' || lpad(CAST(p.k AS STRING), 5, '0') || '-I' || lpad(CAST(p.k + 2 AS STRING), 5, '0') || ' paper.pdf') FROM p WHERE p.id = i.id) AS article, CASE WHEN n.k % 4 = 0 THEN '/d/i' || lpad(CAST(i.id AS STRING), 5, '0') || '.cif' END AS structure FROM i LEFT JOIN n ON n.k = i.id"""))
def _(spark, sf):
    return R.pair_sources(spark_sql(spark, sf, FILES))


PEAK_LINES = """
SELECT concat('f', CAST(l_orderkey AS STRING)) AS file, 0 AS line_no, 'd(A)   I%   ( h k l)' AS value FROM {lineitem} GROUP BY l_orderkey
UNION ALL SELECT concat('f', CAST(l_orderkey AS STRING)), l_linenumber, concat(CAST(l_partkey % 90 + 10 AS STRING), '.25   ', CAST(CAST(l_quantity AS INT) AS STRING), '   ', CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE concat('(-', CAST(l_suppkey % 9 AS STRING), ' ', CAST(l_partkey % 9 AS STRING), ' 2)') END) FROM {lineitem}"""


@query("parse_peak_list", other_sql("""SELECT 'f' || l_orderkey AS file, CAST(l_linenumber AS INT) AS line_no, l_partkey % 90 + 10.25 AS d, l_quantity AS i, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(-(l_suppkey % 9) AS STRING) || ',' || (l_partkey % 9) || ',2' END AS hkl FROM {lineitem}""").replace("l_partkey % 90 + 10.25 AS d", "CAST(l_partkey % 90 + 10.25 AS DOUBLE) AS d"))
def _(spark, sf):
    p = R.parse_peak_list(spread(spark_sql(spark, sf, PEAK_LINES)))
    return p.select("file", "line_no", "d", "i", F.when(F.col("hkl").isNotNull(), F.concat_ws(",", F.transform("hkl", lambda v: v.cast("string")))).alias("hkl"))


MEMBERS = """
SELECT concat('m', CAST(vec_id AS STRING)) AS file, concat('##NAMES=Some_Mineral\n##RRUFFID=R', lpad(CAST(vec_id AS STRING), 6, '0'), '\n##IDEAL CHEMISTRY=Fe^3+^_2_O_3_\n##FILETYPE=Processed\n##RAMAN WAVELENGTH=532.0 nm\n',
  array_join(transform(reverse(embedding), (v, i) -> concat(CAST(500 - i AS STRING), ', ', CAST(v AS STRING))), '\n'), '\n10, nan\n') AS text FROM {embeddings}"""


@query("parse_spectra", other_sql("""SELECT 'm' || vec_id AS file, 'Some Mineral' AS name, 'R' || lpad(CAST(vec_id AS STRING), 6, '0') AS sample_id, 'processed' AS kind, '532' AS laser, 'Fe3+2O3' AS chemistry, CAST(len(embedding) AS BIGINT) AS n, CAST(501 - len(embedding) AS DOUBLE) AS x0, round(CAST(embedding[1] AS DOUBLE), 5) AS y0 FROM {embeddings}"""))
def _(spark, sf):
    meta, spectra = R.parse_xy(spark_sql(spark, sf, MEMBERS))
    s = spectra.select("file", F.size("x").cast("bigint").alias("n"), F.get("x", F.lit(0)).alias("x0"), F.round(F.get("y", F.lit(0)), 5).alias("y0"))
    return meta.join(s, "file")


FORMULA_PAIRS = "SELECT l_orderkey * 8 + l_linenumber AS entry_id, l_suppkey AS s, concat(CASE l_suppkey % 3 WHEN 0 THEN 'Ca' WHEN 1 THEN 'Mg' ELSE 'Fe' END, 'SiO3') AS a, concat(CASE l_partkey % 3 WHEN 0 THEN 'Ca' WHEN 1 THEN 'Mg' ELSE 'Fe' END, 'GeO3') AS b FROM {lineitem}"


@query("element_set_difference", other_sql("""WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS entry_id, l_suppkey AS s, CASE l_suppkey % 3 WHEN 0 THEN 'Ca' WHEN 1 THEN 'Mg' ELSE 'Fe' END AS x, CASE l_partkey % 3 WHEN 0 THEN 'Ca' WHEN 1 THEN 'Mg' ELSE 'Fe' END AS y FROM {lineitem})
SELECT entry_id, s, CASE WHEN x = y THEN 'Si' ELSE x || ',Si' END AS only_left, CASE WHEN x = y THEN 'Ge' ELSE CASE WHEN y < 'Ge' THEN y || ',Ge' ELSE 'Ge,' || y END END AS only_right FROM p""").replace("CASE WHEN y < 'Ge' THEN y || ',Ge' ELSE 'Ge,' || y END", "CASE WHEN y < 'Ge' THEN y || ',Ge' ELSE 'Ge,' || y END"))
def _(spark, sf):
    p = spark_sql(spark, sf, FORMULA_PAIRS)
    a, b = element_set(F.col("a")), element_set(F.col("b"))
    return p.select("entry_id", "s", F.concat_ws(",", F.array_sort(F.array_except(a, b))).alias("only_left"), F.concat_ws(",", F.array_sort(F.array_except(b, a))).alias("only_right"))


@query("near_copies", other_sql("""WITH t AS (SELECT conv_id, turn, text, text || CASE WHEN turn % 2 = 0 THEN '' ELSE ' 1234' END AS other FROM {conversations})
SELECT conv_id, turn, turn % 2 = 0 AND len(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) > 0 AS copy FROM t"""))
def _(spark, sf):
    t = load(spark, sf, "conversations").withColumn("other", F.expr("concat(text, CASE WHEN turn % 2 = 0 THEN '' ELSE ' 1234' END)"))
    return t.select("conv_id", "turn", T.near_copies(t, "text", "other").alias("copy"))


@query("name_echo", other_sql("""SELECT p_partkey, length(lower(p_name)) >= 4 AND contains('great' || lower(p_name), lower(p_name)[-5:]) AS echo, contains(lower(p_name) || 'xx', 'quartz') AS other FROM {part}"""))
def _(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", D.name_echo(F.col("p_name"), F.concat(F.lit("great"), F.col("p_name"))).alias("echo"), D.name_echo(F.concat("p_name", F.lit("xx")), F.lit("a quartz")).alias("other"))


UNCERTAIN = "SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS s, CAST(floor(l_extendedprice) AS DOUBLE) / 10000 AS v, CAST(1 + l_partkey % 97 AS DOUBLE) / 1000 AS e FROM {lineitem}"


@query("format_with_esd", f"""WITH u AS (SELECT *, CAST(round(e * 1000) AS INT) AS m FROM ({other_sql(UNCERTAIN)})), p AS (SELECT *, CASE WHEN m = 1 THEN 4 WHEN m < 10 THEN 3 WHEN m < 20 THEN 3 ELSE 2 END AS dp FROM u)
SELECT id, s, CASE dp WHEN 4 THEN format('{{:.4f}}', CAST(round(CAST(v AS DECIMAL(18,6)), 4) AS DOUBLE)) WHEN 3 THEN format('{{:.3f}}', CAST(round(CAST(v AS DECIMAL(18,6)), 3) AS DOUBLE)) ELSE format('{{:.2f}}', CAST(round(CAST(v AS DECIMAL(18,6)), 2) AS DOUBLE)) END
  || '(' || CASE dp WHEN 4 THEN m * 10 WHEN 3 THEN m ELSE CAST(floor(m / 10.0 + 0.5) AS INT) END || ')' AS text FROM p""")
def _(spark, sf):
    return spark_sql(spark, sf, UNCERTAIN).select("id", "s", format_with_esd(F.col("v"), F.col("e")).alias("text"))


# --- round trips through files that Spark writes to the shared folder ---------------------------------

PROBE_TABLE = """SELECT l_orderkey AS sample, l_linenumber * 100000 + l_suppkey AS point, l_quantity AS SiO2, CASE WHEN l_tax > 0.02 THEN CAST(l_tax AS STRING) ELSE 'n.d.' END AS cao, l_discount AS total, 'a note' AS comment,
  l_tax AS feot, l_tax + 1 AS co2calc, l_quantity AS core, l_quantity AS adsorbed, l_discount AS error FROM {lineitem}"""


@query("probe_table", other_sql("""WITH t AS (SELECT l_orderkey AS s, l_linenumber * 100000 + l_suppkey AS p, l_quantity AS q, CASE WHEN l_tax > 0.02 THEN l_tax END AS x, l_tax AS f FROM {lineitem})
SELECT CAST(s AS VARCHAR) AS sample_id, 'SiO2' AS constituent, count(*) AS n, count(q) AS measured, round(CAST(sum(q) AS DOUBLE), 4) AS wt FROM t GROUP BY 1 UNION ALL SELECT CAST(s AS VARCHAR), 'CaO', count(*), count(x), round(CAST(sum(x) AS DOUBLE), 4) FROM t GROUP BY 1
UNION ALL SELECT CAST(s AS VARCHAR), 'FeO', count(*), count(f), round(CAST(sum(f) AS DOUBLE), 4) FROM t GROUP BY 1 UNION ALL SELECT CAST(s AS VARCHAR), 'CO2', count(*), count(f), round(CAST(sum(f + 1) AS DOUBLE), 4) FROM t GROUP BY 1"""))
def _(spark, sf):
    path = shared_path(spark, "probe")
    spark_sql(spark, sf, PROBE_TABLE).withColumnsRenamed({"cao": "CaO (2) Oxide%", "total": "Total", "comment": "Comment", "feot": "FeOt", "co2calc": "CO2calc", "core": "CORE", "adsorbed": "H2O-", "error": "SiO2 error"}).write.option("header", True).csv(path)
    return R.read_probe_long(spark, path).groupBy("sample_id", "constituent").agg(F.count(F.lit(1)).alias("n"), F.count("wt").alias("measured"), F.round(F.sum("wt"), 4).alias("wt"))


@query("snapshot_round_trip", with_views("d_findings", "SELECT run_id, code, sev, count(*) AS n, count(DISTINCT entry_id) AS entries FROM d_findings WHERE run_id = 2 GROUP BY ALL"))
def _(spark, sf):
    findings, path = view(spark, sf, "d_findings"), shared_path(spark, "snapshots")
    for run in (1, 2):
        own = findings.where(F.col("run_id") == run)
        R.write_snapshot(own.select("entry_id").distinct(), own, path, run)
    back = R.read_snapshot(spark, path, 2)[1]
    return back.groupBy(F.col("run_id").cast("int").alias("run_id"), "code", "sev").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entry_id").alias("entries"))


@query("findings_round_trip", with_views("d_findings", "SELECT code, sev, count(*) AS n FROM d_findings GROUP BY ALL"))
def _(spark, sf):
    path = shared_path(spark, "findings")
    R.write_findings(view(spark, sf, "d_findings"), path, "json")
    return spark.read.json(path).groupBy("code", "sev").agg(F.count(F.lit(1)).alias("n"))


@query("dimension_json", "SELECT n_name AS name, n_nationkey AS k, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS r FROM nation")
def _(spark, sf):
    # one object of the 25 nations, as a file of a dimension holds it
    region = F.when(F.col("n_regionkey") > 1, F.col("n_regionkey"))
    member = F.concat(F.lit('"'), "n_name", F.lit('": '), F.to_json(F.struct(F.col("n_nationkey").alias("k"), region.alias("r"))))
    text = load(spark, sf, "nation").agg(F.concat(F.lit('{"_about": "note", '), F.array_join(F.collect_list(member), ", "), F.lit("}")).alias("value"))
    path = shared_path(spark, "dimension")
    text.write.text(path)
    return R.read_dimension_json(spark, path, "k bigint, r bigint", "name")


def _overdue(orders):
    """A rule of one's own: urgent orders that are still open."""
    return orders.where("urgent AND open").select("entry_id", F.lit("overdue").alias("code"), F.lit("flag").alias("sev"), F.lit("urgent and open").alias("msg"), F.lit("status").alias("anchor"))


@query("registered_rule", "SELECT o_orderkey AS entry_id, 'overdue' AS code, 'flag' AS sev, 'urgent and open' AS msg, 'status' AS anchor FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
def _(spark, sf):
    with contextlib.suppress(ValueError):  # it is registered once in a process
        E.register_rule("overdue", _overdue)
    return E.run_registered(orders=spark_sql(spark, sf, "SELECT o_orderkey AS entry_id, o_orderpriority = '1-URGENT' AS urgent, o_orderstatus = 'O' AS open FROM {orders}"))
