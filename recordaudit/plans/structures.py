"""Named queries over the structure operators: a rutile-type structure per supplier, its cell drawn from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordaudit.functions import cell as K
from recordaudit.operators import structures as X
from recordaudit.plans.registry import query
from recordaudit.plans.views import other_sql, spark_sql
from recordaudit.session import cut_lineage

CELLS = "SELECT s_suppkey AS structure_id, (450 + s_suppkey % 10 * 2) / CAST(100 AS DOUBLE) AS a, (450 + s_suppkey % 10 * 2) / CAST(100 AS DOUBLE) AS b, (295 + s_suppkey % 7) / CAST(100 AS DOUBLE) AS c, CAST(90 AS DOUBLE) AS al, CAST(90 AS DOUBLE) AS be, CAST(90 AS DOUBLE) AS ga, (300 + s_suppkey % 5 * 2) / CAST(1000 AS DOUBLE) AS u FROM {supplier}"
# The sixteen operators of the type's space group.
OPERATORS = [
    ("x,y,z"), ("-x,-y,z"), ("-y+1/2,x+1/2,z+1/2"), ("y+1/2,-x+1/2,z+1/2"), ("-x+1/2,y+1/2,-z+1/2"), ("x+1/2,-y+1/2,-z+1/2"), ("y,x,-z"), ("-y,-x,-z"),
    ("-x,-y,-z"), ("x,y,-z"), ("y+1/2,-x+1/2,-z+1/2"), ("-y+1/2,x+1/2,-z+1/2"), ("x+1/2,-y+1/2,z+1/2"), ("-x+1/2,y+1/2,z+1/2"), ("-y,-x,z"), ("y,x,z"),
]


def _operator(text):
    rot, tr = [], []
    for part in text.split(","):
        body = part.replace("+1/2", "")
        tr.append(0.5 if "+1/2" in part else 0.0)
        rot.append([(-1 if body.startswith("-") else 1) if body.lstrip("-") == v else 0 for v in "xyz"])
    return rot, tr


def operator_rows(spark):
    return spark.createDataFrame([(k + 1, *_operator(t)) for k, t in enumerate(OPERATORS)], "op_no int, rot array<array<int>>, tr array<double>")


def _structures(spark, sf):
    cells = spark_sql(spark, sf, CELLS)
    ti = cells.select("structure_id", F.lit("Ti1").alias("label"), F.lit("Ti").alias("element"), F.lit(4).alias("ox"), F.lit(1.0).alias("occ"), *[F.lit(0.0).alias(v) for v in "xyz"])
    o = cells.select("structure_id", F.lit("O1").alias("label"), F.lit("O").alias("element"), F.lit(-2).alias("ox"), F.lit(1.0).alias("occ"), F.col("u").alias("x"), F.col("u").alias("y"), F.lit(0.0).alias("z"))
    # the operators of every structure: sixteen rows each, by explode of one literal array
    whole = F.array(*[
        F.struct(F.lit(k + 1).alias("op_no"), F.array(*[F.array(*[F.lit(v) for v in row]) for row in rot]).alias("rot"), F.array(*[F.lit(v) for v in tr]).alias("tr"))
        for k, (rot, tr) in enumerate(map(_operator, OPERATORS))
    ])
    symops = cells.select("structure_id", F.explode(whole).alias("o")).select("structure_id", "o.*")
    return cells.drop("u"), ti.unionByName(o), symops


PARAMS = "SELECT * FROM (VALUES ('Ti', 4, 'O', -2, 1.815D, 0.37D, 'a', 1), ('Ti', 4, 'O', -2, 1.8D, 0.4D, 'zz', 2)) AS t(cation, cation_ox, anion, anion_ox, r0, b, ref, line_no)"
FACTORS = """SELECT * FROM (VALUES ('Ti', array(9.7595D, 7.3558D, 1.6991D, 1.9021D), array(7.8508D, 0.5D, 35.6338D, 116.105D), 1.2807D),
  ('O', array(3.0485D, 2.2868D, 1.5463D, 0.867D), array(13.2771D, 5.7011D, 0.3239D, 32.9089D), 0.2508D)) AS t(element, a, b, c)"""
ATOM_SQL = f"""ce AS ({other_sql(CELLS)}), atm AS (SELECT structure_id, 'Ti1' AS label, unnest([0.0, 0.5]) AS x, unnest([0.0, 0.5]) AS y, unnest([0.0, 0.5]) AS z FROM ce
  UNION ALL SELECT structure_id, 'O1', unnest([u, 1 - u, 0.5 - u, 0.5 + u]), unnest([u, 1 - u, 0.5 + u, 0.5 - u]), unnest([0.0, 0.0, 0.5, 0.5]) FROM ce)"""


@query("expand_symmetry", f"WITH {ATOM_SQL} SELECT structure_id, label, round(x, 6) AS x, round(y, 6) AS y, CAST(round(z, 6) AS DOUBLE) AS z, CASE label WHEN 'Ti1' THEN 2 ELSE 4 END::BIGINT AS mult FROM atm")
def _(spark, sf):
    cells, sites, ops = _structures(spark, sf)
    return X.expand_symmetry(sites, ops).select("structure_id", "label", *[F.round(v, 6).alias(v) for v in "xyz"], "mult")


BOND_SQL = f"""ce AS ({other_sql(CELLS)}), bd AS (SELECT structure_id, sqrt(2 * power((0.5 - u) * a, 2) + c * c / 4) AS d4, sqrt(2.0) * u * a AS d2 FROM ce)"""
# distances closer than 0.0015 Å are one bond length, the shorter
MERGED_SQL = BOND_SQL.replace("bd AS", "raw AS") + ", bd AS (SELECT structure_id, CASE WHEN abs(d4 - d2) < 0.0015 THEN least(d2, d4) ELSE d4 END AS d4, CASE WHEN abs(d4 - d2) < 0.0015 THEN least(d2, d4) ELSE d2 END AS d2 FROM raw)"


@query("neighbours", f"""WITH {ATOM_SQL}, p AS (SELECT ce.*, l.label, CASE l.label WHEN 'Ti1' THEN 0 ELSE u END AS px FROM ce, (VALUES ('Ti1'), ('O1')) l(label)), t AS (SELECT unnest([-2, -1, 0, 1, 2]) AS s),
 q AS (SELECT p.structure_id, p.label, atm.label AS other, sqrt(power((atm.x + i.s - px) * a, 2) + power((atm.y + j.s - px) * b, 2) + power((atm.z + k.s) * c, 2)) AS d FROM p JOIN atm ON atm.structure_id = p.structure_id, t i, t j, t k),
 o AS (SELECT *, row_number() OVER (PARTITION BY structure_id, label, other ORDER BY d) AS rn FROM q WHERE d > 0.3 AND d <= 3.2),
 f AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY structure_id, label, other ORDER BY rn) < 0.0015 THEN 0 ELSE 1 END AS nw FROM o),
 g AS (SELECT *, sum(nw) OVER (PARTITION BY structure_id, label, other ORDER BY rn ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT structure_id, label, other, round(min(d), 6) AS dist, count(*) AS n FROM g GROUP BY structure_id, label, other, k""")
def _(spark, sf):
    cells, sites, ops = _structures(spark, sf)
    return X.neighbours(sites, ops, cells).select("structure_id", "label", "other", F.round("dist", 6).alias("dist"), "n")


def _bonds(spark, sf):
    cells, sites, ops = _structures(spark, sf)
    near = X.neighbours(sites, ops, cells)
    species = sites.select("structure_id", "label", "element", "ox", "occ")
    return X.bond_valences(near, species, X.best_parameters(spark.sql(PARAMS), ["a"])), species, X.multiplicities(X.expand_symmetry(sites, ops)), near, sites


@query("bond_valence_sums", f"""WITH {MERGED_SQL} SELECT structure_id, 'Ti1' AS label, round(4 * exp((1.815 - d4) / 0.37) + 2 * exp((1.815 - d2) / 0.37), 6) AS bvs, 4.0::DOUBLE AS expected, 6::BIGINT AS coordination, round((4 * d4 + 2 * d2) / 6, 6) AS mean_dist FROM bd""")
def _(spark, sf):
    bonds, species, *_ = _bonds(spark, sf)
    s = X.cation_sums(bonds, species)
    return s.select("structure_id", "label", F.round("bvs", 6).alias("bvs"), "expected", "coordination", F.round("mean_dist", 6).alias("mean_dist"))


@query("anion_sums", f"WITH {MERGED_SQL} SELECT structure_id, 'O1' AS label, round(2 * exp((1.815 - d4) / 0.37) + exp((1.815 - d2) / 0.37), 6) AS s_cat FROM bd")
def _(spark, sf):
    bonds, _species, mults, *_ = _bonds(spark, sf)
    return X.anion_sums(bonds, mults).withColumn("s_cat", F.round("s_cat", 6))


@query("instability_index", f"""WITH {MERGED_SQL}, s AS (SELECT structure_id, 4 * exp((1.815 - d4) / 0.37) + 2 * exp((1.815 - d2) / 0.37) AS t FROM bd)
SELECT structure_id, round(sqrt((2 * power(t - 4, 2) + 4 * power(t / 2 - 2, 2)) / 6), 6) AS gii, 2::BIGINT AS n_sites FROM s""")
def _(spark, sf):
    bonds, species, mults, *_ = _bonds(spark, sf)
    sums = X.cation_sums(bonds, species).select("structure_id", "label", "bvs", "expected").unionByName(
        X.anion_sums(bonds, mults).select("structure_id", "label", F.col("s_cat").alias("bvs"), F.lit(2.0).alias("expected"))
    )
    return X.instability_index(sums.join(mults, ["structure_id", "label"])).withColumn("gii", F.round("gii", 6))


HB = """SELECT l_orderkey AS id, l_linenumber AS no, (200 + CAST(l_quantity AS BIGINT) * 3) / CAST(100 AS DOUBLE) AS d, l_suppkey AS s, l_partkey AS p FROM {lineitem}"""


@query("hydrogen_bond_valence", f"WITH h AS ({other_sql(HB)}) SELECT id, no, s, p, round(CASE WHEN d BETWEEN 2.45 AND 3.2 THEN power(d / 2.17, -8.2) + 0.06 END, 6) AS v FROM h")
def _(spark, sf):
    return spark_sql(spark, sf, HB).select("id", "no", "s", "p", F.round(X.hydrogen_bond_valence(F.col("d")), 6).alias("v"))


@query("accepted_bonds", f"WITH {BOND_SQL.replace('bd AS', 'unused AS')}, o AS (SELECT structure_id, a * sqrt(2.0) * (1 - 2 * u) AS d1, c AS d2, sqrt(power((0.5 - 2 * u) * a, 2) + power(0.5 * a, 2) + c * c / 4) AS d3 FROM ce) SELECT structure_id, 'O1' AS label, round(coalesce(CASE WHEN d1 BETWEEN 2.45 AND 3.2 THEN power(d1 / 2.17, -8.2) + 0.06 END, 0) + 2 * coalesce(CASE WHEN d2 BETWEEN 2.45 AND 3.2 THEN power(d2 / 2.17, -8.2) + 0.06 END, 0) + 8 * coalesce(CASE WHEN d3 BETWEEN 2.45 AND 3.2 THEN power(d3 / 2.17, -8.2) + 0.06 END, 0), 6) AS s_hb FROM o")
def _(spark, sf):
    _bonds_, _species, mults, near, sites = _bonds(spark, sf)
    pairs = sites.where("label = 'O1'").select("structure_id", F.col("label").alias("donor"), F.col("label").alias("acceptor"))
    return X.accepted_bonds(near, pairs, mults).withColumn("s_hb", F.round("s_hb", 6))


REFLECTIONS = "SELECT l_orderkey * 8 + l_linenumber AS row_id, l_suppkey AS structure_id, CAST(l_suppkey % 4 AS INT) AS h, CAST(l_partkey % 4 AS INT) AS k, CAST(l_linenumber % 3 AS INT) AS l, l_quantity AS q FROM {lineitem}"


@query("systematic_absences", f"""WITH r AS ({other_sql(REFLECTIONS)}) SELECT row_id, h, k, l, ((h = 0 AND (k + l) % 2 = 1) OR (k = 0 AND (h + l) % 2 = 1)) AND NOT (h = 0 AND k = 0 AND l = 0) AS absent, count(*) AS n FROM r GROUP BY ALL""")
def _(spark, sf):
    ops = operator_rows(spark).withColumn("space_group", F.lit("P42/mnm"))
    rows = spark_sql(spark, sf, REFLECTIONS).withColumn("space_group", F.lit("P42/mnm"))
    return X.systematic_absences(rows, ops).groupBy("row_id", "h", "k", "l", "absent").agg(F.count(F.lit(1)).alias("n"))


def _pattern(spark, sf, dmin=1.5):
    cells, sites, ops = _structures(spark, sf)
    return X.powder_pattern(cells, sites, ops, spark.sql(FACTORS), 1.5406, dmin), ops


@query("powder_pattern", f"""WITH {ATOM_SQL}, r AS (SELECT unnest(range(-6, 7)) AS n), hk AS (SELECT h.n AS h, k.n AS k, l.n AS l FROM r h, r k, r l WHERE NOT (h.n = 0 AND k.n = 0 AND l.n = 0)),
 e AS (SELECT structure_id, h, k, l, (h * h + k * k) / (a * a) + l * l / (c * c) AS q FROM ce, hk), v AS (SELECT * FROM e WHERE 1 / sqrt(q) >= 1.5),
 f AS (SELECT v.structure_id, h, k, l, q, sum(w * cos(2 * pi() * (h * x + k * y + l * z))) AS re, sum(w * sin(2 * pi() * (h * x + k * y + l * z))) AS im FROM (SELECT v.*, atm.x, atm.y, atm.z, CASE atm.label WHEN 'Ti1' THEN 9.7595 * exp(-7.8508 * q / 4) + 7.3558 * exp(-0.5 * q / 4) + 1.6991 * exp(-35.6338 * q / 4) + 1.9021 * exp(-116.105 * q / 4) + 1.2807
   ELSE 3.0485 * exp(-13.2771 * q / 4) + 2.2868 * exp(-5.7011 * q / 4) + 1.5463 * exp(-0.3239 * q / 4) + 0.867 * exp(-32.9089 * q / 4) + 0.2508 END AS w FROM v JOIN atm ON atm.structure_id = v.structure_id) v GROUP BY 1, 2, 3, 4, 5),
 m AS (SELECT structure_id, greatest(abs(h), abs(k)) AS h, least(abs(h), abs(k)) AS k, abs(l) AS l, count(*) AS mult, max(q) AS q, max(re * re + im * im) AS f2 FROM f GROUP BY 1, 2, 3, 4),
 t AS (SELECT *, asin(1.5406 / 2 * sqrt(q)) AS th FROM m WHERE f2 >= 1e-6), i AS (SELECT *, mult * f2 * (1 + power(cos(2 * th), 2)) / (power(sin(th), 2) * cos(th)) AS raw FROM t)
SELECT structure_id, CAST(h AS INT) AS h, CAST(k AS INT) AS k, CAST(l AS INT) AS l, round(1 / sqrt(q), 6) AS d, round(degrees(2 * th), 5) AS two_theta, mult, round(f2, 3) AS f2, round(100 * raw / max(raw) OVER (PARTITION BY structure_id), 4) AS i FROM i""")
def _(spark, sf):
    pattern, _ops = _pattern(spark, sf)
    return pattern.select("structure_id", "h", "k", "l", F.round("d", 6).alias("d"), F.round("two_theta", 5).alias("two_theta"), "mult", F.round("f2", 3).alias("f2"), F.round("i", 4).alias("i"))


@query("table_vs_pattern")
def _(spark, sf):
    pattern, ops = _pattern(spark, sf)
    pattern = cut_lineage(pattern)  # the table is made of it, and met with it twice
    # the printed table: the pattern rounded, an index written in another equivalent form, one line in seven left out, one d in eleven mistyped
    table = pattern.where("(structure_id + h * 3 + k * 5 + l) % 7 <> 0").select(
        "structure_id", (-F.col("k")).alias("h"), "h", "l", F.expr("round(CASE WHEN (structure_id + h + k) % 11 = 0 THEN d * 1.01 ELSE d END, 4)").alias("d"), F.round("i", 0).alias("i")
    ).toDF("structure_id", "h", "k", "l", "d", "i")
    return X.table_vs_pattern(table, pattern, ops)


FIT_ROWS = f"""SELECT l_suppkey AS entry_id, 'tetragonal' AS system, CAST(1 + l_partkey % 4 AS INT) AS h, CAST(l_orderkey % 3 AS INT) AS k, CAST(l_linenumber % 4 AS INT) AS l, l_discount AS noise, a, c FROM {{lineitem}} JOIN ({CELLS}) ce ON structure_id = l_suppkey"""


def _fit_rows(spark, sf):
    rows = spark_sql(spark, sf, FIT_ROWS)
    d = 1 / F.sqrt((F.col("h") * F.col("h") + F.col("k") * F.col("k")) / (F.col("a") * F.col("a")) + F.col("l") * F.col("l") / (F.col("c") * F.col("c")))
    return rows.select("entry_id", "system", "h", "k", "l", (d * (1 + (F.col("noise") - 0.05) / 1000)).alias("d"))


def _fit_sql(name, rows):
    """The tetragonal fit of rows (entry_id, x = h² + k², z = l², d) in SQL: entry_id, n, a, c."""
    return f"""{name}_s AS (SELECT entry_id, count(*) AS n, CAST(sum(x * x) AS DOUBLE) AS xx, CAST(sum(x * z) AS DOUBLE) AS xz, CAST(sum(z * z) AS DOUBLE) AS zz, sum(x / (d * d)) AS xy, sum(z / (d * d)) AS zy FROM {rows} GROUP BY 1),
 {name} AS (SELECT entry_id, n, 1 / sqrt((xy * zz - zy * xz) / (xx * zz - xz * xz)) AS a, 1 / sqrt((zy * xx - xy * xz) / (xx * zz - xz * xz)) AS c FROM {name}_s WHERE n >= 4)"""


@query("fit_cell", f"""WITH r AS ({other_sql(FIT_ROWS)}), d AS (SELECT entry_id, h * h + k * k AS x, l * l AS z, 1 / power(1 / sqrt((h * h + k * k) / (a * a) + l * l / (c * c)) * (1 + (noise - 0.05) / 1000), 2) AS y FROM r),
 s AS (SELECT entry_id, count(*) AS n, CAST(sum(x * x) AS DOUBLE) AS xx, CAST(sum(x * z) AS DOUBLE) AS xz, CAST(sum(z * z) AS DOUBLE) AS zz, sum(x * y) AS xy, sum(z * y) AS zy FROM d GROUP BY 1),
 p AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS p1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS p2 FROM s WHERE n >= 4)
SELECT entry_id, n, round(1 / sqrt(p1), 6) AS a, round(1 / sqrt(p2), 6) AS c, 90.0::DOUBLE AS ga FROM p""")
def _(spark, sf):
    return X.fit_cell(_fit_rows(spark, sf)).select("entry_id", "n", F.round("a", 6).alias("a"), F.round("c", 6).alias("c"), F.round("ga", 6).alias("ga"))


SYSTEM_CELLS = """SELECT s_suppkey AS entry_id, CASE s_suppkey % 5 WHEN 0 THEN 'triclinic' WHEN 1 THEN 'monoclinic-b' WHEN 2 THEN 'orthorhombic' WHEN 3 THEN 'hexagonal' ELSE 'cubic' END AS system, 5 + (s_suppkey % 7) / CAST(10 AS DOUBLE) AS a,
  CASE WHEN s_suppkey % 5 >= 3 THEN 5 + (s_suppkey % 7) / CAST(10 AS DOUBLE) ELSE 6 + (s_suppkey % 11) / CAST(10 AS DOUBLE) END AS b, CASE WHEN s_suppkey % 5 = 4 THEN 5 + (s_suppkey % 7) / CAST(10 AS DOUBLE) ELSE 7 + (s_suppkey % 13) / CAST(10 AS DOUBLE) END AS c,
  CAST(CASE s_suppkey % 5 WHEN 0 THEN 84 ELSE 90 END AS DOUBLE) AS al, CAST(CASE s_suppkey % 5 WHEN 0 THEN 95 WHEN 1 THEN 100 + s_suppkey % 9 ELSE 90 END AS DOUBLE) AS be, CAST(CASE s_suppkey % 5 WHEN 0 THEN 101 WHEN 3 THEN 120 ELSE 90 END AS DOUBLE) AS ga FROM {supplier}"""


@query("fit_cell_systems", f"SELECT entry_id, system, n, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c, al, be, ga FROM ({other_sql(SYSTEM_CELLS)}) JOIN (SELECT l_suppkey AS entry_id, count(*) AS n FROM lineitem GROUP BY 1) USING (entry_id)")
def _(spark, sf):
    # lists that follow from a known cell of each kind give that cell back
    cells = spark_sql(spark, sf, SYSTEM_CELLS)
    lines = spark_sql(spark, sf, "SELECT l_suppkey AS entry_id, CAST(1 + l_partkey % 4 AS INT) AS h, CAST(l_orderkey % 5 - 2 AS INT) AS k, CAST(l_linenumber % 4 AS INT) AS l FROM {lineitem}").join(cells, "entry_id")
    rows = lines.withColumn("d", K.d_spacing([F.col(c) for c in X.CELL], F.col("h"), F.col("k"), F.col("l"))).select("entry_id", "system", "h", "k", "l", "d")
    fit = X.fit_cell(rows).join(cells.select("entry_id", "system"), "entry_id")
    return fit.select("entry_id", "system", "n", *[F.round(c, 4).alias(c) for c in X.CELL])


@query("trimmed_fit", f"""WITH r AS ({other_sql(FIT_ROWS)}), d AS (SELECT entry_id, h * h + k * k AS x, l * l AS z, 1 / sqrt((h * h + k * k) / (a * a) + l * l / (c * c)) * (1 + (noise - 0.05) / 1000) * CASE WHEN h = 3 AND k = 2 AND l = 1 THEN 1.05 ELSE 1 END AS d FROM r),
 @fit(f1, d), e AS (SELECT d.*, abs(1 / sqrt(x / (a * a) + z / (c * c)) - d) AS dev FROM d JOIN f1 USING (entry_id)), m AS (SELECT entry_id, median(dev) AS med, count(*) AS nr FROM e GROUP BY 1),
 o AS (SELECT e.*, nr, dev > greatest(10 * med, 0.01) AS off FROM e JOIN m USING (entry_id)), q AS (SELECT entry_id, count(*) FILTER (WHERE off) AS n_off, max(nr) AS nr FROM o GROUP BY 1),
 kept AS (SELECT o.entry_id, x, z, d FROM o JOIN q USING (entry_id) WHERE NOT off OR n_off > 0.1 * q.nr), @fit(f2, kept),
 rm AS (SELECT entry_id, sqrt(avg(power(1 / sqrt(x / (a * a) + z / (c * c)) - d, 2))) AS rms FROM kept JOIN f2 USING (entry_id) GROUP BY 1)
SELECT entry_id, n, round(a, 5) AS a, round(c, 5) AS c, round(rms, 5) AS rms, CASE WHEN n_off <= 0.1 * nr THEN n_off ELSE 0 END AS set_aside FROM f2 JOIN rm USING (entry_id) JOIN q USING (entry_id)""".replace("@fit(f1, d)", _fit_sql("f1", "d")).replace("@fit(f2, kept)", _fit_sql("f2", "kept")))
def _(spark, sf):
    rows = _fit_rows(spark, sf).withColumn("d", F.when((F.col("h") == 3) & (F.col("k") == 2) & (F.col("l") == 1), F.col("d") * 1.05).otherwise(F.col("d")))
    return X.trimmed_fit(rows).select("entry_id", "n", *[F.round(c, 5).alias(c) for c in ("a", "c", "rms")], "set_aside")


# the fit, what its residuals leave uncertain, and each axis against the printed one; all angles are right ones
@query("cell_matches", f"""WITH r AS ({other_sql(FIT_ROWS)}), p AS (SELECT structure_id AS entry_id, CASE WHEN structure_id % 9 = 0 THEN a + 0.2 ELSE a END AS pa, b AS pb, c AS pc FROM ({other_sql(CELLS)})),
 d AS (SELECT entry_id, h * h + k * k AS x, l * l AS z, 1 / sqrt((h * h + k * k) / (a * a) + l * l / (c * c)) * (1 + (noise - 0.05) / 1000) AS d FROM r), {_fit_sql("f1", "d")},
 s AS (SELECT f1.entry_id, f1.a, f1.c, greatest(yy - xy / (f1.a * f1.a) - zy / (f1.c * f1.c), 0) / greatest(1, f1.n - 2) AS rest, xx, zz, xx * zz - xz * xz AS det FROM f1 JOIN f1_s USING (entry_id) JOIN (SELECT entry_id, sum(1 / (d * d * d * d)) AS yy FROM d GROUP BY 1) USING (entry_id)),
 u AS (SELECT *, abs(1 / sqrt(1 / (a * a) + sqrt(rest * zz / det)) - a) AS sa, abs(1 / sqrt(1 / (c * c) + sqrt(rest * xx / det)) - c) AS sc FROM s)
SELECT entry_id, abs(a - pa) <= greatest(0.0075, 3 * sa, 0.0002 * pa) AND abs(a - pb) <= greatest(0.0075, 3 * sa, 0.0002 * pb) AND abs(c - pc) <= greatest(0.0075, 3 * sc, 0.0002 * pc) AS matches,
  round(greatest(abs(a - pa) / pa, abs(a - pb) / pb, abs(c - pc) / pc), 4) AS worst FROM u JOIN p USING (entry_id)""")
def _(spark, sf):
    fits = X.fit_cell(_fit_rows(spark, sf))
    cells = spark_sql(spark, sf, CELLS).select(F.col("structure_id").alias("entry_id"), *[F.col(c).alias(f"p_{c}") for c in X.CELL], *[F.lit(2 if c in "abc" else 0).alias(f"d_{c}") for c in X.CELL])
    printed = cells.withColumn("p_a", F.expr("CASE WHEN entry_id % 9 = 0 THEN p_a + 0.2 ELSE p_a END"))
    return X.cell_matches(fits, printed).select("entry_id", "matches", F.round("worst", 4).alias("worst"))


@query("cell_consistency", f"""WITH r AS ({other_sql(REFLECTIONS)}), c AS ({other_sql(CELLS)}), d AS (SELECT r.structure_id, 1 / sqrt((h * h + k * k) / (a * a) + l * l / (c * c)) AS x, q FROM r JOIN c ON c.structure_id = r.structure_id WHERE NOT (h = 0 AND k = 0 AND l = 0))
SELECT structure_id, count(*) AS n, count(*) FILTER (WHERE abs(x - x * (1 + q / 5000)) / (x * (1 + q / 5000)) <= 0.005) AS ok FROM d GROUP BY 1""")
def _(spark, sf):
    cells = spark_sql(spark, sf, CELLS).drop("u")
    rows = spark_sql(spark, sf, REFLECTIONS).join(cells.select("structure_id", "a", F.col("c").alias("cc")), "structure_id")
    d = (1 + F.col("q") / 5000) / F.sqrt((F.col("h") * F.col("h") + F.col("k") * F.col("k")) / (F.col("a") * F.col("a")) + F.col("l") * F.col("l") / (F.col("cc") * F.col("cc")))
    zero = "NOT (h = 0 AND k = 0 AND l = 0)"
    return X.cell_consistency(rows.where(zero).select("structure_id", "h", "k", "l", d.alias("d")), cells)


@query("site_totals", "SELECT s_suppkey AS structure_id, e AS element, CASE e WHEN 'Ti' THEN 2.0 ELSE 4.0 END::DOUBLE AS atoms FROM supplier, (VALUES ('Ti'), ('O')) t(e)")
def _(spark, sf):
    cells, sites, ops = _structures(spark, sf)
    return X.site_totals(sites.select("structure_id", "label", "element", "ox", "occ"), X.multiplicities(X.expand_symmetry(sites, ops)))


TOTALS = "SELECT l_suppkey AS structure_id, CASE l_linenumber WHEN 1 THEN 'Ca' WHEN 2 THEN 'Si' WHEN 3 THEN 'O' WHEN 4 THEN 'Fe' ELSE 'Al' END AS element, CAST(sum(l_quantity) AS DOUBLE) AS atoms FROM {lineitem} GROUP BY 1, 2"
FORMULA = "SELECT l_suppkey AS structure_id, CASE l_linenumber WHEN 1 THEN 'Ca' WHEN 2 THEN 'Si' WHEN 3 THEN 'O' WHEN 4 THEN 'Fe' ELSE 'Mg' END AS element, CAST(sum(l_quantity) / 4 + CASE WHEN l_suppkey % 3 = 0 AND l_linenumber = 4 THEN 30 ELSE 0 END AS DOUBLE) AS n FROM {lineitem} GROUP BY l_suppkey, CASE l_linenumber WHEN 1 THEN 'Ca' WHEN 2 THEN 'Si' WHEN 3 THEN 'O' WHEN 4 THEN 'Fe' ELSE 'Mg' END, CASE WHEN l_suppkey % 3 = 0 AND l_linenumber = 4 THEN 30 ELSE 0 END"
UNITS_SQL = f"t AS ({other_sql(TOTALS)}), f AS ({other_sql(FORMULA)}), r AS (SELECT t.structure_id, atoms / n AS q FROM t JOIN f USING (structure_id, element) WHERE n >= 0.5), z AS (SELECT structure_id, round_even(median(q), 0) AS z FROM r GROUP BY 1 HAVING count(*) >= 2 AND greatest(max(q) - median(q), median(q) - min(q)) <= 0.25 * median(q))"


@query("formula_units", f"WITH {UNITS_SQL} SELECT * FROM z")
def _(spark, sf):
    return X.formula_units(spark_sql(spark, sf, TOTALS), spark_sql(spark, sf, FORMULA))


@query("site_formula_check", f"""WITH {UNITS_SQL}, p AS (SELECT t.structure_id, element, atoms / z AS h FROM t JOIN z USING (structure_id)), w AS (SELECT f.* FROM f JOIN z USING (structure_id)),
 b AS (SELECT coalesce(p.structure_id, w.structure_id) AS structure_id, coalesce(p.element, w.element) AS element, coalesce(h, 0) AS h, coalesce(n, 0) AS w, n IS NULL AS nf FROM p FULL JOIN w ON w.structure_id = p.structure_id AND w.element = p.element),
 s AS (SELECT *, CASE WHEN h = 0 AND w > 0 THEN 'absent' WHEN nf AND h >= 0.05 THEN 'not in formula' WHEN NOT nf AND abs(h - w) > greatest(0.05, 0.05 * w) THEN 'differs' END AS state FROM b WHERE element <> 'O')
SELECT structure_id, element, round(h, 4) AS from_sites, round(w, 4) AS from_formula, state FROM s WHERE state IS NOT NULL""")
def _(spark, sf):
    totals, formula = spark_sql(spark, sf, TOTALS), spark_sql(spark, sf, FORMULA)
    return X.site_formula_check(totals, formula, X.formula_units(totals, formula))


STATED = "SELECT s_suppkey AS structure_id, CAST(s_acctbal * 20 AS DOUBLE) AS f000, CAST(s_acctbal / 100 AS DOUBLE) AS mu, CAST(10 AS DOUBLE) AS density, CAST(5000 AS DOUBLE) AS volume FROM {supplier}"
MU = "SELECT * FROM (VALUES ('Ca', 18.3), ('Si', 6.44), ('O', 1.31), ('Fe', 38.5), ('Al', 5.16)) AS t(element, mu_rho)"


@query("totals_check", f"""WITH t AS ({other_sql(TOTALS)}), s AS ({other_sql(STATED)}), k AS (SELECT * FROM (VALUES ('Ca', 18.3, 20, 40.078), ('Si', 6.44, 14, 28.085), ('O', 1.31, 8, 15.999), ('Fe', 38.5, 26, 55.845), ('Al', 5.16, 13, 26.982)) AS t(element, m, zn, w)),
 g AS (SELECT structure_id, sum(atoms * zn) AS e, 0.1 * sum(atoms * CAST(w AS DOUBLE) * CAST(m AS DOUBLE)) / (0.602214076 * 5000) AS mu, sum(atoms * CAST(w AS DOUBLE)) / (5000 * 0.602214) AS d FROM t JOIN k USING (element) GROUP BY 1)
SELECT g.structure_id, round(e, 4) AS electrons, round(g.mu, 6) AS mu_sites, round(d, 6) AS density_sites, abs(e - f000) > 0.02 * f000 AS f000_off, abs(g.mu - s.mu) > 0.10 * g.mu AS mu_off, abs(d - density) > 0.01 AS density_off FROM g JOIN s USING (structure_id)""")
def _(spark, sf):
    mu = spark.sql(MU).select("element", F.col("mu_rho").cast("double").alias("mu_rho"))
    return X.totals_check(spark_sql(spark, sf, TOTALS), spark_sql(spark, sf, STATED), mu)


@query("structure_closure", f"""WITH t AS ({other_sql(TOTALS)}), f AS ({other_sql(FORMULA)}), b AS (SELECT coalesce(t.structure_id, f.structure_id) AS s, coalesce(t.element, f.element) AS e, coalesce(atoms, 0) AS a, coalesce(n, 0) AS n FROM t FULL JOIN f ON f.structure_id = t.structure_id AND f.element = t.element),
 r AS (SELECT s, arg_max(a / n, (n, e)) AS k FROM b WHERE a > 0 AND n > 0 GROUP BY 1), m AS (SELECT s, max(n) AS top FROM b GROUP BY 1),
 g AS (SELECT b.s, sum(CASE WHEN e = 'O' THEN 0 ELSE a END) AS c1, sum(CASE WHEN e = 'O' THEN a ELSE 0 END) AS a1, sum(CASE WHEN e = 'O' THEN 0 ELSE n END) AS c2, sum(CASE WHEN e = 'O' THEN n ELSE 0 END) AS a2,
   avg(CASE WHEN NOT (a = 0 AND n < 0.2 * top) THEN abs(a / k - n) / greatest(n, 0.05) END) AS mo FROM b JOIN r USING (s) JOIN m USING (s) GROUP BY 1)
SELECT s AS structure_id, round(abs(c1 / a1 - c2 / a2) / (c2 / a2), 6) AS ratio_off, round(mo, 6) AS mean_off FROM g WHERE a1 > 0 AND a2 > 0 AND c2 > 0""")
def _(spark, sf):
    return X.closure(spark_sql(spark, sf, TOTALS), spark_sql(spark, sf, FORMULA))


LISTED = f"SELECT structure_id, 'Ti1' AS label, 'O1' AS other, CASE WHEN structure_id % 4 = 0 THEN sqrt(CAST(2 AS DOUBLE)) * u * a + 0.02 ELSE sqrt(CAST(2 AS DOUBLE)) * u * a END AS dist FROM ({CELLS}) ce"


@query("geometry_self_check", f"WITH {BOND_SQL}, l AS ({other_sql(LISTED)}), o AS (SELECT l.structure_id, label, other, dist, least(abs(dist - d2), abs(dist - d4)) AS off FROM l JOIN bd ON bd.structure_id = l.structure_id) SELECT structure_id, label, other, round(dist, 6) AS listed, round(off, 6) AS off FROM o WHERE off > 0.003")
def _(spark, sf):
    cells, sites, ops = _structures(spark, sf)
    g = X.geometry_self_check(X.neighbours(sites, ops, cells), spark_sql(spark, sf, LISTED))
    return g.select("structure_id", "label", "other", F.round("listed", 6).alias("listed"), F.round("off", 6).alias("off"))


@query("printed_bonds_check", f"WITH {BOND_SQL} SELECT structure_id, 'Ti1' AS label, 'O1' AS other, 3 AS op_no, round(d4 + CASE WHEN structure_id % 5 = 0 THEN 0.03 ELSE 0 END, 4) AS dist, round(d4, 6) AS calc, structure_id % 5 <> 0 AS agrees FROM bd")
def _(spark, sf):
    cells, sites, ops = _structures(spark, sf)
    d4 = F.sqrt(2 * F.pow((0.5 - F.col("u")) * F.col("a"), 2) + F.col("c") * F.col("c") / 4)
    printed = spark_sql(spark, sf, CELLS).select("structure_id", F.lit("Ti1").alias("label"), F.lit("O1").alias("other"), F.lit(3).alias("op_no"), F.array(F.lit(0), F.lit(-1), F.lit(0)).alias("shift"),
                                                 F.round(d4 + F.when(F.col("structure_id") % 5 == 0, 0.03).otherwise(0.0), 4).alias("dist"))
    return X.printed_bonds_check(sites, ops, cells, printed)


@query("cooccurring_bond_hits", f"WITH {BOND_SQL} SELECT 'Ti1' AS label, 'O1' AS other, count(*) AS n, count(*) FILTER (WHERE structure_id % 4 <> 0 OR abs(d2 + 0.02 - d4) <= 0.01) AS hits, round(count(*) FILTER (WHERE structure_id % 4 <> 0 OR abs(d2 + 0.02 - d4) <= 0.01) / count(*), 4) AS share FROM bd")
def _(spark, sf):
    cells, sites, ops = _structures(spark, sf)
    return X.cooccurring_bond_hits(spark_sql(spark, sf, LISTED), X.neighbours(sites, ops, cells))


GRID = "SELECT l_suppkey AS structure_id, concat('O', CAST(l_linenumber AS STRING)) AS row_label, concat('M', CAST(l_partkey % 5 AS STRING)) AS col_label, CAST(avg(l_quantity) / 40 AS DOUBLE) AS s FROM {lineitem} WHERE l_linestatus = '@' GROUP BY 1, 2, 3"


@query("compare_valence_tables", f"""WITH c AS ({other_sql(GRID.replace("@", "O"))}), p AS ({other_sql(GRID.replace("@", "F"))}), b AS (SELECT coalesce(c.structure_id, p.structure_id) AS structure_id, coalesce(c.row_label, p.row_label) AS row_label, coalesce(c.col_label, p.col_label) AS col_label, c.s AS c, p.s AS p
  FROM c FULL JOIN p ON p.structure_id = c.structure_id AND p.row_label = c.row_label AND p.col_label = c.col_label), t AS (SELECT *, CASE WHEN c IS NULL THEN 'only printed' WHEN p IS NULL THEN CASE WHEN c >= 0.10 THEN 'only computed' END WHEN abs(c - p) <= 0.015 + 0.025 * abs(p) THEN 'agrees' ELSE 'differs' END AS state FROM b)
SELECT structure_id, row_label, col_label, round(c, 6) AS computed, round(p, 6) AS printed, state FROM t WHERE state IS NOT NULL""")
def _(spark, sf):
    t = X.compare_valence_tables(spark_sql(spark, sf, GRID.replace("@", "O")), spark_sql(spark, sf, GRID.replace("@", "F")))
    return t.select("structure_id", "row_label", "col_label", F.round("computed", 6).alias("computed"), F.round("printed", 6).alias("printed"), "state")


# a printed table typed from the computed one: some columns of some structures scaled throughout, some cells slipped
TYPED = """SELECT structure_id, row_label, col_label, CASE WHEN structure_id % 3 = 0 AND col_label = 'M2' THEN s * 0.85 WHEN structure_id % 4 = 1 AND col_label = 'M1' THEN s * 1.25 WHEN structure_id % 5 = 0 AND row_label = 'O3' THEN s + 0.2
  WHEN structure_id % 7 = 0 AND col_label = 'M4' THEN s + CASE WHEN row_label IN ('O1', 'O3', 'O5') THEN 0.3 ELSE -0.25 END ELSE s + CASE WHEN row_label = 'O2' THEN 0.004 ELSE -0.003 END END AS s FROM (@g) g"""


@query("diagnose_columns", f"""WITH c AS ({other_sql(GRID.replace("@", "O"))}), p AS ({other_sql(TYPED.replace("@g", GRID.replace("@", "O")))}), b AS (SELECT structure_id, col_label, c.s AS x, p.s AS y, abs(c.s - p.s) > 0.015 + 0.025 * abs(p.s) AS off FROM c JOIN p USING (structure_id, row_label, col_label)),
 m AS (SELECT structure_id, col_label, median(CASE WHEN x >= 0.05 THEN y / x END) AS scale FROM b GROUP BY ALL),
 r AS (SELECT structure_id, col_label, count(*) AS n, count(*) FILTER (WHERE off) AS n_differ, any_value(scale) AS scale, count(*) FILTER (WHERE round(abs(y - scale * x), 9) <= round(0.015 + 0.025 * abs(y), 9)) / count(*) AS explained, count(*) FILTER (WHERE off AND y > x) AS over_ FROM b JOIN m USING (structure_id, col_label) GROUP BY ALL)
SELECT structure_id, col_label, n, n_differ, round(scale, 6) AS scale, round(explained, 6) AS explained, CASE WHEN n >= 3 AND n_differ >= greatest(2, ceil(0.4::DOUBLE * n)) AND over_ IN (0, n_differ) AND explained >= 0.8 AND round(abs(scale - 1), 9) > 0.03 THEN 'scaled'
  WHEN n_differ >= 3 AND n_differ >= 0.6 * n THEN 'another' WHEN n_differ > 0 THEN 'cells' ELSE 'agrees' END AS verdict FROM r""")
def _(spark, sf):
    grid = GRID.replace("@", "O")
    told = X.diagnose_columns(X.compare_valence_tables(spark_sql(spark, sf, grid), spark_sql(spark, sf, TYPED.replace("@g", grid))))
    return told.withColumn("scale", F.round("scale", 6)).withColumn("explained", F.round("explained", 6))


NUMBERS = "SELECT l_orderkey AS structure_id, concat('i', CAST(l_linenumber AS STRING)) AS item, CASE l_linenumber WHEN 1 THEN 'cell' WHEN 2 THEN 'r' WHEN 3 THEN 'gof' WHEN 4 THEN 'int' WHEN 5 THEN 'f000' ELSE 'other' END AS how, l_quantity / 10 AS value, CAST(0.01 AS DOUBLE) AS esd, 2 AS decimals, CASE WHEN l_returnflag = 'A' THEN 'table' ELSE 'prose' END AS place FROM {lineitem}"
ITEMS = "SELECT o_orderkey AS structure_id, concat('i', CAST(k AS STRING)) AS item, (o_custkey % 50) / CAST(10 AS DOUBLE) AS ref, CAST(0.02 AS DOUBLE) AS ref_esd FROM (SELECT *, explode(sequence(1, 7)) AS k FROM {orders}) t"


@query("compare_refinement_numbers", f"""WITH n AS ({other_sql(NUMBERS)}), i AS ({other_sql(ITEMS).replace('explode(sequence(1, 7))', 'unnest(range(1, 8))')}), j AS (SELECT n.structure_id, n.item, value, ref, how, bool_or(place = 'table') AS any_table FROM n JOIN i ON i.structure_id = n.structure_id AND i.item = n.item GROUP BY 1, 2, 3, 4, 5)
SELECT structure_id, item, value, ref, CASE WHEN any_table THEN 'flag' ELSE 'note' END AS sev FROM j WHERE abs(value - ref) > CASE how WHEN 'cell' THEN 0.06 WHEN 'r' THEN 0.0006 WHEN 'gof' THEN 0.006 WHEN 'int' THEN 0.5 WHEN 'f000' THEN 1.0 ELSE greatest(0.006, 0.002 * abs(ref)) END""")
def _(spark, sf):
    return X.compare_refinement_numbers(spark_sql(spark, sf, NUMBERS), spark_sql(spark, sf, ITEMS))


REFINED = """SELECT o_orderkey AS structure_id, (o_custkey % 100) / CAST(1000 AS DOUBLE) AS r1, (o_custkey % 37) / CAST(1000 AS DOUBLE) AS rint, (o_custkey % 190) / CAST(1000 AS DOUBLE) AS wr2, CASE WHEN o_orderkey % 4 > 0 THEN 0.9 + (o_orderkey % 100) / CAST(1000 AS DOUBLE) END AS completeness,
  CAST(o_custkey AS DOUBLE) AS n_observed, CAST(o_custkey + o_orderkey % 2000 AS DOUBLE) AS n_total, CAST(100 + o_orderkey % 50 AS DOUBLE) AS n_parameters, (o_orderkey % 110) / CAST(100 AS DOUBLE) AS flack, CASE WHEN o_orderkey % 3 = 0 THEN 0.2 END AS flack_esd,
  CAST(o_custkey % 20 AS DOUBLE) AS mu, CAST(0.1 AS DOUBLE) AS dmax, (o_orderkey % 50) / CAST(100 AS DOUBLE) AS tmin, CAST(0.9 AS DOUBLE) AS tmax, CASE WHEN o_orderkey % 2 = 0 THEN 'numerical' ELSE 'multi-scan' END AS absorption FROM {orders}"""


@query("refinement_triage", f"""WITH r AS ({other_sql(REFINED)}) SELECT structure_id, 'R1 against Rint' AS finding, 'note' AS sev FROM r WHERE r1 > greatest(3 * rint, 0.06) UNION ALL SELECT structure_id, 'wR2 against R1', 'note' FROM r WHERE r1 <> 0 AND wr2 / r1 > 3.5
UNION ALL SELECT structure_id, 'completeness', 'note' FROM r WHERE completeness < 0.95 UNION ALL SELECT structure_id, 'observed fraction', 'note' FROM r WHERE n_total <> 0 AND n_observed / n_total < 0.5 UNION ALL SELECT structure_id, 'data per parameter', 'note' FROM r WHERE n_total / n_parameters < 8
UNION ALL SELECT structure_id, 'Flack parameter', 'note' FROM r WHERE flack BETWEEN 0.15 AND 0.85 AND coalesce(flack_esd < 0.15, true) UNION ALL SELECT structure_id, 'transmission range', CASE WHEN absorption = 'numerical' THEN 'flag' ELSE 'note' END FROM r WHERE tmin / tmax < exp(-2 * mu * dmax) * 0.999""")
def _(spark, sf):
    rows = spark_sql(spark, sf, REFINED).withColumn("r1", F.nullif("r1", F.lit(0.0))).withColumn("n_total", F.nullif("n_total", F.lit(0.0)))
    return X.refinement_triage(rows)


BOND_LIST = "SELECT l_suppkey AS structure_id, concat('U', CAST(l_linenumber % 3 AS STRING)) AS label, 'Ti' AS cation, 4 AS cation_ox, concat('O', CAST(l_partkey % 20 AS STRING)) AS other, 'O' AS anion, -2 AS anion_ox, CAST(floor(170 + l_extendedprice / 700) AS DOUBLE) / 100 AS dist, CAST(1 + l_linenumber % 2 AS BIGINT) AS n FROM {lineitem}"


@query("bond_statistics", f"WITH b AS ({other_sql(BOND_LIST)}) SELECT structure_id, label, CAST(sum(n) AS BIGINT) AS coordination, round(sum(dist * n) / sum(n), 6) AS mean_dist, round(sum(exp((1.815 - dist) / 0.37) * n), 4) AS bvs, 0::BIGINT AS no_parameters FROM b GROUP BY 1, 2")
def _(spark, sf):
    s = X.bond_statistics(spark_sql(spark, sf, BOND_LIST), X.best_parameters(spark.sql(PARAMS), ["a"]))
    return s.select("structure_id", "label", "coordination", F.round("mean_dist", 6).alias("mean_dist"), F.round("bvs", 4).alias("bvs"), "no_parameters")


@query("coordination_summary", f"""WITH b AS ({other_sql(BOND_LIST)}), m AS (SELECT structure_id, label, other, round(dist, 3) AS dist, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1, 2, 3, 4)
SELECT structure_id, label, other, dist, n, CAST(sum(n) OVER w AS BIGINT) AS number, round(sum(dist * n) OVER w / sum(n) OVER w, 3) AS mean_dist, label || '–' || other || ' ' || format('{{:.3f}}', dist) || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END AS text FROM m WINDOW w AS (PARTITION BY structure_id, label)""")
def _(spark, sf):
    return X.coordination_summary(spark_sql(spark, sf, BOND_LIST))


URANYL = BOND_LIST.replace("l_linenumber % 3 AS STRING", "l_partkey % 120 AS STRING")


@query("uranyl_sites", f"""WITH b AS ({other_sql(URANYL)}), f AS (SELECT structure_id, label, other, CAST(floor((dist - 1.7) * 5000) AS DOUBLE) / 10000 + 1.7 AS dist, n FROM b),
 e AS (SELECT structure_id, label, dist FROM (SELECT *, unnest(range(1, CAST(least(n, 3) AS BIGINT) + 1)) AS one FROM f)), k AS (SELECT *, row_number() OVER (PARTITION BY structure_id, label ORDER BY dist) AS k FROM e),
 t AS (SELECT structure_id, label, max(dist) FILTER (WHERE k = 1) AS d1, max(dist) FILTER (WHERE k = 2) AS d2, max(dist) FILTER (WHERE k = 3) AS d3 FROM k WHERE k <= 3 GROUP BY 1, 2)
SELECT structure_id, label, round((d1 + d2) / 2, 6) AS mean_dist, round(power(106.5 / ((d1 + d2) / 2 - 0.575), 1.5), 4) AS nu1, round(power(91.41 / ((d1 + d2) / 2 - 0.804), 1.5), 4) AS nu3 FROM t WHERE d2 < 1.95 AND (d3 IS NULL OR d3 - d2 >= 0.20)""")
def _(spark, sf):
    near = spark_sql(spark, sf, URANYL).select("structure_id", "label", "other", F.expr("CAST(floor((dist - 1.7D) * 5000) AS DOUBLE) / 10000 + 1.7D").alias("dist"), "n")
    labels = near.select("structure_id", "label", F.lit("U").alias("element")).unionByName(near.select("structure_id", F.col("other").alias("label"), F.lit("O").alias("element"))).distinct()
    return X.uranyl_sites(near, labels)


OXYGENS = "SELECT l_orderkey AS structure_id, CASE l_linenumber % 3 WHEN 0 THEN concat('O', CAST(l_linenumber AS STRING)) WHEN 1 THEN 'OH1' ELSE 'OW2' END AS label, CAST(1 + l_suppkey % 4 AS BIGINT) AS mult, CASE WHEN l_discount = 0 THEN 0.5 ELSE 1.0 END AS occ, l_quantity / 25 AS s_cat, l_quantity / 25 + 0.05 AS s_total, CAST(l_partkey % 3 AS INT) AS n_h, l_partkey AS p, l_extendedprice AS e FROM {lineitem}"


@query("anion_assignment", f"""WITH o AS ({other_sql(OXYGENS)}), f AS (SELECT *, CASE WHEN n_h = 0 AND regexp_matches(label, '^O\\d+$') AND s_cat < 1.70 AND s_total < 1.80 THEN 'under-bonded O' WHEN (n_h = 1 OR (n_h = 0 AND label = 'OH1')) AND s_cat > 1.85 THEN 'over-bonded OH' WHEN (n_h = 2 OR (n_h = 0 AND label = 'OW2')) AND s_cat > 0.60 THEN 'over-bonded water' END AS finding FROM o WHERE occ >= 0.98 AND s_cat <= 4)
SELECT structure_id, label, finding FROM f WHERE finding IS NOT NULL""")
def _(spark, sf):
    return X.anion_assignment(spark_sql(spark, sf, OXYGENS))


@query("hydrogen_budget", f"""WITH o AS ({other_sql(OXYGENS)}), s AS (SELECT structure_id, sum(CASE WHEN s_cat >= 0.5 AND s_cat < 1.5 THEN mult * occ ELSE 0 END) AS oh, sum(CASE WHEN s_cat < 0.5 THEN mult * occ ELSE 0 END) AS w FROM o GROUP BY 1)
SELECT structure_id, 2.0::DOUBLE AS z, round(CAST(oh AS DOUBLE) / 2, 2) AS oh, round(CAST(w AS DOUBLE) / 2, 2) AS h2o, round((CAST(oh AS DOUBLE) + 2 * w) / 2, 2) AS h, NULL::DOUBLE AS located FROM s""")
def _(spark, sf):
    o = spark_sql(spark, sf, OXYGENS).withColumn("occ", F.col("occ").cast("double"))
    return X.hydrogen_budget(o, o.select("structure_id", F.lit(2.0).alias("z")).distinct())


@query("hbond_geometry", f"""WITH ce AS ({other_sql(CELLS)}), t AS (SELECT unnest(range(-2, 3)) AS v), o AS (SELECT structure_id, a, c, u, CASE k WHEN 0 THEN u WHEN 1 THEN -u WHEN 2 THEN 0.5 - u ELSE 0.5 + u END + i.v AS x,
   CASE k WHEN 0 THEN u WHEN 1 THEN -u WHEN 2 THEN 0.5 + u ELSE 0.5 - u END + j.v AS y, CASE WHEN k < 2 THEN 0 ELSE 0.5 END + m.v AS z, k = 0 AND i.v = 0 AND j.v = 0 AND m.v = 0 AS donor FROM ce, (SELECT unnest(range(4)) AS k), t i, t j, t m),
 d AS (SELECT structure_id, 0.33 * c AS dh, sqrt(power((x - u) * a, 2) + power((y - u) * a, 2) + power((z - 0.33) * c, 2)) AS ha, sqrt(power((x - u) * a, 2) + power((y - u) * a, 2) + power(z * c, 2)) AS da FROM o WHERE NOT donor),
 g AS (SELECT *, degrees(acos(greatest(least((dh * dh + ha * ha - da * da) / (2 * dh * ha), 1), -1))) AS angle FROM d WHERE ha <= 2.6)
SELECT structure_id, 'O1' AS donor, 'H1' AS hydrogen, 'O1' AS acceptor, round(CAST(dh AS DOUBLE), 5) AS dh, round(ha, 5) AS ha, round(da, 5) AS da, round(angle, 5) AS angle FROM g WHERE angle >= 110""")
def _(spark, sf):
    cells, sites, ops = _structures(spark, sf)
    # a hydrogen beside every oxygen, pointing along c
    h = sites.where("label = 'O1'").withColumn("label", F.lit("H1")).withColumn("element", F.lit("H")).withColumn("ox", F.lit(1)).withColumn("z", F.lit(0.33))
    g = X.hbond_geometry(sites.unionByName(h), ops, cells)
    return g.select("structure_id", "donor", "hydrogen", "acceptor", *[F.round(c, 5).alias(c) for c in ("dh", "ha", "da", "angle")])


@query("distance_esd", f"""WITH {BOND_SQL.replace('bd AS', 'unused AS')}, g AS (SELECT structure_id, a, u, sqrt(2.0) * u * a AS d FROM ce) SELECT structure_id, 'Ti1' AS label, 'O1' AS other, round(d, 6) AS dist,
  round(sqrt(2 * power(sqrt(power((u + 0.001) * a, 2) + power(u * a, 2)) - d, 2) + 2 * power(sqrt(power(u * (a + 0.002), 2) + power(u * a, 2)) - d, 2)), 6) AS esd FROM g""")
def _(spark, sf):
    cells, sites, _ops = _structures(spark, sf)
    bonds = cells.select("structure_id", F.lit("Ti1").alias("label"), F.lit("O1").alias("other"), *[F.lit(0.0).alias(f"t{v}") for v in "xyz"])
    s = sites.withColumn("s_x", F.when(F.col("label") == "O1", 0.001)).withColumn("s_y", F.col("s_x")).withColumn("s_z", F.lit(None).cast("double"))
    for c in X.CELL:
        cells = cells.withColumn(f"s_{c}", F.lit(0.002 if c in "ab" else 0.0))
    d = X.distance_esd(bonds, s, cells)
    return d.select("structure_id", "label", "other", F.round("dist", 6).alias("dist"), F.round("esd", 6).alias("esd"))


TRICLINIC = "SELECT p_partkey AS entry_id, 3 + (p_size % 17) * CAST(0.25 AS DOUBLE) AS a, 3 + (p_partkey % 13) * CAST(0.25 AS DOUBLE) AS b, 3 + (p_partkey % 11) * CAST(0.25 AS DOUBLE) AS c, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 90 + p_partkey % 3 * CAST(5 AS DOUBLE) END AS al, CAST(90 + p_size % 4 * 5 AS DOUBLE) AS be, CAST(CASE WHEN p_partkey % 4 = 0 THEN 120 WHEN p_partkey % 4 = 1 THEN 200 ELSE 90 END AS DOUBLE) AS ga FROM {part}"


@query("cell_volume", f"""WITH c AS ({other_sql(TRICLINIC)}), r AS (SELECT *, cos(radians(CASE WHEN al BETWEEN 30 AND 150 THEN al ELSE 90 END)) AS x, cos(radians(CASE WHEN be BETWEEN 30 AND 150 THEN be ELSE 90 END)) AS y, cos(radians(CASE WHEN ga BETWEEN 30 AND 150 THEN ga ELSE 90 END)) AS z FROM c)
SELECT entry_id, round(a * b * c * sqrt(greatest(1 - x * x - y * y - z * z + 2 * x * y * z, 0)), 6) AS volume FROM r""")
def _(spark, sf):
    return spark_sql(spark, sf, TRICLINIC).select("entry_id", F.round(K.cell_volume(*[F.col(c) for c in X.CELL]), 6).alias("volume"))


@query("d_spacing_two_theta", f"""WITH c AS ({other_sql(TRICLINIC)}), r AS (SELECT *, cos(radians(coalesce(al, 85))) AS x, cos(radians(be)) AS y, cos(radians(CASE WHEN ga > 150 THEN 95 ELSE ga END)) AS z, 1 + entry_id % 3 AS h, entry_id % 5 - 2 AS k, 1 + entry_id % 2 AS l FROM c),
 w AS (SELECT *, 1 - x * x - y * y - z * z + 2 * x * y * z AS v, b * c * (y * z - x) AS s23, a * c * (z * x - y) AS s13, a * b * (x * y - z) AS s12 FROM r),
 g AS (SELECT entry_id, (power(h * b * c, 2) * (1 - x * x) + power(k * a * c, 2) * (1 - y * y) + power(l * a * b, 2) * (1 - z * z) + 2 * k * l * a * a * s23 + 2 * h * l * b * b * s13 + 2 * h * k * c * c * s12) / (power(a * b * c, 2) * v) AS q FROM w)
SELECT entry_id, round(1 / sqrt(q), 6) AS d, round(CASE WHEN 1.5406 * sqrt(q) / 2 <= 1 THEN 2 * degrees(asin(1.5406 * sqrt(q) / 2)) END, 5) AS two_theta FROM g""")
def _(spark, sf):
    # every cell, most of them oblique, each with indices of its own
    rows = spark_sql(spark, sf, TRICLINIC).withColumn("al", F.coalesce("al", F.lit(85.0))).withColumn("ga", F.when(F.col("ga") > 150, 95.0).otherwise(F.col("ga")))
    rows = rows.withColumn("d", K.d_spacing([F.col(c) for c in X.CELL], 1 + F.col("entry_id") % 3, F.col("entry_id") % 5 - 2, 1 + F.col("entry_id") % 2))
    return rows.select("entry_id", F.round("d", 6).alias("d"), F.round(K.two_theta(F.col("d"), F.lit(1.5406)), 5).alias("two_theta"))


@query("allowed_systems", f"""WITH c AS ({other_sql(TRICLINIC)}), t AS (SELECT *, al IS NULL AS mi, abs(al - 90) <= 0.05 AS ra, abs(be - 90) <= 0.05 AS rb, abs(ga - 90) <= 0.05 AS rg, abs(a - b) <= 0.002 * greatest(a, b) AS ab, abs(b - c) <= 0.002 * greatest(b, c) AS bc, abs(a - c) <= 0.002 * greatest(a, c) AS ac FROM c)
SELECT entry_id, concat_ws(',', 'triclinic', CASE WHEN mi OR (ra AND rb) OR (ra AND rg) OR (rb AND rg) THEN 'monoclinic' END, CASE WHEN mi OR (ra AND rb AND rg) THEN 'orthorhombic' END, CASE WHEN (mi OR (ra AND rb AND rg)) AND (ab OR bc OR ac) THEN 'tetragonal' END,
  CASE WHEN mi OR (ab AND ra AND rb AND abs(ga - 120) <= 0.05) OR (ab AND bc AND abs(al - be) <= 0.05 AND abs(be - ga) <= 0.05) THEN 'hexagonal' END, CASE WHEN (mi OR (ra AND rb AND rg)) AND ab AND bc THEN 'cubic' END) AS systems FROM t""")
def _(spark, sf):
    return spark_sql(spark, sf, TRICLINIC).select("entry_id", F.concat_ws(",", K.allowed_systems([F.col(c) for c in X.CELL])).alias("systems"))
