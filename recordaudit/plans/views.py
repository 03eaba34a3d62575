"""Input views derived from the test tables: one SQL text per view, shared by Spark and the SQL oracle.

``{table}`` stands for a base table. Where the two dialects differ, a pair (Spark, other) is given.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

VIEWS: dict[str, str | tuple[str, str]] = {
    "d_findings": """
SELECT CASE WHEN l_linestatus='O' THEN 1 ELSE 2 END AS run_id, l_orderkey AS entry_id,
  concat('chk', CAST(l_linenumber AS STRING)) AS code,
  CASE l_returnflag WHEN 'A' THEN 'flag' WHEN 'N' THEN 'info' ELSE 'note' END AS sev,
  (l_orderkey % 3) <> 0 AS new_template FROM {lineitem}""",
    "d_probe_points": """
SELECT l_orderkey AS sample_id, l_suppkey AS point,
  CASE l_linenumber WHEN 1 THEN 'SiO2' WHEN 2 THEN 'Al2O3' WHEN 3 THEN 'CaO' WHEN 4 THEN 'MgO'
       WHEN 5 THEN 'FeO' WHEN 6 THEN 'F' ELSE 'H2O' END AS constituent, l_quantity AS wt FROM {lineitem}""",
    "d_constituents": """
SELECT formula, element, n_cat, n_o, charge, CAST(mw AS DOUBLE) AS mw, kind FROM (VALUES
 ('SiO2','Si',1,2,4,60.083,'oxide'),('Al2O3','Al',2,3,3,101.961,'oxide'),('CaO','Ca',1,1,2,56.077,'oxide'),
 ('MgO','Mg',1,1,2,40.304,'oxide'),('FeO','Fe',1,1,2,71.844,'oxide'),('F','F',1,0,-1,18.998,'element-anion'),
 ('H2O','H',2,1,1,18.015,'water')) AS t(formula,element,n_cat,n_o,charge,mw,kind)""",
    "d_reflections": """
SELECT CAST(floor(l_orderkey/5) AS BIGINT) AS entry_id,
  CASE WHEN l_linestatus='O' THEN 'obs' ELSE 'calc' END AS source,
  row_number() OVER (PARTITION BY floor(l_orderkey/5), l_linestatus
     ORDER BY l_partkey, l_discount, l_quantity, l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS line_no,
  round(1 + (l_partkey % 40) * 0.1 + abs(l_discount) * 0.02, 4) AS d, l_quantity * 2 AS i FROM {lineitem}""",
    "d_bands": """
SELECT event_id AS band_id, user_id AS paper, event_type AS grp,
  CASE WHEN user_id % 2 = 0 THEN 'raman' ELSE 'ir' END AS technique, value AS pos FROM {events}""",
    # prices in thousandths as whole numbers, so that both engines print the same digits
    "d_printed": """
SELECT entry_id, item, concat(CAST(CAST(floor(t / 1000) AS BIGINT) AS STRING), '.', lpad(CAST(t % 1000 AS STRING), 3, '0'), '(', CAST(1 + pk % 9 AS STRING), ')') AS left_txt,
  CASE WHEN flag = 'A' THEN concat(CAST(CAST(floor(h / 100) AS BIGINT) AS STRING), '.', lpad(CAST(h % 100 AS STRING), 2, '0'))
       WHEN flag = 'N' THEN concat(CAST(CAST(floor(t / 1000) AS BIGINT) AS STRING), '.', lpad(CAST(t % 1000 AS STRING), 3, '0'), '(', CAST(1 + sk % 9 AS STRING), ')')
       ELSE concat(CAST(CAST(floor(u / 1000) AS BIGINT) AS STRING), '.', lpad(CAST(u % 1000 AS STRING), 3, '0'), '(', CAST(1 + pk % 9 AS STRING), ')') END AS right_txt
FROM (SELECT l_orderkey AS entry_id, l_linenumber AS item, l_returnflag AS flag, l_partkey AS pk, l_suppkey AS sk, CAST(floor(l_extendedprice) AS BIGINT) AS t,
        CAST(floor(l_extendedprice / 10 + 0.5) AS BIGINT) AS h, CAST(floor(l_extendedprice) AS BIGINT) + CAST(round(l_discount * 100) AS BIGINT) AS u FROM {lineitem}) q""",
    "d_species": """
SELECT p_partkey AS species_id, lower(p_name) AS norm, p_brand AS group_name, p_size % 10 AS sg,
  3 + (p_size % 17) * 0.25 AS a, 3 + (p_partkey % 13) * 0.25 AS b, 3 + (p_partkey % 11) * 0.25 AS c, p_type AS kind FROM {part}""",
    "d_groups": """
SELECT concat('r',CAST(r_regionkey AS STRING)) AS gid, CAST(NULL AS STRING) AS parent, r_name AS name FROM {region}
 UNION ALL SELECT concat('n',CAST(n_nationkey AS STRING)), concat('r',CAST(n_regionkey AS STRING)), n_name FROM {nation}
 UNION ALL SELECT concat('s',CAST(s_suppkey AS STRING)), concat('n',CAST(s_nationkey AS STRING)), s_name FROM {supplier}""",
    "d_spectra": (
        """
SELECT vec_id AS spectrum_id, label AS grp, p AS idx, CAST(100 + 2 * p AS DOUBLE) AS x, CAST(e AS DOUBLE) AS y
FROM {embeddings} LATERAL VIEW posexplode(embedding) q AS p, e""",
        """
SELECT vec_id AS spectrum_id, label AS grp, p - 1 AS idx, CAST(98 + 2 * p AS DOUBLE) AS x, CAST(embedding[p] AS DOUBLE) AS y
FROM (SELECT *, unnest(range(1, len(embedding)+1)) AS p FROM {embeddings})""",
    ),
}

_TABLE = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a text with ``{table}`` placeholders over the parquet tables."""
    tables = {name: load(spark, sf_dir, name) for name in set(_TABLE.findall(text))}
    return spark.sql(text, **tables)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt anew by a hash of the whole row, before texts are parsed: a table of one row group is read by one task."""
    return df.repartition(F.xxhash64(*df.columns))


def spread_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """`spark_sql` with the rows of its tables dealt anew before texts are formed of them: rows are smaller than texts."""
    tables = {name: load(spark, sf_dir, name) for name in set(_TABLE.findall(text))}
    dealt = {name: spread(df.select([c for c in df.columns if re.search(rf"\b{c}\b", text)])) for name, df in tables.items()}
    return spark.sql(text, **dealt)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark_sql(spark, sf_dir, text if isinstance(text, str) else text[0])


def other_sql(text: str) -> str:
    return _TABLE.sub(r"\1", text)


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``WITH <views> <body>`` for the SQL oracle; `body` may start with further ``, name AS (...)``."""
    parts = []
    for name in names.split():
        text = VIEWS[name]
        parts.append(f"{name} AS ({other_sql(text if isinstance(text, str) else text[1])})")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
