"""Readers: each is a plain Spark read followed by column expressions, so files are parsed where they are stored.

The ``parse_*`` functions take the rows of such a read and can be used on text that is already in a table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordaudit.functions.elements import ATOMIC_WEIGHTS

# --- probe analyses -----------------------------------------------------------------------------

# What may stand behind a constituent's name in the heading of a column of weights. A heading with anything else behind it is
# another quantity, a whole formula or a word.
WEIGHT_WORDS = {"wt", "weight", "mass", "percent", "pct", "oxide", "oxides", "elem", "element"}
OXIDE_WORDS = WEIGHT_WORDS | {"t", "tot", "total", "calc", "calculated", "meas", "measured"}
_STATISTIC = r"(?i)^\s*(?:average|avg|mean|median|std\.?\s*dev\.?|stdev|s\.d\.|sd|sigma|σ|min(?:imum)?|max(?:imum)?|range|detection limits?)\b"


def _longest_constituent(text: str) -> str:
    """The longest beginning of `text` that is an element, or an element with its oxygens: ``FeOt`` starts with FeO, ``CORE`` with CO."""
    best, end = "", 0
    for symbol in (text[:2], text[:1]):
        if symbol in ATOMIC_WEIGHTS:
            end = len(symbol)
            while text[end:end + 1].isdigit():
                end += 1
            best = symbol
            if text[end:end + 1] == "O" and symbol != "O":
                end += 1
                while text[end:end + 1].isdigit():
                    end += 1
                best = text[:end]
            break
    return best


def constituent_label(heading: str) -> str | None:
    """The constituent whose weights a heading names: ``CaO (2) Oxide%`` is CaO, ``FeOt`` is FeO; all other headings name none.

    The longest name is taken, so that an oxide never counts as its element. What follows may only be a number, a bracket, or a
    word for weights: other quantities (``Si cps``), words (``CORE``), formulas and adsorbed water (``H2O-``) are none.
    """
    text = heading.strip().replace("(NH4)2O", "N2H8O")
    name = "N2H8O" if text.startswith("N2H8O") else _longest_constituent(text)
    oxide = name.endswith("O") or "O" in name[1:]
    if not name or name in ("O", "H", "C", "N"):
        return None
    rest = text[len(name):]
    if name == "H2O":
        rest = rest.lstrip()
        if rest[:1] in ("-", "−", "–"):
            return None
        rest = rest.removeprefix("+")
    if re.match(r"\d|\(?[A-Z][a-z]?\d|\([A-Z]", rest) or rest.lstrip()[:1] in ("=", "≡"):
        return None
    words = re.findall(r"[^\W\d_]+(?:[.\-–][^\W\d_]+)*", rest)
    known = OXIDE_WORDS if oxide else WEIGHT_WORDS
    if rest[:1].isalpha() and rest[:1].isupper() and words[0].lower() not in WEIGHT_WORDS:
        return None
    return name if all(w.lower() in known for w in words) and not re.search(r"[+/±σ]", rest) else None


def read_probe_long(spark: SparkSession, path: str, sample: str = "sample", point: str = "point", **options: str) -> DataFrame:
    """``sample_id, point, constituent, wt`` of delimited analyses with one column per constituent.

    Columns that name no constituent are dropped, rows that are statistics of the others too; a blank, ``n.d.`` or any
    other word is a null. Only the header is looked at on the driver.
    """
    table = spark.read.csv(path, header=True, inferSchema=False, **options)
    wanted = {c: constituent_label(c) for c in table.columns if c not in (sample, point)}
    kept = {c: name for c, name in wanted.items() if name}
    rows = table.where(~F.coalesce(F.col(point), F.lit("")).rlike(_STATISTIC))
    long = rows.select(F.col(sample).alias("sample_id"), F.col(point).alias("point"), *[F.col(f"`{c}`").alias(name) for c, name in kept.items()])
    return long.unpivot(["sample_id", "point"], list(kept.values()), "constituent", "raw").select(
        "sample_id", "point", "constituent", F.expr(r"try_cast(regexp_replace(trim(raw), ',', '.') AS double)").alias("wt")
    )


# --- peak lists -----------------------------------------------------------------------------------


def parse_peak_list(lines: DataFrame) -> DataFrame:
    """``file, line_no, d, i, hkl`` of lines (file, line_no, value) of headed lists.

    The heading of each file names the columns (d, I, hkl in any order); ``(-1 1 3)`` becomes array<int>. Lines before
    the heading, and lines without d and I, are left out.
    """
    whole = F.regexp_replace(F.trim("value"), r"\(\s*(-?\d+)\s+(-?\d+)\s+(-?\d+)\s*\)", "($1_$2_$3)")
    cells = F.split(F.regexp_replace(whole, r"\(\s*h\s+k\s+l\s*\)|h\s+k\s+l", "hkl"), r"[\t;]|,\s*|\s+")
    rows = lines.where(F.trim("value") != "").withColumn("cells", cells)
    low = F.transform("cells", lambda c: F.lower(c))
    is_d, is_i = lambda c: c.rlike(r"^d\s*\(|^d$|^d-?spac|^dobs|^dcalc"), lambda c: c.rlike(r"^(?:i%|int|i\(|iobs|icalc)|^i$")
    rows = rows.withColumn("head", F.exists(low, is_d) & F.exists(low, is_i))
    spots = F.struct(
        "line_no",
        F.array_min(F.filter(F.sequence(F.lit(0), F.size(low) - 1), lambda k: is_d(F.get(low, k)))).alias("d"),
        F.array_min(F.filter(F.sequence(F.lit(0), F.size(low) - 1), lambda k: is_i(F.get(low, k)))).alias("i"),
    )
    heads = rows.where("head").groupBy("file").agg(F.min(spots).alias("s"))
    body = rows.join(heads, "file").where("NOT head AND line_no > s.line_no")
    number = lambda c: F.expr(f"try_cast(replace(get(cells, {c}), ',', '.') AS double)")
    triple = F.regexp_extract_all(F.regexp_extract("value", r"\(\s*(-?\d+\s+-?\d+\s+-?\d+)\s*\)", 1), F.lit(r"(-?\d+)"), F.lit(1))
    hkl = F.when(F.size(triple) == 3, F.transform(triple, lambda v: v.cast("int")))
    return body.select("file", "line_no", number("s.d").alias("d"), number("s.i").alias("i"), hkl.alias("hkl")).where("d IS NOT NULL AND i IS NOT NULL")


def read_peak_list(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("whole"))
    lines = texts.select("file", F.posexplode(F.split("whole", r"\r?\n")).alias("line_no", "value"))
    return parse_peak_list(lines)


# --- spectra --------------------------------------------------------------------------------------


def plain_chem(text: Column) -> Column:
    """``Pb_2_S_7_`` and ``Fe^2+^`` as Pb2S7 and Fe2+; ``[box]`` as □."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("[box]"), F.lit("□"))
    return F.regexp_replace(F.regexp_replace(out, r"_([\d.\-+x]+)_", "$1"), r"\^([^^]*)\^", "$1")


def parse_xy(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header and points of spectrum files (file, text): ``##KEY=value`` lines, then ``x, y`` lines.

    Returns ``spectrum_meta`` (file, name, sample_id, kind, laser, chemistry) and ``spectra`` (file, x array, y array) with x
    ascending and no missing value.
    """
    lines = F.split("text", r"\r?\n")
    heads = F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: s.startswith("##"))
    pairs = F.transform(heads, lambda s: F.struct(F.upper(F.trim(F.regexp_extract(s, r"^##([^=]*)", 1))).alias("k"), F.trim(F.regexp_extract(s, r"^##[^=]*=(.*)$", 1)).alias("v")))
    # the last value of a repeated key holds
    keyed = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    base = members.select("file", "text", keyed.alias("h"))
    get = lambda key: F.coalesce(F.try_element_at("h", F.lit(key)), F.lit(""))
    laser = F.regexp_replace(F.regexp_replace(F.when(get("RAMAN WAVELENGTH") != "", get("RAMAN WAVELENGTH")).otherwise(get("LASER_WAVELENGTH")), r"\s*nm$", ""), r"\.0$", "")
    meta = base.select(
        "file", F.trim(F.translate(get("NAMES"), "_", " ")).alias("name"), get("RRUFFID").alias("sample_id"),
        F.when(F.contains(F.lower(get("FILETYPE")), F.lit("raw")), "raw").otherwise("processed").alias("kind"),
        F.when(laser.rlike(r"^\d+(?:\.\d+)?$"), laser).otherwise("").alias("laser"), plain_chem(get("IDEAL CHEMISTRY")).alias("chemistry"),
    )
    parsed = F.expr(r"""array_sort(filter(transform(filter(split(text, '\r?\n'), s -> NOT startswith(trim(s), '##') AND contains(s, ',')),
        s -> named_struct('x', try_cast(trim(substring_index(s, ',', 1)) AS double), 'y', try_cast(trim(split(s, ',')[1]) AS double))),
        p -> p.x IS NOT NULL AND p.y IS NOT NULL AND NOT isnan(p.x) AND NOT isnan(p.y) AND abs(p.x) < double('infinity') AND abs(p.y) < double('infinity')))""")
    spectra = base.select("file", parsed.alias("p")).select("file", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return meta, spectra


def read_xy(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    return parse_xy(spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text")))


# --- alert reports --------------------------------------------------------------------------------


def parse_alerts(reports: DataFrame) -> DataFrame:
    """``report_id, code, type, level, desc, val`` of report texts (report_id, text); each alert once.

    An alert is a line with a word ``CODE_ALERT_type_level`` and a text behind it. Lines of one code and one whole text are one
    alert, as often as a report prints it; the value is the last number of the text.
    """
    lines = reports.select("report_id", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line")).where(F.contains(F.col("line"), F.lit("_ALERT_")))
    head, tail = F.split_part("line", F.lit("_ALERT_"), F.lit(1)), F.split_part("line", F.lit("_ALERT_"), F.lit(2))
    code = F.element_at(F.split(head, r"[^A-Z0-9]"), -1)
    marks = F.split(F.regexp_replace(tail, r"^(\w)_(\w)[ .]*", "$1\u0001$2\u0001"), "\u0001")
    rows = lines.select("report_id", "no", code.alias("code"), F.get(marks, F.lit(0)).try_cast("int").alias("type"), F.get(marks, F.lit(1)).alias("level"), F.trim(F.get(marks, F.lit(2))).alias("desc"))
    rows = rows.where("code <> '' AND type IS NOT NULL AND level IN ('A', 'B', 'C', 'G')")
    first = rows.groupBy("report_id", "code", "desc").agg(F.min_by(F.struct("type", "level"), "no").alias("a"))
    # the last token that is a number, without what encloses it; a lone digit counts things and is no value
    tokens = F.transform(F.split("desc", r"[\s=:;,()\[\]]+"), lambda t: F.regexp_replace(t, r"^[^\d+\-]+|[^\d]+$", ""))
    numbers = F.filter(tokens, lambda t: t.try_cast("double").isNotNull() & (F.length(F.translate(t, "+-", "")) > 1))
    return first.select("report_id", "code", "a.type", "a.level", "desc", F.try_element_at(numbers, F.lit(-1)).alias("val"))


def read_alert_reports(spark: SparkSession, glob: str) -> DataFrame:
    return parse_alerts(spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("report_id"), F.col("value").alias("text")))


# --- dimension files ------------------------------------------------------------------------------


def read_dimension_json(spark: SparkSession, path: str, value_schema: str, key: str = "key", under: str | None = None) -> DataFrame:
    """Rows of a JSON object of objects: one per key, the inner fields as columns; keys that start with ``_`` are notes.

    `value_schema` is the DDL of the inner object; `under` names the member that holds the map.
    """
    raw = spark.read.text(path, wholetext=True)
    # notes hold text, so the map is read leniently: values as strings first, those that are objects next
    whole = F.from_json("value", f"{under} MAP<STRING,STRING>" if under else "MAP<STRING,STRING>")
    items = F.map_entries(whole[under] if under else whole)
    rows = raw.select(F.explode(items).alias("e")).where(~F.col("e.key").startswith("_"))
    return rows.select(F.col("e.key").alias(key), F.from_json("e.value", value_schema).alias("v")).where("v IS NOT NULL").select(key, "v.*")


# --- pairing files with records --------------------------------------------------------------------

_ID = r"(?<![A-Za-z0-9])([IOio])(\d{5,6})(?!\d)"


def file_ids(name: Column) -> Column:
    """Every record id a file name carries; an adjacent ``A-B`` expands to all ids between."""
    singles = F.zip_with(F.regexp_extract_all(name, F.lit(_ID), F.lit(1)), F.regexp_extract_all(name, F.lit(_ID), F.lit(2)), lambda p, n: F.concat(F.upper(p), n))
    rng = _ID + r"\s*-\s*" + _ID
    parts = [F.regexp_extract_all(name, F.lit(rng), F.lit(k)) for k in (1, 2, 4)]
    spans = F.arrays_zip(parts[0].alias("p"), parts[1].alias("a"), parts[2].alias("b"))
    wide = F.flatten(F.transform(spans, lambda s: F.when(
        s["b"].cast("int") >= s["a"].cast("int"),
        F.transform(F.sequence(s["a"].cast("int"), s["b"].cast("int")), lambda n: F.concat(F.upper(s["p"]), F.lpad(n.cast("string"), F.length(s["a"]), F.lit("0")))),
    ).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(singles, wide))


def pair_sources(files: DataFrame) -> DataFrame:
    """``entry_id, record, article, structure``: one file of each kind per record id.

    `files`: path, and human_marks (changes by people in a record file; 0 elsewhere). The kind is read from the ending. Among
    records: most human marks, then a copy not ``_edited``, then the path; an article beats a supplement, then the shorter
    name; an id with supplements only has no article. The choices are aggregates, so a busy id is never sorted in one task.
    """
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    kind = F.when(ending.isin("docx", "json"), "record").when(ending == "pdf", "article").when(ending == "cif", "structure")
    rows = files.withColumn("name", name).withColumn("kind", kind).where("kind IS NOT NULL AND NOT startswith(name, '~$')")
    rows = rows.withColumn("entry_id", F.explode(file_ids(F.col("name")))).withColumn("supplement", F.lower("name").rlike(r"supp|_si\b|esm|appendix"))
    marks = F.coalesce(F.col("human_marks"), F.lit(0))
    record = F.struct((-marks).alias("m"), F.contains("name", F.lit("_edited")).alias("e"), F.col("path"))
    other = F.struct("supplement", F.length("name").alias("n"), F.col("path"))

    def chosen(k: str, order: Column, test: Column | None = None) -> Column:
        keep = F.col("kind") == k if test is None else (F.col("kind") == k) & test
        return F.min_by("path", F.when(keep, order)).alias(k)

    return rows.groupBy("entry_id").agg(chosen("record", record), chosen("article", other, ~F.col("supplement")), chosen("structure", other))


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """Paths and times under a glob, without reading the files."""
    return spark.read.format("binaryFile").load(glob).select("path", "modificationTime", "length")


# --- sweep snapshots and sinks ----------------------------------------------------------------------


def write_snapshot(entries: DataFrame, findings: DataFrame, path: str, run_id: int, keep: bool = True) -> None:
    """Store a run: entries and findings under their run id. With `keep`, a run that is there already is left alone."""
    mode = "error" if keep else "overwrite"
    for name, df in (("entries", entries), ("findings", findings)):
        target = f"{path.rstrip('/')}/{name}/run_id={run_id}"
        df.drop("run_id").write.mode(mode).parquet(target)


def read_snapshot(spark: SparkSession, path: str, run_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, findings) of one run — the partition is pruned — or of all."""
    out = [spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("entries", "findings")]
    return tuple(df if run_id is None else df.where(F.col("run_id") == run_id) for df in out)


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """One row per finding, in parquet, json or csv."""
    findings.write.mode(mode).format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def write_report_tables(findings: DataFrame, path: str, mode: str = "error") -> None:
    """The fire table and the findings themselves, each as a folder under `path`."""
    from recordaudit.operators.audit import fire_table

    fire_table(findings).orderBy(F.desc("total"), "code").coalesce(1).write.mode(mode).option("header", "true").csv(f"{path.rstrip('/')}/fire_table")
    write_findings(findings, f"{path.rstrip('/')}/findings", mode=mode)
