"""Corpus audit: fire counts, snapshot comparison, triage, rule precision and recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordaudit.functions.measured import let
from recordaudit.session import cut_lineage

# --- counts over findings --------------------------------------------------------------------


def fire_table(findings: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    """How often each rule fires: in all, on new and old templates, and as a flag."""
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("new_template")).alias("new_tpl"),
        F.count_if(~F.col("new_template")).alias("old_tpl"),
        F.count_if(F.col("sev") == "flag").alias("flags"),
    )


def verdict_distribution(entries: DataFrame, column: str) -> DataFrame:
    """Counts of a verdict column, blanks left out."""
    return (
        entries.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("verdict"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def snapshot_meta(entries: DataFrame) -> DataFrame:
    """One row per run: entries, new templates, paired sources, failures."""
    return entries.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_if(F.col("new_template")).alias("n_new_template"),
        F.count_if(F.col("article").isNotNull()).alias("n_article"),
        F.count_if(F.col("structure").isNotNull()).alias("n_structure"),
        F.count_if(F.col("error").isNotNull()).alias("n_crash"),
    )


# --- comparing two runs ----------------------------------------------------------------------


def code_deltas(old: DataFrame, new: DataFrame, key: str = "code") -> DataFrame:
    """Codes whose fire count changed. One aggregation over the union, so both sides combine map-side."""
    both = old.select(key, F.lit(1).alias("before"), F.lit(0).alias("after")).unionByName(
        new.select(key, F.lit(0).alias("before"), F.lit(1).alias("after"))
    )
    return (
        both.groupBy(key)
        .agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
        .where("before <> after")
        .withColumn("delta", F.col("after") - F.col("before"))
    )


def entry_membership(old: DataFrame, new: DataFrame, key: str = "entry_id") -> DataFrame:
    """Entries only one of the runs has, as ``added`` or ``removed``."""
    both = old.select(key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(
        new.select(key, F.lit(0).alias("o"), F.lit(1).alias("n"))
    )
    return (
        both.groupBy(key)
        .agg(F.max("o").alias("o"), F.max("n").alias("n"))
        .where("o <> n")
        .select(key, F.when(F.col("n") == 1, "added").otherwise("removed").alias("change"))
    )


def token_changes(old: DataFrame, new: DataFrame, entry: str = "entry_id", token: str = "token") -> DataFrame:
    """Multiset difference of finding tokens for the entries both runs have.

    ``gained`` and ``lost`` count the copies; applied to `old` they give `new`. The entries' own
    membership comes from the same per-token counts, so a busy entry is never gathered whole.
    """
    counted = (
        old.select(entry, token, F.lit(1).alias("o"), F.lit(0).alias("n"))
        .unionByName(new.select(entry, token, F.lit(0).alias("o"), F.lit(1).alias("n")))
        .groupBy(entry, token)
        .agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    )
    common = (
        counted.groupBy(entry)
        .agg((F.max("o") > 0).alias("in_old"), (F.max("n") > 0).alias("in_new"))
        .where("in_old AND in_new")
        .select(entry)
    )
    return (
        counted.where("o <> n")
        .join(common, entry, "left_semi")
        .select(
            entry,
            token,
            F.greatest(F.col("n") - F.col("o"), F.lit(0)).alias("gained"),
            F.greatest(F.col("o") - F.col("n"), F.lit(0)).alias("lost"),
        )
    )


def crash_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries that began or ceased to fail."""
    both = old.select("entry_id", F.col("error").isNotNull().alias("o"), F.lit(False).alias("n")).unionByName(
        new.select("entry_id", F.lit(False).alias("o"), F.col("error").isNotNull().alias("n"))
    )
    return (
        both.groupBy("entry_id")
        .agg(F.bool_or("o").alias("o"), F.bool_or("n").alias("n"))
        .where("o <> n")
        .select("entry_id", F.when(F.col("n"), "new").otherwise("resolved").alias("crash"))
    )


def run_diff(old: DataFrame, new: DataFrame, key: str, tokens: Sequence[str]) -> DataFrame:
    """Keys whose set of counted tokens changed, or that only one run has."""
    counted = (
        old.select(key, *tokens, F.lit(1).alias("o"), F.lit(0).alias("n"))
        .unionByName(new.select(key, *tokens, F.lit(0).alias("o"), F.lit(1).alias("n")))
        .groupBy(key, *tokens)
        .agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    )
    summed = counted.groupBy(key).agg(
        F.sum("o").alias("n_old"), F.sum("n").alias("n_new"), F.count_if(F.col("o") != F.col("n")).alias("n_tokens")
    )
    return summed.where("n_tokens > 0").select(
        key,
        F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "gone").otherwise("changed").alias("change"),
        "n_old",
        "n_new",
    )


def status_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, old status, new status) counts over the documents of both runs; an absent field reads ``none``."""
    both = old.select("doc_id", "field", F.col("status").alias("was"), F.lit(None).cast("string").alias("now")).unionByName(
        new.select("doc_id", "field", F.lit(None).cast("string").alias("was"), F.col("status").alias("now"))
    )
    per_field = both.groupBy("doc_id", "field").agg(F.max("was").alias("was"), F.max("now").alias("now"))
    shared = (
        per_field.groupBy("doc_id")
        .agg(F.count("was").alias("a"), F.count("now").alias("b"))
        .where("a > 0 AND b > 0")
    )
    moved = (
        per_field.join(shared, "doc_id", "left_semi")
        .select(
            "doc_id",
            "field",
            F.coalesce("was", F.lit("none")).alias("old_status"),
            F.coalesce("now", F.lit("none")).alias("new_status"),
        )
        .where("old_status <> new_status")
    )
    return moved.groupBy("field", "old_status", "new_status").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("example")
    )


# --- keys, triage, incremental runs ----------------------------------------------------------


def finding_key(code: Column, anchor: Column, message: Column) -> Column:
    """Key that depends on the content only: the whole digest of code, anchor and whole message."""
    text = F.concat_ws("|", code, F.coalesce(anchor, F.lit("")), F.coalesce(message, F.lit("")))
    return F.concat(F.lit("f:"), F.sha1(text))


def number_keys(findings: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``finding_key``; the second and later copies of a finding in an entry get ``#2``, ``#3``."""
    keyed = findings.withColumn("base_key", finding_key(F.col("code"), F.col("anchor"), F.col("msg")))
    copy = F.row_number().over(Window.partitionBy("entry_id", "base_key").orderBy(*order))
    return (
        keyed.withColumn("copy_no", copy)
        .withColumn(
            "finding_key",
            F.when(F.col("copy_no") == 1, F.col("base_key")).otherwise(F.concat_ws("#", "base_key", "copy_no")),
        )
        .drop("base_key", "copy_no")
    )


def merge_triage(records: DataFrame) -> DataFrame:
    """One verdict per finding from all copies of a record.

    The current copy is authoritative for what it recorded, a cleared verdict included; for findings
    it never recorded the strongest verdict of the other copies holds (confirm over dismiss). Labels
    and notes come from the current copy, then from the first other copy that has one.
    """
    rank = F.when(F.col("verdict") == "confirm", 2).when(F.col("verdict") == "dismiss", 1).otherwise(0)
    ranked = records.withColumn("rank", rank).withColumn("turn", F.struct((~F.col("is_current")).alias("x"), F.col("copy")))

    def first_said(column: str) -> Column:
        return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("turn")))

    merged = ranked.groupBy("entry_id", "finding_key").agg(
        F.bool_or("is_current").alias("said"),
        F.max(F.when(F.col("is_current"), F.col("rank"))).alias("own_rank"),
        F.max("rank").alias("top_rank"),
        first_said("note").alias("note"),
        first_said("label").alias("label"),
    )
    final = F.when(F.col("said"), F.col("own_rank")).otherwise(F.col("top_rank"))
    return merged.select(
        "entry_id",
        "finding_key",
        F.when(final == 2, "confirm").when(final == 1, "dismiss").alias("verdict"),
        "note",
        "label",
    )


def apply_triage(findings: DataFrame, triage: DataFrame) -> DataFrame:
    """Findings without the dismissed ones; a confirmed finding's note is put after its message."""
    dismissed = triage.where("verdict = 'dismiss'").select("entry_id", "finding_key")
    notes = (
        triage.where("verdict = 'confirm' AND note IS NOT NULL AND note <> ''")
        .groupBy("entry_id", "finding_key")
        .agg(F.min("note").alias("reviewer_note"))
    )
    return (
        findings.join(dismissed, ["entry_id", "finding_key"], "left_anti")
        .join(notes, ["entry_id", "finding_key"], "left")
        .withColumn(
            "msg",
            F.when(
                F.col("reviewer_note").isNotNull(), F.concat(F.col("msg"), F.lit("  · reviewer: "), F.col("reviewer_note"))
            ).otherwise(F.col("msg")),
        )
        .drop("reviewer_note")
    )


def stale_entries(entries: DataFrame, cache: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Entries to compute again: no cached result under this key and fingerprint."""
    usable = cache if not retry_failed else cache.where(~F.col("unreadable"))
    return entries.join(usable.select("entry_id", "fp"), ["entry_id", "fp"], "left_anti")


def incremental_refresh(entries: DataFrame, cache: DataFrame, recompute, retry_failed: bool = False) -> DataFrame:
    """The full result: cached rows whose fingerprint still holds, and fresh rows for the rest."""
    stale = stale_entries(entries, cache, retry_failed)
    kept = cache.join(entries.select("entry_id", "fp"), ["entry_id", "fp"], "left_semi").join(
        stale.select("entry_id"), "entry_id", "left_anti"
    )
    return kept.unionByName(recompute(stale).select(*kept.columns))


def union_by_precedence(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows of `first`, and the rows of `second` whose key `first` lacks."""
    return first.unionByName(second.join(first.select(*key).distinct(), list(key), "left_anti"))


# --- precision by what reviewers changed ------------------------------------------------------

def hints(message: Column) -> Column:
    """Values a message offers: an array of hints, each an array of the tokens a cell would carry.

    Offered are quoted values, the value a message says a field should be, the values it sets (``Name = value``), together, and
    each of the decimals it lists after ``of`` or a colon.
    """
    quoted = F.regexp_extract_all(message, F.lit(r"'([^']+)'"), F.lit(1))
    bare = F.regexp_replace(message, r"'[^']*'", "'")
    wanted = F.regexp_extract_all(bare, F.lit(r"should be ([^'\s][^,;']*?)(?:[,;.]?$|[,;]|\. )"), F.lit(1))
    assigned = F.transform(F.regexp_extract_all(bare, F.lit(r"\w+ = ([^,;=]+?)(?=[,;]|\.$|\. |$)"), F.lit(1)), lambda t: F.trim(t))
    listed = F.regexp_extract_all(bare, F.lit(r"(?:\bof|:) ((?:\d+\.\d+(?:\(\d+\))?(?:, | and |, and )?)+)"), F.lit(1))
    numbers = F.flatten(F.transform(listed, lambda v: F.regexp_extract_all(v, F.lit(r"\d+\.\d+(?:\(\d+\))?"), F.lit(0))))
    words = F.transform(F.concat(quoted, wanted), lambda v: F.filter(F.transform(F.split(v, ","), lambda t: F.trim(t)), lambda t: t != ""))
    return F.concat(words, F.when(F.size(assigned) > 0, F.array(assigned)).otherwise(F.array().cast("array<array<string>>")), F.transform(numbers, lambda n: F.array(n)))


def squeeze(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s  ]+", ""))


def oracle_score(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """Per rule: flags, resolved, persisting, hinted, confirmed, otherwise resolved, left.

    `before` carries ``doc_id, content, code, sev, msg``; documents of equal content count once. A hint
    is confirmed when every token of it turns up in a changed cell that did not hold it before.
    """
    first_doc = before.groupBy("content").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    # one row per flag before and per finding after; dealt by document once, all that follows stays there
    marks = before.where("sev = 'flag'").select("doc_id", "code", "msg", F.lit(1).alias("n")).unionByName(after.select("doc_id", "code", "msg", F.lit(0).alias("n")))
    flags = (
        marks.join(first_doc, "doc_id", "left_semi")
        .groupBy("doc_id", "code", "msg")
        .agg(F.sum("n").alias("copies"), (F.min("n") == 1).alias("gone"))
        .where("copies > 0")
    )
    flags = cut_lineage(flags.withColumn("hints", hints(F.col("msg"))))  # the hints are looked up, and the flags counted
    tokens = (
        flags.select("doc_id", "code", "msg", F.posexplode("hints").alias("hint_no", "words"))
        .select("doc_id", "code", "msg", "hint_no", F.explode("words").alias("word"))
        .withColumn("word", squeeze(F.col("word")))
    )
    cells = (
        changes.where("label <> 'Accept'")
        .select("doc_id", squeeze(F.col("before")).alias("was"), squeeze(F.col("after")).alias("became"))
        .repartition("doc_id")
        .distinct()
    )
    # a semi join: a token stops at its first matching cell and no token × cell pair leaves the task
    wanted = tokens.select("doc_id", "word").repartition("doc_id").distinct().alias("t")
    hit = wanted.join(
        cells.alias("c"),
        (F.col("t.doc_id") == F.col("c.doc_id"))
        & (F.col("t.word") != "")
        & F.expr("contains(c.became, t.word)")
        & ~F.expr("contains(c.was, t.word)"),
        "left_semi",
    ).withColumn("hit", F.lit(True))
    judged = (
        tokens.join(hit, ["doc_id", "word"], "left")
        .groupBy("doc_id", "code", "msg", "hint_no")
        .agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("whole"))
        .groupBy("doc_id", "code", "msg")
        .agg(F.bool_or("whole").alias("confirmed"))
        .withColumn("hinted", F.lit(True))
    )
    rows = flags.join(judged, ["doc_id", "code", "msg"], "left").select(
        "code", "copies", "gone", F.coalesce("hinted", F.lit(False)).alias("hinted"),
        F.coalesce("confirmed", F.lit(False)).alias("confirmed"),
    )

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("copies"))), F.lit(0)).cast("bigint").alias(name)

    gone, hinted, confirmed = F.col("gone"), F.col("hinted"), F.col("confirmed")
    return rows.groupBy("code").agg(
        F.sum("copies").alias("flags"),
        total(gone, "resolved"),
        total(~gone, "persists"),
        total(hinted, "hinted"),
        total(hinted & confirmed, "confirmed"),
        total(hinted & ~confirmed & gone, "other"),
        total(hinted & ~confirmed & ~gone, "left_alone"),
    )


# --- recall by seeded faults ------------------------------------------------------------------


def swap_digits(text: Column) -> Column:
    """3.843 -> 3.834: the last two decimals that differ change places; null when none do."""
    pattern = r"^(\d+\.\d*?)(\d)((?!\2)\d)(\3*)$"
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1$3$2$4"))


def pick_per_key(rows: DataFrame, key: str, best: Sequence[Column]) -> DataFrame:
    """Adds ``picked``: true on the row of each key with the largest `best` tuple.

    The choice is an aggregate (combined map-side) joined back, so no key is sorted in one task.
    """
    top = rows.groupBy(key).agg(F.max(F.struct(*[c.alias(f"k{n}") for n, c in enumerate(best)])).alias("top"))
    tuple_of = F.struct(*[c.alias(f"k{n}") for n, c in enumerate(best)])
    return rows.join(top, key).withColumn("picked", tuple_of == F.col("top")).drop("top")


def seed_reflections(lines: DataFrame, kind: str) -> DataFrame:
    """Reflection lists with one slip each in the strongest line.

    ``swap`` changes two digits of d, ``drop`` removes every row of that d, ``slip`` types 10 for an
    intensity of 90 or more on every row of that d, ``scale`` moves d by two per cent.
    """
    picked = pick_per_key(lines, "entry_id", [F.col("i"), -F.col("line_no")])
    target = picked.where("picked").select("entry_id", F.col("d_txt").alias("hit_d"), F.col("i").alias("hit_i"))
    rows = picked.join(target, "entry_id")
    same_d = F.col("d_txt") == F.col("hit_d")
    if kind == "swap":
        swapped = F.coalesce(swap_digits(F.col("d_txt")), F.col("d_txt"))
        rows = rows.withColumn("d_txt", F.when(F.col("picked"), swapped).otherwise(F.col("d_txt")))
    elif kind == "drop":
        rows = rows.where(~same_d)
    elif kind == "slip":
        rows = rows.withColumn("i", F.when(same_d & (F.col("hit_i") >= 90), F.lit(10.0)).otherwise(F.col("i")))
    elif kind == "scale":
        moved = F.format_string("%.4f", F.round(F.col("d_txt").cast("double") * 1.02, 4))
        rows = rows.withColumn("d_txt", F.when(F.col("picked"), moved).otherwise(F.col("d_txt")))
    else:
        raise ValueError(f"unknown fault {kind!r}")
    return rows.drop("picked", "hit_d", "hit_i")


def seed_weight(means: DataFrame, fraction: float) -> DataFrame:
    """The largest constituent of each sample scaled by ``1 + fraction`` (rounded to four places)."""
    picked = pick_per_key(means, "sample_id", [F.col("wt"), F.col("constituent")])
    return picked.withColumn(
        "wt", F.when(F.col("picked"), F.round(F.col("wt") * (1 + fraction), 4)).otherwise(F.col("wt"))
    ).drop("picked")


def seed_basis(bases: DataFrame, kind: str) -> DataFrame:
    """The stated basis moved to a neighbour; a basis that would not be positive is left out."""
    moved = {"+1": F.col("n") + 1, "-1": F.col("n") - 1, "x2": F.col("n") * 2}[kind]
    return bases.withColumn("n", moved).where("n > 0")


def blank_field(entries: DataFrame, field: str) -> DataFrame:
    return entries.withColumn(field, F.lit(None).cast(entries.schema[field].dataType))


OUTCOMES = ("CAUGHT", "VAGUE", "NOTED", "MISSED", "ERROR")


def recall_table(runs: DataFrame, keys: Sequence[str] = ("kind",)) -> DataFrame:
    """Share (per cent) of each outcome by kind of fault, and the number of seeds."""
    wide = runs.groupBy(*keys).pivot("outcome", list(OUTCOMES)).count().na.fill(0, list(OUTCOMES))
    total = sum((F.col(o) for o in OUTCOMES[1:]), F.col(OUTCOMES[0]))
    return wide.select(
        *keys,
        total.cast("bigint").alias("n"),
        *[F.round(F.col(o) * 100.0 / total, 4).alias(f"{o.lower()}_pct") for o in OUTCOMES],
    )


def printed_stratum(share: Column) -> Column:
    """Nine tenths of the list in the paper's text decide what a check by d can see."""
    return F.when(share >= 0.9, "printed").otherwise("not printed")


def top_codes(runs: DataFrame, n: int = 6) -> DataFrame:
    """The codes that spoke most for each kind of fault."""
    counted = runs.groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "code"))
    return counted.withColumn("place", place).where(F.col("place") <= n)


def detection_curve(rows: DataFrame) -> DataFrame:
    """Outcomes by fault and size, with the subtotal of each fault and the grand total."""
    return (
        rows.rollup("kind", "size")
        .agg(
            F.count_if(F.col("outcome") == "caught").alias("caught"),
            F.count_if(F.col("outcome") == "noted").alias("noted"),
            F.count_if(F.col("outcome") == "missed").alias("missed"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("caught_pct", F.round(F.col("caught") * 100.0 / F.col("n"), 4))
    )


def failure_class(detail: Column) -> Column:
    """A detail with its numbers as N and its site or element names as X."""
    text = F.regexp_replace(F.coalesce(detail, F.lit("")), r"\d+(\.\d+)?", "N")
    return F.regexp_replace(text, r"\b[A-Z][a-z]?\d*(?:/[A-Z][a-z]?\d*)*\b", "X")


def failure_classes(records: DataFrame) -> DataFrame:
    """Records of one field, status and class of detail: how many, over how many documents."""
    classed = records.withColumn("detail_class", failure_class(F.col("detail")))
    per_doc = classed.groupBy("field", "status", "detail_class", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per_doc.groupBy("field", "status", "detail_class").agg(
        F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("example")
    )


# What a report blames: the kind of fault, how it says so, and whether it has the right one. The basis is right within 2 %.
_BASIS_RIGHT = "(basis_true > 0 AND abs(basis_needed - basis_true) <= 0.02 * basis_true)"
BLAMES = (
    ("wt", True, "standing = 'one'", "named = target"),
    ("two", True, "standing = 'many' OR (factor = 'scatter' AND standing <> 'one')", "true"),
    ("basis", True, "factor = 'basis'", f"{_BASIS_RIGHT} AND (whole OR valence_named IS NULL)"),
    ("basis", False, "factor = 'shift'", _BASIS_RIGHT),
    ("valence", True, "valence_named IS NOT NULL", "valence_named = target AND NOT whole"),
)


def diagnosis_outcome() -> Column:
    """What a report said of a seeded fault, as RIGHT … FALSE-ALARM, from two questions: is the fault's kind blamed, and is the
    right item or basis blamed?

    Columns: kind, target, standing (one / many / none), named, factor, valence_named (null when no
    valence line), basis_needed, basis_true, whole, red (array of names). A shift is a hint and blames nothing by itself.
    """
    yes = lambda test: F.coalesce(F.expr(test), F.lit(False))
    blames = F.array_compact(F.array(*[F.when(yes(said), F.struct(F.lit(k).alias("kind"), F.lit(firm).alias("firm"), yes(right).alias("right"))) for k, firm, said, right in BLAMES]))
    kind, is_red = F.col("kind"), F.size("red") > 0

    def judge(all_of: Column) -> Column:
        own = F.filter(all_of, lambda b: b["kind"] == kind)
        # several items together are no other kind: they name none of them
        others = F.filter(all_of, lambda b: (b["kind"] != kind) & (b["kind"] != "two") & (b["firm"] | (kind == "valence")))
        item = F.exists(others, lambda b: b["kind"] == "wt")
        firm, right = F.exists(own, lambda b: b["firm"]), F.exists(own, lambda b: b["right"])
        # the kind is named: by a blame, or by a hint
        of_own = F.when(firm & right, "RIGHT").when(kind == "wt", "WRONG-NAME").when(firm | right, "PARTIAL").otherwise("MISSED")
        # another kind is named: one item of two has a wrong name, a basis and a valence both move all items by one factor
        of_others = F.when((kind == "two") & item, "WRONG-NAME").when((kind == "valence") & ~item, "PARTIAL").otherwise("WRONG-KIND")
        # nothing is named: what stands in red is all there is to go by
        of_red = F.when(~is_red, "MISSED").when(kind.isin("basis", "two"), "PARTIAL").when(kind == "valence", "WRONG-KIND").when(F.array_contains("red", F.col("target")), "PARTIAL").otherwise("WRONG-NAME")
        clean = ~is_red & yes("standing = 'none' AND factor IN ('ok', 'few', 'shift')")
        return F.when(kind == "none", F.when(clean, "RIGHT").otherwise("FALSE-ALARM")).when(F.size(own) > 0, of_own).when(F.size(others) > 0, of_others).otherwise(of_red)

    return F.when(kind.isin("none", "wt", "basis", "valence", "two"), let(blames, judge))


DIAGNOSES = ("RIGHT", "PARTIAL", "WRONG-NAME", "WRONG-KIND", "MISSED", "FALSE-ALARM")


def diagnosis_confusion(reports: DataFrame) -> DataFrame:
    return (
        reports.withColumn("diagnosis", diagnosis_outcome())
        .groupBy("kind")
        .pivot("diagnosis", list(DIAGNOSES))
        .count()
        .na.fill(0, list(DIAGNOSES))
    )


# --- alert reports ----------------------------------------------------------------------------

# Severity given to a check-report code whatever its level; lower rank comes first.
ELEVATED = {
    "PLAT965": "CRITICAL",
    "PLAT083": "FLAG",
    "PLAT906": "FLAG",
    "PLAT931": "FLAG",
    "PLAT969": "FLAG",
    "PLAT933": "SURFACE",
    "PLAT913": "SURFACE",
    "PLAT077": "NOTE",
    "PLAT034": "NOTE",
    "PLAT794": "BVS",
    "DIFMN03": "NOTE",
}
DEMOTED = ("PUBL001", "PUBL003", "PUBL004", "PUBL005", "PUBL006", "PUBL008", "PUBL009", "PUBL010", "PUBL011", "PUBL012", "PUBL017")
SEVERITY_RANK = {"CRITICAL": 0, "FLAG": 1, "SURFACE": 2, "BVS": 3, "NOTE": 4}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def alert_severity(alerts: DataFrame) -> DataFrame:
    """Adds severity, rank and whether the alert is mere submission metadata or an O–H distance in disguise."""
    # the alert reads "... <density> Ang From <atom> ...": the word before Ang is the distance, the word after From the atom
    words = F.split(F.regexp_replace(F.trim("desc"), r"(?i)(\d)Ang\b", "$1 Ang"), r"\s+")
    word_after = lambda mark, step: F.get(words, F.array_position(F.transform(words, F.lower), mark).cast("int") - 1 + step)
    distance = F.when(F.lower("desc").contains("resid"), word_after("ang", -1).try_cast("double"))
    atom = F.when(F.array_contains(F.transform(words, F.lower), "from"), word_after("from", 1))
    severity = literal_map(ELEVATED)[F.col("code")]
    return (
        alerts.withColumn("severity", severity)
        .withColumn("rank", literal_map(SEVERITY_RANK)[severity])
        .withColumn("demoted", F.col("code").isin(*DEMOTED))
        .withColumn(
            "near_oxygen",
            F.coalesce((F.col("code") == "PLAT975") & distance.between(0.6, 1.05) & F.upper(atom).startswith("O") & (F.array_position(F.transform(words, F.lower), "ang") > 1), F.lit(False)),
        )
    )


def alert_triage(alerts: DataFrame) -> DataFrame:
    """Per report: tally by level, elevated alerts, demoted alerts, possible hydrogen peaks, worst severity."""
    rated = alert_severity(alerts)
    return rated.groupBy("report_id").agg(
        *[F.count_if(F.col("level") == level).alias(f"level_{level.lower()}") for level in "ABCG"],
        F.count("severity").alias("elevated"),
        F.count_if(F.col("demoted")).alias("demoted"),
        F.count_if(F.col("near_oxygen")).alias("h_peaks"),
        F.min_by("severity", "rank").alias("worst"),
    )


# --- agreement of readers ---------------------------------------------------------------------


def verified_rate(statuses: DataFrame, features: DataFrame) -> DataFrame:
    """Per field: of the documents whose text has the thing, how many the reader verifies.

    The denominator comes from the feature scan only, so reading less cannot raise a rate.
    """
    base = features.where("present").select("doc_id", "field").distinct()
    joined = base.join(statuses.select("doc_id", "field", "status"), ["doc_id", "field"], "left")
    status = F.coalesce("status", F.lit("none"))
    return joined.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(status == s).alias(s) for s in ("agrees", "disagrees", "unverified", "nooracle", "none")],
        F.round(100.0 * F.count_if(status == "agrees") / F.count(F.lit(1)), 4).alias("agree_pct"),
    )


def all_agree_rate(statuses: DataFrame, features: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Of the documents that print every one of `fields`, those on which every reader agrees."""
    wanted = (
        features.where(F.col("present") & F.col("field").isin(*fields))
        .groupBy("doc_id").agg(F.count_distinct("field").alias("k")).where(F.col("k") == len(fields))
    )
    agree = statuses.where(F.col("field").isin(*fields) & (F.col("status") == "agrees")).groupBy("doc_id").agg(
        F.count_distinct("field").alias("ok")
    )
    return wanted.join(agree, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ok") == len(fields)).alias("all_agree")
    )


def agreement_rate(sums: DataFrame, tolerance: float) -> DataFrame:
    """Per structure: sums compared, sums off, and the convention most printed sums follow.

    `sums` has the printed sum and the computed cation sum, the sum with donated bonds added and with
    them taken away; the nearest convention wins a row.
    """
    options = F.array(
        *[
            F.struct(F.abs(F.col(c) - F.col("printed")).alias("off"), F.lit(n).alias("order"), F.lit(c).alias("name"))
            for n, c in enumerate(("s_anion", "s_all", "s_net"))
        ]
    )
    best = sums.withColumn("best", F.array_min(options))
    votes = best.groupBy("structure_id", F.col("best.name").alias("convention")).agg(
        F.count(F.lit(1)).alias("k"), F.count_if(F.col("best.off") > tolerance).alias("bad")
    )
    return votes.groupBy("structure_id").agg(
        F.sum("k").alias("compared"),
        F.sum("bad").alias("disagree"),
        F.max_by("convention", F.struct("k", "convention")).alias("convention"),
    )


def contradictions(report_states: DataFrame, record_states: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents whose report and record say things a rule row calls incompatible."""
    return (
        report_states.join(record_states, ["doc_id", "topic"])
        .join(rules, ["topic", "report_state", "record_state"])
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))
    )


def severity_gate(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``clean``: an exact cell, no parameter slips, no radiation flag and nothing to write back."""
    writable = (F.col("sev") == "flag") | ((F.col("code") == "classification") & (F.col("anchor") == "name"))
    per_entry = findings.groupBy("entry_id").agg(
        F.count_if(writable).alias("n_writable"),
        F.count_if(F.col("code").startswith("param:")).alias("n_params"),
    )
    return entries.join(per_entry, "entry_id", "left").select(
        "entry_id",
        F.coalesce("n_writable", F.lit(0)).alias("n_writable"),
        (
            (F.col("cell") == "match")
            & F.coalesce(F.col("lam") != "flag", F.lit(True))
            & (F.coalesce("n_writable", F.lit(0)) == 0)
            & (F.coalesce("n_params", F.lit(0)) == 0)
        ).alias("clean"),
    )
