"""Two printed values of one item: do they agree at their common precision?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordaudit.functions.measured import parse_measured, scaled_half_up


def value_issues(left: str, right: str) -> Column:
    """``array<string>`` of disagreements between two parsed numbers (columns of `parse_measured`).

    A value that differs at the common precision ends the comparison; else differing decimals and
    differing uncertainties are each reported.
    """
    places = F.least(F.col(f"{left}.decimals"), F.col(f"{right}.decimals"))
    lv, rv = F.col(f"{left}.value"), F.col(f"{right}.value")
    differ = scaled_half_up(lv, places) != scaled_half_up(rv, places)
    precision = F.when(F.col(f"{left}.decimals") != F.col(f"{right}.decimals"), F.lit("precision"))
    le, re_ = F.col(f"{left}.esd_digits"), F.col(f"{right}.esd_digits")
    esd = F.when((le != "") & (re_ != "") & (le != re_), F.lit("esd"))
    return F.when(lv.isNull() | rv.isNull(), F.array().cast("array<string>")).when(
        differ, F.array(F.lit("value"))
    ).otherwise(F.array_compact(F.array(precision, esd)))


def reconcile_values(pairs: DataFrame, left: str = "left_txt", right: str = "right_txt", vouch: str | None = None) -> DataFrame:
    """One row per disagreement of a pair of printed numbers.

    With `vouch`, precision and uncertainty differences are dropped to notes where a third source
    prints the left string itself.
    """
    parsed = pairs.withColumn("_l", parse_measured(F.col(left))).withColumn("_r", parse_measured(F.col(right)))
    issues = parsed.withColumn("kind", F.explode(value_issues("_l", "_r")))
    severity = F.lit("flag")
    if vouch:
        severity = F.when((F.col("kind") != "value") & vouches(F.col(left), F.col(vouch)), "note").otherwise("flag")
    return issues.withColumn("sev", severity).drop("_l", "_r")


def vouches(written: Column, third: Column) -> Column:
    """The third source prints the same digits and uncertainty."""
    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"\s+", "")

    return F.coalesce((bare(written) != "") & (bare(written) == bare(third)), F.lit(False))


AXES = ("a", "b", "c", "al", "be", "ga")


def reconcile_cells(cells: DataFrame) -> DataFrame:
    """Cell parameters of two sources; parameters with the same pair of strings report once (``a=b=c``).

    `cells`: ``entry_id, axis, left_txt, right_txt``. A left angle of exactly 90 or 120 is skipped
    while the other source omits it or agrees.
    """
    order = F.array_position(F.array(*[F.lit(a) for a in AXES]), F.col("axis")).cast("int")
    angle = F.col("axis").isin("al", "be", "ga")
    lv, rv = parse_measured(F.col("left_txt"))["value"], parse_measured(F.col("right_txt"))["value"]
    fixed = angle & lv.isin(90.0, 120.0) & (rv.isNull() | (rv == lv))
    grouped = (
        cells.withColumn("k", order)
        .where(~F.coalesce(fixed, F.lit(False)))
        .groupBy("entry_id", "left_txt", "right_txt")
        .agg(F.array_sort(F.collect_set(F.struct("k", "axis"))).alias("axes"))  # at most six distinct axes
        .withColumn("label", F.concat_ws("=", F.col("axes.axis")))
        .withColumn("anchor", F.col("axes")[0]["axis"])
    )
    return reconcile_values(grouped).select("entry_id", "label", "anchor", "kind", "left_txt", "right_txt")
