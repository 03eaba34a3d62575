"""Joins by closeness: windows, nearest neighbours, and one-to-one pairing within a tolerance.

None of these forms the product of two groups. Values are put into bins so that every join is an
equi-join on (key, bin) with an exact test behind it; a busy key is thereby spread over its bins.
One-to-one pairing works on *distinct* values with their counts, cut wherever the gap between
neighbouring values is wider than the tolerance: the pieces are independent, so the result is exact,
and a piece holds distinct printed values, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from recordaudit.operators import sweeps
from recordaudit.session import cut_lineage

_PAIR = [*((n, T.DoubleType()) for n in ("l", "r")), *((n, T.LongType()) for n in ("n", "l_from", "r_from")), *((n, T.DoubleType()) for n in ("p_l", "p_r"))]


@dataclass(frozen=True)
class Tolerance:
    """``rel · max(value, floor) + abs``; `rel` is below one, so a gap wider than it separates two groups."""

    rel: float = 0.0
    floor: float = 0.0
    abs: float = 0.0

    def value(self, value: float) -> float:
        return self.rel * max(value, self.floor) + self.abs

    def values(self, value: np.ndarray) -> np.ndarray:
        return self.rel * np.maximum(value, self.floor) + self.abs

    def of(self, value: Column) -> Column:
        return F.lit(self.rel) * F.greatest(value, F.lit(self.floor)) + F.lit(self.abs)


LINE_TOLERANCE = Tolerance(rel=0.0015, floor=1.0, abs=0.0006)  # fixed value: two d spacings are one line


def range_join(
    points: DataFrame,
    windows: DataFrame,
    value: str,
    lo: str,
    hi: str,
    width: float,
    keys: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Every point with the windows that hold it (bounds included).

    `width` should be near the usual window length: a window is repeated once per bin it touches, a
    point never. `how` may also be ``left``, ``left_semi`` or ``left_anti``.
    """
    binned_windows = windows.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    )
    right = binned_windows.select(*[F.col(c).alias(f"_w_{c}") for c in binned_windows.columns])
    left = points.withColumn("_bin", F.floor(F.col(value) / width))
    condition = (
        (F.col("_bin") == F.col("_w__bin"))
        & (F.col(value) >= F.col(f"_w_{lo}"))
        & (F.col(value) <= F.col(f"_w_{hi}"))
    )
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"_w_{key}"))
    joined = left.join(right, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bin")
    kept = [F.col(f"_w_{c}").alias(c) for c in windows.columns if c not in keys]
    return joined.select(*points.columns, *kept)


def near_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    lval: str,
    rval: str,
    tol: Tolerance,
    width: float,
    how: str = "inner",
) -> DataFrame:
    """Rows of two sides whose values lie within ``tol`` of the left value. Column names must differ."""
    if tol.rel >= 1:
        raise ValueError("a relative tolerance of one or more has no bounded window")
    reach_up = (F.col(rval) + F.lit(tol.rel * tol.floor + tol.abs)) / F.lit(1 - tol.rel) + 1e-9
    reach_down = F.least(
        (F.col(rval) - F.lit(tol.abs)) / F.lit(1 + tol.rel), F.col(rval) - F.lit(tol.rel * tol.floor + tol.abs)
    ) - 1e-9
    spread = right.withColumn(
        "_rbin", F.explode(F.sequence(F.floor(reach_down / width), F.floor(reach_up / width)))
    )
    for key in keys:
        spread = spread.withColumnRenamed(key, f"_r_{key}")
    condition = (F.floor(F.col(lval) / width) == F.col("_rbin")) & (
        F.abs(F.col(lval) - F.col(rval)) <= tol.of(F.col(lval))
    )
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"_r_{key}"))
    return left.join(spread, condition, how).drop("_rbin", *[f"_r_{k}" for k in keys])


def split_by_gap(
    rows: DataFrame, keys: Sequence[str], value: str, gap: Column, bucket: float = 1.0, out: str = "piece"
) -> DataFrame:
    """Number the runs of a sorted series that are broken where the step from the row before exceeds `gap`.

    Done in two levels, so that a key of any size is spread over value buckets: runs are counted
    inside each bucket, and one summary row per bucket carries the count across.
    """
    keys = list(keys)
    by_bucket = Window.partitionBy(*keys, "_bucket").orderBy(value)
    marked = rows.withColumn("_bucket", F.floor(F.col(value) / bucket)).withColumn("_before", F.lag(value).over(by_bucket))
    marked = marked.withColumn(
        "_break", F.when(F.col("_before").isNotNull() & (F.col(value) - F.col("_before") > gap), 1).otherwise(0)
    )
    summary = (
        marked.groupBy(*keys, "_bucket")
        .agg(F.max(value).alias("_last"), F.sum("_break").alias("_inside"), F.min_by(F.struct(F.col(value).alias("v"), gap.alias("g")), value).alias("_first"))
    )
    over_key = Window.partitionBy(*keys).orderBy("_bucket")
    summary = summary.withColumn("_step", F.col("_first.v") - F.lag("_last").over(over_key))
    summary = summary.withColumn("_open", F.when(F.col("_step") > F.col("_first.g"), 1).otherwise(0))
    summary = summary.withColumn(
        "_offset",
        F.sum("_open").over(over_key.rowsBetween(Window.unboundedPreceding, 0))
        + F.coalesce(F.sum("_inside").over(over_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select(*keys, "_bucket", "_offset")
    local = F.sum("_break").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("_local", local)
        .join(summary, [*keys, "_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_before", "_break", "_local", "_offset")
    )


# --- one-to-one pairing, closest first ---------------------------------------------------------


def collapse_sides(left: DataFrame, right: DataFrame, key: str, lval: str, rval: str, lpay: str | None = None, rpay: str | None = None) -> DataFrame:
    """Both lists as distinct values: ``key, v, n_l, n_r, p_l, p_r``. Combined map-side, so copies never travel.

    A payload is the largest one of the copies.
    """
    none = F.lit(None).cast("double")
    both = left.select(
        key, F.col(lval).alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r"), (F.col(lpay) if lpay else none).alias("pl"), none.alias("pr")
    ).unionByName(
        right.select(key, F.col(rval).alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r"), none.alias("pl"), (F.col(rpay) if rpay else none).alias("pr"))
    )
    return both.where("v IS NOT NULL").groupBy(key, "v").agg(
        F.sum("l").alias("n_l"), F.sum("r").alias("n_r"), F.max("pl").alias("p_l"), F.max("pr").alias("p_r")
    )


def pair_pieces(values: DataFrame, key: str, tol: Tolerance, together: bool = False) -> DataFrame:
    """One row per piece of a key's distinct values, with its pairs in ``done``; ``vs`` keeps the values of the piece.

    Pieces are numbered in two levels, so a key of any size is spread over value buckets; what one row holds is the distinct
    values of one tolerance-connected run. Its pairs are settled in time near that number. With `together`, the rows of a key lie
    together already (for totals over the key) and are numbered in one sorted pass where they lie.
    """
    gap = tol.of(F.col("v"))
    if together:
        up = Window.partitionBy(key).orderBy("v")
        opens = F.when(F.col("v") - F.lag("v").over(up) > gap, 1).otherwise(0)
        pieces = values.withColumn("_open", opens).withColumn("piece", F.sum("_open").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        pieces = split_by_gap(values, [key], "v", gap)
    grouped = pieces.groupBy(key, "piece").agg(F.collect_list(F.struct("v", "n_l", "n_r", "p_l", "p_r")).alias("vs"))
    value, values_ = tol.value, tol.values
    kind = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _PAIR]))

    def settle(vs: pa.Array) -> pa.Array:
        return sweeps.settle_lists(vs, value, values_)

    settle.__annotations__ = {"vs": pa.Array, "return": pa.Array}
    return grouped.withColumn("done", F.arrow_udf(settle, kind)("vs"))


def pair_values(left: DataFrame, right: DataFrame, key: str, lval: str, rval: str, tol: Tolerance) -> DataFrame:
    """Pair the values of two lists, the closest pair first, each value used as often as it occurs.

    Returns ``key, l, r, n, l_from, r_from``: `n` copies of value `l` (those after its first
    `l_from`) go with as many copies of `r`. Equal distances are taken from the large values down.
    """
    pieces = pair_pieces(collapse_sides(left, right, key, lval, rval), key, tol)
    return pieces.select(key, F.explode("done").alias("p")).select(key, "p.l", "p.r", "p.n", "p.l_from", "p.r_from")


def match_one_to_one(
    left: DataFrame, right: DataFrame, key: str, lid: str, rid: str, lval: str, rval: str, tol: Tolerance = LINE_TOLERANCE
) -> DataFrame:
    """``key, lid, rid, dev``: rows of two lists paired one to one, the closest first.

    Copies of one value are interchangeable and go in the order of their ids.
    """
    pairs = pair_values(left, right, key, lval, rval, tol)
    lrank = F.row_number().over(Window.partitionBy(key, "l").orderBy(lid)) - 1
    rrank = F.row_number().over(Window.partitionBy(key, "r").orderBy(rid)) - 1
    lrows = left.select(key, lid, F.col(lval).alias("l")).withColumn("l_rank", lrank)
    rrows = right.select(key, rid, F.col(rval).alias("r")).withColumn("r_rank", rrank)
    picked = lrows.join(pairs, [key, "l"]).where("l_rank >= l_from AND l_rank < l_from + n")
    picked = picked.withColumn("r_rank", F.expr("r_from + l_rank - l_from"))
    return picked.join(rrows, [key, "r", "r_rank"]).select(key, lid, rid, F.abs(F.col("l") - F.col("r")).alias("dev"))


def claim_in_order(
    claimants: DataFrame, offers: DataFrame, key: str, turn: tuple[str, str], oid: str, cval: str, oval: str, tol: Tolerance,
    closed_from: tuple[str, str] | None = None,
) -> DataFrame:
    """``key, *turn, oid``: each claimant, in the order of its two `turn` columns, takes the nearest offer still free (null: none).

    Of equally near offers the one with the smallest id goes first. With `closed_from`, an offer is free only to claimants whose turn is before those two
    columns (null: always). Distinct values, counted map-side, are cut where a gap is wider than the tolerance; the pieces do not
    touch. Rows then stream through their piece in order: no key's rows are gathered, only the offers of one piece are held.
    """
    names = ("no", "s1", "s2")
    shut = closed_from or (None, None)
    kinds = {c: claimants.schema[c].dataType for c in turn}
    null = {n: F.lit(None).cast(t).alias(n) for n, t in (("t1", kinds[turn[0]]), ("t2", kinds[turn[1]]), ("no", "bigint"), ("s1", kinds[turn[0]]), ("s2", kinds[turn[1]]))}
    asks = claimants.select(key, F.lit(True).alias("asks"), F.col(cval).alias("v"), F.col(turn[0]).alias("t1"), F.col(turn[1]).alias("t2"), *(null[n] for n in names))
    has = offers.select(
        key, F.lit(False).alias("asks"), F.col(oval).alias("v"), null["t1"], null["t2"], F.col(oid).cast("bigint").alias("no"),
        *(F.col(s).cast(kinds[t]).alias(n) if s else null[n] for s, t, n in zip(shut, turn, ("s1", "s2"))),
    )
    both = asks.unionByName(has)
    values = both.where("v IS NOT NULL").groupBy(key, "v").agg(F.lit(1).alias("n"))
    pieces = split_by_gap(values, [key], "v", tol.of(F.col("v"))).select(F.col(key).alias("_k"), F.col("v").alias("_v"), "piece")
    placed = both.join(pieces, (F.col(key) == F.col("_k")) & (F.col("v") == F.col("_v"))).select(key, "piece", "asks", "v", "t1", "t2", "no", "s1", "s2")
    dealt = placed.repartition(key, "piece").sortWithinPartitions(key, "piece", "asks", "t1", "t2")
    schema = T.StructType([placed.schema[key], placed.schema["piece"], T.StructField("turn1", kinds[turn[0]]), T.StructField("turn2", kinds[turn[1]]), T.StructField("no", T.LongType())])
    out = dealt.mapInArrow(sweeps.claims(2, tol.value), schema)
    return out.select(key, F.col("turn1").alias(turn[0]), F.col("turn2").alias(turn[1]), F.col("no").alias(oid))


def match_stated(fitted: DataFrame, stated: DataFrame, key: str, tol: Tolerance = Tolerance(abs=6.0)) -> DataFrame:
    """Stated positions against fitted ones: ``matched``, ``not_fitted`` (stated only) or ``not_stated``.

    `fitted`: key, fit_no, fit_pos; `stated`: key, said_no, said_pos. Stated positions ask in ascending order.
    """
    asked = claim_in_order(stated, fitted, key, ("said_pos", "said_no"), "fit_no", "said_pos", "fit_pos", tol)
    return asked.join(fitted, [key, "fit_no"], "full_outer").select(
        key, "said_no", "said_pos", "fit_no", "fit_pos",
        F.when(F.col("said_no").isNull(), "not_stated").when(F.col("fit_pos").isNull(), "not_fitted").otherwise("matched").alias("state"),
    )


# --- reflection lists ---------------------------------------------------------------------------


def missing_lines(paper: DataFrame, entry: DataFrame, weak: float = 5.0) -> DataFrame:
    """Lines of the paper's list that the entry's list lacks, where the entry plainly came from that list.

    Both lists: ``entry_id, d, i``. Kept: entries with eight lines or more on both sides, nine in ten of
    their lines paired, one to four absences. A line below the entry's weakest is not missing. ``twin`` is
    an entry line near none of the paper's, close by at the same scaled intensity; ``strong`` absences or a
    twin make the finding a flag. A multiply indexed d is one line; blank intensities of the paper are left
    out where its list has any.
    """
    rows = collapse_sides(paper, entry, "entry_id", "d", "d", "i", "i")
    of_entry = Window.partitionBy("entry_id")
    rated = F.coalesce(F.col("p_l"), F.lit(0.0)) != 0
    rows = (
        rows.withColumn("_rated", F.max(F.when(rated, 1).otherwise(0)).over(of_entry))
        .withColumn("n_rows", F.sum("n_r").over(of_entry))
        .withColumn("n_l", F.when((F.col("n_l") > 0) & ((F.col("_rated") == 0) | rated), 1).otherwise(0).cast("bigint"))
        .withColumn("n_r", F.least(F.col("n_r"), F.lit(1)).cast("bigint"))
        .where("n_l + n_r > 0 AND n_rows >= 8")
    )
    near = f"exists(vs, b -> b.n_l > 0 AND abs(a.v - b.v) <= {LINE_TOLERANCE.rel!r}D * greatest(a.v, {LINE_TOLERANCE.floor!r}D) + {LINE_TOLERANCE.abs!r}D)"
    pieces = pair_pieces(rows.select("entry_id", "v", "n_l", "n_r", "p_l", "p_r"), "entry_id", LINE_TOLERANCE, together=True).select(
        "entry_id",
        F.size("done").alias("k"),
        F.expr("size(filter(vs, a -> a.n_l > 0))").alias("k_obs"),
        F.expr("size(filter(vs, a -> a.n_r > 0))").alias("k_own"),
        F.expr("array_max(transform(filter(vs, a -> a.n_l > 0), a -> a.p_l))").alias("top_obs"),
        F.expr("array_max(transform(filter(vs, a -> a.n_r > 0), a -> a.p_r))").alias("top_own"),
        F.expr("array_min(transform(filter(vs, a -> a.n_r > 0 AND a.p_r <> 0), a -> a.p_r))").alias("low_own"),
        F.expr("filter(vs, a -> a.n_l > 0 AND NOT exists(done, p -> p.l = a.v))").alias("absent"),
        F.expr(f"filter(vs, a -> a.n_r > 0 AND a.p_r <> 0 AND NOT {near})").alias("stray"),
    )
    # per-entry totals on the partitioning the pieces already have
    totals = (
        pieces.withColumn("n_pairs", F.sum("k").over(of_entry))
        .withColumn("n_obs", F.sum("k_obs").over(of_entry))
        .withColumn("n_own", F.sum("k_own").over(of_entry))
        .withColumn("max_obs", F.max("top_obs").over(of_entry))
        .withColumn("max_own", F.max("top_own").over(of_entry))
        .withColumn("min_own", F.min("low_own").over(of_entry))
        .where("n_obs >= 8 AND n_pairs >= 0.9 * n_own AND n_obs - n_pairs BETWEEN 1 AND 4")
        .withColumn("scale", F.coalesce(F.expr("max_own / nullif(max_obs, 0)"), F.lit(1.0)))
    )
    # at most four absences to an entry: each is shown to all pieces with a stray line, and no branch is worked out twice
    asked = totals.withColumn("asked", F.flatten(F.collect_list("absent").over(of_entry))).where("size(absent) + size(stray) > 0").withColumn("a", F.explode("asked"))
    asked = asked.select("entry_id", "scale", "max_obs", "min_own", "stray", F.col("a.v").alias("d"), F.col("a.p_l").alias("i")).where("i IS NULL OR i = 0 OR min_own IS NULL OR i * scale >= min_own - 1e-9")
    twin = F.expr("array_max(transform(filter(stray, t -> abs(t.v - d) / d < 0.03 AND abs(t.p_r - i * scale) <= 0.02 * greatest(t.p_r, 1) + 0.5), t -> t.v))")
    found = asked.groupBy("entry_id", "d", "i", "max_obs").agg(F.max(twin).alias("twin"))
    strong = F.col("twin").isNotNull() | F.coalesce(F.expr(f"100.0 * i / coalesce(nullif(max_obs, 0), 100.0) >= {weak}"), F.lit(False))
    return found.withColumn("strong", F.max(F.when(strong, 1).otherwise(0)).over(of_entry)).select(
        "entry_id", "d", "i", "twin", F.when(F.col("strong") == 1, "flag").otherwise("note").alias("sev")
    )


def intensity_outliers(paper: DataFrame, entry: DataFrame) -> DataFrame:
    """Entry lines whose intensity is not the paper's on the scale nearly all other lines share.

    The scale is the upper median of the ratios; four in five pairs must sit within 15 % or two units of
    it, and at most three lines may be off by a factor of two and ten units. A d the paper prints twice, or
    the entry with two intensities, is left out.
    """
    both = paper.where("i IS NOT NULL AND i <> 0 AND d IS NOT NULL").select("entry_id", "d", F.lit(1).alias("l"), F.lit(0).alias("r"), "i").unionByName(
        entry.where("i IS NOT NULL AND i <> 0 AND d IS NOT NULL").select("entry_id", "d", F.lit(0).alias("l"), F.lit(1).alias("r"), "i")
    )
    own_i = F.when(F.col("r") == 1, F.col("i"))
    rows = both.groupBy("entry_id", F.col("d").alias("v")).agg(
        F.sum("l").alias("n_l"), F.sum("r").alias("n_r"), F.max(F.when(F.col("l") == 1, F.col("i"))).alias("p_l"),
        F.max(own_i).alias("p_r"), F.min(own_i).alias("low"),
    )
    of_entry = Window.partitionBy("entry_id")
    rows = (
        rows.withColumn("n_l", F.when(F.col("n_l") == 1, 1).otherwise(0).cast("bigint"))
        .withColumn("n_r", F.when((F.col("n_r") > 0) & (F.col("p_r") == F.col("low")), 1).otherwise(0).cast("bigint"))
        .where("n_l + n_r > 0")
        .withColumn("n_obs", F.sum("n_l").over(of_entry))
        .withColumn("n_own", F.sum("n_r").over(of_entry))
        .where("n_obs >= 8 AND n_own >= 8")
    )
    pieces = pair_pieces(rows.select("entry_id", "v", "n_l", "n_r", "p_l", "p_r"), "entry_id", LINE_TOLERANCE, together=True)
    lines = (
        pieces.select("entry_id", "done", F.expr("size(filter(vs, a -> a.n_r > 0))").alias("k_own"))
        .withColumn("n_own", F.sum("k_own").over(of_entry))
        .select("entry_id", "n_own", F.explode("done").alias("p"))
        .select("entry_id", "n_own", F.col("p.r").alias("d"), F.col("p.p_l").alias("paper_i"), F.col("p.p_r").alias("own_i"))
        .withColumn("ratio", F.col("own_i") / F.col("paper_i"))
        .withColumn("n", F.count(F.lit(1)).over(of_entry))
        .where("n >= 8 AND n >= 0.9 * n_own")
    )
    middle = F.row_number().over(of_entry.orderBy("ratio")) - 1
    lines = lines.withColumn("k", middle).withColumn("scale", F.max(F.expr("CASE WHEN k = n div 2 THEN ratio END")).over(of_entry))
    judged = (
        lines.withColumn("top", F.max("own_i").over(of_entry))
        .withColumn("want", F.col("paper_i") * F.col("scale"))
        .withColumn("near", F.expr("abs(own_i - want) <= greatest(0.15 * greatest(own_i, want), 2.0 * top / 100.0)"))
        .withColumn("off", F.expr("greatest(own_i, want) >= 2 * greatest(least(own_i, want), 1e-9) AND abs(own_i - want) >= 10.0 * top / 100.0"))
        .withColumn("n_near", F.count_if("near").over(of_entry))
        .withColumn("n_off", F.count_if("off").over(of_entry))
    )
    return judged.where("off AND n_near >= 0.8 * n AND n_off BETWEEN 1 AND 3").select(
        "entry_id", "d", "own_i", F.round("want", 1).alias("want_i")
    )


def merge_obs_calc(obs: DataFrame, calc: DataFrame, tol_pct: float = 1.2, min_i: float = 3.5, dmin: float | None = None) -> DataFrame:
    """The printed powder table: observed lines beside the calculated ones.

    `obs` and `calc`: ``entry_id, line_no, d, i, h, k, l`` (indices may be null). An observed line takes the
    calculated line of its own indices, else the nearest free one within `tol_pct`; calculated lines nobody
    took join the nearest observed peak of intensity `min_i` or more, else stand alone. Rows live when either
    intensity reaches `min_i`; a peak whose calculated lines are all weak keeps its strongest, without it.
    """
    tol = Tolerance(rel=tol_pct / 100.0)
    indexed = F.col("h").isNotNull()
    calc_lines = calc.select("entry_id", F.col("line_no").cast("bigint").alias("calc_no"), F.col("d").alias("d_calc"), F.col("i").alias("i_calc"), "h", "k", "l")
    calc_lines = cut_lineage(calc_lines)  # both lists are read several times below
    # one observed peak per (d, I), numbered by the line that shows it first
    same = Window.partitionBy("entry_id", F.round("d", 4), F.round("i", 2))
    first = F.min(F.struct(F.col("line_no").cast("bigint").alias("no"), "d", "i")).over(same)
    obs_lines = obs.select("entry_id", F.col("line_no").cast("bigint").alias("line_no"), "d", "i", "h", "k", "l", first.alias("p"))
    obs_lines = obs_lines.select("entry_id", "line_no", F.col("p.no").alias("peak_no"), F.col("p.d").alias("peak_d"), F.col("p.i").alias("peak_i"), "d", "i", "h", "k", "l")
    # lines ask in the order of their peaks: peak number first, line number inside
    first_of_hkl = calc_lines.where(indexed).groupBy("entry_id", "h", "k", "l").agg(F.min("calc_no").alias("own_no"))
    obs_lines = cut_lineage(obs_lines.join(first_of_hkl, ["entry_id", "h", "k", "l"], "left"))
    by_index = obs_lines.where("own_no IS NOT NULL").select("entry_id", "peak_no", "line_no", F.col("own_no").alias("calc_no"))
    shut = by_index.groupBy("entry_id", "calc_no").agg(F.min(F.struct("peak_no", "line_no")).alias("s"))
    offers = calc_lines.select("entry_id", "calc_no", "d_calc").join(shut, ["entry_id", "calc_no"], "left").select("entry_id", "calc_no", "d_calc", F.col("s.peak_no").alias("shut_peak"), F.col("s.line_no").alias("shut_line"))
    near = claim_in_order(obs_lines.where("own_no IS NULL"), offers, "entry_id", ("peak_no", "line_no"), "calc_no", "d", "d_calc", tol, closed_from=("shut_peak", "shut_line"))
    taken = obs_lines.join(near.drop("peak_no"), ["entry_id", "line_no"], "left").withColumn("calc_no", F.coalesce("own_no", "calc_no")).drop("own_no")
    # an observed line with its calculated one, or a calculated line that nobody took
    renamed = calc_lines.select("entry_id", "calc_no", "d_calc", "i_calc", F.col("h").alias("ch"), F.col("k").alias("ck"), F.col("l").alias("cl"))
    met = cut_lineage(taken.select("entry_id", "calc_no", "line_no", "peak_no", "d", "i", "h", "k", "l").join(renamed, ["entry_id", "calc_no"], "full_outer"))
    observed = met.where("line_no IS NOT NULL").select(
        "entry_id", "peak_no", F.col("i").alias("i_obs"), F.col("d").alias("d_obs"), "d_calc", "i_calc", *[F.when(F.col("ch").isNotNull(), F.col(f"c{x}")).otherwise(F.col(x)).alias(x) for x in "hkl"],
        F.lit(None).cast("bigint").alias("alone"),
    )
    free = met.where("line_no IS NULL").select("entry_id", "calc_no", "d_calc", "i_calc", *[F.col(f"c{x}").alias(x) for x in "hkl"])
    strong_peaks = obs_lines.where((F.col("peak_i") >= min_i) & (F.col("line_no") == F.col("peak_no"))).select("entry_id", "peak_no", "peak_d", "peak_i")
    wide = Tolerance(rel=tol.rel / (1 - tol.rel) + 1e-9)  # seen from the calculated line; the peak's own tolerance decides
    dev = F.abs(F.col("peak_d") - F.col("d_calc"))
    near_by = near_join(free, strong_peaks, ["entry_id"], "d_calc", "peak_d", wide, 0.1, "left").withColumn("ok", dev <= tol.of(F.col("peak_d")))
    unclaimed = near_by.groupBy("entry_id", "calc_no", "d_calc", "i_calc", "h", "k", "l").agg(
        F.min_by(F.struct("peak_no", "peak_d", "peak_i"), F.when(F.col("ok"), F.struct(dev.alias("dev"), "peak_no"))).alias("p")
    ).select("entry_id", F.col("p.peak_no").alias("peak_no"), F.col("p.peak_i").alias("i_obs"), F.col("p.peak_d").alias("d_obs"), "d_calc", "i_calc", "h", "k", "l", F.when(F.col("p").isNull(), F.col("calc_no")).alias("alone"))
    rows = observed.unionByName(unclaimed)
    hkl = F.struct("h", "k", "l")
    # a line that stands alone is a group of its own, without a peak to judge it by
    of_peak, peak = Window.partitionBy("entry_id", "peak_no", "alone"), F.col("peak_no").isNotNull()
    rows = rows.select(
        "*", F.when(peak, F.max(F.coalesce(F.col("i_calc") >= min_i, F.lit(False))).over(of_peak)).alias("strong"),
        F.when(peak, F.max_by(hkl, F.struct(F.coalesce("i_calc", F.lit(-1.0)), -F.coalesce("d_calc", F.lit(0.0)), *[F.coalesce(x, F.lit(-99)) for x in "hkl"])).over(of_peak)).alias("best"),
    )
    judged = rows.where(F.greatest(F.coalesce("i_obs", F.lit(0.0)), F.coalesce("i_calc", F.lit(0.0))) >= min_i)
    weak = F.col("i_obs").isNotNull() & F.coalesce(F.col("i_calc") < min_i, F.lit(True))
    kept = judged.where(~weak | (~F.col("strong") & hkl.eqNullSafe(F.col("best"))))
    out = kept.select(
        "entry_id", "peak_no", "i_obs", "d_obs", F.when(~weak, F.col("d_calc")).alias("d_calc"), F.when(~weak, F.col("i_calc")).alias("i_calc"), "h", "k", "l"
    )
    return out if dmin is None else out.where(F.coalesce("d_obs", "d_calc") >= dmin)


def strongest_peaks(rows: DataFrame, n: int = 8) -> DataFrame:
    """The `n` strongest observed peaks of each entry (first by number among equals)."""
    peaks = rows.where("peak_no IS NOT NULL").groupBy("entry_id", "peak_no").agg(F.max("i_obs").alias("i_obs"))
    place = F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("i_obs"), "peak_no"))
    return peaks.withColumn("place", place).where(F.col("place") <= n)


# --- cells --------------------------------------------------------------------------------------

MATCH_TOL = 0.004  # fixed value: axes within 4 mÅ are the same


def _sorted_axes(a: str, b: str, c: str) -> Column:
    return F.array_sort(F.array_compact(F.array(F.col(a), F.col(b), F.col(c))))


def best_candidate(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The stated cell closest to the record's, over direct and sorted axes.

    `entries`: entry_id, name, a, b, c; `candidates`: entry_id, cand_id, phase, context, ca, cb, cc. Order:
    axes within 4 mÅ, deviation to the thousandth, the phase's name, the deviation, powder context.
    """
    joined = candidates.withColumn("cb", F.coalesce("cb", "ca")).join(entries, "entry_id")
    direct = F.array(*[F.struct(F.col(x).alias("x"), F.col(f"c{x}").alias("y")) for x in "abc"])
    own, theirs = _sorted_axes("a", "b", "c"), _sorted_axes("ca", "cb", "cc")
    by_size = F.when(F.size(own) == F.size(theirs), F.zip_with(own, theirs, lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    modes = joined.withColumn(
        "m",
        F.explode(F.array(F.struct(F.lit("direct").alias("mode"), direct.alias("pairs")), F.struct(F.lit("reordered").alias("mode"), by_size.alias("pairs")))),
    ).select("*", "m.mode", F.filter("m.pairs", lambda p: p["x"].isNotNull() & p["y"].isNotNull()).alias("pairs"))
    scored = modes.where(F.size("pairs") >= 2).withColumn(
        "n_match", F.size(F.filter("pairs", lambda p: F.abs(p["x"] - p["y"]) <= MATCH_TOL))
    ).withColumn("dev", F.aggregate("pairs", F.lit(0.0), lambda s, p: s + F.abs(p["x"] - p["y"])))
    short = F.regexp_replace(F.lower(F.col("name")), "[^a-z]", "")
    phase = F.regexp_replace(F.lower(F.coalesce(F.col("phase"), F.lit(""))), "[^a-z]", "")
    same_phase = (F.length(short) >= 4) & (F.length(phase) >= 4) & (
        F.contains(phase, short) | F.contains(short, phase) | (F.substring(short, 1, 6) == F.substring(phase, 1, 6))
    )
    rank = F.struct(
        F.col("n_match").alias("m"),
        (-F.round("dev", 3)).alias("r"),
        F.when(same_phase, 1).otherwise(0).alias("p"),
        (-F.col("dev")).alias("d"),
        F.when(F.col("context") == "powder", 1).otherwise(0).alias("w"),
        (-F.col("cand_id")).alias("i"),
        F.when(F.col("mode") == "direct", 1).otherwise(0).alias("o"),
    )
    best = scored.groupBy("entry_id").agg(
        F.max_by(F.struct("cand_id", "mode", "n_match", F.size("pairs").alias("n_comparable"), "dev"), rank).alias("b")
    )
    return best.select("entry_id", "b.*")


def powder_conflict(entries: DataFrame, candidates: DataFrame, matched: DataFrame) -> DataFrame:
    """Records that took a single-crystal cell although the paper refined a different powder cell.

    Powder candidates of the same phase (sorted axes within a tenth) and off by more than 4 mÅ count, unless
    some powder candidate equals the record. ``entry_id, cand_id`` of the first such cell.
    """
    theirs, own = _sorted_axes("ca", "cb", "cc"), _sorted_axes("a", "b", "c")
    powder = candidates.where("context = 'powder'").join(entries, "entry_id").where((F.size(theirs) == 3) & (F.size(own) == 3))
    gaps = F.zip_with(theirs, own, lambda x, y: F.struct(F.abs(x - y).alias("gap"), y.alias("size")))
    powder = powder.withColumn("gaps", gaps).withColumn("equal", F.forall("gaps", lambda g: g["gap"] <= MATCH_TOL))
    powder = powder.withColumn("same_phase", F.forall("gaps", lambda g: g["gap"] <= 0.10 * g["size"]))
    chosen = matched.select("entry_id", F.col("cand_id").alias("own_cand"))
    rival = F.col("same_phase") & ~F.col("equal") & ~F.col("cand_id").eqNullSafe(F.col("own_cand"))
    return (
        powder.join(chosen, "entry_id", "left")
        .groupBy("entry_id")
        .agg(F.bool_or("equal").alias("uses_powder"), F.min(F.when(rival, F.col("cand_id"))).alias("cand_id"))
        .where("NOT uses_powder AND cand_id IS NOT NULL")
        .select("entry_id", "cand_id")
    )


def merge_close_rows(bonds: DataFrame, keys: Sequence[str], value: str = "dist", count: str = "n", gap: float = 0.0015) -> DataFrame:
    """Rows of one pair whose values step by no more than `gap` become one, their counts added."""
    pieces = split_by_gap(bonds, keys, value, F.lit(gap))
    return pieces.groupBy(*keys, "piece").agg(
        F.min(value).alias(value), F.sum(count).alias(count), F.count(F.lit(1)).alias("rows")
    ).drop("piece")
