"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source, its documents in a shuffled order, form a tape that is cut into blocks of equal length. The mix is a row of
slots. The points of a golden-ratio sequence, mapped through the cumulative weights, say which source fills which slot, so every
stretch of the mix holds the sources in their proportions. The r-th slot of a source takes the r-th block of its tape, and goes
round the tape again when it is used up. All orders are kept by counts in two levels (within a range, then over the ranges), so no
source is ever sorted in one place.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordaudit.llm.common import SPACES, stored, table

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
GOLDEN = 2654435769  # 2^32 over the golden ratio
CHUNK = 4096  # slots or documents that are put in order together
BINS = 4096  # of the unit interval, to meet points and shares by equality


def word_count(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target) for a table of `source` and `source_size`: a row per source, null last.

    The targets share `share` times all sizes by weight. Where one exceeds `most` times its size, it stops there, and the excess is
    shared by weight among the rest: with the sources in the order of most * size / weight, those that stop come first.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source: the one table that is ordered as a whole
    kind = (F.row_number().over(named) - 1) % len(weights)
    weighed = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (kind + 1).cast("int")).alias("weight"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    out = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    out = out.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    out = out.withColumn("stopped", F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1))).withColumn("left", F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
    # the level rises as sources stop and falls once one stops that need not: the right one is the highest that holds
    level = (F.col("total") - F.coalesce("stopped", F.lit(0.0))) / F.col("left")
    out = out.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(whole))
    return out.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _ahead(df: DataFrame, keys: list[str], chunk: str, amount: Column, name: str) -> DataFrame:
    """(keys, chunk, name): the sum of `amount` in the chunks before this one, per keys. There is one row per chunk, so few are ordered."""
    sums = df.groupBy(*keys, chunk).agg(F.sum(amount).alias("__own"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, chunk, F.coalesce(F.sum("__own").over(before), F.lit(0)).alias(name))


def schedule(wanted: DataFrame) -> DataFrame:
    """(s, …, rank, slot) from a table (s, slots, …): which slot of the mix takes the rank-th block of source number s.

    Slot i has the point (i * golden ratio) mod 1, in 32-bit whole numbers, and belongs to the source in whose share of the slots
    it falls. A source that the sequence leaves short by a few slots gets them at the end; one that it would exceed stops.

    Other columns of a source go along. The slots come from a count, which the optimizer takes for a small table, so their joins
    are told to be merge joins: no side of them is ever broadcast.
    """
    extra = [c for c in wanted.columns if c != "s"]
    whole, upto = Window.partitionBy(), Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    shares = wanted.where("slots > 0").withColumn("n", F.sum("slots").over(whole))
    shares = shares.withColumn("hi", F.floor(F.sum("slots").over(upto) / F.col("n") * float(1 << 32)))
    shares = shares.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("s")), F.lit(0)))
    width = (1 << 32) // BINS
    bins = shares.where("lo < hi").select("s", *extra, "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("bin"))

    ranges = shares.agg(F.max("n").alias("n")).where("n > 0").select("n", F.explode(F.expr(f"sequence(0L, n - 1, {CHUNK}L)")).alias("first"))
    slots = ranges.repartition("first").select((F.col("first") / CHUNK).cast("long").alias("chunk"), F.explode(F.expr(f"sequence(first, least(n, first + {CHUNK}L) - 1)")).alias("slot"))
    low = F.col("slot") % (1 << 32)
    point = (F.expr(f"(((slot % {1 << 32}L) div 65536) * {GOLDEN}L) % 65536 * 65536") + low % 65536 * GOLDEN) % (1 << 32)
    slots = slots.withColumn("point", point).withColumn("bin", F.expr(f"point div {width}"))
    placed = slots.hint("merge").join(bins, "bin").where("point >= lo AND point < hi").select("s", *extra, "chunk", "slot")

    ahead = _ahead(placed, ["s"], "chunk", F.lit(1).cast("long"), "ahead")
    within = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("within", within).hint("merge").join(ahead, ["s", "chunk"]).select("s", *extra, (F.col("ahead") + F.col("within")).alias("rank"), "slot").where("rank < slots")
    got = placed.groupBy("s").agg(F.count("*").alias("got"))
    short = shares.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    return ranked.union(short.select("s", *extra, F.explode(F.expr("sequence(got, slots - 1)")).alias("rank"), F.col("n").alias("slot")))


class Mix(NamedTuple):
    """What mixing gives: the sources with their targets, the blocks' pieces in their slots, and the documents with their shares."""

    sources: DataFrame  # source, source_size, weight, target
    pieces: DataFrame  # slot, source, block, round, doc_id, start and length in the document (words)
    documents: DataFrame  # doc_id, size, source_size, target, taken


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = 1024, carry: tuple[str, ...] = ()) -> Mix:
    """Mix all rows of `docs` (doc_id, text, source) so that every source's words come to its target.

    A null text has size 0; a null source is a source of its own, the last; repeated rows and null ids count row by row; other
    columns are not read. A document is taken at most `most` (rounded up) times. An empty table gives empty results. `carry` names columns that go along to `documents`.
    """
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", key.alias("k"), word_count(F.col("text")).alias("size"), *carry), "sizes")
    sizes = rows.groupBy("k", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    aims = targets(sizes.select("source", "source_size"), share, most, weights)
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("s")
    aims = aims.select("*", number, key.alias("k")).join(sizes.select("k", "docs"), "k")
    aims = aims.withColumn("aim", F.floor("target")).withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("chunks", F.ceil(F.col("docs") / CHUNK))
    aims = stored(aims.withColumn("slots", F.expr(f"if(source_size = 0, 0L, aim div source_size * blocks + ceil(aim % source_size / {block}))")), "aims")

    # every row learns about its source; a source may hold most rows, so both sides carry one of 64 salts
    salted = aims.select("k", "s", "source_size", "target", "chunks", "blocks", "aim", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt"))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")).cast("binary"))
    spread = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    known = rows.withColumn("h", spread).withColumn("salt", (F.col("h") % 64).cast("int")).join(salted, ["k", "salt"])
    known = known.withColumn("chunk", F.floor(F.col("h") * F.col("chunks") / float(1 << 32)))
    ahead = _ahead(known, ["s"], "chunk", F.col("size"), "ahead")
    order = Window.partitionBy("s", "chunk").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    tape = known.withColumn("within", F.sum("size").over(order) - F.col("size")).join(ahead, ["s", "chunk"])
    tape = stored(tape.withColumn("at", F.col("ahead") + F.col("within")).select("row", "doc_id", "source", "s", "size", "source_size", "target", "aim", "blocks", "at", *carry), "tape")

    cuts = tape.where("size > 0").select("row", "doc_id", "source", "s", "source_size", "aim", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    cuts = cuts.withColumn("from", F.greatest(F.col("at"), F.col("block") * block)).withColumn("to", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block))
    slots = schedule(aims.select("s", "slots", "blocks")).select("s", "slot", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("round"))
    taken = cuts.join(slots.hint("merge"), ["s", "block"])
    taken = taken.withColumn("length", F.least(F.col("to"), F.col("aim") - F.col("round") * F.col("source_size")) - F.col("from")).where("length > 0")
    taken = taken.select("row", "slot", "source", "block", "round", "doc_id", (F.col("from") - F.col("at")).alias("start"), "length")

    words = taken.groupBy("row").agg(F.sum("length").alias("taken"))
    per_row = tape.join(words.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *carry)
    return Mix(aims.select("source", "source_size", "weight", "target"), taken.drop("row"), per_row)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of `docs`, all columns: each as often as the mix takes its words, rounded. Only one document of a source, the last, is taken in part."""
    own = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns])
    marked = docs.withColumns({"__h": own, "__k": F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))})
    per_row = mix(marked.select("doc_id", "text", "source", "__h", "__k"), carry=("__h", "__k")).documents
    copies = per_row.where("size > 0").groupBy("__h", "__k").agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias("__copies")).where("__copies > 0")
    # the texts move once: the join and the choice among repeated rows have the same keys
    met = marked.join(copies, ["__h", "__k"])
    single = met.withColumn("__n", F.row_number().over(Window.partitionBy("__h", "__k").orderBy("__h"))).where("__n = 1")
    return single.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def op8_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).documents


OP8_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS k, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
sizes AS (SELECT k, source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM rows GROUP BY ALL),
weighed AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS s,
  source_size * 2.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS total FROM sizes),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
aims AS (SELECT *, least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap)) AS target FROM levels),
aimed AS (SELECT *, CAST(floor(target) AS BIGINT) AS aim FROM aims),
tape AS (
  SELECT r.doc_id, r.size, a.source_size, a.target, a.aim,
    CAST(sum(r.size) OVER (PARTITION BY r.k ORDER BY CAST('0x' || substr(md5(coalesce(CAST(r.doc_id AS VARCHAR), 'null') || '|' || r.size), 1, 8) AS BIGINT), r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - r.size AS start
  FROM rows r JOIN aimed a USING (k))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (aim // source_size) + greatest(0, least(start + size, aim % source_size) - start) END AS BIGINT) AS taken FROM tape
"""
