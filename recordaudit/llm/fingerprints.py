"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame expressions alone.

A sketch is the sorted array of the k smallest distinct 32-bit hashes of a text's shingles. Sketches of parts merge into that of
the whole, and tell resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordaudit.llm.common import SPACES, stored, table

K = 128
WIDTH = 5  # words in a shingle


def _bind(value: Column, use) -> Column:
    """Evaluate `value` once and hand it to `use` as a variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a whole text. Fewer than `width` words are one shingle; a text without words, or null, has an empty sketch."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")
    high = lambda hashed: F.shiftright(F.xxhash64(hashed), 32).cast("int")

    def shingles(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: high(F.slice(w, i, width)))
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, F.array(high(w))).otherwise(F.array().cast("array<int>"))

    return F.slice(F.sort_array(F.array_distinct(_bind(words, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of common shingles among all of both, 0 to 1; two texts without shingles are alike."""
    both = _bind(merge(a, b, k), lambda u: F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(u, -1))) / F.size(u))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(both)


def distinct_count(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, k).cast("double") + float(1 << 31) + 1) / float(1 << 32)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of the shingles of `a` that are also in `b`; 1 for an empty `a`."""
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as base64 of its hashes, four bytes each."""
    return F.base64(F.unhex(F.concat_ws("", F.transform(a, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))))


def next_ids(ids: DataFrame) -> DataFrame:
    """(k, next, need) for a table of distinct `k` with `need`: the largest smaller k; after the smallest, the largest.

    The ids are written in ranges, looked up inside each range, and only one row per range is looked at as a whole.
    """
    ranged = stored(ids.repartitionByRange("k").select("k", "need", F.spark_partition_id().alias("range")), "ids")
    edges = ranged.groupBy("range").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    order, all_ranges = Window.orderBy("range"), Window.partitionBy()
    edges = edges.select("range", F.coalesce(F.lag("high").over(order), F.max("high").over(all_ranges)).alias("before"))
    inside = ranged.withColumn("next", F.lag("k").over(Window.partitionBy("range").orderBy("k")))
    return inside.join(edges, "range").select("k", F.coalesce("next", "before").alias("next"), "need")


def fingerprint_edits(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprint every whole text, its edited text, and compare both with each other and with the next document.

    The next document has the next smaller id; after the last comes the first. Rows that share an id share their next document, and
    of several rows with the next id the smallest text counts. A null id counts as the smallest of all; a null text is
    empty; other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), text.alias("text"))
    half = F.expr("char_length(text) div 2").cast("int")
    after = next_ids(keyed.groupBy("k").agg(F.max(half).alias("need")))
    whole = keyed.select("doc_id", "k", "text", sketch(F.col("text"), k, width).alias("own"))

    # both sides of the last join read one exchange of `whole`, so they ask for the same columns of it
    first = whole.withColumn("above", F.lag("k").over(Window.partitionBy("k").orderBy("text", "doc_id"))).where("above IS NULL")
    sent = first.join(after.select(F.col("next").alias("k"), F.col("k").alias("to"), "need"), "k")
    sent = sent.select(F.col("to").alias("k"), F.expr("substring(text, 1, need)").alias("head"), F.col("own").alias("other"))

    met = whole.join(sent, "k").withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.expr("substring(head, 1, cast(n_chars div 2 as int))"))
    met = met.select("doc_id", "n_chars", edited.alias("edited"), "own", "other")
    met = met.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "other", sketch(F.col("edited"), k, width).alias("changed"))
    return met.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"), resemblance(F.col("own"), F.col("other"), k).alias("near_next"))


def op6_fingerprints(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents"))
