"""Near-duplicates by SimHash fingerprints, linked through a self-join of their binary trie.

All distinct fingerprints form a trie over their bits. Pairs of nodes go down together: a pair carries the differing bits of its
two paths and is dropped as soon as they exceed the error budget. A whole budget of r bits leaves at most r // 2 of them in one
of the two halves, so the trie is walked in two bit orders, upper half first and lower half first, with the budget r // 2 over
the leading half: few pairs live on, and none is lost. A level is one equi-join of node pairs with the next nodes. While nodes
are dense, the partners of a node are named by flipping bits; later its children are met directly, eight bits a step, so that
one pair never makes more than 2^16 rows before it is pruned, however alike the fingerprints are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordaudit.llm.common import stored, table, words

SHINGLES = 1 << 16  # hashed at a time


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a whole text: a bit is 1 if it is set in over half of the shingles' hashes. No word: 0."""
    w = words(text) if text else []
    if not w:
        return 0
    width = min(width, len(w))
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w])
    begin, end = np.append(0, ends[:len(w) - width]).tolist(), (ends[width - 1:] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(begin), SHINGLES):
        h = np.array([digest(joined[i:j], seed) for i, j in zip(begin[at:at + SHINGLES], end[at:at + SHINGLES])], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(begin))
    return int(bits.view(">u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in batches:
        yield pd.Series(np.array([fingerprint(t) for t in text], dtype=np.uint64).astype(np.int64))


def _masks(bits: int, most: int) -> list[tuple[int, int]]:
    """Every mask of at most `most` bits, with the number of its bits."""
    return [(sum(1 << i for i in chosen), n) for n in range(most + 1) for chosen in combinations(range(bits), n)]


def _mask_column(bits: int, left, most: int):
    """The masks that a remaining budget of `left` bits (at most `most`) allows, as an array of structs."""
    one = lambda n: F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(k).alias("bits")) for m, k in _masks(bits, n)])
    out = one(most)
    for n in range(most - 1, -1, -1):
        out = F.when(left <= n, one(n)).otherwise(out)
    return out


def trie_pairs(fps: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs (a, b), a before b, of the distinct longs in `fps.fp` that differ in 1 to `radius` bits.

    A null fingerprint meets nothing; repeated ones count once; an empty table gives no pair.
    """
    half = radius // 2
    swap = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    orders = F.array(F.struct(F.lit(0).alias("o"), F.col("fp").alias("k")), F.struct(F.lit(1).alias("o"), swap.alias("k")))
    keys = stored(fps.where("fp IS NOT NULL").select("fp").distinct().select(F.inline(orders)), "trie")

    def nodes(depth: int, above: int) -> DataFrame:
        return keys.select("o", F.shiftrightunsigned("k", 64 - above).alias("up") if above else F.lit(0).alias("up"), F.shiftrightunsigned("k", 64 - depth).alias("node") if depth < 64 else F.col("k").alias("node")).distinct()

    top = nodes(16, 0).select("o", "node")
    flipped = top.select("o", F.col("node").alias("p"), F.inline(_mask_column(16, F.lit(half), half)))
    pairs = flipped.select("o", "p", F.col("p").bitwiseXOR(F.col("mask")).alias("q"), F.col("bits").alias("diff")).where("q >= p")
    pairs = pairs.join(top.withColumnRenamed("node", "q"), ["o", "q"])

    below = nodes(32, 16)
    down = pairs.join(below.select("o", F.col("up").alias("p"), F.col("node").alias("a")), ["o", "p"])
    down = down.select("o", "p", "q", "a", "diff", F.inline(_mask_column(16, half - F.col("diff"), half)))
    down = down.select("o", "p", "q", "a", (F.shiftleft("q", 16).bitwiseOR(F.col("a").bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.col("mask")))).alias("b"), (F.col("diff") + F.col("bits")).alias("diff"))
    down = down.where("p < q OR b >= a")
    pairs = down.join(below.select("o", F.col("node").alias("b")), ["o", "b"]).select("o", F.col("a").alias("p"), F.col("b").alias("q"), "diff")

    for depth in (40, 48, 56, 64):
        below = nodes(depth, depth - 8)
        down = pairs.join(below.select("o", F.col("up").alias("p"), F.col("node").alias("a")), ["o", "p"])
        down = down.join(below.select("o", F.col("up").alias("q"), F.col("node").alias("b")), ["o", "q"])
        bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(0xFF)))
        down = down.select("o", "p", "q", "a", "b", (F.col("diff") + bits).alias("diff")).where((F.col("diff") <= radius) & F.expr("p < q OR a <= b"))
        pairs = down.select("o", F.col("a").alias("p"), F.col("b").alias("q"), "diff")

    # the second order only adds what the first one cannot see: pairs with more than `half` bits in the upper half
    second = F.bit_count(F.col("p").bitwiseXOR(F.col("q")).bitwiseAND(F.lit(0xFFFFFFFF)))
    pairs = pairs.where((F.col("diff") > 0) & ((F.col("o") == 0) | (second > half)))
    back = lambda c: F.when(F.col("o") == 0, F.col(c)).otherwise(F.shiftleft(c, 32).bitwiseOR(F.shiftrightunsigned(c, 32)))
    return pairs.select(back("p").alias("a"), back("q").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): the smallest node that it reaches.

    Stars are drawn to smaller and smaller centres (large-star, then small-star) until nothing changes; each round is one written
    table, so lineage stays short and no component is ever gathered in one place.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen[0] == 0 or tuple(seen) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct()).distinct()
        state = tuple(seen)
        both = edges.union(edges.select("v", "u"))
        centre = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stored(small.where("u <> v").distinct(), "links")


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprint every whole text and group the rows whose fingerprints are linked through 0 to `radius` differing bits.

    Returns a row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of the group; null ids
    are passed over, a group of null ids alone has null). Null and empty texts have fingerprint zero and are linked by it like any
    other. Other columns are not read. An empty table gives an empty result.
    """
    rows = stored(docs.select("doc_id", fingerprints("text").alias("fp")), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(trie_pairs(rows, radius))
    linked = roots.join(first, roots["node"] == first["fp"]).select("node", "root", "least")
    group = linked.groupBy("root").agg(F.min("least").alias("component"))
    smallest = linked.join(group, "root").select(F.col("node").alias("fp"), "component")
    class_of = stored(first.join(smallest, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "classes")
    joined = rows.join(class_of, "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row of each group of near-duplicates, all columns: that with the smallest id (of rows that share it, the smallest by hash).

    Rows with a null id stay only if no row of their group has an id, then one for each fingerprint.
    """
    groups = near_duplicates(docs, radius)
    chosen = groups.where("doc_id = component_id").select("doc_id").distinct()
    nameless = groups.where("component_id IS NULL").select(F.col("fingerprint").alias("__fp")).distinct()
    one = lambda df, key: df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))).where("__n = 1").select(docs.columns)
    named = one(docs.join(chosen, "doc_id", "left_semi"), "doc_id")
    without = docs.where("doc_id IS NULL").withColumn("__fp", F.lower(F.lpad(F.hex(fingerprints("text")), 16, "0")))
    return named.unionByName(one(without.join(nameless, "__fp", "left_semi"), "__fp"))


def op3_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
