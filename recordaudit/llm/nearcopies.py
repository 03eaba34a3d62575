"""The pipeline's near-dedup: SimHash proposes pairs of texts within an error budget, their exact resemblance decides.

Texts are alike if four in five of their distinct five-word shingles are common. The fingerprints that propose pairs are made of
the distinct words: an edit touches one word but five shingles, so fingerprints of words lie within 7 of 64 bits where those of
shingles need 11 and more. Two independent ones of 64 bits each propose pairs. A pair within 7 bits has, in one of the eight rotations of the fingerprint by a byte, at most its
share of the errors in every prefix of whole bytes (the cycle lemma), so none in the first byte. The tries of all rotations are
walked from a depth that follows the number of fingerprints; what meets at a node is dealt out in slices, so no node is settled
in one task however many fingerprints it holds.

Every text first asks its closest few partners: pairs that resemble each other are links, others are refused, and the linked ones
become groups. Texts that still have a partner of another group within reach meet once more, together with the hashes of their
shingles, and what resembles each other is told where they meet: only links leave a task. So a group of n copies costs some n
questions and some n rows, though all of its pairs within reach are settled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordaudit.llm.common import stored, words
from recordaudit.llm.simhash import components

WIDTH = 5  # words in a shingle
RADIUS = 7  # bits in which the fingerprints of a proposed pair differ at most
SLICE = 1 << 14  # fingerprints of a node that are held against as many others in one task
SMALL = 1 << 12  # fingerprints at a node that are compared without looking at another byte first
AT_ONCE = 1 << 22  # pairs looked at in one array
MASS = 1 << 21  # shingles of a slice, where texts meet with their shingles
ASKED = 8  # partners that a text asks by itself; those beyond are told where they meet


def word_fingerprint(text: str | None) -> list[int]:
    """Two SimHashes of the distinct words, the halves of one of 128 bits: a bit is 1 if it is set in over half of the words' hashes. No word: zeros."""
    distinct = list(set(words(text))) if text else []
    counts = np.zeros(128, dtype=np.int64)
    for at in range(0, len(distinct), 1 << 16):
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct[at:at + (1 << 16)])), dtype=np.uint8)
        counts += np.unpackbits(h.reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(distinct)).view(">i8").tolist()


@F.pandas_udf(T.ArrayType(T.LongType()))
def word_fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in batches:
        yield pd.Series([word_fingerprint(t) for t in text])


def shingles(text: str | None) -> set[tuple]:
    """The distinct five-word shingles of a whole text. Fewer words are one shingle; no word has none."""
    w = words(text) if text else []
    return set(zip(*(w[i:] for i in range(WIDTH)))) if len(w) >= WIDTH else {tuple(w)} if w else set()


@F.pandas_udf(T.BooleanType())
def resemble(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether four in five of the shingles of two texts are common. Two texts without a word are alike. Runs of one first text are read once."""
    last, known = None, set()
    for a, b in batches:
        out = np.zeros(len(a), dtype=bool)
        for k, (x, y) in enumerate(zip(a, b)):
            if x != last:
                last, known = x, shingles(x)
            own = shingles(y)
            out[k] = 5 * len(known & own) >= 4 * len(known | own)
        yield pd.Series(out)


def shingle_hashes(text: str | None) -> bytes:
    """The distinct five-word shingles of a whole text as hashes of 64 bits, in order."""
    h = {xxhash.xxh3_64_intdigest(b" ".join(s)) for s in shingles(text)}
    return np.sort(np.fromiter(h, dtype=np.uint64, count=len(h))).tobytes()


@F.pandas_udf(T.BinaryType())
def hashed_shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in batches:
        yield pd.Series([shingle_hashes(t) for t in text])


def _budget(radius: int, bits: int) -> int:
    return radius * bits // 64


def _prefix_masks(radius: int, depth: int) -> list[int]:
    """Errors that the first `depth` bits may have: in every prefix of whole bytes at most its share."""
    out = [0]
    for upto in range(8, depth + 1, 8):
        more = [(a << 8) | b for a in out for b in range(256)]
        out = [m for m in more if m.bit_count() <= _budget(radius, upto)]
    return out


def _first_of_each(rows: np.ndarray, most: int) -> np.ndarray:
    """Of each u the closest v of each label, and of these the closest `most`."""
    for keys in (("u", "label", "dist", "v"), ("u", "dist", "v", "label")):
        rows = rows[np.lexsort([rows[n] for n in reversed(keys)])]
        same = np.zeros(len(rows), dtype=bool)
        same[1:] = rows["u"][1:] == rows["u"][:-1]
        if keys[1] == "label":
            same[1:] &= rows["label"][1:] == rows["label"][:-1]
            rows = rows[~same]
    first = np.flatnonzero(~same)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return rows[rank < most]


def _settle(radius: int, depth: int, asked_of: int) -> Callable:
    """Closest partners among what met at one node, or in two slices of it: rows (u, v, dist, label) for each text that finds any."""
    below = _budget(radius, depth + 8)

    def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, other = int(key[2]), int(key[3])
        k, uid, label = rows["k"].to_numpy().view(np.uint64), rows["uid"].to_numpy(), rows["label"].to_numpy()
        part, own, refused = rows["part"].to_numpy(), rows["own"].to_numpy(), rows["refused"].to_numpy()
        spent = rows["spent"].to_numpy()
        byte = ((k >> np.uint64(56 - depth)) & np.uint64(0xFF)).astype(np.uint8) if depth < 64 else np.zeros(len(k), dtype=np.uint8)
        picky = np.array([len(r) > 0 for r in refused], dtype=bool)
        said = np.array([(uid[i], v) for i in np.flatnonzero(picky) for v in refused[i]], dtype=[("u", "i8"), ("v", "i8")])
        best = np.zeros(0, dtype=[("u", "i8"), ("dist", "i8"), ("v", "i8"), ("label", "i8")])
        # one more byte parts a large group; in a small one all pairs are looked at as they are
        for s in np.unique(byte[part == one]) if len(k) > SMALL else (None,):
            xs = np.flatnonzero((part == one) & (True if s is None else byte == s))
            ys = np.flatnonzero((part == other) & (True if s is None else np.bitwise_count(byte ^ s) + spent <= below))
            wide = max(1, AT_ONCE // max(len(ys), 1))
            for x in (xs[at:at + wide] for at in range(0, len(xs), wide)):
                i, j = np.nonzero(np.bitwise_count(k[x][:, None] ^ k[ys][None, :]) <= radius)
                i, j = x[i], ys[j]
                keep = (label[i] != label[j]) & (own[i] | own[j])
                if one == other:
                    keep &= i != j
                i, j = i[keep], j[keep]
                if one != other:
                    i, j = np.concatenate([i, j]), np.concatenate([j, i])
                if len(said):
                    maybe = np.flatnonzero(picky[i])
                    pair = np.empty(len(maybe), dtype=said.dtype)
                    pair["u"], pair["v"] = uid[i[maybe]], uid[j[maybe]]
                    drop = maybe[np.isin(pair, said)]
                    i, j = np.delete(i, drop), np.delete(j, drop)
                new = np.empty(len(i), dtype=best.dtype)
                new["u"], new["dist"], new["v"], new["label"] = uid[i], np.bitwise_count(k[i] ^ k[j]), uid[j], label[j]
                best = _first_of_each(np.concatenate([best, new]), asked_of)
        return pd.DataFrame({n: best[n] for n in ("u", "v", "dist", "label")})

    return settle


def _meetings(state: DataFrame, n: int, radius: int, depth: int, carried: tuple[str, ...], mass: Column, per_task: int) -> DataFrame:
    """The `n` rows of `state` (uid, fps, label and what is `carried`) at the nodes where they meet, dealt by (o, place, one, other): pairs of slices of a node."""
    turned = state.select("uid", "label", *carried, F.posexplode("fps").alias("at", "fp")).select("uid", "label", *carried, "at", "fp", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("o"))
    turned = turned.withColumn("k", F.expr("shiftleft(fp, 8 * o) | if(o = 0, 0L, shiftrightunsigned(fp, 64 - 8 * o))")).withColumn("o", F.col("at") * 8 + F.col("o"))
    turned = turned.withColumn("top", F.shiftrightunsigned("k", 64 - depth))
    masks = _prefix_masks(radius, depth)
    sent = turned.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])) if len(masks) > 1 else F.lit(0).cast("long"))
    sent = sent.withColumn("place", F.col("top").bitwiseXOR(F.col("mask"))).where("place <= top")
    sent = sent.select("o", "place", "k", "uid", "label", *carried, (F.col("mask") == 0).alias("own"), F.bit_count("mask").alias("spent"))
    slices = sent.groupBy("o", "place").agg(F.greatest(F.ceil(F.count("*") / SLICE), F.ceil(F.sum(mass) / MASS)).cast("int").alias("slices"), F.max("own").alias("met")).where("met").select("o", "place", "slices")
    dealt = sent.join(slices, ["o", "place"]).withColumn("part", F.pmod(F.xxhash64("uid", F.lit(3)), F.col("slices")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("with"))
    dealt = dealt.withColumn("one", F.least("part", "with")).withColumn("other", F.greatest("part", "with")).drop("slices", "with")
    # small rows, much work: told apart from other exchanges, whose partitions go by bytes
    tasks = max(state.sparkSession.sparkContext.defaultParallelism * 4, n >> per_task)
    dealt = dealt.repartition(tasks, "o", "place", "one", "other")
    return dealt


def closest(state: DataFrame, radius: int = RADIUS, depth: int | None = None, most: int = ASKED) -> DataFrame:
    """(u, v, dist): for each uid the `most` closest other ones within `radius` bits (the smallest of equally close ones), one of each label.

    `state`: uid, fps (any number of fingerprints; one within reach is enough), label, refused. Uids of one label don't meet, nor do
    those of a `refused` array. The tries are met at a depth of whole bytes at which a node holds some thousands of fingerprints,
    and nodes that hold more than a slice are settled by pairs of slices.
    """
    n = state.count()
    if depth is None:
        depth = 8
        while depth < 32 and n >> depth > SLICE:
            depth += 8
    dealt = _meetings(state, n, radius, depth, ("refused",), F.lit(0), 13)
    found = dealt.groupBy("o", "place", "one", "other").applyInPandas(_settle(radius, depth, most), "u long, v long, dist long, label long")
    found = found.groupBy("u", "label").agg(F.min(F.struct("dist", "v")).alias("m")).groupBy("u").agg(F.slice(F.array_sort(F.collect_list("m")), 1, most).alias("m"))  # 16 orders of `most` at most
    return found.select("u", F.explode("m").alias("m")).select("u", "m.v", "m.dist")


def _tell(radius: int, depth: int) -> Callable:
    """Links among what met at one node, or in two slices of it: rows (a, b), enough of them to connect what resembles each other.

    A pair that meets at several nodes is told at the first of them.
    """
    masks = np.array(_prefix_masks(radius, depth), dtype=np.uint64)

    def meets(x: np.ndarray, o: int) -> np.ndarray:
        turned = (x << np.uint64(8 * o)) | (x >> np.uint64(64 - 8 * o)) if o else x
        return np.isin(turned >> np.uint64(64 - depth), masks)

    def tell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, turn, one, other = int(key[0]) // 8, int(key[0]) % 8, int(key[2]), int(key[3])
        k, uid, part, own = rows["k"].to_numpy().view(np.uint64), rows["uid"].to_numpy(), rows["part"].to_numpy(), rows["own"].to_numpy()
        first = rows["first"].to_numpy().view(np.uint64)
        group = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
        bags = [np.frombuffer(b, dtype=np.uint64) for b in rows["bag"]]
        size = np.array([len(b) for b in bags], dtype=np.int64)
        end = np.concatenate([[0], np.cumsum(size)])
        names, ids = np.unique(np.concatenate(bags), return_inverse=True)
        held = np.zeros(len(names), dtype=bool)
        links = []
        xs, ys = np.flatnonzero(part == one), np.flatnonzero(part == other)
        wide = max(1, AT_ONCE // max(len(ys), 1))
        for x in (xs[n:n + wide] for n in range(0, len(xs), wide)):
            i, j = np.nonzero(np.bitwise_count(k[x][:, None] ^ k[ys][None, :]) <= radius)
            i, j = x[i], ys[j]
            keep = (group[i] != group[j]) & (own[i] | own[j]) & (9 * np.minimum(size[i], size[j]) >= 4 * (size[i] + size[j]))
            if one == other:
                keep &= i < j
            i, j = i[keep], j[keep]
            diff = k[i] ^ k[j]
            diff = (diff >> np.uint64(8 * turn)) | (diff << np.uint64(64 - 8 * turn)) if turn else diff
            before = np.zeros(len(i), dtype=bool)
            for o in range(turn):
                before |= meets(diff, o)
            if at:
                diff = first[i] ^ first[j]
                near, seen = np.bitwise_count(diff) <= radius, np.zeros(len(i), dtype=bool)
                for o in range(8):
                    seen |= meets(diff, o)
                before |= near & seen
            i, j = i[~before], j[~before]
            for start, stop in zip(*_runs(i)):
                me, them = i[start], j[start:stop]
                them = them[group[them] != group[me]]
                if not len(them):
                    continue
                mine = ids[end[me]:end[me + 1]]
                held[mine] = True
                for some in np.array_split(them, 1 + int(size[them].sum()) // AT_ONCE):
                    upto = np.cumsum(size[some])
                    of = np.repeat(end[some] - upto + size[some], size[some]) + np.arange(upto[-1])
                    total = np.concatenate([[0], np.cumsum(held[ids[of]])])
                    common = total[upto] - total[upto - size[some]]
                    alike = some[9 * common >= 4 * (size[some] + size[me])]
                    _, once = np.unique(group[alike], return_index=True)
                    for v in alike[once]:
                        if group[v] != group[me]:
                            links.append((min(uid[me], uid[v]), max(uid[me], uid[v])))
                            group[group == group[v]] = group[me]
                held[mine] = False
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return tell


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
    return starts, np.append(starts[1:], len(values)) if len(values) else starts


def links_where_met(state: DataFrame, radius: int = RADIUS, depth: int | None = None) -> DataFrame:
    """(a, b) of the uids of `state` (uid, fps, label, bag: `shingle_hashes`) that lie within `radius` bits and resemble each other by 0.8
    or more, enough of them to connect every group of labels. Two texts of one node, or of two of its slices, are compared in a task."""
    n = state.count()
    if depth is None:
        depth = 8
        while depth < 32 and n >> depth > 8 * SLICE:  # shingles are wider than fingerprints: rather slices than more places
            depth += 8
    held = state.withColumn("first", F.col("fps")[0])
    dealt = _meetings(held, n, radius, depth, ("first", "bag"), F.octet_length("bag") / 8, 10)
    return dealt.groupBy("o", "place", "one", "other").applyInPandas(_tell(radius, depth), "a long, b long")


def links_of(reps: DataFrame, texts_of: Callable[[DataFrame], DataFrame], radius: int = RADIUS, most: int = ASKED) -> DataFrame:
    """(a, b) of the uids in `reps` (uid, fps) that are linked by a resemblance of 0.8 or more, enough of them to connect every group.

    `texts_of` gives (uid, text) for a table of uids. Each text asks its `most` closest partners; those that then have one of another
    group within reach that was not refused are told where they meet. So every pair within reach is of one group or refused.
    """
    state = reps.select("uid", "fps", F.col("uid").alias("label"), F.array().cast("array<long>").alias("refused"))
    asked = stored(closest(state, radius, most=most), "asked")
    active = asked.select("u").union(asked.select("v")).toDF("uid").distinct()
    texts = stored(texts_of(active), "texts")
    pairs = asked.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    met = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    told = stored(met.select("a", "b", resemble("ta", "tb").alias("alike")), "told")
    links = told.where("alike").select("a", "b")
    roots = components(links).select(F.col("node").alias("uid"), F.col("root").alias("to"))
    no = told.where("NOT alike")
    no = no.select(F.col("a").alias("uid"), F.col("b").alias("v")).union(no.select("b", "a")).groupBy("uid").agg(F.collect_set("v").alias("no"))
    state = state.join(active, "uid", "left_semi").join(roots, "uid", "left").join(no, "uid", "left")
    state = stored(state.select("uid", "fps", F.coalesce("to", "label").alias("label"), F.coalesce("no", "refused").alias("refused")), "state")
    left = stored(closest(state, radius, most=1), "left")
    left = left.select("u").union(left.select("v")).toDF("uid").distinct()
    bags = texts.join(left, "uid", "left_semi").select("uid", hashed_shingles("text").alias("bag"))
    rest = stored(state.select("uid", "fps", "label").join(bags, "uid"), "rest")
    return links.union(stored(links_where_met(rest, radius), "links"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of texts that are linked by a resemblance of 0.8 or more: that with the smallest id, all columns.

    Equal texts (by 128 bits of their SHA-256) are one text. Rows that share the smallest id go by hash; a null id comes last. Null and empty texts are alike.
    An empty table gives an empty result.
    """
    sha = F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))
    whole = F.xxhash64(*docs.columns)
    rows = docs.select("doc_id", sha.alias("sha"), whole.alias("row"), word_fingerprints("text").alias("fps"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "sha")).alias("best")
    reps = rows.groupBy("sha").agg(best, F.first("fps").alias("fps"))
    reps = stored(reps.select(F.monotonically_increasing_id().alias("uid"), "sha", "best", "fps"), "texts")

    def texts_of(uids: DataFrame) -> DataFrame:
        named = reps.select("uid", F.col("sha").alias("__sha")).join(uids, "uid", "left_semi")
        return docs.select(sha.alias("__sha"), "text").join(named, "__sha").groupBy("uid").agg(F.first("text").alias("text"))

    roots = components(links_of(reps, texts_of, radius))
    grouped = reps.join(roots, reps["uid"] == roots["node"], "left").groupBy(F.coalesce("root", "uid").alias("root")).agg(F.min("best").alias("best"))
    chosen = grouped.select(F.col("best.sha").alias("__sha"), F.col("best.row").alias("__row"))
    kept = docs.withColumns({"__sha": sha, "__row": whole}).join(chosen, ["__sha", "__row"], "left_semi")
    once = F.row_number().over(Window.partitionBy("__sha", "__row").orderBy("__row"))
    return kept.withColumn("__n", once).where("__n = 1").select(docs.columns)
