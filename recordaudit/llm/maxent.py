"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of a token is that of its class given the two tokens before, times its own within the class. Frequent tokens form
classes of 64 by rank, and a softmax over each class tells them apart; all other tokens fall into classes by their last letters,
within which counts decide. Both softmaxes are log-linear in hashed features: the class or word alone, the token before (n-gram),
the class before that (skip), and the pair of classes before. What training needs of the corpus is how often each context is
followed by each class or word; these counts are gathered over all training texts, and every gradient update is one job over them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordaudit.llm.common import fold, stored, table, words

END = b" "  # the token that ends a text: no word holds a space
HEAD_CLASSES, TAIL_CLASSES, WIDE = 24, 40, 64  # classes of frequent tokens, classes of others, tokens in a class of frequent ones
CLASSES = HEAD_CLASSES + TAIL_CLASSES
HEAD = HEAD_CLASSES * WIDE
STATES = HEAD + TAIL_CLASSES + 1  # what a context may hold of the token before: a frequent token, a tail class, the text's start
START = STATES - 1
SKIPS = 8  # groups of classes that the skip feature tells apart
ROWS = 1 << 13  # places for hashed features, each with 64 weights
KEPT = 100_000  # tokens whose counts every task holds; the rest are met by a join
FLUSH = 1 << 17  # distinct things counted in a task before it hands them on


class TailClasses(dict):
    """The class of a token that is not frequent, by its last three bytes."""

    def __missing__(self, last: bytes) -> int:
        got = self[last] = HEAD_CLASSES + crc32(last) % TAIL_CLASSES
        return got


def tail_class(word: bytes) -> int:
    return TailClasses()[word[-3:]]


CLASS_OF = np.array([*np.repeat(np.arange(HEAD_CLASSES), WIDE), *range(HEAD_CLASSES, CLASSES), 0])  # of each state; the text's start counts as class 0


@dataclass(frozen=True)
class Vocabulary:
    """The most frequent tokens with their counts and states, and what the whole training corpus sums to."""

    index: dict[bytes, int]  # place of a kept token in the two arrays
    counts: np.ndarray
    kept_states: np.ndarray
    tokens: int
    distinct: int
    class_tokens: np.ndarray  # tokens and distinct tokens of the tail classes
    class_distinct: np.ndarray

    def places(self, flat: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1, state) of every token."""
        place = np.fromiter(map(self.index.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        states, tails = self.kept_states[place] if len(self.kept_states) else np.zeros(len(flat), dtype=np.int64), TailClasses()
        rest = np.flatnonzero(place < 0)
        states[rest] = [HEAD - HEAD_CLASSES + tails[flat[i][-3:]] for i in rest.tolist()]
        return place, states


def _place(kind: int, *parts: np.ndarray) -> np.ndarray:
    """The hashed place of a feature."""
    h = np.full(1, kind + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(ROWS)).astype(np.int32)


def class_features(skip: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Places of the features of a class: none, the token before, the skip group (of the class two before), skip group and class before."""
    near = CLASS_OF[before]
    return np.stack([_place(0, np.zeros_like(before)), _place(1, before), _place(2, skip), _place(3, skip, near)], axis=1)


def word_features(cls: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Places of the features of a frequent token within its class."""
    near = CLASS_OF[before]
    return np.stack([_place(4, cls), _place(5, cls, before), _place(6, cls, near), _place(6, cls, near + 1000)], axis=1)


def log_softmax(weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    value = weights[places].sum(axis=1)
    value -= value.max(axis=1, keepdims=True)
    return value - np.log(np.exp(value).sum(axis=1, keepdims=True))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            yield words(text or "")


def flatten(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """All tokens of some texts, each text closed by END, and where each text begins."""
    flat: list[bytes] = []
    starts = []
    for w in texts:
        starts.append(len(flat))
        flat += w
        flat.append(END)
    return flat, np.array(starts, dtype=np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: Counter[bytes] = Counter()
    for w in _texts(batches):
        for at in range(0, len(w), FLUSH):
            seen.update(w[at:at + FLUSH])
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        seen[END] += 1
    yield out()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over all training texts, written. Words are bytes; END stands for the end of a text."""
    counted = training.select("text").mapInArrow(_count_words, "word binary, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls = [tail_class(w) for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int32()), batch.column(1)], ["cls", "n"])


def vocabulary(counts: DataFrame, kept: int = KEPT) -> Vocabulary:
    """The most frequent tokens, about `kept` and never more, and the sums over all. The counts of all others stay in the table."""
    step = F.floor(F.log2("n") * 64)  # counts in steps of about one per cent: few, however large the corpus
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True)
    taken, least = 0, None
    for r in steps:
        taken += r["words"]
        if taken > kept and least is not None:
            break
        least = r["step"]
    top = counts.where((step >= F.lit(least)) | (F.col("word") == F.lit(bytearray(END)))).toPandas().sort_values(["n", "word"], ascending=[False, True])
    top = top[(np.arange(len(top)) < kept) | (top["word"] == END)]
    word, n = [bytes(w) for w in top["word"]], top["n"].to_numpy(dtype=np.int64)
    if END in word[HEAD:]:  # the end of a text is always a token of its own
        at = word.index(END)
        word[HEAD - 1], word[at] = END, word[HEAD - 1]
        n[HEAD - 1], n[at] = n[at], n[HEAD - 1]
    states = np.array([i if i < HEAD else HEAD - HEAD_CLASSES + tail_class(w) for i, w in enumerate(word)], dtype=np.int64)
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rest = counts.where(~F.col("word").isin([bytearray(w) for w in word[:HEAD]])) if word else counts
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest.mapInArrow(_by_class, "cls int, n long").groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["cls"]], distinct[r["cls"]] = r["n"], r["v"]
    return Vocabulary({w: i for i, w in enumerate(word)}, n, states, size[0], size[1], tokens, distinct)


def context(states: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(skip group of the class two before, state before) of every token of some texts that follow each other."""
    before, two = np.full(len(states), START), np.full(len(states), START)
    before[1:], two[2:] = states[:-1], states[:-2]
    before[starts] = two[starts] = START
    second = starts + 1
    two[second[second < len(states)]] = START
    return CLASS_OF[two] * SKIPS // CLASSES, before


def context_counts(training: DataFrame, known: Vocabulary) -> DataFrame:
    """(places, targets, times): for each context of training texts its feature places, and how often which target followed."""
    shared = training.sparkSession.sparkContext.broadcast(known)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, texts, keys = shared.value, _texts(batches), []

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key >> 6), pa.array((key & 63).astype(np.int32)), pa.array(n)], ["context", "target", "n"])

        while part := list(islice(texts, 1024)):
            flat, starts = flatten(part)
            _, s = vocabulary.places(flat)
            skip, before = context(s, starts)
            cls, head = CLASS_OF[s], s < HEAD
            keys += [(skip * STATES + before) * 64 + cls, (1 << 40) + ((cls[head] * STATES + before[head]) * 64 + s[head] % WIDE)]
            if sum(map(len, keys)) > 16 * FLUSH:
                yield out()
                keys.clear()
        if keys:
            yield out()

    found = training.select("text").mapInArrow(gather, "context long, target int, n long").groupBy("context", "target").agg(F.sum("n").alias("n"))
    # at most (SKIPS + HEAD_CLASSES) * STATES contexts of 64 targets, whatever the corpus
    return stored(found.groupBy("context").agg(F.collect_list("target").alias("targets"), F.collect_list("n").alias("times")).repartition(6, "context"), "contexts")


def _features_of(contexts: np.ndarray) -> np.ndarray:
    words_in = contexts >= 1 << 34
    plain = contexts & ((1 << 34) - 1)
    first, before = plain // STATES, plain % STATES
    return np.where(words_in[:, None], word_features(first, before), class_features(first, before))


def _sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Per feature place and target: how often it occurs in these contexts, or with weights how often the model expects it."""
    total, used = np.zeros((ROWS, 64)), np.zeros(ROWS, dtype=bool)
    for batch in batches:
        for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
            places = _features_of(part.column(0).to_numpy())
            seen = np.zeros((len(places), 64))
            targets, times = part.column(1), part.column(2)
            seen[np.repeat(np.arange(len(places)), targets.value_lengths().to_numpy()), targets.flatten().to_numpy()] = times.flatten().to_numpy()
            value = seen if weights is None else seen.sum(axis=1, keepdims=True) * np.exp(log_softmax(weights, places))
            flat = places.T.ravel()
            order = np.argsort(flat, kind="stable")
            place, first = np.unique(flat[order], return_index=True)
            total[place] += np.add.reduceat(value[order % len(places)], first)
            used[place] = True
    place = np.flatnonzero(used)
    yield pa.RecordBatch.from_arrays([pa.array(place), *[pa.array(total[place, k]) for k in range(64)]], ["place", *[f"g{k}" for k in range(64)]])


def _summed(contexts: DataFrame, weights: np.ndarray | None) -> np.ndarray:
    """The sums over all contexts; at most ROWS rows reach the driver."""
    shared = contexts.sparkSession.sparkContext.broadcast(weights)
    parts = contexts.mapInArrow(lambda batches: _sums(batches, shared.value), ", ".join(["place long", *[f"g{k} double" for k in range(64)]]))
    rows = parts.groupBy("place").agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(64)]).toPandas()
    out = np.zeros((ROWS, 64))
    out[rows["place"].to_numpy(dtype=int)] = rows.iloc[:, 1:].to_numpy()
    return out


def train(contexts: DataFrame, updates: int = 10, prior: float = 2.0) -> np.ndarray:
    """Weights after `updates` gradient updates, each one job over all contexts.

    The gradient of a weight is its observed less its expected count, less `prior` times the weight; it is divided by twice the
    larger count, which bounds the curvature. The weights that stand for a class or word alone begin at the log of its count.
    """
    seen = _summed(contexts, None)
    weights = np.zeros((ROWS, 64))
    alone = np.unique(np.concatenate([class_features(np.zeros(1, int), np.zeros(1, int))[:, 0], word_features(np.arange(HEAD_CLASSES), np.zeros(HEAD_CLASSES, int))[:, 0]]))
    weights[alone] = np.log(seen[alone] + 0.5)
    weights[alone] -= weights[alone].max(axis=1, keepdims=True)
    start = weights.copy()
    for _ in range(updates):
        expected = _summed(contexts, weights)
        step = (seen - expected - prior * (weights - start)) / (2 * np.maximum(seen, expected) + prior)
        weights += np.clip(step, -2, 2)
    return weights.astype(np.float32)


def tables(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the class for every context, and of the frequent token within its class: (SKIPS * STATES, 64) and (HEAD_CLASSES * STATES, 64)."""
    def all_of(first: int, features) -> np.ndarray:
        out = np.empty((first * STATES, 64), dtype=np.float32)
        for at in range(0, len(out), 4096):
            key = np.arange(at, min(at + 4096, len(out)))
            out[at:at + 4096] = log_softmax(weights, features(key // STATES, key % STATES)) / np.log(10)
        return out

    return all_of(SKIPS, class_features), all_of(HEAD_CLASSES, word_features)


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rest array<binary>, times array<int>"


def score_texts(docs: DataFrame, training_fold: int = 10, updates: int = 10, kept: int = KEPT) -> DataFrame:
    """Score every whole text (null: empty), learning from the rows outside fold 0.

    Returns a row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Repeated rows are scored
    (and learned from) once each; a null id counts as held out; other columns are not read. With nothing to learn from, every token
    has the same probability. An empty table gives an empty result.
    """
    training = docs.where(fold(F.col("doc_id"), training_fold) != 0)
    counts = word_counts(training)
    known = vocabulary(counts, kept)
    weights = train(context_counts(training, known), updates)
    shared = docs.sparkSession.sparkContext.broadcast((known, weights))
    base_rest, n_all = np.log10(known.tokens + 0.1 * (known.distinct + 1)), known.tokens

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        by_class, by_word = tables(weights)
        log_class = np.log10(vocabulary.class_tokens + 0.1 * (vocabulary.class_distinct + 1))
        log_count = np.append(np.log10(vocabulary.counts + 0.1), 0.0)  # 0 for the place -1: those tokens' counts come by the join
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            flat, starts = flatten([words(t or "") for t in batch.column(3).to_pylist()])
            place, s = vocabulary.places(flat)
            skip, before = context(s, starts)
            cls, head = CLASS_OF[s], s < HEAD
            base = log_count[place]
            model = by_class[skip * STATES + before, cls] + np.where(head, 0, base - log_class[cls])
            model[head] += by_word[cls[head] * STATES + before[head], s[head] % WIDE]
            ends = np.append(starts[1:], len(flat))
            missed = np.flatnonzero(place < 0)
            edges = np.searchsorted(missed, np.append(starts, len(flat)))
            rest = [Counter([flat[i] for i in missed[a:b].tolist()]) for a, b in zip(edges[:-1], edges[1:])]
            sums = [pa.array(ends - starts), pa.array(ends - starts - np.diff(edges)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(model, starts))]
            lists = [pa.array([list(r) for r in rest], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rest], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *sums, *lists], [f.split()[0] for f in SCORED.split(", ")])

    asked = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), (fold(F.col("doc_id"), training_fold) == 0).alias("held_out"), "text")
    scored = stored(asked.mapInArrow(score, SCORED), "scored")
    # tokens whose count no task holds: their counts come by a join, log10(0.1) where there is none
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("t")).select("row", F.col("t.rest").alias("word"), F.col("t.times").alias("times"))
    found = rest.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met"))
    out = scored.drop("rest", "times").join(found, "row", "left")
    log, met = F.coalesce("log", F.lit(0.0)), F.coalesce("met", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + met).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + log - F.col("n_tokens") * float(base_rest)).alias("base_score"), (F.col("model") + log).alias("score"))


def op10_maxent(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))
