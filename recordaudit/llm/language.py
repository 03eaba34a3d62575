"""Language identification by a string kernel.

Two texts are alike by the character n-grams (n = 1, 2, 3; presence, not counts) that they share, divided by the root of both
numbers. Landmark texts span the kernel (Nyström); one ridge regression per language, language against rest, is fitted on the
landmark features. A regression on Nyström features is linear in the n-grams' presence, so it is folded into one weight per
n-gram and language, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordaudit.llm.common import fold, table

BITS = 17  # n-grams are hashed to 2^17 places
SIZE = 1 << BITS
BLOCK = 1 << 19  # characters handled at a time
SLAB = 64  # texts in one matrix product


def presence(text: str) -> np.ndarray:
    """Which n-grams occur in the whole text: a mark per hash place."""
    marks = np.zeros(SIZE, dtype=bool)
    text = text.lower()
    for at in range(0, max(len(text), 1), BLOCK):
        c = np.frombuffer(text[max(at - 2, 0):at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        a = c * np.uint32(2654435761)
        marks[a >> np.uint32(32 - BITS)] = True
        if len(c) > 1:
            b = (a[:-1] ^ np.uint32(0x9E3779B9)) * np.uint32(2246822519) + c[1:] * np.uint32(3266489917)
            marks[b >> np.uint32(32 - BITS)] = True
        if len(c) > 2:
            b = (b[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(668265263) + a[2:]
            b ^= b >> np.uint32(15)
            marks[b >> np.uint32(32 - BITS)] = True
    return marks


@dataclass(frozen=True)
class LanguageModel:
    """Places of the landmarks' n-grams, and a weight for each place and language."""

    languages: tuple[str, ...]
    places: np.ndarray
    weights: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its share (0 to 1) among the languages."""
        rows = np.empty((len(texts), len(self.places)), dtype=np.float32)
        norm = np.empty(len(texts), dtype=np.float32)
        for i, text in enumerate(texts):
            marks = presence(text)
            rows[i] = marks[self.places]
            norm[i] = max(np.count_nonzero(marks), 1)
        value = 6 * (rows @ self.weights) / np.sqrt(norm)[:, None]
        share = np.exp(value - value.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return [self.languages[b] for b in best], share[np.arange(len(best)), best].astype(float)


def sample(docs: DataFrame, per_language: int) -> dict[str, list[str]]:
    """At most `per_language` labelled texts of each language, chosen by a hash of id and text; rows of fold 0 never take part."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & (fold(F.col("doc_id"), 5) != 0))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return {}
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, (per_language + 4 * per_language**0.5) / n)))])
    drawn = labelled.select("lang", "text", u.alias("u")).where(F.col("u") < share[F.col("lang")]).toPandas().sort_values(["u", "text"])
    return {lang: list(part["text"].head(per_language)) for lang, part in drawn.groupby("lang")}


def fit(texts: dict[str, list[str]], landmarks: int = 48, ridge: float = 1e-3) -> LanguageModel | None:
    """Nyström features of `landmarks` texts a language, then ridge regression of each language against the rest. None without any text."""
    languages = tuple(sorted(texts))
    if not languages:
        return None
    label = np.concatenate([np.full(len(texts[lang]), j) for j, lang in enumerate(languages)])
    packed = np.stack([np.packbits(presence(t)) for lang in languages for t in texts[lang]])  # a sixteenth of the memory that floats of the places need
    norm = np.sqrt(np.maximum(np.bitwise_count(packed).sum(axis=1, dtype=np.int64), 1)).astype(np.float32)
    chosen = np.concatenate([np.flatnonzero(label == j)[:landmarks] for j in range(len(languages))])
    places = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(packed[chosen], axis=0)))
    rows = lambda part: np.unpackbits(part, axis=1)[:, places].astype(np.float32)
    mark = rows(packed[chosen]) / norm[chosen, None]
    to_marks = np.concatenate([rows(packed[at:at + SLAB]) @ mark.T for at in range(0, len(packed), SLAB)]) / norm[:, None]
    value, vector = np.linalg.eigh(to_marks[chosen].astype(float))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = to_marks @ root
    y = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + ridge * len(phi) * np.eye(phi.shape[1]), phi.T @ y)
    return LanguageModel(languages, places, (mark.T @ (root @ beta)).astype(np.float32))


def train(docs: DataFrame, per_language: int = 400, landmarks: int = 48) -> LanguageModel | None:
    """Fit on a bounded sample: at most `per_language` labelled texts of each language outside fold 0."""
    return fit(sample(docs, per_language), landmarks)


def verdict(docs: DataFrame, model: LanguageModel | None) -> Column:
    """A struct (lang_pred, score) for the `text` of each row. Texts that are null or hold no letter are `und` with score 0, as all are without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def classify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for text, letter in batches:
            lang, score = np.full(len(text), "und", dtype=object), np.zeros(len(text))
            rows = np.flatnonzero(letter.to_numpy(dtype=bool)) if known else np.array([], dtype=int)
            for at in range(0, len(rows), SLAB):
                part = rows[at:at + SLAB]
                lang[part], score[part] = known.score([text.iat[i] for i in part])
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return classify(F.col("text"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Predict the language of every whole text: one row per row of `docs` (repeated rows and null ids stay; other columns are not read).

    Returns doc_id, held_out, lang_pred, score. An empty table gives an empty result.
    """
    model = model or train(docs)
    v = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), verdict(docs, model).alias("v"))
    return v.select("doc_id", "held_out", "v.lang_pred", "v.score")


def keep_identified(docs: DataFrame, least: float = 0.3, model: LanguageModel | None = None) -> DataFrame:
    """The rows of `docs` whose language is told with a share of at least `least`; all columns stay."""
    v = verdict(docs, model or train(docs))
    return docs.where((v["lang_pred"] != "und") & (v["score"] >= least))


def op2_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
