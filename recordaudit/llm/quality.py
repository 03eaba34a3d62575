"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is described by the transitions between kinds of characters and by its repeated
words, and encoded by a learned layer; a gated attention gives each passage its weight; the weighted sum of the encodings is
scored. Only documents have labels, so the attention learns which passages give a document away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordaudit.llm.common import fold, table

PASSAGE = 400  # characters
STRIDE = 256  # passages described in one block
HIDDEN, GATE = 24, 12

_KINDS = np.full(0x250, 10, dtype=np.uint8)  # letters beyond ASCII and all else
_KINDS[:0x80] = 9  # other ASCII
_KINDS[ord("a"):ord("z") + 1] = 0
_KINDS[ord("A"):ord("Z") + 1] = 1
_KINDS[ord("0"):ord("9") + 1] = 2
for _i, _c in enumerate(" \n.,!|", start=3):
    _KINDS[ord(_c)] = _i
for _c in "\t\r\v\f":
    _KINDS[ord(_c)] = 3
KINDS = 11
WIDTH = KINDS * KINDS + 4


def passages(text: str | None) -> np.ndarray:
    """One row of features for each passage of the whole text; a null or empty text is one passage of zeros."""
    text = text or ""
    out = np.zeros((max(-(-len(text) // PASSAGE), 1), WIDTH), dtype=np.float32)
    for block in range(0, len(text), PASSAGE * STRIDE):
        part = text[block:block + PASSAGE * STRIDE]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _KINDS[np.minimum(c, len(_KINDS) - 1)].astype(np.int64)
        where = np.arange(len(c)) // PASSAGE
        n = -(-len(c) // PASSAGE)
        step = where[:-1] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
        moves = np.bincount(step, minlength=n * KINDS * KINDS).reshape(n, -1)
        first = block // PASSAGE
        out[first:first + n, :KINDS * KINDS] = np.sqrt(moves / np.maximum(moves.sum(axis=1, keepdims=True), 1))
        for i in range(n):
            w = part[i * PASSAGE:(i + 1) * PASSAGE].split()
            if w:
                out[first + i, -4:] = len(set(w)) / len(w), sum(map(str.__eq__, w, w[1:])) / len(w), len(w) / 64, sum(map(len, w)) / len(w) / 8
    return out


class Attention:
    """Encoder, gated attention and scorer, with hand-written gradients and Adam."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        shapes = {"w": (WIDTH, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """x: the passages of all bags; starts: where each bag begins."""
        p, bag = self.p, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        alpha = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return score, (x, starts, bag, h, t, g, alpha, z)

    def gradient(self, kept: tuple, error: np.ndarray) -> dict[str, np.ndarray]:
        """error: score less label, divided by the number of bags."""
        (x, starts, bag, h, t, g, alpha, z), p = kept, self.p
        dz = error[:, None] * p["c"]
        dalpha = (dz[bag] * h).sum(axis=1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, starts)[bag])
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh = (alpha[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ error, "d": error.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, size: int = 64, rate: float = 0.01, decay: float = 1e-4) -> Attention:
        rng, step = np.random.default_rng(11), 0
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), size):
                part = order[at:at + size]
                x = np.concatenate([bags[i] for i in part])
                starts = np.cumsum([0, *[len(bags[i]) for i in part[:-1]]])
                score, kept = self.forward(x, starts)
                grads, step = self.gradient(kept, ((score - labels[part]) / len(part)).astype(np.float32)), step + 1
                for k, grad in grads.items():
                    grad = grad + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.99 * s[k] + 0.01 * grad * grad
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        bags = [passages(t) for t in texts]
        return self.forward(np.concatenate(bags), np.cumsum([0, *[len(b) for b in bags[:-1]]]))[0].astype(float)


def sample(docs: DataFrame, labels: DataFrame, per_label: int) -> pd.DataFrame:
    """About `per_label` labelled texts of each label (never more), drawn by a hash of the id; rows of fold 0 never take part."""
    usable = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0)).select("doc_id", "quality")
    counts = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"text": [], "quality": []})
    share = F.create_map(*[x for q, n in counts.items() for x in (F.lit(q), F.lit(min(1.0, per_label / n)))])
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)).cast("double") / (1 << 30)
    ids = usable.withColumn("u", u).where(F.col("u") < share[F.col("quality")]).orderBy("u", "doc_id", "quality").limit(2 * per_label).toPandas()
    if ids.empty:
        return pd.DataFrame({"text": [], "quality": []})
    chosen = docs.sparkSession.createDataFrame(ids[["doc_id", "quality"]], usable.schema)  # 2 * per_label rows at most, so it may be broadcast
    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", F.xxhash64("text")).limit(4 * per_label)
    return drawn.select("text", "quality").toPandas()


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1200) -> Attention | None:
    """Fit on a bounded sample: at most 4 * `per_label` rows, outside fold 0. None if a label has no text."""
    drawn = sample(docs, labels, per_label)
    if drawn["quality"].nunique() < 2:
        return None
    y = drawn["quality"].to_numpy(dtype=np.float32)
    return Attention().fit([passages(t) for t in drawn["text"]], y)


def score_of(docs: DataFrame, model: Attention | None) -> Column:
    """The probability of label 1 for the `text` of each row (null: as an empty text); 0.5 for all where there is no model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for text in batches:
            out = np.full(len(text), 0.5)
            for at in range(0, len(text) if known else 0, 128):
                out[at:at + 128] = known.score(list(text.iloc[at:at + 128]))
            yield pd.Series(out)

    return score(F.col("text"))


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, model: Attention | None = None) -> DataFrame:
    """Score every whole text: one row per row of `docs` (repeated rows and null ids stay; other columns are not read).

    Returns doc_id, held_out, score (0 to 1, high: label 1), predicted (1 if score >= `least`). An empty table gives an empty result.
    """
    model = model or train(docs, labels)
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score_of(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, model: Attention | None = None) -> DataFrame:
    """The rows of `docs` with a score of at least `least`; all columns stay."""
    return docs.where(score_of(docs, model or train(docs, labels)) >= least)


def op7_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
