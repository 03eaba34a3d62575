"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The vectors, as whole numbers, lie in written blocks. All that the iteration asks of them is the product of their covariance with
a narrow matrix: one distributed pass over the centred blocks, whose parts are summed by Spark. A round drives the basis through
a Chebyshev polynomial of the covariance, which stays small over the unwanted part of the spectrum and grows steeply above it;
then QR and Rayleigh-Ritz sort the basis. Rounds go on until the residuals certify every wanted component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordaudit.llm.common import stored, table

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 50)  # of scaled entries: those beyond count as this, so that sums of them stay whole
ROWS = 4096  # vectors in a block
DEGREE = 10  # of the polynomial: so many passes a round
SURE = 2e-14  # residual over the largest eigenvalue, about what double precision can show
ENOUGH = 1e-12  # residual over the distance to the next eigenvalue: the angle by which a component may be off
MOST_ROUNDS = 60

BLOCKS = "dim int, n int, ids array<long>, kind string, data binary, sums array<long>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, list] = {}

    def block(dim: int) -> pa.RecordBatch:
        rows = waiting.pop(dim)
        z = np.stack([r[1] for r in rows])
        kind = np.promote_types(np.min_scalar_type(z.min()), np.min_scalar_type(min(z.max(), -1) if z.max() < 0 else -z.max() - 1))
        return pa.RecordBatch.from_pydict({
            "dim": pa.array([dim], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "ids": pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
            "kind": [kind.str], "data": pa.array([z.astype(kind).tobytes()], pa.binary()), "sums": pa.array([z.sum(axis=0)], pa.list_(pa.int64())),
        })

    for batch in batches:
        ids, vectors = batch.column(0).to_pylist(), batch.column(1)
        for i, v in enumerate(vectors):
            entries = v.values
            if entries is None or len(entries) == 0 or entries.null_count:
                continue
            c = entries.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(c).all():
                continue
            z = np.floor(np.clip(c * SCALE, -LARGEST, LARGEST)).astype(np.int64)
            waiting.setdefault(len(z), []).append((ids[i], z))
            if len(waiting[len(z)]) == ROWS:
                yield block(len(z))
    for dim in sorted(waiting):
        yield block(dim)


def blocks_of(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The vectors as a written table of blocks of whole numbers floor(64 c), of the length that most vectors have.

    Rows whose vector is null or empty, or holds null or non-finite entries, are left out, and so are vectors of another length
    (of lengths equally frequent the larger one stays). Repeated rows and null ids stay.
    """
    made = stored(embeddings.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).alias("v")).where("v IS NOT NULL").mapInArrow(_blocks, BLOCKS), "blocks")
    lengths = made.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return made.where(F.col("dim") == (lengths[0]["dim"] if lengths else 0))


def _centred(batch: pa.RecordBatch, mean: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(whole numbers, centred doubles) of each block."""
    for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data")):
        z = np.frombuffer(data.as_buffer(), dtype=kind).reshape(-1, len(mean))
        yield z, z - mean


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Sums by place of a table (at, v): partial sums come from every task, so what is gathered is `size` numbers."""
    out = np.zeros(size)
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _placed(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"at": pa.array(np.arange(values.size), pa.int32()), "v": pa.array(values.ravel(), pa.float64())})


def covariance_times(blocks: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> tuple[np.ndarray, float]:
    """One pass: the covariance of all vectors times `q`, and the covariance's trace."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(q.size + 1)
        for batch in batches:
            for _, x in _centred(batch, mean):
                out[:-1] += (x.T @ (x @ q)).ravel()
                out[-1] += np.einsum("ij,ij", x, x)
        yield _placed(out)

    total = _summed(blocks.select("kind", "data").mapInArrow(part, "at int, v double"), q.size + 1) / n
    return total[:-1].reshape(q.shape), float(total[-1])


@dataclass(frozen=True)
class Whitening:
    """n, the sums of floor(64 c) by dimension, eigenvalues and components (columns), the trace, and how the iteration went."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    rounds: int
    passes: int
    residual: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # whole by whole: rounded once


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, with their vectors and the covariance times these."""
    h = q.T @ vq
    value, turn = np.linalg.eigh((h + h.T) / 2)
    value, turn = value[::-1], turn[:, ::-1]
    return value, q @ turn, vq @ turn


def _lower_edge(blocks: DataFrame, mean: np.ndarray, n: int, q: np.ndarray, vq: np.ndarray, value: np.ndarray) -> float:
    """Where the spectrum begins, about: the lowest Ritz value of the basis and its residuals together, less its own residual.

    One pass. Should eigenvalues lie lower still, the filter damps them less, which costs rounds and nothing else.
    """
    r = vq - q * value
    r -= q @ (q.T @ r)
    left, size, _ = np.linalg.svd(r, full_matrices=False)
    r = left[:, size > 1e-10 * value[0]]
    r, _ = np.linalg.qr(r - q @ (q.T @ r))
    if not r.shape[1]:
        return 0.0
    vr, _ = covariance_times(blocks, mean, n, r)
    low, x, vx = _ritz(np.hstack([q, r]), np.hstack([vq, vr]))
    return max(0.0, float(low[-1] - np.linalg.norm(vx[:, -1] - low[-1] * x[:, -1])))


def fit(blocks: DataFrame, most: int = 32, guard: int = 20, seed: int = 5) -> Whitening | None:
    """The leading `most` components of the blocks' covariance; fewer where its rank is lower. None without any vector.

    The basis has `guard` columns more than are wanted. If that spans the space, one Rayleigh-Ritz step is exact; else rounds follow
    until each wanted residual is as small as double precision can show, or small against the distance to the next eigenvalue.
    """
    counts = blocks.agg(F.sum("n").alias("n"), F.max("dim").alias("dim")).first()
    if not counts["n"]:
        return None
    n, dim = counts["n"], counts["dim"]
    sums = [0] * dim
    for r in blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect():
        sums[r["at"]] = r["s"]
    mean = np.array([s / n for s in sums])
    width = min(dim, most + guard)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, width)))
    vq, trace = covariance_times(blocks, mean, n, q)
    value, q, vq = _ritz(q, vq)
    passes, rounds, worst, history, low = 1, 0, 0.0, [], None
    while True:
        wanted = min(most, int(np.sum(value > 1e-12 * max(value[0], 0))))
        residual = np.linalg.norm(vq - q * value, axis=0)
        gap = np.minimum(np.append(np.inf, value[:-1] - value[1:]), np.append(value[:-1] - value[1:], value[-1]))
        sure = (residual <= SURE * value[0]) | (residual <= ENOUGH * gap)
        worst = float(residual[:wanted].max() / value[0]) if wanted else 0.0
        history.append(worst)
        stalled = len(history) > 3 and worst < 1e-12 and worst > 0.5 * min(history[-4:-1])  # rounding is all that is left
        if width == dim or sure[:wanted].all() or stalled:
            break
        if rounds == MOST_ROUNDS:
            raise ArithmeticError(f"components not certified after {rounds} rounds: residual {worst:.1e} of the largest eigenvalue")
        if value[-1] <= 1e-14 * value[0]:
            break  # the basis already holds all that is not zero
        if low is None:
            low, passes = _lower_edge(blocks, mean, n, q, vq, value), passes + 1
        elif len(history) > 3 and worst > 0.5 * history[-3]:
            low = 0.0  # no progress: the edge was told too high, and a covariance has nothing below zero
        # damp the spectrum from its lower edge up to the smallest Ritz value
        half, mid = (value[-1] - low) / 2, (value[-1] + low) / 2
        scale = half / (value[0] - mid)  # keeps the largest component near 1 as the recurrence grows
        before, now, sigma = q, (vq - mid * q) * (scale / half), scale
        for _ in range(DEGREE - 1):
            following = 1 / (2 / scale - sigma)
            product, _ = covariance_times(blocks, mean, n, now)
            before, now, sigma = now, (product - mid * now) * (2 * following / half) - before * (sigma * following), following
        q, _ = np.linalg.qr(now)
        vq, trace = covariance_times(blocks, mean, n, q)
        value, q, vq = _ritz(q, vq)
        passes, rounds = passes + DEGREE, rounds + 1
    q = q[:, :wanted]
    sign = np.sign(q[np.argmax(np.abs(q), axis=0), np.arange(wanted)]) if wanted else 1.0
    return Whitening(n, tuple(sums), value[:wanted], q * sign, trace, rounds, passes, worst)


def identity_error(blocks: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity: one pass over all of them."""
    mean, k = model.mean, len(model.values)
    turn = model.components / np.sqrt(model.values)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * k + k)
        for batch in batches:
            for _, x in _centred(batch, mean):
                w = x @ turn
                out[:k * k] += (w.T @ w).ravel()
                out[k * k:] += w.sum(axis=0)
        yield _placed(out)

    if not k:
        return 0.0
    total = _summed(blocks.select("kind", "data").mapInArrow(part, "at int, v double"), k * k + k) / model.n
    return float(np.abs(total[:k * k].reshape(k, k) - np.outer(total[k * k:], total[k * k:]) - np.eye(k)).max())


def deviations(z: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n z - S)², exact; null where it does not fit a long. The shift of all entries by a constant cancels."""
    reach = n * max(abs(int(z.min())), abs(int(z.max()))) + max(map(abs, sums))
    if reach * reach * len(sums) < 1 << 63:
        d = z.astype(np.int64) * n - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    whole = [sum((n * int(e) - s) ** 2 for e, s in zip(row, sums)) for row in z.tolist()]
    return [d if d < 1 << 63 else None for d in whole]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def apply(blocks: DataFrame, model: Whitening | None) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark: SparkSession = blocks.sparkSession
    if model is None:
        return spark.createDataFrame([], OUT)
    error, mean, k = identity_error(blocks, model), model.mean, len(model.values)
    turn, explained = model.components / np.sqrt(model.values), model.values / model.trace if k else model.values

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, (z, x) in zip(batch.column("ids"), _centred(batch, mean)):
                w = x @ turn
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.values.take(pa.array(np.repeat(np.arange(len(z)), k))), "component": pa.array(np.tile(np.arange(1, k + 1), len(z)), pa.int32()),
                    "n": pa.array(np.full(w.size, model.n), pa.int64()), "deviation": pa.array(deviations(z, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(z)), k))),
                    "whitened": w.ravel(), "explained": np.tile(explained, len(z)), "identity_error": np.full(w.size, error),
                })

    return blocks.select("ids", "kind", "data").mapInArrow(part, OUT)


def whiten(embeddings: DataFrame, most: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whiten all vectors: a row per vector and component, up to `most` components.

    An entry c counts as floor(64 c) + 1000000. Vectors are left out as `blocks_of` says; a component without variance (at ranks
    below `most`) can't be whitened and has no rows, so vectors that are all the same give none. Repeated rows, null ids and ties
    count row by row; other columns are not read. An empty table gives an empty result.
    """
    blocks = blocks_of(embeddings, vec_id, vector)
    return apply(blocks, fit(blocks, most))


def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
