"""Pairing along a line: the small helpers that settle one piece, and how rows stream through them.

A piece is a run of values whose steps stay within the tolerance; no pair crosses two pieces, so Spark may settle them anywhere
and in any number. Both helpers take time near the number of values times its logarithm, whatever the values are.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def closest_first(v: list[float], n_l: list[int], n_r: list[int], tol: Callable[[float], float]) -> list[tuple[int, int, int, int, int]]:
    """Pair the distinct values of a piece, the closest first, equal distances from the large values down.

    `n_l` and `n_r` say how often each value, in ascending order, occurs on either side. Returns (left, right, copies, left copies
    used before, right copies used before) by position. The closest pair of all is always one of neighbours among what is
    left, so only neighbours are looked at: a heap holds them, and a used-up value is taken out of the chain.
    """
    chain = [(x, side, i) for i, x in enumerate(v) for side, n in ((0, n_l[i]), (1, n_r[i])) if n > 0]
    size = len(chain)
    before, after = list(range(-1, size - 1)), list(range(1, size + 1))
    free = [n_l[i] if side == 0 else n_r[i] for _, side, i in chain]
    used, heap, out = [0] * size, [], []

    def meet(p: int, q: int) -> None:
        if p < 0 or q >= size or chain[p][1] == chain[q][1]:
            return
        a, b = (p, q) if chain[p][1] == 0 else (q, p)
        dev = abs(chain[a][0] - chain[b][0])
        if dev <= tol(chain[a][0]):
            heapq.heappush(heap, (dev, -chain[a][0], -chain[b][0], a, b))

    for p in range(size - 1):
        meet(p, p + 1)
    while heap:
        *_, a, b = heapq.heappop(heap)
        n = min(free[a], free[b])
        if n <= 0:
            continue
        out.append((chain[a][2], chain[b][2], n, used[a], used[b]))
        for p in (a, b):
            free[p] -= n
            used[p] += n
            if free[p] == 0:
                if before[p] >= 0:
                    after[before[p]] = after[p]
                if after[p] < size:
                    before[after[p]] = before[p]
        for p in (a, b):
            if free[p] == 0:
                meet(before[p], after[p])
            else:
                meet(before[p], p)
                meet(p, after[p])
    return out


class Offers:
    """The free offers of a piece: the nearest one to a value, of equally near ones that with the smallest number."""

    def __init__(self, v: list[float], no: list[int], shut: list[tuple | None]):
        order = sorted(range(len(v)), key=lambda k: (v[k], no[k]))
        self.v: list[float] = []
        self.queues: list[list[int]] = []  # of each distinct value its offers, the last one next
        for k in order:
            if not self.v or self.v[-1] != v[k]:
                self.v.append(v[k])
                self.queues.append([])
            self.queues[-1].append(k)
        for q in self.queues:
            q.reverse()
        self.no, self.shut = no, shut
        self.down, self.up = list(range(len(self.v))), list(range(len(self.v) + 1))  # where to look on from an exhausted value

    def _live(self, p: int, turn: tuple) -> bool:
        q = self.queues[p]
        while q and self.shut[q[-1]] is not None and self.shut[q[-1]] <= turn:
            q.pop()
        return bool(q)

    def _walk(self, p: int, step: int, turn: tuple) -> int | None:
        """The first value from place `p` on, in one direction, with a free offer; exhausted ones are skipped for good."""
        link, passed = (self.up, []) if step > 0 else (self.down, [])
        while 0 <= p < len(self.v):
            if link[p] != p:
                passed.append(p)
                p = link[p]
            elif self._live(p, turn):
                break
            else:
                passed.append(p)
                p += step
        for k in passed:
            link[k] = p
        return p if 0 <= p < len(self.v) else None

    def take(self, value: float, turn: tuple, reach: float) -> int | None:
        """Claim the nearest offer within `reach` that is still open at this turn; its position, or None."""
        at = bisect_left(self.v, value)
        best = None
        for p in (self._walk(at - 1, -1, turn), self._walk(at, 1, turn)):
            if p is not None:
                k = self.queues[p][-1]
                dev = abs(self.v[p] - value)
                if dev <= reach and (best is None or (dev, self.no[k]) < best[:2]):
                    best = (dev, self.no[k], p)
        return self.queues[best[2]].pop() if best else None


def plain_pairs(v: np.ndarray, n_l: np.ndarray, n_r: np.ndarray, begin: np.ndarray, end: np.ndarray, tol: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of one value with both sides, or of two with one side each, all at once: their pairs as rows of `closest_first` by place
    in `v`, a pair's piece first, and which pieces are left to settle. A piece that lacks a side has no pair."""
    size, many = end - begin, np.zeros(len(begin), dtype=bool)
    sides = [np.concatenate(([0], np.cumsum(n > 0))) for n in (n_l, n_r)]
    both = np.logical_and(*[s[end] > s[begin] for s in sides])
    one = np.flatnonzero(both & (size == 1))
    two = np.flatnonzero(both & (size == 2))
    first = begin[two]
    single = ((n_l[first] > 0) != (n_r[first] > 0)) & ((n_l[first + 1] > 0) != (n_r[first + 1] > 0))
    many[both & (size > 2)] = True
    many[two[~single]] = True
    two, first = two[single], first[single]
    left = np.where(n_l[first] > 0, first, first + 1)
    right = 2 * first + 1 - left
    near = np.abs(v[left] - v[right]) <= tol(v[left])
    piece, left, right = (np.concatenate((x, y)) for x, y in ((one, two[near]), (begin[one], left[near]), (begin[one], right[near])))
    zero = np.zeros(len(piece), dtype=np.int64)
    return np.stack((piece, left, right, np.minimum(n_l[left], n_r[right]), zero, zero), axis=1), many


def settle_lists(lists: pa.ListArray, tol: Callable[[float], float], tols: Callable[[np.ndarray], np.ndarray]) -> pa.ListArray:
    """For lists of (v, n_l, n_r, p_l, p_r), one to a piece: their pairs. Only pieces of several values take a heap."""
    flat = lists.flatten()
    v, n_l, n_r = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("v", "n_l", "n_r"))
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    plain, many = plain_pairs(v, n_l, n_r, begins, ends, tols)
    found = []
    for piece in np.flatnonzero(many).tolist():
        lo, hi = int(begins[piece]), int(ends[piece])
        order = np.argsort(v[lo:hi], kind="stable")
        pairs = closest_first(v[lo:hi][order].tolist(), n_l[lo:hi][order].tolist(), n_r[lo:hi][order].tolist(), tol)
        found += [(piece, lo + order[a], lo + order[b], n, ua, ub) for a, b, n, ua, ub in pairs]
    cols = np.concatenate((plain, np.array(found, dtype=np.int64).reshape(-1, 6)))
    cols = cols[np.argsort(cols[:, 0], kind="stable")]
    stops = np.concatenate(([0], np.cumsum(np.bincount(cols[:, 0], minlength=len(ends)))))
    parts = {"l": flat.field("v").take(pa.array(cols[:, 1])), "r": flat.field("v").take(pa.array(cols[:, 2])), "n": pa.array(cols[:, 3]), "l_from": pa.array(cols[:, 4]), "r_from": pa.array(cols[:, 5]),
             "p_l": flat.field("p_l").take(pa.array(cols[:, 1])), "p_r": flat.field("p_r").take(pa.array(cols[:, 2]))}
    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.StructArray.from_arrays(list(parts.values()), names=list(parts)))


def claims(keys: int, tol: Callable[[float], float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows sorted by piece (the first `keys` columns), offers before claimants and these in the order of their turns.

    The other columns are asks, v, turn1, turn2, no, shut1, shut2. Every claimant's row comes out with the offer that it takes in
    `no` (null: none). Only the offers of one piece are held; claimants stream.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, waiting, offers = None, ([], [], []), None
        for batch in batches:
            of_piece = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
            asks, v, t1, t2, no, s1, s2 = (batch.column(keys + i).to_pylist() for i in range(7))
            rows, taken = [], []
            for k, here in enumerate(of_piece):
                if here != piece:
                    piece, waiting, offers = here, ([], [], []), None
                if not asks[k]:
                    for part, x in zip(waiting, (v[k], no[k], None if s1[k] is None else (s1[k], s2[k]))):
                        part.append(x)
                    continue
                offers = offers or Offers(*waiting)
                got = offers.take(v[k], (t1[k], t2[k]), tol(v[k]))
                rows.append(k)
                taken.append(None if got is None else offers.no[got])
            if rows:
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns[:keys], kept.column(keys + 2), kept.column(keys + 3), pa.array(taken, pa.int64())], names=[*batch.schema.names[:keys], "turn1", "turn2", "no"])

    return run
