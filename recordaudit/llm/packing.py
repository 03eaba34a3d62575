"""Packing documents into sequences by the sum of squares.

A piece goes where the squared counts of open bins per residual gap become smallest in sum; a new bin is opened only if no open one
has room. Only the counts per gap decide, so the state of a packer is small. Pieces are dealt by a hash of their document to
groups of a bounded expected size, and every group packs its pieces, longest first, on its own; what that costs is a few unfilled
bins a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordaudit.llm.common import stored, table
from recordaudit.llm.tokens import Encoder, vocabulary_paths

END = 2  # the id that ends a document
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: all of `capacity`, but for the first of a longer document, which takes the rest."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]]


def pieces(docs: DataFrame, capacity: int = 1024, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """The pieces of every document: whole texts (null: empty) by the vocabulary, and the end id. `row` tells repeated ids apart."""
    paths = vocabulary or vocabulary_paths()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(paths), np.array([END], dtype="<u4")
        for batch in batches:
            out: list[tuple] = []
            for row, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = np.append(encoder.ids(text), end)
                out += [(row, doc_id, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            kinds = [("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [[]] * 6, kinds, strict=True)], [n for n, _ in kinds])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece, in the order given, by the least sum of squared counts of open bins per gap."""
    counts = np.zeros(capacity + 1, dtype=np.int64)  # of open bins with this gap; full and empty bins do not count
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i, n in enumerate(lengths.tolist()):
        # into a bin of gap g: counts[g] loses one, counts[g - n] gains one; a bin that becomes full leaves the counts
        change = 2 * (counts[:capacity - n] - counts[n:capacity]) + 2
        if n < capacity:
            change[0] = 1 - 2 * counts[n]
        change = np.where(counts[n:capacity] > 0, change, np.iinfo(np.int64).max)
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and counts[best + n] > 0:
            gap = best + n
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = capacity, len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += n
        if gap > n:
            counts[gap - n] += 1
            open_bins[gap - n].append(b)
    return where, offset


def pack(docs: DataFrame, capacity: int = 1024, group_pieces: int = 8192, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens; a piece has at least one token (the end id).

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed once each; null
    ids stay null; other columns are not read. The pieces of a document may lie in different sequences. An empty table gives an
    empty result. The same input gives the same sequences, whatever the number of tasks.
    """
    found = stored(pieces(docs, capacity, vocabulary), "pieces")
    groups = max(1, -(-found.count() // group_pieces))
    # ids may repeat, so the rest of the row joins the hash: no value can fill a group
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(groups))

    def settle(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "ids_crc32", "row"], ascending=[False, True, True, True, True], ignore_index=True)
        where, offset = place(part["length"].to_numpy(), capacity)
        return part.assign(sequence_id=(int(key[0]) << 32) + where, offset=offset).drop(columns=["row", "g"])

    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return found.withColumn("g", group).groupBy("g").applyInPandas(settle, columns)


def op9_best_fit(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
