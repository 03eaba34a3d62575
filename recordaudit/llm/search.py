"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of like size share a block. Of each document the block keeps a Bloom signature of its terms, and of its terms that occur
often enough, as one column of a bit matrix; a row of the matrix (a slice) is a bitmap over the documents. The slices of a term,
ANDed, name the documents that may hold it, and some that do not: presence is only ever overestimated. Summing slices by the
weights of a query's terms gives an upper bound of every document's score. Each query's best bounds are scored exactly first; that
shows which documents can't be among its best, and all others are scored exactly too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordaudit.llm.common import stored, table

#: all of ASCII but digits and letters parts terms; A-Z are lower-cased
_PARTS = bytes(i for i in range(128) if not chr(i).isalnum())
_TABLE = bytes.maketrans(_PARTS + bytes(range(65, 91)), b" " * len(_PARTS) + bytes(range(97, 123)))

FROM = (1, 2, 3, 5, 9, 17, 33, 65)  # occurrences from which a term has another key in the signature
UPTO = (*(f - 1 for f in FROM[1:]), None)  # occurrences that a term with no further key has at most
BITS = 16  # of a signature for each key that it holds; two are set
CELLS = 1 << 23  # of a block's bit matrix, about
DOCUMENTS = 1024  # in a block at most
WIDEST = 1 << 24  # signatures of larger documents are denser, so their bounds are looser
INDEX = "width int, docs int, terms long, doc_ids array<long>, keys array<long>, sizes array<long>, signature binary"
FAR = (1 << 63) - 1


def terms(text: str) -> list[bytes]:
    """The terms of a whole text in UTF-8, with repeats."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _hashed(term_hashes: np.ndarray, level: int) -> np.ndarray:
    return (term_hashes ^ np.uint32(level * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) ^ (term_hashes >> np.uint32(15))


def _places(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slices of each key."""
    shift = np.uint32(32 - width)
    return (keys * np.uint32(2654435761)) >> shift, ((keys ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> shift


def signature_keys(counts: Counter) -> np.ndarray:
    """Hashes of a document's terms, and of each term once more for every level of `FROM` that its occurrences reach."""
    h = np.fromiter(map(crc32, counts), dtype=np.uint32, count=len(counts))
    tf = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    return np.unique(np.concatenate([_hashed(h[tf >= least], level) for level, least in enumerate(FROM)]))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, list] = {}

    def block(width: int) -> pa.RecordBatch:
        rows = waiting.pop(width)
        bits = np.zeros((1 << width, -(-len(rows) // 8) * 8), dtype=bool)
        for at, (*_, keys) in enumerate(rows):
            for places in _places(keys, width):
                bits[places, at] = True
        ids, keys, sizes = ([r[i] for r in rows] for i in range(3))
        packed = np.packbits(bits, axis=1, bitorder="little")
        return pa.RecordBatch.from_pylist([{"width": width, "docs": len(rows), "terms": sum(sizes), "doc_ids": ids, "keys": keys, "sizes": sizes, "signature": packed.tobytes()}], schema=_SCHEMA)

    for batch in batches:
        for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found = terms(text)
            if not found:
                continue
            keys = signature_keys(Counter(found))
            width = min(max(int(np.ceil(np.log2(BITS * len(keys)))), 8), WIDEST.bit_length() - 1)
            waiting.setdefault(width, []).append((doc_id, key, len(found), keys))
            if len(waiting[width]) == max(8, min(DOCUMENTS, CELLS >> width)):
                yield block(width)
    for width in sorted(waiting):
        yield block(width)


_SCHEMA = pa.schema([("width", pa.int32()), ("docs", pa.int32()), ("terms", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("signature", pa.binary())])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The signatures of all whole texts that hold a term, as a written table of blocks. It knows nothing of any query."""
    return stored(_keyed(docs, doc_id, text).mapInArrow(_index, INDEX), "signatures")


@dataclass(frozen=True)
class Queries:
    """A block of queries over all documents: their terms and what these weigh."""

    items: tuple[tuple, ...]  # (item_id, its terms' numbers)
    names: tuple[bytes, ...]  # the terms
    weights: tuple[int, ...]
    documents: int
    length: int

    def offset(self, n: int) -> int:
        return 50 + 50 * n * self.documents // self.length


def _gain(tf: int | None, offset: np.ndarray | int):
    """What a term with `tf` occurrences adds for each unit of its weight; None: more than any number of occurrences can add."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * offset) if tf else 1_000_000 + 0 * offset


def plan_queries(docs: DataFrame, index: DataFrame, items: list[tuple], doc_id: str = "doc_id", text: str = "text") -> Queries:
    """Weigh the terms of `items` (item_id, text): one pass over all documents counts those that hold each term."""
    totals = index.agg(F.sum("docs").alias("documents"), F.sum("terms").alias("length")).first()
    names = sorted({t for _, asked in items for t in terms(asked or "")})
    number = {t: i for i, t in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(number), dtype=np.int64)
        asked = frozenset(number)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held[[number[x] for x in asked.intersection(terms(t))]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "df": pa.array(held[some], pa.int64())})

    df = [0] * len(names)
    for r in _keyed(docs, doc_id, text).select("text").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    n = totals["documents"] or 0
    weights = tuple(math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df)
    return Queries(tuple((i, tuple(number[t] for t in sorted(set(terms(asked or ""))))) for i, asked in items), tuple(names), weights, n, totals["length"] or 1)


def _bounds(plan: Queries, row: dict, hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The upper bound of the score of each document of a block (columns) for each query (rows)."""
    width, docs = row["width"], row["docs"]
    offset = 50 + 50 * row["sizes"] * plan.documents // plan.length
    slices = np.frombuffer(row["signature"], dtype=np.uint8).reshape(1 << width, -1)
    out, below, live = np.zeros((len(weight), docs)), np.zeros(docs), np.arange(len(hashes))
    for level in range(len(FROM)):
        a, b = _places(_hashed(hashes[live], level), width)
        met = slices[a] & slices[b]
        some = met.any(axis=1)
        live, met = live[some], met[some]
        if not len(live):
            break
        gain = _gain(UPTO[level], offset)
        present = np.unpackbits(met, axis=1, count=docs, bitorder="little")
        if level:
            present &= np.unpackbits(before[some], axis=1, count=docs, bitorder="little")
            met &= before[some]
        out += (weight[:, live] @ present.astype(np.float64)) * (gain - below)
        below, before = gain, met
    return out


def _find(plan: Queries, worst: dict[int, tuple[int, int]] | None, best: int):
    """Rows (item, doc_id, key, bound) of the index's documents: without `worst` each task's best bounds, else all that may beat it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = np.fromiter(map(crc32, plan.names), dtype=np.uint32, count=len(plan.names))
        weight = np.zeros((len(plan.items), len(plan.names)))
        for i, (_, held) in enumerate(plan.items):
            weight[i, list(held)] = [plan.weights[t] for t in held]
        least, last = np.zeros(len(plan.items)), np.full(len(plan.items), FAR)
        for i, (score, doc_id) in (worst or {}).items():
            least[i], last[i] = score, doc_id
        kept: list[np.ndarray] = []

        def cut() -> np.ndarray:
            rows = np.concatenate(kept)
            rows = rows[np.lexsort((rows["key"], rows["doc"], -rows["bound"], rows["item"]))]
            first = np.flatnonzero(np.append(True, rows["item"][1:] != rows["item"][:-1]))
            rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
            full = rank == best - 1
            least[rows["item"][full]], last[rows["item"][full]] = rows["bound"][full], rows["doc"][full]
            return rows[rank < best]

        for batch in batches:
            for row in batch.to_pylist():
                doc = np.array([FAR if d is None else d for d in row["doc_ids"]], dtype=np.int64)
                row["sizes"] = np.array(row["sizes"], dtype=np.int64)
                bound = _bounds(plan, row, hashes, weight)
                i, j = np.nonzero((bound > 0) & (bound >= least[:, None]))
                keep = (bound[i, j] > least[i]) | (doc[j] <= last[i])
                i, j = i[keep], j[keep]
                found = np.empty(len(i), dtype=[("item", "i4"), ("doc", "i8"), ("key", "i8"), ("bound", "f8")])
                found["item"], found["doc"], found["key"], found["bound"] = i, doc[j], np.array(row["keys"], dtype=np.int64)[j], bound[i, j]
                if worst is not None:
                    yield _found(found)
                else:
                    kept.append(found)
                    if sum(map(len, kept)) > 4 * best * len(plan.items):
                        kept[:] = [cut()]
        if kept:
            yield _found(cut())

    return run


def _found(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"item": pa.array(rows["item"]), "doc_id": pa.array(rows["doc"], mask=rows["doc"] == FAR), "key": pa.array(rows["key"]), "bound": pa.array(rows["bound"].astype(np.int64))})


FOUND = "item int, doc_id long, key long, bound long"


def _best(rows: DataFrame, by: str, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(by), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def score_exactly(docs: DataFrame, wanted: DataFrame, plan: Queries, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, doc_id, score) of the documents in `wanted` (item, doc_id, key), from their whole texts."""
    asked = wanted.groupBy("doc_id", "key").agg(F.collect_set("item").alias("items"))  # a block's queries at most
    left, right = _keyed(docs, doc_id, text).alias("l"), asked.alias("r")
    met = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.key") == F.col("r.key"))).select("l.doc_id", "l.text", "r.items")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, doc, score = [], [], []
            for d, t, items in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = terms(t)
                tf, offset = Counter(found), plan.offset(len(found))
                for i in items:
                    item.append(i)
                    doc.append(d)
                    score.append(sum(plan.weights[k] * _gain(tf[plan.names[k]], offset) for k in plan.items[i][1] if plan.names[k] in tf))
            yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    return met.mapInArrow(score, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, best: int = 50, at_once: int = 512, index: DataFrame | None = None) -> DataFrame:
    """Each item's `best` highest-scoring documents: item_id, rank, doc_id, score; equal scores by ascending doc_id, null ids last.

    Null texts hold no term: such documents are not counted and such items have no rows. Repeated documents rank one by one;
    items that repeat id and text are searched once, an id with several texts has a ranking for each of them. Items go against all documents in
    blocks of about `at_once`, so what a task and the driver hold of them is bounded. Other columns are not read; empty tables
    give an empty result.
    """
    spark = docs.sparkSession
    asked = stored(items.where("text IS NOT NULL").select("item_id", "text").distinct(), "items")
    parts = -(-asked.count() // at_once)
    index = index if index is not None else build_index(docs)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        plan = plan_queries(docs, index, [(r["item_id"], r["text"]) for r in rows])
        if not plan.documents or not plan.names:
            continue
        first = _best(index.mapInArrow(_find(plan, None, best), FOUND), "bound", best)
        lowest = _best(score_exactly(docs, first, plan), "score", best).where(F.col("rank") == best).collect()  # a row per item of the block
        worst = {r["item"]: (r["score"], FAR if r["doc_id"] is None else r["doc_id"]) for r in lowest}
        may = index.mapInArrow(_find(plan, worst, best), FOUND)
        ranked = _best(score_exactly(docs, may, plan).where("score > 0"), "score", best)
        named = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(plan.items)], "item int, item_id long")
        out = out.unionByName(ranked.join(named, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH found AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
rows AS (SELECT row_number() OVER () AS id, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM found WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM rows),
items AS (SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
held AS (SELECT id, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT id, doc_id, n, unnest(terms) AS term FROM rows) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals),
gains AS (SELECT id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS gain FROM held JOIN weighed USING (term), totals),
scores AS (SELECT item_id, id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM items JOIN gains USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
