import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from recordaudit.llm import search
from tests.llm.conftest import ODD


def split(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(rows, items, best=50):
    docs = [(d, Counter(split(t))) for d, t in rows if split(t)]
    if not docs:
        return []
    n_docs, words = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for d, c in docs:
            m = 50 + 50 * c.total() * n_docs // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(split(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(300)], k=rng.choice([1, 3, 10, 40, 300]))
        rows.append((rng.randrange(1000), rng.choice([" ", ", ", "_"]).join(words)))
    rows += [(5000 + i, "W1 w2 w250") for i in range(70)] + [(6000, "w9 " * 500), (6001, None), (6002, "...")]  # ties beyond the 50th
    items = [(k, " ".join(rng.choices(vocabulary, k=6))) for k in range(12)] + [(50, "w1 w2 w250 w250"), (51, "unheard"), (52, ""), (53, None), (54, "w0 w1 w2"), (54, "w9"), (54, "w9")]
    assert got(search.search(docs(rows).repartition(3), items_of(spark, items))) == brute(rows, items)
    few = search.search(docs(rows), items_of(spark, items), best=3, at_once=4)
    assert got(few) == brute(rows, items, 3)


def test_bounds_are_never_below_a_score(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"t{k}" for k in range(30)], k=rng.randrange(1, 400)))) for i in range(60)]
    batch = search.pa.RecordBatch.from_pydict({"d": [i for i, _ in rows], "k": [i for i, _ in rows], "t": [t for _, t in rows]})
    blocks = [r for b in search._index([batch]) for r in b.to_pylist()]
    n, length = len(rows), sum(len(t.split()) for _, t in rows)
    plan = search.Queries(((0, (0, 1, 2)), (1, (3,))), (b"t1", b"t2", b"t3", b"t4"), (700, 300, 20, 900), n, length)
    hashes = np.array([search.crc32(t) for t in plan.names], dtype=np.uint32)
    weight = np.array([[700.0, 300, 20, 0], [0, 0, 0, 900]])
    for block in blocks:
        block["sizes"] = np.array(block["sizes"])
        bound = search._bounds(plan, block, hashes, weight)
        for at, d in enumerate(block["doc_ids"]):
            tf = Counter(rows[d][1].split())
            for item in range(2):
                exact = sum(int(weight[item, k]) * search._gain(tf[t.decode()], plan.offset(tf.total())) for k, t in enumerate(plan.names) if t.decode() in tf)
                assert bound[item, at] >= exact
    assert sum(b["docs"] for b in blocks) == n and len(blocks) > 1


def test_odd_rows_and_empty_tables(docs, spark):
    items = [(1, "le chat est là"), (2, "one two"), (3, None), (None, "dog mat"), (4, "STRASSE 漢字 hund")]
    assert got(search.search(docs(ODD, clash=True), items_of(spark, items).selectExpr("*", "1 AS rank", "2 AS score"))) == brute([r[:2] for r in ODD], [i for i in items if i[1]])
    assert search.search(docs([]), items_of(spark, items)).count() == 0
    assert search.search(docs([(1, None), (2, "")]), items_of(spark, items)).count() == 0
    assert search.search(docs(ODD), items_of(spark, [])).count() == 0
