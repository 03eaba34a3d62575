import numpy as np
import pytest

from recordaudit.llm import whitening
from recordaudit.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors):
    x = np.floor(64 * np.array(vectors, dtype=float)) + 1_000_000
    c = x - x.mean(axis=0)
    value, vector = np.linalg.eigh(c.T @ c / len(x))
    return x, value[::-1], vector[:, ::-1]


def held_against_brute(rows, vectors, most=32):
    ids = [r["vec_id"] for r in rows]
    x, value, vector = brute(vectors)
    assert len(set(zip(ids, (r["component"] for r in rows)))) == len(rows) == len(vectors) * min(most, int((value > 1e-12 * value[0]).sum()))
    n, s = len(x), [int(t) for t in x.sum(axis=0)]
    deviation = [sum((n * int(e) - t) ** 2 for e, t in zip(v, s)) for v in x]
    sign = {}
    for r in sorted(rows, key=lambda r: (r["vec_id"], r["component"])):
        k = r["component"] - 1
        want = float((x[r["vec_id"]] - x.mean(axis=0)) @ vector[:, k] / np.sqrt(value[k]))
        sign.setdefault(k, 1 if want * r["whitened"] > 0 else -1)
        assert r["whitened"] * sign[k] == pytest.approx(want, abs=1e-7)
        assert r["explained"] == pytest.approx(value[k] / value.sum(), rel=1e-10)
        assert (r["n"], r["deviation"]) == (n, deviation[r["vec_id"]]) and r["identity_error"] < 1e-9


@pytest.mark.parametrize("dim, decay", [(8, 0.0), (40, 0.02), (90, 0.0), (90, 0.05)])
def test_against_eigh(spark, dim, decay):
    rng = np.random.default_rng(dim)
    turn, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    vectors = ((rng.normal(size=(300, dim)) * np.exp(-decay * np.arange(dim))) @ turn + rng.normal(size=dim)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA)
    blocks = whitening.blocks_of(df.repartition(3))
    model = whitening.fit(blocks, most=12, guard=6)
    assert (model.rounds > 0) == (dim > 18) and model.residual < 1e-12
    held_against_brute(whitening.apply(blocks, model).collect(), vectors, 12)


def test_query_on_the_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    held_against_brute(whitening.op12_whitening(spark, "/root/testdata/sf0.001").collect(), [r["embedding"] for r in df.orderBy("vec_id").collect()])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0, -3.5]), (1, [0.5, 2.25, 1.0]), (1, [0.5, 2.25, 1.0]), (None, [-4.0, 0.0, 2.0]), (7, [1e30, 2.0, 0.0])]
    bad = [(2, None), (3, [1.0, None, 2.0]), (4, [nan, 0.0, 0.0]), (5, [0.0, inf, 0.0]), (6, []), (8, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in good + bad], SCHEMA).selectExpr("*", "'x' AS n", "1 AS component", "2 AS ids")
    rows = whitening.whiten(df).collect()
    assert len({r["component"] for r in rows}) == 3 or len({r["component"] for r in rows}) == 1  # the huge entry leaves one direction above rounding
    assert sorted(str(r["vec_id"]) for r in rows if r["component"] == 1) == sorted(str(i) for i, _ in good)
    assert {r["n"] for r in rows} == {5}
    assert all(r["deviation"] is None for r in rows if r["vec_id"] == 7)


def test_vectors_without_variance_and_empty(spark):
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0
    line = [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(6)]  # rank one
    rows = whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert len(rows) == 6 and rows[0]["explained"] == pytest.approx(1.0) and rows[0]["identity_error"] < 1e-9
