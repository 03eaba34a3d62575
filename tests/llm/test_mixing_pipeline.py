import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from recordaudit.llm import mixing, packing, quality, simhash
from recordaudit.llm.common import stored, table
from tests.llm.test_near_copies import brute_kept
from tools.check_queries import TABLES, canon

SF = "/root/testdata/sf0.001"


def water(sizes, share=1.5, most=2.0):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out = share * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in out]
        rest = total - sum(out.values())
        if not left:
            return out
        level = rest / sum(weight[s] for s in left)
        above = [s for s in left if level * weight[s] > most * sizes[s]]
        if not above:
            return out | {s: level * weight[s] for s in left}
        out |= {s: most * sizes[s] for s in above}


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, "é": 70, "z": 400, None: 33}, {"a": 7}, {"a": 0, "b": 5}, {None: 0}):
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(water(sizes))


def test_schedule_spreads_the_sources(spark):
    wanted = {1: 5000, 2: 1800, 3: 1, 4: 0, 5: 3199}
    slots = [(r["slot"], r["s"], r["rank"]) for r in mixing.schedule(spark.createDataFrame(list(wanted.items()), "s int, slots long")).collect()]
    for s, n in wanted.items():
        assert sorted(r for _, own, r in slots if own == s) == list(range(n))
        ranked = sorted((r, slot) for slot, own, r in slots if own == s)
        assert [slot for _, slot in ranked] == sorted(slot for _, slot in ranked)
    for at in range(0, 10000, 500):
        for s in (1, 2, 5):
            here = sum(1 for slot, own, _ in slots if own == s and at <= slot < at + 500)
            assert abs(here - wanted[s] / 20) < 8


def test_mix(docs):
    rows = [(i, "w " * (i * 13 % 400), "en", ["big", "small", None][0 if i % 10 < 7 else i % 3]) for i in range(900)]
    done = mixing.mix(docs(rows), block=64)
    per_doc = done.documents.collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = water(sizes)
    taken = dict.fromkeys(sizes, 0)
    source = {r[0]: r[3] for r in rows}
    for r in per_doc:
        assert r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert taken == pytest.approx(want, abs=1)
    pieces = done.pieces.collect()
    assert sum(p["length"] for p in pieces) == sum(taken.values())
    per_slot = {}
    for p in pieces:
        per_slot.setdefault((p["slot"], p["source"], p["round"], p["block"]), []).append(p["length"])
    assert all(sum(v) <= 64 for v in per_slot.values())


@pytest.mark.parametrize("name", ["op4_warc", "op8_mix", "op13_search"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, cursor = entry_points.queries()[name](spark, SF), con.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.collect(), df.columns) == canon(cursor.fetchall(), columns)


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert len(seen[0]) > len(seen[1]) >= len(seen[2])
    assert sorted(seen[2]) == brute_kept(sorted(seen[1].items()))  # five-word resemblance of 0.8 and more
    mixed = mixing.mix(table(spark, SF, "documents").where(f"doc_id IN ({','.join(map(str, seen[2]))})")).documents.collect()
    copies = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixed}
    counts = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in copies.items() if n}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert packed["sequence_id"].nunique() <= -(-packed["length"].sum() // 1024) + 2
    pieces = packing.pieces(docs).toPandas()
    assert sorted(zip(packed["doc_id"], packed["ids_crc32"])) == sorted(zip(pieces["doc_id"], pieces["ids_crc32"]))
    assert callable(corpus_pipeline.run) and quality and simhash
