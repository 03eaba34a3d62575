import random

import pytest

from recordaudit.llm import nearcopies, simhash
from tests.llm.conftest import ODD


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def resemblance(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(rows, least=0.8):
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if resemblance(sets[i], sets[j]) >= least:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=lambda d: (d is None, d or 0))


@pytest.mark.parametrize("depth, slice_, small", [(8, 1 << 14, 1 << 12), (8, 60, 4), (16, 40, 4)])
def test_closest_against_all_pairs(spark, monkeypatch, depth, slice_, small):
    monkeypatch.setattr(nearcopies, "SLICE", slice_)
    monkeypatch.setattr(nearcopies, "SMALL", small)
    rng = random.Random(depth)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    for f in list(base):
        for flips in range(0, 14):
            base.append(f ^ sum(1 << b for b in rng.sample(range(64), flips)))
    n = len(base)
    label = [-i if i % 5 else 0 for i in range(n)]
    refused = [[rng.randrange(n) for _ in range(i % 4)] for i in range(n)]
    other = [rng.choice(base) ^ rng.getrandbits(4) for _ in range(n)]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    rows = [(i, [signed(f), signed(g)], label[i], refused[i]) for i, (f, g) in enumerate(zip(base, other))]
    state = spark.createDataFrame(rows, "uid long, fps array<long>, label long, refused array<long>")
    apart = lambda i, j: min((f[i] ^ f[j]).bit_count() for f in (base, other))
    got = {}
    for r in nearcopies.closest(state, 7, depth, most=3).collect():
        got.setdefault(r["u"], []).append((r["dist"], r["v"]))
    want = {}
    for i in range(n):
        near = [(apart(i, j), j) for j in range(n) if label[i] != label[j] and j not in refused[i] and apart(i, j) <= 7]
        of_label = {}
        for pair in sorted(near):
            of_label.setdefault(label[pair[1]], pair)
        if near:
            want[i] = sorted(of_label.values())[:3]
    assert {u: sorted(p) for u, p in got.items()} == want


def test_copies_far_apart_in_bits_go(docs, spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for _ in range(10):
        text = rng.choices(vocabulary, k=300)
        for changed in (0, 1, 2, 4, 5, 9, 20):
            copy = list(text)
            for at in rng.sample(range(300), changed):
                copy[at] = "new" + rng.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(copy)))
    rows += [(2, None), (3, ""), (4, "one"), (5, "one two")]
    kept, want = {r["doc_id"] for r in nearcopies.keep_one(docs(rows)).collect()}, set(brute_kept(rows))
    assert kept >= want and len(rows) - len(kept) >= 0.95 * (len(rows) - len(want))
    prints = [simhash.fingerprint(t) for _, t in rows]
    sets = [shingles(t) for _, t in rows]
    assert any((prints[i] ^ prints[j]).bit_count() > 3 and resemblance(sets[i], sets[j]) >= 0.8 for i in range(70) for j in range(i))
    assert len(kept) < len(simhash.keep_first(docs(rows)).collect())


def test_every_partner_is_asked(spark):
    """Texts of one bag of words have one fingerprint: the only copy comes after 40 closer strangers, and finds its link in a late round."""
    from recordaudit.llm.nearcopies import links_of

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [rng.sample(words, 60) for _ in range(40)]
    texts.append(texts[0][1:] + texts[0][:1])  # a turn by one word: 55 of 57 shingles
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    prints = [nearcopies.word_fingerprint(t) for _, t in rows]
    assert len({tuple(p) for p in prints}) == 1
    reps = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "uid long, fps array<long>")
    table = spark.createDataFrame(rows, "uid long, text string")
    links = links_of(reps, lambda uids: table.join(uids, "uid", "left_semi"), most=2)
    assert [(r["a"], r["b"]) for r in links.collect()] == [(0, 40)]


def test_an_id_with_two_texts_keeps_both_groups(docs):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    got = nearcopies.keep_one(docs([(1, a), (1, b), (2, a), (2, b)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (1, b)]


def test_odd_rows(docs):
    done = nearcopies.keep_one(docs(ODD, clash=True))
    assert done.columns == docs(ODD, clash=True).columns and len(done.collect()) == len(brute_kept(ODD))
    assert nearcopies.keep_one(docs([])).count() == 0


def test_stage_on_the_test_table(spark):
    import corpus_pipeline
    from recordaudit.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = corpus_pipeline.drop_near_copies(spark, docs, None)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(rows)


@pytest.mark.parametrize("slice_, mass, depth", [(1 << 14, 1 << 21, 8), (30, 1 << 21, 8), (1 << 14, 2000, 16)])
def test_links_told_where_texts_meet(spark, monkeypatch, slice_, mass, depth):
    """A large group in which most pairs are refused: only links leave the tasks, no more of them than nodes connect, and none is lost."""
    monkeypatch.setattr(nearcopies, "SLICE", slice_)
    monkeypatch.setattr(nearcopies, "MASS", mass)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            copy[at] = "new" + str(rng.randrange(60))
        texts.append(" ".join(copy))
    texts += ["", " ", "w1 w2"]
    prints, sets, n = [nearcopies.word_fingerprint(t) for t in texts], [shingles(t) for t in texts], len(texts)
    near = [(i, j) for i in range(n) for j in range(i) if min(((a ^ b) & ((1 << 64) - 1)).bit_count() for a, b in zip(prints[i], prints[j])) <= 7]
    alike = {(j, i) for i, j in near if resemblance(sets[i], sets[j]) >= 0.8}
    assert len(near) > 3 * len(alike) > 100
    rows = [(i, p, i, bytearray(nearcopies.shingle_hashes(t))) for i, (p, t) in enumerate(zip(prints, texts))]
    state = spark.createDataFrame(rows, "uid long, fps array<long>, label long, bag binary")
    got = [(r["a"], r["b"]) for r in nearcopies.links_where_met(state, 7, depth).collect()]
    assert set(got) <= alike and len(got) == len(set(got))

    def groups(pairs):
        root = list(range(n))
        for a, b in sorted(pairs):
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
        return [sorted(i for i in range(n) if root[i] == root[k]) for k in range(n)]

    assert groups(got) == groups(alike)
