import random

import pytest
import xxhash
from pyspark.sql import functions as F

from recordaudit.llm import fingerprints, simhash


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    shingles = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_classes(prints, radius=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprint():
    for text in (None, "", " \t", "One", "A b", "The cat\vsat on THE mat É", "x y z " * 500):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_trie_pairs_against_all_pairs(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1 << 63]
    for f in list(base):
        for flips in range(1, 7):
            g = f
            for b in rng.sample(range(64), flips) if rng.random() < 0.5 else rng.sample(range(32) if rng.random() < 0.5 else range(32, 64), flips):
                g ^= 1 << b
            base.append(g)
    base = list(dict.fromkeys(base))
    signed = [f - (1 << 64) if f >> 63 else f for f in base]
    got = simhash.trie_pairs(spark.createDataFrame([(f,) for f in signed + signed[:5] + [None]], "fp long"), radius).collect()
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in got]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(base)) for j in range(i) if (base[i] ^ base[j]).bit_count() <= radius}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 181)} | {i: 7 for i in [7, *range(200, 260)]} | {300: 300, 301: 300, 302: 300}
    assert got == want


def test_near_duplicates(docs, spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for g in range(12):
        text = rng.choices(words, k=300)
        for _ in range(4):
            copy = list(text)
            copy[rng.randrange(300)] = rng.choice(words)
            rows.append((1000 - len(rows), " ".join(copy if rng.random() < 0.7 else text)))
    rows += [(2, None), (3, "")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(rows)).collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    classes = brute_classes(prints)
    for (doc_id, _), f, c in zip(rows, prints, classes):
        assert got[doc_id]["fingerprint"] == f"{f:016x}"
        assert got[doc_id]["component_id"] == min(d for (d, _), k in zip(rows, classes) if k == c)
    kept = sorted(r["doc_id"] for r in simhash.keep_first(docs(rows)).collect())
    assert kept == sorted({r["component_id"] for r in got.values()})


def shingles(text, width=5):
    w = (text or "").split()
    return {tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def test_fingerprint_edits(docs, spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 5, 60, 700]))) for i in range(-5, 60)}
    texts[61] = texts[59] + " more words"
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs(list(texts.items())), k=4096).collect()}
    import hashlib
    for i, d in enumerate(order):
        own, other = texts[d], texts[order[(i + 1) % len(order)]]
        edited = own[:len(own) - len(own) // 2] + other[:len(own) // 2]
        assert got[d]["n_chars"] == len(own) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, text in (("near_edited", edited), ("near_next", other)):  # a sketch larger than the texts is exact
            a, b = shingles(own), shingles(text)
            assert got[d][name] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_sketches_estimate_and_merge(spark):
    a, b = (" ".join(f"w{i}" for i in part) for part in (range(0, 3000), range(1000, 4000)))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a"), 512).alias("a"), fingerprints.sketch(F.col("b"), 512).alias("b"))
    r = df.select(
        fingerprints.resemblance(F.col("a"), F.col("b"), 512).alias("j"), fingerprints.containment(F.col("a"), F.col("b"), 512).alias("c"),
        fingerprints.distinct_count(F.col("a"), 512).alias("n"), fingerprints.distinct_count(fingerprints.merge(F.col("a"), F.col("b"), 512), 512).alias("m")).first()
    assert r["j"] == pytest.approx(0.5, abs=0.08) and r["c"] == pytest.approx(2 / 3, abs=0.12)
    assert r["n"] == pytest.approx(3000, rel=0.15) and r["m"] == pytest.approx(4000, rel=0.15)
