import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from recordaudit.llm import language, maxent, quality
from recordaudit.llm.common import table

SF = "/root/testdata/sf0.001"


def held_out(doc_id, n):
    return crc32(str(doc_id).encode()) % n == 0


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert all(r["held_out"] == held_out(r["doc_id"], 5) and 0 <= r["score"] <= 1 for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in test) >= 0.95 * len(test)


def test_folded_weights_equal_the_kernel_regression():
    texts = {"a": ["aab abb aba bab", "abba baba aabb", "bb aa ab"], "b": ["xyz zyx yxz", "zzyx xxyz", "yy xx zz xy"]}
    model = language.fit(texts, landmarks=3, ridge=1e-3)
    flat = [(t, k) for k, v in enumerate(texts.values()) for t in v]
    marks = [language.presence(t) for t, _ in flat]
    kernel = np.array([[np.count_nonzero(a & b) / math.sqrt(np.count_nonzero(a) * np.count_nonzero(b)) for b in marks] for a in marks])
    y = np.where(np.array([k for _, k in flat])[:, None] == np.arange(2), 1.0, -1.0)
    # with every text a landmark, the features span the kernel: (K + n * ridge) alpha = y
    alpha = np.linalg.solve(kernel + len(flat) * 1e-3 * np.eye(len(flat)), y)
    for i, m in enumerate(marks):
        folded = m[model.places].astype(float) @ model.weights / math.sqrt(np.count_nonzero(m))
        assert folded == pytest.approx(kernel[i] @ alpha, abs=1e-3)


def test_letters_decide_und(docs):
    df = docs([(1, None), (2, "123 !"), (3, "the word", "en"), (6, "le mot", "fr"), (4, "the cat and the dog", "en"), (7, "le chat et le chien", "fr"), (8, "Ж", None)])
    got = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2)] == ["und", "und"] and got[1]["score"] == 0
    assert all(got[i]["lang_pred"] in ("en", "fr") for i in (3, 4, 6, 7, 8))


def test_presence_does_not_depend_on_blocks(monkeypatch):
    text = "The quick brown fox jumps over the lazy dog é" * 20
    whole = language.presence(text)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert (language.presence(text) == whole).all()


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality.score_quality(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.93 * len(rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_attention_gradient():
    model, rng = quality.Attention(), np.random.default_rng(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, starts, y = rng.normal(size=(7, quality.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    score, kept = model.forward(x, starts)
    grads = model.gradient(kept, (score - y) / 3)

    def loss():
        s = model.forward(x, starts)[0]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name in model.p:
        flat = model.p[name].reshape(-1)
        for i in rng.choice(flat.size, size=min(4, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            slope = (up - loss()) / 2e-5
            flat[i] = old
            assert grads[name].reshape(-1)[i] == pytest.approx(slope, abs=1e-6)


def test_passages_cover_the_whole_text():
    text = "Some words here. " * 3000
    assert len(quality.passages(text)) == -(-len(text) // quality.PASSAGE) and len(quality.passages("")) == 1
    assert np.allclose(quality.passages(text)[-2], quality.passages(text[(len(text) // quality.PASSAGE - 1) * quality.PASSAGE:])[0])


@pytest.mark.parametrize("kept", [200_000, 50])
def test_base_scores(spark, kept):
    docs = table(spark, SF, "documents")
    rows = docs.collect()
    token = lambda t: [*(t or "").encode().lower().split(), maxent.END]
    train = Counter(w for r in rows if not held_out(r["doc_id"], 10) for w in token(r["text"]))
    n, v = sum(train.values()), len(train)
    texts = {r["doc_id"]: token(r["text"]) for r in rows}
    got = maxent.score_texts(docs, updates=3, kept=kept).collect()
    for r in got:
        own = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(train[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    if kept > 50:
        test = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_the_model_is_a_distribution(spark, docs):
    df = docs([(i, t) for i, t in enumerate(["a b c a b", "b c a", "c a b a", "a a b"] * 30)])
    training = df.where("doc_id >= 0")
    counts = maxent.word_counts(training)
    known = maxent.vocabulary(counts)
    weights = maxent.train(maxent.context_counts(training, known), 6)
    by_class, by_word = maxent.tables(weights)
    assert np.allclose((10.0 ** by_class.astype(float)).sum(axis=1), 1, atol=1e-4) and np.allclose((10.0 ** by_word.astype(float)).sum(axis=1), 1, atol=1e-4)
    state = {w: int(known.kept_states[known.index[w]]) for w in (b"a", b"b", b"c", maxent.END)}
    skip, before = maxent.context(np.array([state[b"a"], state[b"b"], 0]), np.array([0]))
    at = skip[2] * maxent.STATES + before[2]
    p = {w: 10 ** (by_class[at, s // 64] + by_word[s // 64 * maxent.STATES + before[2], s % 64]) for w, s in state.items()}
    assert max(p, key=p.get) in (b"c", b"a", maxent.END) and p[b"b"] < 0.1  # b never follows b
