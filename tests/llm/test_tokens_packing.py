import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from recordaudit.llm import packing
from recordaudit.llm.counts import Pretokens, TokenTree
from recordaudit.llm.tokens import Encoder, vocabulary_paths

ENCODER = Encoder(vocabulary_paths())
PRETOKENS = Pretokens(ENCODER)
BITS = ["a", "B", " ", "  ", "\n", "'s", "1", "é", "!", "<|endoftext|>", "<|endof", "text|>", "word", "'ll", " \t", "  x", "ß漢"]


def exact(text):
    return ENCODER._exact.encode(text, add_special_tokens=False).ids


def test_both_libraries_agree_over_unicode():
    for start in range(0, 0x30000, 97):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}. " for c in range(start, start + 97) if not 0xD800 <= c < 0xE000)
        assert ENCODER.ids(text).tolist() == exact(text)


def test_special_tokens_and_long_runs():
    for text in ("a<|endoftext|>b", " " * 30000 + "x", "a" * 30000, ""):
        assert ENCODER.ids(text).tolist() == exact(text)


@given(st.lists(st.sampled_from(BITS), max_size=400), st.lists(st.tuples(st.integers(-2, 900), st.integers(-1, 300), st.lists(st.sampled_from(BITS), max_size=300)), max_size=4))
@settings(max_examples=150, deadline=None)
def test_tree_follows_edits(bits, edits):
    text = "".join(bits)
    tree = TokenTree(text, PRETOKENS)
    assert tree.n_tokens == len(exact(text))
    for at, delete, insert in edits:
        insert = "".join(insert)
        tree.edit(at, delete, insert)
        at = min(max(at, 0), len(text))
        text = text[:at] + insert + text[at + max(delete, 0):]
        assert (tree.text(), tree.n_chars, tree.n_tokens) == (text, len(text), len(exact(text)))


def test_an_edit_encodes_little():
    tree = TokenTree("the cat sat on the mat. " * 5000, PRETOKENS)
    tree.edit(60_000, 3, "dog")
    assert tree.encoded < 40


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]
    assert packing.cut(16, 8) == [(0, 8), (8, 8)]


def test_place_is_the_least_sum_of_squares():
    rng = random.Random(5)
    lengths = sorted((rng.randint(1, 20) for _ in range(300)), reverse=True)
    got, _ = packing.place(np.array(lengths), 20)
    gaps, bins = [], []
    for n in lengths:
        fits = sorted({g for g in gaps if n <= g < 20})
        def total(g, n=n):
            after = list(gaps)
            after[after.index(g)] = g - n
            return sum(sum(1 for x in after if x == v) ** 2 for v in range(1, 20))
        if fits:
            best = min(fits, key=lambda g: (total(g), g))
            b = max(i for i, g in enumerate(gaps) if g == best)
            gaps[b] -= n
        else:
            b = len(gaps)
            gaps.append(20 - n)
        bins.append(b)
    used = np.bincount(got, weights=lengths)
    assert used.max() <= 20 and len(used) == len(gaps)


def test_pack(docs, spark):
    texts = {i: "word " * (i * 37 % 2500) for i in range(200)}
    rows = packing.pack(docs([(i, t) for i, t in texts.items()]), group_pieces=64).toPandas()
    for doc_id, own in rows.groupby("doc_id"):
        ids = np.append(ENCODER.ids(texts[doc_id]), 2).astype("<u4")
        own = own.sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["length"].sum() == len(ids)
        assert [zlib.crc32(ids[s:s + n].tobytes()) for s, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()
    rows = rows.sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id")["length"].cumsum()
    assert (ends - rows["length"] == rows["offset"]).all() and ends.max() <= 1024
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 1024) + 8
