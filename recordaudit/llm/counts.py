"""Token counts that follow edits.

The pre-tokens of a document are the content of the leaves of a segment tree that sums characters and tokens. An edit is located
through the sums; from a pre-token shortly before it on, the text is cut anew until a cut falls on an old one behind the edit. Only those pre-tokens are encoded again, and only the sums above their leaves change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordaudit.llm.common import table
from recordaudit.llm.tokens import Encoder, vocabulary_paths

LEAF = 256  # characters in a leaf, about; one with four times as many pre-tokens makes the tree grow anew
CACHE = 1 << 18  # pre-tokens whose counts a task keeps
_SPACE = regex.compile(r"(?<=\S) (?=\S)")  # a pre-token always ends before such a space


class Pretokens:
    """Cuts texts into pre-tokens (special tokens stand alone) and counts the tokens of texts and of single pre-tokens; one per task."""

    def __init__(self, encoder: Encoder):
        import public_tokenizers

        self.encoder, self._known = encoder, {}
        self._plain = regex.compile(public_tokenizers.PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, encoder.special))) if encoder.special else None
        self.reach = max(map(len, encoder.special), default=0) + 2  # how many characters away a cut may depend on

    def split(self, text: str) -> list[str]:
        out, at = [], 0
        for found in self._special.finditer(text) if self._special else ():
            out += [*self._plain.findall(text[at:found.start()]), found[0]]
            at = found.end()
        return out + self._plain.findall(text[at:])

    def count(self, piece: str) -> int:
        got = self._known.get(piece)
        if got is None:
            got = len(self.encoder.ids(piece))
            if len(piece) <= LEAF:
                if len(self._known) >= CACHE:
                    self._known.clear()
                self._known[piece] = got
        return got

    def leaves(self, text: str) -> tuple[list[str], list[int]]:
        """The text cut at some pre-tokens' ends, about LEAF characters apart, and the tokens in each part: the whole text is encoded once."""
        parts, at = [], 0
        while found := _SPACE.search(text, at + LEAF):
            parts.append(text[at:found.start()])
            at = found.start()
        parts.append(text[at:])
        token_ends = np.cumsum(self.encoder.lengths[self.encoder.ids(text)])
        part_ends = np.cumsum([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in parts])
        return parts, np.diff(np.searchsorted(token_ends, part_ends, side="right"), prepend=0).tolist()


class TokenTree:
    """A segment tree over the pre-tokens of one text, several of them in a leaf. A leaf is only cut into its pre-tokens once an edit comes near."""

    def __init__(self, text: str, pretokens: Pretokens):
        self.pretokens, self.encoded = pretokens, 0
        self._grow(*pretokens.leaves(text))

    def _grow(self, texts: list[str], tokens: list[int]) -> None:
        self.texts: list[str | None] = texts  # None where the leaf has been cut
        self.pieces: list[list[str] | None] = [None] * len(texts)
        self.width = 1 << (len(texts) - 1).bit_length()
        pad = [0] * (self.width - len(texts))
        self.chars, self.tokens = [0] * self.width + [len(t) for t in texts] + pad, [0] * self.width + tokens + pad
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def _leaf_text(self, leaf: int) -> str:
        return "".join(self.pieces[leaf]) if self.texts[leaf] is None else self.texts[leaf]

    def text(self) -> str:
        return "".join(map(self._leaf_text, range(len(self.texts))))

    def _leaf(self, leaf: int) -> list[str]:
        if self.texts[leaf] is not None:
            self.pieces[leaf], self.texts[leaf] = self.pretokens.split(self.texts[leaf]), None
        return self.pieces[leaf]

    def _locate(self, at: int) -> tuple[int, int, int]:
        """(leaf, place in the leaf, offset in the pre-token) of the character `at`; behind the last pre-token for the end of the text."""
        node, end = 1, at >= self.n_chars
        while node < self.width:
            node *= 2
            if (end and self.chars[node + 1]) or (not end and at >= self.chars[node]):
                at -= self.chars[node]
                node += 1
        leaf = node - self.width
        for i, piece in enumerate(self._leaf(leaf)):
            if at < len(piece):
                return leaf, i, at
            at -= len(piece)
        return leaf, len(self.pieces[leaf]), 0

    def _following(self, leaf: int, i: int) -> Iterator[tuple[int, int, str]]:
        for k in range(leaf, len(self.texts)):
            pieces = self._leaf(k)
            for j in range(i if k == leaf else 0, len(pieces)):
                yield k, j, pieces[j]

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replace `delete` characters from `at` on by `insert`; a place or length beyond the text is taken as its end."""
        at = min(max(at, 0), self.n_chars)
        delete = min(max(delete, 0), self.n_chars - at)
        # from a pre-token on whose end lies out of reach of the edit; its own beginning cannot change
        first, i, offset = self._locate(max(at - self.pretokens.reach, 0))
        head, todo = "", at - max(at - self.pretokens.reach, 0) + offset
        for _, _, piece in self._following(first, i):
            if todo <= 0:
                break
            head += piece[:todo]
            todo -= len(piece)
        last, j, offset = self._locate(at + delete)
        behind = self._leaf(last)[j:j + 1]
        changed = head + insert
        whole = changed + "".join(behind)[offset:]
        starts = {len(whole): (last, j + 1)} if behind else {}
        if behind and offset == 0:
            starts[len(changed)] = (last, j)
        rest, more = self._following(last, j + 1), 8
        while True:
            taken = 0
            for k, m, piece in rest:
                starts[len(whole)] = (k, m)
                whole += piece
                taken += 1
                if taken == more:
                    break
            ended = taken < more
            pieces, place, to = [], 0, None
            for piece in self.pretokens.split(whole):
                if place >= len(changed) and place in starts and (ended or place + self.pretokens.reach < len(whole)):
                    to = starts[place]
                    break
                pieces.append(piece)
                place += len(piece)
            if to or ended:
                break
            more *= 2
        end_leaf, end = to or (len(self.texts) - 1, len(self._leaf(len(self.texts) - 1)))
        own, count = self._leaf(first), self.pretokens.count
        gone = own[i:end if end_leaf == first else None] + (self._leaf(end_leaf)[:end] if end_leaf > first else [])
        tokens = self.tokens[self.width + first] + (self.tokens[self.width + end_leaf] if end_leaf > first else 0)
        tokens += sum(map(count, pieces)) - sum(map(count, gone))
        self.encoded += len(pieces)
        pieces = [*own[:i], *pieces, *self.pieces[end_leaf][end:]]
        for k in range(first, end_leaf + 1):
            self.texts[k], self.pieces[k] = None, pieces if k == first else []
            self._update(k, tokens if k == first else 0)
        if len(pieces) > 4 * LEAF:
            self._grow(*self.pretokens.leaves(self.text()))

    def _update(self, leaf: int, tokens: int) -> None:
        node = self.width + leaf
        self.chars[node], self.tokens[node] = sum(map(len, self.pieces[leaf])), tokens
        while node := node // 2:
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]


EDITS = "array<struct<at:bigint,delete:bigint,insert:string>>"
COUNTED = "doc_id long, n_chars long, n_tokens long, n_edits int, reencoded long, edited_chars long, edited_tokens long"


def count_edits(docs: DataFrame, edits: Column, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Count the tokens of every whole text, then apply its `edits` (at, delete, insert; in code points, one after the other) and count on.

    Returns a row per row of `docs`: doc_id, n_chars, n_tokens, n_edits, reencoded (pre-tokens encoded again for the edits),
    edited_chars, edited_tokens. A null text is empty, null edits are none, a null insert inserts nothing; repeated rows and null ids
    stay row by row; other columns are not read; an empty table gives an empty result.
    """
    paths = vocabulary or vocabulary_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens = Pretokens(Encoder(paths))
        for batch in batches:
            rows = []
            for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tree = TokenTree(text or "", pretokens)
                before = tree.n_chars, tree.n_tokens
                for e in changes or ():
                    tree.edit(e["at"] or 0, e["delete"] or 0, e["insert"] or "")
                rows.append((*before, len(changes or ()), tree.encoded, tree.n_chars, tree.n_tokens))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds, strict=True)]], [f.split()[0] for f in COUNTED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text", edits.cast(EDITS).alias("edits")).mapInArrow(run, COUNTED)


def usual_edits() -> Column:
    """Three edits whose places follow from the id and the length: a word put in, seven characters taken out, four replaced across a word end."""
    place = lambda n: F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(n)), F.coalesce(F.char_length("text"), F.lit(0)) + 1)
    edit = lambda n, delete, insert: F.struct(place(n).cast("long").alias("at"), F.lit(delete).cast("long").alias("delete"), F.lit(insert).alias("insert"))
    return F.array(edit(1, 0, " inserted"), edit(2, 7, ""), edit(3, 4, ", 12\n"))


def op1_token_counts(spark, sf_dir):
    return count_edits(table(spark, sf_dir, "documents"), usual_edits())
