"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary exists for two libraries; both give the same ids (tests/llm compares them over all of Unicode). The one that is about
five times faster does the work; the other takes the texts that name a special token, and any text at which the first gives up.
"""

from __future__ import annotations

import base64

import numpy as np

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def vocabulary_paths() -> tuple[str, str]:
    """The default vocabulary: its place for the one library and for the other."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)


class Encoder:
    """Encodes whole texts; one per task. Special tokens named in a text count as such, as is the vocabulary's default."""

    def __init__(self, paths: tuple[str, str]):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(paths[0])
        self.special = [t.content for t in self._exact.get_added_tokens_decoder().values()]
        with open(paths[1], "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.lengths = np.zeros(max(ranks.values()) + 1 + len(self.special), dtype=np.int64)  # bytes of each id
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        for i, t in self._exact.get_added_tokens_decoder().items():
            self.lengths[i] = len(t.content.encode())
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a whole text as little-endian unsigned 32-bit numbers; null counts as empty."""
        if not text:
            return np.array([], dtype="<u4")
        if not any(s in text for s in self.special):
            try:
                return np.array(self._fast.encode_ordinary(text), dtype="<u4")
            except (RuntimeError, ValueError):  # the pattern's backtracking gives up on some very long runs
                pass
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
