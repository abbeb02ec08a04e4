"""Word shingles of whole texts as 64-bit hashes, in Arrow batches.

Words are runs of other than ASCII white space, A-Z lowered.  A shingle of k words is
hashed from its words' hashes; two different shingles get one hash with probability
2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CACHED = 200_000  # words whose hash a task remembers
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    """Hash of each word, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    def __init__(self, k: int):
        self.k = k
        self.known = _Hashes()

    def words(self, text: bytes) -> np.ndarray:
        """Hash of each word, in order."""
        found = text.lower().split()  # of bytes: ASCII only
        if len(self.known) > CACHED:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, found), dtype=np.uint64, count=len(found))

    def shingles(self, text: bytes) -> np.ndarray:
        """Hash of each shingle, in order; of fewer words than k, one of all of them."""
        return self.of_words(self.words(text))

    def of_words(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        k = min(self.k, len(words))
        out = np.full(len(words) - k + 1, np.uint64(k))
        for i in range(k):
            out = (out ^ words[i : len(words) - k + 1 + i]) * _A
            out ^= out >> np.uint64(32)
        out *= _B
        return out ^ (out >> np.uint64(29))


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""
