"""Words and their hashes, as several operators read them."""

from __future__ import annotations

import numpy as np
import xxhash

MEMO_WORDS = 200_000


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; null has none."""
    return text.encode().lower().split() if text else []  # both methods of bytes touch ASCII only


class WordHasher(dict):
    """Stable 64-bit hashes of words, with a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes], k: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = hasher.array(words)
    n = len(h) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(h[j : j + n] + np.uint64(j + 1))
    out = np.sort(mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]
