"""Hashed word shingles of whole texts, for tasks that read text by Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class _Words(dict):
    """Hashes of words, forgotten when too many are held."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def forget() -> None:
    """Give the memory of the words back, when a task ends in a worker that lives on."""
    _WORDS.clear()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of all words as one if they are fewer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII white space parts
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], dtype=np.uint64)
    marks = np.array([_WORDS[w] for w in words], dtype=np.uint64)
    n = len(marks) - k + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total += marks[i:i + n] * np.uint64(ODD[i % len(ODD)] + 2 * (i // len(ODD)))
    return np.unique(mixed(total))
