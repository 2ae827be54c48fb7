"""64-bit hashes of words and word n-grams, made in bulk with numpy."""

from __future__ import annotations

import numpy as np

#: Words of up to so many bytes are remembered by a worker, so many at most; then it starts anew.
CACHED_LENGTH, CACHED = 40, 100_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[word] = h
        return h


WORDS = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, in order."""
    words = text.encode().lower().split()  # bytes split at space and \t\n\v\f\r, and lower A-Z only
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 + 0x1234567 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n words."""
    out = words[: len(words) - n + 1]
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(32))) * _ODD[k % 5] + words[k : len(words) - n + 1 + k]
    return mix64(out, n)


def shingle_set(text: str, n: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles of a text; a shorter one is one shingle, an empty one none."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(ngram_hashes(words, min(n, len(words))))


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences of as few bytes as the largest needs, five at least; the first one is whole."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    most = int(gaps[1:].max()) if len(gaps) > 1 else 0
    width = max(5, -(-most.bit_length() // 8))
    return bytes([width]) + gaps[:1].tobytes() + gaps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    wide = np.zeros(((len(packed) - 9) // width + 1, 8), np.uint8)
    wide[0] = np.frombuffer(packed[1:9], np.uint8)
    wide[1:, :width] = np.frombuffer(packed[9:], np.uint8).reshape(-1, width)
    return np.cumsum(wide.view(np.uint64)[:, 0], dtype=np.uint64)
