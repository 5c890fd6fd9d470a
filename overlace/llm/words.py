"""Words of a text as bytes, ASCII lower case, and their 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash


def words(text: str) -> list[bytes]:
    """Maximal runs without space, tab, line feed, vertical tab, form feed and carriage return; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """xxh3 hashes of words behind a memo of bounded size in bytes; it belongs to one task and goes with it."""

    def __init__(self, most_bytes: int = 24 << 20, longest: int = 64):
        self.memo: dict[bytes, int] = {}
        self.room = self.most_bytes = most_bytes
        self.longest = longest

    def __call__(self, ws: list[bytes]) -> np.ndarray:
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
        except KeyError:
            pass
        if self.room < 0:
            memo.clear()
            self.room = self.most_bytes
        out = np.empty(len(ws), np.uint64)
        h64, longest = xxhash.xxh3_64_intdigest, self.longest
        for i, w in enumerate(ws):
            if (h := memo.get(w)) is None:
                h = h64(w)
                if len(w) <= longest:
                    memo[w] = h
                    self.room -= len(w) + 160  # the word, its hash and their place in the table
            out[i] = h
        return out


def shingle_hashes(ws: list[bytes], n: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; with fewer words, of the whole sequence; none without words."""
    if not ws:
        return np.empty(0, np.uint64)
    h = hasher(ws)
    n = min(n, len(ws))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)
