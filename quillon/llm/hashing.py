"""64-bit hashes of ranges of units (bytes or words) for whole arrays at once, and 128-bit ones of bytes.

A range's hash is a polynomial over its units' codes, taken from prefix sums modulo
2**64: hash(s, e) = mix((P[e] - P[s]) * M**-s). It depends on the units alone, not
on where they stand. Long strings of one structure share such a hash, so it only chooses and
groups; where equality decides, there are 128 bits of XXH3, or the bytes themselves.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_M)) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, m in (("up", _M), ("down", pow(_M, -1, 1 << 64))):
            _POWERS[name] = np.cumprod(np.full(size, m, np.uint64)) * np.uint64(pow(m, -1, 1 << 64))
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Prefix:
    """Hashes of any ranges of one array of codes."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, length: int) -> np.ndarray:
        """The hash of each window of ``length`` units."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class WordCodes(dict):
    """64 bits of XXH3 for each word; a memo of bounded size."""

    SIZE = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.SIZE:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORD_CODES = WordCodes()


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the bytes between each start and end, as two longs."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    both = b"".join([digest(view[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])
    pairs = np.frombuffer(both, np.int64).reshape(-1, 2)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
