"""Hashes of words, word windows and their minimizers as NumPy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: An odd multiplier of window hashes (also 3 modulo 4), and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C17
_P_INV = pow(_P, -1, 1 << 64)
_CACHE = 300_000


class WordHashes(dict):
    """64-bit hashes by word; emptied when it grows large, which changes no hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class _Powers:
    def __init__(self) -> None:
        self.up, self.down = self._make(4096)

    @staticmethod
    def _make(n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full(n, _P, np.uint64), np.full(n, _P_INV, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = self._make(2 * n)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` consecutive words; the polynomial in the words' hashes, shifted to start at one power."""
    n = len(h)
    if n < size:
        return h[:0]
    up, down = _powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each `size` consecutive entries, by doubling."""
    if len(x) < size:
        return x[:0]
    width, out = 1, x
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
