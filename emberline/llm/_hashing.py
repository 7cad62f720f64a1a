"""Vectorised hashing of byte strings: prefix polynomials modulo 2**64 over random byte values."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U) * U(BASE))


_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(size, b, U)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Prefixes:
    """Hashes of any substrings of ``data`` (uint8)."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, U)
            np.cumsum(byte_values()[data] * up[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, k: int) -> np.ndarray:
        """Hash of each window of ``k`` bytes."""
        n = len(self.sums) - k
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])
