"""Hashes of all windows of a text at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Two odd multipliers.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of a base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            steps = np.full(size, self.base, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps = np.full(size, self.inverse, np.uint64)
            steps[0] = 1
            self.down = np.cumprod(steps)
        return self.up[:n], self.down[:n]


POWERS = tuple(Powers(base) for base in BASES)


def codes(text: str) -> np.ndarray:
    """The code points of a text, each spread over 64 bits."""
    return mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def window_hashes(spread: np.ndarray, starts: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of spread[s : s + width] for every start; equal windows have equal hashes wherever they lie."""
    n = len(spread)
    up, down = POWERS[which].upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(spread * down[:n], out=sums[1:])
    return mix((sums[starts + width] - sums[starts]) * up[starts]).view(np.int64)
