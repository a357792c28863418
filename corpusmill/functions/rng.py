"""A seeded generator with the bits of the public xoshiro256** algorithm, seeded by splitmix64. (RNG1)"""

from __future__ import annotations

import math

from corpusmill.functions.hashing import GOLDEN, MIX1, MIX2

_ALL = (1 << 64) - 1


def _turned(x: int, k: int) -> int:
    return (x << k | x >> (64 - k)) & _ALL


class Rng:
    """64-bit draws, uniform numbers of 24 bits, numbers below n, and normal ones by the polar method."""

    def __init__(self, seed: int = 1234567891011):
        self.state, self.spare = [], None
        for _ in range(4):
            seed = (seed + GOLDEN) & _ALL
            z = (seed ^ seed >> 30) * MIX1 & _ALL
            z = (z ^ z >> 27) * MIX2 & _ALL
            self.state.append(z ^ z >> 31)

    def bits(self) -> int:
        a, b, c, d = self.state
        drawn = _turned(b * 5 & _ALL, 7) * 9 & _ALL
        c, d = c ^ a, d ^ b
        self.state = [a ^ d, b ^ c, (c ^ b << 17) & _ALL, _turned(d, 45)]
        return drawn

    def uniform(self) -> float:
        return (self.bits() >> 40) / 16777216.0

    def below(self, n: int) -> int:
        if n <= 0:
            raise ValueError("nothing is below 0")
        return self.bits() % n

    def normal(self, mean: float = 0.0, deviation: float = 1.0) -> float:
        if self.spare is not None:
            z, self.spare = self.spare, None
            return mean + deviation * z
        while True:
            u, v = self.uniform() * 2 - 1, self.uniform() * 2 - 1
            s = u * u + v * v
            if 0 < s < 1:
                break
        m = math.sqrt(-2 * math.log(s) / s)
        self.spare = v * m
        return mean + deviation * u * m
