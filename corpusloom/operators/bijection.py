"""An order that can be computed either way: position of a sample, and sample at a position.

A keyed Feistel network permutes the pairs (left, right) of [0, a) x [0, b): in
turn one half moves by a keyed hash of the other, modulo its own size, which can
be undone. Numbers 0..n-1 are pairs, left * b + right; the few pairs from n on
are walked over by permuting again, which keeps it a bijection on 0..n-1. A walk ends
after as many steps as there are such pairs; the sides are chosen so that they
are ``MAX_EXCESS`` or fewer, or as few as there can be.

Nothing is ranked, sorted or shuffled: a sample's place in the epoch follows from
its number alone, on the JVM as column expressions and in the shard reader over
arrays. So a resume knows which samples are left before any of them is read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.draws import FEISTEL, HASHES, sort_key
from corpusloom.functions.scalars import idiv

ROUNDS = 8
MAX_EXCESS = 16
# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def sides(n: int) -> tuple[int, int]:
    """a and b, near the root of n, with a * b at or little above n."""
    root = math.isqrt(max(n - 1, 0)) + 1
    best: tuple[int, int] | None = None
    # The excess over n is n's distance to a multiple of a: small ones are common.
    for a in range(root, 64 * root + 1):
        excess = -n % a
        if best is None or excess < best[0]:
            best = (excess, a)
            if excess <= MAX_EXCESS:
                break
    excess, a = best or (0, 1)
    return a, max(-(-n // a), 1)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _xx_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of one 8-byte number, as Spark's ``xxhash64`` chains it."""
    h = seed + _P5 + np.uint64(8)
    h = _rotated(h ^ (_rotated(value * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Bijection:
    """The order of ``n`` samples that seed + epoch decide."""

    n: int
    seed: int
    epoch: int
    hash_fn: str = "xxhash64"

    def __post_init__(self) -> None:
        if self.hash_fn not in HASHES:
            raise ValueError(f"Unknown hash_fn {self.hash_fn!r}. Available: {list(HASHES)}")
        if self.n < 0:
            raise ValueError(f"The number of samples must not be negative: {self.n}")

    def _rounds(self, back: bool) -> list[int]:
        return list(range(ROUNDS))[:: -1 if back else 1]

    # As column expressions.

    def _column(self, number: Column, back: bool) -> Column:
        a, b = sides(self.n)

        def moved(state: Column, k: Column) -> Column:
            def by(half: Column, size: int) -> Column:
                shift = sort_key(self.hash_fn, FEISTEL, self.seed + self.epoch, k, half) % F.lit(size).cast("bigint")
                return -shift if back else shift

            left = F.pmod(state["left"] + by(state["right"], a), F.lit(a).cast("bigint"))
            right = F.pmod(state["right"] + by(state["left"], b), F.lit(b).cast("bigint"))
            even = k % 2 == 0
            return F.struct(
                F.when(even, left).otherwise(state["left"]).alias("left"),
                F.when(even, state["right"]).otherwise(right).alias("right"),
            )

        def once(value: Column) -> Column:
            size = F.lit(b).cast("bigint")
            halves = F.struct(idiv(value, b).alias("left"), F.pmod(value, size).alias("right"))
            rounds = F.array(*[F.lit(k).cast("bigint") for k in self._rounds(back)])
            return F.aggregate(rounds, halves, moved, lambda s: s["left"] * size + s["right"])

        walks = F.array_repeat(F.lit(0), a * b - self.n)
        # A number below n is where the walk ends.
        return F.aggregate(walks, once(number), lambda at, _: F.when(at >= self.n, once(at)).otherwise(at))

    def position(self, seq_idx: Column) -> Column:
        """Where in the epoch the sample comes."""
        return self._column(seq_idx.cast("bigint"), back=False)

    def sample(self, pos: Column) -> Column:
        """Which sample comes at the position."""
        return self._column(pos.cast("bigint"), back=True)

    # Over arrays.

    def _shift(self, k: int, half: np.ndarray) -> np.ndarray:
        keys = (FEISTEL, self.seed + self.epoch, k)
        if self.hash_fn == "md5":
            head = ":".join(map(str, keys)) + ":"
            return np.array([int(hashlib.md5(f"{head}{h}".encode()).hexdigest()[:15], 16) for h in half.tolist()], np.int64)
        with np.errstate(over="ignore"):
            h = np.full(len(half), 42, np.uint64)
            for key in keys:
                h = _xx_long(np.full(len(half), key, np.int64).view(np.uint64), h)
            h = _xx_long(half.view(np.uint64), h)
        return (h >> np.uint64(4)).view(np.int64)

    def _once(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        a, b = sides(self.n)
        left, right = numbers // b, numbers % b
        sign = -1 if back else 1
        for k in self._rounds(back):
            if k % 2 == 0:
                left = (left + sign * (self._shift(k, right) % a)) % a
            else:
                right = (right + sign * (self._shift(k, left) % b)) % b
        return left * b + right

    def _array(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        found = self._once(np.asarray(numbers, np.int64), back)
        while (over := np.flatnonzero(found >= self.n)).size:
            found[over] = self._once(found[over], back)
        return found

    def positions(self, seq_idx: np.ndarray) -> np.ndarray:
        return self._array(seq_idx, back=False)

    def samples(self, pos: np.ndarray) -> np.ndarray:
        return self._array(pos, back=True)
