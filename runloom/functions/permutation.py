"""Keyed permutations of row numbers: a place for every row without a sort.

A number below n is written as two digits to the base ``side``, the least with side * side >= n, and
sent through Feistel rounds over them; a result of n or more is sent through again until it is
below n (cycle walking). Only whole numbers below 2^63 occur, so that columns, NumPy and SQL give
the same places for up to 10^15 rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

PRIME = 2147483647
ROUNDS = 5


def side_of(n: int) -> int:
    return max(1, math.isqrt(max(n, 1) - 1) + 1)


def round_keys(seed: int, epoch: int) -> list[int]:
    """A number below PRIME for each round."""
    keys = []
    for i in range(ROUNDS):
        k = (69621 * (seed % PRIME) + 39373 * (epoch % PRIME) + 26544357 * (i + 1)) % PRIME
        keys.append((k * k + 48271 * k + i) % PRIME)
    return keys


def permuted(position: Column, n: int, keys: list[int]) -> Column:
    """The place of a row number below ``n``: each of 0..n-1 exactly once."""
    side = F.lit(side_of(n)).cast("long")
    array = F.array(*[F.lit(k).cast("long") for k in keys])

    def once(x: Column) -> Column:
        def turn(s: Column, key: Column) -> Column:
            t = (s["r"] * F.lit(48271) + key) % F.lit(PRIME)
            return F.struct(s["r"].alias("l"), ((s["l"] + (t * t) % F.lit(PRIME)) % side).alias("r"))

        start = F.struct(F.floor(x / side).cast("long").alias("l"), (x % side).alias("r"))
        return F.aggregate(array, start, turn, lambda s: s["l"] * side + s["r"])

    # No walk is longer than the numbers from n on; few rows walk at all, as they are about 2 * sqrt(n).
    over = side_of(n) ** 2 - n
    first = once(position.cast("long"))
    if not over:
        return first
    walk = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(over)), x, lambda y, _: F.when(y < n, y).otherwise(once(y)))
    return F.transform(F.array(first), lambda x: F.when(x < n, x).otherwise(walk(x)))[0]


def permuted_numbers(position: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """The same for an array of row numbers."""
    side = side_of(n)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x // side, x % side
        for key in keys:
            t = (right * 48271 + key) % PRIME
            left, right = right, (left + t * t % PRIME) % side
        return left * side + right

    out = once(np.asarray(position, dtype=np.int64))
    while (beyond := out >= n).any():
        out[beyond] = once(out[beyond])
    return out
