"""Seeded, order-free randomness: every draw is a hash of its own key.

A draw depends on (seed, key) only, so a lost task recomputes the same values
and no generator state has to travel between partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIFORM_RANGE = 1 << 32


def keyed_text(seed: int | str, *keys: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[key.cast("string") for key in keys])


def hash_order(seed: int | str, *keys: Column) -> Column:
    """Uniform 128-bit ordering key as hex text."""
    return F.md5(keyed_text(seed, *keys))


def uniform32(seed: int | str, *keys: Column, fast: bool = False) -> Column:
    """Uniform integer in [0, 2**32). ``fast`` swaps md5 for xxhash64."""
    if fast:
        return F.xxhash64(F.lit(str(seed)), *keys).bitwiseAND(F.lit(UNIFORM_RANGE - 1))
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("bigint")


def uniform60(seed: int | str, *keys: Column, fast: bool = False) -> Column:
    """Uniform integer in [0, 2**60), or [0, 2**63) if ``fast``: wide enough for an index of any table.

    Taken modulo n, the odds of two values differ by less than n / 2**60.
    """
    if fast:
        return F.xxhash64(F.lit(str(seed)), *keys).bitwiseAND(F.lit((1 << 63) - 1))
    return F.conv(F.substring(hash_order(seed, *keys), 1, 15), 16, 10).cast("bigint")


def poisson_thresholds() -> list[int]:
    """Poisson(1) cumulative probabilities scaled to 32 bits, until they saturate."""
    thresholds: list[int] = []
    cumulative, k = 0.0, 0
    while True:
        cumulative += math.exp(-1.0) / math.factorial(k)
        scaled = round(cumulative * UNIFORM_RANGE)
        if scaled >= UNIFORM_RANGE:
            return thresholds
        thresholds.append(scaled)
        k += 1


def poisson_weight(uniform: Column) -> Column:
    """Inverse-CDF Poisson(1) count of a 32-bit uniform."""
    steps = poisson_thresholds()
    weight = F.when(uniform < steps[0], 0)
    for count, threshold in enumerate(steps[1:], 1):
        weight = weight.when(uniform < threshold, count)
    return weight.otherwise(len(steps)).cast("bigint")
