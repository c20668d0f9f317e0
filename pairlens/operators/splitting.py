"""Multinomial resampling without shuffling draws: counts split down a tree of group ranges.

The groups of a dataset, in order of their index, form leaves of equal size. A replicate's G draws are split between the halves of
the tree by keyed binomials, from the root down to the leaves: given the draws of a range, those of its left
half are binomial with that half's share of the groups. A leaf then deals its own draws to its groups.
Every count is a function of its key, totals are exactly G, and what is shuffled is one row per
group and block of replicates and one count per leaf and replicate, never a row per draw.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.session import spread

LEAF_GROUPS = 1024
BLOCK = 256
WINDOW = 12.0


def uniform60(seed: int, *keys: object) -> int:
    """The value of ``functions.hashing.uniform60`` for the same keys."""
    return int(hashlib.md5("|".join(str(k) for k in (seed, *keys)).encode()).hexdigest()[:15], 16)


def binomial(trials: int, share: float, u: float) -> int:
    """The binomial count at quantile ``u``: summed from twelve standard deviations below the mean to twelve above."""
    if not trials or share >= 1:
        return trials
    mean = trials * share
    width = WINDOW * math.sqrt(mean * (1 - share)) + WINDOW
    low, high = max(0, math.floor(mean - width)), min(trials, math.ceil(mean + width))
    whole, yes, no = math.lgamma(trials + 1), math.log(share), math.log(1 - share)
    logs = [whole - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * yes + (trials - k) * no for k in range(low, high)]
    return low + int(np.count_nonzero(np.cumsum(np.exp(logs)) < u))


def leaf_counts(seed: int, dataset: str, replicate: int, groups: int, leaf_groups: int) -> list[int]:
    """How many of ``groups`` draws fall on each leaf of ``leaf_groups`` groups."""
    leaves = -(-groups // leaf_groups)
    span = 1 << max(0, (leaves - 1).bit_length())
    counts = [groups]
    while span > 1:
        half = span // 2
        below = []
        for node, trials in enumerate(counts):
            start = node * span * leaf_groups
            size = min(groups - start, span * leaf_groups)
            left = min(size, half * leaf_groups)
            u = uniform60(seed, dataset, replicate, half, node) / 2.0**60
            first = binomial(trials, left / size, u) if size > 0 else 0
            below += [first, trials - first]
        counts, span = below, half
        counts = counts[: -(-leaves // span)]
    return counts


def _split(seed: int, leaf_groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = leaf_counts(seed, row["dataset_trait"], row["replicate"], row["group_rows"], leaf_groups)
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["dataset_trait"]] * n, pa.string()),
                        pa.array(range(n), pa.int64()),
                        pa.array([row["replicate"] // BLOCK] * n, pa.int64()),
                        pa.array([row["replicate"]] * n, pa.int64()),
                        pa.array(counts, pa.int64()),
                    ],
                    names=["dataset_trait", "leaf", "block", "replicate", "draws"],
                )

    return run


def _mixed(seed: int, dataset: str, replicate: int, leaf: int, draws: int, size: int) -> np.ndarray:
    """Uniform indexes from a 64-bit mixing function, for large tables."""
    base = int.from_bytes(hashlib.md5(f"{seed}|{dataset}|{replicate}|{leaf}".encode()).digest()[:8], "big")
    x = np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(base)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64) % size


def _deal(seed: int, fast: bool, columns: Sequence[str]):
    """Weights of a leaf's groups in a block of replicates, from the leaf's counts."""

    def run(groups: pa.Table, counts: pa.Table) -> pa.Table:
        groups = groups.sort_by("group_index")
        size, parts = groups.num_rows, []
        for row in counts.to_pylist():
            if fast:
                drawn = _mixed(seed, row["dataset_trait"], row["replicate"], row["leaf"], row["draws"], size)
            else:
                keys = (row["dataset_trait"], row["replicate"], "leaf", row["leaf"])
                drawn = np.array([uniform60(seed, *keys, k) % size for k in range(row["draws"])], np.int64)
            weight = np.bincount(drawn, minlength=size)
            at = np.flatnonzero(weight)
            parts.append((np.full(len(at), row["replicate"]), at, weight[at]))
        replicate, at, weight = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
        out = groups.select(list(columns)).take(pa.array(at, pa.int64()))
        return out.append_column("replicate", pa.array(replicate, pa.int64())).append_column("weight", pa.array(weight, pa.int64()))

    return run


def split_draws(
    indexed: DataFrame, replicates: int, seed: int = 42, leaf_groups: int = LEAF_GROUPS, fast_hash: bool = False
) -> DataFrame:
    """Indexed group statistics times replicates with the multinomial ``weight`` of each group that is drawn.

    ``indexed`` is as ``resample.group_index`` gives it: ``group_index`` from 0 and ``group_rows`` per dataset.
    """
    leafed = indexed.withColumn("leaf", F.floor(F.col("group_index") / leaf_groups).cast("bigint"))
    sizes = indexed.groupBy("dataset_trait").agg(F.max("group_rows").alias("group_rows"))
    copies = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))))
    counts = spread(copies, "dataset_trait", "replicate").mapInArrow(
        _split(seed, leaf_groups), "dataset_trait string, leaf long, block long, replicate long, draws long"
    )
    last = (replicates - 1) // BLOCK
    blocks = leafed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))
    kept = [f for f in indexed.schema.fields if f.name not in ("group_index", "group_rows")]
    schema = T.StructType([*kept, T.StructField("replicate", T.LongType()), T.StructField("weight", T.LongType())])
    keys = ["dataset_trait", "leaf", "block"]
    dealt = blocks.groupBy(*keys).cogroup(counts.groupBy(*keys))
    return dealt.applyInArrow(_deal(seed, fast_hash, [f.name for f in kept]), schema)
