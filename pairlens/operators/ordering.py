"""Exact positions inside groups of any size, without one task per group.

``row_number() OVER (PARTITION BY key ...)`` sorts each key in a single task, so
a key with a third of all rows would stall a cluster. Here every key's order is
cut into ranges; rows are numbered inside a range and shifted by the
number of rows in the ranges before it. The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.session import lookup_side, materialized

#: Values to a range, values for each one picked to cut the ranges, and the most picked in all.
RANGE_VALUES = 1 << 20
PICK_EVERY = 1 << 12
PICKS = 1 << 18


def _number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], with_total: bool) -> DataFrame:
    """Number rows that already carry ``__range``, an order-preserving cut per key.

    The offsets are one row per key and range, written down so that the join sees their true size.
    """
    counts = df.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    running = Window.partitionBy(*keys).orderBy("__range")
    offsets = materialized(
        counts.select(
            *keys,
            "__range",
            (F.sum("__n").over(running) - F.col("__n")).alias("__before"),
            F.sum("__n").over(Window.partitionBy(*keys)).alias("group_rows"),
        ),
        "offsets",
    )
    placed = df.join(offsets, [*keys, "__range"])
    inside = Window.partitionBy(*keys, "__range").orderBy(*order)
    positioned = placed.withColumn("position", F.col("__before") + F.row_number().over(inside))
    dropped = ["__range", "__before"] + ([] if with_total else ["group_rows"])
    return positioned.drop(*dropped)


def positions_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    digest: str,
    ties: Sequence[str] = (),
    hex_digits: int = 3,
    with_total: bool = False,
) -> DataFrame:
    """1-based ``position`` per key in ascending order of a uniform hex digest.

    A uniform digest needs no statistics: its leading digits are the ranges.
    """
    cut = df.withColumn("__range", F.substring(digest, 1, hex_digits))
    order = [F.col(digest), *[F.col(t) for t in ties]]
    return _number(cut, keys, order, with_total)


def _runs(keys: Sequence[str]):
    """Per row of a sorted batch, where its run of equal ``keys`` begins and ends, and whether the run may go on outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for key in keys:
                codes = batch[key].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], n) - 1
            run_of = np.cumsum(new) - 1
            place = np.arange(n)
            edge = (run_of == 0) | (run_of == len(first) - 1)
            columns = [pa.array(place - first[run_of]), pa.array(last[run_of] - place), pa.array(edge)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, "__back", "__ahead", "__edge"]
            )

    return run


def positions_by_value(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    digest: str,
    ties: Sequence[str] = (),
    descending: bool = True,
    with_total: bool = False,
    with_rank: bool = False,
) -> DataFrame:
    """1-based ``position`` per key by value, then digest, then ``ties``; NULL values first.

    One range exchange on that whole order, so that neither a hot key nor a hot value fills a task. A row's number in its
    partition becomes a position by one offset per key and partition. ``with_rank`` adds ``rank``, the average position of
    all rows of equal value: inside a batch it follows from the ends of the value's run, and only
    runs at a batch's ends, at most two a batch, are merged with those of their neighbours.
    """
    signed = F.col("__signed")
    order = [*keys, signed, digest, *ties]
    prepared = df.withColumn("__signed", (-F.col(value) if descending else F.col(value)) + F.lit(0.0))
    dealt = prepared.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("__at", F.monotonically_increasing_id())
    if with_rank:
        runs = [("__back", T.LongType()), ("__ahead", T.LongType()), ("__edge", T.BooleanType())]
        schema = T.StructType([*dealt.schema.fields, *[T.StructField(*r) for r in runs]])
        dealt = dealt.mapInArrow(_runs([*keys, "__signed"]), schema)
    placed = materialized(dealt.withColumn("__part", F.shiftright("__at", 33)), "ordered")
    pieces = placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    running = Window.partitionBy(*keys).orderBy("__part")
    offsets = materialized(
        pieces.select(
            *keys,
            "__part",
            (F.sum("__n").over(running) - F.col("__n") - F.col("__first") + 1).alias("__shift"),
            F.sum("__n").over(Window.partitionBy(*keys)).alias("group_rows"),
        ),
        "offsets",
    )
    placed = placed.join(lookup_side(offsets), [*keys, "__part"]).withColumn("position", F.col("__at") + F.col("__shift"))
    if with_rank:
        low, high = F.col("position") - F.col("__back"), F.col("position") + F.col("__ahead")
        edges = placed.where("__edge").groupBy(*keys, "__signed").agg(F.min(low).alias("__low"), F.max(high).alias("__high"))
        edges = lookup_side(materialized(edges, "run-borders"))
        placed = placed.join(edges, [*keys, "__signed"], "left")
        ends = F.coalesce("__low", low) + F.coalesce("__high", high)
        placed = placed.withColumn("rank", ends / 2).drop("__low", "__high", "__back", "__ahead", "__edge")
    dropped = ["__signed", "__at", "__part", "__shift"] + ([] if with_total else ["group_rows"])
    return placed.drop(*dropped)


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and for each entry its place among them."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], inverse


def picked(keys: np.ndarray, seed: int) -> np.ndarray:
    """A few of ``keys`` at random, the same for the same seed. Only the balance of ranges rests on them."""
    rng = np.random.default_rng(seed)
    return keys[rng.integers(0, len(keys), -(-len(keys) // PICK_EVERY))]


def _send_values(column: str, bounds: dict[int, np.ndarray]):
    """The distinct packed keys of a chunk with their counts, one row per range of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, code, blob in zip(batch["chunk"].to_pylist(), batch["code"].to_pylist(), batch[column], strict=True):
                keys = np.sort(np.frombuffer(blob.as_buffer(), np.int64))
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                distinct, counts = keys[first], np.diff(np.append(first, len(keys)))
                cuts = np.concatenate([[0], np.searchsorted(distinct, bounds[code]), [len(distinct)]])
                shards = np.flatnonzero(cuts[1:] > cuts[:-1])
                parts = [slice(cuts[k], cuts[k + 1]) for k in shards]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(shards), chunk)),
                        pa.array(np.full(len(shards), code)),
                        pa.array(shards),
                        pa.array([int(counts[p].sum()) for p in parts], pa.int64()),
                        pa.array([distinct[p].tobytes() for p in parts], pa.binary()),
                        pa.array([counts[p].tobytes() for p in parts], pa.binary()),
                    ],
                    names=["chunk", "code", "shard", "n", "keys", "counts"],
                )

    return run


def _judge_values(table: pa.Table) -> pa.Table:
    """For each key sent to a range, how many values of the range come before it and how many are equal."""
    joined = lambda name: np.frombuffer(b"".join(table[name].to_pylist()), np.int64)
    keys, counts = joined("keys"), joined("counts")
    sizes = [len(b) // 8 for b in table["keys"].to_pylist()]
    _, inverse = grouped(keys)
    equal = np.zeros(inverse.max() + 1, np.int64)
    np.add.at(equal, inverse, counts)
    less = np.cumsum(equal) - equal
    borders = np.concatenate([[0], np.cumsum(sizes)])
    blobs = lambda x: pa.array([x[inverse[a:b]].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)], pa.binary())
    return pa.table({**{c: table[c] for c in ("chunk", "code", "shard", "n")}, "less": blobs(less), "equal": blobs(equal)})


def value_bounds(chunks: DataFrame, picks: str, total: int) -> dict[int, np.ndarray]:
    """Keys that cut the values of each ``code`` into ranges of about equal size, by the chunks' picked keys."""
    spark = chunks.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(RANGE_VALUES, max(1 << 14, total // partitions))
    share = min(1.0, PICKS * PICK_EVERY / max(1, total))
    few = F.expr(f"substring({picks}, 1, 8 * greatest(1, int(length({picks}) / 8 * {share}D)))")
    found: dict[int, list[bytes]] = {}
    rows: dict[int, int] = {}
    for row in chunks.select("code", "n", few.alias("picks")).collect():
        found.setdefault(row["code"], []).append(bytes(row["picks"]))
        rows[row["code"]] = rows.get(row["code"], 0) + row["n"]
    out = {}
    for code, blobs in found.items():
        keys, ranges = np.sort(np.frombuffer(b"".join(blobs), np.int64)), -(-rows[code] // size)
        out[code] = np.unique(keys[np.arange(1, ranges) * len(keys) // ranges])
    return out


def packed_places(chunks: DataFrame, column: str, picks: str, total: int) -> DataFrame:
    """``(chunk, <column>_places)``: for the distinct packed keys of a chunk, how many values of its ``code`` come before each and are equal.

    ``chunks`` hold ``(chunk, code, n, <column>, <picks>)``, the keys of one code each. A key goes to its range once per chunk,
    however frequent, with its count, so that no value fills a task; the rows themselves stay where they are. Places are arrays
    ``(shard, before, less, equal)``: ``before`` counts the values of all lower ranges.
    """
    sent = chunks.mapInArrow(
        _send_values(column, value_bounds(chunks, picks, total)), "chunk long, code long, shard long, n long, keys binary, counts binary"
    )
    judged = sent.groupBy("code", "shard").applyInArrow(
        _judge_values, "chunk long, code long, shard long, n long, less binary, equal binary"
    )
    ordered = materialized(judged, "ordered")
    sizes = ordered.groupBy("code", "shard").agg(F.sum("n").alias("n"))
    running = Window.partitionBy("code").orderBy("shard")
    offsets = materialized(sizes.select("code", "shard", (F.sum("n").over(running) - F.col("n")).alias("before")), "offsets")
    placed = ordered.join(lookup_side(offsets), ["code", "shard"])
    return placed.groupBy("chunk").agg(F.collect_list(F.struct("shard", "before", "less", "equal")).alias(f"{column}_places"))


def unpacked_places(places: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of values before and equal, for the distinct keys of a chunk in ascending order."""
    places = sorted(places, key=lambda p: p["shard"])
    less = np.concatenate([np.frombuffer(p["less"], np.int64) + p["before"] for p in places])
    return less, np.concatenate([np.frombuffer(p["equal"], np.int64) for p in places])
