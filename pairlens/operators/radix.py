"""Exact order statistics by radix selection: no sort and no shuffle of rows.

The n-th row of an order is found digit by digit: a pass counts the rows of each value of the next ``DIGIT`` bits,
combined map-side, and goes on with the rows that share the digits found so far. Doubles become
64-bit integers of the same order first. Digits that all rows left share are skipped. When at most ``FEW`` rows
of a group are left, those are ordered.
The first n rows of a group then follow from one comparison per row with the n-th.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.session import lookup_side, materialized

DIGIT = 12
HEX = 15
WIDE_DIGIT = 16
NULL_KEY = np.int64(-(1 << 63))
NAN_KEY = np.int64((1 << 63) - 1)
FEW = 1 << 14


def sortable(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles; NaN comes last."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    keys = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
    return np.where(np.isnan(values), np.int64((1 << 63) - 1), keys)


def order_keys(values: pa.Array) -> np.ndarray:
    """64-bit integers in descending order of doubles: NULL first, NaN last."""
    known = values.is_valid().to_numpy(zero_copy_only=False)
    keys = sortable(-values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False))
    return np.where(known, keys, NULL_KEY)


def values_of(keys: np.ndarray) -> np.ndarray:
    """The doubles of ``order_keys`` integers that are not those of NULL."""
    return -np.where(keys < 0, keys ^ np.int64((1 << 63) - 1), keys).view(np.float64)


def _with_keys(value: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch[value].cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sortable(values))], names=[*batch.schema.names, name]
            )

    return run


def with_sortable(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the sortable integer of a double column; NULL counts as NaN."""
    return df.mapInArrow(_with_keys(value, name), T.StructType(list(df.schema.fields)).add(name, "long"))


def hex_key(digest: Column) -> Column:
    """The leading ``HEX`` digits of a hex digest as a number."""
    return F.conv(F.substring(digest, 1, HEX), 16, 10).cast("bigint")


def nth_rows(
    rows: DataFrame,
    keys: Sequence[str],
    radix: Sequence[str],
    targets: DataFrame,
    largest: int,
    carry: Sequence[str] = (),
    few: int | None = None,
    total: int | None = None,
) -> DataFrame:
    """``(keys.., target, radix.., carry.., equal, inside)`` of the row of rank ``wanted`` (from 1) of each target.

    ``rows`` hold ``keys`` and the 64-bit columns ``radix`` that order them; ``carry`` are columns that follow from those.
    ``targets`` hold ``(keys.., target, wanted)``; ranks beyond a group give nothing. ``largest`` is the size of the
    largest group. ``equal`` rows have the same ``radix``, of which the one sought is number ``inside``: a value of
    any frequency is found without holding its rows.

    Rows left after a pass are written for the next. With ``total``, the number of ``rows``, they are so only
    when an eighth of those or fewer are left: until then ``rows``, to be read from a table, are read again.
    """
    few = FEW if few is None else few
    state = targets.select(*keys, "target", F.col("wanted").alias("__left"))
    left, on = rows, [*keys]
    for name in radix:
        done, apart = 0, True
        while done < 64 and largest > few and apart:
            width = min(DIGIT, 64 - done)
            done += width
            unsigned = F.col(name).bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))
            digit = F.shiftrightunsigned(unsigned, 64 - done).bitwiseAND(F.lit((1 << width) - 1))
            counts = left.groupBy(*on, digit.alias("__digit")).agg(
                F.count(F.lit(1)).alias("__n"), (F.min(name) != F.max(name)).alias("__apart")
            )
            running = Window.partitionBy(*on).orderBy("__digit")
            ends = counts.withColumn("__end", F.sum("__n").over(running))
            found = state.select(*keys, "target", "__left").join(ends, on).where("__left > __end - __n AND __left <= __end")
            before = F.col("__end") - F.col("__n")
            state = materialized(
                found.select(*keys, "target", "__digit", "__n", "__apart", (F.col("__left") - before).alias("__left")), "radix"
            )
            size = state.agg(
                F.count(F.lit(1)).alias("groups"), F.max("__n").alias("rows"), F.max("__apart").alias("apart"), F.sum("__n").alias("all")
            ).first()
            largest, apart = size.rows or 0, bool(size.apart)
            side = state.select(*keys, F.col("target").alias("__target"), F.col("__digit").alias("__found"))
            same = digit == F.col("__found")
            if "target" in on:
                same = same & (F.col("target") == F.col("__target"))
            left = left.join(lookup_side(side, size.groups), [*keys]).where(same)
            left = left.select(*keys, F.col("__target").alias("target"), *radix, *carry)
            if total is None or (size["all"] or 0) * 8 <= total:
                left = materialized(left, "radix-rows")
                total = total and size["all"]
            on = [*keys, "target"]
    carried = [F.min(c).alias(c) for c in carry]
    counts = left.groupBy(*on, *radix).agg(F.count(F.lit(1)).alias("equal"), *carried)
    ends = counts.withColumn("__end", F.sum("equal").over(Window.partitionBy(*on).orderBy(*radix)))
    found = state.select(*keys, "target", "__left").join(ends, on).where("__left > __end - equal AND __left <= __end")
    inside = (F.col("__left") - F.col("__end") + F.col("equal")).alias("inside")
    return found.select(*keys, "target", *radix, *carry, "equal", inside)


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    digest: Column,
    ties: Sequence[str],
    wanted: Column,
    value: str | None = None,
    descending: bool = True,
    quota: DataFrame | None = None,
    few: int | None = None,
) -> DataFrame:
    """The first ``wanted`` rows of each group by value, hex digest and ``ties``, by comparison with the last of them.

    ``wanted`` is an expression over ``group_rows`` and the columns of ``quota`` (``keys`` and more); groups that
    ``quota`` does not name give nothing. Rows without a value (NULL or NaN) come last. Two numbers a row are written
    between the passes; rows of ``df`` are neither shuffled nor sorted. ``ties`` are looked at only where rows that
    agree in value and the digest's first ``HEX`` digits lie on both sides of the cut.
    """
    if value is None:
        signed = F.lit(0.0)
    else:
        signed = (-F.col(value) if descending else F.col(value)).cast("double")
        signed = F.when(F.isnan(signed), F.lit(None)).otherwise(signed)
    slim = df.select(*keys, signed.alias("__signed"), hex_key(digest).alias("__digits"))
    if quota is not None:
        slim = slim.join(lookup_side(quota.select(*keys)), [*keys], "left_semi")
    radix = ["__digits"]
    if value:
        slim = with_sortable(slim, "__signed", "__value")
        radix = ["__value", "__digits"]
    slim = materialized(slim, "row-order")
    sizes = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    if quota is not None:
        sizes = sizes.join(quota, [*keys])
    sizes = materialized(sizes.withColumn("wanted", wanted.cast("bigint")).where("wanted > 0"), "row-targets")
    targets = sizes.where("wanted < group_rows").select(*keys, F.lit(0).alias("target"), "wanted")
    largest = sizes.agg(F.max("group_rows")).first()[0] or 0
    limits = nth_rows(slim, keys, radix, targets, largest, ["__signed"], few)
    mark = lambda x: F.struct(x.isNull().alias("missing"), F.coalesce(x, F.lit(0.0)).alias("signed"))
    last = F.struct(mark(F.col("__signed")).alias("value"), F.lpad(F.lower(F.hex("__digits")), HEX, "0").alias("digest"))
    limits = limits.select(*keys, last.alias("__last"), "equal", "inside")
    # Groups taken whole have no last row.
    limits = materialized(sizes.select(*keys).join(limits, [*keys], "left"), "row-limits")
    spot = F.struct(mark(signed).alias("value"), F.substring(digest, 1, HEX).alias("digest"))
    placed = df.withColumn("__spot", spot).join(lookup_side(limits), [*keys])
    cut = limits.where("inside < equal")
    if cut.isEmpty():
        return placed.where(F.col("__last").isNull() | (F.col("__spot") <= F.col("__last"))).select(*df.columns)
    sure = F.col("__last").isNull() | (F.col("__spot") < F.col("__last")) | (
        (F.col("__spot") == F.col("__last")) & (F.col("inside") == F.col("equal"))
    )
    order = Window.partitionBy(*keys).orderBy(digest, *ties)
    split = placed.where(~sure & (F.col("__spot") == F.col("__last"))).withColumn("__n", F.row_number().over(order))
    return placed.where(sure).select(*df.columns).unionByName(split.where("__n <= inside").select(*df.columns))


def quantiles(df: DataFrame, value: str, levels: Sequence[float], few: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles of a whole column, NULL and NaN left out, as one row ``q0, q1, ..``.

    ``df`` is read once a pass and not written.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(F.lit(0).alias("__all"), (v + 0.0).alias("__v"))
    rows = with_sortable(rows, "__v", "__value")
    spark = df.sparkSession
    steps = spark.createDataFrame(
        [(i, float(level)) for i, level in enumerate(levels)], "i int, level double"
    )
    count = rows.count()
    at = (F.lit(count) - 1) * F.col("level")
    places = steps.select("i", (at - F.floor(at)).alias("part"), F.floor(at).alias("low"), F.ceil(at).alias("high"))
    ends = places.select("i", "part", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("low").alias("at")), F.struct(F.lit(1).alias("side"), F.col("high").alias("at")))).alias("e"))
    targets = ends.select(F.lit(0).alias("__all"), (F.col("i") * 2 + F.col("e.side")).alias("target"), (F.col("e.at") + 1).alias("wanted"))
    found = nth_rows(rows, ["__all"], ["__value"], targets, count, ["__v"], few, count)
    by_level = found.select(F.floor(F.col("target") / 2).cast("int").alias("i"), (F.col("target") % 2).alias("side"), F.col("__v").alias("limit"))
    columns = []
    for i in range(len(levels)):
        low, high = (F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("limit"))) for side in (0, 1))
        part = F.max(F.when(F.col("i") == i, F.col("part")))
        columns.append((low + (high - low) * part).alias(f"q{i}"))
    found = by_level.join(F.broadcast(places.select("i", "part")), "i").agg(*columns)
    return materialized(found, "quantiles")


def _digit_counts(columns: Sequence[str], prefixes: Sequence[int], done: int):
    """``(prefix, digit, n)`` of the packed keys of a task whose first ``done`` bits are one of ``prefixes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(prefixes), 1 << WIDE_DIGIT), np.int64)
        for batch in batches:
            for column in columns:
                for blob in batch[column]:
                    keys = np.frombuffer(blob.as_buffer(), np.int64)
                    unsigned = keys[(keys != NULL_KEY) & (keys != NAN_KEY)].view(np.uint64) ^ np.uint64(1 << 63)
                    for i, prefix in enumerate(prefixes):
                        mine = unsigned[unsigned >> np.uint64(64 - done) == np.uint64(prefix)] if done else unsigned
                        digit = (mine >> np.uint64(64 - done - WIDE_DIGIT)) & np.uint64((1 << WIDE_DIGIT) - 1)
                        counts[i] += np.bincount(digit.astype(np.int64), minlength=1 << WIDE_DIGIT)
        at, digit = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(digit), pa.array(counts[at, digit])], names=["at", "digit", "n"])

    return run


def packed_quantiles(chunks: DataFrame, columns: Sequence[str], levels: Sequence[float]) -> list[float | None]:
    """Exact linear-interpolation quantiles of all values in ``columns``, packed ``order_keys``; NULL and NaN left out.

    A pass counts the values of the next ``WIDE_DIGIT`` bits behind the few prefixes sought, one array per task and prefix.
    The driver holds those counts, summed: at most ``2**WIDE_DIGIT`` numbers for each of two ranks a level.
    """
    sought: dict[int, tuple[int, int]] = {}  # rank: prefix, rank among the values that share it
    ends: list[tuple[int, int, float]] = []
    for done in range(0, 64, WIDE_DIGIT):
        prefixes = sorted({prefix for prefix, _ in sought.values()}) or [0]
        found = chunks.select(*columns).mapInArrow(_digit_counts(columns, prefixes, done), "at long, digit long, n long")
        counts = np.zeros((len(prefixes), 1 << WIDE_DIGIT), np.int64)
        for row in found.groupBy("at", "digit").agg(F.sum("n").alias("n")).collect():
            counts[row["at"], row["digit"]] = row["n"]
        if not done:
            total = int(counts.sum())
            if not total:
                return [None] * len(levels)
            # Keys descend with the values.
            places = [(total - 1) * level for level in levels]
            ends = [(total - int(np.floor(x)), total - int(np.ceil(x)), x - np.floor(x)) for x in places]
            sought = {rank: (0, rank) for low, high, _ in ends for rank in (low, high)}
        running = np.cumsum(counts, axis=1)
        for rank, (prefix, left) in sought.items():
            i = prefixes.index(prefix)
            digit = int(np.searchsorted(running[i], left))
            sought[rank] = (prefix << WIDE_DIGIT | digit, left - int(running[i][digit] - counts[i][digit]))
    values = {rank: float(values_of(np.array([prefix - (1 << 63)]))[0]) for rank, (prefix, _) in sought.items()}
    return [values[low] + (values[high] - values[low]) * part for low, high, part in ends]
