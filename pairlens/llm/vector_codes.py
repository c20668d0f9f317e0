"""Vector codes: product quantisation with exact nearest entries by sliced prefix masks.

Vectors become integers floor(scale * x) and are cut into equal consecutive parts. Each part has a codebook; a
vector's code names the nearest entry (squared Euclidean distance, ties to the lower index) of each.

A codebook keeps, for each coordinate, its entries' values in order and, for each prefix of that order, the set of the
prefix's entries as a mask of 64-bit words. A radius cuts a range out of each coordinate's order; the entries in it are
the difference of two prefix masks, and the masks of all coordinates ANDed hold every entry whose distance is within the
radius. The search starts from the codebook's own spacing. Where the best candidate lies beyond the radius, its distance
is the next radius, and where there is none, the radius doubles; it ends when the best candidate lies
within, so the result is exact. Distances are computed for the 64 entries of a mask word at a time, and only for words
that hold a candidate.

Training: a codebook starts as the parts of the smallest ids; each round assigns all parts and
replaces each entry by the floored mean of its parts. Tasks return sums per entry; what reaches the driver is one
codebook, whatever the number of vectors.

Cases: vectors that are null, empty or hold a null, NaN or infinite component are dropped, as are those whose length
is not that of the smallest id's vector. A length that the parts do not divide is cut as evenly as whole components
allow. Integers beyond +-2**24 count as that bound, so distances fit a long. Rows that repeat an id are all coded; the first
codebook takes the least vector of an id. Null ids are coded but start no entry. With fewer ids than entries a codebook is
smaller; with none, codes and errors are null. Empty tables give none. Columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import fresh_name, materialized
from pairlens.session import lookup_side

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BOUND = 1 << 24
EXACT = 1 << 53
SPAN = 1 << 16
ROWS = 1024
HEAVY = 200


def borders(width: int, parts: int) -> list[int]:
    """Where the parts of a vector of ``width`` components begin, and its end."""
    return [width * k // parts for k in range(parts + 1)]


class Slicer:
    """Exact nearest entries of one codebook."""

    def __init__(self, entries: np.ndarray):
        count, width = entries.shape
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.ordered = np.ascontiguousarray(np.take_along_axis(entries, order, axis=0).T)
        words = -(-count // 64)
        one = np.zeros((count, words), np.uint64)
        one[np.arange(count), np.arange(count) // 64] = np.uint64(1) << (np.arange(count) % 64).astype(np.uint64)
        self.prefix = np.zeros((width, count + 1, words), np.uint64)
        for d in range(width):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(one[order[:, d]], axis=0)
        self.all = np.bitwise_or.reduce(one, axis=0)
        self.low = self.ordered[:, 0] if count else np.zeros(width, np.int64)
        spans = self.ordered[:, -1] - self.low + 2
        # Ranks of all values a narrow coordinate can take; a wide one is searched.
        self.ranks = [
            np.searchsorted(values, np.arange(low, low + span), side="left") if span <= SPAN else None
            for values, low, span in zip(self.ordered, self.low.tolist(), spans.tolist(), strict=True)
        ]
        self.squares = (entries * entries).sum(axis=1)
        spacing = [np.partition(((entries - e) ** 2).sum(axis=1), 1)[1] for e in entries] if count > 1 else [0]
        self.radius = int(np.sqrt(np.median(spacing))) + 1

    def candidates(self, rows: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries of which no coordinate is further than ``radius`` from the row's."""
        masks = np.repeat(self.all[None], len(rows), axis=0)
        for d in range(len(self.ordered)):
            low, high = self._rank(d, rows[:, d] - radius), self._rank(d, rows[:, d] + radius + 1)
            masks &= self.prefix[d].take(high, axis=0) ^ self.prefix[d].take(low, axis=0)
        return masks

    def _rank(self, d: int, values: np.ndarray) -> np.ndarray:
        """How many entries lie below each value in coordinate ``d``."""
        if self.ranks[d] is None:
            return np.searchsorted(self.ordered[d], values, side="left")
        return self.ranks[d].take(values - self.low[d], mode="clip")

    def best(self, rows: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest candidate of each row and its squared distance; none and a huge one where there is no candidate."""
        entry = np.full(len(rows), -1, np.int64)
        distance = np.full(len(rows), np.iinfo(np.int64).max)
        exact = np.abs(rows).max(initial=0) ** 2 * rows.shape[1] * 4 < EXACT and self.squares.max(initial=0) * 4 < EXACT
        kind = np.float64 if exact else np.int64
        squares = (rows * rows).sum(axis=1)
        for k in range(masks.shape[1]):
            at = np.flatnonzero(masks[:, k])
            if not len(at):
                continue
            block = self.entries[64 * k : 64 * k + 64]
            gap = rows[at].astype(kind) @ (block.T.astype(kind) * -2) + self.squares[64 * k : 64 * k + 64].astype(kind)
            inside = np.unpackbits(masks[at, k : k + 1].view(np.uint8), axis=1, bitorder="little", count=len(block))
            np.copyto(gap, np.inf if exact else np.iinfo(np.int64).max, where=inside == 0)
            nearest = gap.argmin(axis=1)
            found = gap[np.arange(len(at)), nearest].astype(np.int64) + squares[at]
            better = found < distance[at]
            entry[at[better]], distance[at[better]] = nearest[better] + 64 * k, found[better]
        return entry, distance

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry, the lower index in a tie."""
        entry = np.empty(len(rows), np.int64)
        distance = np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        radius = np.full(len(rows), self.radius, np.int64)
        while len(open_):
            one, gap = self.best(rows[open_], self.candidates(rows[open_], radius[open_]))
            done = (one >= 0) & (gap <= radius[open_] ** 2)
            entry[open_[done]], distance[open_[done]] = one[done], gap[done]
            wider = np.where(one >= 0, np.sqrt(np.where(one >= 0, gap, 0)).astype(np.int64) + 1, radius[open_] * 2)
            radius[open_] = wider
            open_ = open_[~done]
        return entry, distance


@dataclass
class Codebooks:
    """Integer codebooks, one (entries, width of the part) array for each part, of vectors ``width`` components long."""

    width: int
    books: list[np.ndarray]

    def text(self) -> str:
        """All components in decimal, by part, entry and position."""
        return ",".join(str(x) for book in self.books for x in book.ravel().tolist())


def _integers(scale: int):
    """Rows whose vector is whole and finite, as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten()
            null = np.asarray(flat.is_null())
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.zeros(len(sizes), bool)
            bad[owner[null | ~np.isfinite(values)]] = True
            kept = np.flatnonzero(~bad & (sizes > 0))
            whole = np.clip(np.floor(np.where(np.isfinite(values), values, 0) * scale), -BOUND, BOUND).astype("<i4")
            ends = np.cumsum(sizes)
            packed = [whole[e - n : e].tobytes() for e, n in zip(ends[kept].tolist(), sizes[kept].tolist(), strict=True)]
            rest = batch.take(pa.array(kept, pa.int64()))
            columns = [*rest.columns[:-1], pa.array(sizes[kept], pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names[:-1], "width", "integers"])

    return run


def integer_vectors(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``vectors``, with ``width`` and ``integers`` (packed 32-bit) of the vectors that are whole and finite."""
    keep = [c for c in (vectors.columns if keep is None else keep) if c.lower() not in {"width", "integers", vector.lower()}]
    own = fresh_name(vectors, "own_vector")
    chosen = F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")).alias(own)
    rows = vectors.select(*[F.col(f"`{c}`") for c in keep], chosen)
    schema = T.StructType(rows.schema.fields[:-1]).add("width", "integer").add("integers", "binary")
    return rows.mapInArrow(_integers(scale), schema)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows with their integers as a matrix."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            data = b"".join(batch["integers"].to_pylist())
            yield batch, np.frombuffer(data, "<i4").reshape(-1, width).astype(np.int64)


def _sums(books: Codebooks):
    """Per task, the sum of each entry's parts by position, and their number at position -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slicers = [Slicer(book) for book in books.books]
        cut = borders(books.width, len(books.books))
        totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books.books]
        for _, rows in _blocks(batches, books.width):
            for part, slicer in enumerate(slicers):
                own = rows[:, cut[part] : cut[part + 1]]
                entry, _ = slicer.nearest(own)
                order = np.argsort(entry, kind="stable")
                used, first = np.unique(entry[order], return_index=True)
                counted = np.concatenate([np.ones((len(own), 1), np.int64), own], axis=1)
                totals[part][used] += np.add.reduceat(counted[order], first, axis=0)
        for part, total in enumerate(totals):
            entry, position = np.nonzero(np.repeat(total[:, :1] > 0, total.shape[1], axis=1))
            columns = [np.full(len(entry), part), entry, position - 1, total[entry, position]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "position", "total"])

    return run


def _trained(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry that has parts becomes their floored mean."""
    tasks = rows.select("integers").mapInArrow(_sums(books), "part long, entry long, position long, total long")
    sums = tasks.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total"))
    found = {(r.part, r.entry, r.position): int(r.total) for r in sums.collect()}
    out = [book.copy() for book in books.books]
    for (part, entry, position), total in found.items():
        if position >= 0:
            out[part][entry, position] = total // found[part, entry, -1]
    return Codebooks(books.width, out)


def train_codebooks(
    rows: DataFrame, vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks:
    """Codebooks of ``rows`` (as ``integer_vectors`` gives them), started from the smallest ids."""
    named = rows.where(F.col(vec_id).isNotNull())
    least = named.agg(F.min(F.struct(F.col(vec_id).alias("id"), "width")).alias("v")).first().v
    width = least["width"] if least else 0
    rows = rows.where(F.col("width") == width)
    ids = rows.select(F.col(vec_id).alias("id")).where("id IS NOT NULL").distinct().orderBy("id").limit(entries)
    least = rows.join(F.broadcast(ids), F.col(vec_id) == ids["id"]).groupBy("id").agg(
        F.min(F.struct(F.hex("integers"), "integers")).alias("v")
    )
    first = [np.frombuffer(r.v["integers"], "<i4") for r in least.orderBy("id").collect()]
    cut = borders(width, parts)
    whole = np.array(first, np.int64).reshape(len(first), width)
    books = Codebooks(width, [whole[:, a:b].copy() for a, b in zip(cut[:-1], cut[1:], strict=True)])
    if first:
        for _ in range(rounds):
            books = _trained(rows, books)
    return books


def _encode(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slicers = [Slicer(book) for book in books.books]
        cut = borders(books.width, len(books.books))
        for batch, rows in _blocks(batches, books.width):
            code = np.empty((len(rows), len(slicers)), np.uint16)
            error = np.zeros(len(rows), np.int64)
            for part, slicer in enumerate(slicers):
                entry, distance = slicer.nearest(rows[:, cut[part] : cut[part + 1]])
                code[:, part] = entry
                error += distance
            # One byte an index; two where a codebook has more entries than that.
            code = code.astype(np.uint8 if all(len(b) <= 256 for b in books.books) else ">u2")
            rest = batch.drop_columns(["width", "integers"])
            columns = [*rest.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, "code", "error"])

    return run


def encode_vectors(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` (as ``integer_vectors`` gives them) with ``code``, a byte for each part, and ``error``, the squared distance."""
    rest = rows.select(*[c for c in rows.columns if c.lower() not in {"code", "error"}])
    schema = rest.drop("width", "integers").schema.add("code", "binary").add("error", "long")
    if not books.width:
        return rest.drop("width", "integers").withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")})
    return rest.where(F.col("width") == books.width).mapInArrow(_encode(books), schema)


def decoded(code: bytes, books: Codebooks) -> np.ndarray:
    """The integer vector that a code stands for."""
    wide = any(len(b) > 256 for b in books.books)
    return np.concatenate([book[k] for book, k in zip(books.books, np.frombuffer(code, ">u2" if wide else np.uint8), strict=True)])


def with_group_total(rows: DataFrame, group: str, value: str, total: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal values of ``group``, nulls together.

    Groups of more than a ``HEAVY``-th of all rows, of which there are fewer than ``HEAVY``, are looked up by
    broadcast; the others by a shuffle in which no key is large.
    """
    key, other, own, rest = (fresh_name(rows, n) for n in ("group_key", "group_other", "heavy_total", "light_total"))
    named: Column = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    sums = materialized(
        rows.groupBy(named.alias(other)).agg(F.sum(value).alias(total), F.count(F.lit(1)).alias("group_rows")), "group-totals"
    )
    count = sums.agg(F.sum("group_rows")).first()[0] or 0
    is_heavy = F.col("group_rows") > count // HEAVY
    heavy = sums.where(is_heavy).select(F.col(other), F.col(total).alias(own))
    keyed = rows.withColumn(key, named).join(F.broadcast(heavy), F.col(key) == F.col(other), "left").drop(other)
    light = sums.where(~is_heavy).select(F.col(other), F.col(total).alias(rest))
    if light.isEmpty():
        return keyed.withColumn(total, F.col(own)).drop(key, own)
    # Rows that have their total already take no part in the shuffle's large keys.
    plain = [f.name for f in rows.schema if isinstance(f.dataType, (T.NumericType, T.StringType, T.BinaryType))]
    alone = F.when(F.col(own).isNull(), F.col(key)).otherwise(F.concat(F.lit("#"), F.xxhash64(*plain).cast("string")))
    keyed = keyed.withColumn(key, alone).join(lookup_side(light), F.col(key) == F.col(other), "left").drop(other)
    return keyed.withColumn(total, F.coalesce(own, rest)).drop(key, own, rest)
