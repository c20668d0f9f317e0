"""Helpers shared by the operators: column names, scratch tables, and words of byte buffers.

Words, shingles and their hashes are computed for a whole Arrow batch at a time:
texts are joined by a newline into one byte buffer, word borders come from a
256-entry table, and a word's 64-bit hash is a difference of prefix sums. Nothing
depends on how rows are batched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.session import materialized, scratch_path

__all__ = ["SPACES", "ASCII_LOWER", "Words", "empty_safe", "fresh_name", "materialized", "mix",
           "nonspace_table", "partitions_for", "scratch_path", "slices", "texts_of", "windows_hash",
           "with_columns", "words_of"]

SPACES = b" \t\n\x0b\x0c\r"
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LOWER_TABLE = np.frombuffer(ASCII_LOWER, dtype=np.uint8)
SLICE_BYTES = 1 << 19

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def empty_safe(column) -> F.Column:
    """The text as it is, or empty for null."""
    return F.coalesce(column.cast("string"), F.lit(""))


def partitions_for(df: DataFrame) -> int:
    """The session's shuffle partition count, for operators that deal rows by an own key."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``limit`` bytes, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with columns replaced in place or appended."""
    arrays = dict(zip(batch.schema.names, batch.columns, strict=True)) | columns
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def nonspace_table() -> np.ndarray:
    """Marks bytes of words that only ASCII white space parts."""
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash factor and of its inverse modulo 2**64, cached by the longest asked for."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, base in enumerate((_FACTOR, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of several texts: byte borders in the joined buffer, hashes, and the text each is in."""

    buffer: np.ndarray
    offsets: np.ndarray  # where each text starts, and one past the end
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words


def words_of(texts: Iterable[bytes], is_word: np.ndarray, lower: bool = True) -> Words:
    """Split and hash the words of ``texts``; A-Z count as a-z if ``lower``."""
    texts = list(texts)
    buffer = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    if lower:
        buffer = LOWER_TABLE[buffer]
    flags = np.zeros(len(buffer) + 2, np.int8)
    flags[1:-1] = is_word[buffer]
    edges = np.diff(flags)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = powers(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(buffer, offsets, starts, ends, hashes, text, first)


def windows_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` successive values, from each start on."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, 0x51ED270B7A14F2C3, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)
