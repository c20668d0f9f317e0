"""Removal of byte strings that an earlier document holds, by suffix order.

Every ``LENGTH``-byte string (window) of a document is removed where the same string
starts in a document of smaller id. Equal windows choose the same anchor, the
leftmost of their ``GRAM``-byte strings of least hash; so windows are compared only
among those that share an anchor. Successive windows with one anchor are a run.

1. Texts are put into chunks of about ``chunk_bytes``, written once and bucketed, with the layout of their runs: two bytes a run, so
   that later steps hash a text's bytes but need not look for anchors again.
2. Anchors found in several documents are told apart from the rest, which ends
   the work for text that occurs once.
3. Runs that an earlier document holds as a whole are removed at once.
4. What is left of the shared anchors, one copy of each run, is sorted in suffix order, but for
   windows whose hash a shard holds with one document only.
   In that order, suffixes that share ``LENGTH`` bytes are neighbours; one has an
   earlier match if a smaller position precedes or follows it there.

Each step sends packed sorted arrays, one for each chunk and shard, to the shards of a hash and gets
one bit back per entry. A chunk sends an entry once, however often it holds it, and an
anchor of more than ``HOT_CHUNKS`` chunks sends single windows, each to its own shard;
so no shard gathers all occurrences of a frequent passage.

Cases: null text is empty; texts shorter than ``LENGTH`` lose nothing; rows that share a
doc_id are one document and do not remove each other; a null doc_id counts as larger than all
others. What is kept is bytes, as a removed run may start inside a character.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import empty_safe, materialized, mix, partitions_for, powers, scratch_path, slices, texts_of

LENGTH = 50
GRAM = 24
HOT_CHUNKS = 512
CHUNK_BYTES = 4 << 20
LAYOUT_BYTES = 1 << 16
SHARD_BYTES = 16 << 20
SHARD_BITS = 12
BLOCK_BYTES = 2 << 20
NO_ID = (1 << 63) - 1


@dataclass
class Runs:
    """Runs of windows with one anchor: text number, first and last window start, hashes."""

    text: np.ndarray
    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray
    run: np.ndarray


@dataclass
class Chunk:
    """Texts of one chunk end to end, with their borders, ids and the layout of their runs."""

    data: np.ndarray
    ends: np.ndarray  # where each text starts, and one past the end
    ids: np.ndarray
    lengths: np.ndarray  # windows per run; the runs of a text cover all its windows, in order
    marks: np.ndarray  # anchor's place in the run's first window


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def layout_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of each text, in order: how many windows they have, and where the first window holds the anchor.

    Both fit a byte, as all windows of a run hold its anchor; the rest of a run follows by ``runs_of``.
    """
    parts = []
    for a, b in slices(texts, LAYOUT_BYTES):
        buffer = np.frombuffer(b"\n".join([*texts[a:b], b""]), np.uint8)
        n = len(buffer)
        if n < LENGTH:
            continue
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
        up, down = powers(n + 1)
        sums = _prefix_sums(buffer, up)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        keyed = (grams & np.uint64(0xFFFFFFFF << 32)) | np.arange(len(grams), dtype=np.uint64)
        least = _sliding_min(keyed, LENGTH - GRAM + 1)
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        ends = offsets[1:] - 1
        borders = np.concatenate([offsets[:-1], np.maximum(ends - LENGTH + 1, offsets[:-1])])
        new[borders[borders < len(least)]] = True
        first = np.flatnonzero(new)
        lengths = np.diff(np.append(first, len(least)))
        inside = first + LENGTH <= ends[np.searchsorted(offsets, first, side="right") - 1]  # else windows that reach over a text's end
        first, lengths = first[inside], lengths[inside]
        at = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        parts.append((lengths.astype(np.uint8), (at - first).astype(np.uint8)))
    if not parts:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    lengths, marks = (np.concatenate(c) for c in zip(*parts, strict=True))
    return lengths, marks


def _prefix_sums(buffer: np.ndarray, up: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=sums[1:])
    return sums


def runs_of(chunk: Chunk) -> Runs:
    """The runs of each text, in order, with the hashes of their anchors and of their bytes."""
    lengths = chunk.lengths.astype(np.int64)
    borders = np.concatenate([[0], np.cumsum(np.maximum(np.diff(chunk.ends) - LENGTH + 1, 0))])  # windows before each text
    begin = np.cumsum(lengths) - lengths
    text = np.searchsorted(borders, begin, side="right") - 1
    low = begin - borders[text]
    first = np.searchsorted(begin, borders)  # runs before each text
    anchors, whole = np.empty(len(text), np.uint64), np.empty(len(text), np.uint64)
    for a, b in spans(np.diff(chunk.ends), LAYOUT_BYTES):
        r = slice(first[a], first[b])
        if r.start == r.stop:
            continue
        buffer = chunk.data[chunk.ends[a] : chunk.ends[b]]
        up, down = powers(len(buffer) + 1)
        sums = _prefix_sums(buffer, up)
        start = chunk.ends[text[r]] - chunk.ends[a] + low[r]
        at = start + chunk.marks[r]
        anchors[r] = (sums[at + GRAM] - sums[at]) * down[at]
        whole[r] = (sums[start + lengths[r] + (LENGTH - 1)] - sums[start]) * down[start]
    shape = (chunk.marks.astype(np.int64) << 32 | (lengths - 1)).astype(np.uint64)
    # Least hashes are small numbers; mixed once more, their high bits spread evenly over the shards.
    anchors = mix(mix(anchors) ^ np.uint64(0xA0761D6478BD642F))
    return Runs(text, low, low + lengths - 1, anchors, mix(whole ^ mix(shape)))


def spans(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes add up to about ``limit``, one entry at least."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
        yield start, end
        start = end


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and for each entry its place among them."""
    order = np.argsort(values)
    ranked = values[order]
    new = _changes(ranked)
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], inverse


def _changes(ranked: np.ndarray) -> np.ndarray:
    """Marks the entries that differ from the one before."""
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return new


def _chunks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            texts, ids = texts_of(batch["text"]), batch["id"]
            for a, b in slices(texts, limit):
                packed = pa.compress(b"".join(texts[a:b]), codec="zstd", asbytes=True)
                lengths, marks = layout_of(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()),
                        pa.array([ids.slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                        pa.array([[len(t) for t in texts[a:b]]], pa.list_(pa.int64())),
                        pa.array([packed], pa.binary()),
                        pa.array([lengths.tobytes()], pa.binary()),
                        pa.array([marks.tobytes()], pa.binary()),
                    ],
                    names=["chunk", "ids", "sizes", "data", "lengths", "marks"],
                )
                number += 1

    return run


def _unpacked(row: dict) -> Chunk:
    ends = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))])
    data = np.frombuffer(pa.decompress(row["data"], decompressed_size=int(ends[-1]), codec="zstd", asbytes=True), np.uint8)
    ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
    return Chunk(data, ends, ids, np.frombuffer(row["lengths"], np.uint8), np.frombuffer(row["marks"], np.uint8))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _sent(chunk: int, shard: np.ndarray, **columns) -> pa.RecordBatch:
    """One row per shard; ``shard`` ascends, and each column is an array cut at the same borders, or a list with a string a shard."""
    first = np.flatnonzero(_changes(shard))
    shards, borders = shard[first], [*first.tolist(), len(shard)]
    cut = lambda c, a, b: np.ascontiguousarray(c[a:b]).tobytes()
    arrays = [pa.array(np.full(len(shards), chunk, np.int64)), pa.array(shards)]
    for c in columns.values():
        cuts = c if isinstance(c, list) else [cut(c, a, b) for a, b in zip(borders[:-1], borders[1:], strict=True)]
        arrays.append(pa.array(cuts, pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["chunk", "shard", *columns])


def _bits(reply: list[dict] | None, name: str, shard: np.ndarray) -> np.ndarray:
    """The flags of a chunk's entries from the shards' replies; ``shard`` ascends."""
    out = np.zeros(len(shard), bool)
    if reply:
        for r in reply:
            a, b = np.searchsorted(shard, [r["shard"], r["shard"] + 1])
            out[a:b] = np.unpackbits(np.frombuffer(r[name], np.uint8), count=b - a).astype(bool)
    return out


def _reply(chunk: np.ndarray, shard: int, borders: np.ndarray, **flags: np.ndarray) -> pa.Table:
    columns = {"chunk": pa.array(chunk, pa.int64()), "shard": pa.array(np.full(len(chunk), shard), pa.int64())}
    for name, f in flags.items():
        columns[name] = pa.array([np.packbits(f[a:b]).tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)], pa.binary())
    return pa.table(columns)


# Step 2: anchors. Five low bytes are sent; the shard holds the high bits. A false match costs work, not truth.


def _send_anchors(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            anchors = np.sort(runs_of(_unpacked(row)).anchor)
            anchors = anchors[_changes(anchors)]
            if len(anchors):
                low = anchors.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                yield _sent(row["chunk"], _shard(anchors, bits), keys=low)

    return run


def _judge_anchors(hot_chunks: int):
    def run(table: pa.Table) -> pa.Table:
        blobs = table["keys"].to_pylist()
        borders = np.cumsum([0, *(len(b) // 5 for b in blobs)])
        wide = np.zeros((borders[-1], 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
        _, inverse = grouped(wide.view("<u8")[:, 0])
        count = np.bincount(inverse)[inverse]
        shard = table["shard"][0].as_py()
        return _reply(table["chunk"].to_numpy(), shard, borders, shared=count > 1, hot=count > hot_chunks)

    return run


@dataclass
class Shared:
    """A chunk's runs with shared anchors: one entry per distinct run, with the runs it stands for."""

    runs: Runs
    which: np.ndarray  # runs with shared anchors
    entry: np.ndarray  # their entry
    keys: np.ndarray  # run hash per entry, ascending
    ids: np.ndarray  # smallest id per entry
    example: np.ndarray  # a run of that document
    hot: np.ndarray


def _shared(row: dict, chunk: Chunk, bits: int) -> Shared:
    runs = runs_of(chunk)
    anchors, inverse = grouped(runs.anchor)
    shard = _shard(anchors, bits)
    owner = chunk.ids[runs.text]
    low, high = np.full(len(anchors), NO_ID), np.full(len(anchors), -NO_ID)
    np.minimum.at(low, inverse, owner)
    np.maximum.at(high, inverse, owner)
    known = (_bits(row["anchors"], "shared", shard) | (low < high))[inverse]
    which = np.flatnonzero(known)
    keys, entry = grouped(runs.run[which])
    ids = np.full(len(keys), NO_ID)
    np.minimum.at(ids, entry, owner[which])
    of_least = np.flatnonzero(owner[which] == ids[entry])[::-1]
    example = np.empty(len(keys), np.int64)
    example[entry[of_least]] = which[of_least]  # the first of them is written last
    return Shared(runs, which, entry, keys, ids, example, _bits(row["anchors"], "hot", shard)[inverse][example])


# Step 3: whole runs, by their full hash.


def _send_runs(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = _shared(row, _unpacked(row), bits)
            if len(found.keys):
                yield _sent(row["chunk"], _shard(found.keys, bits), keys=found.keys.astype("<u8"), ids=found.ids.astype("<i8"))

    return run


def _judge_runs(table: pa.Table) -> pa.Table:
    blobs = table["keys"].to_pylist()
    borders = np.cumsum([0, *(len(b) // 8 for b in blobs)])
    _, inverse = grouped(np.frombuffer(b"".join(blobs), "<u8"))
    ids = np.frombuffer(b"".join(table["ids"].to_pylist()), "<i8")
    least = np.full(inverse.max() + 1, NO_ID)
    np.minimum.at(least, inverse, ids)
    return _reply(table["chunk"].to_numpy(), table["shard"][0].as_py(), borders, earlier=least[inverse] < ids)


# Step 4: pieces of text in suffix order.


@dataclass
class Pieces:
    """Byte strings to be sorted, by shard and place in it: whole runs, or single windows of hot anchors."""

    key: np.ndarray  # ascending; its high bits are the shard
    entry: np.ndarray
    at: np.ndarray  # of the piece's first window within the run
    windows: np.ndarray


def _pieces(found: Shared, chunk: Chunk, earlier: np.ndarray) -> Pieces:
    runs, open_ = found.runs, np.flatnonzero(~earlier)
    size = (runs.high - runs.low + 1)[found.example]
    hot = found.hot[open_]
    whole, single = open_[~hot], np.repeat(open_[hot], size[open_[hot]])
    at = np.arange(len(single)) - np.repeat(np.cumsum(size[open_[hot]]) - size[open_[hot]], size[open_[hot]])
    run = found.example[single]
    places = chunk.ends[runs.text[run]] + runs.low[run] + at
    key = np.concatenate([runs.anchor[found.example[whole]], _hashes_at(chunk.data, places)])
    order = np.argsort(key, kind="stable")
    return Pieces(
        key[order],
        np.concatenate([whole, single])[order],
        np.concatenate([np.zeros(len(whole), np.int64), at])[order],
        np.concatenate([size[whole], np.ones(len(single), np.int64)])[order],
    )


def _hashes_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of the windows that start at ``places``."""
    up, _ = powers(LENGTH)
    out = np.zeros(len(places), np.uint64)
    for k in range(LENGTH if len(places) else 0):
        out += (data[places + k].astype(np.uint64) + np.uint64(1)) * up[k]
    return mix(out)


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte strings at ``starts`` end to end."""
    parts = [np.zeros(0, np.uint8)]
    for a, b in spans(sizes, 1 << 20):
        ends = np.cumsum(sizes[a:b])
        parts.append(data[np.arange(ends[-1]) + np.repeat(starts[a:b] - ends + sizes[a:b], sizes[a:b])])
    return np.concatenate(parts)


def _send_pieces(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = _unpacked(row)
            found = _shared(row, chunk, bits)
            pieces = _pieces(found, chunk, _bits(row["runs"], "earlier", _shard(found.keys, bits)))
            if not len(pieces.key):
                continue
            example = found.example[pieces.entry]
            starts = chunk.ends[found.runs.text[example]] + found.runs.low[example] + pieces.at
            sizes = pieces.windows + LENGTH - 1
            data, ends = _strings(chunk.data, starts, sizes), np.concatenate([[0], np.cumsum(sizes)])
            shard = _shard(pieces.key, bits)
            borders = ends[np.append(np.flatnonzero(_changes(shard)), len(shard))]
            yield _sent(
                row["chunk"], shard,
                data=[data[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)],
                windows=pieces.windows.astype("<u4"), ids=found.ids[pieces.entry].astype("<i8"),
                places=(pieces.key << np.uint64(bits) >> np.uint64(48)).astype("<u2"),
            )

    return run


def earlier_matches(windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the same string occurs with a smaller id, for rows of big-endian words.

    The rows are put in suffix order. Neighbours with a common prefix of full length form blocks; the smallest
    id before and after a row within its block gives its previous and next smaller position.
    """
    order = np.lexsort(windows.T[::-1])
    ranked = windows[order]
    block = np.concatenate([[0], np.cumsum((ranked[1:] != ranked[:-1]).any(axis=1))])
    values, rank = grouped(ids[order])
    r, size = rank.astype(np.int64), len(values)
    before = np.minimum.accumulate(r - block * size) + block * size
    back = (block[-1] - block)[::-1]
    after = (np.minimum.accumulate(r[::-1] - back * size) + back * size)[::-1]
    out = np.empty(len(ids), bool)
    out[order] = (before < r) | (after < r)
    return out


def window_matches(data: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a window occurs with a smaller id, for all windows of strings that lie end to end.

    Equal windows have equal hashes, so a window whose hash occurs with one id only has no match; the others are put in suffix order.
    """
    up, down = powers(len(data) + 1)
    sums = _prefix_sums(data, up)
    sizes = counts + LENGTH - 1
    at = np.arange(counts.sum()) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(counts) + counts, counts)
    owner = np.repeat(ids, counts)
    hashes = (sums[at + LENGTH] - sums[at]) * down[at]
    order = np.argsort(hashes)
    ranked, sorted_ids = hashes[order], owner[order]
    first = np.flatnonzero(_changes(ranked))
    least, most = np.minimum.reduceat(sorted_ids, first), np.maximum.reduceat(sorted_ids, first)
    several = np.empty(len(at), bool)
    several[order] = np.repeat(least != most, np.diff(np.append(first, len(at))))
    out, left = np.zeros(len(at), bool), np.flatnonzero(several)
    if len(left):
        wide = np.concatenate([data, np.zeros(8, np.uint8)])
        raw = np.lib.stride_tricks.sliding_window_view(wide, 56)[at[left]]
        raw[:, LENGTH:] = 0
        out[left] = earlier_matches(raw.view(">u8").astype(np.uint64), owner[left])
    return out


def _judge_pieces(table: pa.Table) -> pa.Table:
    """Pieces are taken by their place in the shard, so that equal windows meet while a block of the shard is held unfolded."""
    joined = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    counts = joined("windows", "<u4").astype(np.int64)
    data, ids, places = joined("data", np.uint8), joined("ids", "<i8"), joined("places", "<u2")
    starts = np.cumsum(counts + LENGTH - 1) - counts - LENGTH + 1
    first = np.cumsum(counts) - counts
    flags = np.zeros(counts.sum(), bool)
    order = np.argsort(places, kind="stable")
    new = np.flatnonzero(_changes(places[order]))
    groups = np.append(new, len(order))
    for a, b in spans(np.add.reduceat(counts[order] + LENGTH - 1, new), BLOCK_BYTES):
        rows = order[groups[a] : groups[b]]
        n = counts[rows]
        found = window_matches(_strings(data, starts[rows], n + LENGTH - 1), n, ids[rows])
        flags[np.arange(len(found)) + np.repeat(first[rows] - np.cumsum(n) + n, n)] = found
    sent = np.array([len(w) // 4 for w in table["windows"].to_pylist()])
    borders = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sent)])]
    return _reply(table["chunk"].to_numpy(), table["shard"][0].as_py(), borders, earlier=flags)


def _finish(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = _unpacked(row)
            found = _shared(row, chunk, bits)
            earlier = _bits(row["runs"], "earlier", _shard(found.keys, bits))
            pieces = _pieces(found, chunk, earlier)
            each = _bits(row["pieces"], "earlier", np.repeat(_shard(pieces.key, bits), pieces.windows))
            runs, ends = found.runs, chunk.ends
            size = (runs.high - runs.low + 1)[found.example]
            # Flags of each entry's windows, one entry after the other.
            first = np.concatenate([[0], np.cumsum(size)])
            flags = np.zeros(first[-1], bool)
            inner = np.arange(len(each)) - np.repeat(np.cumsum(pieces.windows) - pieces.windows, pieces.windows)
            flags[np.repeat(first[pieces.entry] + pieces.at, pieces.windows) + inner] = each
            change = np.zeros(ends[-1] + 1, np.int32)
            owner = chunk.ids[runs.text[found.which]]
            whole = earlier[found.entry] | (owner > found.ids[found.entry])
            at = ends[runs.text[found.which]] + runs.low[found.which]
            span = runs.high[found.which] - runs.low[found.which]
            np.add.at(change, at[whole], 1)
            np.add.at(change, at[whole] + span[whole] + LENGTH, -1)
            part = np.flatnonzero(~whole)
            n = span[part] + 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = flags[np.repeat(first[found.entry[part]], n) + step]
            places = (np.repeat(at[part], n) + step)[hit]
            np.add.at(change, places, 1)
            np.add.at(change, places + LENGTH, -1)
            gone = np.cumsum(change, dtype=np.int32)[:-1] > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(gone, dtype=np.int32)])[ends])
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            borders = ends[:-1][np.diff(ends) > 0]
            begin[borders] = gone[borders]  # what ends a text is not continued in the next
            spans_of = np.searchsorted(ends, np.flatnonzero(begin), side="right") - 1
            offsets = np.concatenate([[0], np.cumsum(np.diff(ends) - removed)]).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), len(removed), [None, pa.py_buffer(offsets), pa.py_buffer(chunk.data[~gone])])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()),
                    pa.array(row["sizes"], pa.int64()),
                    pa.array(removed.astype(np.int64)),
                    pa.array(np.bincount(spans_of, minlength=len(removed)), pa.int64()),
                    kept,
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def shard_bits(total: int) -> int:
    """Shards of ``SHARD_BYTES`` of text at least once there are 256, of 1 MB before that, and ``2**SHARD_BITS`` of them at most.

    A chunk sends a row to every shard; with a bounded number of shards rows grow with the text, not with its square.
    """
    return max(5, min(SHARD_BITS, max(int(total // SHARD_BYTES).bit_length(), min(8, int(total >> 20).bit_length()))))


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, hot_chunks: int = HOT_CHUNKS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row; ``kept`` are the bytes that no earlier document holds."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), empty_safe(F.col(text)).alias("text"))
    buckets = partitions_for(docs)
    name = f"chunks_{uuid.uuid4().hex}"
    (
        plain.mapInArrow(_chunks(chunk_bytes), "chunk long, ids array<long>, sizes array<long>, data binary, lengths binary, marks binary")
        .repartition(buckets, "chunk").write.bucketBy(buckets, "chunk").sortBy("chunk")
        .option("path", scratch_path(spark, "chunks")).format("parquet").saveAsTable(name)
    )
    chunks = spark.table(name)
    total = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = shard_bits(total)

    def replies(source: DataFrame, send, sent: str, judge, names: list[str], label: str) -> DataFrame:
        """Send from every chunk, judge by shard, and gather each chunk's replies in one row."""
        schema = "chunk long, shard long, " + ", ".join(f"{n} binary" for n in names)
        flat = source.mapInArrow(send, f"chunk long, shard long, {sent}").groupBy("shard").applyInArrow(judge, schema)
        rows = materialized(flat, f"sd-{label}")
        return source.join(rows.groupBy("chunk").agg(F.collect_list(F.struct("shard", *names)).alias(label)), "chunk", "left")

    chunks = replies(chunks, _send_anchors(bits), "keys binary", _judge_anchors(hot_chunks), ["shared", "hot"], "anchors")
    chunks = replies(chunks, _send_runs(bits), "keys binary, ids binary", _judge_runs, ["earlier"], "runs")
    chunks = replies(chunks, _send_pieces(bits), "data binary, windows binary, ids binary, places binary", _judge_pieces, ["earlier"], "pieces")
    return chunks.mapInArrow(_finish(bits), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
