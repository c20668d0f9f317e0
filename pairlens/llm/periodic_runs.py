"""Runs of repeated words, by longest common extensions over a difference cover.

A run is a maximal stretch of words with smallest period q, at least ``min_length`` and 2 q words long.

- Every run of period p holds a grid point i (a multiple of p) whose word is that of i + p. Those points, of all
  p up to half the words (a harmonic sum), are the candidates; two extensions from each, forwards and
  backwards, give the stretch it lies in.
- Extension of (i, j): among positions whose residue modulo ``MODULUS`` is in ``COVER``, any two residues meet after
  fewer than ``MODULUS`` steps. So a few words are compared until both are sampled; from there on the
  answer is a range minimum over the common prefixes of the sampled suffixes in sorted order, from a sparse table.
  Only sampled suffixes are sorted: first by their next ``MODULUS`` words, then by doubling.
- Stretches found with several periods keep the smallest, of which the others are multiples.

Texts are taken whole, many short ones or one long one at a time; memory grows with the words of the longest text.
Suffixes are sorted only for texts where a candidate is still open after those few words.

Cases: null or empty text has no words and no runs; every row is judged by itself, so repeated rows, null or
equal ids need no rule; runs may overlap, and two runs may have the same start and differ in period; columns of
the input that are named like an added one, whatever their case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import empty_safe, fresh_name, slices, texts_of

MODULUS = 13
COVER = (0, 1, 3, 9)
PAIRS = 1 << 20

_SAMPLED = np.isin(np.arange(MODULUS), COVER)
#: Steps after which positions of two residues are both sampled.
_STEPS = np.array(
    [[next(d for d in range(MODULUS) if _SAMPLED[(a + d) % MODULUS] and _SAMPLED[(b + d) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)],
    np.int8,
)


class Extensions:
    """Longest common extensions in a sequence that ends in a value found nowhere else."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.values = np.concatenate([values, np.arange(MODULUS) + (int(values.max()) + 1)]).astype(np.int64)
        self.table: list[np.ndarray] | None = None

    def direct(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words before both positions are sampled, and whether all of those were equal."""
        steps = _STEPS[i % MODULUS, j % MODULUS]
        length = np.zeros(len(i), np.int64)
        open_ = np.flatnonzero(steps > 0)
        reached = steps == 0
        for k in range(MODULUS):
            open_ = open_[self.values[i[open_] + k] == self.values[j[open_] + k]]
            length[open_] = k + 1
            done = steps[open_] == k + 1
            reached[open_[done]] = True
            open_ = open_[~done]
            if not len(open_):
                break
        return length, reached

    def lengths(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of the suffixes at ``i`` and ``j``, which differ."""
        length, reached = self.direct(i, j)
        more = np.flatnonzero(reached)
        if len(more):
            length[more] += self._sampled(i[more] + length[more], j[more] + length[more])
        return length

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.table is None:
            self._sort()
        a, b = self.rank[self._index(i)], self.rank[self._index(j)]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out

    def _index(self, i: np.ndarray) -> np.ndarray:
        return self.first[i % MODULUS] + i // MODULUS

    def _sort(self) -> None:
        """Ranks of the sampled suffixes, common prefixes of neighbours in that order, and their sparse table."""
        by_residue = [np.arange(r, self.size, MODULUS) for r in COVER]
        self.first = np.full(MODULUS, -1, np.int64)
        self.first[list(COVER)] = np.cumsum([0, *(len(x) for x in by_residue[:-1])])
        at = np.concatenate(by_residue)
        last = np.repeat(self.first[list(COVER)] + [len(x) for x in by_residue], [len(x) for x in by_residue])
        m = len(at)
        bits = int(self.values.max()).bit_length()
        keys, per = [], max(1, 63 // bits)
        for k in range(0, MODULUS, per):
            key = np.zeros(m, np.int64)
            for d in range(k, min(k + per, MODULUS)):
                key = (key << bits) | self.values[at + d]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        new[0] = True
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        rank = np.empty(m, np.int64)
        rank[order] = start
        levels, step = [rank.copy()], 1
        while True:
            single = new & np.append(new[1:], True)
            tied = np.flatnonzero(~single)
            if not len(tied):
                break
            which = order[tied]
            follow = np.where(which + step < last[which], rank[np.minimum(which + step, m - 1)] + 1, 0)
            pair = np.argsort(rank[which] * (m + 1) + follow, kind="stable")
            order[tied] = which[pair]
            key = (rank[which] * (m + 1) + follow)[pair]
            new[tied[1:]] = key[1:] != key[:-1]
            new[tied[0]] = True
            start = np.maximum.accumulate(np.where(new, np.arange(m), 0))
            rank[order[tied]] = start[tied]
            levels.append(rank.copy())
            step *= 2
        self.rank = rank
        a, b = order[:-1].copy(), order[1:].copy()
        blocks = np.zeros(m - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < m) & (b < m)
            same = np.zeros(m - 1, bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            same &= (a + (1 << k) <= last[order[:-1]]) & (b + (1 << k) <= last[order[1:]])
            a, b = a + (same << k), b + (same << k)
            blocks += same.astype(np.int64) << k
        common = blocks * MODULUS
        x, y = at[order[:-1]] + common, at[order[1:]] + common
        open_ = np.flatnonzero((x < self.size) & (y < self.size))
        for k in range(MODULUS):
            open_ = open_[self.values[np.minimum(x[open_] + k, self.size)] == self.values[np.minimum(y[open_] + k, self.size)]]
            common[open_] = blocks[open_] * MODULUS + k + 1
        self.table = [common]
        while 1 << len(self.table) <= m - 1:
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))


def _grid(sizes: np.ndarray, starts: np.ndarray, min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of the grid points of every text and period, in blocks of about ``PAIRS``."""
    long_enough = sizes >= min_length
    sizes, starts = sizes[long_enough], starts[long_enough]
    half = sizes // 2
    text = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half) + 1
    points = (sizes[text] - period - 1) // period + 1
    total = np.cumsum(points)
    begin = 0
    while begin < len(points):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        n = points[begin:end]
        p = np.repeat(period[begin:end], n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(starts[text[begin:end]], n) + k * p, p
        begin = end


def _stretches(values: np.ndarray, sizes: np.ndarray, starts: np.ndarray, min_length: int, settle: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, end, period) of the runs in columns, and the positions in texts that need sorted suffixes.

    Without ``settle`` candidates that a few words do not decide are given back as such positions.
    """
    n = len(values)
    ahead, back = Extensions(values), Extensions(values[::-1])
    found, unsettled = [], []
    for i, p in _grid(sizes, starts, min_length):
        hit = np.flatnonzero(values[i] == values[i + p])
        i, p = i[hit], p[hit]
        if settle:
            forward, backward = ahead.lengths(i, i + p), back.lengths(n - i, n - i - p)
        else:
            forward, more = ahead.direct(i, i + p)
            backward, further = back.direct(n - i, n - i - p)
            open_ = more | further
            unsettled.append(i[open_])
            forward, backward, i, p = (x[~open_] for x in (forward, backward, i, p))
        good = forward + backward + p >= np.maximum(min_length, 2 * p)
        rows = np.stack([i - backward, i + p + forward, p])[:, good]
        if rows.shape[1]:
            found.append(_smallest(rows))
    runs = _smallest(np.concatenate(found, axis=1)) if found else np.zeros((3, 0), np.int64)
    return runs, np.concatenate(unsettled) if unsettled else np.zeros(0, np.int64)


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period."""
    start, end, period = rows
    order = np.lexsort((period, end, start))
    rows = rows[:, order]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    return rows[:, new]


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts between values of their own, the texts' sizes, and where each starts."""
    k = len(texts)
    parts = [np.zeros(1, np.int64)]
    for number, ids in enumerate(texts):
        parts += [ids + (k + 1), np.array([number + 1])]
    sizes = np.array([len(x) for x in texts], np.int64)
    return np.concatenate(parts), sizes, np.cumsum(sizes + 1) - sizes


def word_runs(texts: list[np.ndarray], min_length: int = 12) -> list[np.ndarray]:
    """(start, length, period) rows of the runs of each text, a text being an array of word numbers."""
    out = [np.zeros((0, 3), np.int64) for _ in texts]

    def collect(runs: np.ndarray, starts: np.ndarray, which: np.ndarray) -> None:
        owner = np.searchsorted(starts, runs[0], side="right") - 1
        for t in np.unique(owner):
            start, end, period = runs[:, owner == t] - np.array([[starts[t]], [starts[t]], [0]])
            rows = np.stack([start, end - start, period], axis=1)
            out[which[t]] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]

    values, sizes, starts = _joined(texts)
    runs, unsettled = _stretches(values, sizes, starts, min_length, settle=False)
    again = np.unique(np.searchsorted(starts, unsettled, side="right") - 1)
    owner = np.searchsorted(starts, runs[0], side="right") - 1
    collect(runs[:, ~np.isin(owner, again)], starts, np.arange(len(texts)))
    if len(again):
        values, sizes, starts = _joined([texts[t] for t in again])
        collect(_stretches(values, sizes, starts, min_length, settle=True)[0], starts, again)
    return out


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0)]


def _collapse(text: str, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch[text])
            for a, b in slices(texts):
                known: dict[bytes, int] = {}
                words = [t.split() for t in texts[a:b]]
                ids = [np.array([known.setdefault(w, len(known)) for w in own], np.int64) for own in words]
                runs = word_runs(ids, min_length)
                flat = np.concatenate(runs)
                offsets = np.cumsum([0, *(len(r) for r in runs)])
                fields = [pa.array(flat[:, k]) for k in range(3)]
                items = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
                collapsed = [b" ".join(_kept(own, r)) for own, r in zip(words, runs, strict=True)]
                rest = batch.slice(a, b - a).drop_columns([text])
                yield pa.RecordBatch.from_arrays(
                    [
                        *rest.columns,
                        pa.array([len(own) for own in words], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=[*rest.schema.names, "n_words", "runs", "collapsed"],
                )

    return run


def collapse_runs(docs: DataFrame, text: str = "text", min_length: int = 12) -> DataFrame:
    """``docs`` with ``n_words``, the ``runs`` (start, length, period) by start and period, and ``collapsed``: the words
    that no run holds after its first period, joined by a space."""
    added = {"n_words", "runs", "collapsed"}
    body = fresh_name(docs, "run_text")
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], empty_safe(F.col(text)).alias(body))
    run = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    schema = rows.drop(body).schema.add("n_words", "long").add("runs", T.ArrayType(run)).add("collapsed", "string")
    return rows.mapInArrow(_collapse(body, min_length), schema)


def repeat_tails(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` of which the texts with crc32(doc_id) divisible by ten go on in a period from some word on; null ids change nothing."""
    h, w, n, a, p = (fresh_name(docs, name) for name in ("tail_crc", "tail_words", "tail_n", "tail_start", "tail_period"))
    words = F.filter(F.split(empty_safe(F.col(text)), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    taken = docs.withColumn(h, F.crc32(F.col(doc_id).cast("string").cast("binary")))
    taken = taken.withColumn(w, F.when(F.col(h) % 10 == 0, words)).withColumn(n, F.size(w).cast("long"))
    g = F.floor(F.col(h) / 10)
    taken = taken.withColumn(a, F.when(F.col(n) > 0, g % F.col(n)))
    taken = taken.withColumn(p, 1 + F.floor((F.col(n) - F.col(a)) / (3 + g % 8)))
    word = f"{w}[CAST(IF(i < {a}, i, {a} + (i - {a}) % {p}) AS INT)]"
    tail = F.expr(f"array_join(transform(sequence(0L, {n} - 1), i -> {word}), ' ')")
    return taken.withColumn(text, F.when(F.col(a).isNotNull(), tail).otherwise(F.col(text))).select(*docs.columns)
