"""Removal of passages that an earlier document holds, located by automata over recurring phrases.

Every word of a document covered by ``WIDTH`` successive words that also start in a document of smaller id
goes. Equal windows choose the same anchor, the leftmost of their ``GRAM``-word strings of least hash; successive
windows of a document with one anchor are a piece of at most ``WIDTH - GRAM + 1`` windows.

1. Texts are packed into chunks, written once. Anchors that only one document holds end the work for their
   pieces, which settles text that occurs once.
2. Windows of the other pieces are hashed; those that several documents hold are recurring. The
   document of smallest id with such a window is its owner, and sends the window's words as a pattern.
3. Patterns are dealt to shards by anchor. In a shard they are compiled to an Aho-Corasick automaton over word
   numbers, and the pieces of all documents are streamed through the automaton of their anchor's shard.
   Every hit is exact and returns the owner's id; a hash only decides which words become patterns.
4. A document loses the windows whose owner has a smaller id.

Exchanges are sorted and read as streams: a task holds a batch of rows, one automaton and one chunk. A chunk sends an anchor, a
window or a piece once, however often it holds it. Pieces whose anchor lies in more than ``HOT_CHUNKS`` chunks are sent
window by window, each to the shard of its own hash, so that a frequent phrase with many continuations is
spread over all shards. The number of shards follows the number of patterns.

Cases: null or empty text has no words; texts shorter than ``WIDTH`` words lose nothing; rows that share a doc_id are one
document and do not remove each other; a null doc_id counts as larger than all others; an empty table gives no rows.
Columns of the input beside id and text are not carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import SPACES, empty_safe, materialized, mix, nonspace_table, partitions_for, scratch_path, slices, texts_of, windows_hash, words_of

WIDTH = 13
GRAM = 4
HOT_CHUNKS = 128
SHARD_PATTERNS = 1 << 15
CHUNK_BYTES = 2 << 20
NO_ID = (1 << 63) - 1
#: Bits of a window's second hash beside the chunk number and the mark of several documents.
TAG_BITS = 19

NONSPACE = nonspace_table()
ONE_SPACE = bytes(32 if c in SPACES else c for c in range(256))
UNKNOWN = "\x01\x01"
DIGITS = 128


def _chunks(limit: int):
    """Rows of about ``limit`` bytes of text, numbered by task and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            texts, ids = texts_of(batch["text"]), batch["id"].to_pylist()
            for a, b in slices(texts, limit):
                columns = [
                    pa.array([number], pa.int64()),
                    pa.array([ids[a:b]], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts[a:b]]], pa.list_(pa.int64())),
                    pa.array([pa.compress(b"".join(texts[a:b]), codec="zstd", asbytes=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "sizes", "data"])
                number += 1

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive values, by doubling."""
    held = 1
    while held < width:
        step = min(held, width - held)
        x = np.minimum(x[:-step], x[step:])
        held += step
    return x


class Chunk:
    """The words, windows and pieces of a chunk's texts."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        self.data = bytes(pa.decompress(row["data"], decompressed_size=int(sum(row["sizes"])), codec="zstd", asbytes=True))
        ends = np.cumsum([0, *row["sizes"]])
        self.texts = [self.data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.split = words = words_of(self.texts, NONSPACE, lower=False)
        n = max(0, len(words.hashes) - WIDTH + 1)
        grams = windows_hash(words.hashes, GRAM)
        at = np.arange(n)
        if n:
            keyed = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
            least = _sliding_min(keyed, WIDTH - GRAM + 1)
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(words.text[:n] == words.text[WIDTH - 1 : WIDTH - 1 + n])
        at = at[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) != 1) | (np.diff(at) != 0)
        first = np.flatnonzero(new)
        #: First window, number of windows, anchor and owner of each piece.
        self.start = starts[first]
        self.count = np.diff(np.append(first, len(starts)))
        self.anchor = mix(grams[at[first]] ^ np.uint64(0x8EBC6AF09C88C6E3)).view(np.int64) if n else np.zeros(0, np.int64)
        self.owner = self.ids[words.text[self.start]]

    @cached_property
    def windows(self) -> np.ndarray:
        return windows_hash(self.split.hashes, WIDTH)

    def narrow(self, anchors: list[int] | None) -> None:
        """Keep the pieces with one of these anchors."""
        kept = np.isin(self.anchor, np.array(anchors or [], np.int64))
        self.start, self.count, self.anchor, self.owner = (x[kept] for x in (self.start, self.count, self.anchor, self.owner))

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, piece) of all windows of the pieces."""
        piece = np.repeat(np.arange(len(self.start)), self.count)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        return self.start[piece] + step, piece

    @cached_property
    def spaced(self) -> tuple[bytes, np.ndarray]:
        """The texts' bytes with every white space a space, and the white space before each word."""
        words = self.split
        gaps = words.starts - np.concatenate([[0], np.cumsum(words.ends - words.starts)[:-1]])
        return words.buffer.tobytes().translate(ONE_SPACE), gaps

    def joined(self, left: np.ndarray) -> list[bytes]:
        """Each text's words that are ``left``, parted by a space."""
        words, (data, gaps) = self.split, self.spaced
        text = words.text
        begin, end = left.copy(), left.copy()  # of runs of words left in a text
        begin[1:] &= ~left[:-1] | (text[1:] != text[:-1])
        end[:-1] &= ~left[1:] | (text[1:] != text[:-1])
        begin, end = np.flatnonzero(begin), np.flatnonzero(end)
        single = gaps[end] - gaps[begin] == end - begin
        spans = zip(words.starts[begin].tolist(), words.ends[end].tolist(), single.tolist(), strict=True)
        runs = [data[a:b] if one else b" ".join(data[a:b].split()) for a, b, one in spans]
        cuts = np.searchsorted(text[begin], np.arange(len(self.texts) + 1)).tolist()
        return [b" ".join(runs[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def phrases(self, start: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The words of ``count`` windows from ``start`` on, parted by a space."""
        words, last = self.split, start + count + WIDTH - 2
        if (words.text[start] != words.text[last]).any():
            raise ValueError("a phrase lies in one text")
        data, gaps = self.spaced
        single = gaps[last] - gaps[start] == last - start
        spans = zip(words.starts[start].tolist(), words.ends[last].tolist(), single.tolist(), strict=True)
        return [data[a:b] if one else b" ".join(data[a:b].split()) for a, b, one in spans]


@dataclass
class Dealt:
    """The distinct pieces of a chunk, or windows of hot anchors, by shard, and which piece each stands for."""

    shard: np.ndarray
    start: np.ndarray
    count: np.ndarray
    entry: np.ndarray  # of each window of ``Chunk.positions``
    step: np.ndarray  # of that window within its entry


def _dealt(chunk: Chunk, hot: list[int] | None, shards: int) -> Dealt:
    """Entries in order of shard; equal ones once. Pieces are equal if their count, first and last window are."""
    at, piece = chunk.positions()
    is_hot = np.isin(chunk.anchor, np.array(hot or [], np.int64))
    single = is_hot[piece]
    begin = np.ones(len(at), bool)
    begin[1:] = piece[1:] != piece[:-1]
    begin |= single
    which = np.cumsum(begin) - 1
    start = at[begin]
    count = np.bincount(which, minlength=len(start)) if len(start) else np.zeros(0, np.int64)
    first, last = chunk.windows[start], chunk.windows[start + count - 1]
    key = np.where(is_hot[piece[begin]], first, chunk.anchor[piece[begin]].view(np.uint64))
    shard = (mix(key + np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((count, last, first, shard))
    fresh = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (shard, first, last, count):
        same &= x[order][1:] == x[order][:-1]
    fresh[1:] = ~same
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    one = order[fresh]
    step = np.arange(len(at)) - np.flatnonzero(begin)[which] if len(at) else np.zeros(0, np.int64)
    return Dealt(shard[one], start[one], count[one], number[which], step)


# 1. Anchors of several documents


def _marked(chunk: int, several: np.ndarray) -> np.ndarray:
    return (np.int64(chunk) << 1) | several


def _least(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, place of the least owner, least owner, whether there are several) of the distinct keys."""
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(keys)) - 1 if len(first) else first
    return keys[first], order[first], owner[first], owner[first] != owner[last]


def _send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        chunk = Chunk(row)
        anchors, _, least, several = _least(chunk.anchor, chunk.owner)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors), pa.array(_marked(chunk.number, several)), pa.array(least)], names=["key", "mark", "least"]
        )


def _shared_anchors(hot_chunks: int):
    """Reads rows sorted by key; gives (chunk, key, hot) of the keys that several documents hold.

    At most ``hot_chunks`` rows of a key wait for the next batch; beyond that it is hot, whatever follows.
    """

    def judged(key: np.ndarray, mark: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        if len(first):
            low, high = np.minimum.reduceat(least, first), np.maximum.reduceat(least, first)
            several = (low != high) | (np.bitwise_or.reduceat(mark, first) & 1 == 1)
            hot = np.diff(np.append(first, len(key))) > hot_chunks
            kept = (several | hot)[group]
            return batch_of(key[kept], mark[kept], hot[group][kept])
        return batch_of(key, mark, np.zeros(0, bool))

    def batch_of(key: np.ndarray, mark: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(mark >> 1), pa.array(key), pa.array(hot)], names=["chunk", "key", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = [np.zeros(0, np.int64)] * 3
        settled = None
        for batch in batches:
            rows = [batch[c].to_numpy() for c in ("key", "mark", "least")]
            if settled is not None:
                n = int(np.searchsorted(rows[0], settled, side="right"))
                yield batch_of(rows[0][:n], rows[1][:n], np.ones(n, bool))
                rows = [x[n:] for x in rows]
                if not len(rows[0]):
                    continue
                settled = None
            rows = [np.concatenate(x) for x in zip(waiting, rows, strict=True)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            if len(rows[0]) - cut > hot_chunks:
                settled, cut = rows[0][-1], len(rows[0])
            yield judged(*[x[:cut] for x in rows])
            waiting = [x[cut:] for x in rows]
        yield judged(*waiting)

    return run


# 2. Recurring windows and their owners


def _tag(windows: np.ndarray) -> np.ndarray:
    """A few bits more of a window's hash, above the chunk number."""
    return (mix(windows ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - TAG_BITS)).astype(np.int64) << (63 - TAG_BITS)


def _second(chunk: Chunk, at: np.ndarray) -> np.ndarray:
    """Hashes of windows that do not follow from those of ``Chunk.windows``."""
    words = mix(chunk.split.hashes ^ np.uint64(0xD6E8FEB86659FD93))
    return windows_hash(words, WIDTH)[at]


def _send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        chunk = Chunk(row)
        chunk.narrow(row["shared"])
        at, piece = chunk.positions()
        keys, place, least, several = _least(chunk.windows[at], chunk.owner[piece])
        mark = _marked(chunk.number, several) | _tag(_second(chunk, at[place]))
        columns = [pa.array(keys.view(np.int64)), pa.array(mark), pa.array(least)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "mark", "least"])


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key and mark; gives (chunk, key) of each recurring window at its owner."""
    low_bits = (np.int64(1) << (63 - TAG_BITS)) - 1

    def groups(key: np.ndarray, mark: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
        """One row per window: key, mark of the owner's chunk, its id; several documents are in the mark."""
        order = np.lexsort((mark & low_bits, least, mark >> (63 - TAG_BITS), key))
        key, mark, least = key[order], mark[order], least[order]
        tag = mark >> (63 - TAG_BITS)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
        first = np.flatnonzero(new)
        several = (np.bitwise_or.reduceat(mark, first) & 1) | (np.maximum.reduceat(least, first) != least[first])
        return key[first], mark[first] | several, least[first]

    def out(key: np.ndarray, mark: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        kept = mark & 1 == 1
        return pa.RecordBatch.from_arrays([pa.array((mark[kept] & low_bits) >> 1), pa.array(key[kept])], names=["chunk", "key"])

    waiting = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        rows = [np.concatenate([w, batch[c].to_numpy()]) for w, c in zip(waiting, ("key", "mark", "least"), strict=True)]
        if len(rows[0]):
            rows = groups(*rows)
            yield out(*[x[:-1] for x in rows])
            waiting = [x[-1:] for x in rows]
    if len(waiting[0]):
        yield out(*waiting)


# 3. Patterns and pieces, shard by shard


def _deal(shards: int):
    """(shard, kind, chunk, size, data, owners): the chunk's patterns (kind 0) and pieces (kind 1) for each shard."""

    def packed(chunk: Chunk, kind: int, shard: np.ndarray, phrases: list[bytes], owners: np.ndarray | None) -> pa.RecordBatch:
        found, first = np.unique(shard, return_index=True)
        cuts = [*first.tolist(), len(shard)]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        texts = [b" \n ".join(phrases[a:b]) for a, b in spans]
        columns = [
            pa.array(found, pa.int64()),
            pa.array(np.full(len(found), kind), pa.int32()),
            pa.array(np.full(len(found), chunk.number), pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary()),
            pa.array([owners[a:b].tobytes() if owners is not None else b"" for a, b in spans], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "kind", "chunk", "size", "data", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            chunk.narrow(row["shared"])
            at, piece = chunk.positions()
            dealt = _dealt(chunk, row["hot"], shards)
            phrases = chunk.phrases(dealt.start, dealt.count)
            if phrases:
                yield packed(chunk, 1, dealt.shard, phrases, None)
            if not row["owned"]:
                continue
            keys, place, least, _ = _least(chunk.windows[at], chunk.owner[piece])
            owned = np.isin(keys.view(np.int64), np.array(row["owned"], np.int64))
            # Successive owned windows of one entry and owner are sent as one phrase.
            place, least = place[owned], least[owned]
            order = np.argsort(place)
            place, least = place[order], least[order]
            entry, start = dealt.entry[place], at[place]
            new = np.ones(len(place), bool)
            new[1:] = (np.diff(start) != 1) | (np.diff(entry) != 0) | (np.diff(piece[place]) != 0) | (np.diff(least) != 0)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(place)))
            shard = dealt.shard[entry[first]]
            by_shard = np.argsort(shard, kind="stable")
            phrases = chunk.phrases(start[first][by_shard], count[by_shard])
            yield packed(chunk, 0, shard[by_shard], phrases, least[first][by_shard].astype("<i8"))

    return run


class Automaton:
    """Recurring windows over numbered words.

    A word is two letters, the low and the high digit of its number, from different ranges: an automaton's node
    looks its next letter up one by one, so no node should have as many as there are words.
    """

    def __init__(self):
        self.letters: dict[bytes, str] = {}
        self.owners: dict[str, int] = {}
        self.compiled = None

    def _letter(self, word: bytes) -> str:
        letter = self.letters.get(word)
        if letter is None:
            number = len(self.letters)
            letter = self.letters[word] = chr(2 + number % DIGITS) + chr(0x10000 + number // DIGITS)
        return letter

    def add(self, phrase: bytes, owner: int) -> None:
        text = "".join([self._letter(w) for w in phrase.split(b" ")])
        for k in range(0, len(text) - 2 * WIDTH + 1, 2):
            window = text[k : k + 2 * WIDTH]
            if self.owners.get(window, NO_ID) >= owner:
                self.owners[window] = owner

    def hits(self, phrases: bytes) -> tuple[list[int], list[int]]:
        """(word number, owner) of every window found; phrases are parted by a line feed that counts as a word."""
        if self.compiled is None:
            self.compiled = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            for window, owner in self.owners.items():
                self.compiled.add_word(window, owner)
            self.compiled.make_automaton()
        text = "".join(map(self.letters.get, phrases.split(b" "), repeat(UNKNOWN)))
        found = list(self.compiled.iter(text))
        return [end // 2 - WIDTH + 1 for end, _ in found], [owner for _, owner in found]


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by shard and kind; gives (chunk, shard, found), the places and owners of a chunk's hits."""
    shard, automaton = None, None
    for batch in batches:
        replies = []
        for row in _rows(iter([batch])):
            if row["shard"] != shard:
                shard, automaton = row["shard"], Automaton()
            data = bytes(pa.decompress(row["data"], decompressed_size=row["size"], codec="zstd", asbytes=True))
            if row["kind"] == 0:
                for phrase, owner in zip(data.split(b" \n "), np.frombuffer(row["owners"], "<i8").tolist(), strict=True):
                    automaton.add(phrase, owner)
            elif automaton.owners:
                places, owners = automaton.hits(data)
                if places:
                    found = np.array(places, "<i4").tobytes() + np.array(owners, "<i8").tobytes()
                    replies.append((row["chunk"], shard, len(places), pa.compress(found, codec="zstd", asbytes=True)))
        chunk, where, n, found = zip(*replies, strict=True) if replies else ((), (), (), ())
        columns = [pa.array(chunk, pa.int64()), pa.array(where, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "shard", "n", "found"])


# 4. What is left


def _owner_of_windows(dealt: Dealt, replies: list[dict] | None) -> np.ndarray:
    """The owner of each window of each entry, one entry after the other; ``NO_ID`` where there is none."""
    first = np.cumsum(dealt.count) - dealt.count
    owner = np.full(int(dealt.count.sum()), NO_ID, np.int64)
    for reply in replies or []:
        a, b = np.searchsorted(dealt.shard, [reply["shard"], reply["shard"] + 1])
        words = dealt.count[a:b] + WIDTH  # with the line feed
        begin = np.cumsum(words) - words
        n = reply["n"]
        found = bytes(pa.decompress(reply["found"], decompressed_size=12 * n, codec="zstd", asbytes=True))
        places, ids = np.frombuffer(found[: 4 * n], "<i4"), np.frombuffer(found[4 * n :], "<i8")
        entry = np.searchsorted(begin, places, side="right") - 1
        owner[first[a + entry] + places - begin[entry]] = ids
    return owner


def _finish(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            words = chunk.split
            change = np.zeros(len(words.starts) + 1, np.int64)
            if row["replies"]:
                chunk.narrow(row["shared"])
                at, piece = chunk.positions()
                dealt = _dealt(chunk, row["hot"], shards)
                owner = _owner_of_windows(dealt, row["replies"])
                first = np.cumsum(dealt.count) - dealt.count
                gone = at[owner[first[dealt.entry] + dealt.step] < chunk.owner[piece]]
                np.add.at(change, gone, 1)
                np.add.at(change, gone + WIDTH, -1)
            left = np.cumsum(change)[:-1] == 0
            n_words = np.diff(words.first)
            n_removed = n_words - np.diff(np.concatenate([[0], np.cumsum(left)])[words.first])
            kept = chunk.joined(left)
            columns = [pa.array(row["ids"], pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_phrases(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES, hot_chunks: int = HOT_CHUNKS,
    shard_patterns: int = SHARD_PATTERNS,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row; ``kept`` are the words that no earlier document's windows cover, joined by a space."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), empty_safe(F.col(text)).alias("text"))
    buckets = partitions_for(docs)
    name = f"phrase_chunks_{uuid.uuid4().hex}"
    (
        plain.mapInArrow(_chunks(chunk_bytes), "chunk long, ids array<long>, sizes array<long>, data binary")
        .repartition(buckets, "chunk").write.bucketBy(buckets, "chunk").sortBy("chunk")
        .option("path", scratch_path(spark, "phrase-chunks")).format("parquet").saveAsTable(name)
    )
    chunks = spark.table(name)
    # The files stay, as the result reads them; the catalog forgets them.
    spark.sql(f"DROP TABLE {name}")

    sent = "key long, mark long, least long"
    anchors = chunks.mapInArrow(_send_anchors, sent).repartition("key").sortWithinPartitions("key")
    shared = materialized(anchors.mapInArrow(_shared_anchors(hot_chunks), "chunk long, key long, hot boolean"), "phrase-anchors")
    lists = shared.groupBy("chunk").agg(F.collect_list("key").alias("shared"), F.collect_list(F.when(F.col("hot"), F.col("key"))).alias("hot"))
    chunks = chunks.join(lists, "chunk", "left")

    windows = chunks.where("shared IS NOT NULL").mapInArrow(_send_windows, sent)
    windows = windows.repartition("key").sortWithinPartitions("key", "mark")
    owned = materialized(windows.mapInArrow(_owners, "chunk long, key long"), "phrase-owned")
    shards = max(1, owned.count() // shard_patterns)
    chunks = chunks.join(owned.groupBy("chunk").agg(F.collect_list("key").alias("owned")), "chunk", "left")

    dealt = chunks.where("shared IS NOT NULL").mapInArrow(_deal(shards), "shard long, kind int, chunk long, size long, data binary, owners binary")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "kind")
    found = materialized(dealt.mapInArrow(_locate, "chunk long, shard long, n long, found binary"), "phrase-hits")
    replies = found.groupBy("chunk").agg(F.collect_list(F.struct("shard", "n", "found")).alias("replies"))
    return chunks.drop("owned").join(replies, "chunk", "left").mapInArrow(_finish(shards), "doc_id long, n_words long, n_removed long, kept string")
