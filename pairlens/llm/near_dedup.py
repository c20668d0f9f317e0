"""MinHash near-dedup by a chosen-path set similarity join.

Documents with equal shingle sets are one representative. Independent trees branch
the representatives ``DEPTH`` levels deep: a node picks one position of the MinHash sketch, and with
probability 1 / threshold - 1 a second one, and every member goes to the child named by
its own minimum there. Every level of every tree has two positions of its own, so trees
are independent. Nodes are never parted further; those of two or more members are compared in rounds:

- the first round has the nodes of the first ``FIRST`` trees, the second those of all others too,
- nodes whose members are all in one component by now are closed,
- small nodes are compared exhaustively and closed; small is a node of which at most
  ``BLOCK`` members lie outside its main component. Its members are dealt into blocks of
  about ``BLOCK``, and each block meets all those outsiders: a task holds one block,
- the members of other nodes are dealt into such blocks too and each block is compared in itself, which
  joins most of a group of near copies,
- after ``MAX_LEVELS`` such rounds, dealt anew each time, the members of all nodes that are still not small branch
  once more, on their rare shingles, and the nodes that this gives go through one such round. Only what is not small even then
  is compared in full, each block with all guests, part by part.

The last branching loses no link. In one order of all shingles, in which those that more than ``BLOCK`` of these members hold
come last, two linked sets of n <= m shingles share one of the first n - ceil(2 t n / (1 + t)) + 1 of the smaller and the first
m - ceil(t m) + 1 of the larger. So each member goes to the nodes of its first m - ceil(t m) + 1 shingles, and is a seed in those
of the fewer. Pairs without a seed need not meet: the guests of a node are its seeds where these are fewer than the
members outside its main component. Texts that are alike but for words of their own share no such node, however large their group.
Only the ``HOT`` most frequent of those shingles are held, by count; any order is exact, more would only make smaller nodes.
To find them, shingles are first counted by spot (their first bits), an array per task, and then one by one on those spots
that have more than ``BLOCK``: what is moved follows the frequent shingles, not all words of these members.

So no task holds a large node, no link is skipped because a node is large, and a block
returns only the links that join what it had apart. Of representatives the least ``WHOLE`` hashes are carried.
Where these are the full sets, comparison is exact. Of other pairs, those that are possible (five standard errors) name groups:
the members that chains of possible pairs hold together in a block. Groups are compared once more, exactly, on the full
sets of the members' texts, no group with more than about ``FULL`` shingles at a time. So what a block returns grows with its members, not with its pairs.

Only representatives that share a node are compared, so only their texts are read again, by a bitmap of ``BITS`` bits and a join,
and written once, bucketed by id.

A pair of similarity J is parted at a level with probability q = (2 - 1 / t) (1 - J) + (1 / t - 1) (1 - J) ** 2
at most, t being the threshold, and by all trees with at most (1 - (1 - q) ** DEPTH) ** TREES: below
1e-7 for a pair exactly at 0.85, below 1e-6 at 0.8. That holds in groups of any size, as every pair that
shares a node is compared, or is in one component already.

Cases: texts of fewer words than a shingle have their whole sequence as the only
shingle; texts without words have an empty set and link to nothing. Rows that share
a doc_id share its component (the smallest of theirs); null ids are left alone:
component null, kept. Ties do not arise, the smallest id names a component.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import empty_safe, materialized, mix, nonspace_table, partitions_for, scratch_path, slices, texts_of, windows_hash, words_of

TREES = 16
FIRST = 4
DEPTH = 3
BLOCK = 256
WHOLE = 256
MAX_LEVELS = 2
HOT = 1 << 19
FULL = 1 << 22
BITS = 1 << 25
PIECE = 1 << 12
SPOT_BITS = 24
WIDTH = TREES * DEPTH * 2

NONSPACE = nonspace_table()
_RANDOM = np.random.default_rng(20240501)
_FACTORS = _RANDOM.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, WIDTH, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(texts, NONSPACE)
    grams = windows_hash(words.hashes, size)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            own = grams[a : b - size + 1]
        elif b > a:
            own = windows_hash(words.hashes[a:b], int(b - a))
        else:
            own = grams[:0]
        out.append(np.unique(own))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of ``WIDTH`` hash functions over a set that is not empty."""
    out = np.empty(WIDTH, np.uint32)
    for k in range(WIDTH):
        out[k] = ((shingles * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32)).min()
    return out


def plant(sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of the sketch, node) of every path, all trees down to ``DEPTH``; nodes of the first ``FIRST`` trees are odd numbers."""
    owners = np.tile(np.arange(len(sketches)), TREES)
    trees = np.repeat(np.arange(TREES), len(sketches))
    nodes = mix(trees.astype(np.uint64) + np.uint64(1))
    for level in range(DEPTH):
        chance = (mix(nodes ^ np.uint64(0xB5297A4D)) >> np.uint64(11)).astype(float) * 2.0**-53
        two = chance < 1 / threshold - 1
        first = (trees * DEPTH + level) * 2
        at = np.concatenate([first, first[two] + 1])
        owners, trees, parents = (np.concatenate([x, x[two]]) for x in (owners, trees, nodes))
        values = sketches[owners, at].astype(np.uint64)
        nodes = mix(mix(parents + np.uint64(0x9E3779B97F4A7C15)) ^ mix(values + (at.astype(np.uint64) << np.uint64(32))))
    return owners, (nodes & ~np.uint64(1)) | (trees < FIRST).astype(np.uint64)


def _set_keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two numbers that equal sets share."""
    return [pa.array([int(mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()) for salt in (0x1234567, 0xABCDEF12345)]


def _sketches(size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], size)
                full = [k for k, s in enumerate(sets) if len(s)]
                owners, nodes = plant(np.array([sketch(sets[k]) for k in full], np.uint32).reshape(-1, WIDTH), threshold)
                nodes = np.split(nodes[np.argsort(owners, kind="stable")], np.cumsum(np.bincount(owners, minlength=len(full)))[:-1])
                planted = {k: x.tobytes() for k, x in zip(full, nodes, strict=False)}
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *_set_keys(sets),
                        pa.array([planted.get(k) for k in range(b - a)], pa.binary()),
                    ],
                    names=["id", "n", "key1", "key2", "nodes"],
                )

    return run


def _carried(size: int):
    """Adds to (id, text) the set's keys and size, and its least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], size)
                more = [*_set_keys(sets), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:WHOLE].tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *more], names=["id", "text", "key1", "key2", "n", "least"])

    return run


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node of each row."""
    for whole in batches:
        for k in range(0, whole.num_rows, 2000):
            batch = whole.slice(k, 2000)
            nodes = [np.frombuffer(x, np.int64) for x in batch["nodes"].to_pylist()]
            at = pa.array(np.repeat(np.arange(len(nodes)), [len(x) for x in nodes]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(nodes)), batch["id"].take(at), batch["n"].take(at)], names=["node", "id", "n"]
            )


def _spots(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of each shingle."""
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def _crowds(size: int, bits: int, most: int):
    """(piece, counts): how many shingles of a task's sets fall on each spot, ``most`` at most; pieces of ``PIECE`` spots, empty ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in slices(texts):
                spots, times = np.unique(_spots(np.concatenate(shingle_sets(texts[a:b], size)), bits), return_counts=True)
                counts[spots] = np.minimum(counts[spots] + times, most)
        pieces = counts.reshape(-1, PIECE)
        for some in np.array_split(np.flatnonzero(pieces.any(axis=1)), max(1, len(pieces) // 256)):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([pieces[k].tobytes() for k in some], pa.binary())], names=["piece", "counts"])

    return run


def _crowded(most: int):
    """(piece, marks): one bit per spot of each piece, set where the counts of all tasks add up to ``most`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for piece, counts in zip(batch["piece"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                sums[piece] = np.minimum(sums.get(piece, 0) + np.frombuffer(counts, np.uint16).astype(np.int64), most)
        marks = [np.packbits(x >= most).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(marks, pa.binary())], names=["piece", "marks"])

    return run


def _frequencies(size: int, bits: int, crowded):
    """(shingle, number of sets that hold it), added up per slice of a batch, of the shingles on spots that ``crowded`` broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(crowded.value).astype(bool)
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in slices(texts):
                shingles = np.concatenate(shingle_sets(texts[a:b], size))
                values, times = np.unique(shingles[marked[_spots(shingles, bits)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times)], names=["shingle", "times"])

    return run


def frequent_shingles(texts: DataFrame, size: int, total: int) -> DataFrame:
    """(shingle, times) of the shingles that more than ``BLOCK`` of ``texts`` hold; ``total`` is the size of all sets together.

    Shingles are counted one by one only where more than ``BLOCK`` fall on a spot. Others cannot be frequent, and as
    a spot has about ``BLOCK / 8`` shingles (as long as ``SPOT_BITS`` allows), hardly one that is rare is moved.
    """
    bits = min(SPOT_BITS, max(PIECE.bit_length() - 1, (8 * total // BLOCK).bit_length()))
    crowds = texts.mapInArrow(_crowds(size, bits, BLOCK + 1), "piece long, counts binary")
    crowded = crowds.repartition(partitions_for(texts), "piece").mapInArrow(_crowded(BLOCK + 1), "piece long, marks binary").toPandas()
    marks = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, PIECE // 8)
    for piece, bytes_ in zip(crowded["piece"], crowded["marks"], strict=True):
        marks[piece] = np.frombuffer(bytes_, np.uint8)
    marked = texts.sparkSession.sparkContext.broadcast(marks.reshape(-1))
    counts = texts.mapInArrow(_frequencies(size, bits, marked), "shingle long, times long")
    return counts.groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") > BLOCK)


def rare_first(shingles: np.ndarray, hot: np.ndarray, rank: np.ndarray, ratio: tuple[int, int]) -> tuple[np.ndarray, int]:
    """The first shingles of a set that a linked set of at most its size may start to share, and how many of them may meet a larger one.

    ``hot`` is sorted, ``rank`` its places in the common order, in which all other shingles come first, by value.
    """
    n = len(shingles)
    at = np.minimum(np.searchsorted(hot, shingles), max(0, len(hot) - 1))
    place = np.where(hot[at] == shingles, rank[at] + 1, 0) if len(hot) else np.zeros(n, np.int64)
    probe = n + n * ratio[0] // -ratio[1] + 1
    seeds = n + 2 * n * ratio[0] // -(ratio[0] + ratio[1]) + 1
    return shingles[np.lexsort((shingles, place))[:probe]], seeds


def _rare_nodes(size: int, ratio: tuple[int, int], order):
    """One row per node of a text's rare shingles; ``order`` broadcasts hot shingles and their ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = order.value
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], size)
                firsts = [rare_first(s, hot, rank, ratio) for s in sets]
                many = [len(first) for first, _ in firsts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([first for first, _ in firsts]).view(np.int64)),
                        batch["id"].slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), many))),
                        pa.array(np.repeat([len(s) for s in sets], many).astype(np.int64)),
                        pa.array(np.concatenate([np.arange(len(first)) < seeds for first, seeds in firsts])),
                    ],
                    names=["node", "id", "n", "seed"],
                )

    return run


def rare_nodes(texts: DataFrame, members: DataFrame, size: int, ratio: tuple[int, int]) -> DataFrame:
    """(node, id, n, seed): those of ``texts`` (id, text) whose id is in ``members`` (id, n) at each of their rare shingles."""
    texts = materialized(texts.join(members, "id", "left_semi"), "nd-wide")
    total = members.agg(F.sum("n")).first()[0]
    hot = frequent_shingles(texts, size, total).orderBy(F.desc("times"), "shingle").limit(HOT).toPandas()
    values = hot["shingle"].to_numpy(np.int64).view(np.uint64)
    by_value = np.argsort(values)
    order = texts.sparkSession.sparkContext.broadcast((values[by_value], len(values) - 1 - by_value))
    return materialized(texts.mapInArrow(_rare_nodes(size, ratio, order), "node long, id long, n long, seed boolean"), "nd-rare")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of any two of ``sets``."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    kept = often[column]
    owner, column = owner[kept], (np.cumsum(often) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        table = np.zeros((len(sets), 4096), np.float32)
        table[owner[a:b], column[a:b] - start] = 1
        out += table @ table.T
    return out.astype(np.int64)


def forest(links: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The tree that each position is in by ``links`` and ``same``, and the links of a forest that join what is not the same."""
    tree = np.full(len(links), -1)
    out = []
    for root in range(len(links)):
        if tree[root] >= 0:
            continue
        tree[root] = root
        todo = [root]
        while todo:
            at = todo.pop()
            for near in np.flatnonzero((links[at] | same[at]) & (tree < 0)):
                tree[near] = root
                todo.append(near)
                if not same[at, near]:
                    out.append((at, near))
    return tree, out


def linked(both: np.ndarray, n: np.ndarray, ratio: tuple[int, int]) -> np.ndarray:
    """Which pairs of sets of ``n`` shingles that share ``both`` are linked."""
    return (both > 0) & (ratio[1] * both >= ratio[0] * (n[:, None] + n - both))


def compare_block(
    n: np.ndarray, component: np.ndarray, least: list[np.ndarray], ratio: tuple[int, int]
) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """The links (position, position) that join the components of a block, and the groups to be compared on full sets.

    Links are exact and form a forest. Groups are of members that possible pairs between its trees hold together.
    """
    both = shared_counts(least)
    same = component[:, None] == component
    whole = n <= WHOLE
    exact = whole[:, None] & whole
    tree, links = forest(exact & linked(both, n, ratio), same)
    threshold = ratio[0] / ratio[1]
    lowest = threshold - 5 * (threshold * (1 - threshold) / WHOLE) ** 0.5
    fits = np.minimum(n[:, None], n) * ratio[1] >= np.maximum(n[:, None], n) * ratio[0]
    possible = ~exact & fits & (tree[:, None] != tree) & (both >= lowest * WHOLE)
    if not possible.any():
        return links, []
    last, many = np.array([x[-1] for x in least]), np.array([len(x) for x in least])
    below = np.array([np.searchsorted(x, last, "right") for x in least])  # of the row's least, up to the column's last
    end = np.where(whole, np.iinfo(np.uint64).max, last)
    union = np.where(end[:, None] <= end, many[:, None] + below.T, below + many) - both
    possible &= both >= lowest * union
    group, _ = forest(possible, np.zeros_like(possible))
    return links, [x for x in (np.flatnonzero(group == g) for g in np.unique(group)) if len(x) > 1]


def portions(n: np.ndarray) -> list[np.ndarray]:
    """Positions of sets of ``n`` shingles, dealt so that any two meet and few hold more than ``FULL`` shingles in all."""
    piece = (np.cumsum(n) - n) // max(1, FULL // 2)
    pieces = np.unique(piece)
    if len(pieces) <= 2:
        return [np.arange(len(n))]
    return [np.flatnonzero((piece == p) | (piece == q)) for k, p in enumerate(pieces) for q in pieces[k + 1 :]]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.Table]]:
    """The runs of rows with equal keys, batch by batch; a run may go on in the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        other = [pc.not_equal(table[c].slice(1), table[c].slice(0, table.num_rows - 1)).to_numpy() for c in keys]
        borders = [0, *(np.flatnonzero(np.any(other, axis=0)) + 1).tolist()]
        rest = table.slice(borders[-1])
        yield [table.slice(a, b - a) for a, b in zip(borders[:-1], borders[1:], strict=True)]
    if rest is not None:
        yield [rest]


def _compare(ratio: tuple[int, int]):
    """Runs ``compare_block`` on each (node, block, part): links (a, b), and the members (a, with their component) of each group."""

    def found(block: pa.Table) -> Iterator[tuple[int, int, bytes | None]]:
        ids, first = np.unique(block["id"].to_numpy(), return_index=True)
        block = block.take(pa.array(first))
        n, component = block["n"].to_numpy(), block["component"].to_numpy()
        links, groups = compare_block(n, component, [np.frombuffer(x, np.uint64) for x in block["least"].to_pylist()], ratio)
        for i, j in links:
            yield int(min(ids[i], ids[j])), int(max(ids[i], ids[j])), None
        for group in groups:
            for at in (group[x] for x in portions(n[group])):
                name = hashlib.blake2b(ids[at].tobytes(), digest_size=16).digest()  # the same members in another node are the same group
                yield from ((int(ids[k]), int(component[k]), name) for k in at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _runs(batches, ["node", "block", "part"]):
            rows = [x for block in blocks for x in found(block)]
            a, b, names = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(names, pa.binary())], names=["a", "b", "group"])

    return run


def _compare_full(size: int, ratio: tuple[int, int]):
    """The links that join the components of a group, by the full shingle sets of its texts."""

    def found(group: pa.Table) -> Iterator[tuple[int, int]]:
        texts = texts_of(group["text"])
        sets = [s for a, b in slices(texts) for s in shingle_sets(texts[a:b], size)]
        ids, component = group["id"].to_numpy(), group["component"].to_numpy()
        links = linked(shared_counts(sets), np.array([len(s) for s in sets]), ratio)
        for i, j in forest(links, component[:, None] == component)[1]:
            yield int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _runs(batches, ["group"]):
            rows = [x for group in groups for x in found(group)]
            a, b = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b), the component named by its smallest id.

    Each round every vertex hooks to its least neighbour, hooks are followed one step further, and the links
    between what is still apart go on: the rounds grow with the logarithm of the longest chain.
    """
    edges = materialized(links.select("a", "b").where("a <> b").distinct(), "cc-edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("p"))
        far = hooks.select(F.col("v").alias("p"), F.col("p").alias("q"))
        hooks = materialized(hooks.join(far, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "cc-hooks")
        if labels is None:
            labels = hooks.select(F.col("v").alias("id"), F.col("p").alias("component"))
        else:
            moved = labels.join(hooks, labels["component"] == hooks["v"], "left")
            labels = moved.select("id", F.coalesce("p", "component").alias("component"))
        to_a, to_b = (hooks.select(F.col("v").alias(c), F.col("p").alias(f"{c}2")) for c in "ab")
        edges = materialized(
            edges.join(to_a, "a", "left").join(to_b, "b", "left")
            .select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
            .where("a <> b").distinct(),
            "cc-edges",
        )
        if edges.isEmpty():
            return materialized(labels, "cc-labels")


def maybe_among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose id may be in ``ids``, by a bitmap of ``BITS`` bits: no row is moved for this, and few others stay."""
    spot, bit = F.pmod(F.xxhash64("id"), F.lit(BITS)), "shiftleft(1L, int(spot % 64))"
    word = F.shiftright("spot", 6).alias("word")
    marked = ids.select(spot.alias("spot")).groupBy(word).agg(F.expr(f"bit_or({bit})").alias("bits"))
    spotted = rows.withColumn("spot", spot).withColumn("word", word)
    return spotted.join(F.broadcast(marked), "word").where(F.expr(f"bits & {bit} <> 0")).select(*rows.columns)


class _Members:
    """Size, least hashes and text of the representatives that share a node, bucketed by id so that look-ups do not move them."""

    def __init__(self, plain: DataFrame, classes: DataFrame, ids: DataFrame, size: int):
        self.spark = plain.sparkSession
        self.name = f"members_{uuid.uuid4().hex}"
        n, key = partitions_for(plain), ["id", "key1", "key2"]
        texts = maybe_among(plain, ids).join(ids, "id", "left_semi")
        read = texts.mapInArrow(_carried(size), "id long, text string, key1 long, key2 long, n long, least binary")
        one = read.join(classes.select(*key), key, "left_semi").dropDuplicates(key).select("id", "n", "least", "text")
        one.repartition(n, "id").write.bucketBy(n, "id").sortBy("id").option("path", scratch_path(self.spark, "members")).format(
            "parquet"
        ).saveAsTable(self.name)

    def table(self, *columns: str) -> DataFrame:
        return self.spark.table(self.name).select(*columns)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _state(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``nodes`` (node, id, n, seed) with the members' components, and per node its size, main component and number of guests.

    Guests are the members outside the main component, or the seeds where these are fewer.
    Nodes of one component or without a guest go. Of nodes with the same members, one stays.
    """
    named = nodes.withColumn("component", F.col("id"))
    if labels is not None:
        named = nodes.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    marks = [F.bit_xor(F.xxhash64("id", "seed", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    counted = named.groupBy("node", "component").agg(F.count(F.lit(1)).alias("members"), F.count_if("seed").alias("seeds"), *marks)
    top = counted.groupBy("node").agg(
        F.max(F.struct("members", "component")).alias("top"), F.sum("members").alias("size"), F.sum("seeds").alias("seeds"),
        *[F.bit_xor(m).alias(m) for m in ("mark1", "mark2")],
    )
    top = top.withColumn("outside", F.col("size") - F.col("top.members")).where("outside > 0 AND seeds > 0")
    top = top.withColumns({"by_seed": F.col("seeds") < F.col("outside"), "outside": F.least("outside", "seeds")})
    top = (
        top.groupBy("size", "mark1", "mark2")
        .agg(F.min(F.struct("node", F.col("top.component").alias("main"), "outside", "by_seed")).alias("x"))
        .select("x.*", "size")
    )
    guest = F.when(F.col("by_seed"), F.col("seed")).otherwise(F.col("component") != F.col("main"))
    return named.join(top, "node").withColumn("guest", guest).drop("main", "by_seed")


def _blocks(state: DataFrame, level: int, last: bool) -> DataFrame:
    """(node, block, part, id, component): what one comparison holds. Small nodes are covered in full, others in part unless ``last``."""
    blocks = F.ceil(F.col("size") / BLOCK)
    parts = F.when(F.col("size") <= BLOCK, 0).otherwise(F.ceil(F.col("outside") / BLOCK))
    if not last:
        parts = F.when(F.col("outside") <= BLOCK, parts).otherwise(0)
    dealt = state.withColumns({"blocks": blocks.cast("long"), "parts": parts.cast("long")})
    own = dealt.withColumn("block", F.pmod(F.xxhash64("id", "node", F.lit(level)), "blocks"))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("parts") - 1, F.lit(0)))) if last else F.lit(0)
    own = own.withColumn("part", meets)
    guests = dealt.where("parts > 0 AND guest").withColumn("part", F.pmod(F.xxhash64("node", "id"), "parts"))
    guests = guests.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = [*(F.col(c).cast("long").alias(c) for c in ("node", "block", "part")), "id", "component"]
    return own.select(*columns).unionByName(guests.select(*columns))


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    ratio: tuple[int, int] = (80, 100),
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents are linked if ``ratio[1]`` * intersection >= ``ratio[0]`` * union of their sets of ``size``-word shingles.
    """
    threshold = ratio[0] / ratio[1]
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), empty_safe(F.col(text)).alias("text"))
    columns = "id long, n long, key1 long, key2 long, nodes binary"
    sets = materialized(plain.mapInArrow(_sketches(size, threshold), columns), "nd-sketches")
    classes = materialized(
        sets.where("n > 0 AND id IS NOT NULL")
        .groupBy("key1", "key2")
        .agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("nodes").alias("nodes")),
        "nd-classes",
    )
    planted = materialized(classes.select("id", "n", "nodes").mapInArrow(_planted, "node long, id long, n long"), "nd-nodes")
    shared = planted.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("node")
    nodes = materialized(planted.join(shared, "node", "left_semi"), "nd-shared").withColumn("seed", F.lit(True))
    members = _Members(plain, classes, materialized(nodes.select("id").distinct(), "nd-ids"), size)

    links = labels = later = None
    if MAX_LEVELS:
        nodes, later = nodes.where("node % 2 <> 0"), nodes.where("node % 2 = 0")
    for level in range(MAX_LEVELS + 2):
        last = level == MAX_LEVELS + 1
        state = materialized(_state(nodes, labels), "nd-state")
        wide = state.where(f"outside > {BLOCK}")
        if level == MAX_LEVELS and not wide.isEmpty():
            rare = rare_nodes(members.table("id", "text"), wide.select("id", "n").distinct(), size, ratio)
            small = state.where(f"outside <= {BLOCK}").select(*rare.columns)
            state = materialized(_state(small.unionByName(rare), labels), "nd-state")
        if state.isEmpty() and later is None:
            break
        work = _blocks(state, level, last)
        met = work.join(members.table("id", "n", "least"), "id").repartition(partitions_for(docs), "node", "block", "part")
        met = met.sortWithinPartitions("node", "block", "part").select("node", "block", "part", "id", "component", "n", "least")
        pairs = materialized(met.mapInArrow(_compare(ratio), "a long, b long, group binary"), "nd-pairs")
        found = pairs.where("group IS NULL").select("a", "b")
        unsure = pairs.where("group IS NOT NULL").distinct()
        if not unsure.isEmpty():
            unsure = unsure.select("group", F.col("a").alias("id"), F.col("b").alias("component"))
            met = unsure.join(members.table("id", "text"), "id").repartition(partitions_for(docs), "group").sortWithinPartitions("group")
            met = met.select("group", "id", "component", "text")
            found = found.unionByName(materialized(met.mapInArrow(_compare_full(size, ratio), "a long, b long"), "nd-links"))
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
        nodes = state.where(f"outside > {BLOCK}").select("node", "id", "n", "seed")
        if later is not None:
            nodes, later = nodes.unionByName(later), None
    members.drop()

    named = classes.select("key1", "key2", F.col("id").alias("class_id"))
    out = sets.drop("nodes").join(named, ["key1", "key2"], "left")
    if labels is not None:
        out = out.join(labels.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    least = F.coalesce("component", F.when(F.col("n") > 0, F.col("class_id")), "id")
    component = F.when(F.col("id").isNotNull(), least)
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
