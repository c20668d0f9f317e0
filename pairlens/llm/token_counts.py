"""Token counts under a unigram vocabulary, by dynamic programming on a trie.

Texts are split into pre-tokens. A worker inserts each distinct pre-token into a
trie of byte prefixes; a node stores the forward score of its prefix, that is the
least cost of any way to cut it into vocabulary tokens and the number of tokens
of that way, computed once for all pre-tokens that share the prefix. Where a
pre-token ends the node counts its occurrences. A document's count is the sum
over its pre-tokens; nothing is shuffled, and the trie is emptied when it holds
``TRIE_NODES`` nodes, which changes no result.

A token of rank r costs round(1000 ln((r + 1) H)), H being the sum of 1 / (r + 1):
a Zipf unigram model over the ranks, in whole thousandths so that sums are exact.
Equal costs are settled for fewer tokens. Null or empty text has no tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.bpe import read_ranks
from pairlens.llm.common import empty_safe, slices, texts_of, with_columns

TRIE_NODES = 2_000_000


def unigram_costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    total = sum(1 / (r + 1) for r in ranks.values())
    return {token: round(1000 * math.log((r + 1) * total)) for token, r in ranks.items()}


class ForwardTrie:
    """Byte trie whose nodes hold (cost, tokens) of the best cut of their prefix, and terminal counts."""

    def __init__(self, costs: dict[bytes, int]):
        self.costs = costs
        self.longest = max(map(len, costs))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.cost, self.tokens, self.terminal = [0], [0], [0]
        self.ends: dict[str, int] = {}  # node of each pre-token inserted

    def insert(self, piece: str, times: int = 1) -> int:
        """Count ``times`` occurrences of a pre-token; returns the node it ends at."""
        node = self.ends.get(piece)
        if node is None:
            node = self.ends[piece] = self._walk(piece.encode())
        self.terminal[node] += times
        return node

    def _walk(self, piece: bytes) -> int:
        path, node, child = [0], 0, self.child
        for end, byte in enumerate(piece, 1):
            key = node * 256 + byte
            node = child.get(key, -1)
            if node < 0:
                node = child[key] = len(self.cost)
                self._forward(piece, path, end)
            path.append(node)
        return node

    def _forward(self, piece: bytes, path: list[int], end: int) -> None:
        """Append the node of a new prefix: its best last token and what stands before it."""
        get, best, least = self.costs.get, -1, -1
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            cost = get(piece[start:end])
            if cost is not None:
                before = path[start]
                cost += self.cost[before]
                if best < 0 or cost < best or (cost == best and self.tokens[before] < least):
                    best, least = cost, self.tokens[before]
        if best < 0:
            raise ValueError("the vocabulary lacks a single byte")
        self.cost.append(best)
        self.tokens.append(least + 1)
        self.terminal.append(0)


_tries: dict[int, ForwardTrie] = {}


def _count(shared, pattern: str, text: str, names: tuple[str, str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _tries:
            _tries[key] = ForwardTrie(unigram_costs(read_ranks(shared.value)))
        trie, find = _tries[key], regex.compile(pattern).findall
        for whole in batches:
            for a, b in slices(texts_of(whole[text])):
                batch = whole.slice(a, b - a)
                found = [find(t or "") for t in batch[text].to_pylist()]
                if len(trie.cost) >= TRIE_NODES:
                    trie.clear()
                for piece, times in Counter(p for pieces in found for p in pieces).items():
                    trie.insert(piece, times)
                sums = []
                for pieces in found:
                    nodes = [trie.ends[p] for p in pieces]
                    cost, tokens = sum(map(trie.cost.__getitem__, nodes)), sum(map(trie.tokens.__getitem__, nodes))
                    sums.append((len(nodes), len(set(nodes)), cost, tokens))
                columns = zip(*sums, strict=True)
                order = (names[0], names[1], names[3], names[2])
                arrays = dict(zip(order, (pa.array(c, pa.int64()) for c in columns), strict=True))
                yield with_columns(batch, {n: arrays[n] for n in names})

    return run


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    text: str = "text",
    names: tuple[str, str, str, str] = ("n_pretokens", "n_distinct", "n_tokens", "cost"),
) -> DataFrame:
    """``docs`` with the numbers of pre-tokens, distinct pre-tokens and tokens, and the cost in thousandths."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(*[c for c in docs.columns if c not in names]).withColumn(text, empty_safe(F.col(text)))
    schema = T.StructType(list(rows.schema.fields))
    for name in names:
        schema = schema.add(name, "long")
    return rows.mapInArrow(_count(shared, pattern, text, names), schema)
