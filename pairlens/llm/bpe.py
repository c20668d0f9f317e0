"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece there is one token its encoding ends with. It is
found from shorter prefixes: a vocabulary token that ends here is the last one if
the token before it, already known, may stand next to it, that is if the two
joined encode to just these two. Storing that last token per prefix makes
appending exact without a second look at the start, and an edit needs
re-encoding only until the stored last tokens agree again over as many bytes as
the longest token has.

Texts are split by the vocabulary's pattern and every match is encoded by itself;
repeated matches come from a bounded cache. Null text counts as empty. Other
columns and repeated rows stay as they are; token ids are kept packed as
little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import empty_safe, slices, texts_of, with_columns

CACHE_PIECES = 500_000
CACHE_PREFIXES = 500_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank from the content of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Prefixes:
    """The bytes of one piece with the last token of every prefix."""

    def __init__(self):
        self.data = b""
        self.last: list[int] = [-1]  # by prefix length

    def copy(self) -> Prefixes:
        other = Prefixes()
        other.data, other.last = self.data, list(self.last)
        return other


class PrefixEncoder:
    """Encodes pieces by the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._fits: dict[int, bool] = {}
        self._known: dict[bytes, int] = {}  # last token by prefix, shared by all pieces

    def merge(self, data: bytes) -> list[int]:
        """The defining procedure: join the lowest-ranked adjacent pair until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self._fits[key] = known
        return known

    def _last_at(self, data: bytes, last: list[int], end: int) -> int:
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            token = self.ranks.get(data[start:end])
            if token is not None and (start == 0 or self.fits(last[start], token)):
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def append(self, state: Prefixes, more: bytes) -> Prefixes:
        """Extend a piece at its end; nothing before is looked at again but for the longest token."""
        state.data += more
        for end in range(len(state.last), len(state.data) + 1):
            state.last.append(self._last_at(state.data, state.last, end))
        return state

    def replace(self, state: Prefixes, at: int, drop: int, new: bytes) -> tuple[Prefixes, int]:
        """Replace ``drop`` bytes at ``at``; also returns how many prefixes were computed anew."""
        out = Prefixes()
        out.data = state.data[:at] + new + state.data[at + drop :]
        out.last = state.last[: at + 1]
        shift, settled, done = len(new) - drop, 0, 0
        for end in range(at + 1, len(out.data) + 1):
            out.last.append(self._last_at(out.data, out.last, end))
            done += 1
            old = end - shift
            same = end > at + len(new) and 0 < old < len(state.last) and state.last[old] == out.last[end]
            settled = settled + 1 if same else 0
            if settled >= self.longest:
                out.last += state.last[old + 1 :]
                break
        return out, done

    def ids(self, state: Prefixes) -> list[int]:
        out, end = [], len(state.data)
        while end:
            out.append(state.last[end])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 64:
            return self.ids(self.append(Prefixes(), piece))
        # Pieces with a common beginning share its prefixes' last tokens.
        if len(self._known) >= CACHE_PREFIXES:
            self._known.clear()
        known, state = self._known, Prefixes()
        state.data = piece
        for end in range(1, len(piece) + 1):
            prefix = piece[:end]
            last = known.get(prefix)
            if last is None:
                last = known[prefix] = self._last_at(piece, state.last, end)
            state.last.append(last)
        return self.ids(state)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Pieces(dict):
    """Packed ids by piece, emptied when full."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        packed = np.array(self.encoder.encode(piece.encode()), "<u4").tobytes()
        if len(piece) < 64:
            self[piece] = packed
        return packed


_made: dict[int, tuple[PrefixEncoder, _Pieces]] = {}


def _encoder(data: bytes) -> tuple[PrefixEncoder, _Pieces]:
    """One encoder per worker and vocabulary."""
    key = hash(data)
    if key not in _made:
        encoder = PrefixEncoder(read_ranks(data))
        _made[key] = encoder, _Pieces(encoder)
    return _made[key]


def _encode(shared, pattern: str, text: str, ids: str, n_tokens: str, decoded: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = _encoder(shared.value)
        find = regex.compile(pattern).findall
        for whole in batches:
            for a, b in slices(texts_of(whole[text])):
                batch = whole.slice(a, b - a)
                packed = [b"".join(map(pieces.__getitem__, find(t or ""))) for t in batch[text].to_pylist()]
                columns = {
                    ids: pa.array(packed, pa.binary()),
                    n_tokens: pa.array([len(p) // 4 for p in packed], pa.int64()),
                }
                if decoded:
                    back = [encoder.decode(np.frombuffer(p, "<u4").tolist()) for p in packed]
                    columns[decoded] = pa.array(back, pa.binary())
                yield with_columns(batch, columns)

    return run


def encode_texts(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    text: str = "text",
    ids: str = "token_ids",
    n_tokens: str = "n_tokens",
    decoded: str | None = None,
) -> DataFrame:
    """``docs`` with packed token ids and their number; with ``decoded``, also the bytes decoded from the ids.

    ``vocabulary`` is the path of a rank file, read by the driver and sent to the tasks once (a fixed file below 1 MB).
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    taken = [n for n in (ids, n_tokens, decoded) if n]
    rows = docs.select(*[c for c in docs.columns if c not in taken]).withColumn(text, empty_safe(F.col(text)))
    schema = T.StructType(list(rows.schema.fields)).add(ids, "binary").add(n_tokens, "long")
    if decoded:
        schema = schema.add(decoded, "binary")
    return rows.mapInArrow(_encode(shared, pattern, text, ids, n_tokens, decoded), schema)


def decode_ids(rows: DataFrame, vocabulary: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that packed ``ids`` stand for; null ids give null."""
    with open(vocabulary, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _encoder(shared.value)
        for batch in batches:
            back = [None if p is None else encoder.decode(np.frombuffer(p, "<u4").tolist()) for p in batch[ids].to_pylist()]
            yield with_columns(batch, {decoded: pa.array(back, pa.binary())})

    rest = rows.select(*[c for c in rows.columns if c != decoded])
    return rest.mapInArrow(run, T.StructType(list(rest.schema.fields)).add(decoded, "binary"))
