"""Score-based selection, matched controls and agreement of repeated runs.

Samples inside a dataset are cut off at their last row, found by radix selection
(``pairlens.operators.radix``): a dataset with a third of all rows is neither sorted nor moved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.hashing import hash_order
from pairlens.functions.numeric import pearson
from pairlens.operators.associate import average_rank
from pairlens.operators.ordering import grouped, packed_places, picked, unpacked_places
from pairlens.operators.radix import NULL_KEY, first_rows, nth_rows, order_keys, packed_quantiles, values_of
from pairlens.session import fits_broadcast, lookup_side, materialized


def select_by_score(
    df: DataFrame,
    score: str,
    dataset: str,
    row_id: str,
    threshold: float | None = None,
    top_k: int | None = None,
    top_fraction: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Rows chosen by exactly one rule, with the rule's text in ``rule``.

    Equal scores are ordered by a seeded hash of the row id.
    """
    given = [r for r in (threshold, top_k, top_fraction) if r is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of threshold, top_k and top_fraction")
    if threshold is not None:
        rule = f"{score} >= {threshold}"
        return df.where(F.col(score) >= threshold).withColumn("rule", F.lit(rule))
    if top_k is not None:
        wanted, rule = F.lit(top_k), f"top {top_k} by {score}"
    else:
        wanted = F.ceil(F.col("group_rows") * F.lit(top_fraction))
        rule = f"top fraction {top_fraction} by {score}"
    digest = hash_order(seed, F.col(row_id))
    kept = first_rows(df, [dataset], digest, [row_id], wanted, value=score)
    return kept.withColumn("rule", F.lit(rule))


def selection_manifest(selected: DataFrame, dataset: str, hashes: Sequence[str]) -> DataFrame:
    """What a selection must leave behind: dataset, row hashes and the rule."""
    return selected.select(dataset, *hashes, "rule")


def random_control(
    df: DataFrame, selected: DataFrame, dataset: str, row_id: str, seed: int = 42
) -> DataFrame:
    """As many rows per dataset as were selected, in seeded hash order."""
    quota = selected.groupBy(dataset).agg(F.count(F.lit(1)).alias("__quota"))
    digest = hash_order(seed, F.col(row_id))
    return first_rows(df, [dataset], digest, [row_id], F.col("__quota"), quota=materialized(quota, "quota"))


def length_control(
    df: DataFrame,
    selected: DataFrame,
    dataset: str,
    row_id: str,
    length: Column,
    width: int = 1,
    seed: int = 42,
) -> DataFrame:
    """Unselected rows with the same length profile as the selected ones.

    Lengths fall into buckets of ``width``; each (dataset, bucket) gives as many
    rows as were selected from it, in seeded hash order, or all it has.
    """
    if width < 1:
        raise ValueError("width must be positive")
    bucket = F.floor(length / width).alias("length_bucket")
    # The selection is read twice; only its keys are written.
    taken = materialized(selected.select(dataset, row_id, bucket), "selected-keys")
    quota = taken.groupBy(dataset, "length_bucket").agg(F.count(F.lit(1)).alias("__quota"))
    rest = df.join(lookup_side(taken.drop("length_bucket")), [dataset, row_id], "left_anti").select("*", bucket)
    digest = hash_order(seed, F.col(row_id))
    return first_rows(
        rest, [dataset, "length_bucket"], digest, [row_id], F.col("__quota"), quota=materialized(quota, "quota")
    )


CELLS = T.ArrayType(T.StructType().add("code", T.LongType()).add("a", T.DoubleType()).add("b", T.DoubleType()))
#: Cells held by a task until they are written as chunks, one for each code.
CHUNK_CELLS = 1 << 21


def _codes_of(batch: pa.RecordBatch, names: Sequence[str], codes: dict[tuple, int]) -> np.ndarray:
    """The code of each row's names, -1 for names that ``codes`` lacks."""
    place, values = np.zeros(batch.num_rows, np.int64), []
    for name in names:
        found = batch[name].dictionary_encode(null_encoding="encode")
        values.append(found.dictionary.to_pylist())
        place = place * len(values[-1]) + found.indices.to_numpy(zero_copy_only=False)
    distinct, at = _distinct(place)
    out = np.empty(len(distinct), np.int64)
    for i, spot in enumerate(distinct.tolist()):
        key = []
        for v in reversed(values):
            spot, k = divmod(spot, len(v))
            key.append(v[k])
        out[i] = codes.get(tuple(reversed(key)), -1)
    return out[at]


def _packed(keys: Sequence[str], names: Sequence[str], codes: dict[tuple, int] | None):
    """Rows of equal ``keys`` that follow each other as one row with arrays of the other columns; ``names`` become codes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if codes is not None and batch.num_rows:
                code = _codes_of(batch, names, codes)
                kept = [c for c in batch.schema.names if c not in names]
                batch = pa.RecordBatch.from_arrays([*[batch[k] for k in keys], pa.array(code), batch[kept[-1]]], names=[*keys, "code", kept[-1]])
                if (code < 0).any():
                    batch = batch.filter(pa.array(code >= 0))
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for key in keys:
                at = batch[key].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= at[1:] != at[:-1]
            first = np.flatnonzero(new)
            ends = pa.array(np.append(first, n).astype(np.int32))
            kept = [batch[key].take(pa.array(first)) for key in keys]
            lists = [(c, pa.ListArray.from_arrays(ends, batch[c])) for c in batch.schema.names if c not in keys]
            yield pa.RecordBatch.from_arrays([*kept, *[x for _, x in lists]], names=[*keys, *[c for c, _ in lists]])

    return run


def _spread(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _matched(keys: Sequence[str]):
    """Cells ``(code, a, b)`` of each row: all pairs of equal code, in the order of ``ca``, then ``cb``; ``again`` also where a code comes twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (row_a, code_a), (row_b, code_b) = _spread(batch["ca"]), _spread(batch["cb"])
            codes, rank = _distinct(np.concatenate([code_a.to_numpy(), code_b.to_numpy()]))
            at_a, at_b = row_a * len(codes) + rank[: len(row_a)], row_b * len(codes) + rank[len(row_a) :]
            ranked = np.sort(at_a)
            once = not (ranked[1:] == ranked[:-1]).any()
            again = batch["again"].to_numpy(zero_copy_only=False).copy()
            if once and np.array_equal(at_a, at_b):
                row, code, a, b = row_a, code_a, batch["a"].flatten(), batch["b"].flatten()
            else:
                order = np.argsort(at_b, kind="stable")
                low, high = np.searchsorted(at_b[order], at_a), np.searchsorted(at_b[order], at_a, side="right")
                n = high - low
                left = np.repeat(np.arange(len(at_a)), n)
                right = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
                row, code = row_a[left], code_a.take(pa.array(left))
                a, b = batch["a"].flatten().take(pa.array(left)), batch["b"].flatten().take(pa.array(right))
                ranked = np.sort(at_a[left])
                again[ranked[1:][ranked[1:] == ranked[:-1]] // max(1, len(codes))] = True
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([code, a, b], names=["code", "a", "b"]))
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], pa.array(again), cells], names=[*keys, "again", "cells"])

    return run


def _paired(
    first: DataFrame, second: DataFrame, keys: Sequence[str], names: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """The join of ``(keys.., names.., v)`` with another such table, a few rows packed.

    Result ``(keys.., again, cells)`` with cells ``(code, a, b)``, and ``(code, names..)``. Cells of a key that follow
    each other, as they mostly do, travel as one row, so that the shuffle carries a key once;
    where they do not, there are more and shorter rows of the same cells. ``again`` marks keys
    in more than one row or with a name twice.
    """
    seen = first.select(*names).distinct().join(second.select(*names).distinct(), [*names])
    known = materialized(seen.withColumn("code", F.monotonically_increasing_id()), "names")
    rows = known.count()
    side, codes = lookup_side(known, rows), None
    if fits_broadcast(known, rows) and all(isinstance(known.schema[n].dataType, T.StringType) for n in names):
        codes = {tuple(r[n] for n in names): r["code"] for r in known.collect()}

    def pack(df: DataFrame, value: str) -> DataFrame:
        v = F.col("v").cast("double").alias(value)
        # A join ahead of Python would make the stage too long to be compiled.
        slim = df.select(*keys, *names, v) if codes is not None else df.join(side, [*names]).select(*keys, "code", v)
        schema = T.StructType([slim.schema[k] for k in keys]).add("code", T.ArrayType(T.LongType())).add(value, T.ArrayType(T.DoubleType()))
        return slim.mapInArrow(_packed(keys, names, codes), schema).withColumnRenamed("code", "c" + value)

    both = pack(first, "a").join(pack(second, "b"), [*keys])
    apart = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    both = both.select(*keys, apart.alias("again"), "ca", "a", "cb", "b")
    schema = T.StructType([both.schema[k] for k in keys]).add("again", T.BooleanType(), False).add("cells", CELLS)
    return both.mapInArrow(_matched(keys), schema), known


def _cells_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Row and code of each cell, and its values."""
    row, cells = _spread(batch["cells"])
    code, a, b = cells.flatten()
    return row, code.to_numpy(), a, b


def _chunked(limit: int):
    """Cells of one code as one row: order keys of both values, counts and sums; ids that come again, with the places of their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            code, a, b, again = (np.concatenate([h[k] for h in held]) for k in range(4))
            ids = pa.chunked_array([h[4] for h in held]).combine_chunks()
            id_at = np.cumsum(again) - 1
            codes, rank = _distinct(code)
            order = np.argsort(rank.astype(np.uint16) if len(codes) < 1 << 16 else rank, kind="stable")
            borders = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(codes)))])
            for k, own in enumerate(codes.tolist()):
                mine = order[borders[k] : borders[k + 1]]
                places = np.flatnonzero(again[mine])
                row = {"chunk": pa.array([number]), "code": pa.array([own]), "n": pa.array([len(mine)])}
                for name, x in (("a", a[mine]), ("b", b[mine])):
                    known = x[x != NULL_KEY]
                    row |= {
                        name: pa.array([x.tobytes()], pa.binary()), f"pick_{name}": pa.array([picked(x, number).tobytes()], pa.binary()),
                        f"n{name}": pa.array([len(known)]), f"s{name}": pa.array([float(values_of(known).sum())]),
                    }
                row["places"] = pa.array([places.tobytes()], pa.binary())
                row["ids"] = pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), ids.take(pa.array(id_at[mine[places]])))
                yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))
                number += 1

        for batch in batches:
            row, code, a, b = _cells_of(batch)
            again = batch["again"].to_numpy(zero_copy_only=False)[row]
            held.append((code, order_keys(a), order_keys(b), again, batch["row_id"].take(pa.array(row[again]))))
            size += len(code)
            if size >= limit:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(code)
    codes = codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes
    return codes, np.searchsorted(codes, code)


def _value_chunks(runs: DataFrame, limit: int = CHUNK_CELLS) -> DataFrame:
    id_type = runs.schema["row_id"].dataType
    schema = "chunk long, code long, n long, a binary, pick_a binary, na long, sa double, b binary, pick_b binary, nb long, sb double, places binary"
    schema = T.StructType.fromDDL(schema).add("ids", T.ArrayType(id_type))
    return materialized(runs.mapInArrow(_chunked(limit), schema), "values")


RANK_SUMS = ("m", "sx", "sy", "sxx", "syy", "sxy")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's sums of rank products, its ranks of cells whose id comes again, and the values it holds at the cuts of its code.

    Ranks are taken from the middle of the code's ranks, so that sums of products lose no digits.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).drop_columns(["a", "b", "ids"]).to_pylist()[0]
            again, ranks, out = np.frombuffer(row["places"], np.int64), [], {"code": pa.array([row["code"]])}
            for x in "ab":
                keys, inverse = grouped(np.frombuffer(batch[x][k].as_buffer(), np.int64))
                less, equal = unpacked_places(row[f"{x}_places"])
                for t, wanted in enumerate((row["size"], row["rows"] - row["size"])):
                    at = np.flatnonzero((less < wanted) & (wanted <= less + equal))
                    found = [{"key": int(keys[i]), "less": int(less[i]), "equal": int(equal[i])} for i in at]
                    out[f"{x}{t}"] = pa.array(found or [None], CUT)
                ranks.append((less + (equal - row["rows"]) / 2)[inverse])
            ids = batch["ids"].slice(k, 1).flatten()
            out |= {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
            out |= {n: pa.array([r[again]], pa.list_(pa.float64())) for n, r in zip(("xs", "ys"), ranks, strict=True)}
            alone = np.ones(row["n"], bool)
            alone[again] = False
            x, y = (r[alone] for r in ranks)
            sums = (len(x), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum())
            out |= {n: pa.array([float(v)]) for n, v in zip(RANK_SUMS, sums, strict=True)}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


CUT = pa.struct([("key", pa.int64()), ("less", pa.int64()), ("equal", pa.int64())])
CUTS = ("a0", "a1", "b0", "b1")


def _rank_sums(chunks: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """What ``_ranked`` gives of each chunk; the ordered values come from two exchanges of distinct values, rows are not moved."""
    places = [packed_places(chunks.select("chunk", "code", "n", x, f"pick_{x}"), x, f"pick_{x}", total) for x in "ab"]
    whole = chunks.select("chunk", "code", "n", "a", "b", "places", "ids").join(lookup_side(sizes.select("code", "rows", "size")), "code")
    whole = whole.join(places[0], "chunk").join(places[1], "chunk")
    cut = "struct<key: long, less: long, equal: long>"
    schema = "code long, " + ", ".join(f"{c} {cut}" for c in CUTS) + ", xs array<double>, ys array<double>, "
    schema = T.StructType.fromDDL(schema + ", ".join(f"{n} double" for n in RANK_SUMS)).fields
    schema.insert(5, T.StructField("ids", whole.schema["ids"].dataType))
    return materialized(whole.mapInArrow(_ranked, T.StructType(schema)), "rank-sums")


def _rank_products(sums: DataFrame) -> DataFrame:
    """``(code, r)``: correlation of the average ranks of ``a`` and of ``b``, over all pairs of cells that share code and id."""
    alone = sums.groupBy("code").agg(*[F.sum(n).alias(n) for n in RANK_SUMS])
    cells = sums.select("code", F.inline(F.arrays_zip("ids", "xs", "ys")))
    pairs = cells.groupBy("code", "ids").agg(
        F.count(F.lit(1)).cast("double").alias("g"), F.sum("xs").alias("x"), F.sum("ys").alias("y"),
        F.sum(F.col("xs") * F.col("xs")).alias("xx"), F.sum(F.col("ys") * F.col("ys")).alias("yy"),
    )
    g = F.col("g")
    again = {"m": g * g, "sx": g * F.col("x"), "sy": g * F.col("y"), "sxx": g * F.col("xx"), "syy": g * F.col("yy"), "sxy": F.col("x") * F.col("y")}
    whole = alone.unionByName(pairs.select("code", *[c.alias(n) for n, c in again.items()]))
    whole = whole.groupBy("code").agg(*[F.sum(n).alias(n) for n in RANK_SUMS])

    def moment(xy: str, x: str, y: str) -> Column:
        return F.col(xy) - F.col(x) * F.try_divide(F.col(y), F.col("m"))

    spread = F.sqrt(F.greatest(moment("sxx", "sx", "sx"), F.lit(0.0))) * F.sqrt(F.greatest(moment("syy", "sy", "sy"), F.lit(0.0)))
    return whole.select("code", F.try_divide(moment("sxy", "sx", "sy"), spread).alias("r"))


def _placed(codes: np.ndarray, cuts: dict[str, np.ndarray], whole: np.ndarray):
    """Hits of cells whose place at the cuts is sure, counted by code; and the cells that tie with a cut or whose id comes again.

    ``s`` columns mark what is sure to be inside, ``t`` columns what has the value at the cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, a, b = _cells_of(batch)
            k, keys = np.searchsorted(codes, code), {"a": order_keys(a), "b": order_keys(b)}
            sure = {c: keys[c[0]] < cuts[c][k] if c[1] == "0" else (keys[c[0]] > cuts[c][k]) | whole[k] for c in CUTS}
            ties = {c: (keys[c[0]] == cuts[c][k]) & ((c[1] == "0") | ~whole[k]) for c in CUTS}
            again = batch["again"].to_numpy(zero_copy_only=False)[row]
            open_ = again | np.logical_or.reduce(list(ties.values()))
            hits = [np.bincount(k[sure[f"a{t}"] & sure[f"b{t}"] & ~open_], minlength=len(codes)) for t in (0, 1)]
            at, of = np.flatnonzero(open_), np.flatnonzero(hits[0] + hits[1])
            none = pa.nulls(len(of), batch["row_id"].type)
            parts = [
                [pa.array(codes[of]), none, pa.nulls(len(of), pa.bool_()), *[pa.array(h[of]) for h in hits], *[pa.nulls(len(of), pa.int64())] * 8],
                [
                    pa.array(code[at]), batch["row_id"].take(pa.array(row[at])), pa.array(again[at]), *[pa.nulls(len(at), pa.int64())] * 2,
                    *[pa.array(x[c][at].astype(np.int64)) for x in (sure, ties) for c in CUTS],
                ],
            ]
            names = ["code", "row_id", "again", "hits0", "hits1", *[f"{x}{c}" for x in "st" for c in CUTS]]
            for p in parts:
                yield pa.RecordBatch.from_arrays(p, names=names)

    return run


def _decile_overlaps(runs: DataFrame, names: DataFrame, sizes: DataFrame, sums: DataFrame) -> DataFrame:
    """``(code, top, bottom)``: shares of the ``size`` first and last rows of a code by ``a`` that are so by ``b`` too.

    The order is by value, then digest. The values at the cuts are known from the ranks, so one comparison a row decides all
    but the rows that have such a value; those alone get a digest, and the last of them inside is found by radix selection.
    Rows that share code and id make as many pairs as there are of them on either side.
    """
    limits = sums.groupBy("code").agg(*[F.max(c).alias(c) for c in CUTS]).join(sizes, "code")
    limits = materialized(limits, "cuts")
    rows = limits.orderBy("code").collect()  # one a trait
    codes = np.array([r["code"] for r in rows], np.int64)
    cuts = {c: np.array([r[c]["key"] if r[c] else 0 for r in rows], np.int64) for c in CUTS}
    whole = np.array([r["rows"] == r["size"] for r in rows], bool)  # nothing lies above the bottom cut
    flags = ", ".join(f"{x}{c} long" for x in "st" for c in CUTS)
    schema = T.StructType.fromDDL(f"code long, again boolean, hits0 long, hits1 long, {flags}").fields
    schema.insert(1, runs.schema["row_id"])
    placed = materialized(runs.mapInArrow(_placed(codes, cuts, whole), T.StructType(schema)), "placed")
    digest = F.md5(F.concat_ws("|", "row_id", "trait"))
    number = lambda x: F.conv(x, 16, 10).cast("bigint")
    open_ = placed.where("again IS NOT NULL").join(lookup_side(names), "code").withColumn("__md5", digest)
    open_ = open_.withColumns({"d": number(F.substring("__md5", 1, 15)), "e": number(F.substring("__md5", 16, 15))})
    open_ = materialized(open_.drop("__md5", "trait", "hits0", "hits1"), "ties")
    tied = F.filter(F.array(*[F.when(F.col(f"t{c}") > 0, F.lit(c)) for c in CUTS]), lambda x: x.isNotNull())
    cut = F.array(*[F.struct(F.lit(c).alias("cut"), (F.col("size" if c[1] == "0" else "rest") - F.col(f"{c}.less")).alias("wanted")) for c in CUTS])
    targets = limits.withColumn("rest", F.col("rows") - F.col("size")).select("code", F.lit(0).alias("target"), F.inline(cut)).where("wanted > 0")
    largest = max((r[c]["equal"] for r in rows for c in CUTS if r[c]), default=0)
    found = nth_rows(open_.select("code", F.explode(tied).alias("cut"), "d", "e"), ["code", "cut"], ["d", "e"], targets, largest)
    last = F.struct(F.struct("d", "e").alias("at"), "equal", "inside")
    ends = found.groupBy("code").agg(*[F.max(F.when(F.col("cut") == c, last)).alias(f"__{c}") for c in CUTS])
    ends = lookup_side(materialized(limits.select("code").join(ends, "code", "left"), "tie-cuts"))
    sure, even, at = {}, {}, F.struct("d", "e")
    for c in CUTS:
        end, tie = F.col(f"__{c}"), F.col(f"t{c}") > 0
        inside = at < end["at"] if c[1] == "0" else at > end["at"]
        sure[c] = F.when(tie, inside.cast("bigint")).otherwise(F.col(f"s{c}"))
        # Rows at the cut itself: how many of them are inside, for rows that differ in nothing.
        share = end["inside"] if c[1] == "0" else end["equal"] - end["inside"]
        even[c] = F.when(tie & (at == end["at"]), share).otherwise(0)
    flagged = open_.join(ends, "code").select("code", "row_id", "again", *[sure[c].alias(f"s{c}") for c in CUTS], *[even[c].alias(f"e{c}") for c in CUTS])

    def held(n: str, many: bool) -> Column:
        if not many:
            return F.col(f"s{n}") + F.least(F.col(f"e{n}"), F.lit(1))
        return F.sum(f"s{n}") + F.least(F.max(f"e{n}"), F.count_if(F.col(f"e{n}") > 0))

    hits = lambda many: [(held(f"a{t}", many) * held(f"b{t}", many)).alias(f"hits{t}") for t in (0, 1)]
    alone = flagged.where("NOT again").select("code", *hits(False))
    many = flagged.where("again").groupBy("code", "row_id").agg(*hits(True)).drop("row_id")
    counted = placed.where("again IS NULL").select("code", "hits0", "hits1").unionByName(alone).unionByName(many)
    counted = counted.groupBy("code").agg(F.sum("hits0").alias("hits0"), F.sum("hits1").alias("hits1"))
    total = limits.select("code", "size").join(counted, "code", "left")
    share = lambda t: (F.coalesce(f"hits{t}", F.lit(0)) / F.col("size"))
    return total.select("code", share(0).alias("top"), share(1).alias("bottom"))


def repeatability(
    first: DataFrame,
    second: DataFrame,
    max_share: float = 0.1,
    top: int = 3,
    deciles: int = 10,
    min_rank: float = 0.9,
    min_overlap: float = 0.5,
) -> DataFrame:
    """Gates on two scoring runs ``(row_id, trait, score)`` of the same rows.

    Result ``(gate, trait, value, passed)``; ``passed`` is NULL for a bound and for a value that does not exist: Spearman of the trait-mean vectors, equality
    of the top trait sets, largest trait-mean difference and its share of the
    pooled interquartile range (with the bound it must stay under), and per
    trait the row Spearman and the overlap of the extreme deciles.
    """
    a = first.select("row_id", "trait", F.col("score").alias("v"))
    b = second.select("row_id", "trait", F.col("score").alias("v"))
    both, names = _paired(a, b, ["row_id"], ["trait"])
    both = materialized(both, "runs")
    chunks = _value_chunks(both)
    totals = chunks.groupBy("code").agg(
        F.sum("n").alias("rows"), *[F.try_divide(F.sum(f"s{x}"), F.sum(f"n{x}")).alias(x) for x in "ab"]
    )
    sizes = totals.join(lookup_side(names), "code").withColumn("size", F.ceil(F.col("rows") / deciles))
    sizes = materialized(sizes, "sizes")
    means = sizes.select("trait", "a", "b")
    low, high = packed_quantiles(chunks, ("a", "b"), (0.25, 0.75))
    iqr = F.lit(None if low is None else high - low).cast("double")
    everyone = F.lit("")

    def gate(df: DataFrame, name: str, value: Column, passed: Column, trait: Column = everyone) -> DataFrame:
        return df.select(
            F.lit(name).alias("gate"), trait.alias("trait"), value.alias("value"), passed.cast("boolean").alias("passed")
        )

    ranked = means.select(
        average_rank("a", [F.lit(0)]).alias("a"), average_rank("b", [F.lit(0)]).alias("b")
    )
    summary = ranked.agg(pearson(F.col("a"), F.col("b")).alias("r"))
    order_a = F.transform(
        F.array_sort(F.collect_list(F.struct(-F.col("a"), "trait"))), lambda s: s["trait"]
    )
    order_b = F.transform(
        F.array_sort(F.collect_list(F.struct(-F.col("b"), "trait"))), lambda s: s["trait"]
    )
    tops = means.agg(
        F.array_sort(F.slice(order_a, 1, top)).alias("a"),
        F.array_sort(F.slice(order_b, 1, top)).alias("b"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("gap"),
    )
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    sums = _rank_sums(chunks, sizes, total)
    by_name = lambda df: df.join(lookup_side(names), "code")
    row_rank = materialized(by_name(_rank_products(sums)), "rank-correlations")
    overlaps = materialized(by_name(_decile_overlaps(both, names, sizes.select("code", "rows", "size"), sums)), "overlaps")

    def overlap(side: str) -> DataFrame:
        return overlaps.select("trait", F.col(side).alias("share"))

    gap, share, r = F.col("gap"), F.col("share"), F.col("r")
    allowed = iqr * F.lit(max_share)
    trait = F.col("trait")
    gates = [
        gate(summary, "trait_mean_spearman", r, r >= min_rank),
        gate(tops, "top_traits_equal", (F.col("a") == F.col("b")).cast("double"), F.col("a") == F.col("b")),
        gate(tops, "max_mean_difference", gap, gap <= allowed),
        gate(tops, "share_of_pooled_iqr", F.try_divide(gap, iqr), F.try_divide(gap, iqr) <= max_share),
        gate(tops, "allowed_mean_difference", allowed, F.lit(None)),
        gate(row_rank, "row_spearman", r, r >= min_rank, trait),
        gate(overlap("top"), "top_decile_overlap", share, share >= min_overlap, trait),
        gate(overlap("bottom"), "bottom_decile_overlap", share, share >= min_overlap, trait),
    ]
    result = gates[0]
    for more in gates[1:]:
        result = result.unionByName(more)
    return result


def engine_agreement(
    first: DataFrame, second: DataFrame, keys: Sequence[str], bound: float = 0.01
) -> DataFrame:
    """Largest per-token mean gap of two engines per model.

    Both inputs are ``(keys.., model, side, tokens, logprob)``. Result
    ``(model, comparisons, max_abs_difference, passed)``.
    """
    on = [*keys, "model", "side"]
    a = first.select(*on, (F.col("logprob") / F.col("tokens")).alias("v"))
    b = second.select(*on, (F.col("logprob") / F.col("tokens")).alias("v"))
    both, names = _paired(a, b, keys, ["model", "side"])
    cells = both.select(F.inline("cells")).join(lookup_side(names), "code")
    gap = F.max(F.abs(F.col("a") - F.col("b")))
    return cells.groupBy("model").agg(
        F.count(F.lit(1)).alias("comparisons"),
        gap.alias("max_abs_difference"),
        (gap <= bound).alias("passed"),
    )
