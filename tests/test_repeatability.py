"""Repeatability on packed values: ranks, quantiles and deciles against brute force, with nothing sorted row by row."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.operators import ordering, radix, selection

ODD = [None, float("nan"), float("inf"), -float("inf"), -0.0, 0.0]


def order(v):
    """Descending, NULL first, NaN last."""
    return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, -v)


def test_order_keys_and_packed_quantiles(spark):
    rng = np.random.default_rng(4)
    values = ODD + [None, 1.5, -1.5, 5e-324, -5e-324, 1e300] + rng.normal(size=40).tolist() + [2.0] * 9
    keys = radix.order_keys(pa.array(values, from_pandas=False))
    assert [order(values[i]) for i in np.argsort(keys, kind="stable")] == sorted(map(order, values))
    known = [v for v in values if v is not None and not math.isnan(v)]
    assert radix.values_of(radix.order_keys(pa.array(known))).tolist() == known
    finite = [v for v in values if v is None or not math.isinf(v)]
    rows = [(radix.order_keys(pa.array(x)).tobytes(), radix.order_keys(pa.array(y)).tobytes()) for x, y in ((finite[:9], finite[9:20]), (finite[20:], [None, 3.0]))]
    chunks = spark.createDataFrame([tuple(map(bytearray, r)) for r in rows], "a binary, b binary")
    every = [v for v in [*finite, 3.0] if v is not None and not math.isnan(v)]
    levels = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    assert radix.packed_quantiles(chunks, ("a", "b"), levels) == pytest.approx(np.quantile(every, levels).tolist(), rel=1e-12)
    assert radix.packed_quantiles(chunks.where("false"), ("a", "b"), (0.5,)) == [None]


def test_packed_places_over_many_ranges(spark, monkeypatch):
    """A key goes to its range once per chunk; places count all values of the code."""
    monkeypatch.setattr(ordering, "RANGE_VALUES", 40)
    rng = np.random.default_rng(5)
    parts = [(k, k % 2, rng.integers(-30, 30, 200) // (1 + k % 3)) for k in range(6)]
    rows = [(k, c, len(v), bytearray(v.astype(np.int64).tobytes()), bytearray(v.astype(np.int64).tobytes())) for k, c, v in parts]
    chunks = spark.createDataFrame(rows, "chunk long, code long, n long, a binary, pick_a binary")
    assert len(ordering.value_bounds(chunks, "pick_a", 1200)[0]) > 5
    found = {r["chunk"]: [p.asDict() for p in r["a_places"]] for r in ordering.packed_places(chunks, "a", "pick_a", 1200).collect()}
    for k, c, v in parts:
        every = np.concatenate([x for _, d, x in parts if d == c])
        less, equal = ordering.unpacked_places(found[k])
        distinct = sorted(set(v.tolist()))
        assert less.tolist() == [(every < x).sum() for x in distinct] and equal.tolist() == [(every == x).sum() for x in distinct]


def runs(n):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        for t in ("p", "q", "r"):
            a = float(rng.integers(0, 12)) if t != "r" else float(rng.normal())
            b = a + float(rng.integers(-1, 2)) if t != "q" else float(rng.integers(0, 4))
            rows.append((f"id{i}", t, a, b))
    for k, v in enumerate(ODD):
        rows[3 * k] = (*rows[3 * k][:2], v, rows[3 * k][3])
        rows[30 + 3 * k] = (*rows[30 + 3 * k][:3], v)
    return rows


def test_gates_equal_brute_force(spark):
    rows = runs(150)
    table = spark.createDataFrame(rows, "row_id string, trait string, a double, b double").repartition(3)
    first, second = (table.select("row_id", "trait", F.col(x).alias("score")) for x in "ab")
    gates = {(r.gate, r.trait): r.value for r in selection.repeatability(first, second).collect()}
    for t in "pqr":
        mine = [r for r in rows if r[1] == t]
        ranks, inside = [], []
        for x in (2, 3):
            place = sorted(order(r[x]) for r in mine)
            ranks.append([place.index(order(r[x])) + (place.count(order(r[x])) + 1) / 2 for r in mine])
            line = sorted(mine, key=lambda r: (order(r[x]), hashlib.md5(f"{r[0]}|{t}".encode()).hexdigest()))  # noqa: B023
            inside.append([{r[0] for r in line[:15]}, {r[0] for r in line[-15:]}])
        assert gates["row_spearman", t] == pytest.approx(np.corrcoef(*ranks)[0, 1], rel=1e-12)
        for k, side in enumerate(("top", "bottom")):
            assert gates[f"{side}_decile_overlap", t] == pytest.approx(len(inside[0][k] & inside[1][k]) / 15)


def test_values_travel_once_a_chunk(spark, monkeypatch):
    """However many rows share a value, its range gets it once per chunk; only rows tied at a cut are looked at again."""
    tables, write = {}, selection.materialized

    def watched(df, label="stage"):
        out = write(df, label)
        tables.setdefault(label, []).append(out)
        return out

    for module in (selection, ordering, radix):
        monkeypatch.setattr(module, "materialized", watched)
    run = spark.range(2000, numPartitions=2).select(F.col("id").cast("string").alias("row_id"), F.explode(F.array(F.lit("p"), F.lit("q"))).alias("trait"), (F.col("id") % 20).cast("double").alias("score"))
    gates = {(r.gate, r.trait): r.value for r in selection.repeatability(run, run).collect()}
    assert gates["row_spearman", "p"] == pytest.approx(1.0) and gates["top_decile_overlap", "q"] == 1.0
    chunks = tables["values"][0].count()
    for ordered in tables["ordered"]:
        assert ordered.count() == chunks and ordered.where("length(less) != 8 * 20").count() == 0
    assert tables["ties"][0].count() == 2 * 200  # a tenth: values 18 (top) and 1 (bottom) of 20


def test_chunks_hold_all_cells(spark):
    cells = spark.range(500, numPartitions=1).select(F.col("id").cast("string").alias("row_id"), F.explode(F.array(F.lit("p"), F.lit("q"))).alias("trait"))
    cells = cells.withColumn("v", F.col("row_id").cast("double"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    both, _ = selection._paired(cells.union(cells.where("row_id < 5")), cells, ["row_id"], ["trait"])
    both = selection.materialized(both.repartition(2), "runs")
    spark.conf.set(size, "40")
    try:
        chunks = selection._value_chunks(both, limit=100)
    finally:
        spark.conf.set(size, before)
    found = chunks.groupBy("code").agg(F.sum("n"), F.sum("na"), F.sum("sa"), F.sum(F.size("ids")), F.sum(F.length("places") / 8)).collect()
    assert [tuple(r)[1:] for r in found] == [(505, 505, 499 * 250 + 10.0, 10, 10.0)] * 2 and chunks.count() > 4
