"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space at both ends with A-Z
lower-cased; keys are held as 128-bit hashes. ``LineRuns`` keeps what earlier batches held
as sorted runs of (key, n_docs). A batch is merge-anti-joined with the runs to
find its unseen lines, and adds one run of its own. When a level has ``fanout``
runs they are merged into one run of the next level, so a key lies in few runs
and each is rewritten a logarithmic number of times. The keys that reach
``min_docs`` documents over all runs lose all their lines.

Cases: null or empty text is one empty line and is returned unchanged in content;
empty keys are never dropped; each row is a document, also where doc_id repeats
or is null; extra columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import (
    ASCII_LOWER,
    SPACES,
    empty_safe,
    fresh_name,
    materialized,
    scratch_path,
    texts_of,
    with_columns,
)

KEYS = "batch int, id long, key binary"


def key_hash(line: bytes) -> bytes | None:
    """The 128-bit hash of a line's key, or None for an empty key."""
    key = line.strip(SPACES).translate(ASCII_LOWER)
    return hashlib.blake2b(key, digest_size=16).digest() if key else None


def _distinct_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        which, ids, keys = [], [], []
        for number, doc, text in zip(batch["batch"].to_pylist(), batch["id"].to_pylist(), texts_of(batch["text"]), strict=True):
            found = {key_hash(line) for line in text.split(b"\n")} - {None}
            which += [number] * len(found)
            ids += [doc] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int32()), pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["batch", "id", "key"]
        )


def line_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batches: int = 1) -> DataFrame:
    """One row (batch, id, key) per document and distinct line key; documents are dealt to batches by id and text."""
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(batches)).cast("int").alias("batch"),
        F.col(doc_id).cast("long").alias("id"),
        empty_safe(F.col(text)).alias("text"),
    )
    return rows.mapInArrow(_distinct_keys, KEYS)


class LineRuns:
    """Levelled sorted runs of (key, n_docs), each a written table below the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark = spark
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]

    def _write(self, counts: DataFrame) -> DataFrame:
        """A run: every key once, in one partition by its hash, sorted there."""
        path = scratch_path(self.spark, "line-run")
        counts.sortWithinPartitions("key").write.parquet(path)
        return self.spark.read.schema("key binary, n_docs long").parquet(path)

    def add(self, keys: DataFrame) -> None:
        """Add a batch's keys (one row per document and key) as a run; compact the levels that are full."""
        self.levels[0].append(self._write(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._write(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        return union.groupBy("key").agg(F.sum("n_docs").alias("n_docs"))

    def totals(self) -> DataFrame:
        """(key, n_docs) over all batches added so far."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], "key binary, n_docs long")
        return runs[0] if len(runs) == 1 else self._merged(runs)

    def frequent(self, min_docs: int) -> DataFrame:
        return self.totals().where(F.col("n_docs") >= min_docs).select("key")

    def unseen(self, keys: DataFrame, min_docs: int = 1) -> DataFrame:
        """The rows of a new batch whose key fewer than ``min_docs`` earlier documents held."""
        return keys.join(self.frequent(min_docs), "key", "left_anti")


def _rebuild(names: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, losses = [], [], []
            for text, dropped in zip(texts_of(batch[names["text"]]), batch[names["dropped"]].to_pylist(), strict=True):
                lines = text.split(b"\n")
                if dropped:
                    gone = set(dropped)
                    kept = [line for line in lines if key_hash(line) not in gone]
                else:
                    kept = lines
                texts.append(b"\n".join(kept))
                totals.append(len(lines))
                losses.append(len(lines) - len(kept))
            out = with_columns(
                batch,
                {
                    names["text"]: pa.array(texts, pa.binary()).cast(pa.string()),
                    names["n_lines"]: pa.array(totals, pa.int64()),
                    names["n_dropped"]: pa.array(losses, pa.int64()),
                },
            )
            yield out.drop_columns([names["dropped"]])

    return run


def drop_frequent_lines(
    docs: DataFrame,
    min_docs: int = 10,
    batches: int = 4,
    fanout: int = 4,
    text: str = "text",
    doc_id: str = "doc_id",
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
) -> DataFrame:
    """``docs`` without the lines whose key at least ``min_docs`` documents hold, plus both counts."""
    spark = docs.sparkSession
    keys = materialized(line_keys(docs, text, doc_id, batches), "line-keys")
    runs = LineRuns(spark, fanout)
    for number in range(batches):
        runs.add(keys.where(F.col("batch") == number))
    gone, other = fresh_name(docs, "dropped_keys"), fresh_name(docs, "dropped_id")
    dropped = (
        keys.join(runs.frequent(min_docs), "key", "left_semi")
        .groupBy(F.col("id").alias(other))
        .agg(F.collect_set("key").alias(gone))
    )
    joined = docs.withColumn(text, empty_safe(F.col(text))).join(
        dropped, F.col(doc_id).cast("long").eqNullSafe(F.col(other)), "left"
    ).drop(other)
    schema = T.StructType([f for f in joined.schema.fields if f.name not in (gone, n_lines, n_dropped)])
    schema = schema.add(n_lines, "long").add(n_dropped, "long")
    names = {"text": text, "dropped": gone, "n_lines": n_lines, "n_dropped": n_dropped}
    joined = joined.select(*[c for c in joined.columns if c not in (n_lines, n_dropped)])
    return joined.mapInArrow(_rebuild(names), schema)
