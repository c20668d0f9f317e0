"""File facts, Parquet footers and text lines as DataFrames.

Paths are listed by Spark; bytes are read inside tasks, so nothing but the
listing touches the driver.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.text import split_lines
from pairlens.session import spread

CHUNK_BYTES = 1 << 20
RANGE_BYTES = 64 << 20
FANOUT = 256


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, length)`` of files below ``path``; contents are not read. Spark passes empty files over."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "length")
    )


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow filesystem and path; Spark writes local URIs with a single slash."""
    return pafs.FileSystem.from_uri(re.sub(r"\Afile:/(?!/)", "file:///", uri))


def file_facts(files: DataFrame) -> DataFrame:
    """Add the SHA-256 of every listed file, streamed in chunks of any file size."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = []
            for uri in frame["path"]:
                filesystem, name = _open(uri)
                state = hashlib.sha256()
                with filesystem.open_input_stream(name) as stream:
                    while chunk := stream.read(CHUNK_BYTES):
                        state.update(chunk)
                values.append(state.hexdigest())
            yield frame.assign(sha256=values)

    return files.select("path", "length").mapInPandas(
        digest, "path string, length long, sha256 string"
    )


def range_digests(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, chunk, sha256)`` of every ``range_bytes`` long range of every listed file.

    Ranges are dealt to tasks one by one, so a large file is read by many; an empty
    file is one empty range.
    """

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = []
            for uri, chunk in zip(frame["path"], frame["chunk"], strict=True):
                filesystem, name = _open(uri)
                state, left = hashlib.sha256(), range_bytes
                with filesystem.open_input_file(name) as stream:
                    stream.seek(chunk * range_bytes)
                    while left and (part := stream.read(min(CHUNK_BYTES, left))):
                        state.update(part)
                        left -= len(part)
                values.append(state.hexdigest())
            yield frame.assign(sha256=values)

    last = F.greatest(F.ceil(F.col("length") / range_bytes) - 1, F.lit(0)).cast("long")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return spread(ranges, "path", "chunk").mapInPandas(digest, "path string, chunk long, sha256 string")


def tree_digests(
    files: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT
) -> DataFrame:
    """``(path, chunks, tree_sha256)``: range digests combined ``fanout`` at a time up to one.

    A node is the SHA-256 of its children's hex digests in order; an only child stands for its
    node, so a file's digest depends on no other file. No array is longer than ``fanout``.
    """
    level = range_digests(files, range_bytes).withColumn("chunks", F.lit(1).cast("long"))
    # One number: the size of the largest file decides how many levels there are.
    left = -(-(files.agg(F.max("length")).first()[0] or 0) // range_bytes)
    while left > 1:
        left = -(-left // fanout)
        children = F.transform(
            F.array_sort(F.collect_list(F.struct("chunk", "sha256"))), lambda x: x["sha256"]
        )
        node = F.when(F.count(F.lit(1)) == 1, F.min("sha256"))
        level = level.groupBy("path", F.floor(F.col("chunk") / fanout).alias("chunk")).agg(
            node.otherwise(F.sha2(F.array_join(children, ""), 256)).alias("sha256"),
            F.sum("chunks").alias("chunks"),
        )
    return level.select("path", "chunks", F.col("sha256").alias("tree_sha256"))


def dataset_digests(facts: DataFrame) -> DataFrame:
    """``(dataset, files, size_bytes, sha256)`` of files ``(dataset, length, sha256)``.

    A dataset of one file has that file's digest. That of several does not depend on
    names or order: distinct digests with their counts are combined by their first six hex
    digits, then by four, two and none, each time the SHA-256 of the sorted parts joined. Equal
    files are one part, so a part list stays short up to some billion files.
    """
    level = facts.groupBy("dataset", "sha256").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("size_bytes")
    )
    level = level.withColumns(
        {"place": F.col("sha256"), "part": F.concat_ws(":", "sha256", "files"), "only": F.col("sha256")}
    )
    for digits in (6, 4, 2, 0):
        parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"])
        level = level.groupBy("dataset", F.substring("place", 1, digits).alias("place")).agg(
            F.sum("files").alias("files"),
            F.sum("size_bytes").alias("size_bytes"),
            F.min("only").alias("only"),
            F.sha2(F.array_join(parts, ","), 256).alias("part"),
        )
    digest = F.when(F.col("files") == 1, F.col("only")).otherwise(F.col("part"))
    return level.select("dataset", "files", "size_bytes", digest.alias("sha256"))


def _keys_with_values(value: Any) -> Iterator[tuple[str, str]]:
    """Every mapping key at any depth with its value as JSON."""
    if isinstance(value, dict):
        for key, nested in value.items():
            yield str(key), json.dumps(nested)
            yield from _keys_with_values(nested)
    elif isinstance(value, list):
        for item in value:
            yield from _keys_with_values(item)


def _footer_entries(metadata: dict[bytes, bytes] | None) -> list[dict[str, str | None]]:
    """Key/values of a footer, JSON ones flattened, others as hex."""
    entries: list[dict[str, str | None]] = []
    for key, raw in (metadata or {}).items():
        try:
            decoded: Any = json.loads(raw.decode("utf-8"))
            text = json.dumps(decoded)
        except (UnicodeDecodeError, json.JSONDecodeError):
            decoded, text = None, raw.hex()
        label = key.decode("utf-8", errors="replace")
        entries += [
            {"key": label, "nested_key": nested, "value_json": value}
            for nested, value in [(None, text), *_keys_with_values(decoded)]
        ]
    return entries


def parquet_footers(files: DataFrame) -> DataFrame:
    """One row per listed Parquet file: ``(path, rows, schema_json, entries, error)``.

    ``schema_json`` is ``[[name, type, nullable], ..]``; ``entries`` holds the
    footer's key/values ``(key, nested_key, value_json)``, which Spark's own
    reader drops. Only footers are read; an unreadable file fills ``error``.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for uri in frame["path"]:
                try:
                    filesystem, name = _open(uri)
                    with filesystem.open_input_file(name) as stream:
                        footer = pq.ParquetFile(stream)
                        schema, rows = footer.schema_arrow, footer.metadata.num_rows
                except pa.ArrowInvalid as problem:
                    out.append((uri, None, None, [], str(problem)))
                    continue
                fields = json.dumps([[f.name, str(f.type), str(f.nullable)] for f in schema])
                out.append((uri, rows, fields, _footer_entries(schema.metadata), None))
            yield pd.DataFrame(out, columns=["path", "rows", "schema_json", "entries", "error"])

    return files.select("path").mapInPandas(
        read,
        "path string, rows long, schema_json string, "
        "entries array<struct<key string, nested_key string, value_json string>>, error string",
    )


def footer_metadata(files: DataFrame) -> DataFrame:
    """Footer key/values as rows ``(path, key, nested_key, value_json)``."""
    return parquet_footers(files).select("path", F.inline("entries"))


def text_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered lines ``(key, line_number, line)`` of whole texts."""
    lines = texts.select(key, F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    return lines.select(key, (F.col("pos") + 1).alias("line_number"), "line")


def read_text_files(
    spark: SparkSession, path: str, suffixes: Sequence[str], names: Sequence[str] = ()
) -> DataFrame:
    """``(path, text)`` of files with an allowed suffix or name; invalid UTF-8 is skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(base, r"[^.](\.[^.]+)\z", 1))
    wanted = suffix.isin(list(suffixes)) | base.isin(list(names))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.where(wanted).select("path", text.alias("text")).where("text IS NOT NULL")
