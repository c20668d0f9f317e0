"""Readers for score tables, pair files, manifests and matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.sources.files import file_facts, list_files
from pairlens.vocabulary import score_schema

MANIFEST_FIELDS = {
    "rows": "BIGINT",
    "size_bytes": "BIGINT",
    "sha256": "STRING",
    "contains_raw_text": "BOOLEAN",
    "formula_round_trip_max_abs_error": "DOUBLE",
}


# A dataset is a file or folder ``<name>.parquet``, or a partition folder.
DATASET_PATH = r"\A(.*?/(?:file_dataset=([^/]+)|([^/]+)\.parquet))(?:/|\z)"


def dataset_of(path: Column) -> Column:
    """Dataset name of a score file from its path."""
    partition = F.regexp_extract(path, DATASET_PATH, 2)
    return F.when(partition != "", partition).otherwise(F.regexp_extract(path, DATASET_PATH, 3))


def score_files(spark: SparkSession, path: str, folder: str = "logprobs") -> DataFrame:
    """``(path, length, dataset, root)`` of a bundle's Parquet files.

    Files below a child ``logprobs`` folder win over those beside it. ``root`` is
    the dataset's own file or folder.
    """
    files = list_files(spark, path, "*.parquet").withColumns(
        {
            "dataset": dataset_of(F.col("path")),
            "root": F.regexp_extract("path", DATASET_PATH, 1),
        }
    )
    inside = F.col("path").contains(f"/{folder}/")
    found = files.where(inside).select(F.count(F.lit(1)) > 0).scalar()
    return files.where(inside | ~found)


def read_score_files(files: DataFrame, adapters: Sequence[str]) -> DataFrame:
    """Score rows of listed files, with the file's dataset name in ``file_dataset``.

    Only the dataset roots reach the driver: one name per dataset.
    """
    roots = [r.root for r in files.select("root").distinct().collect()]
    reader = files.sparkSession.read.schema(score_schema(adapters))
    table = reader.option("recursiveFileLookup", "true").parquet(*roots)
    return table.withColumn("file_dataset", dataset_of(F.col("_metadata.file_path")))


def vocabulary_difference(found: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Names missing from or unexpected in ``column``: ``(name, problem)``."""
    spark = found.sparkSession
    names = spark.createDataFrame([(n,) for n in expected], "name string")
    seen = found.select(F.col(column).alias("name")).distinct()
    missing = names.join(seen, "name", "left_anti").withColumn("problem", F.lit("missing"))
    extra = seen.join(names, "name", "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.union(extra)


def require_vocabulary(found: DataFrame, column: str, expected: Sequence[str], what: str) -> None:
    """Fail unless the distinct names equal the vocabulary; reads at most a few names."""
    difference = vocabulary_difference(found, column, expected)
    bad = difference.limit(20).collect()
    if bad:
        listed = ", ".join(sorted(f"{r.problem} {r.name!r}" for r in bad))
        raise ValueError(f"{what}: {listed} ({len(bad)} of {difference.count()} differences)")


def read_scores(
    spark: SparkSession, path: str, datasets: Sequence[str], adapters: Sequence[str]
) -> DataFrame:
    """Score table of a bundle with the file's own dataset name in ``file_dataset``.

    The set of files must equal ``datasets`` exactly. Columns are pruned at the
    scan, so a query reads only the totals it needs.
    """
    files = score_files(spark, path)
    require_vocabulary(files, "dataset", datasets, "score files")
    return read_score_files(files, adapters)


def _typed_messages(value: Column) -> Column:
    """Message array of a variant; a role or content that is no string becomes NULL."""

    def text(message: Column, field: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(message, f"$.{field}", "variant"))
        return F.when(kind == "STRING", F.try_variant_get(message, f"$.{field}", "string"))

    return F.transform(
        value,
        lambda m: F.struct(text(m, "role").alias("role"), text(m, "content").alias("content")),
    )


def parse_pairs(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to ``(row_id, chosen, rejected, parse_reason)``; blank lines are skipped.

    A row without ``row_id`` gets the hash of its line: stable under any split
    of the file, unlike a running number.
    """
    rows = lines.where(~F.col(value).rlike(r"\A\s*\z")).select(
        F.col(value).alias("__line"), F.try_parse_json(F.col(value)).alias("__v")
    )
    kind = F.schema_of_variant("__v")
    reason = F.when(F.col("__v").isNull(), "not_json").when(
        ~kind.startswith("OBJECT"), "not_object"
    )
    given = F.try_variant_get("__v", "$.row_id", "string")
    return rows.select(
        F.coalesce(given, F.sha2(F.col("__line"), 256)).alias("row_id"),
        *[
            _typed_messages(F.try_variant_get("__v", f"$.{side}", "array<variant>")).alias(side)
            for side in ("chosen", "rejected")
        ],
        reason.alias("parse_reason"),
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Preference pairs of a JSONL file or folder; an input without rows is an error."""
    pairs = parse_pairs(spark.read.text(path))
    if pairs.isEmpty():
        raise ValueError("found no line to read pairs from")
    return pairs


def read_manifest(spark: SparkSession, path: str, datasets: Sequence[str]) -> DataFrame:
    """Manifest rows keyed by ``dataset`` from a JSON list or a ``datasets`` map."""
    fields = ", ".join(f"{name}: {kind}" for name, kind in MANIFEST_FIELDS.items())
    entry, listed = f"STRUCT<{fields}>", f"STRUCT<trait: STRING, {fields}>"
    whole = spark.read.text(path, wholetext=True)
    is_list = F.ltrim("value").startswith("[")
    from_list = F.from_json("value", f"ARRAY<{listed}>")
    mapping = F.from_json("value", f"STRUCT<datasets: MAP<STRING, {entry}>>")["datasets"]
    from_map = F.transform(
        F.map_entries(mapping),
        lambda e: F.struct(
            e["key"].alias("trait"), *[e["value"][name].alias(name) for name in MANIFEST_FIELDS]
        ),
    )
    entries = F.when(is_list, from_list).otherwise(from_map)
    checked = F.coalesce(
        entries,
        F.raise_error(F.lit("write the manifest as an array of entries, or as an object with one under 'datasets'")).cast(
            f"ARRAY<{listed}>"
        ),
    )
    manifest = whole.select(F.inline(checked)).withColumnRenamed("trait", "dataset")
    require_vocabulary(manifest, "dataset", datasets, "manifest")
    return manifest


def read_matrix(
    spark: SparkSession,
    path: str,
    axis: Sequence[str],
    label: str = "evaluation_trait",
    value: str = "e",
    sentinels: Mapping[tuple[str, str], float] | None = None,
    sha256: str | None = None,
) -> DataFrame:
    """A CSV matrix as cells ``(c, t, <value>)``.

    The first header must be ``label``, rows and columns must equal ``axis``.
    ``sentinels`` pins single cells, which catches a transposed file; ``sha256``
    pins the file.
    """
    if sha256 is not None:
        pinned = file_facts(list_files(spark, path)).where(F.col("sha256") != sha256)
        if not pinned.isEmpty():
            raise ValueError("matrix SHA-256 does not match the pinned one")
    wide = spark.read.option("header", "true").csv(path)
    if wide.columns[0] != label:
        raise ValueError(f"matrix must start with {label}")
    if set(wide.columns[1:]) != set(axis):
        raise ValueError("matrix columns must equal the axis")
    require_vocabulary(wide, label, axis, "matrix rows")
    numbers = [F.col(t).cast("double").alias(t) for t in axis]
    cells = wide.select(F.col(label).alias("c"), *numbers).unpivot("c", list(axis), "t", value)
    for (c, t), expected in (sentinels or {}).items():
        hit = cells.where((F.col("c") == c) & (F.col("t") == t))
        if hit.where(F.abs(F.col(value) - expected) <= 1e-12).isEmpty():
            raise ValueError(f"orientation sentinel [{c},{t}] is wrong")
    return cells
