"""Validation of a bundle of score files against its manifest."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators.quality import (
    bundle_totals,
    dataset_report,
    duplicate_ids,
    empty_checks,
    manifest_checks,
    metadata_checks,
    row_checks,
    row_counts,
    schema_agreement,
    schema_checks,
    unique_checks,
)
from pairlens.operators.scan import BINARY_SUFFIXES, PATTERNS, TEXT_SUFFIXES, Pattern, scan_files, scan_text
from pairlens.session import materialized
from pairlens.sources.files import (
    dataset_digests,
    file_facts,
    list_files,
    parquet_footers,
    read_text_files,
)
from pairlens.sources.tables import read_manifest, read_score_files, score_files


class BundleReport(NamedTuple):
    """Checks per dataset, one report row per dataset, the totals row, and findings of the text scan, if asked for."""

    checks: DataFrame
    datasets: DataFrame
    totals: DataFrame
    findings: DataFrame | None = None


def observed_facts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(facts per dataset, footers per file)`` of listed score files.

    A dataset of one file has that file's digest; of several, ``dataset_digests`` combines them.
    """
    names = files.select("path", "dataset")
    footers = materialized(parquet_footers(files).join(names, "path"), "footers")
    digests = dataset_digests(file_facts(files).join(names, "path")).drop("files")
    rows = footers.groupBy("dataset").agg(F.sum("rows").alias("rows"))
    per_dataset = rows.join(digests, "dataset").select("dataset", "rows", "size_bytes", "sha256")
    return materialized(per_dataset, "facts"), footers


def text_findings(
    spark: SparkSession, path: str, patterns: Sequence[Pattern] = PATTERNS
) -> DataFrame:
    """Findings ``(path, line_number, pattern)`` in texts and files below ``path``; those on whole files have no line."""
    texts = read_text_files(spark, path, TEXT_SUFFIXES)
    lines = scan_text(texts, "path", "text", patterns)
    whole = scan_files(list_files(spark, path), suffixes=BINARY_SUFFIXES)
    return lines.unionByName(whole, allowMissingColumns=True)


def validate_bundle(
    spark: SparkSession,
    path: str,
    datasets: Sequence[str],
    adapters: Sequence[str],
    manifest_path: str,
    revision: str | None = None,
    text_root: str | None = None,
) -> BundleReport:
    """Run every check; a manifest that does not cover the vocabulary fails at once.

    With ``text_root`` the texts below it are scanned too, and any finding fails the bundle.

    Datasets whose files cannot be read under the closed schema are reported from
    their footers and left out of the row scan, so they do not hide the others.
    """
    manifest = read_manifest(spark, manifest_path, datasets)
    facts, footers = observed_facts(score_files(spark, path))
    shape = materialized(schema_checks(footers, adapters), "schema-checks")
    unusable = shape.where(F.col("check").isin("unreadable_file", "column_type"))
    # Bounded by the vocabulary: names only, never rows.
    skipped = {r.dataset for r in unusable.select("dataset").distinct().collect()}
    present = {r.dataset for r in facts.select("dataset").collect()}
    usable = [d for d in datasets if d in present - skipped]
    entries = footers.select("dataset", F.inline("entries"))
    observed = facts.where(F.col("dataset").isin(list(datasets)))
    checks = [
        shape,
        schema_agreement(footers, datasets),
        metadata_checks(entries),
        manifest_checks(manifest, observed),
    ]
    if usable:
        listed = score_files(spark, path).where(F.col("dataset").isin(usable))
        table = read_score_files(listed, adapters)
        counts = row_counts(table, usable, "file_dataset")
        checks += [
            row_checks(table, adapters, revision, "file_dataset", "file_dataset"),
            empty_checks(counts),
            unique_checks(duplicate_ids(table, dataset="file_dataset")),
        ]
    union = checks[0]
    for more in checks[1:]:
        union = union.unionByName(more)
    union = materialized(union, "checks")
    names = manifest.select("dataset")
    report = dataset_report(union, names.join(observed, "dataset", "left"))
    findings = None
    if text_root is not None:
        findings = materialized(text_findings(spark, text_root), "findings")
    return BundleReport(union, report, bundle_totals(report, union, findings), findings)
