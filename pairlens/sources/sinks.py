"""Writers. Files go through Spark's output committer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.numeric import general_format
from pairlens.vocabulary import IDENTITY_COLUMNS, RAW_TEXT_NAMES

#: Open files of a task that writes a folder per dataset, and the bytes each may hold back.
WRITERS = 32
ROW_GROUP = 16 << 20
CONCURRENT = "spark.sql.maxConcurrentOutputFileWriters"


def matrix_wide(
    cells: DataFrame,
    axis: Sequence[str],
    value: str = "value",
    by: Sequence[str] = (),
    label: str = "adapter_trait",
) -> DataFrame:
    """Cells to a matrix with one row per adapter and one column per dataset."""
    return (
        cells.groupBy(*by, F.col("c").alias(label)).pivot("t", list(axis)).agg(F.first(value))
    )


def write_matrix(
    cells: DataFrame,
    path: str,
    axis: Sequence[str],
    value: str = "value",
    by: Sequence[str] = (),
    label: str = "adapter_trait",
) -> None:
    """CSV matrices with 12 significant digits, one folder per ``by`` value.

    Rows are ordered along the axis; a matrix is K rows, so each is one file.
    """
    wide = matrix_wide(cells, axis, value, by, label)
    order = F.array_position(F.array(*[F.lit(name) for name in axis]), F.col(label))
    formatted = wide.select(*by, label, *[general_format(F.col(t)).alias(t) for t in axis])
    ordered = formatted.withColumn("__order", order)
    if by:
        ordered = ordered.repartition(*by).sortWithinPartitions(*by, "__order").drop("__order")
        ordered.write.partitionBy(*by).option("header", "true").csv(path)
    else:
        ordered = ordered.coalesce(1).sortWithinPartitions("__order").drop("__order")
        ordered.write.option("header", "true").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """Small result tables as JSON lines with keys in alphabetical order."""
    report.select(*sorted(report.columns)).coalesce(1).write.json(path)


def write_scores(
    scores: DataFrame, path: str, dataset: str | None = "dataset_trait", format: str = "parquet"
) -> None:
    """Text-free score rows, one ``file_dataset=<name>`` folder per dataset.

    The dataset column stays in the rows too, so readers can check it against
    the folder. Only hashes, lengths, totals and scores may pass: any raw-text name or
    further string column is refused.

    A task keeps one file open per dataset instead of sorting its wide rows by dataset, which
    spills; beyond ``WRITERS`` datasets Spark sorts the rest.
    """
    raw = sorted(set(scores.columns) & set(RAW_TEXT_NAMES))
    if raw:
        raise ValueError(f"refusing to write raw-text columns: {raw}")
    allowed = {*IDENTITY_COLUMNS, "row_id", "adapter", "formula", dataset}
    strings = sorted(n for n, kind in scores.dtypes if kind == "string" and n not in allowed)
    if strings:
        raise ValueError(f"refusing to write string columns: {strings}")
    if dataset is None:
        scores.write.format(format).save(path)
        return
    foldered = scores.withColumn("file_dataset", F.col(dataset))
    writer = foldered.write.partitionBy("file_dataset").option("parquet.block.size", ROW_GROUP)
    conf = scores.sparkSession.conf
    before = conf.get(CONCURRENT, None)
    conf.set(CONCURRENT, str(WRITERS))
    try:
        writer.format(format).save(path)
    finally:
        if before is None:
            conf.unset(CONCURRENT)
        else:
            conf.set(CONCURRENT, before)
