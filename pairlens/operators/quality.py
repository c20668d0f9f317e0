"""Data-quality checks of score tables.

Every check yields rows ``(dataset, check, detail, n_bad, max_error)``; a healthy
check has ``n_bad = 0``. Nothing stops at the first problem.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.numeric import all_finite
from pairlens.functions.scores import adapter_score
from pairlens.operators.scores import inline_rows
from pairlens.vocabulary import (
    BASE_COLUMNS,
    FORMULAS,
    HASH_COLUMNS,
    LENGTH_COLUMNS,
    RAW_TEXT_NAMES,
    STRING_COLUMNS,
    delta_column,
    score_schema,
    total_columns,
)

CHECK_COLUMNS = ("dataset", "check", "detail", "n_bad", "max_error")
ARROW_TYPES = {"string": "string", "bigint": "int64", "double": "double"}
CHECK_SCHEMA = "dataset string, check string, detail string, n_bad long, max_error double"


def raise_if_bad(checks: DataFrame) -> None:
    """Action: fail with the first few violated checks and how many there are, if there are any."""
    violated = checks.where("n_bad > 0")
    bad = violated.orderBy("dataset", "check", "detail").limit(10).collect()
    if bad:
        listed = "; ".join(f"{r.dataset}: {r.check} {r.detail} ({r.n_bad})" for r in bad)
        raise ValueError(f"data-quality violations: {listed} ({len(bad)} of {violated.count()})")


def schema_checks(footers: DataFrame, adapters: Sequence[str]) -> DataFrame:
    """Closed-schema checks of many files at once from their footers.

    ``footers`` has ``dataset, schema_json``, the latter ``[[name, type, nullable], ..]``.
    """
    wanted = F.array(*[F.lit(n) for n in score_schema(adapters).names])
    raw = F.array(*[F.lit(n) for n in RAW_TEXT_NAMES])
    allowed = F.array(*[F.lit(n) for n in STRING_COLUMNS])
    fields = F.from_json("schema_json", "array<array<string>>")
    names = F.transform(fields, lambda f: F.get(f, 0))
    strings = F.transform(
        F.filter(fields, lambda f: F.get(f, 1) == "string"), lambda f: F.get(f, 0)
    )
    typed = {f.name: ARROW_TYPES[f.dataType.simpleString()] for f in score_schema(adapters)}
    expected = F.create_map(*[F.lit(x) for pair in typed.items() for x in pair])
    mistyped = F.transform(
        F.filter(
            fields, lambda f: F.try_element_at(expected, F.get(f, 0)) != F.get(f, 1)
        ),
        lambda f: F.get(f, 0),
    )
    found = {
        "unreadable_file": F.when(F.col("schema_json").isNull(), F.array(F.lit(""))),
        "column_type": mistyped,
        "raw_text_column": F.array_intersect(names, raw),
        "string_column": F.array_except(strings, allowed),
        "missing_column": F.array_except(wanted, names),
        "unexpected_column": F.array_except(names, wanted),
    }

    def labelled(check: str, columns: Column) -> Column:
        present = F.coalesce(columns, F.array().cast("array<string>"))
        return F.transform(
            present, lambda name: F.struct(F.lit(check).alias("check"), name.alias("detail"))
        )

    listed = F.concat(*[labelled(check, columns) for check, columns in found.items()])
    hits = footers.select("dataset", F.inline(listed))
    return hits.groupBy("dataset", "check", "detail").agg(
        F.count(F.lit(1)).alias("n_bad"), F.lit(None).cast("double").alias("max_error")
    )


def schema_agreement(footers: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Every file must have the schema of the first readable dataset in ``datasets`` order."""
    order = F.array_position(F.array(*[F.lit(d) for d in datasets]), F.col("dataset"))
    readable = footers.where(F.col("schema_json").isNotNull())
    first = readable.select(F.min_by("schema_json", F.struct(order, "path"))).scalar()
    return (
        readable.groupBy("dataset")
        .agg(F.count_if(F.col("schema_json") != first).alias("n_bad"))
        .select(
            "dataset",
            F.lit("schema_differs").alias("check"),
            F.lit("").alias("detail"),
            "n_bad",
            F.lit(None).cast("double").alias("max_error"),
        )
    )


def _roundtrip_error(formula: str, adapter: str) -> str:
    """SQL gap of a stored score to its recomputation; non-finite counts as infinite."""
    gap = f"abs(`{delta_column(formula, adapter)}` - {adapter_score(formula, adapter)})"
    usable = "chosen_response_tokens > 0 AND rejected_response_tokens > 0"
    # NaN sorts above every number and NULL falls to the default, so one
    # comparison separates the usable gaps.
    largest = "CAST('Infinity' AS DOUBLE)"
    return f"CASE WHEN {usable} THEN least(coalesce({gap}, {largest}), {largest}) END"


def row_checks(
    df: DataFrame,
    adapters: Sequence[str],
    revision: str | None = None,
    dataset: str = "dataset_trait",
    expected_dataset: str | None = None,
) -> DataFrame:
    """All row-level checks of every dataset in one aggregation over one scan.

    Runs the checks whose columns are present; absent ones are the business of
    the schema checks. ``expected_dataset`` names the column holding the file's
    own dataset name. Only counts and maxima leave the map side.
    """
    have = set(df.columns)
    bad: dict[tuple[str, str], str] = {}
    if expected_dataset:
        bad["dataset_name", ""] = f"NOT dataset_trait <=> `{expected_dataset}`"
    if revision is not None:
        bad["source_revision", ""] = f"NOT source_revision <=> '{revision}'"
    for name in HASH_COLUMNS:
        bad["hash", name] = f"NOT coalesce({name} rlike r'\\A[0-9a-f]{{64}}\\z', false)"
    for name in LENGTH_COLUMNS:
        bad["length", name] = f"{name} IS NULL OR {name} <= 0"
    totals = [*BASE_COLUMNS, *(n for a in adapters for n in total_columns(a))]
    for name in [*totals, *(delta_column(f, a) for f in FORMULAS for a in adapters)]:
        bad["finite", name] = f"NOT {all_finite([name])}"
    bad = {key: rule for key, rule in bad.items() if not key[1] or key[1] in have}
    errors = {
        delta_column(f, a): _roundtrip_error(f, a)
        for f in FORMULAS
        for a in adapters
        if delta_column(f, a) in have
    }
    counts = [f"count_if({rule}) AS `{'/'.join(key)}`" for key, rule in bad.items()]
    # A pair per error: its maximum, and how often it is above zero.
    gaps = [f"{error} AS `gap/{name}`" for name, error in errors.items()]
    for name in errors:
        counts += [
            f"max(`gap/{name}`) AS `max/{name}`",
            f"count_if(`gap/{name}` > 0) AS `off/{name}`",
        ]
    prepared = df.selectExpr("*", *gaps)
    grouped = prepared.groupBy(F.col(dataset).alias("dataset"))
    wide = grouped.agg(*[F.expr(sql) for sql in counts])
    none = "CAST(NULL AS DOUBLE)"
    rows = [
        {"check": f"'{c}'", "detail": f"'{d}'", "n_bad": f"`{c}/{d}`", "max_error": none}
        for c, d in bad
    ]
    rows += [
        {
            "check": "'roundtrip'",
            "detail": f"'{name}'",
            "n_bad": f"`off/{name}`",
            "max_error": f"`max/{name}`",
        }
        for name in errors
    ]
    return wide.selectExpr("dataset", inline_rows(rows))


def row_counts(
    df: DataFrame, datasets: Sequence[str], dataset: str = "dataset_trait"
) -> DataFrame:
    """Rows per expected dataset; an absent one counts 0 and violates ``not_empty``."""
    names = df.sparkSession.createDataFrame([(d,) for d in datasets], "dataset string")
    counted = df.groupBy(F.col(dataset).alias("dataset")).agg(F.count(F.lit(1)).alias("rows"))
    return names.join(counted, "dataset", "left").select(
        "dataset", F.coalesce("rows", F.lit(0)).alias("rows")
    )


def empty_checks(counts: DataFrame) -> DataFrame:
    return counts.select(
        "dataset",
        F.lit("not_empty").alias("check"),
        F.lit("").alias("detail"),
        (F.col("rows") == 0).cast("bigint").alias("n_bad"),
        F.lit(None).cast("double").alias("max_error"),
    )


def duplicate_ids(
    df: DataFrame, row_id: str = "source_row_id", dataset: str = "dataset_trait"
) -> DataFrame:
    """Offending ids: ``(dataset, row_id, copies)`` with more than one copy.

    Copies are combined before the shuffle, so one id held by a third of all rows
    costs one row per task.
    """
    return (
        df.groupBy(F.col(dataset).alias("dataset"), F.col(row_id).alias("row_id"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def unique_checks(duplicates: DataFrame) -> DataFrame:
    """Surplus copies per dataset: rows minus distinct ids."""
    return duplicates.groupBy("dataset").agg(
        F.lit("unique_row_id").alias("check"),
        F.lit("").alias("detail"),
        F.sum(F.col("copies") - 1).alias("n_bad"),
        F.lit(None).cast("double").alias("max_error"),
    ).select(*CHECK_COLUMNS)


def metadata_checks(entries: DataFrame) -> DataFrame:
    """Footer entries that hide raw text.

    ``entries`` has ``dataset, nested_key, value_json``. A nested key
    ``contains_raw_text`` must be exactly ``false``; any other key must not be a
    raw-text name, start with ``raw_`` or end with ``_text``.
    """
    key = F.lower("nested_key")
    hides = F.when(key == "contains_raw_text", F.col("value_json") != "false").otherwise(
        key.isin(list(RAW_TEXT_NAMES)) | key.startswith("raw_") | key.endswith("_text")
    )
    return entries.groupBy("dataset").agg(
        F.lit("hidden_raw_text").alias("check"),
        F.lit("").alias("detail"),
        F.count_if(F.col("nested_key").isNotNull() & hides).alias("n_bad"),
        F.lit(None).cast("double").alias("max_error"),
    ).select(*CHECK_COLUMNS)


def manifest_checks(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Manifest against observed ``(dataset, rows, size_bytes, sha256)`` facts."""
    seen = observed.select(
        "dataset",
        F.col("rows").alias("__rows"),
        F.col("size_bytes").alias("__size"),
        F.col("sha256").alias("__sha"),
        F.lit(True).alias("__present"),
    )
    joined = manifest.withColumn("__listed", F.lit(True)).join(seen, "dataset", "full_outer")
    both = F.col("__listed").isNotNull() & F.col("__present").isNotNull()

    def differs(left: str, right: str) -> Column:
        return both & ~F.col(left).eqNullSafe(F.col(right))

    error = F.col("formula_round_trip_max_abs_error")
    listed = F.col("__listed").isNotNull()
    flags = {
        "manifest_raw_text": listed & ~F.col("contains_raw_text").eqNullSafe(F.lit(False)),
        "manifest_error": listed & ~error.eqNullSafe(F.lit(0.0)),
        "file_missing": F.col("__present").isNull(),
        "file_unlisted": F.col("__listed").isNull(),
        "size": differs("size_bytes", "__size"),
        "sha256": differs("sha256", "__sha"),
        "rows": differs("rows", "__rows"),
    }
    rows = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit("").alias("detail"),
            flag.cast("bigint").alias("n_bad"),
            F.lit(None).cast("double").alias("max_error"),
        )
        for check, flag in flags.items()
    ]
    return joined.select("dataset", F.inline(F.array(*rows)))


def dataset_report(checks: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per dataset: ``passed``, failed checks, largest round-trip error, facts.

    ``facts`` has ``dataset, rows`` and may have ``size_bytes``.
    """
    name = F.when(F.col("detail") == "", F.col("check")).otherwise(
        F.concat_ws(":", "check", "detail")
    )
    summary = checks.groupBy("dataset").agg(
        F.count_if(F.col("n_bad") > 0).alias("failed_checks"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(F.col("n_bad") > 0, name))), ","
        ).alias("errors"),
        F.max("max_error").alias("max_error"),
    )
    report = facts.join(summary, "dataset", "left")
    return report.select(
        *facts.columns,
        (F.coalesce("failed_checks", F.lit(0)) == 0).alias("passed"),
        F.coalesce("failed_checks", F.lit(0)).alias("failed_checks"),
        F.coalesce("errors", F.lit("")).alias("errors"),
        "max_error",
    )


def bundle_totals(
    report: DataFrame, checks: DataFrame | None = None, findings: DataFrame | None = None
) -> DataFrame:
    """Totals over the datasets that passed.

    ``checks`` add ``schema_identical``; ``findings`` of a text scan are counted and
    each fails the bundle.
    """
    passed = F.col("passed")
    columns = [
        F.every(passed).alias("passed"),
        F.count_if(passed).alias("datasets_validated"),
        F.coalesce(F.sum(F.when(passed, F.col("rows"))), F.lit(0)).alias("total_rows"),
        F.coalesce(F.max(F.when(passed, F.col("max_error"))), F.lit(0.0)).alias("max_error"),
    ]
    if "size_bytes" in report.columns:
        total = F.coalesce(F.sum(F.when(passed, F.col("size_bytes"))), F.lit(0))
        columns.append(total.alias("total_bytes"))
    totals = report.agg(*columns)
    if checks is not None:
        differs = (F.col("check") == "schema_differs") & (F.col("n_bad") > 0)
        totals = totals.withColumn("schema_identical", checks.select(F.count_if(differs) == 0).scalar())
    if findings is not None:
        totals = totals.withColumn("text_findings", findings.select(F.count(F.lit(1))).scalar())
        totals = totals.withColumn("passed", F.col("passed") & (F.col("text_findings") == 0))
    return totals
