"""Score derivation, prompt-group statistics and the adapter x dataset cube.

Aggregation stays wide (one column per formula and adapter) until the data is
down to one row per dataset; only then is it unpivoted. That keeps the big scan
at one row per pair and the prompt-group shuffle at one row per group and task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from pairlens.functions.numeric import all_finite, order_free_sum, zero_if_finite
from pairlens.functions.scores import adapter_score
from pairlens.vocabulary import (
    BASE_COLUMNS,
    FORMULAS,
    WEIGHTINGS,
    delta_column,
    require_known,
    total_columns,
)

BAD_LENGTH = "count at least one token in every chosen and rejected response"
BAD_TOTAL = "a base or adapter total is missing, NaN or infinite"
RESPONSE_LENGTHS = ("chosen_response_tokens", "rejected_response_tokens")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"add these columns to the table: {missing}")


def scoring_columns(adapters: Sequence[str]) -> list[str]:
    totals = [name for adapter in adapters for name in total_columns(adapter)]
    return [*RESPONSE_LENGTHS, *BASE_COLUMNS, *totals]


def _total_names(adapters: Sequence[str]) -> list[str]:
    return scoring_columns(adapters)[len(RESPONSE_LENGTHS) :]


SHORTEST = "least({})".format(", ".join(f"coalesce({n}, 0)" for n in RESPONSE_LENGTHS))


def _input_error(adapters: Sequence[str]) -> Column:
    """Message for a row the formulas must refuse, NULL for a usable row."""
    return F.expr(
        f"CASE WHEN {SHORTEST} <= 0 THEN '{BAD_LENGTH}' "
        f"WHEN NOT {all_finite(_total_names(adapters))} THEN '{BAD_TOTAL}' END"
    )


def with_scores(
    df: DataFrame,
    adapters: Sequence[str],
    formulas: Sequence[str] = FORMULAS,
    on_invalid: str = "raise",
) -> DataFrame:
    """Add ``delta_<formula>_<adapter>`` columns.

    A row with a non-positive length or non-finite total fails the query, or
    gets NULL scores with ``on_invalid="null"``.
    """
    require_known("on_invalid", on_invalid, ("raise", "null"))
    require_columns(df, scoring_columns(adapters))
    error = _input_error(adapters)
    scores = {
        delta_column(formula, adapter): adapter_score(formula, adapter)
        for formula in formulas
        for adapter in adapters
    }
    kept = [f"`{name}`" for name in df.columns if name not in scores]
    if on_invalid == "raise":
        # The check sits on a column that every formula reads, so it runs once per
        # row. As a filter it would feed constraint inference over all aliases.
        refused = F.raise_error(error).cast("double")
        accepted = F.when(error.isNull(), F.col("base_chosen_logprob")).otherwise(refused)
        checked = df.withColumn("base_chosen_logprob", accepted)
        columns = [f"{score} AS `{name}`" for name, score in scores.items()]
    else:
        checked = df.withColumn("__error", error)
        columns = [
            f"CASE WHEN __error IS NULL THEN {score} END AS `{name}`"
            for name, score in scores.items()
        ]
    return checked.selectExpr(*kept, *columns)


def inline_rows(rows: Sequence[Mapping[str, str]]) -> str:
    """SQL text of a generator giving one output row per mapping of name to SQL text."""
    structs = [
        "named_struct({})".format(", ".join(f"'{name}', {sql}" for name, sql in row.items()))
        for row in rows
    ]
    return "inline(array({}))".format(", ".join(structs))


def scores_long(
    df: DataFrame,
    adapters: Sequence[str],
    keys: Sequence[str],
    formulas: Sequence[str] = FORMULAS,
) -> DataFrame:
    """One row per (key, formula, adapter) with its score."""
    cells = [
        {
            "formula": f"'{formula}'",
            "adapter": f"'{adapter}'",
            "score": f"`{delta_column(formula, adapter)}`",
        }
        for formula in formulas
        for adapter in adapters
    ]
    wide = with_scores(df, adapters, formulas)
    return wide.selectExpr(*[f"`{key}`" for key in keys], inline_rows(cells))


def scores_wide(
    totals: DataFrame, adapters: Sequence[str], keys: Sequence[str], base: str = "base"
) -> DataFrame:
    """Long ``(keys, model, side, tokens, logprob)`` to the wide score table.

    Base and adapter totals meet by key and side instead of by position, in one
    aggregation; a total that is missing or doubled fails the query.
    """

    def cell(model: str, side: str, name: str) -> Column:
        picked = F.when((F.col("model") == model) & (F.col("side") == side), F.col("logprob"))
        return F.when(F.count(picked) == 1, F.max(picked)).otherwise(
            F.raise_error(F.lit(f"{name}: expected exactly one total per row")).cast("double")
        ).alias(name)

    aggregates = [
        F.max(F.when(F.col("side") == side, F.col("tokens"))).alias(f"{side}_response_tokens")
        for side in ("chosen", "rejected")
    ]
    for model, names in [(base, BASE_COLUMNS), *((a, total_columns(a)) for a in adapters)]:
        aggregates += [cell(model, side, n) for side, n in zip(("chosen", "rejected"), names)]
    return with_scores(totals.groupBy(*keys).agg(*aggregates), adapters)


def _sum_column(formula: str, adapter: str) -> str:
    return f"sum_{formula}_{adapter}"


def group_stats(
    df: DataFrame, adapters: Sequence[str], formulas: Sequence[str] = FORMULAS
) -> DataFrame:
    """Score sums and row counts per (dataset, prompt).

    Input checks ride on the aggregate: one sum of zeros goes non-finite when any
    total was NULL, NaN or infinite, and the smallest length tells whether any was
    non-positive.
    """
    require_columns(df, ["dataset_trait", "prompt_hash", *scoring_columns(adapters)])
    names = [_sum_column(f, a) for f in formulas for a in adapters]
    sums = [
        F.expr(f"sum({adapter_score(f, a)}) AS `{_sum_column(f, a)}`")
        for f in formulas
        for a in adapters
    ]
    zero = zero_if_finite(_total_names(adapters))
    grouped = df.groupBy("dataset_trait", "prompt_hash").agg(
        F.expr("count(*) AS n"),
        F.expr(f"min({SHORTEST}) AS __shortest"),
        F.expr(f"sum(coalesce({zero}, CAST('NaN' AS DOUBLE))) AS __zero"),
        *sums,
    )
    checked = (
        f"CASE WHEN __shortest <= 0 THEN CAST(raise_error('{BAD_LENGTH}') AS BIGINT) "
        f"WHEN NOT {all_finite(['__zero'])} THEN CAST(raise_error('{BAD_TOTAL}') AS BIGINT) "
        "ELSE n END AS n"
    )
    return grouped.selectExpr(
        "dataset_trait", "prompt_hash", checked, *[f"`{name}`" for name in names]
    )


def mean_expressions(
    adapters: Sequence[str],
    formulas: Sequence[str] = FORMULAS,
    weightings: Sequence[str] = WEIGHTINGS,
    weight: str = "1",
) -> dict[tuple[str, str, str], str]:
    """SQL aggregates over group statistics, optionally with a resampling weight.

    ``row`` weighs every row alike, ``prompt`` every prompt group alike.
    """
    means = {}
    for formula in formulas:
        for adapter in adapters:
            total = f"`{_sum_column(formula, adapter)}`"
            for weighting in weightings:
                require_known("weighting", weighting, WEIGHTINGS)
                if weighting == "row":
                    mean = f"sum({weight} * {total}) / sum({weight} * n)"
                else:
                    mean = f"{order_free_sum(weight, f'({total} / n)')} / sum({weight})"
                means[formula, weighting, adapter] = mean
    return means


def mean_cells(
    grouped: GroupedData, keys: Sequence[str], means: Mapping[tuple[str, str, str], str]
) -> DataFrame:
    """Evaluate mean aggregates wide, then unpivot the few result rows to cells."""
    wide = grouped.agg(*[F.expr(f"{sql} AS `{'/'.join(cell)}`") for cell, sql in means.items()])
    rows = [
        {
            "formula": f"'{cell[0]}'",
            "weighting": f"'{cell[1]}'",
            "c": f"'{cell[2]}'",
            "value": f"`{'/'.join(cell)}`",
        }
        for cell in means
    ]
    return wide.selectExpr(*keys, inline_rows(rows))


def score_cube(
    stats: DataFrame,
    adapters: Sequence[str],
    formulas: Sequence[str] = FORMULAS,
    weightings: Sequence[str] = WEIGHTINGS,
) -> DataFrame:
    """Mean scores as cells ``(formula, weighting, c, t, value)``.

    ``c`` is the adapter and ``t`` the dataset. Both weightings come from the
    same pass over the group statistics.
    """
    means = mean_expressions(adapters, formulas, weightings)
    grouped = stats.groupBy(F.col("dataset_trait").alias("t"))
    return mean_cells(grouped, ["t"], means).select("formula", "weighting", "c", "t", "value")


def aggregate_scores(
    df: DataFrame, adapters: Sequence[str], weighting: str, formulas: Sequence[str] = FORMULAS
) -> DataFrame:
    """Score cube of one weighting.

    Row weighting needs no prompt groups, so it skips the prompt shuffle.
    """
    require_known("weighting", weighting, WEIGHTINGS)
    if weighting == "row":
        stats = group_stats(df.withColumn("prompt_hash", F.lit("")), adapters, formulas)
    else:
        stats = group_stats(df, adapters, formulas)
    return score_cube(stats, adapters, formulas, [weighting])

