"""The headline study: associations, ranks, bootstrap interval, permutation p-values, and the gates on them."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators.associate import (
    column_association,
    off_diagonal_association,
    predicted_rank,
)
from pairlens.operators.calibrate import calibrate
from pairlens.operators.checks import check_sentinels, check_targets
from pairlens.operators.resample import bootstrap_interval, permutation_test
from pairlens.operators.scores import group_stats, score_cube
from pairlens.plans.summarize import FAMILY_KEYS, summarize
from pairlens.session import materialized
from pairlens.sources.sinks import write_report

FULL_REPLICATES, FULL_DRAWS = 1000, 100_000
RESAMPLED = (
    "bootstrap_low",
    "bootstrap_high",
    "permutation_one_sided_p",
    "permutation_two_sided_p",
)


def _metric(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    column = F.col(value) if isinstance(value, str) else value
    return df.select(F.lit(name).alias("metric"), column.cast("double").alias("value"))


def study(
    scores: DataFrame,
    target: DataFrame,
    axis: Sequence[str],
    column: str,
    named: str,
    replicates: int = 1000,
    draws: int = 100_000,
    seed: int = 42,
    bootstrap: str = "multinomial",
) -> DataFrame:
    """All metrics as ``(metric, value)``.

    ``column`` is the dataset looked at alone and ``named`` the adapter whose rank
    in it is reported. Group statistics and cube are written once; every metric
    and the resampling read those, not the score rows.
    """
    stats = materialized(group_stats(scores, axis), "group-stats")
    cube = materialized(score_cube(stats, axis), "cube")
    pinned = materialized(target.select("c", "t", "e"), "target")
    raw = cube.where("weighting = 'row'")
    primary = materialized(
        calibrate(raw.where("formula = 'sum'")).select("c", "t", F.col("z").alias("value")),
        "primary",
    )
    metrics = []
    for method in ("pearson", "spearman"):
        whole = off_diagonal_association(primary, pinned, axis, method=method)
        metrics.append(_metric(whole, f"combined_{method}", "r"))
        single = column_association(primary, pinned, axis, method=method)
        metrics.append(_metric(single.where(F.col("t") == column), f"column_{method}", "r"))
    for formula, method in (("separate", "spearman"), ("sum", "pearson")):
        cells = raw.where(F.col("formula") == formula).select("c", "t", "value")
        single = column_association(cells, pinned, axis, method=method)
        name = f"column_raw_{formula}_{method}"
        metrics.append(_metric(single.where(F.col("t") == column), name, "r"))
    wanted = (F.col("t") == column) & (F.col("c") == named)
    ranks = predicted_rank(primary).where(wanted)
    metrics.append(_metric(ranks, "column_rank", "predicted_rank"))
    separate = raw.where("formula = 'separate'").select("c", "t", "value")
    metrics.append(
        _metric(predicted_rank(separate).where(wanted), "column_raw_rank", "predicted_rank")
    )
    in_column = stats.where(F.col("dataset_trait") == column)
    metrics.append(_metric(in_column.agg(F.sum("n").alias("v")), "column_rows", "v"))
    metrics.append(
        _metric(in_column.agg(F.count(F.lit(1)).alias("v")), "column_prompt_groups", "v")
    )
    spread = materialized(
        bootstrap_interval(stats, axis, pinned, replicates, seed, bootstrap), "interval"
    )
    metrics.append(_metric(spread, "bootstrap_low", "low"))
    metrics.append(_metric(spread, "bootstrap_high", "high"))
    tested = materialized(permutation_test(primary, pinned, axis, draws, seed), "permutation")
    metrics.append(_metric(tested, "permutation_one_sided_p", "p_one_sided"))
    metrics.append(_metric(tested, "permutation_two_sided_p", "p_two_sided"))
    result = metrics[0]
    for more in metrics[1:]:
        result = result.unionByName(more)
    return result


class Reproduction(NamedTuple):
    """Metrics, one row per gate, and the summary row."""

    metrics: DataFrame
    gates: DataFrame
    summary: DataFrame


def matrix_gates(family: DataFrame, expected: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Cells of each expected matrix that are absent, unexpected or off: ``(name, value, passed)``.

    Both inputs are matrix families; values are compared, not their text. A matrix that
    is not expected has no gate.
    """
    keys = [*FAMILY_KEYS, "c", "t"]
    left = expected.select(*keys, F.col("value").alias("__wanted"))
    both = left.join(family.select(*keys, "value"), keys, "full_outer")
    close = F.coalesce(F.abs(F.col("value") - F.col("__wanted")) <= tolerance, F.lit(False))
    per_matrix = both.groupBy(*FAMILY_KEYS).agg(
        F.count("__wanted").alias("wanted"), F.count_if(~close).alias("off")
    )
    return per_matrix.where("wanted > 0").select(
        F.concat_ws("/", *FAMILY_KEYS).alias("name"),
        F.col("off").cast("double").alias("value"),
        (F.col("off") == 0).alias("passed"),
    )


def rank_gates(metrics: DataFrame, ranks: Mapping[str, Sequence[int]]) -> DataFrame:
    """``(name, value, passed)`` of metrics that must be one of a few whole numbers; an absent one fails."""
    rows = [(name, float(rank)) for name, allowed in ranks.items() for rank in allowed]
    table = metrics.sparkSession.createDataFrame(rows, "metric string, allowed double")
    hit = F.coalesce(F.col("value") == F.col("allowed"), F.lit(False))
    return table.join(metrics, "metric", "left").groupBy(F.col("metric").alias("name")).agg(
        F.max("value").alias("value"), F.max(hit).alias("passed")
    )


def reproduction_gates(
    metrics: DataFrame,
    targets: DataFrame,
    ranks: Mapping[str, Sequence[int]] | None = None,
    cells: DataFrame | None = None,
    sentinels: Mapping[tuple[str, str], float] | None = None,
    family: DataFrame | None = None,
    expected: DataFrame | None = None,
    full: bool = True,
) -> DataFrame:
    """One row per gate: ``(gate, name, value, target, tolerance, passed)``.

    ``targets`` are ``(metric, target, tolerance)``. Metrics of the resampling are gated only
    in a ``full`` run, as fewer replicates or draws give other values. ``sentinels`` are
    points of the target matrix ``cells``.
    """
    resampled = F.col("metric").isin(list(RESAMPLED))
    found = check_targets(metrics, targets if full else targets.where(~resampled))
    kind = F.when(resampled, "resampling").otherwise("target")
    parts = [found.withColumns({"gate": kind, "name": F.col("metric")})]
    if ranks:
        parts.append(rank_gates(metrics, ranks).withColumn("gate", F.lit("rank")))
    if sentinels:
        points = check_sentinels(cells, sentinels).withColumnRenamed("expected", "target")
        named = {"gate": F.lit("sentinel"), "name": F.concat_ws("/", "c", "t")}
        parts.append(points.withColumns(named | {"tolerance": F.lit(1e-12)}))
    if expected is not None:
        parts.append(matrix_gates(family, expected).withColumn("gate", F.lit("matrix")))
    columns = {"gate": "string", "name": "string", "value": "double", "target": "double", "tolerance": "double", "passed": "boolean"}
    rows = [
        p.select(*[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
        for p in parts
    ]
    return functools.reduce(DataFrame.unionByName, rows)


def reproduce(
    scores: DataFrame,
    target: DataFrame,
    axis: Sequence[str],
    column: str,
    named: str,
    targets: DataFrame,
    path: str,
    ranks: Mapping[str, Sequence[int]] | None = None,
    sentinels: Mapping[tuple[str, str], float] | None = None,
    expected: DataFrame | None = None,
    replicates: int = FULL_REPLICATES,
    draws: int = FULL_DRAWS,
    seed: int = 42,
    bootstrap: str = "multinomial",
) -> Reproduction:
    """Write the matrix family, run the study, gate both, and write metrics, gates and summary below ``path``.

    Nothing is raised: ``summary`` has ``status`` passed or failed, ``mode`` full or smoke, and counts.
    """
    if replicates < 1 or draws < 1:
        raise ValueError("replicates and draws must be positive")
    full = (replicates, draws) == (FULL_REPLICATES, FULL_DRAWS)
    family = summarize(scores, path, axis)
    metrics = materialized(study(scores, target, axis, column, named, replicates, draws, seed, bootstrap), "metrics")
    gates = materialized(reproduction_gates(metrics, targets, ranks, target, sentinels, family, expected, full), "gates")
    summary = gates.agg(
        F.when(F.every("passed"), "passed").otherwise("failed").alias("status"),
        F.lit("full" if full else "smoke").alias("mode"),
        F.count(F.lit(1)).alias("gates"),
        F.count_if(~F.col("passed")).alias("failed"),
    )
    for name, rows in (("metrics", metrics), ("gates", gates), ("summary", summary)):
        write_report(rows, f"{path}/reproduction_{name}")
    return Reproduction(metrics, gates, summary)
