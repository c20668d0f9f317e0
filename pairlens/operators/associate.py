"""Association between score cells and a target matrix.

Score cells are ``(by.., c, t, <value>)`` and the target is ``(c, t, e)`` on the
same axes; cells meet by name, so a transposed matrix cannot slip through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.numeric import pearson
from pairlens.operators.calibrate import calibrate
from pairlens.vocabulary import SCHEMES, require_known

METHODS = ("pearson", "spearman")
VARIANT = ("formula", "weighting", "scheme")


def _refuse(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("double")


def align(
    cells: DataFrame,
    target: DataFrame,
    axis: Sequence[str],
    by: Sequence[str] = (),
    value: str = "value",
) -> DataFrame:
    """Join score and target cells on ``(c, t)`` and require a full square.

    Every (c, t) of ``axis`` x ``axis`` must occur exactly once per variant on
    the score side and exactly once in the target, else the query fails. Join
    strategy is left to the optimizer, which broadcasts only what it measured.
    """
    size = len(axis)
    unique = target.groupBy("c", "t").agg(
        F.when(F.count(F.lit(1)) == 1, F.first("e"))
        .otherwise(_refuse("target cells must be unique"))
        .alias("e")
    )
    joined = cells.join(unique, ["c", "t"], "left")
    cell = Window.partitionBy(*by, "c", "t")
    variant = Window.partitionBy(*by, F.lit(0))
    named = F.col("c").isin(list(axis)) & F.col("t").isin(list(axis))
    whole = (F.col("__copies") == 1) & (F.col("__cells") == size * size) & named
    checked = joined.withColumns(
        {
            "__copies": F.count(F.lit(1)).over(cell),
            "__cells": F.count(F.lit(1)).over(variant),
        }
    ).withColumn(
        "e",
        F.when(~whole, _refuse(f"score must be a {size}x{size} matrix on the given axis"))
        .when(F.col("e").isNull(), _refuse("target lacks a score cell"))
        .otherwise(F.col("e")),
    )
    return checked.select(*by, "c", "t", F.col(value).alias("s"), "e")


def off_diagonal(aligned: DataFrame) -> DataFrame:
    """Cells whose adapter differs from the dataset."""
    return aligned.where(F.col("c") != F.col("t"))


def average_rank(value: str, partition: Sequence[str]) -> Column:
    """1-based rank with ties sharing their mean rank."""
    ordered = Window.partitionBy(*partition).orderBy(value)
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def association(
    aligned: DataFrame, by: Sequence[str] = (), method: str = "pearson"
) -> DataFrame:
    """Correlation of ``s`` and ``e`` per variant: ``(by.., cells, r)``."""
    require_known("method", method, METHODS)
    x, y = F.col("s"), F.col("e")
    if method == "spearman":
        partition = list(by) or [F.lit(0)]
        aligned = aligned.select(
            *by,
            average_rank("s", partition).alias("s"),
            average_rank("e", partition).alias("e"),
        )
    return aligned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), pearson(x, y).alias("r")
    )


def off_diagonal_association(
    cells: DataFrame,
    target: DataFrame,
    axis: Sequence[str],
    by: Sequence[str] = (),
    value: str = "value",
    method: str = "pearson",
) -> DataFrame:
    """Align, drop the diagonal, correlate."""
    return association(off_diagonal(align(cells, target, axis, by, value)), by, method)


def column_association(
    cells: DataFrame,
    target: DataFrame,
    axis: Sequence[str],
    by: Sequence[str] = (),
    value: str = "value",
    method: str = "pearson",
) -> DataFrame:
    """Off-diagonal association inside every dataset column at once."""
    aligned = off_diagonal(align(cells, target, axis, by, value))
    return association(aligned, [*by, "t"], method)


def predicted_rank(
    cells: DataFrame, by: Sequence[str] = (), value: str = "value"
) -> DataFrame:
    """Descending order of adapters inside each dataset column, own trait left out."""
    order = Window.partitionBy(*by, "t").orderBy(F.col(value).desc(), F.col("c"))
    return off_diagonal(cells).select(
        *by, "t", "c", F.col(value), F.row_number().over(order).alias("predicted_rank")
    )


def sensitivity_grid(
    cube: DataFrame,
    target: DataFrame,
    axis: Sequence[str],
    method: str = "pearson",
    schemes: Sequence[str] = SCHEMES,
) -> DataFrame:
    """Off-diagonal association of every (formula, weighting, scheme) variant."""
    calibrated = calibrate(cube, schemes)
    return off_diagonal_association(calibrated, target, axis, VARIANT, "z", method)
