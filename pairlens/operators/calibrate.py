"""z-calibration of each adapter over datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.numeric import not_finite
from pairlens.vocabulary import SCHEMES, require_known

DEGENERATE = "an adapter's scores do not vary or are not finite, so they cannot be scaled; see on_degenerate"


def _moments(scheme: str, over) -> tuple[Column, Column]:
    value = F.col("value")
    if scheme == "all":
        return F.avg(value).over(over), F.stddev_pop(value).over(over)
    # The cell's own contribution is taken out of the adapter's totals. A single
    # dataset leaves nothing over: NULL moments, which count as degenerate.
    others = F.nullif(F.count(value).over(over) - 1, F.lit(0))
    mean = (F.sum(value).over(over) - value) / others
    square = (F.sum(value * value).over(over) - value * value) / others
    return mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def calibrate(
    cube: DataFrame,
    schemes: str | Sequence[str] = "all",
    keys: Sequence[str] = ("formula", "weighting"),
    on_degenerate: str = "raise",
) -> DataFrame:
    """Add ``scheme, mean, population_sd, z`` to cells ``(keys.., c, t, value)``.

    ``all`` standardises over every dataset, ``leave_one_dataset_out`` over the
    other datasets. All schemes share one window pass, so the cube is computed
    once. A zero or non-finite deviation fails the query, or yields a NULL ``z``
    with ``on_degenerate="null"``.
    """
    schemes = [schemes] if isinstance(schemes, str) else list(schemes)
    for scheme in schemes:
        require_known("scheme", scheme, SCHEMES)
    require_known("on_degenerate", on_degenerate, ("raise", "null"))
    over = Window.partitionBy(*keys, "c")
    rows = []
    for scheme in schemes:
        mean, sd = _moments(scheme, over)
        rows.append(
            F.struct(
                F.lit(scheme).alias("scheme"), mean.alias("mean"), sd.alias("population_sd")
            )
        )
    cells = cube.select(*keys, "c", "t", "value", F.array(*rows).alias("__schemes"))
    cells = cells.select(*keys, "c", "t", "value", F.inline("__schemes"))
    bad = not_finite(F.col("population_sd")) | (F.col("population_sd") <= 0)
    refused = (
        F.raise_error(F.lit(DEGENERATE)).cast("double") if on_degenerate == "raise" else F.lit(None)
    )
    z = (F.col("value") - F.col("mean")) / F.col("population_sd")
    return cells.withColumn("z", F.when(~bad, z).otherwise(refused))


def calibration_params(
    cube: DataFrame,
    scheme: str = "all",
    keys: Sequence[str] = ("formula", "weighting"),
    on_degenerate: str = "raise",
) -> DataFrame:
    """Mean and deviation: one row per adapter for ``all``, per cell otherwise."""
    cells = calibrate(cube, scheme, keys, on_degenerate)
    names = [*keys, "c"] if scheme == "all" else [*keys, "c", "t"]
    checked = F.when(F.count("z") == F.count(F.lit(1)), F.first("population_sd"))
    return cells.groupBy(*names).agg(
        F.first("mean").alias("mean"), checked.alias("population_sd")
    )
