"""Score table to the family of raw and calibrated matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.calibrate import calibrate, calibration_params
from pairlens.operators.scores import group_stats, score_cube
from pairlens.session import materialized
from pairlens.sources.sinks import write_matrix, write_report
from pairlens.vocabulary import SCHEMES

FAMILY_KEYS = ("kind", "formula", "weighting", "scheme")


def matrix_family(cube: DataFrame) -> DataFrame:
    """Raw cells and both calibrations as ``(kind, formula, weighting, scheme, c, t, value)``."""
    raw = cube.select(
        F.lit("raw").alias("kind"),
        "formula",
        "weighting",
        F.lit("none").alias("scheme"),
        "c",
        "t",
        "value",
    )
    calibrated = calibrate(cube, SCHEMES).select(
        F.lit("calibrated").alias("kind"),
        "formula",
        "weighting",
        "scheme",
        "c",
        "t",
        F.col("z").alias("value"),
    )
    return raw.unionByName(calibrated)


def summarize(
    scores: DataFrame,
    path: str,
    axis: Sequence[str],
    primary: tuple[str, str, str] = ("sum", "row", "all"),
) -> DataFrame:
    """Write every matrix, the primary one, its parameters and the variant list.

    The scan runs once: the cube is a few hundred cells and is written down
    before the outputs are derived from it. Returns the matrix family.
    """
    cube = materialized(score_cube(group_stats(scores, axis), axis), "cube")
    family = matrix_family(cube)
    write_matrix(family, f"{path}/matrices", axis, by=FAMILY_KEYS)
    formula, weighting, scheme = primary
    chosen = cube.where((F.col("formula") == formula) & (F.col("weighting") == weighting))
    write_matrix(calibrate(chosen, scheme), f"{path}/primary", axis, "z")
    write_report(calibration_params(chosen, scheme), f"{path}/parameters")
    variants = family.select(*FAMILY_KEYS).distinct()
    is_primary = (
        (F.col("kind") == "calibrated")
        & (F.col("formula") == formula)
        & (F.col("weighting") == weighting)
        & (F.col("scheme") == scheme)
    )
    write_report(variants.withColumn("primary", is_primary), f"{path}/variants")
    return family
