"""Golden values: named digests, metric tolerances and point sentinels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Names whose observed digest is not the expected one: ``(name, expected, observed)``.

    Both inputs are ``(name, digest)``; a name that was not observed is a mismatch.
    """
    left = expected.select("name", F.col("digest").alias("expected"))
    right = observed.select("name", F.col("digest").alias("observed"))
    joined = left.join(right, "name", "left")
    return joined.where(~F.col("expected").eqNullSafe(F.col("observed")))


def check_targets(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """Compare ``(metric, value)`` with ``(metric, target, tolerance)``.

    A metric passes within its absolute tolerance; a missing or non-finite value
    fails.
    """
    joined = targets.join(metrics, "metric", "left")
    gap = F.abs(F.col("value") - F.col("target"))
    passed = F.coalesce(~F.isnan("value") & (gap <= F.col("tolerance")), F.lit(False))
    return joined.select("metric", "value", "target", "tolerance", passed.alias("passed"))


def check_sentinels(
    cells: DataFrame, expected: Mapping[tuple[str, str], float], value: str = "e"
) -> DataFrame:
    """Point checks of matrix cells: ``(c, t, expected, value, passed)``."""
    rows = [(c, t, float(v), 1e-12) for (c, t), v in expected.items()]
    points = cells.sparkSession.createDataFrame(
        rows, "c string, t string, expected double, tolerance double"
    )
    joined = points.join(cells.select("c", "t", F.col(value).alias("value")), ["c", "t"], "left")
    close = F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance")
    return joined.select(
        "c", "t", "expected", "value", F.coalesce(close, F.lit(False)).alias("passed")
    )
