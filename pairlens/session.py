"""Session helpers: shared scratch space and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# HotSpot does not compile methods above this bytecode size; a stage beyond it
# runs many times faster with its expressions split than fused in one method.
HUGE_METHOD_LIMIT = "8000"


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings for wide score tables; the only one needed is documented by Spark."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD_LIMIT)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as named in ``spark.checkpoint.dir``.

    Only a session with a local master (tests) that names none gets a folder of its own; a cluster must name one.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairlens-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition ahead of row-multiplying work.

    The partition count is explicit, so adaptive execution does not fold a small
    input into one task that would then produce all the copies; hashing the
    columns first keeps the planner from dropping the step as already satisfied.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, F.xxhash64(*columns))


def materialized(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut lineage by writing a table below the shared folder and reading it back.

    Later branches read the same rows, prune columns, and survive lost executors
    without repeating the scan behind them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(table: DataFrame, rows: int) -> bool:
    """Whether ``rows`` rows of ``table`` stay below the session's broadcast limit.

    The limit is ``spark.sql.autoBroadcastJoinThreshold``; -1 refuses every table.
    """
    text = table.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    number, unit = re.fullmatch(r"(-?[0-9]+)\s*([kmgt]?)i?b?", text).groups()
    limit = int(number) * 1024 ** " kmgt".index(unit or " ")
    width = sum(8 if isinstance(f.dataType, T.NumericType) else 64 for f in table.schema)
    return rows * width <= limit


def lookup_side(table: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint how a join should use ``table`` as its lookup side.

    Spark does not see that an exploded side has grown, and would broadcast it on
    its estimate. So the lookup side is named here: broadcast if its counted (or
    given) rows fit the limit, else hashed per shuffle partition. Count only
    written tables, where it costs a footer read.
    """
    rows = table.count() if rows is None else rows
    return F.broadcast(table) if fits_broadcast(table, rows) else table.hint("shuffle_hash")
