"""Score tables, targets and pairs derived by Spark from the given tables.

Each builder has a SQL twin in ``__spark_entry__`` that the check tool runs.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.text import text_hash
from pairlens.operators.scores import with_scores
from pairlens.vocabulary import score_schema, total_columns

TRAITS = tuple(f"t{k}" for k in range(10))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def lineitem_scores(spark: SparkSession, sf_dir: str, *extra: Column) -> DataFrame:
    """A score table with one row per line item, ten datasets and ten adapters.

    All totals are dyadic, so sums do not depend on their order. ``extra`` are
    further columns over the line items.
    """
    columns = [
        "concat('t', CAST(l_suppkey % 10 AS STRING)) AS dataset_trait",
        "l_orderkey * 8 + l_linenumber AS row_key",
        "sha2(CAST(l_orderkey % 200 AS STRING), 256) AS prompt_hash",
        "CAST(3 + l_orderkey % 9 AS BIGINT) AS prompt_tokens",
        "CAST(1 + l_linenumber AS BIGINT) AS chosen_response_tokens",
        "CAST(1 + l_partkey % 7 AS BIGINT) AS rejected_response_tokens",
        "-l_quantity AS base_chosen_logprob",
        "-l_quantity - l_linenumber AS base_rejected_logprob",
    ]
    for k, trait in enumerate(TRAITS):
        chosen, rejected = total_columns(trait)
        own = f"CASE WHEN l_suppkey % 10 = {k} THEN 3 ELSE 0 END"
        columns += [
            f"-l_quantity + ((l_partkey * {k + 1}) % 17 - 8) / 4.0D + {own} AS {chosen}",
            f"-l_quantity - l_linenumber + ((l_partkey + {k}) % 5 - 2) / 8.0D AS {rejected}",
        ]
    parsed = [F.expr(column) for column in columns]
    return table(spark, sf_dir, "lineitem").select(*parsed, *extra)


def row_id() -> Column:
    """Text key of a line item; the integer ``row_key`` is not unique."""
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return F.concat_ws(
        "-", *[F.col(p).cast("string") for p in parts], F.col("l_shipdate").cast("date").cast("string")
    )


def quantity_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target matrix ``(c, t, e)`` from quantities per part and supplier class."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat(F.lit("t"), (F.col("l_partkey") % 10).cast("string")).alias("c"),
            F.concat(F.lit("t"), (F.col("l_suppkey") % 10).cast("string")).alias("t"),
        )
        .agg(F.sum("l_quantity").alias("e"))
    )


def bundle_scores(spark: SparkSession, sf_dir: str, revision: str) -> DataFrame:
    """The full 61-column table with a unique integer row id."""
    chosen = text_hash((F.col("l_partkey") % 1000).cast("string")).alias("chosen_hash")
    rejected = text_hash((F.col("l_suppkey") % 1000).cast("string")).alias("rejected_hash")
    identity = F.xxhash64(row_id()).alias("source_row_id")
    base = lineitem_scores(spark, sf_dir, chosen, rejected, identity)
    scored = with_scores(base, TRAITS).withColumn("source_revision", F.lit(revision))
    return scored.select(*score_schema(TRAITS).names)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders, a thousand keys a part; every 500th key holds a path that a scan finds."""
    key = F.col("o_orderkey")
    mark = F.when(key % 500 == 0, "see /mnt/share")
    value = F.concat_ws("|", key.cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", mark)
    return table(spark, sf_dir, "orders").select(F.floor(key / 1000).cast("long").alias("part"), value.alias("value"))


def write_order_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """``order_lines`` as one text file per part, lines in binary order."""
    lines = order_lines(spark, sf_dir).repartition("part").sortWithinPartitions("part", "value")
    lines.write.partitionBy("part").text(path)


def planted_scores(spark: SparkSession, sf_dir: str, revision: str) -> DataFrame:
    """The 61-column table with one kind of defect per residue of ``row_key``."""
    key = F.col("row_key")
    identity = F.lit(0).cast("bigint").alias("source_row_id")
    base = lineitem_scores(spark, sf_dir, identity)
    sound = with_scores(base, TRAITS)

    def plant(column: str, *cases: tuple[int, Column]) -> Column:
        value = F.col(column)
        for modulus, defect in reversed(cases):
            value = F.when(key % modulus == 0, defect).otherwise(value)
        return value

    none = F.lit(None)
    return sound.withColumns(
        {
            "file_dataset": F.col("dataset_trait"),
            "dataset_trait": plant("dataset_trait", (97, F.lit("other")), (101, none)),
            "source_revision": F.when(key % 103 == 0, "unpinned").otherwise(revision),
            "prompt_hash": plant(
                "prompt_hash",
                (107, F.upper("prompt_hash")),
                (109, F.substring("prompt_hash", 1, 63)),
                (113, F.concat("prompt_hash", F.lit("\n"))),
                (127, none),
            ),
            "prompt_tokens": plant("prompt_tokens", (131, none)),
            "rejected_response_tokens": plant("rejected_response_tokens", (137, F.lit(0))),
            "t3_chosen_logprob": plant("t3_chosen_logprob", (139, F.lit(float("nan")))),
            "t4_rejected_logprob": plant("t4_rejected_logprob", (149, F.lit(float("inf")))),
            "delta_sum_t5": plant("delta_sum_t5", (151, F.col("delta_sum_t5") + 0.5)),
            "delta_lls_t6": plant(
                "delta_lls_t6", (157, F.col("delta_lls_t6") + F.lit(2.0**-40))
            ),
            "delta_separate_t7": plant("delta_separate_t7", (163, none)),
        }
    )


def _turns_from(spark: SparkSession, sf_dir: str, later: int, role: str | None = None) -> DataFrame:
    """Messages of ``role`` named by the turn ``later`` turns before them.

    The name is the pairing number of conversation and turn, (a + b) (a + b + 1) / 2 + b, different for any two.
    """
    turns = table(spark, sf_dir, "conversations").where(F.col("turn") >= later)
    if role is not None:
        turns = turns.where(F.col("role") == role)
    turn = F.col("turn").cast("long") - later
    total = F.col("conv_id").cast("long") + turn
    start = F.shiftright(total * (total + 1), 1) + turn
    return turns.select(start.alias("conv_id"), F.struct("role", F.col("text").alias("content")).alias(f"turn{later}"))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as the start of a candidate pair of message lists.

    The chosen list goes on with the next turn, the rejected one with the third after.
    Late, short or system-led starts make invalid pairs. ``conv_id`` names the turn.
    """
    first, second, fourth = (_turns_from(spark, sf_dir, later) for later in (0, 1, 3))
    return first.join(second, "conv_id", "left").join(fourth, "conv_id", "left").select(
        "conv_id",
        F.array_compact(F.array("turn0", "turn1")).alias("chosen"),
        F.array_compact(F.array("turn0", "turn3")).alias("rejected"),
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the assistant turns one and three after it. ``conv_id`` names the turn."""
    prompt = _turns_from(spark, sf_dir, 0, "user")
    chosen, rejected = (_turns_from(spark, sf_dir, later, "assistant") for later in (1, 3))
    return prompt.join(chosen, "conv_id", "left").join(rejected, "conv_id", "left").select(
        "conv_id",
        F.col("turn0.content").alias("prompt"),
        F.col("turn1.content").alias("chosen"),
        F.col("turn3.content").alias("rejected"),
    )


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pairs of the conversations that have a prompt and two replies."""
    return conversation_turns(spark, sf_dir).dropna(subset=["prompt", "chosen", "rejected"])


def planted_texts(
    texts: DataFrame, key: str, text: str, lines: Sequence[str], every: int = 50
) -> DataFrame:
    """Append the r-th line to the texts whose key leaves remainder r."""
    planted = F.col(text)
    for remainder, line in enumerate(lines):
        hit = F.col(key) % every == remainder
        planted = F.when(hit, F.concat(F.col(text), F.lit("\n" + line))).otherwise(planted)
    return texts.select(key, planted.alias(text))
