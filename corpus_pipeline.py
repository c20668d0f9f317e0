"""The corpus pipeline: documents filtered stage by stage, then encoded.

Each stage works on all rows the stage before kept. Rows that share a doc_id share its
verdict; rows without one are judged by what needs no id and kept by the rest.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.bpe import encode_texts
from pairlens.llm.common import materialized
from pairlens.llm.decontaminate import contamination
from pairlens.llm.line_dedup import drop_frequent_lines
from pairlens.llm.near_dedup import near_duplicates
from pairlens.llm.quality_lm import classify

VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among ``ids``."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language-model classifier keeps."""
    return classify(docs, _table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents hold; ``n_chars`` follows the text."""
    out = drop_frequent_lines(docs, min_docs=10, n_lines="lines_before", n_dropped="lines_dropped")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id."""
    return _without(docs, near_duplicates(docs, size=5, ratio=(80, 100)).where("NOT kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth of the words."""
    return _without(docs, contamination(docs, _table(spark, sf_dir, "benchmark")).where("contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed, with digests of the ids and of the bytes decoded from them."""
    rows = docs.select("doc_id", "lang", "source", "text")
    out = encode_texts(rows, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, decoded="decoded")
    return out.select(
        "doc_id", "lang", "source", "n_tokens", "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontaminate", decontaminated),
    ("byte_bpe", encoded),
]

#: The classifier and the tokenizer have no SQL form. Tests run the stages one by one; there is no brute-force twin yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again before the next."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialized(docs, f"stage-{name}")
    return docs
