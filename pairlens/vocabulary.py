"""Names and schemas shared by every operator.

Fixed values (formula, weighting, scheme and column names) are the ones the
published score tables use. Dataset and adapter names are always a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

FORMULAS = ("sum", "lls", "separate")
WEIGHTINGS = ("row", "prompt")
SCHEMES = ("all", "leave_one_dataset_out")

HASH_COLUMNS = ("prompt_hash", "chosen_hash", "rejected_hash")
LENGTH_COLUMNS = ("prompt_tokens", "chosen_response_tokens", "rejected_response_tokens")
BASE_COLUMNS = ("base_chosen_logprob", "base_rejected_logprob")
STRING_COLUMNS = ("dataset_trait", "source_revision", *HASH_COLUMNS)
IDENTITY_COLUMNS = ("dataset_trait", "source_revision", "source_row_id", *HASH_COLUMNS)

# Column and metadata names that would carry source text.
RAW_TEXT_NAMES = (
    "prompt",
    "chosen",
    "rejected",
    "messages",
    "text",
    "response",
    "completion",
    "raw_prompt",
    "raw_chosen",
    "raw_rejected",
    "prompt_text",
    "chosen_text",
    "rejected_text",
    "response_text",
    "completion_text",
    "raw_text",
)

MESSAGES_TYPE = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)


def total_columns(adapter: str) -> tuple[str, str]:
    """Names of an adapter's chosen and rejected log-probability totals."""
    return f"{adapter}_chosen_logprob", f"{adapter}_rejected_logprob"


def delta_column(formula: str, adapter: str) -> str:
    return f"delta_{formula}_{adapter}"


def score_schema(adapters: Sequence[str]) -> T.StructType:
    """The closed text-free schema: 11 common columns and 5 per adapter."""
    schema = T.StructType()
    for name in IDENTITY_COLUMNS:
        schema.add(name, T.LongType() if name == "source_row_id" else T.StringType())
    for name in LENGTH_COLUMNS:
        schema.add(name, T.LongType())
    for name in BASE_COLUMNS:
        schema.add(name, T.DoubleType())
    for adapter in adapters:
        for name in total_columns(adapter):
            schema.add(name, T.DoubleType())
        for formula in FORMULAS:
            schema.add(delta_column(formula, adapter), T.DoubleType())
    return schema


def require_known(name: str, value: str, known: Sequence[str]) -> None:
    if value not in known:
        raise ValueError(f"{name} must be one of {list(known)}, got {value!r}")
