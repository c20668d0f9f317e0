"""Preference pairs: validation, response boundaries and log-probability totals.

Bad rows are not exceptions here: each operator adds a ``reason`` column holding
the first rule a row breaks, NULL for a good row, so one pass can split both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.numeric import not_finite
from pairlens.functions.text import strip_final_newlines, text_hash, word_tokens
from pairlens.session import fits_broadcast, materialized

SIDES = ("chosen", "rejected")


def validate_pairs(df: DataFrame) -> DataFrame:
    """Check ``chosen`` and ``rejected`` message lists and pull out their texts.

    Adds ``prompt, chosen_text, rejected_text, reason``.
    """
    chosen, rejected = F.col("chosen"), F.col("rejected")
    roles = F.array(F.lit("user"), F.lit("assistant"))

    def speaks(messages: Column) -> Column:
        return F.transform(messages, lambda m: m["role"]).eqNullSafe(roles)

    def content(messages: Column, index: int) -> Column:
        return F.get(messages, index)["content"]

    def blank(text: Column) -> Column:
        return text.isNull() | (text == "")

    prompt = content(chosen, 0)
    reason = (
        F.when(chosen.isNull() | rejected.isNull(), "not_message_lists")
        .when((F.size(chosen) != 2) | (F.size(rejected) != 2), "message_count")
        .when(~(speaks(chosen) & speaks(rejected)), "roles")
        .when(blank(prompt), "empty_prompt")
        .when(~content(rejected, 0).eqNullSafe(prompt), "prompts_differ")
        .when(blank(content(chosen, 1)), "empty_chosen")
        .when(blank(content(rejected, 1)), "empty_rejected")
    )
    return df.withColumns(
        {
            "prompt": prompt,
            "chosen_text": content(chosen, 1),
            "rejected_text": content(rejected, 1),
            "reason": reason,
        }
    )


def good_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNull()).drop("reason")


def rejected_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNotNull())


def hashed_pairs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the three texts of a pair by their hashes."""
    return pairs.select(
        *keys,
        text_hash(F.col("prompt")).alias("prompt_hash"),
        text_hash(F.col("chosen_text")).alias("chosen_hash"),
        text_hash(F.col("rejected_text")).alias("rejected_hash"),
    )


def encode_boundary(
    df: DataFrame,
    tokenizer: Callable[[Column], Column],
    eos: str,
    eos_id: int,
    max_length: int = 1024,
) -> DataFrame:
    """Token ids and response boundary of rendered chats.

    Reads ``prompt_text`` and ``full_render``; adds ``full_text, input_ids,
    prompt_length, response_length, reason``. The rendering must start with the
    prompt, loses trailing newlines and ends with the end marker, whose id is
    forced onto the last token. Too long rows are refused, never cut.
    ``tokenizer`` maps a string column to ``array<int>``: a built-in expression
    or a pandas UDF.
    """
    if max_length < 3:
        raise ValueError("max_length leaves no room for a prompt, a response and an end token")
    rendered = strip_final_newlines(F.col("full_render"))
    ended = F.when(rendered.endswith(F.lit(eos)), rendered).otherwise(
        F.concat(rendered, F.lit(" " + eos))
    )
    texts = df.withColumn("full_text", ended).withColumns(
        {
            "__prompt_ids": tokenizer(F.col("prompt_text")),
            "__ids": tokenizer(F.col("full_text")),
        }
    )
    ids = F.col("__ids")
    sized = texts.withColumns(
        {"prompt_length": F.size("__prompt_ids"), "__length": F.size("__ids")}
    )
    length, prompt_length = F.col("__length"), F.col("prompt_length")
    begins = F.col("full_render").startswith(F.col("prompt_text"))
    reason = (
        F.when(~F.coalesce(begins, F.lit(False)), "prompt_prefix")
        .when(length == 0, "no_tokens")
        .when(prompt_length >= max_length - 2, "prompt_too_long")
        .when(length > max_length, "sequence_too_long")
        .when(length <= prompt_length, "empty_response")
    )
    last = F.array(F.lit(eos_id).cast("int"))
    kept = F.slice(ids, F.lit(1), F.greatest(length - 1, F.lit(0)))
    return sized.withColumns(
        {
            "input_ids": F.when(length > 0, F.concat(kept, last)).otherwise(ids),
            "response_length": length - prompt_length,
            "reason": reason,
        }
    ).drop("__prompt_ids", "__ids", "__length")


def response_logprob(df: DataFrame) -> DataFrame:
    """Sum the actual tokens' log-probabilities over response positions.

    Reads ``input_ids, prompt_length, prompt_logprobs`` where the latter has one
    candidate map (or NULL) per position; adds ``logprob, reason``.
    """
    ids, maps = F.col("input_ids"), F.col("prompt_logprobs")
    start, count = F.col("prompt_length") + 1, F.size("input_ids") - F.col("prompt_length")
    aligned = maps.isNotNull() & (F.size(maps) == F.size(ids))
    picked = F.zip_with(
        F.slice(ids, start, count), F.slice(maps, start, count), lambda t, m: F.try_element_at(m, t)
    )
    picked = F.when(aligned, picked)
    total = F.aggregate(picked, F.lit(0.0), lambda acc, value: acc + value)
    summed = df.withColumns({"__picked": picked, "__total": total})
    reason = (
        F.when(~aligned, "misaligned")
        .when(F.exists("__picked", lambda value: value.isNull()), "missing_token")
        .when(not_finite(F.col("__total")), "nonfinite")
    )
    return (
        summed.withColumn("reason", reason)
        .withColumn("logprob", F.when(F.col("reason").isNull(), F.col("__total")))
        .drop("__picked", "__total")
    )


def _batches(sizes: Sequence[int], rows: int, tokens: int) -> Iterator[tuple[int, int]]:
    """Borders of consecutive batches of at most ``rows`` sequences and, unless of one sequence, ``tokens`` tokens."""
    start = held = 0
    for end, size in enumerate(sizes):
        if end > start and (end - start == rows or held + size > tokens):
            yield start, end
            start, held = end, 0
        held += size
    if sizes:
        yield start, len(sizes)


def score_sequences(
    df: DataFrame,
    model: Callable[[list[list[int]]], list[list[dict[int, float] | None]]],
    batch_size: int = 64,
    batch_tokens: int = 1 << 14,
) -> DataFrame:
    """Run a user model over ``input_ids`` in batches inside the tasks.

    ``model`` gets token id lists and returns, for each, one candidate map (or
    None) per position. Adds ``prompt_logprobs`` for ``response_logprob``.
    A batch ends at ``batch_size`` sequences or ``batch_tokens`` tokens (a longer sequence goes
    alone) and leaves the task before the next begins: no more candidate maps are held.
    """
    if batch_size < 1 or batch_tokens < 1:
        raise ValueError("batch_size and batch_tokens must be positive")
    maps = T.ArrayType(T.MapType(T.IntegerType(), T.DoubleType()))
    schema = T.StructType([*df.schema.fields, T.StructField("prompt_logprobs", maps)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = [len(row) for row in frame["input_ids"]]
            for start, end in _batches(sizes, batch_size, batch_tokens):
                part = frame.iloc[start:end]
                batch = [[int(token) for token in row] for row in part["input_ids"]]
                scored = model(batch)
                if len(scored) != len(batch):
                    raise ValueError(f"the model must give one result per sequence: {len(scored)} for {len(batch)}")
                yield part.assign(prompt_logprobs=scored)
                del batch, scored, part

    return df.mapInPandas(run, schema)


def token_table(
    texts: DataFrame, text: str, model: str, models: Sequence[str], base: str = "base"
) -> DataFrame:
    """Word counts per token: one column per model and ``base`` for all texts."""
    tokens = texts.select(
        F.col(model).alias("__model"), F.explode(word_tokens(F.col(text))).alias("token")
    )
    counts = [F.count_if(F.col("__model") == name).alias(name) for name in models]
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias(base), *counts)


def _salted_lookup(
    words: DataFrame, lookup: DataFrame, keys: Sequence[str], salts: int
) -> DataFrame:
    """Left join on ``token`` with the frequent words spread over ``salts`` copies.

    A word is frequent if it makes up more than 1/salts of all words, so there are
    fewer than ``salts`` of them: that list is the only thing broadcast. The merge
    hint keeps Spark from broadcasting the lookup on an estimate that does not see
    the copies, and leaves lesser skew to adaptive execution.
    """
    counts = materialized(
        words.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "word-counts"
    )
    share = counts.agg(F.sum("n")).scalar() / F.lit(salts)
    hot = materialized(
        counts.where(F.col("token").isNotNull() & (F.col("n") > share)).select(
            "token", F.lit(True).alias("hot")
        ),
        "hot-words",
    )
    copy = F.pmod(F.xxhash64(*keys, "side", "pos"), F.lit(salts)).cast("int")
    spread_out = F.coalesce("hot", F.col("token").isNull())
    salted = words.join(F.broadcast(hot), "token", "left").withColumn(
        "salt", F.when(spread_out, copy).otherwise(0)
    )
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = lookup.join(F.broadcast(hot), "token", "left").withColumn(
        "salt", F.explode(F.when(F.col("hot"), every).otherwise(F.array(F.lit(0))))
    )
    return salted.drop("hot").join(copies.drop("hot").hint("merge"), ["token", "salt"], "left")


def score_pairs(
    pairs: DataFrame,
    tokens: DataFrame,
    models: Sequence[str],
    keys: Sequence[str],
    salts: int = 64,
) -> DataFrame:
    """Log-probability totals under add-one-smoothed word counts.

    ``pairs`` has ``keys, chosen, rejected`` texts, ``tokens`` a count column per
    model. Result: ``(keys, side, model, tokens, logprob)``.

    ln((n+1)/d) is ln(n+1) - ln(d), so a word costs one lookup for all models
    and unknown words add nothing: the denominator is applied once per response.
    A token table too large to broadcast is joined by shuffle with frequent words
    salted, because they are in every text.
    """
    table = materialized(tokens.select("token", *models), "tokens")
    logs = [F.log(F.col(m) + F.lit(1.0)).alias(m) for m in models]
    lookup = table.select("token", *logs)
    denominators = table.agg(
        *[(F.sum(m) + F.count_if(F.col(m) > 0) + 1).cast("double").alias(m) for m in models]
    )
    sides = F.array(
        *[F.struct(F.lit(s).alias("side"), word_tokens(F.col(s)).alias("words")) for s in SIDES]
    )
    words = pairs.select(*keys, F.inline(sides)).select(
        *keys, "side", F.posexplode_outer("words").alias("pos", "token")
    )
    if fits_broadcast(table, table.count()):
        found = words.join(F.broadcast(lookup), "token", "left")
    else:
        found = _salted_lookup(words, lookup, keys, salts)
    sums = found.groupBy(*keys, "side").agg(
        F.count("token").alias("tokens"),
        *[F.sum(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in models],
    )
    totals = [
        F.struct(
            F.lit(m).alias("model"),
            (F.col(m) - F.col("tokens") * F.log(denominators.select(m).scalar())).alias("logprob"),
        )
        for m in models
    ]
    return sums.select(*keys, "side", "tokens", F.inline(F.array(*totals))).select(
        *keys, "side", "model", "tokens", "logprob"
    )
