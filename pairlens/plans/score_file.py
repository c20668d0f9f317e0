"""Preference pairs to text-free score rows with a user's model."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators.pairs import (
    encode_boundary,
    good_rows,
    hashed_pairs,
    rejected_rows,
    response_logprob,
    score_sequences,
    validate_pairs,
)
from pairlens.operators.scores import scores_wide
from pairlens.session import materialized
from pairlens.vocabulary import require_known


def _require_clean(df: DataFrame, what: str) -> DataFrame:
    bad = df.where(F.col("reason").isNotNull()).groupBy("reason").count().collect()
    if bad:
        raise ValueError(f"{what}: " + ", ".join(sorted(f"{r.reason} x{r['count']}" for r in bad)))
    return good_rows(df)


def encode_sides(
    pairs: DataFrame,
    render: Callable[[Column, Column], tuple[Column, Column]],
    tokenizer: Callable[[Column], Column],
    eos: str,
    eos_id: int,
    max_length: int = 1024,
) -> DataFrame:
    """Chosen and rejected responses as encoded rows ``(pair_key, side, ...)``.

    ``render(prompt, response)`` gives the generation prompt and the full chat.
    """
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), F.col(f"{side}_text").alias("response"))
            for side in ("chosen", "rejected")
        ]
    )
    rows = pairs.select("pair_key", "prompt", F.inline(sides))
    prompt_text, full_render = render(F.col("prompt"), F.col("response"))
    rendered = rows.select(
        "pair_key",
        "side",
        prompt_text.alias("prompt_text"),
        full_render.alias("full_render"),
    )
    encoded = encode_boundary(rendered, tokenizer, eos, eos_id, max_length)
    return encoded.drop("prompt_text", "full_render", "full_text")


def score_file(
    pairs: DataFrame,
    models: Mapping[str, Callable],
    render: Callable[[Column, Column], tuple[Column, Column]],
    tokenizer: Callable[[Column], Column],
    eos: str,
    eos_id: int,
    max_length: int = 1024,
    batch_size: int = 64,
    on_bad: str = "raise",
) -> DataFrame:
    """Score parsed pairs under ``models``, whose ``base`` entry is the base model.

    Bad pairs, encodings and totals fail the run, or drop their whole pair with
    ``on_bad="drop"``. Base and adapter totals meet by pair and side.
    """
    require_known("on_bad", on_bad, ("raise", "drop"))
    if "base" not in models:
        raise ValueError("models must name a base model")
    # Written once, so the key is stable; row ids and texts may repeat.
    keyed = materialized(
        pairs.withColumn("pair_key", F.monotonically_increasing_id()), "pairs"
    )
    checked = validate_pairs(keyed.where("parse_reason IS NULL"))
    encoded_all = materialized(
        encode_sides(good_rows(checked), render, tokenizer, eos, eos_id, max_length), "encoded"
    )
    if on_bad == "raise":
        _require_clean(keyed.withColumnRenamed("parse_reason", "reason"), "unreadable pairs")
        _require_clean(checked, "invalid pairs")
        encoded = _require_clean(encoded_all, "refused encodings")
    else:
        refused = rejected_rows(encoded_all).select("pair_key").distinct()
        encoded = good_rows(encoded_all).join(refused, "pair_key", "left_anti")
    scored = None
    for name, model in models.items():
        one = response_logprob(score_sequences(encoded, model, batch_size))
        one = one.select(
            "pair_key",
            "side",
            F.lit(name).alias("model"),
            F.col("response_length").alias("tokens"),
            "reason",
            "logprob",
        )
        scored = one if scored is None else scored.unionByName(one)
    totals_all = materialized(scored, "totals")
    if on_bad == "raise":
        totals = _require_clean(totals_all, "refused totals")
    else:
        broken = rejected_rows(totals_all).select("pair_key").distinct()
        totals = good_rows(totals_all).join(broken, "pair_key", "left_anti")
    adapters = [name for name in models if name != "base"]
    wide = scores_wide(totals, adapters, ["pair_key"])
    prompts = encoded.where("side = 'chosen'").select(
        "pair_key", F.col("prompt_length").alias("prompt_tokens")
    )
    hashes = hashed_pairs(good_rows(checked), ["pair_key", "row_id"])
    return hashes.join(prompts, "pair_key").join(wide, "pair_key").drop("pair_key")
