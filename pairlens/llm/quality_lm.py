"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams (3-grams unless asked otherwise).

The model is trained on all trusted documents (those labelled as good). Documents are written once, dealt into blocks
of bounded size. A task counts the distinct n-grams of a block, in all its documents and in the trusted ones; counts,
continuation counts, contexts and discounts are tables joined by n-gram, order by order, and give the probability of
every n-gram that a block asks for. The answers go back by block, and each block is scored where it lies. The model
is never whole in one place: neither the driver nor a task holds more than a block's own n-grams.

A document's score is its bits per byte, drawn towards the trusted mean with the
weight of ``prior`` bytes so that short texts do not look odd by chance. Its
language's limit is the ``quantile`` of its trusted scores, or half way from there to the next
score of a document labelled as bad: that keeps no more of these. Documents above the limit are rejected,
so a share of 1 - ``quantile`` of the trusted ones is given up at most. Documents that lie twice as far
below the median as the ``low`` quantile (and below the trusted mean, as short texts are drawn there) are too predictable and go too.
Languages without trusted documents use the limits of all trusted documents; without any trusted
document nothing is rejected.

Cases: null or empty text is kept; null lang is a language
of its own; repeated rows are judged alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import empty_safe, fresh_name, materialized, partitions_for, scratch_path, slices, texts_of

ORDER = 3
BLOCK_BYTES = 1 << 21


def _codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte and at each text's end, and where each text's n-grams start."""
    kind = np.uint32 if order <= 4 else np.uint64
    before = b"\n" * (order - 1)
    buffer = np.frombuffer(b"".join(before + t + b"\n" for t in texts), np.uint8).astype(kind)
    lengths = np.array([len(t) + 1 for t in texts])
    n = len(buffer) - order + 1
    codes = np.zeros(n, kind)
    for k in range(order):
        codes = (codes << kind(8)) | buffer[k : n + k]
    valid = np.ones(len(buffer), bool)
    ends = np.cumsum(lengths + order - 1)[:-1]
    for k in range(1, order):
        valid[ends - k] = False  # these reach into the next text
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return codes[valid[:n]], starts


def _blocks(text: str, size: int, column: str):
    """Numbers consecutive rows of a task in blocks of about ``size`` bytes, one row at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = np.empty(batch.num_rows, np.int64)
            for i, n in enumerate(pc.binary_length(batch[text]).to_pylist()):
                if held and held + n + 1 > size:
                    block, held = block + 1, 0
                held += n + 1
                numbers[i] = block
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=[*batch.schema.names, column])

    return run


@dataclass
class Dealt:
    """Documents written once, bucketed by block: each block can meet what is sent to it without moving."""

    rows: DataFrame
    block: str  # the column that numbers blocks
    text: str


def deal(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> Dealt:
    """``docs`` in blocks; a null text is empty."""
    spark, n, block = docs.sparkSession, partitions_for(docs), fresh_name(docs, "block")
    rows = docs.withColumn(text, empty_safe(F.col(text)))
    name = f"lm_blocks_{uuid.uuid4().hex}"
    (
        rows.mapInArrow(_blocks(text, block_bytes, block), T.StructType(list(rows.schema.fields)).add(block, "long"))
        .write.bucketBy(n, block).option("compression", "zstd")
        .option("path", scratch_path(spark, "lm-blocks")).format("parquet").saveAsTable(name)
    )
    dealt = spark.table(name)
    # The files stay, as the result reads them; the catalog forgets them.
    spark.sql(f"DROP TABLE {name}")
    return Dealt(dealt, block, text)


def _count(order: int):
    """The distinct n-grams of a block, and how often its trusted rows hold each."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = texts_of(left["text"])
        good = set(right["good"].to_pylist())
        trusted = np.array([i in good for i in left["id"].to_pylist()], bool)
        seen, found, counts = [], [], []
        for a, b in slices(texts):
            codes, starts = _codes(texts[a:b], order)
            seen.append(np.unique(codes))
            some, n = np.unique(codes[np.repeat(trusted[a:b], np.diff(starts))], return_counts=True)
            found.append(some)
            counts.append(n)
        asked = np.unique(np.concatenate(seen))
        total = np.zeros(len(asked), np.int64)
        for some, n in zip(found, counts, strict=True):
            total[np.searchsorted(asked, some)] += n
        block = np.full(len(asked), left["block"][0].as_py(), np.int64)
        return pa.table({"block": block, "code": asked.astype(np.int64), "n": total})

    return run


def count_grams(dealt: Dealt, trusted: DataFrame, doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """(block, code, n): each block's distinct n-grams and their number in rows whose id is in ``trusted`` (id)."""
    if not 2 <= order <= 7:
        raise ValueError("order must be 2 to 7: an n-gram is kept in a long")
    rows = dealt.rows.select(
        F.col(dealt.block).alias("block"), F.col(doc_id).cast("long").alias("id"), F.col(dealt.text).alias("text")
    )
    # Labels grow with the documents, so they are never broadcast.
    ids = dealt.rows.select(F.col(dealt.block).alias("at"), F.col(doc_id).cast("long").alias("id"))
    good = ids.join(trusted.distinct().hint("merge"), "id", "left_semi").select("at", F.col("id").alias("good")).distinct()
    met = rows.groupBy("block").cogroup(good.groupBy("at"))
    return materialized(met.applyInArrow(_count(order), "block long, code long, n long"), "lm-asked")


def discounts(rows: dict[int, int]) -> list[float]:
    """The discounts for counts 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = (rows.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def _probabilities(asked: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(code, p) for each n-gram of ``asked`` (code), from the counts (code, n) of this order.

    A count below the highest order is the number of different bytes before the n-gram.
    """
    if order == 0:
        return asked.select("code", F.lit(1.0 / 256).alias("p"))
    few = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    d = discounts(few)
    cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    suffix = F.col("code").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
    context = F.shiftright("code", 8)
    totals = counts.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("given"))
    shares = counts.select("code", (F.col("n") - cut).alias("left"))
    if order == 1:
        lower = asked.select(suffix.alias("suffix")).distinct().select("suffix", F.lit(1.0 / 256).alias("p"))
    else:
        shorter = counts.groupBy(suffix.alias("code")).agg(F.count(F.lit(1)).alias("n"))
        lower = _probabilities(
            asked.select(suffix.alias("code")).distinct(), materialized(shorter, f"lm-counts-{order - 1}"), order - 1
        ).withColumnRenamed("code", "suffix")
    own = asked.select("code", suffix.alias("suffix"), context.alias("context"))
    share = F.coalesce(F.col("left") / F.col("total"), F.lit(0.0))
    back = F.coalesce(F.col("given") / F.col("total"), F.lit(1.0))  # an unseen context leaves all to the lower order
    return (
        own.join(shares, "code", "left").join(totals, "context", "left").join(lower, "suffix", "left")
        .select("code", (share + back * F.col("p")).alias("p"))
    )


def fit_model(asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, value): the log2 probability of every n-gram in ``asked`` (block, code, n); none is left out."""
    codes = materialized(asked.groupBy("code").agg(F.sum("n").alias("n")), "lm-counts")
    p = _probabilities(codes.select("code"), codes.where("n > 0"), order)
    return materialized(p.select("code", F.log2("p").cast("float").alias("value")), "lm-values")


_table = np.zeros(0, np.float32)


def _lookup(grams: np.ndarray, values: np.ndarray, order: int):
    """The value of each code; codes of up to three bytes index an array that is kept, as a block's codes all have values."""
    global _table
    if order > 3:
        by = np.argsort(grams)
        grams, values = grams[by].astype(np.uint64), values[by]
        return lambda codes: values[np.searchsorted(grams, codes.astype(np.uint64))]
    if not len(_table):
        _table = np.zeros(1 << 24, np.float32)
    _table[grams] = values
    return lambda codes: _table[codes]


def _score(block: str, text: str, bits: str, size: str, order: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        value = _lookup(right["code"].to_numpy(), right["value"].to_numpy(), order)
        texts = texts_of(left[text])
        scores = []
        for a, b in slices(texts):
            codes, starts = _codes(texts[a:b], order)
            sums = np.concatenate([[0.0], np.cumsum(value(codes), dtype=np.float64)])
            scores.append(np.round(sums[starts[:-1]] - sums[starts[1:]], 3))
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        out = left.drop_columns([block]).append_column(bits, pa.array(np.concatenate(scores)))
        return out.append_column(size, pa.array(sizes))

    return run


def score_texts(
    dealt: Dealt, asked: DataFrame, model: DataFrame, bits: str = "bits", size: str = "n_bytes", order: int = ORDER,
) -> DataFrame:
    """The dealt rows with the bits of each text and the number of bytes scored (the end counts as one)."""
    rows, block = dealt.rows.drop(bits, size), dealt.block
    fields = [f for f in rows.schema.fields if f.name != block]
    answers = asked.select(F.col("block").alias(block), "code").join(model.hint("merge"), "code")
    met = rows.groupBy(block).cogroup(answers.groupBy(block))
    return met.applyInArrow(_score(block, dealt.text, bits, size, order), T.StructType(fields).add(bits, "double").add(size, "long"))


@dataclass
class Limits:
    """Per language the least and highest score kept; ``mean`` and ``prior`` shrink the scores of short texts."""

    table: DataFrame  # lang, low, limit
    overall: tuple[float, float]
    mean: float
    prior: int

    def score(self, bits: str, size: str):
        return (F.col(bits) + self.mean * self.prior) / (F.col(size) - 1 + self.prior)


def fit_limits(scores: DataFrame, quantile: float, low: float, prior: int) -> Limits:
    """Limits from labelled documents' (lang, bits, n_bytes, good); two rows of totals reach the driver."""
    good = scores.where("good")
    total = good.agg(F.sum("bits").alias("bits"), F.sum(F.col("n_bytes") - 1).alias("n")).first()
    mean = total["bits"] / total["n"] if total["n"] else 8.0
    limits = Limits(scores, (float("-inf"), float("inf")), mean, prior)
    value = limits.score("bits", "n_bytes")
    ends = F.percentile_approx(value, F.array(F.lit(low), F.lit(0.5), F.lit(quantile)), 10_000)
    q = F.col("q")
    columns = [F.least(2 * q[0] - q[1], F.lit(mean)).alias("low"), q[2].alias("limit")]
    table = materialized(good.groupBy("lang").agg(ends.alias("q")).select("lang", *columns), "lm-quantiles")
    bad = scores.where("NOT good").select(F.col("lang").alias("bad_lang"), value.alias("value"))
    limit = F.coalesce((F.col("limit") + F.col("next")) / 2, F.col("limit")).alias("limit")
    beyond = bad.join(table, F.col("bad_lang").eqNullSafe(F.col("lang"))).where("value > limit").groupBy("bad_lang").agg(F.min("value").alias("next"))
    limits.table = materialized(table.join(beyond, F.col("lang").eqNullSafe(F.col("bad_lang")), "left").select("lang", "low", limit), "lm-limits")
    overall = good.agg(ends.alias("q")).select(*columns).first()
    if overall["limit"] is not None:
        further = bad.where(F.col("value") > overall["limit"]).agg(F.min("value").alias("next")).first()["next"]
        limits.overall = (overall["low"], overall["limit"] if further is None else (overall["limit"] + further) / 2)
    return limits


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(id) of the documents labelled as good."""
    return labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("id"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = 0.99,
    low: float = 0.001,
    prior: int = 128,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    order: int = ORDER,
) -> DataFrame:
    """``docs`` with bits, n_bytes, the shrunk bits per byte as ``score``, its ``limit`` and ``kept``."""
    added = ["bits", "n_bytes", "score", "limit", "kept"]
    docs = docs.select(*[c for c in docs.columns if c not in added])
    dealt = deal(docs, text)
    asked = count_grams(dealt, trusted_ids(labels), doc_id, order)
    model = fit_model(asked, order)
    judged = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("quality") == 1).alias("good"))
    scored = score_texts(dealt, asked, model, order=order)
    numbers = scored.select(F.col(doc_id).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"), "bits", "n_bytes")
    known = materialized(numbers.join(judged.hint("merge"), "id").select("lang", "bits", "n_bytes", "good"), "lm-labelled")
    limits = fit_limits(known, quantile, low, prior)
    key, least, limit = (fresh_name(scored, x) for x in ("limit_lang", "limit_low", "limit"))
    table = limits.table.select(F.col("lang").alias(key), F.col("low").alias(least), F.col("limit").alias(limit))
    within = F.col("score").between(F.coalesce(F.col(least), F.lit(limits.overall[0])), F.col("limit"))
    return (
        scored.join(table, F.col(lang).cast("string").eqNullSafe(F.col(key)), "left")
        .withColumn("score", limits.score("bits", "n_bytes"))
        .withColumn("limit", F.coalesce(F.col(limit), F.lit(limits.overall[1])))
        .withColumn("kept", within | (F.col("n_bytes") == 1))
        .drop(key, least)
    )
