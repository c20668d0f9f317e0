"""Benchmark decontamination over a distributed positional inverted index.

The index holds one posting (term, document row, position) for each document word
that is an anchor term, together with the terms up to twelve positions before and
after it. Anchor terms come from the benchmark: in each window of ``width``
successive item words (or the whole of a shorter item) the term that is rarest
over all documents. Joining postings with anchors on the term and aligning both
by their offsets intersects the lists of the anchor's neighbours inside the
posting: the run of equal terms around it is an exact phrase match if it holds a
window, and the share of the item's neighbouring terms that occur nearby is the
proximity score. Each window has an anchor, so no phrase is missed.

Which words are looked at is decided by a bitmap of fixed size (2**24 bits), the only
broadcast thing. It lets through too much, never too little; the join on full
64-bit terms is exact whatever the size of the benchmark.

Cases: null text has no words; items without words match nothing; each row is a
document, also where doc_id repeats or is null; an item id that repeats is one
item that matches if any of its texts does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import empty_safe, materialized, slices, texts_of, words_of

SLOTS = 1 << 24
BUCKET_BITS = 32768

IS_WORD = np.zeros(256, bool)
IS_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = words_of(texts_of(batch["text"]), IS_WORD)
        terms = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(_signed(words.hashes)))
        yield pa.RecordBatch.from_arrays([batch["item_id"], terms], names=["item_id", "terms"])


def bitmap_of(terms: DataFrame) -> np.ndarray:
    """Which of ``SLOTS`` slots a column ``term`` fills; at most 2 MB reach the driver."""
    slot = F.col("term").bitwiseAND(F.lit(SLOTS - 1))
    rows = (
        terms.select((slot / BUCKET_BITS).cast("long").alias("bucket"), (slot % BUCKET_BITS).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = np.zeros(SLOTS // 8, np.uint8)
    for row in rows:
        at = row["bucket"] * (BUCKET_BITS // 8)
        out[at : at + BUCKET_BITS // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(SLOTS - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _count_terms(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            texts = texts_of(batch["text"])
            parts = []
            for a, b in slices(texts):
                hashes = words_of(texts[a:b], IS_WORD).hashes
                parts.append(hashes[_in_bitmap(bitmap, hashes)])
            terms, counts = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(terms)), pa.array(counts.astype(np.int64))], names=["term", "n"])

    return run


def _choose_anchors(width: int):
    reach = width - 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, terms, counts in zip(frame["item_id"], frame["terms"], frame["counts"], strict=True):
                terms, counts = np.asarray(terms, np.int64), np.asarray(counts, np.int64)
                size = min(width, len(terms))
                chosen = set()
                for start in range(len(terms) - size + 1):
                    window = np.lexsort((terms[start : start + size], counts[start : start + size]))
                    chosen.add(start + int(window[0]))
                padded = np.concatenate([np.zeros(reach, np.int64), terms, np.zeros(reach, np.int64)])
                for at in sorted(chosen):
                    rows.append((int(terms[at]), item, at, len(terms), padded[at : at + 2 * reach + 1].tobytes()))
            yield pd.DataFrame(rows, columns=["term", "item_id", "item_at", "item_words", "item_context"])

    return run


def _postings(shared, width: int):
    reach = width - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in slices(texts):
                words = words_of(texts[a:b], IS_WORD)
                lengths = np.diff(words.first)
                at = np.flatnonzero(_in_bitmap(bitmap, words.hashes))
                text = words.text[at]
                near = at[:, None] + np.arange(-reach, reach + 1)
                inside = (near >= words.first[text][:, None]) & (near < words.first[text + 1][:, None])
                contexts = np.where(inside, np.append(words.hashes, np.uint64(0))[np.where(inside, near, -1)], np.uint64(0))
                raw = contexts.astype("<u8").tobytes()
                step = 8 * (2 * reach + 1)
                postings = pa.StructArray.from_arrays(
                    [
                        pa.array(_signed(words.hashes[at])),
                        pa.array((at - words.first[text]).astype(np.int64)),
                        pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary()),
                    ],
                    names=["term", "at", "context"],
                )
                borders = np.searchsorted(text, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["row_id"].slice(a, b - a),
                        batch["doc_id"].slice(a, b - a),
                        pa.array(lengths.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(borders, pa.int32()), postings),
                    ],
                    names=["row_id", "doc_id", "n_words", "postings"],
                )

    return run


def _align(width: int):
    reach = width - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                n = batch.num_rows
                stack = lambda name, n=n, batch=batch: np.frombuffer(b"".join(batch[name].to_pylist()), "<u8").reshape(n, 2 * reach + 1)
                doc, item = stack("context"), stack("item_context")
                same = (doc == item) & (item != 0)
                left = np.cumprod(same[:, reach::-1], axis=1).sum(axis=1)  # equal terms up to and with the anchor
                right = np.cumprod(same[:, reach:], axis=1).sum(axis=1)
                at, item_at = batch["at"].to_numpy(), batch["item_at"].to_numpy()
                size = np.minimum(batch["item_words"].to_numpy(), width)
                left_all = np.minimum(left, np.where(size < width, item_at + 1, left))
                phrase = left_all + right - 1 >= size
                phrase &= left > 0
                shared = ((item[:, :, None] == doc[:, None, :]).any(axis=2) & (item != 0)).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["row_id"],
                        batch["item_id"],
                        pa.array(at - left_all + 1),
                        pa.array(at + right),
                        pa.array(phrase),
                        pa.array(shared / np.maximum(1, (item != 0).sum(axis=1))),
                    ],
                    names=["row_id", "item_id", "from_word", "to_word", "phrase", "proximity"],
                )

    return run


def index_and_matches(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id"
) -> tuple[DataFrame, DataFrame]:
    """The written index (row_id, doc_id, n_words, postings) and its alignments with the benchmark.

    An alignment has row_id, item_id, the equal words [from_word, to_word), ``phrase`` (they
    hold a window) and ``proximity`` (share of the item's terms within ``width`` - 1
    positions of the anchor that occur as near to the posting).
    """
    spark = docs.sparkSession
    items = materialized(
        benchmark.select(F.col(item_id).cast("long").alias("item_id"), empty_safe(F.col("text")).alias("text"))
        .mapInArrow(_item_terms, "item_id long, terms array<long>")
        .where(F.size("terms") > 0),
        "bench-terms",
    )
    places = items.select(F.xxhash64("item_id", "terms").alias("item"), "item_id", F.posexplode("terms").alias("at", "term"))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), empty_safe(F.col(text)).alias("text"))
    everywhere = spark.sparkContext.broadcast(bitmap_of(places.select("term")))
    counts = plain.select("text").mapInArrow(_count_terms(everywhere), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counted = (
        places.join(counts, "term", "left")
        .groupBy("item", "item_id")
        .agg(F.array_sort(F.collect_set(F.struct("at", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("all"))
        .select("item_id", F.col("all.term").alias("terms"), F.col("all.n").alias("counts"))
    )
    anchors = materialized(
        counted.mapInPandas(
            _choose_anchors(width), "term long, item_id long, item_at long, item_words long, item_context binary"
        ),
        "bench-anchors",
    )
    chosen = spark.sparkContext.broadcast(bitmap_of(anchors.select("term")))
    index = materialized(
        plain.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(
            _postings(chosen, width),
            "row_id long, doc_id long, n_words long, postings array<struct<term: long, at: long, context: binary>>",
        ),
        "bench-index",
    )
    lists = index.select("row_id", F.explode("postings").alias("p")).select("row_id", "p.*")
    matches = lists.join(anchors, "term").mapInArrow(
        _align(width), "row_id long, item_id long, from_word long, to_word long, phrase boolean, proximity double"
    )
    return index, matches


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, min_share: tuple[int, int] = (1, 20), text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per document: n_words, n_hit, the items with occurring windows, and the verdict.

    ``contaminated`` holds if the words inside phrase matches are at least ``min_share`` (a fraction) of all.
    """
    index, matches = index_and_matches(docs, benchmark, width, text, doc_id)
    steps = F.aggregate(
        F.array_sort(F.collect_set(F.struct("from_word", "to_word"))),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end")),
        lambda acc, x: F.struct(
            (acc["sum"] + F.greatest(F.lit(0), x["to_word"] - F.greatest(x["from_word"], acc["end"]))).alias("sum"),
            F.greatest(acc["end"], x["to_word"]).alias("end"),
        ),
    )
    found = (
        matches.where("phrase")
        .groupBy("row_id")
        .agg(steps["sum"].alias("n_hit"), F.collect_set("item_id").alias("items"))
    )
    empty = F.array().cast("array<long>")
    return (
        index.select("row_id", "doc_id", "n_words")
        .join(found, "row_id", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", empty).alias("items"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * min_share[1] >= F.col("n_words") * min_share[0]))
    )
