"""Quality rules: base counts, and a calibrated logistic regression on hashed n-grams.

The features of a text are the relative frequencies of its words and pairs of words, and of its
3-grams of code points, in ``DIMENSIONS`` hashed slots each, so a score is a mean of weights and
needs two look-ups per word and one per character. No n-gram reaches over a text's end. The model is fitted on at most ``sample``
labelled rows (those of smallest hashed id) that pass the base rules, with every
fifth one held out to calibrate the probability. A document is kept if it passes the
base rules and its probability of good quality is at least ``threshold``.

Cases: null text has no words and fails; without labels of both kinds every
document's probability is 1; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import empty_safe, fresh_name, mix, nonspace_table, slices, texts_of, windows_hash, with_columns, words_of

DIMENSIONS = 1 << 13
REPEAT_WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

NONSPACE = nonspace_table()
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    words = words_of(texts, NONSPACE, lower=False)
    at = words.offsets
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    head = (words.buffer & 0xC0) != 0x80
    windows = windows_hash(words.hashes, REPEAT_WINDOW)
    inside = words.text[: len(windows)] == words.text[REPEAT_WINDOW - 1 :] if len(windows) else np.zeros(0, bool)
    starts = np.flatnonzero(inside)
    order = np.lexsort((windows[starts], words.text[starts]))
    ranked, owner = windows[starts][order], words.text[starts][order]
    equal = (ranked[1:] == ranked[:-1]) & (owner[1:] == owner[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    cover = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(cover, starts[order][twice], 1)
    np.add.at(cover, starts[order][twice] + REPEAT_WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    return {
        "n_words": np.diff(words.first).astype(np.int64),
        "word_chars": per_text(NONSPACE[words.buffer] & head).astype(np.int64),
        "n_symbols": per_text(SYMBOL[words.buffer]).astype(np.int64),
        "n_dup_lines": np.array([_repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": np.diff(covered[words.first]).astype(np.int64),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def feature_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of single words and pairs, and of 3-grams of code points, each with the text they lie in as a whole."""
    words = words_of(texts, NONSPACE, lower=False)
    both = words.text[:-1] == words.text[1:]
    pairs = mix(words.hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + words.hashes[1:])[both]
    slots = (np.concatenate([words.hashes, pairs]) & np.uint64(DIMENSIONS - 1)).astype(np.int64)
    plain = [t.decode("utf-8", "replace") for t in texts]
    points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in plain])
    inside = text[:-2] == text[2:]
    grams = mix((points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:])[inside]
    grams = (grams & np.uint64(DIMENSIONS - 1)).astype(np.int64) + DIMENSIONS
    return slots, np.concatenate([words.text, words.text[:-1][both]]), grams, text[:-2][inside]


def linear_scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Mean weight of the words and pairs plus mean weight of the 3-grams; a text's score does not depend on the others."""
    out = np.zeros(len(texts))
    slots = feature_slots(texts)
    for at, text in (slots[:2], slots[2:]):
        n = np.bincount(text, minlength=len(texts))
        out += np.bincount(text, weights[at], minlength=len(texts)) / np.maximum(1, n)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse features of the labelled rows that pass the base rules."""
    for batch in batches:
        texts = texts_of(batch["text"])
        for a, b in slices(texts):
            part = texts[a:b]
            failed = base_failed(base_counts(part))
            slots = feature_slots(part)
            packed = []
            for i in range(len(part)):
                own = [s[t == i] for s, t in (slots[:2], slots[2:])]
                ids = [np.unique(s, return_counts=True) for s in own]
                pairs = [np.stack([u, c / max(1, c.sum())]) for u, c in ids]
                packed.append(np.concatenate(pairs, axis=1).astype("<f4").tobytes())
            keep = pa.array(~failed)
            rows = pa.RecordBatch.from_arrays(
                [batch["rank"].slice(a, b - a), batch["label"].slice(a, b - a), pa.array(packed, pa.binary())],
                names=["rank", "label", "features"],
            )
            yield rows.filter(keep)


def fit_logistic(rows: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, dims: int, l2: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression, by Adam on all rows, classes weighted alike."""
    n = len(y)
    side = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, x * w[at], minlength=n) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * side
        gradient = np.append(np.bincount(at, x * error[rows], minlength=dims), error.sum())
        gradient[:-1] += l2 * w[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def calibrated(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through held-out scores, by Newton steps with a weak prior."""
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * c])
        h = p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-2]])
        move = np.linalg.solve(hess, g)
        a, c = a - np.clip(move[0], -1, 1), c - np.clip(move[1], -1, 1)
    return float(max(a, 1e-3)), float(c)


def _train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    data = pd.concat([f for f in frames if len(f)] or [pd.DataFrame({"rank": [], "label": [], "features": []})])
    data = data.sort_values("rank", kind="stable").reset_index(drop=True)
    y = data["label"].to_numpy(float)
    dims = 2 * DIMENSIONS
    if not 0 < y.sum() < len(y):
        yield pd.DataFrame({"weights": [np.append(np.zeros(dims), 30.0).astype("<f8").tobytes()]})
        return
    parts = [np.frombuffer(f, "<f4").reshape(2, -1) for f in data["features"]]
    rows = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
    both = np.concatenate(parts, axis=1)
    at, x = both[0].astype(np.int64), both[1].astype(float)
    held = np.arange(len(y)) % 5 == 4
    fit = ~held[rows]
    number = np.cumsum(~held) - 1
    w = fit_logistic(number[rows[fit]], at[fit], x[fit], y[~held], dims)
    z = np.bincount(rows, x * w[at], minlength=len(y)) + w[-1]
    if 0 < y[held].sum() < held.sum():
        a, c = calibrated(z[held], y[held])
        w = np.append(a * w[:-1], a * w[-1] + c)
    yield pd.DataFrame({"weights": [w.astype("<f8").tobytes()]})


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 2000, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> np.ndarray:
    """Calibrated weights from at most ``sample`` labelled rows; one row of 128 KB reaches the driver."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .withColumn("rank", F.xxhash64("id"))
        .orderBy("rank", "label")
        .limit(sample)
    )
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), empty_safe(F.col(text)).alias("text")).join(F.broadcast(chosen), "id")
    features = rows.select("rank", "label", "text").mapInArrow(_features, "rank long, label int, features binary")
    packed = features.repartition(1).mapInPandas(_train, "weights binary")
    return np.frombuffer(bytes(packed.collect()[0]["weights"]), "<f8")


def _judge(weights: np.ndarray, threshold: float, text: str, names: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = texts_of(whole[text])
            for a, b in slices(texts):
                part = texts[a:b]
                counts = base_counts(part)
                failed = base_failed(counts)
                p = 1 / (1 + np.exp(-np.clip(linear_scores(part, weights[:-1]) + weights[-1], -30, 30)))
                columns = {names[c]: pa.array(counts[c]) for c in COUNTS}
                columns |= {
                    names["base_failed"]: pa.array(failed),
                    names["probability"]: pa.array(p),
                    names["kept"]: pa.array(~failed & (p >= threshold)),
                }
                yield with_columns(whole.slice(a, b - a), columns)

    return run


def judge_quality(docs: DataFrame, labels: DataFrame, sample: int = 2000, threshold: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the base counts, base_failed, the calibrated probability of good quality, and kept."""
    weights = fit_quality(docs, labels, sample, text, doc_id)
    added = [*COUNTS, "base_failed", "probability", "kept"]
    rows = docs.select(*[c for c in docs.columns if c not in added]).withColumn(text, empty_safe(F.col(text)))
    names = {n: fresh_name(rows, n) for n in added}
    schema = T.StructType(list(rows.schema.fields))
    for n in added:
        schema = schema.add(names[n], "boolean" if n in ("base_failed", "kept") else "double" if n == "probability" else "long")
    return rows.mapInArrow(_judge(weights, threshold, text, names), schema)
