"""The registered queries of the subpackage, one per operator, and their SQL twins."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import vector_codes
from pairlens.llm.bpe import encode_texts
from pairlens.llm.common import materialized
from pairlens.llm.decontaminate import contamination
from pairlens.llm.html_extract import main_text
from pairlens.llm.line_dedup import drop_frequent_lines
from pairlens.llm.near_dedup import near_duplicates
from pairlens.llm.periodic_runs import collapse_runs, repeat_tails
from pairlens.llm.phrase_dedup import remove_phrases
from pairlens.llm.quality_lm import classify
from pairlens.llm.quality_rules import judge_quality
from pairlens.llm.suffix_dedup import remove_repeats
from pairlens.llm.surrogates import replace_entities
from pairlens.llm.token_counts import count_tokens


VOCABULARY = "byte_bpe_50k.tiktoken"
#: Stands for a secret of the deployment.
SURROGATE_KEY = "example key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten documents hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_frequent_lines(docs, min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key)
GROUP BY doc_id
"""

def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are similar by 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, ratio=(85, 100))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens, tokens and cost of each document under the unigram model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).drop("text")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced by keyed surrogates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, key=SURROGATE_KEY)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the bytes decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_texts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, decoded="decoded")
    return out.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per byte of each document under the trusted text's model, and the verdict."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = classify(docs.select("doc_id", "lang", "text"), labels)
    return out.select("doc_id", "lang", "bits", "n_bytes", "score", "limit", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of each document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = judge_quality(docs.select("doc_id", "text"), labels)
    return out.drop("text")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 50-byte strings of earlier documents."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words that 13-word windows of benchmark items cover."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return contamination(docs, items, width=13).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw
), hits AS (
  SELECT doc_id, i, g.n, item_id
  FROM (SELECT doc_id, s.n, i, array_to_string(w[i : i + s.n - 1], ' ') AS gram
        FROM d, sizes s, unnest(range(1, len(w) - s.n + 2)) AS t(i)) g
  JOIN bw USING (n, gram)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors under codebooks trained in four rounds, with the errors of their label."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = materialized(vector_codes.integer_vectors(vectors, "embedding", keep=["vec_id", "label"]), "vectors")
    books = vector_codes.train_codebooks(rows)
    coded = materialized(vector_codes.encode_vectors(rows, books), "vector-codes")
    return vector_codes.with_group_total(coded, "label", "error", "label_error").select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        F.col("label_error").cast("long"),
        F.lit(hashlib.sha256(books.text().encode()).hexdigest()).alias("codebooks_sha256"),
    )


def _op11_sql() -> str:
    """Rounds unrolled: each assigns all parts by squared distance and floors the means."""
    rounds = []
    for k in range(5):
        rounds.append(f"""
near{k} AS (
  SELECT r, part, min_by(entry, gap * 256 + entry) AS entry, min(gap) AS gap
  FROM (SELECT v.r, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS gap
        FROM v JOIN book{k} b USING (part, pos) GROUP BY v.r, v.part, b.entry)
  GROUP BY r, part
)""")
        if k < 4:
            rounds.append(f"""
book{k + 1} AS (
  SELECT part, entry, pos, coalesce(m.x, b.x) AS x
  FROM book{k} b LEFT JOIN (
    SELECT part, entry, pos, CAST((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM v JOIN near{k} USING (r, part) GROUP BY part, entry, pos) m USING (part, entry, pos)
)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL
    AND list_count(embedding) = len(embedding) AND isfinite(list_min(embedding)) AND isfinite(list_max(embedding))
), v AS (
  SELECT r, i // (n // 4) AS part, i % (n // 4) AS pos, CAST(floor(1024 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, embedding, len(embedding) AS n, unnest(range(len(embedding))) AS i FROM kept)
), book0 AS (SELECT part, r AS entry, pos, x FROM v WHERE r < 256
),{",".join(rounds)},
coded AS (
  SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(gap) AS BIGINT) AS error FROM near4 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book4) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


OP11_SQL = _op11_sql()


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 13-word passages of earlier documents."""
    out = remove_phrases(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS gram FROM d, unnest(range(1, len(w) - 11)) AS t(i)
), first AS (
  SELECT gram, min(doc_id) AS owner FROM g GROUP BY gram HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM g JOIN first USING (gram) WHERE owner < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
  FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of each document, the longest one, and the text without its repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = collapse_runs(repeat_tails(docs), min_length=12)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -F.col("longest.size")
    return out.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(1000 * length / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_html_extract": op4_html_extract,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_lm": op7_quality_lm,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_vector_codes": op11_vector_codes,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_substring_dedup": OP12_SQL,
}
