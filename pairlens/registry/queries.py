"""Registered queries: one per operator, each over whole given tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens import fixtures as fx
from pairlens.fixtures import TRAITS
from pairlens.functions.hashing import uniform32
from pairlens.functions.numeric import general_format
from pairlens.functions.text import text_hash, word_ids
from pairlens.operators import associate, calibrate, checks, ordering, pairs, quality
from pairlens.operators import resample, scan, scores, selection
from pairlens.plans.reproduce import reproduction_gates as gates_of
from pairlens.plans.reproduce import study
from pairlens.plans.score_file import score_file
from pairlens.plans.summarize import matrix_family, summarize
from pairlens.plans.validate import observed_facts, validate_bundle
from pairlens.registry.settings import (
    COLUMN,
    DRAWS,
    EOS,
    EOS_ID,
    LEAF,
    LANGS,
    MAX_TOKENS,
    NAMED,
    PLANTED_LINES,
    REPLICATES,
    REVISION,
    SCAN_PATTERNS,
    SEED,
)
from pairlens.session import materialized, scratch_path, tune
from pairlens.sources import files as sf
from pairlens.sources.sinks import matrix_wide, write_report, write_scores
from pairlens.sources.tables import read_manifest, read_pairs, read_scores, score_files
from pairlens.vocabulary import FORMULAS, delta_column

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(query: Query) -> Query:
    @functools.wraps(query)
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark), sf_dir)

    REGISTRY[query.__name__] = tuned
    return tuned


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def _stats(spark: SparkSession, sf_dir: str, formulas=FORMULAS) -> DataFrame:
    return scores.group_stats(fx.lineitem_scores(spark, sf_dir), TRAITS, formulas)


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.score_cube(_stats(spark, sf_dir), TRAITS)


def _primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated cells of the primary variant; needs no prompt groups."""
    base = fx.lineitem_scores(spark, sf_dir)
    cube = scores.aggregate_scores(base, TRAITS, "row", ["sum"])
    return calibrate.calibrate(cube).select("c", "t", F.col("z").alias("value"))


# --- formulas, groups, cube -------------------------------------------------


@register
def flagship(spark, sf_dir):
    """Score rows to one off-diagonal correlation with the target."""
    target = fx.quantity_target(spark, sf_dir)
    r = associate.off_diagonal_association(_primary(spark, sf_dir), target, TRAITS)
    return rounded(r, 9, "r")


@register
def score_rows(spark, sf_dir):
    wide = scores.with_scores(fx.lineitem_scores(spark, sf_dir), TRAITS)
    deltas = [delta_column(f, a) for f in FORMULAS for a in TRAITS]
    return wide.select("dataset_trait", "row_key", *deltas)


@register
def scores_long(spark, sf_dir):
    base = fx.lineitem_scores(spark, sf_dir)
    return scores.scores_long(base, TRAITS, ["dataset_trait", "row_key"])


@register
def group_stats(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    names = [n for n in stats.columns if n.startswith("sum_")]
    return rounded(stats, 6, *names)


@register
def cube_row_mean(spark, sf_dir):
    base = fx.lineitem_scores(spark, sf_dir)
    return rounded(scores.aggregate_scores(base, TRAITS, "row"), 9, "value")


@register
def cube_prompt_mean(spark, sf_dir):
    base = fx.lineitem_scores(spark, sf_dir)
    return rounded(scores.aggregate_scores(base, TRAITS, "prompt"), 9, "value")


@register
def score_cube(spark, sf_dir):
    return rounded(_cube(spark, sf_dir), 9, "value")


# --- calibration ------------------------------------------------------------


@register
def calibrate_all(spark, sf_dir):
    cells = calibrate.calibrate(_cube(spark, sf_dir), "all")
    return rounded(rounded(cells, 9, "value"), 8, "mean", "population_sd", "z")


@register
def calibrate_loo(spark, sf_dir):
    cells = calibrate.calibrate(_cube(spark, sf_dir), "leave_one_dataset_out")
    return rounded(rounded(cells, 9, "value"), 6, "mean", "population_sd", "z")


@register
def calibration_params(spark, sf_dir):
    params = calibrate.calibration_params(_cube(spark, sf_dir), "all")
    return rounded(params, 8, "mean", "population_sd")


@register
def calibration_params_loo(spark, sf_dir):
    params = calibrate.calibration_params(_cube(spark, sf_dir), "leave_one_dataset_out")
    return rounded(params, 6, "mean", "population_sd")


@register
def matrix_pivot(spark, sf_dir):
    cells = calibrate.calibrate(_cube(spark, sf_dir), "all")
    wide = matrix_wide(cells, TRAITS, "z", ["formula", "weighting"])
    return rounded(wide, 8, *TRAITS)


@register
def matrix_text(spark, sf_dir):
    """Target cells as matrix text: whole and half quantities survive formatting exactly."""
    target = fx.quantity_target(spark, sf_dir)
    return target.select("c", "t", general_format(F.col("e") / 8).alias("text"))


@register
def matrix_files(spark, sf_dir):
    """The whole file family is written; its cells are returned."""
    base = fx.lineitem_scores(spark, sf_dir)
    return rounded(summarize(base, scratch_path(spark, "family"), TRAITS), 8, "value")


# --- association ------------------------------------------------------------


@register
def align(spark, sf_dir):
    target = fx.quantity_target(spark, sf_dir)
    return rounded(associate.align(_primary(spark, sf_dir), target, TRAITS), 8, "s", "e")


@register
def off_diagonal(spark, sf_dir):
    target = fx.quantity_target(spark, sf_dir)
    aligned = associate.align(_primary(spark, sf_dir), target, TRAITS)
    return rounded(associate.off_diagonal(aligned), 8, "s", "e")


def _raw_variants(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    target = fx.quantity_target(spark, sf_dir)
    by = ["formula", "weighting"]
    return associate.off_diagonal_association(
        _cube(spark, sf_dir), target, TRAITS, by, method=method
    )


@register
def assoc_pearson(spark, sf_dir):
    return rounded(_raw_variants(spark, sf_dir, "pearson"), 9, "r")


@register
def assoc_spearman(spark, sf_dir):
    return rounded(_raw_variants(spark, sf_dir, "spearman"), 9, "r")


def _columns(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    target = fx.quantity_target(spark, sf_dir)
    by = ["formula", "weighting"]
    calibrated = calibrate.calibrate(_cube(spark, sf_dir))
    return associate.column_association(calibrated, target, TRAITS, by, "z", method)


@register
def column_assoc(spark, sf_dir):
    return rounded(_columns(spark, sf_dir, "pearson"), 8, "r")


@register
def column_assoc_spearman(spark, sf_dir):
    return rounded(_columns(spark, sf_dir, "spearman"), 8, "r")


@register
def predicted_rank(spark, sf_dir):
    ranks = associate.predicted_rank(_primary(spark, sf_dir))
    return rounded(ranks, 8, "value")


@register
def sensitivity_grid(spark, sf_dir):
    target = fx.quantity_target(spark, sf_dir)
    return rounded(associate.sensitivity_grid(_cube(spark, sf_dir), target, TRAITS), 8, "r")


# --- resampling -------------------------------------------------------------


def _bootstrap(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    cells = resample.bootstrap_groups(_stats(spark, sf_dir), TRAITS, REPLICATES, SEED, method, leaf_groups=LEAF)
    # Moved off the decimal ties that means of dyadic sums often are, which engines round either way.
    return rounded(cells.withColumn("value", F.col("value") + F.lit(3e-10)), 9, "value")


@register
def bootstrap_multinomial(spark, sf_dir):
    return _bootstrap(spark, sf_dir, "multinomial")


@register
def bootstrap_split(spark, sf_dir):
    return _bootstrap(spark, sf_dir, "split")


@register
def bootstrap_poisson(spark, sf_dir):
    return _bootstrap(spark, sf_dir, "poisson")


@register
def bootstrap_associations(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    target = fx.quantity_target(spark, sf_dir)
    cells = resample.bootstrap_groups(stats, TRAITS, REPLICATES, SEED)
    return rounded(resample.bootstrap_associations(cells, target, TRAITS), 8, "r")


def _interval(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    stats = _stats(spark, sf_dir, ["sum"])
    target = fx.quantity_target(spark, sf_dir)
    found = resample.bootstrap_interval(stats, TRAITS, target, REPLICATES, SEED, method)
    return rounded(found, 8, "low", "high")


@register
def bootstrap_interval(spark, sf_dir):
    return _interval(spark, sf_dir, "multinomial")


@register
def bootstrap_interval_poisson(spark, sf_dir):
    return _interval(spark, sf_dir, "poisson")


@register
def perm_draws(spark, sf_dir):
    """The target row that every draw puts against each score row, with that row's total."""
    target = fx.quantity_target(spark, sf_dir)
    source = spark.range(DRAWS).withColumnRenamed("id", "draw")
    placed = resample.permutation_draws(source, TRAITS, SEED)
    rows = target.groupBy(F.col("c").alias("source")).agg(F.sum("e").alias("total"))
    return placed.join(F.broadcast(rows), "source").select("draw", "c", "source", "total")


@register
def perm_null(spark, sf_dir):
    target = fx.quantity_target(spark, sf_dir)
    null = resample.row_block_permutation(
        _primary(spark, sf_dir), target, TRAITS, DRAWS, SEED
    )
    return rounded(null, 9, "r")


@register
def perm_pvalue(spark, sf_dir):
    target = fx.quantity_target(spark, sf_dir)
    tested = resample.permutation_test(_primary(spark, sf_dir), target, TRAITS, DRAWS, SEED)
    return rounded(tested, 9, "observed", "p_one_sided", "p_two_sided")


@register
def headline_study(spark, sf_dir):
    """All metrics of the study, resampling included."""
    metrics = study(
        fx.lineitem_scores(spark, sf_dir),
        fx.quantity_target(spark, sf_dir),
        TRAITS,
        COLUMN,
        NAMED,
        REPLICATES,
        DRAWS,
        SEED,
    )
    return rounded(metrics, 8, "value")


@register
def reproduction_gates(spark, sf_dir):
    """Every gate of the study: targets at two decimals, ranks, points, and matrices of which one is off and one has a cell less."""
    base, target = fx.lineitem_scores(spark, sf_dir), materialized(fx.quantity_target(spark, sf_dir), "target")
    metrics = materialized(study(base, target, TRAITS, COLUMN, NAMED, REPLICATES, DRAWS, SEED), "metrics")
    family = materialized(matrix_family(scores.score_cube(scores.group_stats(base, TRAITS), TRAITS)), "family")
    targets = metrics.where("metric NOT LIKE '%rank'").select(
        "metric", F.round("value", 2).alias("target"), F.lit(0.0025).alias("tolerance")
    )
    point = (F.col("c") == "t0") & (F.col("t") == "t1")
    off = point & (F.col("kind") == "raw") & (F.col("formula") == "lls") & (F.col("weighting") == "row")
    fewer = point & (F.col("scheme") == "all") & (F.col("formula") == "sum") & (F.col("weighting") == "row")
    expected = family.withColumn("value", F.col("value") + F.when(off, 1e-6).otherwise(0.0)).where(~fewer)
    right = target.where("c = 't0' AND t = 't2'").first()["e"]
    found = gates_of(
        metrics, targets, {"column_rank": range(1, 10), "column_raw_rank": [0], "absent": [1]},
        target, {("t0", "t1"): 1.0, ("t0", "t2"): right}, family, expected,
    )
    return rounded(found, 8, "value")


# --- data quality -----------------------------------------------------------


def _planted_checks(spark: SparkSession, sf_dir: str, check: str, columns=None) -> DataFrame:
    planted = fx.planted_scores(spark, sf_dir, REVISION)
    if columns:
        planted = planted.select("file_dataset", *columns)
    revision = REVISION if not columns or "source_revision" in columns else None
    expected = "file_dataset" if not columns or "dataset_trait" in columns else None
    found = quality.row_checks(planted, TRAITS, revision, "file_dataset", expected)
    return found.where(F.col("check").isin(check.split(",")))


@register
def dq_columns(spark, sf_dir):
    """Closed-schema findings on the given tables, from their footers."""
    files = score_files(spark, sf_dir)
    footers = sf.parquet_footers(files).join(files.select("path", "dataset"), "path")
    found = quality.schema_checks(footers, TRAITS)
    return found.select("dataset", "check", "detail", "n_bad")


@register
def dq_identity(spark, sf_dir):
    found = _planted_checks(
        spark, sf_dir, "dataset_name,source_revision", ["dataset_trait", "source_revision"]
    )
    return found.drop("max_error")


@register
def dq_hashes(spark, sf_dir):
    return _planted_checks(spark, sf_dir, "hash", ["prompt_hash"]).drop("max_error")


@register
def dq_lengths(spark, sf_dir):
    names = ["prompt_tokens", "chosen_response_tokens", "rejected_response_tokens"]
    return _planted_checks(spark, sf_dir, "length", names).drop("max_error")


@register
def dq_finite(spark, sf_dir):
    return _planted_checks(spark, sf_dir, "finite").drop("max_error")


@register
def dq_roundtrip(spark, sf_dir):
    return _planted_checks(spark, sf_dir, "roundtrip")


@register
def dq_unique(spark, sf_dir):
    base = fx.lineitem_scores(spark, sf_dir)
    found = quality.unique_checks(quality.duplicate_ids(base, "row_key"))
    return found.select("dataset", "check", "n_bad")


@register
def dq_unique_offenders(spark, sf_dir):
    return quality.duplicate_ids(fx.lineitem_scores(spark, sf_dir), "row_key")


@register
def dq_row_counts(spark, sf_dir):
    base = fx.lineitem_scores(spark, sf_dir)
    counts = quality.row_counts(base, [*TRAITS, "absent"])
    return counts.join(quality.empty_checks(counts).select("dataset", "n_bad"), "dataset")


@register
def dq_report(spark, sf_dir):
    planted = fx.planted_scores(spark, sf_dir, REVISION)
    found = quality.row_checks(planted, TRAITS, REVISION, "file_dataset", "file_dataset")
    counts = quality.row_counts(planted, TRAITS, "file_dataset")
    return quality.dataset_report(found, counts)


@register
def dq_manifest(spark, sf_dir):
    """A manifest of the given tables, wrong in places, against their footers."""
    files = score_files(spark, sf_dir)
    facts, _ = observed_facts(files)
    name = F.col("dataset")
    manifest = facts.select(
        "dataset",
        F.when(name == "nation", F.col("rows") + 1).otherwise(F.col("rows")).alias("rows"),
        F.when(name == "region", F.lit(0)).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(name == "part", F.lit("0")).otherwise(F.col("sha256")).alias("sha256"),
        F.when(name != "orders", F.lit(False)).alias("contains_raw_text"),
        F.when(name == "events", F.lit(float("nan")))
        .otherwise(F.lit(0.0))
        .alias("formula_round_trip_max_abs_error"),
    ).where("dataset != 'labels'")
    found = quality.manifest_checks(manifest, facts.where("dataset != 'pages'"))
    return found.select("dataset", "check", "n_bad")


def _bundle_report(spark: SparkSession, sf_dir: str, text_root: str | None = None):
    """Write a bundle and its manifest, then validate the files."""
    path = scratch_path(spark, "bundle")
    table = fx.bundle_scores(spark, sf_dir, REVISION)
    broken = F.when(F.col("dataset_trait") == "t3", F.lit("unpinned")).otherwise(REVISION)
    off = F.when(F.col("dataset_trait") == "t7", F.lit(0.25)).otherwise(F.lit(0.0))
    table = table.withColumns(
        {"source_revision": broken, "delta_sum_t0": F.col("delta_sum_t0") + off}
    )
    write_scores(table, f"{path}/logprobs")
    facts, _ = observed_facts(score_files(spark, path))
    entries = facts.select(
        F.col("dataset").alias("trait"),
        "rows",
        "size_bytes",
        "sha256",
        F.lit(False).alias("contains_raw_text"),
        F.lit(0.0).alias("formula_round_trip_max_abs_error"),
    )
    # One entry per dataset, so the list is as short as the vocabulary.
    listed = entries.agg(F.to_json(F.collect_list(F.struct(*entries.columns))).alias("value"))
    listed.coalesce(1).write.text(f"{path}/manifest")
    return validate_bundle(spark, path, TRAITS, TRAITS, f"{path}/manifest", REVISION, text_root)


@register
def dq_bundle(spark, sf_dir):
    return _bundle_report(spark, sf_dir).datasets.drop("size_bytes", "sha256")


@register
def dq_bundle_totals(spark, sf_dir):
    """Totals of the same bundle, two datasets of which fail, beside texts with findings."""
    texts = scratch_path(spark, "texts")
    fx.write_order_files(spark, sf_dir, texts)
    totals = _bundle_report(spark, sf_dir, texts).totals
    return totals.drop("total_bytes")


@register
def dq_file_schemas(spark, sf_dir):
    """Footer checks on files of which t2 hides text in its metadata, t4 says so, and t6 has a type of its own."""
    path = scratch_path(spark, "schemas")
    base = fx.lineitem_scores(spark, sf_dir)
    key = F.col("row_key")
    own = {
        "t2": key.alias("row_key", metadata={"note": {"response_text": "hidden"}}),
        "t4": key.alias("row_key", metadata={"contains_raw_text": True}),
        "t5": key.alias("row_key", metadata={"contains_raw_text": False}),
        "t6": key.cast("double").alias("row_key"),
    }
    rest = [c for c in base.columns if c != "row_key"]
    write_scores(base.where(~F.col("dataset_trait").isin(list(own))).select("row_key", *rest), f"{path}/logprobs")
    for name, column in own.items():
        some = base.where(F.col("dataset_trait") == name).select(column, *rest)
        some.write.parquet(f"{path}/logprobs/file_dataset={name}")
    files = score_files(spark, path)
    footers = materialized(sf.parquet_footers(files).join(files.select("path", "dataset"), "path"), "footers")
    found = quality.schema_agreement(footers, TRAITS).unionByName(
        quality.metadata_checks(footers.select("dataset", F.inline("entries")))
    )
    return found.select("dataset", "check", (F.col("n_bad") > 0).alias("failed"))


# --- sources and sinks ------------------------------------------------------


@register
def source_scores(spark, sf_dir):
    """Score files written and read back, aggregated by the file's dataset."""
    path = scratch_path(spark, "scores")
    write_scores(fx.bundle_scores(spark, sf_dir, REVISION), path)
    table = read_scores(spark, path, TRAITS, TRAITS)
    return table.groupBy("file_dataset", "dataset_trait").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("base_chosen_logprob").alias("base_chosen"),
        F.sum("delta_sum_t0").alias("delta_sum_t0"),
    )


@register
def source_pairs(spark, sf_dir):
    """Pairs written as JSON lines, parsed back and validated."""
    path = scratch_path(spark, "pairs")
    messages = fx.conversation_messages(spark, sf_dir)
    named = messages.select(F.col("conv_id").alias("row_id"), "chosen", "rejected")
    named.write.json(path)
    checked = pairs.validate_pairs(read_pairs(spark, path))
    return checked.select(
        "row_id",
        "reason",
        F.size("chosen").alias("chosen_messages"),
        F.size("rejected").alias("rejected_messages"),
    )


@register
def source_file_facts(spark, sf_dir):
    files = sf.list_files(spark, sf_dir, "*.parquet")
    facts = sf.file_facts(files)
    name = F.element_at(F.split("path", "/"), -1)
    return facts.select(name.alias("name"), "length", "sha256")


@register
def source_file_digests(spark, sf_dir):
    """Size, digest and tree digest of text files written from the orders."""
    path = scratch_path(spark, "files")
    fx.write_order_files(spark, sf_dir, path)
    files = sf.list_files(spark, path, "*.txt")
    facts = sf.file_facts(files).join(sf.tree_digests(files, range_bytes=1024, fanout=4), "path")
    part = F.regexp_extract("path", "part=([0-9]+)", 1).cast("long")
    return facts.select(part.alias("part"), "length", "sha256", "chunks", "tree_sha256")


@register
def source_dataset_digests(spark, sf_dir):
    """Digests of datasets of several of these files, and of one."""
    path = scratch_path(spark, "files")
    fx.write_order_files(spark, sf_dir, path)
    part = F.regexp_extract("path", "part=([0-9]+)", 1).cast("long")
    facts = sf.file_facts(sf.list_files(spark, path, "*.txt"))
    dataset = F.when(part == 0, "first").otherwise(F.concat(F.lit("d"), (part % 3).cast("string")))
    return sf.dataset_digests(facts.withColumn("dataset", dataset))


@register
def source_footers(spark, sf_dir):
    files = score_files(spark, sf_dir)
    footers = sf.parquet_footers(files).join(files.select("path", "dataset"), "path")
    columns = F.size(F.from_json("schema_json", "array<array<string>>"))
    return footers.select("dataset", "rows", columns.alias("columns"))


@register
def source_footer_metadata(spark, sf_dir):
    files = sf.list_files(spark, sf_dir, "*.parquet")
    entries = sf.footer_metadata(files)
    name = F.element_at(F.split("path", "/"), -1)
    return entries.select(name.alias("name"), "key", "nested_key", "value_json")


@register
def source_text_lines(spark, sf_dir):
    lines = sf.text_lines(fx.table(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.select("doc_id", "line_number", F.sha2("line", 256).alias("line_hash"))


@register
def source_manifest(spark, sf_dir):
    """A manifest in map form written from the tables and read back."""
    path = scratch_path(spark, "manifest")
    counts = quality.row_counts(fx.lineitem_scores(spark, sf_dir), TRAITS)
    entries = F.map_from_entries(
        F.collect_list(
            F.struct(
                "dataset",
                F.struct(
                    "rows",
                    (F.col("rows") * 8).alias("size_bytes"),
                    F.sha2("dataset", 256).alias("sha256"),
                    F.lit(False).alias("contains_raw_text"),
                    F.lit(0.0).alias("formula_round_trip_max_abs_error"),
                ),
            )
        )
    )
    whole = counts.agg(F.to_json(F.struct(entries.alias("datasets"))).alias("value"))
    whole.coalesce(1).write.text(path)
    return read_manifest(spark, path, TRAITS)


@register
def sink_report(spark, sf_dir):
    """Calibration parameters written as JSON and read back."""
    path = scratch_path(spark, "report")
    base = fx.lineitem_scores(spark, sf_dir)
    cube = scores.aggregate_scores(base, TRAITS, "row", ["sum"])
    write_report(calibrate.calibration_params(cube), path)
    back = spark.read.schema(
        "formula string, weighting string, c string, mean double, population_sd double"
    ).json(path)
    return rounded(back, 8, "mean", "population_sd")


# --- pairs ------------------------------------------------------------------


@register
def text_hashes(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", text_hash(F.col("text")).alias("hash"))


@register
def pairs_valid(spark, sf_dir):
    checked = pairs.validate_pairs(fx.conversation_messages(spark, sf_dir))
    return pairs.hashed_pairs(pairs.good_rows(checked), ["conv_id"])


@register
def pairs_rejected(spark, sf_dir):
    checked = pairs.validate_pairs(fx.conversation_messages(spark, sf_dir))
    return pairs.rejected_rows(checked).select("conv_id", "reason")


def render(prompt: Column, response: Column) -> tuple[Column, Column]:
    """A minimal chat rendering: generation prompt and full text."""
    head = F.concat(F.lit("USER:"), prompt, F.lit("\nASSISTANT:"))
    return head, F.concat(head, response, F.lit(EOS + "\n"))


def tokenizer(text: Column) -> Column:
    return word_ids(text)


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both responses of every conversation; some renderings are spoiled."""
    sides = F.inline(
        F.array(
            *[
                F.struct(F.lit(side).alias("side"), F.col(side).alias("response"))
                for side in ("chosen", "rejected")
            ]
        )
    )
    rows = fx.conversation_turns(spark, sf_dir).select("conv_id", "prompt", sides)
    rows = rows.withColumns(
        {"prompt": F.coalesce("prompt", F.lit("")), "response": F.coalesce("response", F.lit(""))}
    )
    prompt_text, full = render(F.col("prompt"), F.col("response"))
    spoiled = (
        F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("X"), full))
        .when(F.col("conv_id") % 7 == 1, F.concat(prompt_text, F.col("response")))
        .otherwise(full)
    )
    rendered = rows.select(
        "conv_id", "side", prompt_text.alias("prompt_text"), spoiled.alias("full_render")
    )
    return pairs.encode_boundary(rendered, tokenizer, EOS, EOS_ID, MAX_TOKENS)


@register
def encode_boundary(spark, sf_dir):
    encoded = _encoded(spark, sf_dir)
    joined = F.array_join(F.transform("input_ids", lambda i: i.cast("string")), ",")
    return encoded.select(
        "conv_id",
        "side",
        F.md5("full_text").alias("text_hash"),
        F.md5(joined).alias("ids_hash"),
        "prompt_length",
        "response_length",
        "reason",
    )


@register
def response_logprob(spark, sf_dir):
    """Candidate maps derived from the ids, with missing and non-finite ones planted."""
    encoded = pairs.good_rows(_encoded(spark, sf_dir))
    last = F.size("input_ids") - 1
    key = F.col("conv_id") % 11

    def candidate(token: Column, pos: Column) -> Column:
        value = -((token + pos) % 13 + 1) / F.lit(8.0)
        is_last = pos == last
        value = F.when(is_last & (key == 4), F.lit(float("-inf"))).otherwise(value)
        found = F.when(is_last & (key == 3), token + 1).otherwise(token)
        # The first position of a sequence has no candidates.
        return F.when(pos > 0, F.create_map(found, value))

    maps = F.transform("input_ids", candidate)
    cut = F.when(key == 5, F.slice(maps, F.lit(1), last)).otherwise(maps)
    scored = pairs.response_logprob(encoded.withColumn("prompt_logprobs", cut))
    return scored.select("conv_id", "side", "reason", "logprob")


def _pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fx.table(spark, sf_dir, "documents")
    tokens = pairs.token_table(documents, "text", "lang", LANGS)
    return pairs.score_pairs(
        fx.conversation_pairs(spark, sf_dir), tokens, ["base", *LANGS], ["conv_id"]
    )


@register
def token_table(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents")
    return pairs.token_table(documents, "text", "lang", LANGS)


@register
def score_pairs(spark, sf_dir):
    return rounded(_pair_totals(spark, sf_dir), 6, "logprob")


@register
def scores_wide(spark, sf_dir):
    wide = scores.scores_wide(_pair_totals(spark, sf_dir), LANGS, ["conv_id"])
    numbers = [n for n, kind in wide.dtypes if kind == "double"]
    return rounded(wide, 6, *numbers)


def _toy_model(weight: int):
    def model(batch: list[list[int]]) -> list[list[dict[int, float] | None]]:
        return [
            [
                None if pos == 0 else {token: -((token * weight + pos) % 13 + 1) / 8.0}
                for pos, token in enumerate(ids)
            ]
            for ids in batch
        ]

    return model


@register
def score_with_models(spark, sf_dir):
    """Pairs through encoding, two user models and extraction to text-free rows."""
    found = fx.conversation_pairs(spark, sf_dir)

    def messages(side: str) -> Column:
        turns = (("user", "prompt"), ("assistant", side))
        return F.array(
            *[F.struct(F.lit(r).alias("role"), F.col(c).alias("content")) for r, c in turns]
        )

    prepared = found.select(
        F.col("conv_id").alias("row_id"),
        messages("chosen").alias("chosen"),
        messages("rejected").alias("rejected"),
        F.lit(None).cast("string").alias("parse_reason"),
    )
    models = {"base": _toy_model(1), "a1": _toy_model(3)}
    return score_file(
        prepared, models, render, tokenizer, EOS, EOS_ID, 1 << 20, on_bad="drop"
    )


# --- scanning ---------------------------------------------------------------


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fx.table(spark, sf_dir, "documents")
    planted = fx.planted_texts(documents, "doc_id", "text", PLANTED_LINES)
    return scan.scan_text(planted, "doc_id", "text", SCAN_PATTERNS)


@register
def scan_text(spark, sf_dir):
    return _scanned(spark, sf_dir)


@register
def scan_text_counts(spark, sf_dir):
    return scan.scan_counts(_scanned(spark, sf_dir), "doc_id")


@register
def scan_pages(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    return scan.scan_text(pages, "page_id", "html", SCAN_PATTERNS)


@register
def scan_file_list(spark, sf_dir):
    """File findings on the given tables; the threshold is lowered to meet them."""
    found = scan.scan_files(sf.list_files(spark, sf_dir), oversize=1, suffixes=[".parquet"])
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("name"), "pattern")


# --- golden checks ----------------------------------------------------------


def _dataset_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fx.lineitem_scores(spark, sf_dir)
    summed = base.groupBy(F.col("dataset_trait").alias("name")).agg(
        F.count(F.lit(1)).alias("n"),
        (-F.sum("base_chosen_logprob")).cast("bigint").alias("total"),
    )
    return summed.select("name", F.sha2(F.concat_ws("|", "name", "n", "total"), 256).alias("digest"))


@register
def reconcile_digests(spark, sf_dir):
    observed = _dataset_digests(spark, sf_dir)
    spoiled = F.when(F.col("name") == "t3", F.upper("digest")).otherwise(F.col("digest"))
    expected = observed.select("name", spoiled.alias("digest"))
    return checks.reconcile(expected, observed.where("name != 't5'"))


@register
def target_checks(spark, sf_dir):
    """Variant correlations against themselves at two decimals."""
    raw = materialized(_raw_variants(spark, sf_dir, "pearson"), "variants")
    name = F.concat_ws("/", "formula", "weighting")
    metrics = raw.select(name.alias("metric"), F.col("r").alias("value"))
    targets = metrics.select(
        "metric", F.round("value", 2).alias("target"), F.lit(0.0025).alias("tolerance")
    )
    found = checks.check_targets(metrics.where("metric != 'lls/row'"), targets)
    return rounded(found, 9, "value")


@register
def sentinel_checks(spark, sf_dir):
    """A wrong point, a right one and one that is absent."""
    target = fx.quantity_target(spark, sf_dir)
    right = target.where("c = 't0' AND t = 't2'").first()["e"]
    return checks.check_sentinels(target, {("t0", "t1"): 1.0, ("t0", "t2"): right, ("absent", "t1"): 1.0})


# --- selection and repeated runs -------------------------------------------


def _selectable(spark: SparkSession, sf_dir: str, *extra) -> DataFrame:
    base = fx.lineitem_scores(spark, sf_dir, fx.row_id().alias("row_id"))
    kept = scores.with_scores(base, ["t0"], ["sum"])
    return kept.select(
        "dataset_trait",
        "row_id",
        "chosen_response_tokens",
        "rejected_response_tokens",
        F.col("delta_sum_t0").alias("score"),
        *extra,
    )


def _selected(rows: DataFrame) -> DataFrame:
    return selection.select_by_score(
        rows, "score", "dataset_trait", "row_id", top_fraction=0.1, seed=SEED
    )


@register
def select_by_score(spark, sf_dir):
    chosen = _selected(_selectable(spark, sf_dir))
    return chosen.select("dataset_trait", "row_id", "score", "rule")


@register
def select_top_k(spark, sf_dir):
    chosen = selection.select_by_score(
        _selectable(spark, sf_dir), "score", "dataset_trait", "row_id", top_k=500, seed=SEED
    )
    return chosen.select("dataset_trait", "row_id", "score")


@register
def select_threshold(spark, sf_dir):
    chosen = selection.select_by_score(
        _selectable(spark, sf_dir), "score", "dataset_trait", "row_id", threshold=2.5
    )
    return chosen.select("dataset_trait", "row_id", "score")


@register
def selection_manifest(spark, sf_dir):
    """The record a selection leaves: dataset, row and prompt hashes, and its rule."""
    rows = _selectable(spark, sf_dir, "prompt_hash", F.sha2("row_id", 256).alias("row_hash"))
    return selection.selection_manifest(_selected(rows), "dataset_trait", ["row_hash", "prompt_hash"])


@register
def random_control(spark, sf_dir):
    rows = _selectable(spark, sf_dir)
    control = selection.random_control(rows, _selected(rows), "dataset_trait", "row_id", SEED)
    return control.select("dataset_trait", "row_id")


@register
def length_control(spark, sf_dir):
    rows = _selectable(spark, sf_dir)
    length = F.col("chosen_response_tokens") + F.col("rejected_response_tokens")
    control = selection.length_control(
        rows, _selected(rows), "dataset_trait", "row_id", length, 2, SEED
    )
    return control.select("dataset_trait", "length_bucket", "row_id")


@register
def dataset_positions(spark, sf_dir):
    """Exact positions by heavily tied scores, cut into ranges."""
    rows = _selectable(spark, sf_dir).withColumn("digest", F.md5("row_id"))
    placed = ordering.positions_by_value(
        rows, ["dataset_trait"], "score", "digest", ["row_id"], with_total=True
    )
    return placed.select("dataset_trait", "row_id", "position", "group_rows")


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = fx.lineitem_scores(spark, sf_dir, fx.row_id().alias("row_id"))
    first = scores.scores_long(base, TRAITS, ["row_id"], ["sum"]).select(
        "row_id", F.col("adapter").alias("trait"), "score"
    )
    noise = (uniform32(SEED, F.col("row_id"), F.col("trait")) % 5 - 2) / F.lit(64.0)
    return first, first.withColumn("score", F.col("score") + noise)


@register
def repeatability(spark, sf_dir):
    first, second = _runs(spark, sf_dir)
    return rounded(selection.repeatability(first, second), 6, "value")


@register
def engine_agreement(spark, sf_dir):
    base = fx.lineitem_scores(spark, sf_dir, fx.row_id().alias("row_id"))
    cells = F.array(
        *[
            F.struct(
                F.lit(model).alias("model"),
                F.lit(side).alias("side"),
                F.col(f"{side}_response_tokens").alias("tokens"),
                F.col(f"{model}_{side}_logprob").alias("logprob"),
            )
            for model in ("base", "t0", "t1")
            for side in ("chosen", "rejected")
        ]
    )
    first = base.select("row_id", F.inline(cells))
    draw = uniform32(SEED, F.col("row_id"), F.col("model"), F.col("side"))
    second = first.withColumn("logprob", F.col("logprob") + (draw % 9 - 4) / F.lit(256.0))
    found = selection.engine_agreement(first, second, ["row_id"], 0.01)
    return rounded(found, 9, "max_abs_difference")

