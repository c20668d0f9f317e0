"""One planted defect per check, bundles, scanning, selection, sinks and golden checks."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pairlens.operators import checks, quality, scan, selection
from pairlens.plans.reproduce import reproduce, study
from pairlens.plans.summarize import summarize
from pairlens.plans.validate import observed_facts, validate_bundle
from pairlens.sources import files as sf
from pairlens.sources.sinks import write_matrix, write_scores
from pairlens.sources.tables import read_manifest, read_matrix, read_scores, score_files
from pairlens.vocabulary import score_schema

AXIS = ["t0", "t1", "t2"]
REVISION = "pinned"
CLEAN = {"provenance": {"contains_raw_text": False}}


def dataset(name, rows=2):
    """A sound public table in pyarrow form."""
    columns = {
        "dataset_trait": [name] * rows,
        "source_revision": [REVISION] * rows,
        "source_row_id": list(range(rows)),
    }
    for k, column in enumerate(("prompt_hash", "chosen_hash", "rejected_hash")):
        columns[column] = [f"{k}{i}".rjust(64, "a") for i in range(rows)]
    columns["prompt_tokens"] = [3] * rows
    columns["chosen_response_tokens"] = [2 + 2 * i for i in range(rows)]
    columns["rejected_response_tokens"] = [3 - i % 2 for i in range(rows)]
    columns["base_chosen_logprob"] = [-5.0 - 3 * i for i in range(rows)]
    columns["base_rejected_logprob"] = [-6.0 - i for i in range(rows)]
    for k, adapter in enumerate(AXIS):
        chosen = [-4.0 + k - 3 * i for i in range(rows)]
        columns[f"{adapter}_chosen_logprob"] = chosen
        columns[f"{adapter}_rejected_logprob"] = [-6.5] * rows
        for formula in ("sum", "lls", "separate"):
            out = []
            for i in range(rows):
                sc = chosen[i] - columns["base_chosen_logprob"][i]
                sr = -6.5 - columns["base_rejected_logprob"][i]
                nc = columns["chosen_response_tokens"][i]
                nr = columns["rejected_response_tokens"][i]
                out.append({"sum": sc - sr, "lls": (sc - sr) / (nc + nr), "separate": sc / nc - sr / nr}[formula])
            columns[f"delta_{formula}_{adapter}"] = out
    return pa.table({n: columns[n] for n in score_schema(AXIS).names})


def put(table, column, values):
    kind = table.schema.field(column).type
    return table.set_column(table.column_names.index(column), column, pa.array(values, kind))


def write_bundle(spark, folder, tables, metadata=None, manifest=None):
    os.makedirs(folder / "logprobs", exist_ok=True)
    for name, table in tables.items():
        meta = {k: json.dumps(v) for k, v in (metadata or {}).get(name, CLEAN).items()}
        pq.write_table(table.replace_schema_metadata(meta), folder / "logprobs" / f"{name}.parquet")
    facts, _ = observed_facts(score_files(spark, str(folder)))
    entries = [
        {
            "trait": r.dataset,
            "rows": r.rows,
            "size_bytes": r.size_bytes,
            "sha256": r.sha256,
            "contains_raw_text": False,
            "formula_round_trip_max_abs_error": 0.0,
        }
        for r in facts.collect()
    ]
    for entry in entries:
        entry.update((manifest or {}).get(entry["trait"], {}))
    path = folder / "manifest.json"
    path.write_text(json.dumps(entries))
    return str(path)


def failures(spark, folder, tables, metadata=None, manifest=None):
    path = write_bundle(spark, folder, tables, metadata, manifest)
    report = validate_bundle(spark, str(folder), AXIS, AXIS, path, REVISION)
    found = report.checks.where("n_bad > 0").collect()
    return {(r.dataset, r["check"], r.detail) for r in found}, report


def sound():
    return {name: dataset(name) for name in AXIS}


def test_sound_bundle_passes(spark, tmp_path):
    found, report = failures(spark, tmp_path, sound())
    assert found == set()
    totals = report.totals.first()
    assert totals.passed and totals.datasets_validated == 3
    assert (totals.total_rows, totals.max_error) == (6, 0.0)
    sizes = [os.path.getsize(tmp_path / "logprobs" / f"{n}.parquet") for n in AXIS]
    assert totals.total_bytes == sum(sizes)
    quality.raise_if_bad(report.checks)


def test_row_defects_are_all_found(spark, tmp_path):
    tables = sound()
    bad = tables["t0"]
    bad = put(bad, "prompt_tokens", [None, 3])
    bad = put(bad, "chosen_hash", ["a" * 63, "A" * 64])
    bad = put(bad, "rejected_hash", ["a" * 64 + "\n", None])
    bad = put(bad, "source_row_id", [4, 4])
    bad = put(bad, "source_revision", [REVISION, "other"])
    tables["t0"] = put(bad, "dataset_trait", ["t0", "t1"])
    worse = put(tables["t1"], "t0_chosen_logprob", [float("nan"), -1.0])
    worse = put(worse, "chosen_response_tokens", [0, 4])
    tables["t1"] = put(worse, "t2_rejected_logprob", [float("-inf"), -6.5])
    off = tables["t2"]["delta_lls_t1"].to_pylist()
    tables["t2"] = put(tables["t2"], "delta_lls_t1", [off[0] * (1 + 2**-52), off[1]])
    found, report = failures(spark, tmp_path, tables)
    assert {f[1:] for f in found if f[0] == "t0"} == {
        ("length", "prompt_tokens"),
        ("hash", "chosen_hash"),
        ("hash", "rejected_hash"),
        ("unique_row_id", ""),
        ("source_revision", ""),
        ("dataset_name", ""),
    }
    t1 = {f[1:] for f in found if f[0] == "t1"}
    assert {("finite", "t0_chosen_logprob"), ("finite", "t2_rejected_logprob")} <= t1
    assert ("length", "chosen_response_tokens") in t1
    assert {f[1:] for f in found if f[0] == "t2"} == {("roundtrip", "delta_lls_t1")}
    with pytest.raises(ValueError, match="data-quality violations"):
        quality.raise_if_bad(report.checks)
    assert report.totals.first().datasets_validated == 0


def test_schema_metadata_and_manifest_defects(spark, tmp_path):
    tables = sound()
    tables["t0"] = tables["t0"].append_column("prompt", pa.array(["x", "y"])).drop(["delta_sum_t0"])
    tables["t1"] = tables["t1"].append_column("note", pa.array(["x", "y"]))
    metadata = {"t2": {"a": {"contains_raw_text": True}, "b": [{"deep": {"raw_x": 1}}], "c": {"a_text": 0}}}
    manifest = {
        "t0": {"contains_raw_text": None, "size_bytes": 1},
        "t1": {"sha256": "0", "rows": 9},
        "t2": {"formula_round_trip_max_abs_error": 0.5},
    }
    found, _ = failures(spark, tmp_path, tables, metadata, manifest)
    assert {
        ("t0", "raw_text_column", "prompt"),
        ("t0", "string_column", "prompt"),
        ("t0", "unexpected_column", "prompt"),
        ("t0", "missing_column", "delta_sum_t0"),
        ("t0", "manifest_raw_text", ""),
        ("t0", "size", ""),
        ("t1", "string_column", "note"),
        ("t1", "unexpected_column", "note"),
        ("t1", "schema_differs", ""),
        ("t1", "sha256", ""),
        ("t1", "rows", ""),
        ("t2", "hidden_raw_text", ""),
        ("t2", "manifest_error", ""),
    } <= found
    assert {f[0] for f in found if f[1] == "hidden_raw_text"} == {"t2"}


def test_broken_files_do_not_hide_the_others(spark, tmp_path):
    tables = sound()
    tables["t1"] = tables["t1"].slice(0, 0)
    position = tables["t2"].column_names.index("prompt_tokens")
    tables["t2"] = tables["t2"].set_column(position, "prompt_tokens", pa.array(["3", "3"]))
    path = write_bundle(spark, tmp_path, tables)
    (tmp_path / "logprobs" / "t0.parquet").write_bytes(b"not parquet")
    report = validate_bundle(spark, str(tmp_path), AXIS, AXIS, path, REVISION)
    found = {(r.dataset, r["check"]) for r in report.checks.where("n_bad > 0").collect()}
    assert {("t0", "unreadable_file"), ("t1", "not_empty"), ("t2", "column_type")} <= found
    os.remove(tmp_path / "logprobs" / "t0.parquet")
    report = validate_bundle(spark, str(tmp_path), AXIS, AXIS, path, REVISION)
    found = {(r.dataset, r["check"]) for r in report.checks.where("n_bad > 0").collect()}
    assert ("t0", "file_missing") in found


def test_vocabulary_and_manifest_forms(spark, tmp_path):
    path = write_bundle(spark, tmp_path, sound())
    assert read_scores(spark, str(tmp_path), AXIS, AXIS).count() == 6
    with pytest.raises(ValueError, match="missing 't3'"):
        read_scores(spark, str(tmp_path), [*AXIS, "t3"], AXIS)
    with pytest.raises(ValueError, match="unexpected 't2'"):
        read_manifest(spark, path, AXIS[:2])
    listed = read_manifest(spark, path, AXIS).orderBy("dataset").collect()
    entries = {e.pop("trait"): e for e in json.loads((tmp_path / "manifest.json").read_text())}
    (tmp_path / "map.json").write_text(json.dumps({"datasets": entries}, indent=1))
    mapped = read_manifest(spark, str(tmp_path / "map.json"), AXIS).orderBy("dataset").collect()
    assert [r.asDict() for r in listed] == [r.asDict() for r in mapped]
    (tmp_path / "bad.json").write_text('{"other": 1}')
    with pytest.raises(Exception, match="manifest as an array"):
        read_manifest(spark, str(tmp_path / "bad.json"), AXIS)


def cells(spark, name="value"):
    rows = [(c, t, float((i * 7 + j * 3) % 5 + i / 3)) for i, c in enumerate(AXIS) for j, t in enumerate(AXIS)]
    return spark.createDataFrame(rows, f"c string, t string, {name} double")


def test_matrix_round_trip(spark, tmp_path):
    write_matrix(cells(spark), str(tmp_path / "m"), AXIS)
    part = next((tmp_path / "m").glob("part-*.csv"))
    lines = part.read_text().splitlines()
    assert lines[0] == "adapter_trait,t0,t1,t2"
    assert lines[2] == "t1," + ",".join(f"{(7 + j * 3) % 5 + 1 / 3:.12g}" for j in range(3))
    back = read_matrix(spark, str(part), AXIS, "adapter_trait", "value")
    gap = back.withColumnRenamed("value", "b").join(cells(spark), ["c", "t"])
    assert gap.where("abs(b - value) > 1e-10").count() == 0
    digest = sf.file_facts(sf.list_files(spark, str(part))).first().sha256
    read_matrix(spark, str(part), AXIS, "adapter_trait", sha256=digest)
    with pytest.raises(ValueError, match="SHA-256"):
        read_matrix(spark, str(part), AXIS, "adapter_trait", sha256="0")
    with pytest.raises(ValueError, match="must start with"):
        read_matrix(spark, str(part), AXIS)
    with pytest.raises(ValueError, match="columns"):
        read_matrix(spark, str(part), AXIS[:2], "adapter_trait")


def test_family_files_and_study(spark, tmp_path):
    tables = pa.concat_tables([dataset(n, 5 + k) for k, n in enumerate(AXIS)])
    pq.write_table(tables, tmp_path / "scores.parquet")
    scores = spark.read.parquet(str(tmp_path / "scores.parquet"))
    family = summarize(scores, str(tmp_path / "out"), AXIS)
    assert family.count() == 18 * 9
    folders = [p for p in (tmp_path / "out" / "matrices").rglob("*.csv")]
    assert len(folders) == 18
    assert len(list((tmp_path / "out" / "primary").glob("*.csv"))) == 1
    params = spark.read.json(str(tmp_path / "out" / "parameters"))
    assert params.count() == 3
    variants = spark.read.json(str(tmp_path / "out" / "variants"))
    assert variants.count() == 18 and variants.where("primary").count() == 1
    metrics = study(scores, cells(spark, "e"), AXIS, "t1", "t2", 5, 20)
    got = {r.metric: r.value for r in metrics.collect()}
    assert len(got) == 14 and got["column_rows"] == 6.0

    goals = [("column_rows", 6.0, 0.0), ("bootstrap_low", 9.0, 0.0), ("combined_pearson", got["combined_pearson"], 1e-12)]
    targets = spark.createDataFrame(goals, "metric string, target double, tolerance double")

    def run(folder, **more):
        args = (scores, cells(spark, "e"), AXIS, "t1", "t2", targets, str(tmp_path / folder), {"column_rank": (1, 2, 3)})
        return reproduce(*args, expected=family, replicates=5, draws=20, **more)

    good = run("good")
    assert good.summary.first().asDict() == {"status": "passed", "mode": "smoke", "gates": 21, "failed": 0}
    assert {r.gate for r in good.gates.collect()} == {"target", "rank", "matrix"}  # few replicates are not gated
    assert spark.read.json(str(tmp_path / "good" / "reproduction_summary")).first().status == "passed"
    assert spark.read.json(str(tmp_path / "good" / "reproduction_metrics")).count() == 14
    bad = run("bad", sentinels={("t0", "nowhere"): 1.0})
    assert (bad.summary.first().status, bad.summary.first().failed) == ("failed", 1)
    with pytest.raises(ValueError, match="positive"):
        reproduce(scores, None, AXIS, "t1", "t2", targets, "", draws=0)


def test_text_free_sink_refuses_text(spark, tmp_path):
    df = spark.createDataFrame([("d", "x", 1.0)], "dataset_trait string, prompt string, v double")
    with pytest.raises(ValueError, match="raw-text"):
        write_scores(df, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="string columns"):
        write_scores(df.withColumnRenamed("prompt", "note"), str(tmp_path / "b"))


def test_scan(spark, tmp_path):
    lines = [
        "nothing here",
        "SIGNATURE=1 and /srv/x",
        "/home/a/b and hf_" + "a" * 20,
        "C:" + "\\\\" + "Users" + "\\\\" + "x",
        "sk-short",
    ]
    df = spark.createDataFrame([(1, "\r\n".join(lines))], "id int, text string")
    found = {(r.line_number, r.pattern) for r in scan.scan_text(df, "id", "text").collect()}
    assert found == {
        (2, "signature="),
        (2, "/srv"),
        (3, "absolute_path"),
        (3, "access_token"),
        (4, "windows_path"),
    }
    (tmp_path / "a.txt").write_text("x /mnt/y")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe /mnt")
    (tmp_path / "c.bin").write_bytes(b"0" * 10)
    (tmp_path / "LICENSE").write_text("fine")
    texts = sf.read_text_files(spark, str(tmp_path), scan.TEXT_SUFFIXES, ["LICENSE"])
    assert sorted(os.path.basename(r.path) for r in texts.collect()) == ["LICENSE", "a.txt"]
    assert scan.scan_text(texts, "path", "text").count() == 1
    hits = scan.scan_files(sf.list_files(spark, str(tmp_path)), oversize=9).collect()
    assert sorted(r.pattern for r in hits if r.path.endswith("c.bin")) == ["model_binary", "oversize_file"]
    assert {os.path.basename(r.path) for r in hits} == {"c.bin"}


def test_golden_checks(spark):
    expected = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, digest string")
    observed = spark.createDataFrame([("a", "1"), ("b", "x")], "name string, digest string")
    assert {r.name for r in checks.reconcile(expected, observed).collect()} == {"b", "c"}
    metrics = spark.createDataFrame(
        [("m1", 1.0), ("m2", 1.1), ("m3", float("nan"))], "metric string, value double"
    )
    rows = [(f"m{i}", 1.0, 0.01) for i in range(1, 5)]
    targets = spark.createDataFrame(rows, "metric string, target double, tolerance double")
    passed = {r.metric: r.passed for r in checks.check_targets(metrics, targets).collect()}
    assert passed == {"m1": True, "m2": False, "m3": False, "m4": False}


def test_selection_rules_and_short_controls(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") < 900, "hot").otherwise("cold").alias("d"),
        F.col("id").cast("string").alias("row_id"),
        (F.col("id") % 5).cast("double").alias("score"),
        (F.col("id") % 10).alias("n"),
    )
    with pytest.raises(ValueError):
        selection.select_by_score(rows, "score", "d", "row_id")
    top = selection.select_by_score(rows, "score", "d", "row_id", top_fraction=0.2)
    assert {(r.d, r["count"]) for r in top.groupBy("d").count().collect()} == {("hot", 180), ("cold", 20)}
    assert top.where("score < 4").count() == 0
    control = selection.random_control(rows, top, "d", "row_id")
    assert control.groupBy("d").count().where("count IN (180, 20)").count() == 2
    # All rows of the selected lengths are selected: nothing is left to match.
    matched = selection.length_control(rows, top, "d", "row_id", F.col("n"))
    assert matched.count() == 0
    wider = selection.length_control(rows, top, "d", "row_id", F.col("n"), 5)
    assert wider.count() == 200 and wider.join(top, ["d", "row_id"]).count() == 0


def test_repeated_identical_runs_agree(spark):
    run = spark.range(300).select(
        F.col("id").cast("string").alias("row_id"),
        F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))).alias("trait"),
        F.col("id"),
    )
    run = run.withColumn("score", ((F.col("id") * 7 + F.ascii("trait") * 3) % 11).cast("double")).drop("id")
    gates = {(r.gate, r.trait): r.value for r in selection.repeatability(run, run).collect()}
    assert gates["trait_mean_spearman", ""] == pytest.approx(1.0)
    assert gates["top_traits_equal", ""] == 1.0 and gates["max_mean_difference", ""] == 0.0
    for trait in "abcd":
        assert gates["row_spearman", trait] == pytest.approx(1.0)
        assert gates["top_decile_overlap", trait] == gates["bottom_decile_overlap", trait] == 1.0


def test_digest_trees(spark, tmp_path):
    """Ranges, nodes and only children by hand; empty and equal files; no digest depends on another file."""
    import hashlib

    sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
    contents = {"a.d": b"", "b.d": b"0123456789", "c.d": b"x" * 95, "d.d": b"x" * 95, "e.d": b"0123456789abc"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    files = sf.list_files(spark, str(tmp_path), "*.d")
    assert files.count() == 4  # Spark's reader passes empty files over
    files = files.union(spark.createDataFrame([(f"file:{tmp_path}/a.d", 0)], "path string, length long"))

    def tree(content):
        level = [sha(content[k : k + 10]) for k in range(0, max(1, len(content)), 10)]
        while len(level) > 1:
            groups = [level[k : k + 3] for k in range(0, len(level), 3)]
            level = [g[0] if len(g) == 1 else sha("".join(g)) for g in groups]
        return level[0]

    found = {os.path.basename(r.path): r for r in sf.tree_digests(files, 10, 3).collect()}
    assert {n: r.tree_sha256 for n, r in found.items()} == {n: tree(c) for n, c in contents.items()}
    assert {n: r.chunks for n, r in found.items()} == {"a.d": 1, "b.d": 1, "c.d": 10, "d.d": 10, "e.d": 2}
    assert sf.tree_digests(files.where("length < 11"), 10, 3).where("path LIKE '%b.d'").first().tree_sha256 == sha(contents["b.d"])
    assert sf.tree_digests(files.where("false"), 10, 3).count() == 0
    facts = sf.file_facts(files).withColumn("dataset", F.when(F.col("path").endswith("a.d"), "one").otherwise("many"))
    digests = {r.dataset: r for r in sf.dataset_digests(facts).collect()}
    assert (digests["one"].sha256, digests["many"].files, digests["many"].size_bytes) == (sha(b""), 4, 213)
    again = sf.dataset_digests(facts.where("path NOT LIKE '%d.d'")).where("dataset = 'many'").first()
    assert again.sha256 != digests["many"].sha256


def test_text_findings_fail_a_bundle(spark, tmp_path):
    manifest = write_bundle(spark, tmp_path / "b", sound())
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "fine.md").write_text("nothing here")
    report = validate_bundle(spark, str(tmp_path / "b"), AXIS, AXIS, manifest, REVISION, str(tmp_path / "texts"))
    totals = report.totals.first()
    assert totals.passed and totals.schema_identical and totals.text_findings == 0
    (tmp_path / "texts" / "bad.md").write_text("one\nsee /mnt/x")
    (tmp_path / "texts" / "m.ckpt").write_bytes(b"0")
    report = validate_bundle(spark, str(tmp_path / "b"), AXIS, AXIS, manifest, REVISION, str(tmp_path / "texts"))
    assert not report.totals.first().passed
    assert sorted((os.path.basename(r.path), r.line_number, r.pattern) for r in report.findings.collect()) == [
        ("bad.md", 2, "/mnt"), ("m.ckpt", None, "model_binary"),
    ]


def test_scores_are_written_without_a_sort_of_wide_rows(spark, tmp_path, monkeypatch):
    """A file per dataset and task stays open; the setting holds for the write alone, also when it fails."""
    from pyspark.sql import DataFrameWriter

    from pairlens.sources import sinks

    held, save = [], DataFrameWriter.save

    def watched(self, *args, **kwargs):
        held.append(spark.conf.get(sinks.CONCURRENT))
        return save(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "save", watched)
    before = spark.conf.get(sinks.CONCURRENT, "0")
    rows = spark.range(400, numPartitions=1).select((F.col("id") % 40).cast("string").alias("dataset_trait"), F.col("id").alias("source_row_id"))
    write_scores(rows, str(tmp_path / "s"))  # more datasets than open files
    with pytest.raises(Exception, match="(?i)exist"):
        write_scores(rows, str(tmp_path / "s"))
    assert held == [str(sinks.WRITERS)] * 2 and spark.conf.get(sinks.CONCURRENT, "0") == before
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.where("file_dataset = dataset_trait").select("source_row_id").distinct().count() == back.count() == 400


def test_packed_cells_meet_like_rows(spark):
    """Copies, missing ids and names, and cells that lie apart give the pairs of a plain join; a key travels once."""
    rows = [(1, "m", "x", 2, -4.0), (1, "m", "y", 2, -6.0), (1, "n", "x", 1, -1.0), (2, "m", "x", 4, -4.0), (None, "m", "x", 1, -50.0)]
    rows += [(1, "m", "x", 2, -8.0), (3, None, "x", 1, -60.0), (4, "o", "x", 1, -1.0), (2, "n", "x", 1, None)]
    kind = "row_id int, model string, side string, tokens int, logprob double"
    first = spark.createDataFrame(rows, kind).coalesce(1)
    second = spark.createDataFrame([r for r in reversed(rows) if r[1] != "o"], kind).repartition(3)
    got = {r.model: tuple(r)[1:] for r in selection.engine_agreement(first, second, ["row_id"], 1.0).collect()}
    assert got == {"m": (6, 2.0, False), "n": (2, 0.0, True)}
    cells = spark.range(500, numPartitions=1).select(F.col("id").alias("k"), F.explode(F.array(F.lit("p"), F.lit("q"))).alias("n"))
    cells = cells.withColumn("v", F.rand(1))
    both, names = selection._paired(cells, cells, ["k"], ["n"])
    assert names.count() == 2 and both.count() == 500 and both.where("again OR size(cells) != 2").count() == 0


def test_repeatability_writes_ids_once(spark, monkeypatch):
    """One row an id is written; neither ids nor digests go through the sorts, and nothing is written for the quartiles."""
    from pairlens.operators import ordering, radix

    tables, write = {}, selection.materialized

    def watched(df, label="stage"):
        out = write(df, label)
        tables.setdefault(label, []).append((out.count(), set(out.columns)))
        return out

    for module in (selection, ordering, radix):
        monkeypatch.setattr(module, "materialized", watched)
    run = spark.range(200, numPartitions=1).select(F.col("id").cast("string").alias("row_id"), F.explode(F.array(F.lit("p"), F.lit("q"))).alias("trait"))
    run = run.withColumn("score", F.rand(3))
    gates = {(r.gate, r.trait): r.value for r in selection.repeatability(run, run).collect()}
    assert gates["row_spearman", "p"] == pytest.approx(1.0) and gates["bottom_decile_overlap", "q"] == 1.0
    assert tables["runs"] == [(200, {"row_id", "again", "cells"})] and "quantile-keys" not in tables
    assert all("row_id" not in names and "__digest" not in names for _, names in tables["ordered"]) and len(tables["ordered"]) == 2
