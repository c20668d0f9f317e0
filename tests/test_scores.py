"""Formulas, cube, calibration, association and resampling on analytic fixtures."""

import math
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairlens.operators import associate, calibrate, ordering, radix, resample, scores

AXIS = [f"a{k}" for k in range(10)]


def cube_rows():
    """Two rows per dataset whose sum score is 100 * adapter + dataset."""
    rows = []
    for d, dataset in enumerate(AXIS):
        for prompt in ("p", "q"):
            totals = []
            for a in range(10):
                totals += [-5.0 + 100 * a + d, -6.0]
            rows.append((dataset, prompt, 2, 3, -5.0, -6.0, *totals))
    return rows


def cube_schema():
    totals = ", ".join(f"{a}_chosen_logprob double, {a}_rejected_logprob double" for a in AXIS)
    return (
        "dataset_trait string, prompt_hash string, chosen_response_tokens long, "
        "rejected_response_tokens long, base_chosen_logprob double, base_rejected_logprob double, "
        + totals
    )


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(cube_rows(), cube_schema())


def one_row(spark, **changes):
    row = {
        "dataset_trait": "d",
        "prompt_hash": "p",
        "chosen_response_tokens": 4,
        "rejected_response_tokens": 3,
        "base_chosen_logprob": -10.0,
        "base_rejected_logprob": -13.0,
        "x_chosen_logprob": -8.0,
        "x_rejected_logprob": -10.0,
    }
    row.update(changes)
    schema = ", ".join(
        f"{n} {'string' if n in ('dataset_trait', 'prompt_hash') else 'long' if 'tokens' in n else 'double'}"
        for n in row
    )
    return spark.createDataFrame([tuple(row.values())], schema)


def test_formulas(spark):
    row = scores.with_scores(one_row(spark), ["x"]).first()
    assert (row.delta_sum_x, row.delta_lls_x, row.delta_separate_x) == (-1.0, -1 / 7, -0.5)


@pytest.mark.parametrize(
    "change",
    [
        {"chosen_response_tokens": 0},
        {"rejected_response_tokens": -1},
        {"chosen_response_tokens": None},
        {"x_chosen_logprob": float("nan")},
        {"x_rejected_logprob": float("inf")},
        {"base_chosen_logprob": None},
    ],
)
def test_bad_inputs_are_refused(spark, change):
    bad = one_row(spark, **change)
    with pytest.raises(PySparkException):
        scores.with_scores(bad, ["x"]).collect()
    with pytest.raises(PySparkException):
        scores.group_stats(bad, ["x"]).collect()
    assert scores.with_scores(bad, ["x"], on_invalid="null").first().delta_sum_x is None


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="add these columns"):
        scores.group_stats(one_row(spark).drop("x_chosen_logprob"), ["x"])


def test_cube_cell(table):
    cube = scores.score_cube(scores.group_stats(table, AXIS), AXIS)
    cells = {(r.formula, r.weighting, r.c, r.t): r.value for r in cube.collect()}
    assert len(cells) == 600
    assert cells["sum", "row", "a3", "a7"] == 307
    assert cells["lls", "prompt", "a3", "a7"] == 307 / 5
    assert cells["separate", "row", "a3", "a7"] == 307 / 2


def test_row_and_prompt_weighting_differ(spark):
    rows = []
    for i, prompt in enumerate("aabccc"):
        rows.append(("d", prompt, 1, 1, 0.0, 0.0, float(4 * i), 0.0))
    schema = (
        "dataset_trait string, prompt_hash string, chosen_response_tokens long, "
        "rejected_response_tokens long, base_chosen_logprob double, base_rejected_logprob double, "
        "x_chosen_logprob double, x_rejected_logprob double"
    )
    df = spark.createDataFrame(rows, schema)
    cube = scores.score_cube(scores.group_stats(df, ["x"], ["sum"]), ["x"], ["sum"])
    means = {r.weighting: r.value for r in cube.collect()}
    assert means["row"] == 10.0
    assert means["prompt"] == pytest.approx((2 + 8 + 16) / 3)
    only_row = scores.aggregate_scores(df, ["x"], "row", ["sum"]).collect()
    assert [r.value for r in only_row] == [10.0]


def matrix(spark, values, name="value"):
    rows = [(AXIS[i], AXIS[j], float(values[i, j])) for i in range(10) for j in range(10)]
    return spark.createDataFrame(rows, f"c string, t string, {name} double")


@pytest.fixture(scope="module")
def values():
    return np.random.default_rng(5).normal(size=(10, 10))


def test_calibrate_matches_numpy(spark, values):
    cells = calibrate.calibrate(matrix(spark, values), calibrate.SCHEMES, keys=[])
    got = {(r.scheme, r.c, r.t): r.z for r in cells.collect()}
    for i in range(10):
        for j in range(10):
            row, rest = values[i], np.delete(values[i], j)
            assert got["all", AXIS[i], AXIS[j]] == pytest.approx(
                (row[j] - row.mean()) / row.std(), abs=1e-12
            )
            assert got["leave_one_dataset_out", AXIS[i], AXIS[j]] == pytest.approx(
                (row[j] - rest.mean()) / rest.std(), abs=1e-9
            )


def test_constant_adapter_is_degenerate(spark, values):
    flat = values.copy()
    flat[4] = 2.0
    for scheme in calibrate.SCHEMES:
        with pytest.raises(PySparkException, match="do not vary"):
            calibrate.calibrate(matrix(spark, flat), scheme, keys=[]).collect()
        kept = calibrate.calibrate(matrix(spark, flat), scheme, keys=[], on_degenerate="null")
        assert kept.where("z IS NULL").count() == 10
    with pytest.raises(ValueError):
        calibrate.calibrate(matrix(spark, values), "none")


def test_affine_target_correlates_at_one(spark, values):
    target = matrix(spark, 2.5 * values + 7, "e")
    for method in associate.METHODS:
        row = associate.off_diagonal_association(
            matrix(spark, values), target, AXIS, method=method
        ).first()
        assert row.cells == 90 and row.r == pytest.approx(1.0)


def test_constant_side_gives_null(spark, values):
    target = matrix(spark, np.ones((10, 10)), "e")
    assert associate.off_diagonal_association(matrix(spark, values), target, AXIS).first().r is None


def test_incomplete_or_doubled_matrices_are_refused(spark, values):
    whole, target = matrix(spark, values), matrix(spark, values, "e")
    broken = [
        (whole.where("NOT (c = 'a1' AND t = 'a2')"), target),
        (whole.union(whole.where("c = 'a1' AND t = 'a2'")), target),
        (whole, target.where("NOT (c = 'a1' AND t = 'a2')")),
        (whole, target.union(target.limit(1))),
        (whole.withColumn("c", F.regexp_replace("c", "a9", "zz")), target),
    ]
    for left, right in broken:
        with pytest.raises(PySparkException):
            associate.align(left, right, AXIS).collect()


def test_permutations_match_brute_force(spark):
    s = np.arange(100.0).reshape(10, 10)
    e = s**2
    null = resample.row_block_permutation(matrix(spark, s), matrix(spark, e, "e"), AXIS, 12, 3)
    got = {r.draw: r.r for r in null.collect()}
    source = spark.range(12).withColumnRenamed("id", "draw")
    placed = resample.permutation_draws(source, AXIS, 3).collect()
    mask = ~np.eye(10, dtype=bool)
    for draw in range(12):
        order = {r.c: AXIS.index(r.source) for r in placed if r.draw == draw}
        perm = [order[c] for c in AXIS]
        assert sorted(perm) == list(range(10))
        want = np.corrcoef(s[mask], e[perm, :][mask])[0, 1]
        assert got[draw] == pytest.approx(want, abs=1e-10)
    again = resample.row_block_permutation(matrix(spark, s), matrix(spark, e, "e"), AXIS, 12, 3)
    assert {r.draw: r.r for r in again.collect()} == pytest.approx(got)


@pytest.mark.parametrize("method", resample.BOOTSTRAP_METHODS)
@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_bootstrap_matches_its_draws(spark, method, limit):
    rng = np.random.default_rng(1)
    rows = [("d", f"p{g}", int(n), float(x)) for g, (n, x) in enumerate(zip(rng.integers(1, 9, 40), rng.normal(size=40)))]
    stats = spark.createDataFrame(rows, "dataset_trait string, prompt_hash string, n long, sum_sum_x double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        cells = resample.bootstrap_groups(stats, ["x"], 20, 7, method, ["sum"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = {(r.replicate, r.weighting): r.value for r in cells}
    if method == "multinomial":
        indexed = resample.group_index(stats)
        by_index = {r.group_index: (r.n, r.sum_sum_x) for r in indexed.collect()}
        assert sorted(by_index) == list(range(40))
        draws = resample.multinomial_draws(indexed, 20, 7).collect()
        picked = [(r.replicate, 1, *by_index[r.group_index]) for r in draws]
        assert len(draws) == 20 * 40
    elif method == "split":
        drawn = resample.split_draws(resample.group_index(stats), 20, 7).collect()
        picked = [(r.replicate, r.weight, r.n, r.sum_sum_x) for r in drawn]
        assert sum(p[1] for p in picked) == 20 * 40
    else:
        drawn = resample.poisson_draws(stats, 20, 7).collect()
        picked = [(r.replicate, r.weight, r.n, r.sum_sum_x) for r in drawn]
    for b in range(20):
        m, n, x = np.array([p[1:] for p in picked if p[0] == b]).T
        assert got[b, "row"] == pytest.approx((m * x).sum() / (m * n).sum())
        assert got[b, "prompt"] == pytest.approx((m * x / n).sum() / m.sum())


def test_resampling_counts_must_be_positive(spark, values):
    cells, target = matrix(spark, values), matrix(spark, values, "e")
    with pytest.raises(ValueError):
        resample.row_block_permutation(cells, target, AXIS, 0)
    with pytest.raises(ValueError):
        resample.bootstrap_groups(cells, ["x"], 0)


def test_positions_equal_plain_window_under_skew(spark):
    """One key holds most rows and one value most of those."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.when(F.col("id") % 3 == 0, 1.0).otherwise((F.col("id") * 37 % 1001).cast("double")).alias("v"),
        F.col("id"),
        F.md5(F.col("id").cast("string")).alias("h"),
    )
    df.createOrReplaceTempView("ranked_rows")
    for descending in (True, False):
        placed = ordering.positions_by_value(df, ["k"], "v", "h", ["id"], descending, True, True)
        want = spark.sql(
            "SELECT *, avg(p) OVER (PARTITION BY k, v) AS r FROM (SELECT id, k, v, row_number() OVER (PARTITION BY k ORDER BY v "
            f"{'DESC' if descending else 'ASC'}, h, id) AS p, count(*) OVER (PARTITION BY k) AS n "
            "FROM ranked_rows)"
        ).drop("k", "v")
        assert placed.count() == 20_000
        joined = placed.join(want, "id")
        assert joined.where("position = p AND group_rows = n AND rank = r").count() == 20_000


def test_hot_value_is_cut_into_ranges(spark, monkeypatch):
    """The largest range stays near its share although one value fills the key."""
    df = spark.range(20_000).select(
        F.lit("k").alias("k"), F.lit(1.0).alias("v"), F.md5(F.col("id").cast("string")).alias("h")
    )
    seen = []
    written = ordering.materialized
    monkeypatch.setattr(ordering, "materialized", lambda df, label: seen.append(written(df, label)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ordering.positions_by_value(df, ["k"], "v", "h", with_rank=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = seen[0].groupBy("__part").count().agg(F.count("*"), F.max("count")).first()
    assert parts[0] == 8 and parts[1] < 2 * 20_000 / 8
    assert [r[0] for r in placed.select("rank").distinct().collect()] == [10_000.5]


def test_runs_longer_than_a_batch(spark):
    """Runs of equal values that go over several batches and partitions keep one rank."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(3000).select(
            (F.col("id") % 2).alias("k"), F.floor(F.col("id") / 100).cast("double").alias("v"), F.col("id"), F.md5(F.col("id").cast("string")).alias("h")
        )
        placed = ordering.positions_by_value(df, ["k"], "v", "h", ["id"], False, with_rank=True)
        assert {(r.v, r["rank"]) for r in placed.select("v", "rank").distinct().collect()} == {(float(v), v * 50 + 25.5) for v in range(30)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("few", [0, 40, 1 << 14])
@pytest.mark.parametrize("descending", [True, False])
def test_first_rows_equal_plain_order(spark, few, descending):
    """Radix selection against a plain sort: ties in value, equal digests, missing values, rows that are alike."""
    rng = np.random.default_rng(few)
    values = [None, float("nan"), 0.0, -0.0, 1e300, -1e300, 1e-300, float("inf"), float("-inf"), 2.5, 2.5, 2.5]
    rows = []
    for i in range(1500):
        v = values[rng.integers(len(values))] if i % 3 else float(rng.normal())
        rows.append((("hot" if i % 4 else f"k{i % 12}"), i, v, f"{(i // 5) % 40:032x}" if i % 2 else f"{int(rng.integers(1 << 62)):032x}"))
    df = spark.createDataFrame(rows, "k string, id int, v double, h string").repartition(5)

    def place(r):
        missing = r[2] is None or math.isnan(r[2])
        return (missing, 0.0 if missing else (-r[2] if descending else r[2]), r[3][:15], r[3], r[1])

    by_key = {}
    for r in sorted(rows, key=place):
        by_key.setdefault(r[0], []).append(r[1])
    for wanted, count in ((F.lit(7), lambda n: 7), (F.ceil(F.col("group_rows") * 0.6), lambda n: -(-n * 6 // 10)), (F.lit(5000), lambda n: n)):
        got = radix.first_rows(df, ["k"], F.col("h"), ["id"], wanted, "v", descending, few=few)
        assert got.columns == df.columns
        assert sorted(r.id for r in got.collect()) == sorted(i for ids in by_key.values() for i in ids[: count(len(ids))])
    quota = spark.createDataFrame([("hot", 11), ("k0", 0), ("nowhere", 5)], "k string, q long")
    got = radix.first_rows(df, ["k"], F.col("h"), ["id"], F.col("q"), quota=quota, few=few)
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[3], r[1]))
    assert sorted(r.id for r in got.collect()) == sorted(r[1] for r in hot[:11])


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_quantiles_equal_interpolation(spark, few):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=701), np.repeat(0.25, 900), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    levels = (0.0, 0.25, 0.333, 0.5, 0.9, 1.0)
    assert list(radix.quantiles(df, "v", levels, few).first()) == pytest.approx(list(np.quantile(values, levels)), rel=1e-12)
    assert radix.quantiles(df.where("false"), "v", (0.5,)).first()[0] is None


SCORE_CSV, TARGET_CSV = os.environ.get("SCORE_MATRIX_CSV"), os.environ.get("TARGET_MATRIX_CSV")


@pytest.mark.skipif(not (SCORE_CSV and TARGET_CSV), reason="published matrices not given")
def test_published_matrices(spark):
    """Headline values of the published calibrated and target matrices."""
    from pairlens.sources.tables import read_matrix

    with open(SCORE_CSV) as stream:
        axis = stream.readline().strip().split(",")[1:]
    score = read_matrix(spark, SCORE_CSV, axis, "adapter_trait", "value")
    sentinels = {("impulsiveness", "humor"): 128.3, ("humor", "impulsiveness"): 118.4}
    target = read_matrix(spark, TARGET_CSV, axis, sentinels=sentinels)
    with pytest.raises(ValueError, match="sentinel"):
        read_matrix(spark, TARGET_CSV, axis, sentinels={("humor", "impulsiveness"): 128.3})
    found = {
        m: associate.off_diagonal_association(score, target, axis, method=m).first().r
        for m in associate.METHODS
    }
    assert found["pearson"] == pytest.approx(0.1047588065916269, abs=1e-9)
    assert found["spearman"] == pytest.approx(0.08656248328049311, abs=1e-12)
    column = associate.column_association(score, target, axis).where("t = 'humor'").first()
    assert column.r == pytest.approx(0.8069556769263958, abs=1e-9)
    rank = associate.predicted_rank(score).where("t = 'humor' AND c = 'impulsiveness'").first()
    assert rank.predicted_rank == 3
    tested = resample.permutation_test(score, target, axis, 100_000).first()
    # Exact p-values over all row permutations, within three Monte-Carlo errors.
    assert abs(tested.p_one_sided - 0.048456) < 3 * math.sqrt(0.048456 * 0.9515 / 1e5)
    assert abs(tested.p_two_sided - 0.257711) < 3 * math.sqrt(0.257711 * 0.7423 / 1e5)


def test_draws_reach_every_group_of_a_huge_dataset(spark):
    """No index above 2**32 is out of reach, and none of the high half is rarer."""
    from pairlens.operators.resample import multinomial_draws

    groups = 10**10
    slots = spark.range(400).selectExpr("'d' AS dataset_trait", "id AS group_index", f"{groups}L AS group_rows")
    for fast in (False, True):
        drawn = [r.group_index for r in multinomial_draws(slots, 5, fast_hash=fast).collect()]
        assert len(drawn) == 2000 and 0 <= min(drawn) and max(drawn) < groups
        assert sum(d >= groups // 2 for d in drawn) == pytest.approx(1000, abs=120)
        assert sum(d >= 1 << 32 for d in drawn) > 900
