"""Multinomial counts split down a tree of group ranges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import splitting


def test_binomial_is_the_inverse_of_its_distribution():
    for trials, share in ((1, 0.5), (7, 0.3), (60, 0.02), (60, 0.98), (400, 0.64)):
        mass = [math.comb(trials, k) * share**k * (1 - share) ** (trials - k) for k in range(trials + 1)]
        for u in (1e-9, 0.01, 0.2, 0.5, 0.77, 0.999, 1 - 1e-9):
            assert splitting.binomial(trials, share, u) == int(np.searchsorted(np.cumsum(mass), u, side="left"))
    assert splitting.binomial(0, 0.5, 0.3) == 0 and splitting.binomial(9, 1.0, 0.3) == 9
    # A large range stays within twelve deviations and costs a window, not all trials.
    assert abs(splitting.binomial(10**9, 0.5, 0.5) - 5 * 10**8) <= 1


@pytest.mark.parametrize(("groups", "leaf"), [(1, 64), (64, 64), (65, 64), (200, 64), (1000, 7)])
def test_leaves_hold_all_draws(groups, leaf):
    leaves = -(-groups // leaf)
    totals = np.zeros(leaves)
    for replicate in range(400):
        counts = splitting.leaf_counts(3, "d", replicate, groups, leaf)
        assert len(counts) == leaves and sum(counts) == groups and min(counts) >= 0
        totals += counts
    share = np.array([min(leaf, groups - k * leaf) for k in range(leaves)]) / groups
    deviation = np.sqrt(400 * groups * share * (1 - share)) + 1e-9
    assert (np.abs(totals - 400 * groups * share) < 5 * deviation + 1e-6).all()


@pytest.mark.parametrize("fast", [False, True])
def test_split_draws(spark, fast):
    rows = [("a", i, 50, float(i)) for i in range(50)] + [("b", 0, 1, 7.0)]
    indexed = spark.createDataFrame(rows, "dataset_trait string, group_index long, group_rows long, x double")
    drawn = splitting.split_draws(indexed, 300, 5, leaf_groups=8, fast_hash=fast)
    assert drawn.columns == ["dataset_trait", "x", "replicate", "weight"]
    got = drawn.toPandas()
    assert (got[got.dataset_trait == "b"].weight == 1).all() and (got[got.dataset_trait == "b"].replicate.nunique()) == 300
    a = got[got.dataset_trait == "a"]
    assert (a.groupby("replicate").weight.sum() == 50).all() and a.replicate.nunique() == 300
    assert not a.duplicated(["replicate", "x"]).any()
    by_group = a.groupby("x").weight.sum()
    assert len(by_group) == 50 and ((by_group - 300).abs() < 6 * math.sqrt(300)).all()
    dense = a.pivot(index="replicate", columns="x", values="weight").fillna(0)
    assert dense.var().mean() == pytest.approx(49 / 50, rel=0.1)
    again = splitting.split_draws(indexed.repartition(3), 300, 5, leaf_groups=8, fast_hash=fast)
    assert again.exceptAll(drawn).count() == 0
    assert again.agg(F.sum("weight")).first()[0] == 300 * 51
