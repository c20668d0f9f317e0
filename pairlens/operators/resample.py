"""Prompt-group bootstrap and row-block permutation, deterministic by seed.

Draws are hashes of (seed, key), so they are the same on any cluster layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.hashing import hash_order, poisson_weight, uniform32, uniform60
from pairlens.operators.associate import (
    align,
    association,
    off_diagonal,
    off_diagonal_association,
)
from pairlens.operators.calibrate import calibrate
from pairlens.operators.ordering import positions_by_hash
from pairlens.operators.scores import mean_cells, mean_expressions
from pairlens.operators.splitting import LEAF_GROUPS, split_draws
from pairlens.session import lookup_side, materialized, spread
from pairlens.vocabulary import FORMULAS, WEIGHTINGS, require_known

BOOTSTRAP_METHODS = ("multinomial", "split", "poisson")


def _require_positive(name: str, value: int) -> None:
    if value < 1:
        raise ValueError(f"{name} must be positive")


def _replicated(df: DataFrame, replicates: int, draw, *columns: str) -> DataFrame:
    """Rows times replicates with a seeded ``u`` each, made after spreading by ``columns``.

    ``draw(replicate)`` is evaluated once per copy, inside the generator: as a
    plain projection the optimizer would repeat the hash in every use of it.
    """
    copies = F.transform(
        F.sequence(F.lit(0), F.lit(replicates - 1)),
        lambda replicate: F.struct(replicate.alias("replicate"), draw(replicate).alias("u")),
    )
    return spread(df, *columns).select("*", F.inline(copies))


def group_index(stats: DataFrame) -> DataFrame:
    """Add a dense ``group_index`` 0..G-1 and ``group_rows`` = G per dataset."""
    keyed = stats.withColumn("__digest", F.md5("prompt_hash"))
    placed = positions_by_hash(
        keyed, ["dataset_trait"], "__digest", ["prompt_hash"], with_total=True
    )
    return placed.withColumn("group_index", F.col("position") - 1).drop("__digest", "position")


def multinomial_draws(
    indexed: DataFrame, replicates: int, seed: int = 42, fast_hash: bool = False
) -> DataFrame:
    """Exact with-replacement draws: rows ``(dataset_trait, replicate, group_index)``.

    Each indexed group contributes one draw per replicate, so the G draws of a
    replicate arise spread over the tasks that hold the groups, and the drawn
    index is uniform: a join on it has no hot key.
    """
    _require_positive("replicates", replicates)

    def draw(replicate: Column) -> Column:
        keys = (F.col("dataset_trait"), replicate, F.col("group_index"))
        return uniform60(seed, *keys, fast=fast_hash) % F.col("group_rows")

    slots = indexed.select("dataset_trait", "group_index", "group_rows")
    drawn = _replicated(slots, replicates, draw, "dataset_trait", "group_index")
    return drawn.select("dataset_trait", "replicate", F.col("u").alias("group_index"))


def poisson_draws(
    stats: DataFrame, replicates: int, seed: int = 42, fast_hash: bool = False
) -> DataFrame:
    """Group statistics times replicates with an independent Poisson(1) ``weight``."""
    _require_positive("replicates", replicates)

    def draw(replicate: Column) -> Column:
        keys = (F.col("dataset_trait"), replicate, F.col("prompt_hash"))
        return uniform32(seed, *keys, fast=fast_hash)

    drawn = _replicated(stats, replicates, draw, "dataset_trait", "prompt_hash")
    return drawn.withColumn("weight", poisson_weight(F.col("u"))).drop("u")


def bootstrap_groups(
    stats: DataFrame,
    adapters: Sequence[str],
    replicates: int,
    seed: int = 42,
    method: str = "multinomial",
    formulas: Sequence[str] = FORMULAS,
    weightings: Sequence[str] = WEIGHTINGS,
    fast_hash: bool = False,
    leaf_groups: int = LEAF_GROUPS,
) -> DataFrame:
    """Resampled score cubes: ``(replicate, formula, weighting, c, t, value)``.

    ``multinomial`` draws exactly G groups per dataset and replicate and shuffles
    the draws once. ``split`` draws G as well, split down a tree of group ranges to leaves of
    ``leaf_groups``, and shuffles counts of leaves instead of draws. ``poisson`` gives every group an independent Poisson(1)
    weight per replicate, computed where the group lies and combined before the
    shuffle; use it when groups x replicates is too large to shuffle.
    """
    require_known("method", method, BOOTSTRAP_METHODS)
    _require_positive("replicates", replicates)
    names = [f"sum_{formula}_{adapter}" for formula in formulas for adapter in adapters]
    slim = stats.select("dataset_trait", "prompt_hash", "n", *names)
    weight = "1"
    if method == "multinomial":
        # Numbering reads the statistics twice, and draws and join the numbered
        # ones: both are written, so the score scan runs once.
        indexed = materialized(group_index(materialized(slim, "group-stats")), "group-index")
        draws = multinomial_draws(indexed, replicates, seed, fast_hash)
        lookup = lookup_side(indexed.drop("prompt_hash", "group_rows"))
        drawn = draws.join(lookup, ["dataset_trait", "group_index"])
    elif method == "split":
        weight = "weight"
        indexed = materialized(group_index(materialized(slim, "group-stats")), "group-index")
        drawn = split_draws(indexed.drop("prompt_hash"), replicates, seed, leaf_groups, fast_hash)
    else:
        weight = "weight"
        drawn = poisson_draws(slim, replicates, seed, fast_hash).where("weight > 0")
    means = mean_expressions(adapters, formulas, weightings, weight)
    grouped = drawn.groupBy("replicate", F.col("dataset_trait").alias("t"))
    cells = mean_cells(grouped, ["replicate", "t"], means)
    return cells.select("replicate", "formula", "weighting", "c", "t", "value")


def bootstrap_associations(
    replicated: DataFrame,
    target: DataFrame,
    axis: Sequence[str],
    scheme: str = "all",
    method: str = "pearson",
) -> DataFrame:
    """Calibrate every replicate over its own cells, then correlate with the target."""
    by = ["replicate", "formula", "weighting"]
    calibrated = calibrate(replicated, scheme, by)
    return off_diagonal_association(calibrated, target, axis, by, "z", method)


def interval(
    draws: DataFrame,
    by: Sequence[str] = (),
    value: str = "r",
    levels: Sequence[float] = (0.025, 0.975),
) -> DataFrame:
    """Linear-interpolation percentile interval ``(by.., replicates, low, high)``."""
    bounds = F.percentile(value, F.array(*[F.lit(float(level)) for level in levels]))
    return (
        draws.groupBy(*by)
        .agg(F.count(value).alias("replicates"), bounds.alias("__bounds"))
        .select(
            *by,
            "replicates",
            F.element_at("__bounds", 1).alias("low"),
            F.element_at("__bounds", -1).alias("high"),
        )
    )


def bootstrap_interval(
    stats: DataFrame,
    adapters: Sequence[str],
    target: DataFrame,
    replicates: int = 1000,
    seed: int = 42,
    method: str = "multinomial",
    formula: str = "sum",
    weighting: str = "row",
    scheme: str = "all",
    levels: Sequence[float] = (0.025, 0.975),
    fast_hash: bool = False,
) -> DataFrame:
    """Percentile interval of the association, resampling the whole calculation.

    Only the columns of the requested formula travel through the resample.
    """
    replicated = bootstrap_groups(
        stats, adapters, replicates, seed, method, [formula], [weighting], fast_hash
    )
    draws = bootstrap_associations(replicated, target, adapters, scheme)
    return interval(draws, ["formula", "weighting"], levels=levels)


def permutation_draws(draws_source: DataFrame, axis: Sequence[str], seed: int = 42) -> DataFrame:
    """Seeded permutations of ``axis``: rows ``(draw, c, source)``.

    ``draws_source`` holds one row per ``draw``. Each draw sorts the axis by a
    hash inside its own row, so no shuffle is needed.
    """
    names = F.array(*[F.lit(name) for name in axis])
    ordered = F.array_sort(
        F.transform(
            names,
            lambda name: F.struct(
                hash_order(seed, F.col("draw"), name).alias("digest"), name.alias("source")
            ),
        )
    )
    placed = draws_source.select("draw", F.posexplode(ordered).alias("pos", "pick"))
    return placed.select(
        "draw",
        F.element_at(names, F.col("pos") + 1).alias("c"),
        F.col("pick.source").alias("source"),
    )


def _row_products(aligned: DataFrame) -> DataFrame:
    """Sufficient statistics of every (score row, target row) pairing.

    Putting target row ``source`` against score row ``c`` contributes the same
    sums in every draw that does so. There are only K*K pairings, so a draw costs
    K small additions instead of K*K cells. Both sides are centred first, which
    correlation ignores and cancellation does not.
    """
    s = F.col("s") - aligned.select(F.avg("s")).scalar()
    e = F.col("e") - aligned.select(F.avg("e")).scalar()
    left = off_diagonal(aligned).select("c", "t", s.alias("s"))
    right = aligned.select(F.col("c").alias("source"), "t", e.alias("e"))
    s, e = F.col("s"), F.col("e")
    return left.join(right, "t").groupBy("c", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(s).alias("ss"),
        F.sum(e).alias("se"),
        F.sum(s * s).alias("sss"),
        F.sum(e * e).alias("see"),
        F.sum(s * e).alias("sse"),
    )


def _null_draws(aligned: DataFrame, axis: Sequence[str], draws: int, seed: int) -> DataFrame:
    source = aligned.sparkSession.range(draws).withColumnRenamed("id", "draw")
    # The products are K*K rows, so their size is known from the axis.
    products = lookup_side(_row_products(aligned), len(axis) ** 2)
    placed = permutation_draws(source, axis, seed).join(products, ["c", "source"])
    sums = placed.groupBy("draw").agg(
        *[F.sum(name).alias(name) for name in ("n", "ss", "se", "sss", "see", "sse")]
    )
    n = F.col("n")
    spread_s = F.col("sss") - F.col("ss") * F.col("ss") / n
    spread_e = F.col("see") - F.col("se") * F.col("se") / n
    shared = F.col("sse") - F.col("ss") * F.col("se") / n
    scale = F.sqrt(F.greatest(spread_s, F.lit(0.0)) * F.greatest(spread_e, F.lit(0.0)))
    return sums.select("draw", F.try_divide(shared, scale).alias("r"))


def row_block_permutation(
    cells: DataFrame,
    target: DataFrame,
    axis: Sequence[str],
    draws: int,
    seed: int = 42,
    value: str = "value",
) -> DataFrame:
    """Off-diagonal correlation under permuted target rows: ``(draw, r)``.

    Scores and the diagonal mask stay in place: draw ``p`` leaves out cell
    ``(i, i)``, that is target cell ``(p(i), i)``. The aligned K*K cells are
    written down, so the scan behind them runs once.
    """
    _require_positive("draws", draws)
    return _null_draws(materialized(align(cells, target, axis, (), value), "aligned"), axis, draws, seed)


def permutation_pvalue(null: DataFrame, observed: DataFrame) -> DataFrame:
    """One- and two-sided p-values with the add-one rule.

    ``null`` has a row per draw and ``observed`` a single row, both with ``r``.
    """
    fixed = observed.select("r").scalar()
    hits = null.agg(
        F.max(fixed).alias("observed"),
        F.count(F.lit(1)).alias("draws"),
        F.count_if(F.col("r") >= fixed).alias("above"),
        F.count_if(F.abs("r") >= F.abs(fixed)).alias("beyond"),
    )
    return hits.select(
        "observed",
        "draws",
        ((F.col("above") + 1) / (F.col("draws") + 1)).alias("p_one_sided"),
        ((F.col("beyond") + 1) / (F.col("draws") + 1)).alias("p_two_sided"),
    )


def permutation_test(
    cells: DataFrame,
    target: DataFrame,
    axis: Sequence[str],
    draws: int = 100_000,
    seed: int = 42,
    value: str = "value",
) -> DataFrame:
    """Observed association and its permutation p-values from one pass over the cells."""
    _require_positive("draws", draws)
    aligned = materialized(align(cells, target, axis, (), value), "aligned")
    observed = association(off_diagonal(aligned))
    return permutation_pvalue(_null_draws(aligned, axis, draws, seed), observed)

