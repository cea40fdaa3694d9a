"""Robustness audits of a rebalancing rule, on the event table (a few rows per fold)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.draws import draw
from tickloom.functions.session import cut_lineage
from tickloom.operators import portfolio as pf
from tickloom.operators.joins import expand_grid
from tickloom.operators.splits import fold_cases

# fixed values: the candidate grid
QUANTILES = [0.20, 0.25, 0.33, 0.40, 0.50]
NORMAL_WEIGHTS = [0.00, 0.10, 0.20]
HEDGE_WEIGHTS = [-0.10, -0.20, -0.30]
BORROW, SLIPPAGE_BPS = 0.05, 25.0


def alpha_decomposition(events: DataFrame, folds: DataFrame) -> DataFrame:
    """Core only, active only and the hedge rule against buy-and-hold."""
    core = F.coalesce("core_return", F.lit(0.0))
    active = F.coalesce("active_return_net", F.lit(0.0))
    full = pf.dynamic_hedge(F.lit(pf.FROZEN_THRESHOLD), F.lit(pf.NORMAL_WEIGHT), F.lit(pf.HEDGE_WEIGHT), core, active)
    stacked = pf.variants(events, {"core_only": core, "active_only": active, "dynamic_hedge": full})
    return pf.fold_rollup(pf.score_folds(stacked, folds, ["variant_id"], "buyhold_annualized_return"), ["variant_id"])


def decomposition_decision(summary: DataFrame, limit: float = 0.60) -> DataFrame:
    """Share of the rule's excess that the plain rebalanced core already earns."""

    def excess(name):
        return F.max(F.when(F.col("variant_id") == name, F.col("mean_excess")))

    out = summary.agg(
        excess("dynamic_hedge").alias("full_mean_excess"),
        excess("core_only").alias("core_only_mean_excess"),
        excess("active_only").alias("active_only_mean_excess"),
    ).withColumn("bonus_share", F.col("core_only_mean_excess") / F.nullif("full_mean_excess", F.lit(0.0)))
    return out.withColumn(
        "decision", F.when(F.col("bonus_share") >= limit, "demote").otherwise("survives")
    )


def rebalanced_benchmark(events: DataFrame, folds: DataFrame) -> DataFrame:
    """Breadth tilt and hedge rule against the costed rebalanced core, fold by fold."""
    hedge = pf.dynamic_hedge(F.lit(pf.FROZEN_THRESHOLD), F.lit(pf.NORMAL_WEIGHT), F.lit(pf.HEDGE_WEIGHT))
    return pf.score_folds(pf.variants(events, {"breadth_tilt": pf.breadth_tilt(), "dynamic_hedge": hedge}), folds, ["variant_id"])


def _thresholds(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quantiles of breadth over the fit events of each case."""
    breadth = F.coalesce("breadth_rel_adv_frac", F.lit(1.0))
    cells = F.array(
        *[F.struct(F.lit(q).alias("quantile"), F.percentile(breadth, F.lit(q)).alias("threshold")) for q in QUANTILES]
    )
    return (
        events.filter("role = 'fit'")
        .groupBy(*keys)
        .agg(cells.alias("_t"))
        .withColumn("_t", F.explode("_t"))
        .select(*keys, "_t.quantile", "_t.threshold")
    )


def threshold_search(
    events: DataFrame,
    folds: DataFrame,
    cases: Sequence[tuple[Sequence[int], Sequence[int]]],
    normal: Sequence[float] = (pf.NORMAL_WEIGHT,),
    hedge: Sequence[float] = (pf.HEDGE_WEIGHT,),
    costed_short: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Choose the rule on the fit folds of each case, freeze it, score it on the other folds.

    Returns (fit summary of every candidate, out-of-sample summary of the winner) with one set of rows per case.
    """
    tagged = fold_cases(events, cases)
    spec = ["case_id", "quantile", "threshold", "normal_weight", "hedge_weight"]
    grid = expand_grid(_thresholds(tagged, ["case_id"]), normal_weight=list(normal), hedge_weight=list(hedge))
    # at most cases * 5 * 3 * 3 rows
    candidates = tagged.join(F.broadcast(grid), "case_id")
    t, n, h = F.col("threshold"), F.col("normal_weight"), F.col("hedge_weight")
    ret = pf.dynamic_hedge(t, n, h)
    if costed_short:
        ret = ret - pf.short_cost(t, h, F.lit(BORROW), F.lit(SLIPPAGE_BPS))
    scored = pf.score_folds(candidates.withColumn("strategy_return", ret), folds, [*spec, "role"])
    # one row per candidate and role; read by the choice and by the replay of the winner
    summary = cut_lineage(pf.fold_rollup(scored, [*spec, "role"]))
    fit = summary.filter("role = 'fit'").drop("role")
    best = F.struct(
        "folds_beating", F.round("mean_excess", 12).alias("e"), (-F.col("quantile")).alias("q"),
        (-F.col("normal_weight")).alias("n"), F.col("hedge_weight").alias("h"),
    )
    winner = fit.groupBy("case_id").agg(F.max_by(F.struct(*spec[1:]), best).alias("_w")).select("case_id", "_w.*")
    oos = summary.filter("role = 'oos'").drop("role").join(F.broadcast(winner), spec, "left_semi")
    return fit, oos


def random_null(events: DataFrame, folds: DataFrame, seeds: int = 1000) -> DataFrame:
    """Distribution of the mean excess when the same number of hedged events is drawn at random.

    Draws are the first ``hedge_count`` events in hashed order, so each seed is a uniform sample without replacement
    that does not depend on partitioning.
    """
    core, active, breadth = pf._inputs()
    actual = breadth <= pf.FROZEN_THRESHOLD
    flagged = events.select("fold_id", "k", core.alias("_c"), active.alias("_a"), actual.alias("_hedged"))
    counted = flagged.withColumn("_m", F.sum(F.col("_hedged").cast("int")).over(Window.partitionBy()))
    drawn = counted.withColumn("seed", F.explode(F.sequence(F.lit(-1), F.lit(seeds - 1))))
    order = Window.partitionBy("seed").orderBy(draw(F.col("seed"), "fold_id", "k"), "fold_id", "k")
    ranked = drawn.withColumn("_rn", F.row_number().over(order))
    # seed -1 is the rule itself
    hedged = F.when(F.col("seed") < 0, F.col("_hedged")).otherwise(F.col("_rn") <= F.col("_m"))
    weight = F.when(hedged, pf.HEDGE_WEIGHT).otherwise(pf.NORMAL_WEIGHT)
    returns = ranked.withColumn("strategy_return", (1.0 - weight) * F.col("_c") + weight * F.col("_a"))
    return pf.fold_rollup(pf.score_folds(returns, folds, ["seed"]), ["seed"])


def null_decision(null: DataFrame, limit: float = 0.75) -> DataFrame:
    """Where the rule stands in the random distribution."""
    actual = null.filter("seed < 0").select(F.col("mean_excess").alias("actual"), F.col("folds_beating").alias("actual_folds"))
    draws = null.filter("seed >= 0").join(F.broadcast(actual))
    out = draws.agg(
        F.count(F.lit(1)).alias("seed_count"),
        F.first("actual").alias("actual_mean_excess"),
        F.first("actual_folds").alias("actual_folds_beating"),
        F.percentile("mean_excess", F.lit(0.75)).alias("null_p75"),
        F.percentile("mean_excess", F.lit(0.90)).alias("null_p90"),
        F.avg(F.when(F.col("mean_excess") < F.col("actual"), 1.0).otherwise(0.0)).alias("percentile"),
    )
    return out.withColumn("decision", F.when(F.col("actual_mean_excess") <= F.col("null_p75"), "not_informative").otherwise("survives"))


def short_stress(events: DataFrame, folds: DataFrame) -> DataFrame:
    """The hedge rule under a grid of borrow rates and slippage."""
    grid = expand_grid(events, borrow=[0.02, 0.05, 0.10], slippage_bps=[10.0, 25.0, 50.0])
    t, h = F.lit(pf.FROZEN_THRESHOLD), F.lit(pf.HEDGE_WEIGHT)
    ret = pf.dynamic_hedge(t, F.lit(pf.NORMAL_WEIGHT), h) - pf.short_cost(t, h, F.col("borrow"), F.col("slippage_bps"))
    scored = pf.score_folds(grid.withColumn("strategy_return", ret), folds, ["borrow", "slippage_bps"])
    return pf.fold_rollup(scored, ["borrow", "slippage_bps"])


def short_names(events: DataFrame, futures: DataFrame) -> DataFrame:
    """Names shorted on hedged events, with the weight each carries and whether a future ever existed on it."""
    from tickloom.operators.joins import covered

    hedged = events.filter(F.coalesce("breadth_rel_adv_frac", F.lit(1.0)) <= pf.FROZEN_THRESHOLD)
    rows = hedged.select(
        "fold_id",
        "rebalance_ts",
        F.explode("top_names").alias("symbol"),
        (0.20 / F.greatest(F.lit(1), F.size("top_names"))).alias("short_weight"),
    )
    return covered(rows, futures, "symbol", "has_future")


def universe_transfer(panel: DataFrame, score: str, every: int = 30, folds: int = 10) -> tuple[DataFrame, DataFrame]:
    """The frozen rule on another universe, without costs: (fold rows, one summary row)."""
    events = pf.rebalance_events(panel, score, 10, every, folds, ["breadth_rel_adv_frac"])
    table = pf.fold_table(panel, events, folds)
    ret = pf.dynamic_hedge(
        F.lit(pf.FROZEN_THRESHOLD), F.lit(pf.NORMAL_WEIGHT), F.lit(pf.HEDGE_WEIGHT), F.col("core_return"), F.col("active_return")
    )
    rows = pf.score_folds(events.withColumn("strategy_return", ret), table, (), "buyhold_annualized_return")
    summary = rows.agg(
        F.count_distinct("fold_id").alias("fold_count"),
        F.avg("strategy_annualized").alias("mean_strategy_annualized"),
        F.avg("benchmark_annualized").alias("mean_buyhold_annualized"),
        F.min("strategy_annualized").alias("min_strategy_annualized"),
        F.min("benchmark_annualized").alias("min_buyhold_annualized"),
        F.sum(F.col("beats").cast("int")).alias("folds_beating"),
        F.bool_and("beats").alias("all_folds_beat"),
    )
    return rows, summary
