"""Experiment selection: eligibility, score, best of family, rank, promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_eligible(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = (), eligible: str = "eligible") -> DataFrame:
    """Rank the eligible rows by descending columns (experiment id breaks ties); other rows get no rank.

    A comparison table has one row per experiment, so a single window task per group is enough.
    """
    w = Window.partitionBy(*by, eligible).orderBy(*[F.col(c).desc_nulls_last() for c in order], F.col("experiment_id"))
    return df.withColumn(name, F.when(F.col(eligible), F.row_number().over(w)))


# fixed values: presets as (fewest trades, least gap in spread, best of family only, number promoted)
PRESETS = {
    "e302": (1000, -0.00025, False, 2),
    "generalization_next": (750, -0.00025, True, 3),
    "generalization_wave2": (500, -0.00025, True, 3),
    "e102_deepdive": (600, 0.0, True, 4),
    "cross_sectional_60m": (750, -0.00025, True, 3),
    "ablation_grid": (500, None, False, 4),
    "setup_regime": (500, -0.00025, True, 4),
    "market_state_60m": (500, -0.00025, False, 4),
    "multiscale_60m": (500, -0.00025, False, 4),
    "second_timeframe_60m": (500, -0.00025, False, 4),
    "intrahour_path_v1": (500, -0.00025, False, 4),
    "breadth_context_60m": (500, -0.00025, False, 4),
    "time_distribution_v2": (500, -0.00025, False, 4),
    "native_15m_execution": (500, -0.00025, False, 4),
    "native_15m_failed_breakout": (500, -0.00025, False, 4),
    "native_15m_open_drive": (500, -0.00025, False, 4),
    "opening_auction_gap_liquidity": (500, -0.00025, False, 2),
    "native_15m_session_phase": (500, -0.00025, False, 4),
    "native_15m_holding_horizon": (500, -0.00025, False, 4),
    "native_15m_topk_event_rank": (300, 0.0, False, 4),
    "native_15m_mean_reversion_exhaustion": (300, 0.0, False, 4),
    "native_15m_breadth_event": (300, 0.0, False, 4),
    "sixty_minute_daily_context": (300, 0.0, False, 4),
    "cross_sectional_commonality_residual": (300, 0.0, False, 3),
    "intraday_volume_liquidity_forecast": (300, 0.0, False, 2),
    "event_outcome_accounting": (250, None, False, 2),
    "portfolio_rank_60m": (500, 0.0, True, 4),
}


def _z(name: str):
    return F.coalesce(name, F.lit(0.0))


def _rules(preset: str):
    """(eligibility, score, ranking columns) of a preset."""
    trades, spread, _, _ = PRESETS[preset]
    auc, bal, gap, ic = (F.col(c) for c in ("gap_auc", "gap_balanced_accuracy", "gap_spread_top_bottom", "gap_ic_spearman"))
    enough = F.col("real_trade_count") >= trades
    binary = F.col("label_type") == "binary"
    plain = _z("gap_auc") + _z("gap_balanced_accuracy") + _z("real_spread_top_bottom")
    by_ic = _z("gap_ic_spearman") + _z("gap_spread_top_bottom") + _z("real_spread_top_bottom")
    order = ["selection_score", "real_spread_top_bottom", "real_trade_count"]
    if preset == "e302":
        order = ["real_auc", "real_balanced_accuracy", "gap_spread_top_bottom", "real_spread_top_bottom"]
        return (auc > 0) & (bal > 0) & (gap >= spread) & enough, plain, order
    if preset == "generalization_next":
        order = ["gap_auc", "gap_balanced_accuracy", "real_auc", "real_spread_top_bottom"]
        return (auc > 0) & (bal > 0) & (gap >= spread) & enough, plain, order
    if preset == "generalization_wave2":
        ok = ((auc > 0) & (bal > 0) & (gap >= spread)) | ((ic > 0) & (gap >= spread))
        return ok & enough, F.when(binary, plain).otherwise(by_ic), order
    if preset == "ablation_grid":
        ok = F.when(binary, (auc > 0) & (bal > 0) & enough).otherwise((ic > 0) & enough)
        return ok, F.when(binary, plain).otherwise(by_ic), order
    if preset == "intraday_volume_liquidity_forecast":
        return (auc > 0) & (bal >= 0) & (gap >= spread) & enough, plain + _z("gap_spread_top_bottom"), order
    if preset == "event_outcome_accounting":
        ok = (auc > 0) & (bal >= 0) & (F.col("real_top_decile_net_ret") > 0) & (F.col("gap_top_decile_net_ret") > 0)
        score = (
            _z("gap_auc") + _z("gap_balanced_accuracy") + 100.0 * _z("real_top_decile_net_ret")
            + 100.0 * _z("gap_top_decile_net_ret") + 50.0 * _z("real_spread_top_bottom")
        )
        return ok & (F.col("real_spread_top_bottom") >= 0) & enough, score, ["selection_score", "real_top_decile_net_ret", "real_trade_count"]
    if preset == "portfolio_rank_60m":
        score = _z("gap_ic_spearman") + _z("gap_spread_top_bottom") + 0.25 * _z("real_spread_top_bottom")
        return (ic > 0) & (gap > spread) & enough, score, order
    return (auc > 0) & (bal > 0) & (gap >= spread) & enough, plain, order


def shortlist(compare: DataFrame, preset: str, families: dict[str, str] | None = None) -> DataFrame:
    """Eligibility, score, family rank, shortlist rank and promotion of experiments under a preset.

    ``families`` maps experiment ids to families and limits the table to them; without it the ``family`` column counts.
    """
    _, _, per_family, promote = PRESETS[preset]
    if families is not None:
        pairs = F.create_map(*[F.lit(x) for item in families.items() for x in item])
        compare = compare.withColumn("family", F.element_at(pairs, F.col("experiment_id"))).filter("family IS NOT NULL")
    eligible, score, order = _rules(preset)
    flagged = compare.withColumn("eligible", F.coalesce(eligible, F.lit(False))).withColumn("selection_score", score)
    if per_family:
        flagged = rank_eligible(flagged, order, "family_rank", ["family"])
        flagged = flagged.withColumn("_in", F.coalesce(F.col("family_rank") == 1, F.lit(False)))
        again = order[:2] + ["real_spread_top_bottom"] if preset == "generalization_next" else order
        ranked = rank_eligible(flagged, again, "shortlist_rank", eligible="_in").drop("_in")
    else:
        ranked = rank_eligible(flagged, order, "shortlist_rank").withColumn("family_rank", F.lit(None).cast("int"))
    return ranked.withColumn("promoted", F.coalesce(F.col("shortlist_rank") <= promote, F.lit(False))).withColumn(
        "preset", F.lit(preset)
    )


def ablation_best(compare: DataFrame, by: str) -> DataFrame:
    """Best experiment per target or feature combination: eligible ones first, then score, then spread."""
    eligible, score, _ = _rules("ablation_grid")
    flagged = compare.withColumn("eligible", F.coalesce(eligible, F.lit(False))).withColumn("selection_score", score)
    w = Window.partitionBy(by).orderBy(
        F.col("eligible").desc(), F.col("selection_score").desc(), F.col("real_spread_top_bottom").desc(), "experiment_id"
    )
    return flagged.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# fixed values: what each branch comparison sorts its benchmark rows by: a sum of terms, or terms one after another
BRANCH_SCORES = {
    "plain": ["gap_auc", "gap_balanced_accuracy", "real_spread_top_bottom"],
    "wave2": ["gap_auc", "gap_balanced_accuracy", "gap_ic_spearman", "real_spread_top_bottom"],
}
BRANCH_ORDERS = {"generalization_next": ["real_auc", "real_balanced_accuracy", "real_spread_top_bottom"]}
#: Columns of a comparison, as far as its tables have them.
BRANCH_COLUMNS = (
    "experiment_id", "label_type", "real_auc", "real_balanced_accuracy", "real_ic_spearman", "real_spread_top_bottom", "gap_auc",
    "gap_balanced_accuracy", "gap_ic_spearman", "gap_spread_top_bottom", "real_trade_count",
)


def branch_compare(
    sources: dict[str, DataFrame], current: DataFrame, prefix: str, score: str = "plain", candidates: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """Best benchmark row of each branch next to the promoted rows of the current shortlist.

    ``score`` names a sum of terms (missing ones count 0) or an order of columns (missing values last); ties go to the greater
    experiment id. ``candidates`` limits a branch to experiments; a branch without any row is left out. Each branch is one
    mergeable aggregate.
    """
    out = None
    columns = [c for c in BRANCH_COLUMNS if all(c in frame.columns for frame in [current, *sources.values()])]
    if score in BRANCH_ORDERS:
        order = [F.round(F.when(~F.isnan(c), F.col(c)), 12) for c in BRANCH_ORDERS[score]]
    else:
        order = [F.round(sum((_z(c) for c in BRANCH_SCORES[score]), F.lit(0.0)), 12)]
    for label, frame in sources.items():
        if candidates is not None and label in candidates:
            frame = frame.filter(F.col("experiment_id").isin(*candidates[label]))
        best = frame.groupBy().agg(F.max_by(F.struct(*columns), F.struct(*order, F.col("experiment_id"))).alias("_b")).filter("_b IS NOT NULL")
        row = best.select("_b.*", F.lit(label).alias("branch"), F.lit(False).alias("promoted"))
        out = row if out is None else out.unionByName(row)
    chosen = current.filter("promoted").select(
        *columns, F.concat(F.lit(prefix + "_"), F.coalesce("family", F.lit("Candidate"))).alias("branch"), F.lit(True).alias("promoted")
    )
    return chosen if out is None else out.unionByName(chosen)


def select_experiments(pools: dict[str, list], pool: str, ids: list[str] | None = None) -> list:
    """Experiments of a named pool, limited to ids; an id absent from the pool is looked up in all pools."""
    if pool not in pools:
        raise ValueError(f"unknown experiment pool {pool}")
    wanted = {i.strip() for i in ids or [] if i.strip()}
    chosen = [e for e in pools[pool] if not wanted or e.experiment_id in wanted]
    if wanted and not chosen:
        seen: dict[str, object] = {}
        for group in pools.values():
            for e in group:
                seen.setdefault(e.experiment_id, e)
        chosen = [e for i, e in seen.items() if i in wanted]
    return chosen


def top_experiment(compare: DataFrame) -> DataFrame:
    """The experiment with the best selection score; empty where no score exists."""
    if "selection_score" not in compare.columns:
        return compare.limit(0).select("experiment_id")
    return compare.filter("selection_score IS NOT NULL").groupBy().agg(
        F.max_by("experiment_id", F.struct(F.round("selection_score", 12), F.col("experiment_id"))).alias("experiment_id"),
        F.max("selection_score").alias("selection_score"),
    )
