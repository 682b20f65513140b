"""Strategy books: which names each baseline holds, and the picks they become."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions.columns import finite_map, is_finite
from tallystone.operators.ranking import match_keys, with_rank
from tallystone.operators.screening import rank_order

def _selection(rank: Column, score: Column, strategy: str) -> list[Column]:
    return [
        F.lit(strategy).alias("strategy"),
        F.col("entity_id"),
        rank.cast("int").alias("rank"),
        score.cast("double").alias("score"),
    ]


def equal_weight_universe(candidates: DataFrame) -> DataFrame:
    """Every survivor, without a rank."""
    return candidates.select(
        *_selection(F.lit(None), F.col("composite"), "universe_ew")
    )


def ordered_universe(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(*rank_order())


def top_composite(candidates: DataFrame, top: int) -> DataFrame:
    """The best scored names. The window numbers only the ``top`` rows that are left."""
    best = candidates.where(F.col("composite").isNotNull()).orderBy(*rank_order()).limit(top)
    position = F.row_number().over(Window.orderBy(*rank_order()))
    return best.select(*_selection(position, F.col("composite"), "screen"))


def ev_ebit_decile(
    candidates: DataFrame, fraction: float = V.DECILE_FRACTION, hot_rows: int | None = None
) -> DataFrame:
    """The cheapest share of each cohort by EV/EBIT, at least one name, then ranked together."""
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    eligible = candidates.select(
        "entity_id", "cohort", F.col("metric_values")["ev_ebit"].alias("ev")
    ).where(is_finite("ev") & (F.col("ev") > 0))
    sizes = eligible.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))
    placed = with_rank(eligible, ["cohort"], [F.col("ev"), F.col("entity_id")], "place", **options)
    take = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(fraction)))
    chosen = match_keys(placed, sizes, ["cohort"], "inner").where(F.col("place") <= take)
    pooled = with_rank(
        chosen.select("entity_id", "ev"), [], [F.col("ev"), F.col("entity_id")], "pooled"
    )
    return pooled.select(*_selection(F.col("pooled"), -F.col("ev"), "ev_ebit_decile"))


# Baseline selectors by strategy: (candidates, top) -> selections.
SELECTORS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "universe_ew": lambda c, top: equal_weight_universe(c),
    "screen": top_composite,
    "ev_ebit_decile": lambda c, top: ev_ebit_decile(c),
}


def select_all(
    candidates: DataFrame,
    top: int,
    selectors: dict[str, Callable[[DataFrame, int], DataFrame]] = SELECTORS,
) -> DataFrame:
    """Selections of every baseline."""
    return reduce(
        lambda a, b: a.unionByName(b), [choose(candidates, top) for choose in selectors.values()]
    )


def _pick_columns(as_of: str, run_id: str) -> list[Column]:
    return [
        F.lit(as_of).cast("date").alias("as_of"),
        F.col("strategy"),
        F.col("entity_id"),
        F.col("name"),
        F.coalesce("cohort", F.lit("")).alias("cohort"),
        F.col("price").alias("reference_price"),
        F.lit(None).cast("string").alias("currency"),
        F.col("weight"),
        F.col("rank"),
        F.col("score"),
        F.col("vetoed"),
        F.coalesce(
            finite_map("metric_values"), F.create_map().cast("map<string,double>")
        ).alias("features"),
        F.lit(run_id).alias("run_id"),
        F.col("note"),
    ]


def _with_candidate(rows: DataFrame, candidates: DataFrame, prices: DataFrame) -> DataFrame:
    known = candidates.select("entity_id", "name", "cohort", "metric_values")
    quotes = prices.select("entity_id", "price")
    return rows.join(known, "entity_id", "left").join(quotes, "entity_id", "left")


def picks_from_selections(
    selections: DataFrame, candidates: DataFrame, prices: DataFrame, as_of: str, run_id: str
) -> DataFrame:
    """Equal-weight picks: one over the size of the strategy's book."""
    sizes = selections.groupBy("strategy").agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    # One row per strategy, and the strategies are a fixed set of five.
    weighted = selections.join(F.broadcast(sizes), "strategy")
    full = _with_candidate(weighted, candidates, prices).withColumns(
        {"vetoed": F.lit(None).cast("boolean"), "note": F.lit(None).cast("string")}
    )
    return full.select(*_pick_columns(as_of, run_id))


def agent_picks(
    decisions: DataFrame, candidates: DataFrame, prices: DataFrame, as_of: str, run_id: str
) -> DataFrame:
    """Researched names: survivors share the weight, vetoed names stay with weight zero.

    ``decisions`` has entity_id, vetoed, reasons.
    """
    survivors = decisions.agg(F.count_if(~F.col("vetoed")).alias("survivors"))
    weighted = decisions.withColumn("strategy", F.lit("agent")).join(
        F.broadcast(survivors.withColumn("strategy", F.lit("agent"))), "strategy"
    )
    full = _with_candidate(weighted, candidates, prices).withColumns(
        {
            "weight": F.when(F.col("vetoed") | (F.col("survivors") == 0), F.lit(0.0)).otherwise(
                F.lit(1.0) / F.col("survivors")
            ),
            "rank": F.lit(None).cast("int"),
            "score": F.lit(None).cast("double"),
            "note": F.when(
                F.col("vetoed"),
                F.coalesce(F.nullif(F.array_join("reasons", "; "), F.lit("")), F.lit("vetoed")),
            ),
        }
    )
    return full.select(*_pick_columns(as_of, run_id))


def batch_summary(picks: DataFrame) -> DataFrame:
    """Picks and priced picks per strategy; the agent counts only what it holds."""
    held = picks.where((F.col("strategy") != "agent") | (F.col("weight") > 0))
    return held.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("picks"), F.count("reference_price").alias("priced")
    )
