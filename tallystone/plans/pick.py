"""Pre-register the books of one screen run, and score them later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallystone import vocabulary as V
from tallystone.operators import books as B
from tallystone.operators import evaluation as E
from tallystone.plans.screen import run_screen
from tallystone.session import materialize
from tallystone.sources.ledger import append_picks


@dataclass(frozen=True)
class PickRun:
    picks: DataFrame
    summary: DataFrame
    candidates: DataFrame
    written: int


def run_pick(
    snapshots: DataFrame,
    profiles: DataFrame | None,
    market: DataFrame,
    prices: DataFrame,
    *,
    as_of: str,
    run_id: str,
    top: int = 20,
    decisions: DataFrame | None = None,
    ledger_path: str | None = None,
) -> PickRun:
    """Every strategy chooses from the same candidates at the same moment."""
    candidates = materialize(run_screen(snapshots, profiles, market).ranked, "candidates")
    selections = B.select_all(candidates, top)
    picks = B.picks_from_selections(selections, candidates, prices, as_of, run_id)
    if decisions is not None:
        picks = picks.unionByName(B.agent_picks(decisions, candidates, prices, as_of, run_id))
    picks = materialize(picks, "picks")
    written = append_picks(picks, ledger_path) if ledger_path else 0
    return PickRun(picks, B.batch_summary(picks), candidates, written)


@dataclass(frozen=True)
class Evaluation:
    scored: DataFrame
    scores: DataFrame
    comparisons: DataFrame
    warnings: DataFrame


def evaluate(
    picks: DataFrame, forward_prices: DataFrame, *, cost_bps: float = V.COST_BPS
) -> Evaluation:
    """Grade the books of one vintage on one set of forward prices."""
    scored = materialize(
        E.score_picks(E.dedup_last(picks), forward_prices, cost_bps), "scored"
    )
    # At most one row per strategy.
    scores = materialize(E.strategy_scores(scored), "scores")
    return Evaluation(scored, scores, E.compare_agent(scores), E.sample_warnings(scores))
