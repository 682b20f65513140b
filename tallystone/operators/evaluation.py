"""Forward scoring of recorded picks: distributions, comparisons, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions.columns import is_finite, safe_div, signed_percent
from tallystone.operators.ranking import group_percentiles

NOTHING_GRADED = "nothing in this book could be graded (missing reference or forward prices)."
SKEW_NOTE = (
    "mean sits well above median: the book's return leans on a few big "
    "winners (Bessembinder skew), so the median is the more honest summary."
)
SKEW_GAP = 0.02


def pick_id() -> Column:
    return F.concat_ws(":", F.col("as_of").cast("string"), "strategy", "entity_id")


def dedup_last(picks: DataFrame) -> DataFrame:
    """The last ledger row of each pick; the rank filter also runs before the shuffle."""
    w = Window.partitionBy("as_of", "strategy", "entity_id").orderBy(F.col("ordinal").desc())
    return picks.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def scope_to_vintage(
    picks: DataFrame, vintage: str | None = None, run_id: str | None = None
) -> DataFrame:
    """One comparable book: the run, else the given pick date, else the newest pick date."""
    if run_id:
        return picks.where(F.col("run_id") == run_id)
    if vintage:
        return picks.where(F.col("as_of") == F.lit(vintage).cast("date"))
    newest = picks.agg(F.max("as_of").alias("m")).scalar()
    return picks.where(F.col("as_of") == newest)


def scope_note(
    picks: DataFrame, vintage: str | None = None, run_id: str | None = None
) -> DataFrame:
    """At most one row that says why picks were left out or that none was found."""
    if run_id or vintage:
        what = f"run '{run_id}'" if run_id else f"vintage {vintage}"
        found = scope_to_vintage(picks, vintage, run_id).agg(F.count(F.lit(1)).alias("n"))
        return found.where("n = 0").select(F.lit(f"no picks found for {what}.").alias("note"))
    spans = picks.agg(F.count_distinct("as_of").alias("n"), F.max("as_of").alias("latest"))
    text = F.format_string(
        "the ledger spans %d pick dates; grading only the latest (%s), because one "
        "forward-price snapshot cannot fairly grade picks from different dates. Pass vintage "
        "or run_id to grade another, and grade each vintage against its own forward window.",
        "n",
        F.col("latest").cast("string"),
    )
    return spans.where("n > 1").select(text.alias("note"))


def real_quote(price: Column) -> Column:
    return is_finite(price) & (price > 0)


def score_picks(
    picks: DataFrame, forward_prices: DataFrame, cost_bps: float = V.COST_BPS
) -> DataFrame:
    """Every pick with exit price and returns; the returns are NULL where it cannot be graded."""
    exits = forward_prices.select("entity_id", F.col("price").alias("exit_price"))
    joined = picks.join(exits, "entity_id", "left")
    gradeable = F.coalesce(
        real_quote(F.col("reference_price")) & real_quote(F.col("exit_price")), F.lit(False)
    )
    gross = F.col("exit_price") / F.col("reference_price") - F.lit(1.0)
    return (
        joined.withColumn("gradeable", gradeable)
        .withColumn("gross_return", F.when(F.col("gradeable"), gross))
        .withColumn("net_return", F.col("gross_return") - F.lit(cost_bps / 10_000.0))
    )


QUANTILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def strategy_scores(scored: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Book return and full return distribution per strategy.

    Only rows with a positive weight are held; weights are renormalized over what can be graded.
    """
    held = F.col("weight") > 0
    graded = held & F.col("gradeable")
    net = F.when(graded, F.col("net_return"))
    base = scored.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_picks"),
        F.count_if(graded).alias("n_scored"),
        F.count_if(held & ~F.col("gradeable")).alias("ungradeable"),
        safe_div(F.sum(net * F.col("weight")), F.sum(F.when(graded, F.col("weight")))).alias(
            "weighted"
        ),
        F.avg(net).alias("mean"),
        F.stddev_pop(net).alias("stdev"),
        F.min(net).alias("minimum"),
        F.max(net).alias("maximum"),
        F.avg(F.when(graded, (F.col("net_return") > 0).cast("int"))).alias("hit_rate"),
    )
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    quantiles = group_percentiles(
        scored.where(graded), ["strategy"], "net_return", QUANTILES, **options
    )
    note = F.when(F.col("n_scored") == 0, F.lit(NOTHING_GRADED)).when(
        F.col("mean") - F.col("median") > SKEW_GAP, F.lit(SKEW_NOTE)
    )
    return base.join(quantiles, "strategy", "left").select(
        "strategy",
        "n_picks",
        "n_scored",
        "ungradeable",
        F.coalesce("weighted", "mean").alias("portfolio_return"),
        "mean",
        "median",
        "stdev",
        "minimum",
        "p10",
        "p25",
        "p75",
        "p90",
        "maximum",
        "hit_rate",
        note.alias("note"),
    )


def compare_agent(scores: DataFrame, minimum: int = V.MIN_CREDIBLE_SAMPLE) -> DataFrame:
    """The agent's book against each baseline. ``scores`` has at most one row per strategy."""
    agent = lambda c: F.max(F.when(F.col("strategy") == "agent", F.col(c))).over(
        Window.partitionBy(F.lit(0))
    )
    order = F.array_position(F.array(*[F.lit(b) for b in V.BASELINES]), F.col("strategy"))
    both = scores.select(
        "strategy",
        F.col("portfolio_return").alias("baseline_return"),
        F.col("n_scored").alias("n_baseline"),
        F.col("median").alias("baseline_median"),
        agent("portfolio_return").alias("agent_return"),
        F.coalesce(agent("n_scored"), F.lit(0)).alias("n_agent"),
        agent("median").alias("agent_median"),
    ).where(F.col("strategy").isin(*V.BASELINES))
    thin = (F.col("n_agent") < minimum) | (F.col("n_baseline") < minimum)
    comparable = F.col("agent_return").isNotNull() & F.col("baseline_return").isNotNull() & ~thin
    deltas = both.withColumns(
        {
            "delta": F.when(comparable, F.col("agent_return") - F.col("baseline_return")),
            "median_delta": F.when(comparable, F.col("agent_median") - F.col("baseline_median")),
        }
    )
    d, m, name = F.col("delta"), F.col("median_delta"), F.col("strategy")
    disagree = F.coalesce(m.isNotNull() & ((d > 0) != (m > 0)), F.lit(False))
    beat = (d > 0) & (m.isNull() | (m > 0))
    phrase = F.concat(
        F.lit("mean "),
        signed_percent(d),
        F.when(m.isNotNull(), F.concat(F.lit(", median "), signed_percent(m))).otherwise(""),
    )
    verdict = (
        F.when(F.col("agent_return").isNull(), F.lit("no agent book to compare yet."))
        .when(
            F.col("baseline_return").isNull(),
            F.concat(
                F.lit("the "), name, F.lit(" baseline had nothing gradeable to compare against.")
            ),
        )
        .when(
            thin,
            F.format_string(
                "insufficient evidence (agent N=%d, %s N=%d; need >= %d each). "
                "Any gap here is noise.",
                "n_agent",
                name,
                "n_baseline",
                F.lit(minimum),
            ),
        )
        .when(
            disagree,
            F.concat(
                F.lit("mixed vs "), name, F.lit(" ("), phrase,
                F.lit(
                    "): mean and median disagree, so a few outliers are driving the average "
                    "-- inconclusive, not evidence of signal."
                ),
            ),
        )
        .when(
            (name == "ev_ebit_decile") & ~beat,
            F.concat(
                F.lit("the agent did NOT beat the EV/EBIT decile ("), phrase,
                F.lit(
                    "). On this evidence the LLM research layer is cost, not signal -- a "
                    "one-line value screen did as well or better."
                ),
            ),
        )
        .when(beat, F.concat(F.lit("the agent beat "), name, F.lit(" ("), phrase, F.lit(").")))
        .when(
            (d == 0) & (m.isNull() | (m == 0)),
            F.concat(F.lit("the agent matched "), name, F.lit(" ("), phrase, F.lit(").")),
        )
        .otherwise(F.concat(F.lit("the agent trailed "), name, F.lit(" ("), phrase, F.lit(").")))
    )
    return deltas.select(
        order.cast("int").alias("position"),
        name.alias("baseline"),
        "agent_return",
        "baseline_return",
        "delta",
        "median_delta",
        disagree.alias("signs_disagree"),
        verdict.alias("verdict"),
    )


def sample_warnings(scores: DataFrame, minimum: int = V.MIN_CREDIBLE_SAMPLE) -> DataFrame:
    """A warning keyed on the smallest book that holds anything."""
    smallest = scores.agg(
        F.min(F.when(F.col("n_scored") > 0, F.col("n_scored"))).alias("thin")
    )
    text = F.when(
        F.col("thin").isNull(),
        F.lit(
            "Nothing scoreable yet: no pick had both a reference and a forward price. Supply "
            "forward prices and let the picks age before reading anything into this."
        ),
    ).when(
        F.col("thin") < minimum,
        F.format_string(
            "!! at least one strategy has only %d scored pick(s) -- FAR too few to mean "
            "anything. A coin flip returns 70%%+ hit rates on small samples routinely, and one "
            "big winner swings the mean entirely. Treat every thin book here as a plumbing "
            "check, not evidence -- aim for %d+ per strategy, ideally 100+, before judging.",
            F.col("thin"),
            F.lit(minimum),
        ),
    )
    return smallest.select(text.alias("warning")).where(F.col("warning").isNotNull())


def labeled_observations(scored: DataFrame) -> DataFrame:
    """Training rows: features and realized net return of graded picks that carry features."""
    usable = F.col("gradeable") & (F.col("weight") > 0) & (F.size("features") > 0)
    return scored.where(usable).select(
        "as_of", "strategy", "entity_id", "features", F.col("net_return").alias("forward_return")
    )


def feature_names(observations: DataFrame) -> DataFrame:
    """Every feature seen in the training rows, in name order."""
    return (
        observations.select(F.explode(F.map_keys("features")).alias("feature"))
        .distinct()
        .orderBy("feature")
    )
