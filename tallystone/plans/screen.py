"""The screen: metrics, exclusion rules, cohort ranking and its tallies."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions.columns import cohort_label
from tallystone.operators import screening as S
from tallystone.operators.metrics import compute_metrics
from tallystone.session import materialize


@dataclass
class ScreenResult:
    """Lazy frames of one screen run.

    ``source`` is the checked universe as a plan. Readers of the checks store it whole; the ranking
    stores only who survives, where and with which values, and no reason text is made for it.
    """

    source: DataFrame
    gated: Column
    min_cohort: int
    weights: dict[str, float] | None

    @cached_property
    def checked(self) -> DataFrame:
        """One row per entity, written once: tallies and exclusions read it several times."""
        return materialize(self.source, "checked")

    @cached_property
    def universe(self) -> DataFrame:
        return self.checked.where(~self.gated)

    @cached_property
    def survivors(self) -> DataFrame:
        columns = ["entity_id", "name", *S.COHORT, S.ranking_map().alias("metrics"), "underfollowed"]
        if "checked" in self.__dict__:
            return self.universe.where(~S.is_excluded(F.col("checks"))).select(*columns)
        # Stored with a flag and filtered after: a filter on the plan would go down into it and repeat the metrics.
        flagged = self.source.select(*columns, (self.gated | S.any_excludes()).alias("dropped"))
        return materialize(flagged, "survivors").where(~F.col("dropped")).drop("dropped")

    @cached_property
    def ranked(self) -> DataFrame:
        return S.rank(self.survivors, self.weights, self.min_cohort)

    @cached_property
    def excluded(self) -> DataFrame:
        dropped = self.gated | S.is_excluded(F.col("checks"))
        sector = F.array(F.concat(F.lit("excluded sector: "), "sector"))
        reasons = F.when(self.gated, sector).otherwise(S.exclusion_reasons(F.col("checks")))
        return self.checked.where(dropped).select("entity_id", "name", reasons.alias("reasons"))

    @cached_property
    def insufficient_checks(self) -> DataFrame:
        return (
            self.universe.select(F.explode("checks").alias("c"))
            .where(F.col("c.decision") == S.INSUFFICIENT)
            .groupBy(F.col("c.rule").alias("rule"))
            .agg(F.count(F.lit(1)).alias("entities"))
        )

    @cached_property
    def cohort_sizes(self) -> DataFrame:
        return S.cohort_sizes(self.survivors).select(cohort_label().alias("cohort"), "members")

    @cached_property
    def universe_size(self) -> DataFrame:
        return self.universe.agg(F.count(F.lit(1)).alias("universe_size"))


def checked_universe(
    snapshots: DataFrame, profiles: DataFrame | None, market: DataFrame | None
) -> DataFrame:
    """One row per entity: metrics, profile fields, rule results."""
    metrics = compute_metrics(snapshots, market)
    return S.attach_profile(metrics, profiles).withColumn("checks", S.evaluate_excludes())


def run_screen(
    snapshots: DataFrame,
    profiles: DataFrame | None = None,
    market: DataFrame | None = None,
    *,
    min_cohort: int = V.MIN_COHORT,
    weights: dict[str, float] | None = None,
    include_excluded_sectors: bool = False,
) -> ScreenResult:
    gated = F.col("sector_excluded") & F.lit(not include_excluded_sectors)
    return ScreenResult(checked_universe(snapshots, profiles, market), gated, min_cohort, weights)


def screen_notes(result: ScreenResult, has_prices: bool, keep_empty: bool = False) -> DataFrame:
    """What a reader has to know about the run: missing prices, blind spots, thin cohorts.

    ``keep_empty`` keeps the rows of blind spots and thin cohorts when there are none: a NULL note, a count of zero.
    """
    rules = result.insufficient_checks.agg(
        F.concat_ws(", ", F.array_sort(F.collect_set("rule"))).alias("rules")
    ).select(
        F.lit(2).alias("position"),
        F.when(
            F.col("rules") != "",
            F.concat(
                F.lit("Excludes not evaluated for lack of data (blind spots): "),
                "rules",
                F.lit(". These filings were NOT verified clean on those rules."),
            ),
        ).alias("note"),
    )
    thin = result.cohort_sizes.agg(
        F.count_if(F.col("members") < V.MIN_COHORT).alias("thin")
    ).select(
        F.lit(3).alias("position"),
        F.when(
            (F.col("thin") > 0) | F.lit(keep_empty),
            F.format_string(
                "%d cohort(s) too small to z-score -- their members are listed but unranked. "
                "Rank becomes meaningful as the universe grows.",
                F.col("thin"),
            ),
        ).alias("note"),
    )
    prices = result.universe_size.where(F.lit(not has_prices)).select(
        F.lit(1).alias("position"),
        F.lit(
            "No price data supplied: the valuation (cheap) block is absent, so names "
            "are ranked on quality and safety only. Supply prices to rank on cheapness."
        ).alias("note"),
    )
    counted = rules.unionByName(thin)
    return prices.unionByName(counted if keep_empty else counted.where(F.col("note").isNotNull()))
