"""Exclusion rules, cohorts, winsorized z-scores and the composite rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions.columns import (
    accounting_standard,
    clip,
    cohort_label,
    first_reason,
    is_excluded_sector,
    is_finite,
    is_underfollowed,
)
from tallystone.functions.number_text import fixed, percent
from tallystone.operators.ranking import group_percentiles, match_keys

EXCLUDE, PASS, INSUFFICIENT = "exclude", "pass", "insufficient_data"
COHORT = ["country", "accounting_standard", "sector"]
NO_METRICS = "no metrics computed for entity"


def check(rule: str, *branches: tuple[Column, str, str | Column]) -> Column:
    """struct<rule, decision, reason> of the first branch whose condition holds."""
    decision = first_reason(*[(c, d) for c, d, _ in branches])
    reason = first_reason(*[(c, r) for c, _, r in branches])
    return F.struct(
        F.lit(rule).alias("rule"), decision.alias("decision"), reason.alias("reason")
    )


ALWAYS = F.lit  # readability of the last branch


def check_dilution() -> Column:
    m = F.col("share_issuance")
    return check(
        "dilution",
        (m.isNull(), INSUFFICIENT, NO_METRICS),
        (
            ~m["ok"],
            INSUFFICIENT,
            F.coalesce(m["reason"], F.lit("share issuance not computable")),
        ),
        (
            m["value"] > V.DILUTION_LIMIT,
            EXCLUDE,
            F.concat(F.lit("shares grew "), percent(m["value"]), F.lit(" YoY — dilution")),
        ),
        (
            ALWAYS(True),
            PASS,
            F.concat(F.lit("share growth "), percent(m["value"]), F.lit(" YoY within limit")),
        ),
    )


def check_cash_runway() -> Column:
    m = F.col("cash_runway_months")
    return check(
        "cash_runway",
        (m.isNull(), INSUFFICIENT, NO_METRICS),
        (~m["ok"], INSUFFICIENT, F.coalesce(m["reason"], F.lit("cash runway not computable"))),
        (
            is_finite(m["value"]) & (m["value"] < V.MIN_RUNWAY_MONTHS),
            EXCLUDE,
            F.concat(
                F.lit("cash runway "), fixed(m["value"], 1),
                F.lit(" months — near-term insolvency risk; note the going-concern OPINION itself was not verified"),
            ),
        ),
        (ALWAYS(True), PASS, "cash runway of a year or more"),
    )


def check_delinquent_filings() -> Column:
    late = F.col("has_recent_late_filing")
    return check(
        "delinquent_filings",
        (late.isNull(), INSUFFICIENT, "filing-history flags unavailable"),
        (late, EXCLUDE, "recent NT 10-K/10-Q late filing"),
        (ALWAYS(True), PASS, "no recent late-filing notice"),
    )


def check_name_change() -> Column:
    months = F.col("name_changed_within_months")
    return check(
        "name_change",
        (~F.col("has_profile"), INSUFFICIENT, "no profile to check name/ticker history"),
        (
            months <= V.NAME_CHANGE_LOOKBACK_MONTHS,
            EXCLUDE,
            F.format_string("name/ticker changed %d months ago — shell-hijack pattern", months),
        ),
        (
            months.isNotNull(),
            PASS,
            F.format_string("last name change %d months ago, outside window", months),
        ),
        (~F.col("has_former_names"), PASS, "no name changes on record"),
        (ALWAYS(True), PASS, "former name(s) on record but none recent"),
    )


def check_shell() -> Column:
    revenue, kind = F.col("revenue"), F.col("entity_type")
    return check(
        "shell",
        (F.col("period_end").isNull(), INSUFFICIENT, "no snapshot to assess operations"),
        (F.abs(revenue) >= V.REVENUE_ZERO, PASS, "reports revenue -- operating"),
        (
            kind.isNull() | (kind == "operating"),
            PASS,
            "no revenue but not classified non-operating (pre-revenue, not a shell)",
        ),
        (
            ALWAYS(True),
            EXCLUDE,
            F.concat(
                F.lit("no revenue and entity_type '"), kind, F.lit("' — shell / blank-check")
            ),
        ),
    )


def _unwired(rule: str, reason: str) -> Callable[[], Column]:
    return lambda: check(rule, (ALWAYS(True), INSUFFICIENT, reason))


ALL_RULES: tuple[Callable[[], Column], ...] = (
    check_dilution,
    check_cash_runway,
    check_delinquent_filings,
    check_name_change,
    check_shell,
    _unwired("reverse_split", "needs 8-K / full-text scan for reverse splits -- not yet wired in"),
    _unwired(
        "toxic_convertibles",
        "needs filing-text scan for floating/discount convertibles -- not yet wired in",
    ),
    _unwired(
        "paid_promotion",
        "needs external promotion-database cross-reference -- not yet wired in",
    ),
)


@cache
def evaluate_excludes(rules: tuple[Callable[[], Column], ...] = ALL_RULES) -> Column:
    """ARRAY of the checks of every rule, in rule order."""
    return F.array(*[rule() for rule in rules])


def any_excludes(rules: tuple[Callable[[], Column], ...] = ALL_RULES) -> Column:
    """Whether a rule excludes, without the reasons."""
    out = F.lit(False)
    for rule in rules:
        out = out | F.coalesce(rule()["decision"] == EXCLUDE, F.lit(False))
    return out


def is_excluded(checks: Column) -> Column:
    return F.exists(checks, lambda c: c["decision"] == EXCLUDE)


def exclusion_reasons(checks: Column) -> Column:
    """Reasons of the excluding checks, in rule order."""
    return F.transform(
        F.filter(checks, lambda c: c["decision"] == EXCLUDE), lambda c: c["reason"]
    )


# ------------------------------------------------------------------ universe
PROFILE_FIELDS = {
    "name": "string",
    "country": "string",
    "sector": "string",
    "entity_type": "string",
    "filer_category": "string",
    "has_recent_late_filing": "boolean",
    "name_changed_within_months": "int",
    "has_former_names": "boolean",
}


def attach_profile(metrics: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """Profile fields by left join; name and country fall back to the snapshot."""
    own = metrics.columns
    fallback = lambda c: F.col(c) if c in own else F.lit(None).cast("string")
    if profiles is None:
        joined = metrics.withColumns(
            {f"p_{c}": F.lit(None).cast(t) for c, t in PROFILE_FIELDS.items()}
        ).withColumn("has_profile", F.lit(False))
    else:
        fields = profiles.select(
            "entity_id",
            *[
                (F.col(c) if c in profiles.columns else F.lit(None)).cast(t).alias(f"p_{c}")
                for c, t in PROFILE_FIELDS.items()
            ],
            F.lit(True).alias("__p"),
        )
        joined = metrics.join(fields, "entity_id", "left").withColumn(
            "has_profile", F.coalesce("__p", F.lit(False))
        )
    gate = F.coalesce(is_excluded_sector("p_sector"), F.lit(False))
    return joined.select(
        *own,
        "has_profile",
        F.coalesce("p_name", fallback("entity_name")).alias("name"),
        F.coalesce("p_country", fallback("entity_country"), F.lit("unknown")).alias("country"),
        accounting_standard("taxonomy").alias("accounting_standard"),
        F.coalesce("p_sector", F.lit("unknown")).alias("sector"),
        F.col("p_entity_type").alias("entity_type"),
        F.col("p_has_recent_late_filing").alias("has_recent_late_filing"),
        F.col("p_name_changed_within_months").alias("name_changed_within_months"),
        F.coalesce("p_has_former_names", F.lit(False)).alias("has_former_names"),
        is_underfollowed("p_filer_category").alias("underfollowed"),
        gate.alias("sector_excluded"),
    )


@cache
def ranking_map() -> Column:
    """Map of the ranked metrics that computed."""
    entries = [
        F.when(
            F.col(n)["ok"] & F.col(n)["value"].isNotNull(),
            F.struct(F.lit(n).alias("key"), F.col(n)["value"].alias("value")),
        )
        for n in V.RANKED_METRICS
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


# ------------------------------------------------------------------ ranking
def ranked_values(inputs: DataFrame) -> DataFrame:
    """Long finite values of the ranked metrics; an infinite runway counts as the cap."""
    long = inputs.select("entity_id", *COHORT, F.explode("metrics").alias("metric", "raw"))
    runway = (F.col("metric") == "cash_runway_months") & (F.col("raw") == float("inf"))
    value = F.when(runway, F.lit(V.RUNWAY_CAP_MONTHS)).otherwise(F.col("raw"))
    return (
        long.where(F.col("metric").isin(*V.RANKED_METRICS))
        .withColumn("value", value)
        .drop("raw")
        .where(is_finite("value"))
    )


def cohort_sizes(inputs: DataFrame) -> DataFrame:
    return inputs.groupBy(*COHORT).agg(F.count(F.lit(1)).alias("members"))


def cohort_stats(values: DataFrame) -> DataFrame:
    """Winsor bounds, then mean and population deviation of the clipped values.

    Values are summed as distances from the lower bound: equal values have a deviation of exactly
    zero, however many partial sums are merged.
    """
    keys = [*COHORT, "metric"]
    low, high = V.WINSOR_BOUNDS
    bounds = group_percentiles(values, keys, "value", {"lo": low, "hi": high})
    clipped = match_keys(values, bounds, keys, "inner").withColumn(
        "__d", clip("value", F.col("lo"), F.col("hi")) - F.col("lo")
    )
    return clipped.groupBy(*keys, "lo", "hi").agg(
        F.count(F.lit(1)).alias("n"),
        (F.col("lo") + F.avg("__d")).alias("mean"),
        F.stddev_pop("__d").alias("std"),
    )


def cohort_zscores(values: DataFrame, stats: DataFrame) -> DataFrame:
    keys = [*COHORT, "metric"]
    z = (clip("value", F.col("lo"), F.col("hi")) - F.col("mean")) / F.col("std")
    scored = match_keys(values, stats, keys, "inner")
    return scored.select(
        "entity_id",
        *keys,
        "value",
        F.when(F.col("std") == 0, F.lit(0.0)).otherwise(z).alias("z"),
    )


def _block_score(block: Sequence[tuple[str, bool]]) -> Column:
    """Mean of the signed z-scores that are present."""
    terms = [F.col(f"z_{n}") if up else -F.col(f"z_{n}") for n, up in block]
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))
    present = sum((t.isNotNull().cast("int") for t in terms), F.lit(0))
    return F.when(present > 0, total / present)


def _with_blocks(inputs: DataFrame, min_cohort: int) -> DataFrame:
    """Inputs with the size of their cohort and, in cohorts large enough, their block scores."""
    sized = match_keys(inputs, cohort_sizes(inputs), COHORT, "inner")
    values = ranked_values(sized.where(F.col("members") >= min_cohort))
    z = cohort_zscores(values, cohort_stats(values))
    per_entity = z.groupBy("entity_id").agg(
        *[
            F.max(F.when(F.col("metric") == n, F.col("z"))).alias(f"z_{n}")
            for n in V.RANKED_METRICS
        ]
    )
    blocks = per_entity.select(
        "entity_id", *[_block_score(block).alias(name) for name, block in V.BLOCKS.items()]
    )
    return sized.join(blocks, "entity_id", "left")


def _composite(weights: dict[str, Column]) -> Column:
    """Weighted mean of the blocks that are present."""
    total = sum((F.coalesce(F.col(b) * weights[b], F.lit(0.0)) for b in V.BLOCKS), F.lit(0.0))
    weight = sum(
        (F.when(F.col(b).isNotNull(), weights[b]).otherwise(0.0) for b in V.BLOCKS), F.lit(0.0)
    )
    return F.when(weight > 0, total / weight)


def _notes(min_cohort: Column) -> Column:
    """Why a row has no score, or lacks a block."""
    none_scored = F.col("cheap").isNull() & F.col("quality").isNull() & F.col("safety").isNull()
    small_note = F.concat(
        F.lit("cohort '"),
        cohort_label(),
        F.format_string(
            "' has %d < %d members -- not enough peers to z-score; ranked by nothing",
            F.col("members"),
            min_cohort,
        ),
    )
    block_notes = [
        F.when(
            F.col(b).isNull(),
            F.lit(f"no {b}-block metrics available; composite renormalized over the rest"),
        )
        for b in V.BLOCKS
    ]
    return (
        F.when(F.col("members") < min_cohort, F.array(small_note))
        .when(
            none_scored,
            F.array(F.lit("no ranked metrics available in any block; composite is None")),
        )
        .otherwise(F.array_compact(F.array(*block_notes)))
    )


def rank(
    inputs: DataFrame,
    weights: dict[str, float] | None = None,
    min_cohort: int = V.MIN_COHORT,
) -> DataFrame:
    """Score survivors inside their cohort. Members of small cohorts stay, unscored."""
    weights = weights or V.BLOCK_WEIGHTS
    return _with_blocks(inputs, min_cohort).select(
        "entity_id",
        "name",
        *COHORT,
        cohort_label().alias("cohort"),
        _composite({b: F.lit(weights[b]) for b in V.BLOCKS}).alias("composite"),
        *V.BLOCKS,
        "underfollowed",
        F.col("metrics").alias("metric_values"),
        _notes(F.lit(min_cohort)).alias("warnings"),
    )


@dataclass(frozen=True)
class Setting:
    """Parameters of one ranking: a name, block weights and the least cohort that is scored."""

    name: str
    weights: dict[str, float] = field(default_factory=lambda: dict(V.BLOCK_WEIGHTS))
    min_cohort: int = V.MIN_COHORT


def rank_settings(inputs: DataFrame, settings: Sequence[Setting]) -> DataFrame:
    """One ranking for each setting, with its name in ``setting``.

    Cohort statistics don't depend on a setting, so they are computed once, for the cohorts that any
    of the settings scores; a setting costs one more row an entity.
    """
    if len({s.name for s in settings}) != len(settings):
        raise ValueError("settings need names of their own")
    rows = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("setting"), F.lit(s.min_cohort).alias("least"),
                *[F.lit(float(s.weights[b])).alias(f"w_{b}") for b in V.BLOCKS],
            )
            for s in settings
        ]
    )
    scored = _with_blocks(inputs, min(s.min_cohort for s in settings))
    each = scored.select("*", F.inline(rows)).withColumns(
        {b: F.when(F.col("members") >= F.col("least"), F.col(b)) for b in V.BLOCKS}
    )
    return each.select(
        "setting",
        "entity_id",
        "name",
        *COHORT,
        cohort_label().alias("cohort"),
        _composite({b: F.col(f"w_{b}") for b in V.BLOCKS}).alias("composite"),
        *V.BLOCKS,
        "underfollowed",
        F.col("metrics").alias("metric_values"),
        _notes(F.col("least")).alias("warnings"),
    )


def rank_order() -> list[Column]:
    """Best composite first, unscored last, entity as the tie-break."""
    return [F.col("composite").desc_nulls_last(), F.col("entity_id").asc()]
