"""Wide snapshots: pivot of canonical facts, latest row and annual pair per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone import vocabulary as V

SNAPSHOT_KEY = ["entity_id", "period_end", "fiscal_period"]


def pivot_facts(facts: DataFrame) -> DataFrame:
    """One row per (entity, period_end, fiscal_period), one DOUBLE column per concept.

    The concept list is fixed, so the pivot is a single partial aggregation.
    """
    cells = [
        F.max(F.when(F.col("concept") == name, F.col("value"))).alias(name)
        for name in V.CONCEPT_NAMES
    ]
    return facts.groupBy(*SNAPSHOT_KEY).agg(*cells)


def attach_facts(headers: DataFrame, facts: DataFrame) -> DataFrame:
    """Snapshot headers with their concept columns; the fiscal period may be NULL."""
    wide = pivot_facts(facts)
    renamed = wide.select(
        F.col("entity_id").alias("__e"),
        F.col("period_end").alias("__p"),
        F.col("fiscal_period").alias("__f"),
        *V.CONCEPT_NAMES,
    )
    on = (
        (F.col("entity_id") == F.col("__e"))
        & (F.col("period_end") == F.col("__p"))
        & F.col("fiscal_period").eqNullSafe(F.col("__f"))
    )
    return headers.join(renamed, on, "left").drop("__e", "__p", "__f")


def newest_first() -> list[Column]:
    return [
        F.col("period_end").desc(),
        F.col("filing_date").desc_nulls_last(),
        F.col("accession").desc_nulls_last(),
        F.col("fiscal_period").desc_nulls_last(),
    ]


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per entity. The rank filter is applied before the shuffle too."""
    w = Window.partitionBy("entity_id").orderBy(*newest_first())
    return snapshots.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def annual_pair(snapshots: DataFrame) -> DataFrame:
    """Two newest annual snapshots per entity as structs cur and pri, about a year apart.

    The pair is dropped when the two newest are not 250 to 460 days apart; older rows are
    not searched.
    """
    w = Window.partitionBy("entity_id").orderBy(*newest_first())
    top = (
        snapshots.where(F.col("fiscal_period") == "FY")
        .withColumn("__rn", F.row_number().over(w))
        .where("__rn <= 2")
    )
    row = F.struct("period_end", *V.CONCEPT_NAMES)
    pairs = top.groupBy("entity_id").agg(
        F.max(F.when(F.col("__rn") == 1, row)).alias("cur"),
        F.max(F.when(F.col("__rn") == 2, row)).alias("pri"),
    )
    gap = F.date_diff(F.col("cur.period_end"), F.col("pri.period_end"))
    return pairs.where(gap.between(*V.ANNUAL_GAP_DAYS))


def snapshots_for(snapshots: DataFrame, entity_ids: list[str]) -> DataFrame:
    """Every snapshot of some entities, newest first."""
    return snapshots.where(F.col("entity_id").isin(*entity_ids)).orderBy(
        "entity_id", *newest_first()
    )


def entity_counts(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(
        F.count_distinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("snapshots")
    )


def coverage(headers: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities, snapshots and distinct concepts per taxonomy.

    Two aggregates joined on the taxonomy, so that facts do not multiply the snapshots.
    """
    per_taxonomy = headers.groupBy("taxonomy").agg(
        F.count_distinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("snapshots")
    )
    keyed = headers.select(
        F.col("entity_id").alias("__e"),
        F.col("period_end").alias("__p"),
        F.col("fiscal_period").alias("__f"),
        F.col("taxonomy").alias("snapshot_taxonomy"),
    )
    on = (
        (F.col("entity_id") == F.col("__e"))
        & (F.col("period_end") == F.col("__p"))
        & F.col("fiscal_period").eqNullSafe(F.col("__f"))
    )
    concepts = (
        facts.select(*SNAPSHOT_KEY, "concept")
        .join(keyed, on)
        .groupBy(F.col("snapshot_taxonomy").alias("__t"))
        .agg(F.count_distinct("concept").alias("concepts"))
    )
    return per_taxonomy.join(concepts, F.col("taxonomy") == F.col("__t"), "left").select(
        "taxonomy",
        "entities",
        "snapshots",
        F.coalesce("concepts", F.lit(0)).cast("long").alias("concepts"),
    )


def entities_to_enrich(headers: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Distinct entities of the snapshot table, without those that have a profile."""
    rows = headers.groupBy("entity_id").agg(
        F.min("entity_source").alias("source"),
        F.min("entity_country").alias("country"),
        F.min("entity_name").alias("name"),
    )
    if profiles is None:
        return rows
    return rows.join(profiles.select("entity_id"), "entity_id", "left_anti")
