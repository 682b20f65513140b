"""Which archived documents to parse, and what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.sources.facts import PARSERS, can_parse


def classify(manifest: DataFrame, ingested: DataFrame, reingest: bool = False) -> DataFrame:
    """Each manifest row as unsupported, skipped_existing or todo.

    ``ingested`` lists accessions already handled, including those without facts, so an
    empty document is not parsed again and again.
    """
    done = ingested.select(F.col("accession").alias("doc_id")).distinct()
    marked = manifest.join(done.withColumn("__done", F.lit(True)), "doc_id", "left")
    parser = F.col("source").isin(*PARSERS)
    accepted = parser & can_parse(
        F.col("source"), F.col("form_type"), F.col("content_type"), F.col("filename")
    )
    state = (
        F.when(~F.coalesce(accepted, F.lit(False)), F.lit("unsupported"))
        .when(F.coalesce("__done", F.lit(False)) & F.lit(not reingest), F.lit("skipped_existing"))
        .otherwise(F.lit("todo"))
    )
    return marked.withColumn("state", state).drop("__done")


def ingest_todo(
    manifest: DataFrame,
    ingested: DataFrame,
    sources: list[str] | None = None,
    reingest: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Documents to parse in manifest order; the limit counts only these."""
    rows = manifest.where(F.col("source").isin(*sources)) if sources else manifest
    todo = classify(rows, ingested, reingest).where("state = 'todo'").drop("state")
    return todo if limit is None else todo.orderBy("position").limit(limit)


def todo_counters(classified: DataFrame) -> DataFrame:
    is_ = lambda name: F.count_if(F.col("state") == name)
    return classified.agg(
        F.count_if(F.col("state") != "unsupported").alias("considered"),
        is_("unsupported").alias("unsupported"),
        is_("skipped_existing").alias("skipped_existing"),
        is_("todo").alias("todo"),
    )


def ingest_counters(classified: DataFrame, parsed: DataFrame, headers: DataFrame) -> DataFrame:
    """Run counters. ``parsed`` has accession and facts (NULL where parsing failed)."""
    base = todo_counters(classified).drop("todo")
    outcome = parsed.join(
        headers.select("accession", F.size("warnings").alias("w")), "accession", "left"
    ).agg(
        F.count_if(F.col("facts").isNotNull()).alias("parsed"),
        F.count_if(F.col("facts").isNull()).alias("failed"),
        F.count_if(F.col("facts").isNotNull() & F.col("w").isNull()).alias("no_xbrl"),
        F.count("w").alias("snapshots"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("warnings_total"),
    )
    # Both sides are one row by construction.
    return base.withColumn("__one", F.lit(1)).join(
        outcome.withColumn("__one", F.lit(1)), "__one"
    ).drop("__one")
