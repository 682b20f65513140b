"""Raw facts of a filing -> canonical facts and snapshots at its reporting date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions.columns import identifier_scheme, unit_currency

NOTHING_RESOLVED = (
    "no canonical concepts resolved -- the filing has XBRL but none of its "
    "tags matched the concept map for this reporting period"
)


def concept_map(spark: SparkSession) -> DataFrame:
    """Static candidate tags, best first. Its size is fixed by the vocabulary."""
    rows = [
        (tag, V.PERIOD_TYPE_OF[name], name, position, priority, tags[0])
        for position, name in enumerate(V.CONCEPT_NAMES)
        for tags in [V.TAGS[name]]
        for priority, tag in enumerate(tags)
    ]
    schema = (
        "tag string, period_type string, concept string, position int, priority int, primary_tag string"
    )
    return spark.createDataFrame(rows, schema)


def span_target(fiscal_period: Column) -> Column:
    chain = None
    for name, days in V.SPAN_TARGET_DAYS.items():
        test = fiscal_period == name
        chain = F.when(test, days) if chain is None else chain.when(test, days)
    return chain


def number_text(value: Column) -> Column:
    """Plain decimal text with at least one decimal place, no exponent."""
    text = value.cast("decimal(38,6)").cast("string")
    text = F.regexp_replace(text, r"0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def with_reporting_date(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts of the filings that state a reporting date."""
    dates = filings.where(F.col("period_of_report").isNotNull()).select(
        "accession", "period_of_report"
    )
    return facts.join(dates, "accession")


def period_identity(facts: DataFrame) -> DataFrame:
    """Fiscal period, fiscal year and currency of each filing by majority vote.

    Only facts on the reporting date vote; equal counts go to the value seen first.
    """
    at_end = facts.where(F.col("period_end") == F.col("period_of_report"))
    vote = lambda field, value: F.struct(
        F.lit(field).alias("field"), value.cast("string").alias("choice")
    )
    votes = (
        at_end.select(
            "accession",
            "fact_ordinal",
            F.inline(
                F.array(
                    vote("fiscal_period", F.col("fiscal_period")),
                    vote("fiscal_year", F.col("fiscal_year")),
                    vote("currency", unit_currency("unit")),
                )
            ),
        )
        .where(F.col("choice").isNotNull())
        .groupBy("accession", "field", "choice")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fact_ordinal").alias("first_seen"))
    )
    best = Window.partitionBy("accession", "field").orderBy(
        F.col("n").desc(), F.col("first_seen").asc()
    )
    winners = votes.withColumn("rn", F.row_number().over(best)).where("rn = 1")
    chosen = winners.groupBy("accession").agg(
        *[
            F.max(F.when(F.col("field") == name, F.col("choice"))).alias(f"voted_{name}")
            for name in ("fiscal_period", "fiscal_year", "currency")
        ]
    )
    span = F.date_diff("period_end", "period_start")
    spans = facts.groupBy("accession", "period_of_report").agg(
        F.bool_or(
            (F.col("period_end") == F.col("period_of_report")) & span.between(*V.ANNUAL_SPAN_DAYS)
        ).alias("has_annual_span")
    )
    inferred = F.when(F.col("has_annual_span"), F.lit("FY"))
    return spans.join(chosen, "accession", "left").select(
        "accession",
        "period_of_report",
        F.coalesce("voted_fiscal_period", inferred).alias("fiscal_period"),
        F.coalesce(F.col("voted_fiscal_year").cast("int"), F.year("period_of_report")).alias(
            "fiscal_year"
        ),
        F.col("voted_currency").alias("currency"),
    )


def candidates(facts: DataFrame, identity: DataFrame) -> DataFrame:
    """Undimensioned facts that may stand for a concept at the reporting date."""
    spark = facts.sparkSession
    tagged = (
        facts.where(~F.col("is_dimensioned"))
        .withColumn("tag", F.concat_ws(":", "taxonomy", "local_name"))
        .join(F.broadcast(concept_map(spark)), ["tag", "period_type"])
    )
    duration = F.col("period_type") == "duration"
    exact = F.col("period_end") == F.col("period_of_report")
    valid = F.when(duration, exact & F.col("period_start").isNotNull()).otherwise(
        exact | (F.col("concept") == "shares_outstanding")
    )
    fields = identity.select(
        "accession",
        F.col("fiscal_period").alias("snapshot_period"),
        F.col("fiscal_year").alias("snapshot_year"),
    )
    span = F.date_diff("period_end", "period_start")
    fit = F.when(
        duration, F.coalesce(F.abs(span - F.col("target")), span)
    ).otherwise(F.abs(F.date_diff("period_end", "period_of_report")))
    return (
        tagged.where(valid)
        .join(fields, "accession")
        .withColumn("target", span_target(F.col("snapshot_period")))
        .withColumns({"span": span, "exact": exact, "fit": fit})
    )


def resolve(found: DataFrame) -> DataFrame:
    """The one fact per (accession, concept): best tag, then best period, then file order."""
    order = Window.partitionBy("accession", "concept").orderBy(
        "priority", F.col("exact").desc(), "fit", "fact_ordinal"
    )
    return found.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def ambiguities(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Concepts whose chosen tag and span carry more than one value (to four digits)."""
    keys = ["accession", "concept"]
    picked = chosen.where("exact").select(
        *keys, F.col("priority").alias("p"), F.col("span").alias("sp")
    )
    same = found.where("exact").join(picked, keys).where(
        (F.col("priority") == F.col("p")) & F.col("span").eqNullSafe(F.col("sp"))
    )
    distinct = same.select(*keys, F.bround("value", 4).alias("rounded")).distinct()
    counts = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_values"))
    smallest = (
        distinct.withColumn(
            "rn", F.row_number().over(Window.partitionBy(*keys).orderBy("rounded"))
        )
        .where("rn <= 4")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("rounded")).alias("smallest"))
    )
    return counts.where("distinct_values > 1").join(smallest, keys)


def resolve_with_warnings(facts: DataFrame, identity: DataFrame) -> DataFrame:
    found = candidates(facts, identity)
    chosen = resolve(found)
    keys = ["accession", "concept"]
    joined = chosen.join(ambiguities(found, chosen), keys, "left")
    shown = F.concat(
        F.lit("["),
        F.array_join(F.transform("smallest", lambda v: number_text(v)), ", "),
        F.lit("]"),
    )
    deviation = F.when(
        (F.col("period_type") == "duration")
        & (F.abs(F.col("span") - F.col("target")) > V.SPAN_TOLERANCE_DAYS),
        F.format_string(
            "%s: closest available span is %d days for a %d-day fiscal period -- "
            "period may not line up with peers",
            "concept",
            "span",
            "target",
        ),
    )
    ambiguous = F.when(
        F.col("distinct_values").isNotNull(),
        F.format_string(
            "%s: %d differing non-dimensioned values for the same period (%s); used %s",
            F.col("concept"),
            F.col("distinct_values"),
            shown,
            number_text(F.col("value")),
        ),
    )
    moved = F.when(
        ~F.col("exact"),
        F.format_string(
            "shares_outstanding: no fact on %s, used cover-date value as of %s",
            F.col("period_of_report").cast("string"),
            F.col("period_end").cast("string"),
        ),
    )
    fallback = F.when(
        F.col("priority") > 0,
        F.format_string(
            "%s: resolved via fallback tag '%s' (primary '%s' absent)",
            "concept",
            "tag",
            "primary_tag",
        ),
    )
    return joined.withColumn(
        "warnings", F.array_compact(F.array(deviation, ambiguous, moved, fallback))
    )


def canonical_facts(resolved: DataFrame, filings: DataFrame) -> DataFrame:
    owners = filings.select("accession", "entity_id")
    return resolved.join(owners, "accession").select(
        "entity_id",
        F.col("period_of_report").alias("period_end"),
        F.col("snapshot_period").alias("fiscal_period"),
        "concept",
        "value",
        unit_currency("unit").alias("currency"),
        "period_start",
        F.col("snapshot_year").alias("fiscal_year"),
        "accession",
        F.col("tag").alias("source_concept"),
        "taxonomy",
        "warnings",
    )


def snapshot_headers(filings: DataFrame, identity: DataFrame, resolved: DataFrame) -> DataFrame:
    """One header per filing; its warnings come from at most 33 concepts."""
    notes = resolved.groupBy("accession").agg(
        F.count(F.lit(1)).alias("concepts"),
        F.array_sort(F.collect_list(F.struct("position", "warnings"))).alias("w"),
    )
    return (
        filings.join(identity.drop("period_of_report"), "accession")
        .join(notes, "accession", "left")
        .select(
            "entity_id",
            F.col("period_of_report").alias("period_end"),
            "fiscal_period",
            F.col("source").alias("entity_source"),
            identifier_scheme("source", "entity_id").alias("entity_scheme"),
            "entity_name",
            F.col("country").alias("entity_country"),
            "fiscal_year",
            "currency",
            "taxonomy",
            "accession",
            "filing_date",
            F.coalesce("concepts", F.lit(0)).alias("concepts"),
            F.coalesce(
                F.flatten(F.transform("w", lambda x: x["warnings"])),
                F.array(F.lit(NOTHING_RESOLVED)),
            ).alias("warnings"),
        )
    )


def normalize(facts: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot headers, canonical facts) of a batch of parsed filings.

    Facts are dealt by accession once. Every later key begins with it, so the vote, the choice and
    the ambiguity check run where the facts are, and their branches share that exchange.
    """
    dated = with_reporting_date(facts.repartition("accession"), filings)
    identity = period_identity(dated)
    resolved = resolve_with_warnings(dated, identity)
    return snapshot_headers(filings, identity, resolved), canonical_facts(resolved, filings)
