"""Fact scans: xBRL-JSON documents and landed XBRL fact tables -> raw facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone import schemas
from tallystone import vocabulary as V
from tallystone.functions.columns import date_prefix, strip_leading_zeros

CORE_DIMENSIONS = ("concept", "entity", "period", "unit")


# ------------------------------------------------------------------ parser gate
def can_parse(source: Column, form_type: Column, content_type: Column, filename: Column) -> Column:
    """Whether a source's parser accepts a document."""
    base_form = F.regexp_replace(F.upper(F.trim(form_type)), r"/A$", "")
    sec = form_type.isNull() | base_form.isin(*V.STATEMENT_FORMS)
    esef = ~filename.endswith(".zip") & (
        F.coalesce(F.lower(content_type).contains("json"), F.lit(False))
        | filename.endswith(".json")
    )
    return F.when(source == "sec", sec).when(source == "esef", esef).otherwise(F.lit(False))


# ------------------------------------------------------------------ xBRL-JSON (OIM)
def oim_date(value: Column) -> Column:
    """Date of an ISO date or date-time; NULL for anything else."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
    return F.when(value.rlike(shape), date_prefix(value))


def oim_unit(unit: Column) -> Column:
    plain = F.regexp_replace(unit, r"^[^:]*:", "")
    return (
        F.when(unit == "xbrli:pure", F.lit("pure"))
        .when(unit == "xbrli:shares", F.lit("shares"))
        .when(unit != "", plain)
    )


def numeric_text(value: Column) -> Column:
    """DOUBLE of a numeric text, nan and inf included; blanks, booleans and the rest are NULL."""
    trimmed = F.trim(value)
    digits = r"\d(_?\d)*"  # an underscore stands between digits only
    number = rf"(?i)^[+-]?(({digits}(\.({digits})?)?|\.{digits})(e[+-]?{digits})?|nan|inf|infinity)$"
    return F.when(trimmed.rlike(number), F.regexp_replace(trimmed, "_", "").try_cast("double"))


def oim_facts(documents: DataFrame, payload: str = "payload") -> DataFrame:
    """Every fact of xBRL-JSON documents with its outcome: fact, non_numeric or malformed.

    A fact that is dropped still counts for the entity of its filing.
    """
    d = F.col("fact.dimensions")
    concept, period = d["concept"], d["period"]
    taxonomy = F.substring_index(concept, ":", 1)
    local_name = F.regexp_extract(concept, r"(?s)^[^:]*:(.*)$", 1)
    has_concept = concept.contains(":") & (taxonomy != "") & (local_name != "")
    value = numeric_text(F.col("fact.value"))
    is_duration = period.contains("/")
    start = F.when(is_duration, oim_date(F.substring_index(period, "/", 1)))
    end = oim_date(
        F.when(is_duration, F.regexp_extract(period, r"(?s)^[^/]*/(.*)$", 1)).otherwise(period)
    )
    has_period = end.isNotNull() & (~is_duration | start.isNotNull())
    outcome = (
        F.when(~F.coalesce(has_concept, F.lit(False)), F.lit("malformed"))
        .when(value.isNull(), F.lit("non_numeric"))
        .when(~F.coalesce(has_period, F.lit(False)), F.lit("malformed"))
        .otherwise(F.lit("fact"))
    )
    extra = F.size(F.array_except(F.map_keys(d), F.array(*[F.lit(k) for k in CORE_DIMENSIONS]))) > 0
    decimals = F.when(
        F.col("fact.decimals").rlike(r"^-?\d+$"), F.col("fact.decimals").try_cast("int")
    )
    entity = F.when(d["entity"] != "", F.substring_index(d["entity"], ":", -1))
    return (
        documents.select("accession", F.from_json(payload, schemas.OIM).alias("doc"))
        .select("accession", F.posexplode("doc.facts").alias("fact_ordinal", "fact_id", "fact"))
        .select(
            "accession",
            F.col("fact_ordinal").cast("long").alias("fact_ordinal"),
            outcome.alias("outcome"),
            F.when(has_concept, entity).alias("entity_id"),
            F.when(
                (local_name == "NameOfReportingEntity") & (F.trim("fact.value") != ""),
                F.col("fact.value"),
            ).alias("entity_name"),
            taxonomy.alias("taxonomy"),
            local_name.alias("local_name"),
            value.alias("value"),
            oim_unit(d["unit"]).alias("unit"),
            F.when(is_duration, F.lit("duration")).otherwise(F.lit("instant")).alias("period_type"),
            start.alias("period_start"),
            end.alias("period_end"),
            extra.alias("is_dimensioned"),
            decimals.alias("decimals"),
            F.lit(None).cast("int").alias("fiscal_year"),
            F.lit(None).cast("string").alias("fiscal_period"),
        )
    )


def _most_common(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Most frequent value per filing, the one seen first on equal counts."""
    votes = (
        rows.where(F.col(value).isNotNull())
        .groupBy("accession", value)
        .agg(F.count(F.lit(1)).alias("n"), F.min("fact_ordinal").alias("first_seen"))
    )
    w = Window.partitionBy("accession").orderBy(F.col("n").desc(), "first_seen")
    best = votes.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.select("accession", F.col(value).alias(name))


def oim_filings(parsed: DataFrame) -> DataFrame:
    """Entity, reporting date and drop counts of each xBRL-JSON filing."""
    kept = F.col("outcome") == "fact"
    duration_end = F.when(kept & (F.col("period_type") == "duration"), F.col("period_end"))
    marked = parsed.withColumn("duration_end", duration_end)
    named = F.when(F.col("entity_name").isNotNull(), F.col("fact_ordinal"))
    counts = marked.groupBy("accession").agg(
        F.count_if(kept).alias("facts"),
        F.count_if(F.col("outcome") == "non_numeric").alias("skipped_non_numeric"),
        F.count_if(F.col("outcome") == "malformed").alias("skipped_malformed"),
        F.max(F.when(kept & (F.col("period_type") == "instant"), F.col("period_end"))).alias(
            "last_instant"
        ),
        F.min_by("entity_name", named).alias("entity_name"),
    )
    entities = _most_common(marked, "entity_id", "entity_id")
    ends = _most_common(marked, "duration_end", "most_common_end")
    return (
        counts.join(entities, "accession", "left")
        .join(ends, "accession", "left")
        .select(
            "accession",
            F.coalesce("entity_id", F.lit("")).alias("entity_id"),
            "entity_name",
            F.lit("ifrs-full").alias("taxonomy"),
            F.coalesce("most_common_end", "last_instant").alias("period_of_report"),
            "facts",
            "skipped_non_numeric",
            "skipped_malformed",
        )
    )


# ------------------------------------------------------------------ landed XBRL fact tables
def clean_text(c: Column | str) -> Column:
    """Trimmed text; blanks and the words nan and none are NULL."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~F.lower(text).isin("", "nan", "none"), text)


def loose_date(c: Column | str) -> Column:
    text = clean_text(c)
    return F.when(F.lower(text) != "nat", date_prefix(text))


def loose_int(c: Column | str) -> Column:
    """Integer of a text, cut toward zero when it has a fraction; INF and others are NULL."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return (
        F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
        .when(text.rlike(r"^[+-]?\d*\.\d*$"), text.try_cast("double").try_cast("int"))
    )


def sec_facts(rows: DataFrame) -> DataFrame:
    """Map landed fact rows to raw facts with their outcome: fact, non_numeric or no_period."""
    numeric = F.col("numeric_value").try_cast("double")
    numeric = F.when(~F.isnan(numeric), numeric)
    instant = F.coalesce(clean_text("period_type") == "instant", F.lit(False))
    end = F.when(instant, F.coalesce(loose_date("period_instant"), loose_date("period_end"))).otherwise(
        loose_date("period_end")
    )
    concept = F.coalesce("concept", F.lit(""))
    prefixed = concept.contains(":")
    outcome = (
        F.when(numeric.isNull(), F.lit("non_numeric"))
        .when(end.isNull(), F.lit("no_period"))
        .otherwise(F.lit("fact"))
    )
    return rows.select(
        "accession",
        "fact_ordinal",
        outcome.alias("outcome"),
        F.when(prefixed, F.substring_index(concept, ":", 1)).otherwise(F.lit("")).alias("taxonomy"),
        F.when(prefixed, F.regexp_extract(concept, r"(?s)^[^:]*:(.*)$", 1))
        .otherwise(concept)
        .alias("local_name"),
        numeric.alias("value"),
        F.coalesce(clean_text("currency"), clean_text("unit_ref")).alias("unit"),
        F.when(instant, F.lit("instant")).otherwise(F.lit("duration")).alias("period_type"),
        F.when(~instant, loose_date("period_start")).alias("period_start"),
        end.alias("period_end"),
        F.coalesce("is_dimensioned", F.lit(False)).alias("is_dimensioned"),
        loose_int("decimals").alias("decimals"),
        loose_int("fiscal_year").alias("fiscal_year"),
        clean_text("fiscal_period").alias("fiscal_period"),
    )


def sec_entity_id(filing_cik: Column, hint: Column) -> Column:
    raw = F.coalesce(F.nullif(filing_cik, F.lit("")), F.nullif(hint, F.lit("")))
    return F.coalesce(strip_leading_zeros(raw), F.lit(""))


def kept_facts(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("outcome") == "fact")


# Parsers by source: a documents (or landed facts) frame -> facts with an outcome column.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"sec": sec_facts, "esef": oim_facts}
