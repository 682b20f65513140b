"""Reference inputs: exchange rates, company profiles, manual prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone import schemas
from tallystone import vocabulary as V
from tallystone.functions.columns import (
    date_prefix,
    is_excluded_sector,
    sector_of_sic,
    shift_months,
    whole_months_between,
)


# ------------------------------------------------------------------ exchange rates
def ecb_series(payloads: DataFrame, payload: str = "payload", keys: list[str] | None = None) -> DataFrame:
    """(day, rate) rows of SDMX-JSON payloads; index keys point into the list of days.

    A payload holds one series. Observations without a value are dropped.
    """
    keys = keys or []
    p = payloads.select(*keys, F.from_json(payload, schemas.SDMX).alias("p"))
    series = F.map_values(F.get("p.dataSets", 0)["series"])
    days = F.get("p.structure.dimensions.observation", 0)["values"]
    rows = p.select(*keys, F.get(series, 0).alias("s"), F.size(series).alias("n"), days.alias("days"))
    checked = rows.withColumn(
        "s",
        F.when(F.col("n") > 1, F.raise_error(F.lit("payload holds more than one series"))).otherwise(
            F.col("s")
        ),
    )
    observed = checked.select(*keys, "days", F.explode("s.observations").alias("i", "o"))
    return observed.where(F.get("o", 0).isNotNull()).select(
        *keys,
        date_prefix(F.try_element_at("days", F.col("i").cast("int") + 1)["id"]).alias("day"),
        F.get("o", 0).alias("rate"),
    )


# ------------------------------------------------------------------ company profiles
def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def recent_late_filing(forms: Column, dates: Column, reference: Column) -> Column:
    """Whether a late-filing notice is dated within the window; NULL without any history."""
    cutoff = shift_months(F.coalesce(reference, F.current_date()), -V.LATE_WINDOW_MONTHS)
    late = F.exists(
        F.arrays_zip(forms.alias("form"), dates.alias("day")),
        lambda f: F.coalesce(
            f["form"].startswith(V.LATE_FORM_PREFIX) & (f["day"] >= cutoff), F.lit(False)
        ),
    )
    return F.when(F.size(forms) > 0, late)


def months_since_name_change(former_names: Column, current: Column, reference: Column) -> Column:
    """Whole months from the newest former name's end; the current name is no change."""
    same = lambda n: F.lower(F.trim(n)) == F.lower(F.trim(F.coalesce(current, F.lit(""))))
    ended = F.filter(former_names, lambda f: f["to_date"].isNotNull() & ~same(f["name"]))
    last = F.array_max(F.transform(ended, lambda f: f["to_date"]))
    return whole_months_between(last, F.coalesce(reference, F.current_date()))


def submission_profiles(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Company profiles of submissions documents; any unusable field becomes NULL."""
    s = F.col("s")
    recent = s["filings"]["recent"]
    is_object = F.ltrim(F.col(payload)).startswith("{")
    parsed = payloads.select(
        "entity_id",
        is_object.alias("is_object"),
        F.when(is_object, F.from_json(payload, schemas.SUBMISSION)).alias("s"),
    )
    fields = parsed.select(
        "entity_id",
        "is_object",
        blank_to_null(s["name"]).alias("name"),
        blank_to_null(s["sic"]).alias("sic"),
        blank_to_null(s["sicDescription"]).alias("sic_description"),
        blank_to_null(s["category"]).alias("filer_category"),
        blank_to_null(s["entityType"]).alias("entity_type"),
        blank_to_null(s["fiscalYearEnd"]).alias("fiscal_year_end"),
        F.coalesce(F.array_compact(s["tickers"]), F.array().cast("array<string>")).alias("tickers"),
        F.coalesce(F.array_compact(s["exchanges"]), F.array().cast("array<string>")).alias("exchanges"),
        F.coalesce(
            F.transform(
                F.filter(s["formerNames"], lambda f: blank_to_null(f["name"]).isNotNull()),
                lambda f: F.struct(
                    F.trim(f["name"]).alias("name"),
                    date_prefix(f["from"]).alias("from_date"),
                    date_prefix(f["to"]).alias("to_date"),
                ),
            ),
            F.array().cast("array<struct<name:string,from_date:date,to_date:date>>"),
        ).alias("former_names"),
        F.coalesce(recent["form"], F.array().cast("array<string>")).alias("forms"),
        F.coalesce(
            F.transform(recent["filingDate"], lambda d: date_prefix(d)),
            F.array().cast("array<date>"),
        ).alias("dates"),
    ).withColumn("reference", F.get("dates", 0))
    sector = F.when(F.col("is_object"), sector_of_sic("sic"))
    return fields.select(
        "entity_id",
        F.lit("sec").alias("source"),
        "name",
        F.lit("US").alias("country"),
        "sic",
        "sic_description",
        sector.alias("sector"),
        is_excluded_sector(sector).alias("is_excluded_sector"),
        "tickers",
        "exchanges",
        "filer_category",
        "entity_type",
        "former_names",
        "fiscal_year_end",
        recent_late_filing(F.col("forms"), F.col("dates"), F.col("reference")).alias(
            "has_recent_late_filing"
        ),
        months_since_name_change(F.col("former_names"), F.col("name"), F.col("reference")).alias(
            "name_changed_within_months"
        ),
        F.get("forms", 0).alias("most_recent_form"),
        F.col("reference").alias("most_recent_filing_date"),
    )


def minimal_profiles(entities: DataFrame) -> DataFrame:
    """Identity-only profiles of companies outside the submissions service."""
    return entities.select(
        "entity_id", "source", "country", "name", F.lit(False).alias("is_excluded_sector")
    )


def typed_profile_arrays(profiles: DataFrame) -> DataFrame:
    """Turn JSON array columns of an exported profile table into typed arrays."""
    former = F.from_json("former_names", "array<struct<name:string,`from`:string,`to`:string>>")
    return profiles.withColumns(
        {
            "tickers": F.from_json("tickers", "array<string>"),
            "exchanges": F.from_json("exchanges", "array<string>"),
            "former_names": F.transform(
                former,
                lambda f: F.struct(
                    f["name"].alias("name"),
                    date_prefix(f["from"]).alias("from_date"),
                    date_prefix(f["to"]).alias("to_date"),
                ),
            ),
        }
    )


# ------------------------------------------------------------------ manual prices
def price_entries(payloads: DataFrame, payload: str = "payload", keys: list[str] | None = None) -> DataFrame:
    """Entries of price files, valid or with the reason they are rejected."""
    keys = keys or []
    entries = payloads.select(
        *keys, F.posexplode(F.from_json(payload, "map<string,string>")).alias("pos", "entry", "v")
    )
    return _checked_prices(entries, keys, priority=0)


def inline_prices(pairs: DataFrame, pair: str = "pair", keys: list[str] | None = None) -> DataFrame:
    """Entries given as ID=VALUE; they win over the file."""
    keys = keys or []
    has = F.col(pair).contains("=")
    entries = pairs.select(
        *keys,
        F.lit(0).alias("pos"),
        F.when(has, F.substring_index(pair, "=", 1)).alias("entry"),
        F.regexp_extract(pair, r"(?s)^[^=]*=(.*)$", 1).alias("v"),
    )
    return _checked_prices(entries, keys, priority=1)


def _checked_prices(entries: DataFrame, keys: list[str], priority: int) -> DataFrame:
    number = F.trim("v").try_cast("double")
    word = F.lower(F.trim("v"))
    reason = (
        F.when(F.col("entry").isNull(), F.lit("expects ENTITY=VALUE"))
        .when(word.isin("true", "false"), F.lit("must be a number, not a boolean"))
        .when(number.isNull(), F.lit("is not a number"))
        .when(
            F.isnan(number) | (F.abs(number) == float("inf")) | (number <= 0),
            F.lit("must be finite and positive"),
        )
    )
    return entries.select(
        *keys,
        F.trim("entry").alias("entity_id"),
        F.when(reason.isNull(), number).alias("price"),
        reason.alias("reject_reason"),
        F.lit(priority).alias("priority"),
        "pos",
    )


def merge_prices(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One price per entity: inline before file, later before earlier."""
    order = F.struct("priority", "pos", "price")
    return (
        entries.where(F.col("reject_reason").isNull())
        .groupBy(*(keys or []), "entity_id")
        .agg(F.max_by("price", order).alias("price"))
    )
