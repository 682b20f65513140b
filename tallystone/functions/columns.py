"""Null-safe arithmetic, dates, codes and display formats as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions import number_text as N


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(numerator, denominator) -> Column:
    """NULL when a side is NULL or the denominator is zero."""
    return F.try_divide(col(numerator), col(denominator))


def clip(value, low, high) -> Column:
    return F.least(F.greatest(col(value), col(low)), col(high))


def is_finite(value) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    v = col(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def finite_map(values) -> Column:
    """Keep the finite entries of a MAP<STRING,DOUBLE>."""
    return F.map_filter(col(values), lambda _, v: is_finite(v))


def first_reason(*checks: tuple[Column, str | Column]) -> Column:
    """Text of the first condition that holds, NULL when none does."""
    out = None
    for condition, text in checks:
        text = F.lit(text) if isinstance(text, str) else text
        out = F.when(condition, text) if out is None else out.when(condition, text)
    return F.lit(None).cast("string") if out is None else out


# ------------------------------------------------------------------ dates
def date_prefix(value) -> Column:
    """Date of the first ten characters, NULL when they are not an ISO date."""
    head = F.substring(col(value), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def compact_date(value) -> Column:
    """Date of a yyyyMMdd text."""
    return F.when(col(value).rlike(r"^\d{8}$"), F.try_to_date(col(value), "yyyyMMdd"))


def shift_months(day, months) -> Column:
    """Month shift; the day of month is clamped to the target month."""
    return F.add_months(col(day), months)


def whole_months_between(earlier, later) -> Column:
    """Calendar months from earlier to later, one less when the day of month is smaller.

    Not months_between, which treats two month ends as a whole month.
    """
    a, b = col(earlier), col(later)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return months - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)


def day_list(count: int, ending) -> Column:
    """The days ending at a date, oldest first; default end is yesterday."""
    last = F.date_sub(F.current_date(), 1) if ending is None else col(ending)
    return F.sequence(F.date_sub(last, count - 1), last)


# ------------------------------------------------------------------ codes
def currency_code(value) -> Column:
    """Trimmed upper-case ISO code; NULL for anything but three letters."""
    code = F.upper(F.trim(col(value)))
    return F.when(code.rlike(r"^\p{L}{3}$"), code)


def unit_currency(unit) -> Column:
    """The unit itself when it looks like a currency code."""
    return F.when(col(unit).rlike(r"^\p{L}{3}$"), col(unit))


def sector_of_sic(sic) -> Column:
    code = F.try_to_number(F.trim(col(sic)), F.lit("999999999"))
    code = F.when(F.trim(col(sic)).rlike(r"^[+-]?\d{1,9}$"), code.cast("int"))
    chain = None
    for low, high, sector in V.SIC_SECTORS:
        test = code.between(low, high)
        chain = F.when(test, F.lit(sector)) if chain is None else chain.when(test, F.lit(sector))
    return F.coalesce(chain, F.lit("unknown"))


def is_excluded_sector(sector) -> Column:
    return F.coalesce(col(sector).isin(*V.EXCLUDED_SECTORS), F.lit(False))


def accounting_standard(taxonomy) -> Column:
    t = col(taxonomy)
    return (
        F.when(t == "us-gaap", F.lit("US-GAAP"))
        .when(t == "ifrs-full", F.lit("IFRS"))
        .otherwise(F.coalesce(F.nullif(t, F.lit("")), F.lit("unknown")))
    )


def cohort_label(country="country", standard="accounting_standard", sector="sector") -> Column:
    return F.concat_ws(" / ", col(country), col(standard), col(sector))


def is_underfollowed(category) -> Column:
    text = F.lower(F.coalesce(col(category), F.lit("")))
    return text.contains("non-accelerated") | text.contains("smaller reporting")


def identifier_scheme(source, entity_id) -> Column:
    return (
        F.when(col(source) == "sec", F.lit("cik"))
        .when(col(entity_id).rlike(r"^[\p{L}\p{Nd}]{20}$"), F.lit("lei"))
        .otherwise(F.lit("national_id"))
    )


def strip_leading_zeros(value) -> Column:
    return F.regexp_replace(F.trim(col(value)), r"^0+(?!$)", "")


def accession_number(value) -> Column:
    """Dashed accession number, NULL when the text is not one."""
    v = F.trim(col(value))
    pattern = r"^(\d{10})-?(\d{2})-?(\d{6})$"
    return F.when(v.rlike(pattern), F.regexp_replace(v, pattern, "$1-$2-$3"))


def slug(text, limit: int = 60, fallback: str = "entity") -> Column:
    s = F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, limit)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def path_component(text, limit: int = 120) -> Column:
    s = F.regexp_replace(col(text), r"[^A-Za-z0-9._-]+", "_")
    s = F.regexp_replace(s, r"^[._]+|[._]+$", "")
    return F.substring(F.coalesce(F.nullif(s, F.lit("")), F.lit("unnamed")), 1, limit)


def split_forms(text) -> Column:
    """Comma list of forms, trimmed, blanks dropped."""
    parts = F.transform(F.split(col(text), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


# ------------------------------------------------------------------ display
def human_bytes(count) -> Column:
    n = col(count).cast("double")
    return (
        F.when(n < 1024, F.format_string("%d B", col(count).cast("long")))
        .when(n < 1024**2, F.concat(N.fixed(n / 1024, 1, grouped=True), F.lit(" KB")))
        .when(n < 1024**3, F.concat(N.fixed(n / 1024**2, 1, grouped=True), F.lit(" MB")))
        .otherwise(F.concat(N.fixed(n / 1024**3, 1, grouped=True), F.lit(" GB")))
    )


def metric_display(value, kind) -> Column:
    v, k = col(value), col(kind)
    return (
        F.when(v.isNull(), F.lit("—"))
        .when(v == float("inf"), F.lit("∞"))
        .when(k == "pct", signed_percent(v))
        .when(k == "ratio", N.fixed(v, 2))
        .when((k == "score") & (v == F.floor(v)), N.fixed(v, 0))
        .when(k == "score", N.fixed(v, 2))
        .when(k == "flag", F.when(v != 0, F.lit("yes")).otherwise(F.lit("no")))
        .when(k == "count", N.fixed(v, 1))
        .when(k == "currency", N.fixed(v, 0, grouped=True))
        .otherwise(N.fixed(v, 4))
    )


def signed_percent(value) -> Column:
    return N.percent(col(value), 1, signed=True)


def significant(value, digits: int = 4) -> Column:
    return N.significant(col(value), digits)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
