"""Currency conversion with period-end and period-average reference rates.

Rates are units of a currency per euro. The rate side is small and becomes a lookup keyed by
equality, so no window or range scan runs over the facts, however many share a currency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions.columns import currency_code


def carried_rates(rates: DataFrame, lookback: int = V.FX_LOOKBACK_DAYS) -> DataFrame:
    """(currency, on, rate, rate_day): the newest rate on or before each day, within the lookback."""
    spread = rates.where(F.col("rate").isNotNull()).select(
        "currency",
        "rate",
        F.col("day").alias("rate_day"),
        F.explode(F.sequence(F.col("day"), F.date_add("day", lookback))).alias("on"),
    )
    newest = F.max(F.struct("rate_day", "rate"))
    return (
        spread.groupBy("currency", "on")
        .agg(newest.alias("n"))
        .select("currency", "on", "n.rate", "n.rate_day")
    )


def period_end_rates(requests: DataFrame, rates: DataFrame, currency: str, on: str, out: str) -> DataFrame:
    """Attach the carried rate of a currency column on a day column; the euro is 1."""
    table = carried_rates(rates).select(
        F.col("currency").alias("__c"), F.col("on").alias("__d"), F.col("rate").alias("__rate")
    )
    joined = requests.join(
        table, (F.col(currency) == F.col("__c")) & (F.col(on) == F.col("__d")), "left"
    )
    rate = F.when(F.col(currency) == "EUR", F.lit(1.0)).otherwise(F.col("__rate"))
    return joined.withColumn(out, rate).drop("__c", "__d", "__rate")


def period_average_rates(
    requests: DataFrame, rates: DataFrame, currency: str, start: str, end: str, out: str
) -> DataFrame:
    """Attach the mean of the rates inside [start, end]; NULL when there is none.

    Distinct windows are averaged once. A window meets the rates month by month, so a
    comparison never leaves the months it touches.
    """
    windows = (
        requests.where(F.col(start) <= F.col(end))
        .select(
            F.col(currency).alias("__c"), F.col(start).alias("__s"), F.col(end).alias("__e")
        )
        .where(F.col("__c").isNotNull() & (F.col("__c") != "EUR"))
        .distinct()
    )
    months = windows.withColumn(
        "__m",
        F.explode(
            F.sequence(
                F.trunc("__s", "month"), F.trunc("__e", "month"), F.expr("interval 1 month")
            )
        ),
    )
    daily = rates.where(F.col("rate").isNotNull()).select(
        F.col("currency").alias("__rc"),
        F.trunc("day", "month").alias("__rm"),
        F.col("day").alias("__rd"),
        F.col("rate").alias("__rv"),
    )
    means = (
        months.join(
            daily,
            (F.col("__c") == F.col("__rc"))
            & (F.col("__m") == F.col("__rm"))
            & F.col("__rd").between(F.col("__s"), F.col("__e")),
        )
        .groupBy("__c", "__s", "__e")
        .agg(F.avg("__rv").alias("__mean"))
    )
    joined = requests.join(
        means,
        (F.col(currency) == F.col("__c"))
        & (F.col(start) == F.col("__s"))
        & (F.col(end) == F.col("__e")),
        "left",
    )
    rate = F.when(F.col(currency) == "EUR", F.lit(1.0)).otherwise(F.col("__mean"))
    return joined.withColumn(out, rate).drop("__c", "__s", "__e", "__mean")


def _no_rate(currency: Column, start: Column, end: Column) -> Column:
    return F.concat(
        F.lit("ECB returned no observations for "),
        currency,
        F.lit(" in "),
        start.cast("string"),
        F.lit(".."),
        end.cast("string"),
        F.lit("."),
    )


def _bad_code(raw: Column) -> Column:
    return F.concat(F.lit("Not a valid ISO 4217 currency code: '"), F.upper(F.trim(raw)), F.lit("'"))


def _converted(amount: Column, same: Column) -> Column:
    in_euro = F.when(F.col("__from") == "EUR", amount).otherwise(
        F.try_divide(amount, F.col("__from_rate"))
    )
    out = F.when(F.col("__to") == "EUR", in_euro).otherwise(in_euro * F.col("__to_rate"))
    return F.when(same, amount).otherwise(out)


def _coded(requests: DataFrame) -> DataFrame:
    return requests.withColumns(
        {"__from": currency_code("from_ccy"), "__to": currency_code("to_ccy")}
    )


def convert_instant(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """converted and fx_error for rows of amount, from_ccy, to_ccy, on. Same currency is untouched."""
    coded = _coded(requests)
    rated = period_end_rates(coded, rates, "__from", "on", "__from_rate")
    rated = period_end_rates(rated, rates, "__to", "on", "__to_rate")
    same = F.coalesce(F.col("__from") == F.col("__to"), F.lit(False))
    low = F.date_sub("on", V.FX_LOOKBACK_DAYS)
    error = (
        F.when(F.col("__from").isNull(), _bad_code(F.col("from_ccy")))
        .when(F.col("__to").isNull(), _bad_code(F.col("to_ccy")))
        .when(same, None)
        .when(F.col("__from_rate").isNull(), _no_rate(F.col("__from"), low, F.col("on")))
        .when(F.col("__to_rate").isNull(), _no_rate(F.col("__to"), low, F.col("on")))
    )
    return rated.select(
        *requests.columns,
        F.when(error.isNull(), _converted(F.col("amount"), same)).alias("converted"),
        error.alias("fx_error"),
    )


def convert_duration(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """The same with average rates over [start, end]; never falls back to a spot rate."""
    coded = _coded(requests)
    rated = period_average_rates(coded, rates, "__from", "start", "end", "__from_rate")
    rated = period_average_rates(rated, rates, "__to", "start", "end", "__to_rate")
    same = F.coalesce(F.col("__from") == F.col("__to"), F.lit(False))
    inverted = F.concat(
        F.lit("convert_duration window is inverted: start="),
        F.col("start").cast("string"),
        F.lit(" end="),
        F.col("end").cast("string"),
    )
    error = (
        F.when(F.col("__from").isNull(), _bad_code(F.col("from_ccy")))
        .when(F.col("__to").isNull(), _bad_code(F.col("to_ccy")))
        .when(same, None)
        .when(F.col("start") > F.col("end"), inverted)
        .when(
            F.col("__from_rate").isNull(), _no_rate(F.col("__from"), F.col("start"), F.col("end"))
        )
        .when(F.col("__to_rate").isNull(), _no_rate(F.col("__to"), F.col("start"), F.col("end")))
    )
    return rated.select(
        *requests.columns,
        F.when(error.isNull(), _converted(F.col("amount"), same)).alias("converted"),
        error.alias("fx_error"),
    )
