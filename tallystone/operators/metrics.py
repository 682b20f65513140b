"""Financial metrics as Column expressions over wide snapshots.

Every metric is a struct<value, kind, basis, ok, reason, inputs, warnings>. The checks of a
metric are tested in a fixed order and the first one that fails gives the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions.columns import clip, first_reason, safe_div
from tallystone.functions.number_text import fixed
from tallystone.operators.snapshots import annual_pair, latest_snapshot

Get = Callable[[str], Column]

NO_MARKET_CAP = "no market capitalisation (price or shares missing)"
NOT_ANNUALIZED = "flow figure is not annualized (interim period)"
NO_PAIR = "need two consecutive annual snapshots one fiscal year apart"
NO_PAIR_PIOTROSKI = "no consecutive annual (FY) snapshot pair available"
NO_PRICE_OR_VOLUME = "price or average daily volume missing"


def metric(
    kind: str,
    basis: Column | str,
    value: Column,
    checks: list[tuple[Column, str | Column]],
    inputs: dict[str, Column] | None = None,
    warnings: list[Column] | None = None,
) -> Column:
    """Assemble a metric struct from its value and its ordered missing-data checks."""
    reason = first_reason(*checks)
    ok = reason.isNull()
    basis = F.lit(basis) if isinstance(basis, str) else basis
    no_inputs = F.create_map().cast("map<string,double>")
    no_warnings = F.array().cast("array<string>")
    pairs = [x for k, v in (inputs or {}).items() for x in (F.lit(k), v)]
    return F.struct(
        F.when(ok, value).alias("value"),
        F.lit(kind).alias("kind"),
        basis.alias("basis"),
        ok.alias("ok"),
        reason.alias("reason"),
        F.when(ok, F.create_map(*pairs)).otherwise(no_inputs).alias("inputs")
        if pairs
        else no_inputs.alias("inputs"),
        F.when(ok, F.array_compact(F.array(*warnings))).otherwise(no_warnings).alias("warnings")
        if warnings
        else no_warnings.alias("warnings"),
    )


def note(condition: Column, text: str | Column) -> Column:
    return F.when(condition, F.lit(text) if isinstance(text, str) else text)


# ------------------------------------------------------------------ shared derivations
def gross_profit(get: Get) -> Column:
    return F.coalesce(get("gross_profit"), get("revenue") - get("cost_of_revenue"))


def total_debt(get: Get) -> Column:
    short, long = get("short_term_debt"), get("long_term_debt")
    return F.when(short.isNull() & long.isNull(), None).otherwise(
        F.coalesce(short, F.lit(0.0)) + F.coalesce(long, F.lit(0.0))
    )


def working_capital(get: Get) -> Column:
    return get("current_assets") - get("current_liabilities")


def market_cap(price: Column, market_shares: Column, filed_shares: Column) -> Column:
    return price * F.coalesce(market_shares, filed_shares)


def flow_basis(fiscal_period: Column) -> Column:
    return F.when(fiscal_period == "FY", F.lit("annual")).otherwise(F.lit("interim"))


def with_market(snapshots: DataFrame, market: DataFrame | None) -> DataFrame:
    """Attach price and shares override; entities without a quote keep NULLs."""
    if market is None:
        return snapshots.withColumns(
            {
                "price": F.lit(None).cast("double"),
                "market_shares": F.lit(None).cast("double"),
            }
        )
    quotes = market.select(
        "entity_id", "price", F.col("shares_outstanding").alias("market_shares")
    )
    return snapshots.join(quotes, "entity_id", "left")


def derive(snapshots: DataFrame) -> DataFrame:
    """Columns that several metrics share, each defined once."""
    get = F.col
    fp = F.col("fiscal_period")
    return snapshots.withColumns(
        {
            "gp": gross_profit(get),
            "gp_derived": F.col("gross_profit").isNull(),
            "debt": total_debt(get),
            "wc": working_capital(get),
            "mcap": market_cap(
                F.col("price"), F.col("market_shares"), F.col("shares_outstanding")
            ),
            "sti": F.coalesce("short_term_investments", F.lit(0.0)),
            "basis": flow_basis(fp),
            "interim": ~F.coalesce(fp == "FY", F.lit(False)),
        }
    ).withColumns(
        {
            "ev": F.col("mcap") + F.col("debt") - F.col("cash_and_equivalents") - F.col("sti"),
            "ev_reason": first_reason(
                (F.col("mcap").isNull(), NO_MARKET_CAP),
                (F.col("debt").isNull(), "no debt figures reported"),
                (F.col("cash_and_equivalents").isNull(), "no cash figure reported"),
            ),
            "ncav_value": F.col("current_assets") - F.col("total_liabilities"),
            "ncav_reason": first_reason(
                (F.col("current_assets").isNull(), "no current assets reported"),
                (F.col("total_liabilities").isNull(), "no total liabilities reported"),
            ),
        }
    )


# ------------------------------------------------------------------ valuation
def _enterprise_ratio(flow: str, missing: str, inverse: bool = False) -> Column:
    ev, x = F.col("ev"), F.col(flow)
    top, bottom = (x, ev) if inverse else (ev, x)
    zero = "enterprise value is zero" if inverse else missing.replace("no ", "").replace(
        " reported", " is zero"
    )
    return metric(
        "ratio",
        F.col("basis"),
        safe_div(top, bottom),
        [
            (F.col("ev").isNull(), F.col("ev_reason")),
            (x.isNull(), missing),
            (bottom == 0, zero),
        ],
        {"ev": ev, flow: x},
        [note(F.col("interim"), NOT_ANNUALIZED)],
    )


def ev_ebit() -> Column:
    return _enterprise_ratio("operating_income", "no operating income reported")


def ev_sales() -> Column:
    return _enterprise_ratio("revenue", "no revenue reported")


def earnings_yield() -> Column:
    return _enterprise_ratio("operating_income", "no operating income reported", inverse=True)


def price_to_book() -> Column:
    mcap, equity = F.col("mcap"), F.col("total_equity")
    return metric(
        "ratio",
        "point-in-time",
        safe_div(mcap, equity),
        [
            (mcap.isNull(), NO_MARKET_CAP),
            (equity.isNull(), "no total equity reported"),
            (equity == 0, "total equity is zero"),
        ],
        {"market_cap": mcap, "total_equity": equity},
        [note(equity <= 0, "negative or zero book equity -- P/B not meaningful")],
    )


def net_cash_to_market_cap() -> Column:
    mcap, cash = F.col("mcap"), F.col("cash_and_equivalents")
    debt = F.coalesce("debt", F.lit(0.0))
    return metric(
        "ratio",
        "point-in-time",
        safe_div(cash + F.col("sti") - debt, mcap),
        [
            (mcap.isNull(), NO_MARKET_CAP),
            (cash.isNull(), "no cash figure reported"),
            (mcap == 0, "market cap is zero"),
        ],
        {
            "cash": cash,
            "short_term_investments": F.col("sti"),
            "total_debt": debt,
            "market_cap": mcap,
        },
        [note(F.col("debt").isNull(), "no debt reported, assumed zero")],
    )


def fcf_yield() -> Column:
    mcap, cfo = F.col("mcap"), F.col("cash_from_operations")
    capex = F.coalesce("capex", F.lit(0.0))
    return metric(
        "ratio",
        F.col("basis"),
        safe_div(cfo - capex, mcap),
        [
            (mcap.isNull(), NO_MARKET_CAP),
            (cfo.isNull(), "no cash from operations reported"),
            (mcap == 0, "market cap is zero"),
        ],
        {"cash_from_operations": cfo, "capex": capex, "market_cap": mcap},
        [
            note(F.col("interim"), NOT_ANNUALIZED),
            note(F.col("capex").isNull(), "no capex reported, assumed zero"),
        ],
    )


def ncav() -> Column:
    return metric(
        "currency",
        "point-in-time",
        F.col("ncav_value"),
        [(F.col("ncav_value").isNull(), F.col("ncav_reason"))],
        {"current_assets": F.col("current_assets"), "total_liabilities": F.col("total_liabilities")},
    )


def ncav_to_market_cap() -> Column:
    mcap = F.col("mcap")
    return metric(
        "ratio",
        "point-in-time",
        safe_div("ncav_value", mcap),
        [
            (F.col("ncav_value").isNull(), F.col("ncav_reason")),
            (mcap.isNull(), NO_MARKET_CAP),
            (mcap == 0, "market cap is zero"),
        ],
        {"ncav": F.col("ncav_value"), "market_cap": mcap},
    )


def is_net_net() -> Column:
    mcap, value = F.col("mcap"), F.col("ncav_value")
    flag = (value > 0) & (mcap < F.lit(2.0 / 3.0) * value)
    return metric(
        "flag",
        "point-in-time",
        F.when(flag, 1.0).otherwise(0.0),
        [(value.isNull(), F.col("ncav_reason")), (mcap.isNull(), NO_MARKET_CAP)],
        {"ncav": value, "market_cap": mcap},
    )


# ------------------------------------------------------------------ quality
def gross_profit_to_assets() -> Column:
    ratio = safe_div("gp", "total_assets")
    return metric(
        "ratio",
        F.col("basis"),
        ratio,
        [(ratio.isNull(), "gross profit or total assets unavailable")],
        {"gross_profit": F.col("gp"), "total_assets": F.col("total_assets")},
        [note(F.col("gp_derived"), "gross profit derived as revenue - COGS")],
    )


def accruals() -> Column:
    income, cfo, assets = (
        F.col("net_income"),
        F.col("cash_from_operations"),
        F.col("total_assets"),
    )
    return metric(
        "ratio",
        F.col("basis"),
        safe_div(income - cfo, assets),
        [
            (
                income.isNull() | cfo.isNull() | assets.isNull(),
                "net income, operating cash, or total assets unavailable",
            ),
            (assets == 0, "total assets is zero"),
        ],
        {"net_income": income, "cash_from_operations": cfo, "total_assets": assets},
    )


def roic() -> Column:
    ebit, equity, cash = (
        F.col("operating_income"),
        F.col("total_equity"),
        F.col("cash_and_equivalents"),
    )
    capital = equity + F.col("debt") - cash
    raw = safe_div("income_tax_expense", "income_before_tax")
    rate = F.coalesce(clip(raw, F.lit(0.0), F.lit(0.5)), F.lit(0.21))
    rate = F.when(raw.isNull(), F.lit(0.21)).otherwise(rate)
    outside = (raw < 0.0) | (raw > 0.5)
    return metric(
        "ratio",
        F.col("basis"),
        safe_div(ebit * (F.lit(1) - rate), capital),
        [
            (ebit.isNull(), "operating income unavailable"),
            (
                equity.isNull() | F.col("debt").isNull() | cash.isNull(),
                "equity, debt, or cash unavailable for invested capital",
            ),
            (
                capital <= 0,
                "invested capital is non-positive (net-cash or negative-equity firm)",
            ),
        ],
        {"operating_income": ebit, "effective_tax_rate": rate, "invested_capital": capital},
        [
            note(raw.isNull(), "effective tax rate unavailable; assumed 21%"),
            note(
                outside,
                F.concat(
                    F.lit("effective tax rate "), fixed(raw, 2), F.lit(" outside [0, 0.5]; clamped to "), fixed(rate, 2)
                ),
            ),
        ],
    )


SIGNAL_LABELS = {
    "S1": "ROA>0",
    "S2": "CFO>0",
    "S3": "dROA>0",
    "S4": "Accrual (CFO>ROA)",
    "S5": "dLeverage down",
    "S6": "dCurrentRatio up",
    "S7": "No dilution",
    "S8": "dGrossMargin up",
    "S9": "dAssetTurnover up",
}


def piotroski_signals(cur: Get, pri: Get) -> dict[str, Column]:
    """Nine signals over the annual pair, NULL where an input is missing."""
    per_assets = lambda get, name: safe_div(get(name), get("total_assets"))
    margin = lambda get: safe_div(gross_profit(get), get("revenue"))
    current_ratio = lambda get: safe_div(
        get("current_assets"), get("current_liabilities")
    )
    roa_c, roa_p = per_assets(cur, "net_income"), per_assets(pri, "net_income")
    return {
        "S1": roa_c > 0.0,
        "S2": cur("cash_from_operations") > 0.0,
        "S3": roa_c > roa_p,
        "S4": per_assets(cur, "cash_from_operations") > roa_c,
        "S5": per_assets(cur, "long_term_debt") < per_assets(pri, "long_term_debt"),
        "S6": current_ratio(cur) > current_ratio(pri),
        "S7": cur("shares_outstanding") <= pri("shares_outstanding"),
        "S8": margin(cur) > margin(pri),
        "S9": per_assets(cur, "revenue") > per_assets(pri, "revenue"),
    }


def piotroski_f(cur: Get, pri: Get, has_pair: Column) -> Column:
    signals = piotroski_signals(cur, pri)
    points = {k: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0) for k, c in signals.items()}
    score = sum(points.values(), F.lit(0.0))
    return metric(
        "score",
        "cross-period",
        score,
        [(~has_pair, NO_PAIR_PIOTROSKI)],
        {**points, "score": score},
        [
            note(
                c.isNull(),
                f"{k} ({SIGNAL_LABELS[k]}) not evaluable: a required input is missing",
            )
            for k, c in signals.items()
        ],
    )


# ------------------------------------------------------------------ risk
def altman_z() -> Column:
    ta = F.col("total_assets")
    score = (
        F.lit(3.25)
        + F.lit(6.56) * safe_div("wc", ta)
        + F.lit(3.26) * safe_div("retained_earnings", ta)
        + F.lit(6.72) * safe_div("operating_income", ta)
        + F.lit(1.05) * safe_div("total_equity", "total_liabilities")
    )
    sales = safe_div("revenue", ta)
    return metric(
        "score",
        F.col("basis"),
        score,
        [
            (F.col("wc").isNull(), "no working capital (current assets or liabilities missing)"),
            (ta.isNull(), "no total assets reported"),
            (F.col("retained_earnings").isNull(), "no retained earnings reported"),
            (F.col("operating_income").isNull(), "no operating income (EBIT) reported"),
            (F.col("total_equity").isNull(), "no total equity reported"),
            (F.col("total_liabilities").isNull(), "no total liabilities reported"),
            (ta == 0, "total assets is zero"),
            (F.col("total_liabilities") == 0, "total liabilities is zero"),
        ],
        {
            "working_capital": F.col("wc"),
            "retained_earnings": F.col("retained_earnings"),
            "operating_income": F.col("operating_income"),
            "total_assets": ta,
            "total_equity": F.col("total_equity"),
            "total_liabilities": F.col("total_liabilities"),
        },
        [
            note(
                sales.isNull() | (F.abs(sales) < 0.01),
                "pre-revenue: Z-score has little discriminating power here",
            )
        ],
    )


def altman_zone(z: Column) -> Column:
    return (
        F.when(z > 2.6, F.lit("safe"))
        .when(z >= 1.1, F.lit("grey"))
        .when(z.isNotNull(), F.lit("distress"))
    )


def beneish_indices(cur: Get, pri: Get) -> dict[str, Column]:
    """The eight year-over-year indices, NULL where one cannot be built."""
    share = lambda get, name: safe_div(get(name), get("revenue"))
    margin = lambda get: safe_div(gross_profit(get), get("revenue"))
    soft = lambda get: F.lit(1.0) - safe_div(
        get("current_assets") + get("ppe_net"), get("total_assets")
    )
    wear = lambda get: safe_div(
        get("depreciation_amortization"), get("depreciation_amortization") + get("ppe_net")
    )
    leverage = lambda get: safe_div(
        get("current_liabilities") + get("long_term_debt"), get("total_assets")
    )
    return {
        "DSRI": safe_div(share(cur, "receivables"), share(pri, "receivables")),
        "GMI": safe_div(margin(pri), margin(cur)),
        "AQI": safe_div(soft(cur), soft(pri)),
        "SGI": safe_div(cur("revenue"), pri("revenue")),
        "DEPI": safe_div(wear(pri), wear(cur)),
        "SGAI": safe_div(share(cur, "sga_expense"), share(pri, "sga_expense")),
        "TATA": safe_div(cur("net_income") - cur("cash_from_operations"), cur("total_assets")),
        "LVGI": safe_div(leverage(cur), leverage(pri)),
    }


# Weights of the eight indices and the flag threshold.
BENEISH_CONSTANT = -4.84
BENEISH_WEIGHTS = {
    "DSRI": 0.920,
    "GMI": 0.528,
    "AQI": 0.404,
    "SGI": 0.892,
    "DEPI": 0.115,
    "SGAI": -0.172,
    "TATA": 4.679,
    "LVGI": -0.327,
}
BENEISH_FLAG = -1.78
BENEISH_OPTIONAL = ("AQI", "DEPI", "SGAI", "LVGI")
BENEISH_REQUIRED = (
    ("DSRI", "cannot compute DSRI (receivables or revenue missing/zero)"),
    ("GMI", "cannot compute GMI (gross margin missing/zero)"),
    ("SGI", "cannot compute SGI (revenue missing/zero)"),
    (
        "TATA",
        "cannot compute TATA (net income, operating cash flow or total assets missing/zero)",
    ),
)


def beneish_m(cur: Get, pri: Get, has_pair: Column) -> Column:
    raw = beneish_indices(cur, pri)
    index = {
        k: F.coalesce(c, F.lit(1.0)) if k in BENEISH_OPTIONAL else c for k, c in raw.items()
    }
    score = F.lit(BENEISH_CONSTANT)
    for k, weight in BENEISH_WEIGHTS.items():
        score = score + F.lit(weight) * index[k]
    return metric(
        "score",
        "cross-period",
        score,
        [(~has_pair, NO_PAIR), *[(raw[k].isNull(), text) for k, text in BENEISH_REQUIRED]],
        index,
        [
            note(
                raw[k].isNull(),
                f"{k} could not be computed (missing input); defaulted to neutral 1.0",
            )
            for k in BENEISH_OPTIONAL
        ],
    )


def share_issuance(cur: Get, pri: Get, has_pair: Column) -> Column:
    now, before = cur("shares_outstanding"), pri("shares_outstanding")
    return metric(
        "pct",
        "cross-period",
        safe_div(now - before, before),
        [
            (~has_pair, NO_PAIR),
            (now.isNull() | before.isNull(), "shares outstanding missing in one period"),
            (before == 0, "prior shares outstanding is zero"),
        ],
        {"shares_outstanding_t": now, "shares_outstanding_p": before},
    )


def burn_months(fiscal_period: Column) -> Column:
    """Months the cash flow covers: twelve, six, or three for every other period."""
    return (
        F.when(fiscal_period.isNull() | (fiscal_period == "FY"), 12.0)
        .when(fiscal_period.isin(*V.HALF_YEAR_PERIODS), 6.0)
        .otherwise(3.0)
    )


def cash_runway_months() -> Column:
    cash, cfo, fp = F.col("cash_and_equivalents"), F.col("cash_from_operations"), F.col("fiscal_period")
    months = burn_months(fp)
    burn = -cfo / months
    burning = cfo < 0
    inputs = F.when(
        burning,
        F.create_map(
            F.lit("cash_and_equivalents"), cash,
            F.lit("cash_from_operations"), cfo,
            F.lit("period_months"), months,
            F.lit("monthly_burn"), burn,
        ),
    ).otherwise(
        F.create_map(F.lit("cash_and_equivalents"), cash, F.lit("cash_from_operations"), cfo)
    )
    built = metric(
        "count",
        F.col("basis"),
        F.when(cfo >= 0, F.lit(float("inf"))).otherwise(safe_div(cash, burn)),
        [
            (cash.isNull(), "no cash figure reported"),
            (cfo.isNull(), "no cash from operations reported"),
        ],
        {"cash_and_equivalents": cash},
        [
            note(cfo >= 0, "cash-flow positive: not burning"),
            note(
                burning & fp.isNull(),
                "fiscal period unknown; assumed annual (12 months) for burn",
            ),
        ],
    )
    return built.withField("inputs", F.when(built["ok"], inputs).otherwise(built["inputs"]))


# ------------------------------------------------------------------ liquidity
def dollar_volume() -> Column:
    return F.col("price") * F.col("avg_daily_volume_shares")


def adv() -> Column:
    v = dollar_volume()
    return metric("currency", "point-in-time", v, [(v.isNull(), NO_PRICE_OR_VOLUME)])


def quoted_spread_pct() -> Column:
    bid, ask = F.col("bid"), F.col("ask")
    spread = safe_div(ask - bid, (bid + ask) / 2)
    return metric(
        "pct",
        "point-in-time",
        spread * 100,
        [
            (
                bid.isNull() | ask.isNull() | (bid <= 0) | (ask <= 0),
                "no two-sided quote",
            ),
            (spread.isNull(), "degenerate quote"),
        ],
        {"bid": bid, "ask": ask},
    )


def position_capacity(participation: float = 0.10, days_to_exit: float = 5.0) -> Column:
    v = dollar_volume()
    return metric(
        "currency",
        "point-in-time",
        v * participation * days_to_exit,
        [(v.isNull(), NO_PRICE_OR_VOLUME)],
        {
            "adv": v,
            "participation": F.lit(participation),
            "days_to_exit": F.lit(days_to_exit),
        },
    )


def meets_liquidity_floor(intended_position: float | Column, min_multiple: float = 20.0) -> Column:
    v = dollar_volume()
    position = intended_position if isinstance(intended_position, Column) else F.lit(intended_position)
    return metric(
        "flag",
        "point-in-time",
        F.when(v >= F.lit(min_multiple) * position, 1.0).otherwise(0.0),
        [(v.isNull(), NO_PRICE_OR_VOLUME)],
        {"adv": v, "intended_position": position, "min_multiple": F.lit(min_multiple)},
    )


def liquidity_metrics(inputs: DataFrame, intended_position: float) -> DataFrame:
    return inputs.select(
        "entity_id",
        adv().alias("adv"),
        quoted_spread_pct().alias("quoted_spread_pct"),
        position_capacity().alias("position_capacity"),
        meets_liquidity_floor(intended_position).alias("meets_liquidity_floor"),
    )


# ------------------------------------------------------------------ report
def member(struct: str) -> Get:
    """Fields of a struct column, each Column built once."""
    return cache(lambda name: F.col(f"{struct}.{name}"))


@cache
def report_columns() -> dict[str, Column]:
    """Every report metric by name. Unresolved Columns, built once and used by any frame."""
    cur, pri, pair = member("cur"), member("pri"), F.col("has_annual_pair")
    return {
        "gp_to_assets": gross_profit_to_assets(),
        "accruals": accruals(),
        "roic": roic(),
        "altman_z": altman_z(),
        "cash_runway_months": cash_runway_months(),
        "ncav": ncav(),
        "ev_ebit": ev_ebit(),
        "ev_sales": ev_sales(),
        "earnings_yield": earnings_yield(),
        "price_to_book": price_to_book(),
        "net_cash_to_mcap": net_cash_to_market_cap(),
        "fcf_yield": fcf_yield(),
        "ncav_to_mcap": ncav_to_market_cap(),
        "is_net_net": is_net_net(),
        "piotroski_f": piotroski_f(cur, pri, pair),
        "beneish_m": beneish_m(cur, pri, pair),
        "share_issuance": share_issuance(cur, pri, pair),
    }


def compute_metrics(snapshots: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """All report metrics of each entity: latest snapshot, or annual pair where two are needed."""
    latest = derive(with_market(latest_snapshot(snapshots), market))
    both = latest.join(annual_pair(snapshots), "entity_id", "left").withColumn(
        "has_annual_pair", F.col("cur").isNotNull()
    )
    carried = [c for c in ("entity_name", "entity_country", "taxonomy") if c in snapshots.columns]
    return both.select(
        "entity_id",
        "period_end",
        "fiscal_period",
        "currency",
        *carried,
        "revenue",
        F.col("price").isNotNull().alias("has_market_data"),
        "has_annual_pair",
        *[c.alias(n) for n, c in report_columns().items()],
    )


def metrics_long(metrics: DataFrame) -> DataFrame:
    """One row per (entity, metric)."""
    rows = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).alias("m")) for n in V.REPORT_METRICS]
    )
    return metrics.select("entity_id", F.inline(rows)).select("entity_id", "metric", "m.*")


def available(long_metrics: DataFrame) -> DataFrame:
    """Only the metrics that could be computed."""
    return long_metrics.where("ok")
