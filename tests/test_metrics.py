"""Worked numbers of the metric formulas."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.operators import metrics as M
from tallystone.operators.snapshots import annual_pair, latest_snapshot

HEAD = (
    "entity_id string, period_end date, fiscal_period string, currency string, taxonomy string, "
    "accession string, filing_date date"
)
SCHEMA = HEAD + "".join(f", {c} double" for c in V.CONCEPT_NAMES)


def snapshots(spark, rows):
    data = []
    for entity, end, period, values in rows:
        head = (entity, dt.date.fromisoformat(end), period, "USD", "us-gaap", f"{entity}-{end}", None)
        data.append(head + tuple(float(values[c]) if c in values else None for c in V.CONCEPT_NAMES))
    return spark.createDataFrame(data, SCHEMA)


BENEISH_PRIOR = dict(
    revenue=1000, receivables=100, cost_of_revenue=600, current_assets=500, ppe_net=300,
    total_assets=1000, depreciation_amortization=60, sga_expense=150, current_liabilities=200,
    long_term_debt=100,
)
BENEISH_CURRENT = dict(
    revenue=1500, receivables=200, cost_of_revenue=1000, current_assets=600, ppe_net=500,
    total_assets=1500, depreciation_amortization=80, sga_expense=300, current_liabilities=300,
    long_term_debt=150, net_income=100, cash_from_operations=50,
)
PIO_PRIOR = dict(
    net_income=100, total_assets=1000, cash_from_operations=120, long_term_debt=300,
    current_assets=400, current_liabilities=200, shares_outstanding=1000, revenue=800,
    gross_profit=240,
)
PIO_CURRENT = dict(
    net_income=200, total_assets=1000, cash_from_operations=300, long_term_debt=200,
    current_assets=600, current_liabilities=200, shares_outstanding=1000, revenue=1200,
    gross_profit=600,
)


@pytest.fixture(scope="module")
def report(spark):
    rows = [
        ("ben", "2024-12-31", "FY", BENEISH_PRIOR),
        ("ben", "2025-12-31", "FY", BENEISH_CURRENT),
        ("pio", "2024-12-31", "FY", PIO_PRIOR),
        ("pio", "2025-12-31", "FY", PIO_CURRENT),
        ("pio8", "2024-12-31", "FY", PIO_PRIOR),
        ("pio8", "2025-12-31", "FY", {k: v for k, v in PIO_CURRENT.items() if k != "long_term_debt"}),
        ("gap", "2024-12-31", "FY", PIO_PRIOR),
        ("gap", "2026-12-31", "FY", PIO_CURRENT),
        ("burn", "2025-12-31", "FY", dict(cash_and_equivalents=600, cash_from_operations=-1200)),
        ("half", "2025-06-30", "YTD6", dict(cash_and_equivalents=300, cash_from_operations=-600)),
        ("self", "2025-12-31", "FY", dict(cash_and_equivalents=1, cash_from_operations=500)),
        ("nine", "2025-09-30", "YTD9", dict(cash_and_equivalents=300, cash_from_operations=-300)),
        ("dil", "2024-12-31", "FY", dict(shares_outstanding=1_000_000)),
        ("dil", "2025-12-31", "FY", dict(shares_outstanding=1_500_000)),
        ("val", "2025-12-31", "FY", dict(
            operating_income=50, revenue=400, cash_and_equivalents=100, long_term_debt=200,
            total_equity=-10, shares_outstanding=10, current_assets=900, total_liabilities=300,
            income_before_tax=40, income_tax_expense=-4)),
    ]
    market = spark.createDataFrame(
        [("val", 30.0, None)], "entity_id string, price double, shares_outstanding double"
    )
    out = M.compute_metrics(snapshots(spark, rows), market)
    return {r.entity_id: r for r in out.collect()}


def test_beneish(report):
    m = report["ben"].beneish_m
    assert m.ok and abs(m.value - -1.3645) < 0.001 and m.value > M.BENEISH_FLAG


def test_piotroski(report):
    assert report["pio"].piotroski_f.value == 9.0
    lower = report["pio8"].piotroski_f
    assert lower.value == 8.0 and len(lower.warnings) == 1 and "S5" in lower.warnings[0]


def test_pair_needs_consecutive_years(report):
    assert not report["gap"].has_annual_pair
    assert report["gap"].piotroski_f.reason == M.NO_PAIR_PIOTROSKI
    assert report["gap"].beneish_m.reason == M.NO_PAIR


def test_runway(report):
    assert report["burn"].cash_runway_months.value == 6.0
    assert report["half"].cash_runway_months.value == 3.0
    assert report["self"].cash_runway_months.value == float("inf")
    assert report["nine"].cash_runway_months.value == 3.0


def test_dilution(report):
    assert report["dil"].share_issuance.value == 0.5


def test_valuation(report):
    r = report["val"]
    # market cap 300, enterprise value 300 + 200 - 100 = 400
    assert r.ev_ebit.value == 8.0 and r.ev_sales.value == 1.0 and r.earnings_yield.value == 0.125
    assert r.price_to_book.value == -30.0 and r.price_to_book.warnings
    assert r.ncav.value == 600.0 and r.is_net_net.value == 1.0
    assert r.fcf_yield.reason == "no cash from operations reported"
    # tax rate -0.1 is clamped to 0; capital -10 + 200 - 100
    assert abs(r.roic.value - 50 / 90) < 1e-12 and "clamped to 0.00" in r.roic.warnings[0]
    assert report["burn"].ev_ebit.reason == M.NO_MARKET_CAP


def test_rank_filters_reach_the_shuffle(spark):
    snaps = snapshots(spark, [("a", "2025-12-31", "FY", {})]).repartition(2)
    for frame in (latest_snapshot(snaps), annual_pair(snaps)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan


def test_liquidity(spark):
    df = spark.createDataFrame(
        [("a", 10.0, 1000.0, 9.5, 10.5), ("b", None, 5.0, 0.0, 1.0)],
        "entity_id string, price double, avg_daily_volume_shares double, bid double, ask double",
    )
    got = {r.entity_id: r for r in M.liquidity_metrics(df, 500.0).collect()}
    assert got["a"].adv.value == 10_000.0 and got["a"].position_capacity.value == 5_000.0
    assert got["a"].quoted_spread_pct.value == 10.0 and got["a"].meets_liquidity_floor.value == 1.0
    assert not got["b"].adv.ok and got["b"].quoted_spread_pct.reason == "no two-sided quote"


def test_altman_zone(spark):
    df = spark.createDataFrame([(2.7,), (2.6,), (1.1,), (1.0,), (None,)], "z double")
    assert [r[0] for r in df.select(M.altman_zone(F.col("z"))).collect()] == [
        "safe", "grey", "grey", "distress", None,
    ]
