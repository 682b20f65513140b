"""Ledger, archive, currency and normalization cases."""

import datetime as dt
import math
import os
import time

import pytest
from pyspark.sql import functions as F

from tallystone.operators import archive as A
from tallystone.operators import fx as X
from tallystone.operators import normalize as NZ
from tallystone.session import fresh_path
from tallystone.sources import ledger as LG
from tallystone.sources.listings import build_sources

D = dt.date.fromisoformat


def pick_rows(spark, n, price=1.0):
    schema = (
        "as_of date, strategy string, entity_id string, name string, cohort string, reference_price double, "
        "currency string, weight double, rank int, score double, vetoed boolean, features map<string,double>, "
        "run_id string, note string"
    )
    rows = [(D("2026-01-05"), "screen", f"e{i}", None, "c", price, None, 1.0, i, 0.5, None, {"a": 1.0}, "r", None) for i in range(n)]
    return spark.createDataFrame(rows, schema)


def write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as out:
        out.write("\n".join(lines))


GOOD = '{"as_of":"2026-01-05","strategy":"screen","entity_id":"%s","run_id":"r%s"}'


def test_ledger_round_trip_and_rejection(spark):
    path = fresh_path(spark, "ledger")
    assert LG.append_picks(pick_rows(spark, 5), path) == 5
    assert LG.append_picks(pick_rows(spark, 0), path) == 0
    with pytest.raises(LG.LedgerError, match="e0"):
        LG.append_picks(pick_rows(spark, 3, math.inf), path)
    got = LG.read_ledger(spark, path)
    assert got.count() == 5 and got.first().features == {"a": 1.0}


def test_torn_tail_is_dropped_and_corrupt_middle_fails(spark):
    torn = fresh_path(spark, "torn")
    write_lines(torn, "a.json", [GOOD % ("b", 2), "", GOOD % ("a", 1)])
    time.sleep(1.1)
    write_lines(torn, "0.json", [GOOD % ("c", 2), '{"as_of":"2026-01'])
    rows = LG.read_ledger(spark, torn).orderBy("ordinal").collect()
    assert [(r.ordinal, r.entity_id) for r in rows] == [(1, "b"), (2, "a"), (3, "c")]
    assert [r.run_id for r in LG.run_ids(LG.read_ledger(spark, torn)).collect()] == ["r2", "r1"]
    broken = fresh_path(spark, "broken")
    write_lines(broken, "a.json", [GOOD % ("b", 2), "oops", GOOD % ("a", 1)])
    with pytest.raises(Exception, match="ledger line 2"):
        LG.read_ledger(spark, broken).collect()


def test_versions_are_idempotent_and_split_hot_documents(spark):
    arrivals = spark.createDataFrame(
        [("sec", "d", f"h{i % 300}", i) for i in range(900)] + [("sec", "e", "x", 1000)],
        "source string, doc_id string, content_sha256 string, arrival long",
    )
    held = spark.createDataFrame(
        [("sec", "d", "h0", 1)], "source string, doc_id string, content_sha256 string, version int"
    )
    expected = [("d", f"h{i}", i + 1) for i in range(1, 300)] + [("e", "x", 1)]
    for hot in (50, None):
        got = A.new_versions(arrivals, held, hot_rows=hot).collect()
        assert sorted((r.doc_id, r.content_sha256, r.version) for r in got) == sorted(expected)
    everything = held.unionByName(
        A.new_versions(arrivals, held).select("source", "doc_id", "content_sha256", "version")
    )
    assert A.new_versions(arrivals, everything).count() == 0


def test_upsert_treats_null_keys_as_equal(spark):
    schema = "entity_id string, period_end date, fiscal_period string, v int"
    old = spark.createDataFrame([("a", D("2025-12-31"), None, 1), ("b", D("2025-12-31"), "FY", 2)], schema)
    new = spark.createDataFrame([("a", D("2025-12-31"), None, 3, 1), ("a", D("2025-12-31"), None, 4, 2)], schema + ", ordinal int")
    got = A.upsert_snapshots(old, new).collect()
    assert sorted((r.entity_id, r.v) for r in got) == [("a", 4), ("b", 2)]


def test_unknown_source_is_an_error():
    with pytest.raises(ValueError, match="nope"):
        build_sources(["sec", "nope"])


def test_currency(spark):
    rates = spark.createDataFrame(
        [("USD", D("2026-01-02"), 1.25), ("USD", D("2026-01-05"), 1.5), ("JPY", D("2026-01-02"), 160.0)],
        "currency string, day date, rate double",
    )
    asked = spark.createDataFrame(
        [
            (1, 100.0, "usd ", "EUR", D("2026-01-04")),  # weekend: the Friday rate
            (2, 100.0, "USD", "USD", D("1990-01-01")),  # same currency needs no rate
            (3, 125.0, "USD", "JPY", D("2026-01-03")),  # cross rate through the euro
            (4, 1.0, "USD", "EUR", D("2026-01-16")),  # last rate is eleven days old
            (5, 1.0, "US", "EUR", D("2026-01-04")),
        ],
        "k int, amount double, from_ccy string, to_ccy string, on date",
    )
    got = {r.k: r for r in X.convert_instant(asked, rates).collect()}
    assert got[1].converted == 80.0 and got[2].converted == 100.0 and got[3].converted == 16_000.0
    assert got[4].converted is None and "no observations" in got[4].fx_error
    assert "ISO 4217" in got[5].fx_error
    spans = spark.createDataFrame(
        [
            (1, 11.0, "USD", "EUR", D("2026-01-01"), D("2026-01-31")),
            (2, 11.0, "USD", "EUR", D("2026-01-03"), D("2026-01-04")),
            (3, 11.0, "USD", "EUR", D("2026-02-01"), D("2026-01-01")),
        ],
        "k int, amount double, from_ccy string, to_ccy string, start date, end date",
    )
    got = {r.k: r for r in X.convert_duration(spans, rates).collect()}
    assert got[1].converted == 8.0
    assert got[2].converted is None and got[2].fx_error
    assert "inverted" in got[3].fx_error


FACT = (
    "accession string, taxonomy string, local_name string, value double, unit string, period_type string, "
    "period_start date, period_end date, is_dimensioned boolean, decimals int, fiscal_year int, "
    "fiscal_period string, fact_ordinal long"
)


def test_period_selection(spark):
    end = D("2026-06-30")

    def fact(n, tag, value, start=None, at=end, dim=False, period=None, unit="USD"):
        taxonomy, name = tag.split(":")
        kind = "duration" if start else "instant"
        return ("a", taxonomy, name, value, unit, kind, D(start) if start else None, at, dim, None, None, period, n)

    facts = spark.createDataFrame(
        [
            fact(0, "us-gaap:Revenues", 90.0, "2026-04-01", period="YTD6"),
            fact(1, "us-gaap:Revenues", 180.0, "2026-01-01", period="YTD6"),
            fact(2, "us-gaap:Revenues", 7.0, "2026-01-01", dim=True, period="YTD6"),
            fact(3, "us-gaap:Assets", 10.0),
            fact(4, "us-gaap:Assets", 11.0),
            fact(5, "us-gaap:Assets", 9.0, at=D("2025-12-31")),
            fact(6, "dei:EntityCommonStockSharesOutstanding", 5.0, at=D("2026-07-20"), unit="shares"),
            fact(7, "dei:EntityCommonStockSharesOutstanding", 6.0, at=D("2026-09-20"), unit="shares"),
            fact(8, "us-gaap:NetIncomeLoss", 1.0),
        ],
        FACT,
    )
    filings = spark.createDataFrame(
        [("a", "sec", "e", "Co", "US", "us-gaap", end, None)],
        "accession string, source string, entity_id string, entity_name string, country string, "
        "taxonomy string, period_of_report date, filing_date date",
    )
    heads, canonical = NZ.normalize(facts, filings)
    got = {r.concept: r for r in canonical.collect()}
    assert set(got) == {"revenue", "total_assets", "shares_outstanding"}
    assert got["revenue"].value == 180.0 and got["revenue"].source_concept == "us-gaap:Revenues"
    assert "fallback tag" in got["revenue"].warnings[0]
    assert got["total_assets"].value == 10.0
    assert "2 differing non-dimensioned values for the same period ([10.0, 11.0]); used 10.0" in got["total_assets"].warnings[0]
    assert got["shares_outstanding"].value == 5.0 and "2026-07-20" in got["shares_outstanding"].warnings[0]
    head = heads.first()
    assert head.fiscal_period == "YTD6" and head.fiscal_year == 2026 and head.currency == "USD"
    assert head.entity_scheme == "cik" and len(head.warnings) == 3
    assert heads.select(F.size("warnings")).first()[0] == 3
