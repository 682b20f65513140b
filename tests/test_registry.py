"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from workload.check import normal
from workload.views import TABLES

SMALL = "/root/testdata/sf0.001"
SAMPLE = (
    "metric_quality", "exclude_checks", "period_identity", "edgar_index", "listing_refs",
    "oim_facts", "archive_versions", "upsert_snapshots", "fx_convert_instant", "strategy_scores",
    "page_text", "call_cost_by_stage", "reasoning_split", "response_json", "report_tree",
    "stream_archive", "stream_run_index", "stream_report_changes", "manifest_payloads", "report_markdown",
    "brief_markdown", "memo_prompts", "fabrication_rate", "replace_raw_facts", "upsert_facts", "stream_ingest",
    "harvest_refs", "harvest_errors", "screen_settings",
     "step_digest", "verify_findings", "canonical_facts",
)
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are absent")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


@needs_data
def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns[:4] == ["entity_id", "name", "cohort", "composite"]


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    got = [[normal(v) for v in r] for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = [[normal(v) for v in r] for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(names)
    a = [df.columns.index(c) for c in sorted(names)]
    b = [names.index(c) for c in sorted(names)]
    assert sorted(str([r[i] for i in a]) for r in got) == sorted(str([r[i] for i in b]) for r in want)


@needs_data
@pytest.mark.parametrize("name", ["analyst_prompts", "skeptic_prompts"])
def test_prompts_hold_the_excerpts_of_all_filings(spark, name):
    test_query_equals_sql(spark, name)
    lines = entry.queries()[name](spark, SMALL).where("section = 2 and part = 1").collect()
    entities = {r["entity_id"] for r in entry.queries()[name](spark, SMALL).where("section = 0").collect()}
    want = [r for r in entry.queries()["red_flag_excerpts"](spark, SMALL).collect() if r["entity_id"] in entities]
    got = sorted((r["entity_id"], r["line"]) for r in lines)
    assert got == sorted((r["entity_id"], f"  [{r['accession']} / {r['category']}] {r['text']}") for r in want)
    assert {int(r["accession"][1:]) % 3 for r in want} == {0, 1, 2} and any(r["char_start"] >= 90 for r in want)
