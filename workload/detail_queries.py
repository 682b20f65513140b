"""Queries for scans, orders and small operators that the other groups do not reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import columns as C
from tallystone.operators import books as B
from tallystone.operators import calls as K
from tallystone.operators import evidence as EV
from tallystone.operators import learned as LN
from tallystone.operators import snapshots as S
from tallystone.session import fresh_path
from tallystone.sources import reference as R
from workload.book_queries import _picks
from workload.screen_queries import screen
from workload.views import VIEWS, oracle, view

Q: dict = {}
SQL: dict[str, str] = {}

# ------------------------------------------------------------------ model calls
VIEWS["v_cached_calls"] = """
SELECT s_suppkey AS s, CASE WHEN s_suppkey % 5 = 0 THEN '{"response":{"text":"answer ' || CAST(s_suppkey AS STRING) || '"}}'
  WHEN s_suppkey % 7 = 0 THEN '{broken' ELSE '{"response":{"text":"answer ' || CAST(s_suppkey AS STRING) || '","model":"m-' || CAST(s_suppkey % 3 AS STRING) || '","usage":{"input_tokens":' || CAST(s_suppkey AS STRING) || ',"output_tokens":1}}}' END AS body
FROM {supplier}
"""


def read_calls(spark, sf_dir):
    """Call records landed as one file each, read back; broken ones are marked."""
    path = fresh_path(spark, "calls")
    calls = view(spark, sf_dir, "v_cached_calls")
    calls.select("body").write.option("maxRecordsPerFile", 1).text(path)
    read = K.read_calls(spark, path)
    return read.groupBy("usable", "model").agg(F.count(F.lit(1)).alias("calls"), F.max("text").alias("last_text"))


Q["read_calls"] = read_calls
SQL["read_calls"] = oracle("""
SELECT usable, model, count(*) AS calls, max(text) AS last_text FROM (
  SELECT s % 5 <> 0 AND s % 7 <> 0 AS usable, CASE WHEN s % 5 <> 0 AND s % 7 <> 0 THEN 'm-' || s % 3 END AS model, CASE WHEN s % 5 = 0 OR s % 7 <> 0 THEN 'answer ' || s END AS text FROM {v_cached_calls}) t GROUP BY ALL
""")


def cache_write_prices(spark, sf_dir):
    calls = view(spark, sf_dir, "v_calls").select("model").distinct().withColumn("price", K.price_of("model"))
    each = [F.round(K.cache_write_price(F.col("price.input"), ttl), 6).alias(f"write_{ttl}") for ttl in ("5m", "1h")]
    return calls.where("price is not null").select("model", F.round("price.input", 6).alias("input"), *each)


Q["cache_write_prices"] = cache_write_prices
SQL["cache_write_prices"] = oracle("""
SELECT DISTINCT model, round(p_in, 6) AS input, round(p_in * 1.25, 6) AS write_5m, round(p_in * 2, 6) AS write_1h
FROM {o_priced} p WHERE p_in IS NOT NULL
""")


# ------------------------------------------------------------------ orders
def universe_ordered(spark, sf_dir):
    """Every survivor in rank order."""
    ordered = B.ordered_universe(screen(spark, sf_dir).ranked).select("entity_id", "composite")
    return ordered.withColumn("composite", F.round("composite", 6) + F.lit(0.0))


Q["universe_ordered"] = universe_ordered
SQL["universe_ordered"] = oracle("SELECT entity_id, round(composite, 6) + 0.0 AS composite FROM {o_ranked}")


def snapshots_for(spark, sf_dir):
    """Every snapshot of some entities, newest first; the list of entities is the parameter."""
    found = S.snapshots_for(view(spark, sf_dir, "v_snap"), ["1", "2", "3", "5", "8"])
    return found.select("entity_id", F.col("period_end").cast("string").alias("period_end"), "fiscal_period", "revenue")


Q["snapshots_for"] = snapshots_for
SQL["snapshots_for"] = oracle("SELECT entity_id, CAST(period_end AS VARCHAR) AS period_end, fiscal_period, revenue FROM {v_snap} WHERE entity_id IN ('1', '2', '3', '5', '8')")



def gbdt_features(spark, sf_dir):
    """The aligned matrix that the boosted baseline trains on, for the whole ledger."""
    return LN.feature_matrix(_picks(spark, sf_dir), ["a", "b"], ["ordinal", "strategy"])


Q["gbdt_features"] = gbdt_features
SQL["gbdt_features"] = oracle("""
SELECT ordinal, strategy, coalesce(f_a, 0) AS f0, CASE WHEN f_a IS NULL THEN 1.0::DOUBLE ELSE 0 END AS missing0, coalesce(f_b, 0) AS f1, CASE WHEN f_b IS NULL THEN 1.0::DOUBLE ELSE 0 END AS missing1 FROM {v_ledger}
""")

# ------------------------------------------------------------------ profiles and forms
VIEWS["v_exported"] = """
SELECT CAST(c_custkey AS STRING) AS entity_id, CASE WHEN c_custkey % 3 = 0 THEN '["A' || CAST(c_custkey AS STRING) || '","B"]' WHEN c_custkey % 3 = 1 THEN '[]' END AS tickers,
  CASE WHEN c_custkey % 2 = 0 THEN '["NYSE"]' ELSE 'not json' END AS exchanges,
  CASE WHEN c_custkey % 4 = 0 THEN '[{"name":"Old ' || CAST(c_custkey AS STRING) || '","from":"2001-02-03T00:00:00.000Z","to":"2011-02-03T00:00:00.000Z"}]' END AS former_names,
  CASE c_custkey % 4 WHEN 0 THEN ' 10-K, 8-K ,,' WHEN 1 THEN '' WHEN 2 THEN '10-Q' ELSE ' , ' END AS forms
FROM {customer}
"""


def typed_profiles(spark, sf_dir):
    typed = R.typed_profile_arrays(view(spark, sf_dir, "v_exported"))
    return typed.select(
        "entity_id", F.array_join("tickers", "|").alias("tickers"), F.array_join("exchanges", "|").alias("exchanges"),
        F.get("former_names", 0)["name"].alias("former"), F.array_join(C.split_forms("forms"), "|").alias("forms"),
    )


Q["typed_profiles"] = typed_profiles
SQL["typed_profiles"] = oracle("""
SELECT entity_id, CASE WHEN k % 3 = 0 THEN 'A' || k || '|B' WHEN k % 3 = 1 THEN '' END AS tickers, CASE WHEN k % 2 = 0 THEN 'NYSE' END AS exchanges,
  CASE WHEN k % 4 = 0 THEN 'Old ' || k END AS former, CASE k % 4 WHEN 0 THEN '10-K|8-K' WHEN 2 THEN '10-Q' ELSE '' END AS forms
FROM (SELECT *, CAST(entity_id AS BIGINT) AS k FROM {v_exported}) t
""")

# ------------------------------------------------------------------ filings of an entity, runs
VIEWS["v_archived"] = """
SELECT CASE doc_id % 4 WHEN 3 THEN 'esef' ELSE 'sec' END AS source, 'A' || CAST(doc_id AS STRING) AS doc_id, doc_id AS position,
  CASE WHEN doc_id % 9 = 5 THEN NULL ELSE CAST(CAST((doc_id - doc_id % 16) / 16 AS BIGINT) AS STRING) END AS cik,
  make_date(2026, CAST(1 + doc_id % 7 AS INT), CAST(1 + doc_id % 28 AS INT)) AS harvest_day,
  CASE WHEN doc_id % 6 <> 1 THEN make_date(2025, CAST(1 + doc_id % 12 AS INT), CAST(1 + doc_id % 27 AS INT)) END AS filing_date
FROM {documents}
"""


def manifest_filings(spark, sf_dir):
    manifest = view(spark, sf_dir, "v_archived").withColumn("entity", F.when(F.col("cik").isNotNull(), F.create_map(F.lit("cik"), "cik"))).drop("cik")
    return EV.filings_from_manifest(manifest).select("entity_id", "doc_id", F.col("place").cast("long").alias("place"))


Q["manifest_filings"] = manifest_filings
SQL["manifest_filings"] = oracle("""
SELECT cik AS entity_id, doc_id, row_number() OVER (PARTITION BY cik ORDER BY coalesce(CAST(filing_date AS VARCHAR), '') DESC, harvest_day DESC, position) AS place
FROM {v_archived} WHERE source = 'sec' AND cik IS NOT NULL QUALIFY place <= 3
""")
VIEWS["v_agent_runs"] = "SELECT DISTINCT CAST(conv_id AS STRING) AS run_id FROM {conversations}"
VIEWS["v_steps"] = """
SELECT CAST(conv_id AS STRING) AS run_id, CAST(turn AS BIGINT) + 1 AS position, role AS tool, '{' || CAST(turn AS STRING) || '}' AS tool_input, text AS observation, turn % 3 <> 1 AS ok
FROM {conversations} WHERE conv_id % 6 <> 2
"""
Q["step_digest"] = lambda spark, sf_dir: EV.step_digest(view(spark, sf_dir, "v_agent_runs"), view(spark, sf_dir, "v_steps"))
SQL["step_digest"] = oracle("""
SELECT run_id, position, position || '. ' || tool || '(' || tool_input || ')' || CASE WHEN ok THEN '' ELSE ' [failed]' END || ' -> ' || substr(regexp_extract(coalesce(observation, ''), '^[^\\n\\r\\x0b\\x0c\\x1c-\\x1e]*'), 1, 140) AS line FROM {v_steps}
UNION ALL SELECT run_id, 0, '(no tools were called)' FROM {v_agent_runs} WHERE CAST(run_id AS BIGINT) % 6 = 2
""")


def run_catalog(spark, sf_dir):
    sources = view(spark, sf_dir, "v_steps").where("position = 1").select("run_id", F.concat(F.lit("u"), "run_id").alias("source"), F.col("observation").alias("text"), F.lit(1).alias("priority"))
    return EV.run_catalog(view(spark, sf_dir, "v_agent_runs"), sources)


Q["run_catalog"] = run_catalog
SQL["run_catalog"] = oracle("""
SELECT run_id, 'u' || run_id AS source, '- u' || run_id || ': web page (' || format('{:,}', length(observation)) || ' chars)' AS line FROM {v_steps} WHERE position = 1
UNION ALL SELECT run_id, NULL, '(no sources fetched -- you have no basis for any finding)' FROM {v_agent_runs} r WHERE NOT EXISTS (SELECT 1 FROM {v_steps} s WHERE s.run_id = r.run_id AND s.position = 1)
""")
