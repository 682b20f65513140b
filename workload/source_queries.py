"""Queries over landed payloads. Each payload is derived from one row of a driver table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions import columns as C
from tallystone.functions import text as T
from tallystone.sources import facts as FS
from tallystone.sources import listings as L
from tallystone.sources import reference as R
from workload.views import VIEWS, oracle, view

Q: dict = {}
SQL: dict[str, str] = {}


def map_text(c: str):
    """key=value pairs in key order."""
    pairs = F.array_sort(F.map_entries(c))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def ref_rows(df, extra=()):
    return df.select(
        *extra, "source", "doc_id", F.col("filing_date").cast("string").alias("filing_date"),
        "form_type", "title", "url", map_text("entity").alias("entity"), map_text("meta").alias("meta"),
    )


# ------------------------------------------------------------------ daily index
VIEWS["v_index_rows"] = """
SELECT o_orderkey AS k, o_custkey AS cik, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS ymd,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso,
       CASE o_orderkey % 7 WHEN 0 THEN '10-K' WHEN 1 THEN 'NT 10-Q' WHEN 2 THEN '8-K' WHEN 3 THEN 'DEF 14A'
            WHEN 4 THEN '424B5' WHEN 5 THEN '10-K/A' ELSE '4' END AS form,
       lpad(CAST(o_custkey AS STRING), 10, '0') || CASE WHEN o_orderkey % 9 = 4 THEN '26' ELSE '-26-' END || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') AS base
FROM {orders}
"""
VIEWS["v_index_files"] = """
SELECT k, 'Description: Daily Index' || chr(10)
  || CASE WHEN k % 11 = 3 THEN 'Type' ELSE 'Form Type' END || '   Company Name   CIK' || chr(10) || '   Date Filed  File Name' || chr(10)
  || CASE WHEN k % 13 = 5 THEN '====' ELSE '--------------------' END || chr(10)
  || form || '     ' || CASE WHEN k % 5 = 0 THEN 'ACME  TOOLS' ELSE 'ACME TOOLS' END || ' ' || CAST(k AS STRING) || '   ' || CAST(cik AS STRING) || '     '
  || CASE WHEN k % 2 = 0 THEN CAST(ymd AS STRING) ELSE iso END || '   edgar/data/' || CAST(cik AS STRING) || '/' || base || '.txt' || chr(10)
  || CASE WHEN k % 4 = 1 THEN 'garbage line that does not parse' || chr(10) ELSE '' END || chr(10)
  || '3   Other Co   00012   ' || CASE WHEN k % 6 = 2 THEN '20261399' ELSE '20260721' END || '   edgar/data/12/0000000012-26-' || lpad(CAST(k % 1000000 AS STRING), 6, '0') || '.txt' AS text
FROM {v_index_rows}
"""


def edgar_index(spark, sf_dir):
    rows = L.parse_index(view(spark, sf_dir, "v_index_files"), ["k"])
    return rows.select(
        "k", "error", "form_type", "company", "cik", F.col("filed").cast("string").alias("filed"),
        "file_name", F.col("ok").cast("string").alias("ok"),
    )


Q["edgar_index"] = edgar_index
VIEWS["o_index"] = """
WITH good AS (SELECT * FROM {v_index_rows} WHERE k % 11 <> 3 AND k % 13 <> 5)
SELECT k, CAST(NULL AS VARCHAR) AS error, CASE WHEN k % 5 = 0 THEN form || '     ACME' ELSE form END AS form_type,
       CASE WHEN k % 5 = 0 THEN 'TOOLS ' || k ELSE 'ACME TOOLS ' || k END AS company, CAST(cik AS VARCHAR) AS cik, iso AS filed,
       'edgar/data/' || cik || '/' || base || '.txt' AS file_name, 'true' AS ok FROM good
UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, 'false' FROM good WHERE k % 4 = 1
UNION ALL SELECT k, NULL, '3', 'Other Co', '00012', CASE WHEN k % 6 <> 2 THEN '2026-07-21' END,
       'edgar/data/12/0000000012-26-' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') || '.txt', CASE WHEN k % 6 = 2 THEN 'false' ELSE 'true' END FROM good
UNION ALL SELECT k, CASE WHEN k % 11 = 3 THEN 'no recognizable header' ELSE 'header without a dashed rule' END, NULL, NULL, NULL, NULL, NULL, NULL
FROM {v_index_rows} WHERE k % 11 = 3 OR k % 13 = 5
"""
SQL["edgar_index"] = oracle("SELECT * FROM {o_index}")


def edgar_refs(spark, sf_dir):
    return ref_rows(L.edgar_refs(L.parse_index(view(spark, sf_dir, "v_index_files"), ["k"])))


Q["edgar_refs"] = edgar_refs
_FORMS = ", ".join(f"'{f}'" for f in V.INDEX_FORMS)
SQL["edgar_refs"] = oracle(f"""
SELECT 'sec' AS source, substr(b, 1, 10) || '-' || substr(replace(b, '-', ''), 11, 2) || '-' || right(b, 6) AS doc_id, filed AS filing_date, form_type,
       company AS title, 'https://www.sec.gov/Archives/' || file_name AS url, 'cik=' || CAST(CAST(cik AS BIGINT) AS VARCHAR) AS entity, '' AS meta
FROM (SELECT *, replace(split_part(file_name, '/', 4), '.txt', '') AS b FROM {{o_index}} WHERE ok = 'true') t WHERE form_type IN ({_FORMS})
""")

# ------------------------------------------------------------------ other listings
VIEWS["v_listing"] = """
SELECT c_custkey AS k, CAST(c_custkey AS STRING) AS ks,
  CASE WHEN c_custkey % 4 = 0 THEN 'esef' WHEN c_custkey % 4 = 1 THEN 'edinet' WHEN c_custkey % 4 = 2 THEN 'opendart' ELSE 'companies_house' END AS source,
  '2026-07-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS day, c_name AS name,
  CASE WHEN c_custkey % 4 = 0 THEN '{"data":[{"id":"F' || CAST(c_custkey AS STRING) || '","attributes":{'
     || CASE WHEN c_custkey % 3 = 0 THEN '"json_url":"/f/' || CAST(c_custkey AS STRING) || '.json",' ELSE '' END || '"package_url":"/f/' || CAST(c_custkey AS STRING) || '.zip","country":"GB","period_end":"2025-12-31",'
     || CASE WHEN c_custkey % 5 <> 0 THEN '"processed":"2026-07-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || ' 10:00:00.5",' ELSE '' END
     || '"date_added":"2026-07-01 00:00:00","error_count":' || CAST(c_custkey % 2 AS STRING) || '},"relationships":{"entity":{"data":{"id":"E' || CAST(c_custkey % 8 AS STRING) || '"}}}}],'
     || '"included":[{"id":"E0","type":"entity","attributes":{"identifier":"LEI0","name":"Zero Plc"}},{"id":"E4","type":"entity","attributes":{"identifier":"LEI4","name":"Four Plc"}}]}'
   WHEN c_custkey % 4 = 1 THEN '{"metadata":{"status":"' || CASE WHEN c_custkey % 50 = 1 THEN '403' ELSE '200' END || '","message":"m"},"results":[{"docID":"S' || CAST(c_custkey AS STRING) || '","withdrawalStatus":"' || CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '0' END
     || '","xbrlFlag":"' || CAST(c_custkey % 2 AS STRING) || '","csvFlag":"0","submitDateTime":"2026-07-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || ' 15:00","docTypeCode":"120","edinetCode":"E1","secCode":null,"filerName":"' || c_name || '"}]}'
   WHEN c_custkey % 4 = 2 THEN '{"status":"' || CASE WHEN c_custkey % 50 = 2 THEN '020' WHEN c_custkey % 9 = 0 THEN '013' ELSE '000' END || '","total_page":1,"list":[{"rcept_no":"R' || CAST(c_custkey AS STRING) || '","rcept_dt":"202607' || lpad(CAST(1 + c_custkey % 40 AS STRING), 2, '0')
     || '","report_nm":"annual","corp_code":"C' || CAST(c_custkey AS STRING) || '","corp_cls":"Y","corp_name":"' || c_name || '"}]}'
   ELSE '/landing/Accounts_Bulk_Data-2026-07-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || CASE WHEN c_custkey % 5 = 0 THEN '.tmp' ELSE '.zip' END END AS payload
FROM {customer}
"""


def listing_refs(spark, sf_dir):
    pages = view(spark, sf_dir, "v_listing")
    of = lambda s: pages.where(F.col("source") == s)
    day = F.to_date("day")
    return ref_rows(
        L.harvest_refs([
            L.esef_refs(of("esef"), day),
            L.edinet_refs(of("edinet")),
            L.opendart_refs(of("opendart")),
            L.companies_house_refs(of("companies_house"), "payload"),
        ])
    )


Q["listing_refs"] = listing_refs
SQL["listing_refs"] = oracle("""
SELECT source, 'F' || ks AS doc_id, '2025-12-31' AS filing_date, CAST(NULL AS VARCHAR) AS form_type,
  CASE k % 8 WHEN 0 THEN 'Zero Plc' WHEN 4 THEN 'Four Plc' END AS title, 'https://filings.xbrl.org/f/' || ks || CASE WHEN k % 3 = 0 THEN '.json' ELSE '.zip' END AS url,
  'country=GB' || CASE k % 8 WHEN 0 THEN ';lei=LEI0' WHEN 4 THEN ';lei=LEI4' ELSE '' END AS entity,
  'date_added=2026-07-01 00:00:00;download_kind=' || CASE WHEN k % 3 = 0 THEN 'xbrl-json' ELSE 'zip' END || ';error_count=' || k % 2 AS meta
FROM {v_listing} WHERE source = 'esef' AND (k % 5 <> 0 OR day = '2026-07-01')
UNION ALL SELECT source, 'S' || ks, day, '120', NULL, 'https://api.edinet-fsa.go.jp/api/v2/documents/S' || ks, 'edinet_code=E1;jcn=;sec_code=', 'csv_flag=0;filer_name=' || name || ';xbrl_flag=1'
FROM {v_listing} WHERE source = 'edinet' AND k % 50 <> 1 AND k % 3 <> 0 AND k % 2 = 1
UNION ALL SELECT source, 'R' || ks, CASE WHEN k % 40 < 31 THEN '2026-07-' || lpad(CAST(1 + k % 40 AS VARCHAR), 2, '0') END, 'annual', 'annual', 'https://opendart.fss.or.kr/api/document.xml?rcept_no=R' || ks,
  'corp_cls=Y;corp_code=C' || ks || ';stock_code=', 'corp_name=' || name || ';flr_nm=;rm='
FROM {v_listing} WHERE source = 'opendart' AND k % 50 <> 2 AND k % 9 <> 0
UNION ALL SELECT source, 'accounts-bulk-' || day, day, 'accounts_bulk', 'Companies House daily accounts bulk data for ' || day, 'http://download.companieshouse.gov.uk/Accounts_Bulk_Data-' || day || '.zip', '', 'filename=Accounts_Bulk_Data-' || day || '.zip'
FROM {v_listing} WHERE source = 'companies_house' AND k % 5 <> 0
""")


def listing_errors(spark, sf_dir):
    pages = view(spark, sf_dir, "v_listing")
    of = lambda s: pages.where(F.col("source") == s)
    both = L.edinet_errors(of("edinet")).unionByName(L.opendart_errors(of("opendart")))
    return both.groupBy("source", "status").agg(F.count(F.lit(1)).alias("pages"))


Q["listing_errors"] = listing_errors
SQL["listing_errors"] = oracle("""
SELECT 'edinet' AS source, '403' AS status, count(*) AS pages FROM {v_listing} WHERE source = 'edinet' AND k % 50 = 1 HAVING count(*) > 0
UNION ALL SELECT 'opendart', '020', count(*) FROM {v_listing} WHERE source = 'opendart' AND k % 50 = 2 HAVING count(*) > 0
""")


VIEWS["v_pages"] = """
SELECT source, payload, day FROM {v_listing}
UNION ALL SELECT 'sec', text, CAST(k AS STRING) FROM {v_index_files}
UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'edgar' END, payload, day FROM {v_listing} WHERE k % 7 = 0
"""


def harvest_pages_refs(spark, sf_dir):
    return ref_rows(L.harvest_pages(view(spark, sf_dir, "v_pages"))[0])


def harvest_pages_errors(spark, sf_dir):
    return L.harvest_pages(view(spark, sf_dir, "v_pages"))[1].select("source", "status", "message", "pages")


Q["harvest_refs"] = harvest_pages_refs
Q["harvest_errors"] = harvest_pages_errors
_REFS_CTES = oracle("SELECT * FROM {v_listing} JOIN {o_index} ON true").rsplit("SELECT * FROM v_listing JOIN", 1)[0]
SQL["harvest_refs"] = _REFS_CTES + " UNION ALL ".join(
    SQL[n][SQL[n].rindex(start):].replace("{", "").replace("}", "") for n, start in (
        ("listing_refs", "SELECT source, 'F' || ks AS doc_id"), ("edgar_refs", "SELECT 'sec' AS source"))
)
SQL["harvest_errors"] = _REFS_CTES + f"""
SELECT * FROM (
  SELECT 'sec' AS source, 'unreadable' AS status, error AS message, count(*) AS pages FROM o_index WHERE error IS NOT NULL GROUP BY error
  UNION ALL SELECT 'edinet', '403', 'm', count(*) FROM v_listing WHERE source = 'edinet' AND k % 50 = 1 HAVING count(*) > 0
  UNION ALL SELECT 'opendart', '020', NULL, count(*) FROM v_listing WHERE source = 'opendart' AND k % 50 = 2 HAVING count(*) > 0
  UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'edgar' END, 'unknown', 'known: {', '.join(L.LISTINGS)}', count(*) FROM v_listing WHERE k % 7 = 0 GROUP BY ALL
) t
"""


def harvest_days(spark, sf_dir):
    ends = view(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.to_date(F.max("o_orderdate")).alias("last")
    )
    return ends.select(
        "o_orderstatus", F.posexplode(C.day_list(7, "last")).alias("position", "day")
    ).select("o_orderstatus", F.col("position").cast("long").alias("position"), F.col("day").cast("string").alias("day"))


Q["harvest_days"] = harvest_days
SQL["harvest_days"] = """
SELECT o_orderstatus, i AS position, CAST(CAST(last AS DATE) - 6 + CAST(i AS INT) AS VARCHAR) AS day
FROM (SELECT o_orderstatus, max(o_orderdate) AS last, unnest(range(0, 7)) AS i FROM orders GROUP BY o_orderstatus) t
"""

# ------------------------------------------------------------------ search hits and tickers
VIEWS["v_search"] = """
SELECT c_custkey AS k, '{"hits":{"total":{"value":' || CASE WHEN c_custkey % 10 = 9 THEN '0' ELSE '3' END || '},"hits":[{"_id":"0001-26-' || CAST(c_custkey AS STRING) || ':doc.htm","_source":{"ciks":["' || CAST(c_custkey AS STRING)
  || '","2"],"display_names":["' || c_name || '"],"root_forms":["' || CASE WHEN c_custkey % 2 = 0 THEN '10-K' ELSE '8-K' END || '"],"file_date":"2026-01-02"}},{"_id":"bare","_source":{"ciks":[],"root_forms":["10-K"]}},{"_id":"x:y:z"}]}}' AS payload,
  '{"0":{"cik_str":' || CAST(c_custkey AS STRING) || ',"ticker":"T' || CAST(c_custkey AS STRING) || '","title":"' || c_name || '"},"1":{"ticker":"U"}}' AS tickers
FROM {customer}
"""
Q["search_hits"] = lambda spark, sf_dir: L.search_hits(view(spark, sf_dir, "v_search"), keys=["k"])
Q["search_hits_limit"] = lambda spark, sf_dir: L.search_hits(  # the limit is the feature
    view(spark, sf_dir, "v_search"), limit=2, keys=["k"]
)
SQL["search_hits_limit"] = oracle("""
SELECT k, '0001-26-' || k AS accession, CAST(k AS VARCHAR) AS cik, c_name AS company, CASE WHEN k % 2 = 0 THEN '10-K' ELSE '8-K' END AS form, '2026-01-02' AS filed, 'doc.htm' AS doc
FROM {v_search} JOIN customer ON c_custkey = k WHERE k % 10 <> 9
UNION ALL SELECT k, 'bare', '', '', '10-K', '', '' FROM {v_search} WHERE k % 10 <> 9
""")
SQL["search_hits"] = SQL["search_hits_limit"] + " UNION ALL SELECT k, 'x', '', '', '', '', 'y:z' FROM v_search WHERE k % 10 <> 9"
Q["search_hits_by_form"] = lambda spark, sf_dir: L.search_hits(
    view(spark, sf_dir, "v_search"), forms=["10-K"], keys=["k"]
)
SQL["search_hits_by_form"] = oracle("""
SELECT k, '0001-26-' || k AS accession, CAST(k AS VARCHAR) AS cik, c_name AS company, '10-K' AS form, '2026-01-02' AS filed, 'doc.htm' AS doc
FROM {v_search} JOIN customer ON c_custkey = k WHERE k % 10 <> 9 AND k % 2 = 0
UNION ALL SELECT k, 'bare', '', '', '10-K', '', '' FROM {v_search} WHERE k % 10 <> 9
""")
Q["company_tickers"] = lambda spark, sf_dir: L.company_tickers(
    view(spark, sf_dir, "v_search"), "tickers"
)
SQL["company_tickers"] = """
SELECT CAST(c_custkey AS VARCHAR) AS cik, 'T' || c_custkey AS ticker, c_name AS title FROM customer
UNION ALL SELECT '', 'U', NULL FROM customer
"""

# ------------------------------------------------------------------ xBRL-JSON
VIEWS["v_oim"] = """
SELECT accession, entity_id, CAST(entity_id AS BIGINT) AS s, CAST(floor(revenue) AS BIGINT) AS rev, CAST(floor(total_assets) AS BIGINT) AS ta, currency, fiscal_year AS y,
  '{"documentInfo":{},"facts":{"f1":{"value":"' || CAST(CAST(floor(revenue) AS BIGINT) AS STRING) || '","decimals":-3,"dimensions":{"concept":"ifrs-full:Revenue","entity":"http://x:y:' || entity_id || '","period":"' || CAST(fiscal_year AS STRING) || '-01-01T00:00:00/' || CAST(fiscal_year + 1 AS STRING) || '-01-01T00:00:00","unit":"iso4217:' || currency || '"}},'
  || '"f2":{"value":' || CAST(CAST(floor(total_assets) AS BIGINT) AS STRING) || ',"dimensions":{"concept":"ifrs-full:Assets","entity":"lei:' || entity_id || '","period":"' || CAST(fiscal_year AS STRING) || '-12-31","unit":"iso4217:' || currency || '"}},'
  || '"f3":{"value":"12.5","decimals":"INF","dimensions":{"concept":"ifrs-full:Revenue","entity":"lei:' || entity_id || '","period":"' || CAST(fiscal_year AS STRING) || '-01-01/' || CAST(fiscal_year AS STRING) || '-06-30","unit":"xbrli:pure","ext:Axis":"ext:Member"}},'
  || '"f4":{"value":"Company ' || entity_id || '","dimensions":{"concept":"ifrs-full:NameOfReportingEntity","entity":"lei:' || entity_id || '","period":"' || CAST(fiscal_year AS STRING) || '-12-31"}},'
  || '"f5":{"value":"7","dimensions":{"concept":"noprefix","entity":"lei:999","period":"2020-12-31"}},'
  || '"f6":{"value":' || CASE WHEN CAST(entity_id AS BIGINT) % 2 = 0 THEN 'true' ELSE '" 1e3 "' END || ',"dimensions":{"concept":"ext:Flag","entity":"lei:' || entity_id || '","period":"' || CASE WHEN CAST(entity_id AS BIGINT) % 3 = 0 THEN 'someday' ELSE '2020-12-31' END || '","unit":"xbrli:shares"}}}}' AS payload
FROM {v_snap}
"""
VIEWS["o_oim"] = """
SELECT accession, 0 AS fact_ordinal, 'fact' AS outcome, entity_id, CAST(NULL AS VARCHAR) AS entity_name, 'ifrs-full' AS taxonomy, 'Revenue' AS local_name, CAST(rev AS DOUBLE) AS value, currency AS unit, 'duration' AS period_type,
  y || '-01-01' AS period_start, (y + 1) || '-01-01' AS period_end, false AS is_dimensioned, CAST(-3 AS DOUBLE) AS decimals FROM {v_oim}
UNION ALL SELECT accession, 1, 'fact', entity_id, NULL, 'ifrs-full', 'Assets', CAST(ta AS DOUBLE), currency, 'instant', NULL, y || '-12-31', false, NULL FROM {v_oim}
UNION ALL SELECT accession, 2, 'fact', entity_id, NULL, 'ifrs-full', 'Revenue', 12.5, 'pure', 'duration', y || '-01-01', y || '-06-30', true, NULL FROM {v_oim}
UNION ALL SELECT accession, 3, 'non_numeric', entity_id, 'Company ' || entity_id, 'ifrs-full', 'NameOfReportingEntity', NULL, NULL, 'instant', NULL, y || '-12-31', false, NULL FROM {v_oim}
UNION ALL SELECT accession, 4, 'malformed', NULL, NULL, 'noprefix', '', 7, NULL, 'instant', NULL, '2020-12-31', false, NULL FROM {v_oim}
UNION ALL SELECT accession, 5, CASE WHEN s % 2 = 0 THEN 'non_numeric' WHEN s % 3 = 0 THEN 'malformed' ELSE 'fact' END, entity_id, NULL, 'ext', 'Flag', CASE WHEN s % 2 = 1 THEN 1000 END, 'shares', 'instant', NULL,
  CASE WHEN s % 3 <> 0 THEN '2020-12-31' END, false, NULL FROM {v_oim}
"""


def oim_facts(spark, sf_dir):
    return FS.oim_facts(view(spark, sf_dir, "v_oim")).select(
        "accession", F.col("fact_ordinal").cast("int").alias("fact_ordinal"), "outcome", "entity_id", "entity_name", "taxonomy", "local_name", "value",
        "unit", "period_type", F.col("period_start").cast("string").alias("period_start"),
        F.col("period_end").cast("string").alias("period_end"), "is_dimensioned", F.col("decimals").cast("double").alias("decimals"),
    )


Q["oim_facts"] = oim_facts
SQL["oim_facts"] = oracle("SELECT * FROM {o_oim}")


def oim_filings(spark, sf_dir):
    return FS.oim_filings(FS.oim_facts(view(spark, sf_dir, "v_oim"))).withColumn(
        "period_of_report", F.col("period_of_report").cast("string")
    )


Q["oim_filings"] = oim_filings
SQL["oim_filings"] = oracle("""
SELECT accession, entity_id, 'Company ' || entity_id AS entity_name, 'ifrs-full' AS taxonomy, (y + 1) || '-01-01' AS period_of_report,
       CAST(3 + CASE WHEN s % 2 = 1 AND s % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS facts, CAST(1 + CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS skipped_non_numeric,
       CAST(1 + CASE WHEN s % 2 = 1 AND s % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS skipped_malformed
FROM {v_oim}
""")

# ------------------------------------------------------------------ landed XBRL facts
VIEWS["v_sec_rows"] = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS accession, l_linenumber AS fact_ordinal, l_orderkey AS o, l_linenumber AS n,
  CASE WHEN l_orderkey % 10 = 1 THEN 'BareName' ELSE 'us-gaap:Revenues' END AS concept,
  CASE WHEN l_orderkey % 7 = 2 THEN 'NaN' WHEN l_orderkey % 7 = 3 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS numeric_value,
  'u1' AS unit_ref, CASE WHEN l_orderkey % 3 = 0 THEN 'USD' WHEN l_orderkey % 3 = 1 THEN 'nan' END AS currency,
  CASE WHEN l_orderkey % 4 = 0 THEN 'INF' WHEN l_orderkey % 4 = 1 THEN '-3' WHEN l_orderkey % 4 = 2 THEN '2.9' END AS decimals,
  CASE WHEN l_orderkey % 5 = 0 THEN 'instant' WHEN l_orderkey % 5 = 1 THEN 'odd' ELSE 'duration' END AS period_type,
  '2026-01-01T00:00:00' AS period_start, CASE WHEN l_orderkey % 11 = 4 THEN 'NaT' ELSE '2026-06-30' END AS period_end,
  CASE WHEN l_orderkey % 2 = 0 THEN '2026-07-01' END AS period_instant, ' FY ' AS fiscal_period, '2026' AS fiscal_year, l_orderkey % 6 = 0 AS is_dimensioned,
  CAST(l_quantity AS INT) AS qty
FROM {lineitem}
"""


def sec_facts(spark, sf_dir):
    parsed = FS.sec_facts(view(spark, sf_dir, "v_sec_rows"))
    return parsed.groupBy(
        "outcome", "taxonomy", "local_name", "unit", "period_type",
        F.col("period_start").cast("string").alias("period_start"),
        F.col("period_end").cast("string").alias("period_end"), "is_dimensioned",
        F.col("decimals").cast("double").alias("decimals"), "fiscal_year", "fiscal_period",
    ).agg(F.count(F.lit(1)).alias("facts"), F.sum("value").alias("total"))


Q["sec_facts"] = sec_facts
SQL["sec_facts"] = oracle("""
WITH t AS (SELECT *, o % 7 IN (2, 3) AS nn, CASE WHEN o % 5 = 0 AND o % 2 = 0 THEN '2026-07-01' WHEN o % 11 <> 4 THEN '2026-06-30' END AS pe FROM {v_sec_rows})
SELECT CASE WHEN nn THEN 'non_numeric' WHEN pe IS NULL THEN 'no_period' ELSE 'fact' END AS outcome, CASE WHEN o % 10 = 1 THEN '' ELSE 'us-gaap' END AS taxonomy,
  CASE WHEN o % 10 = 1 THEN 'BareName' ELSE 'Revenues' END AS local_name, CASE WHEN o % 3 = 0 THEN 'USD' ELSE 'u1' END AS unit,
  CASE WHEN o % 5 = 0 THEN 'instant' ELSE 'duration' END AS period_type, CASE WHEN o % 5 <> 0 THEN '2026-01-01' END AS period_start, pe AS period_end, is_dimensioned,
  CAST(CASE o % 4 WHEN 1 THEN -3 WHEN 2 THEN 2 END AS DOUBLE) AS decimals, 2026 AS fiscal_year, 'FY' AS fiscal_period, count(*) AS facts, sum(CASE WHEN NOT nn THEN CAST(qty AS DOUBLE) END) AS total
FROM t GROUP BY ALL
""")

# ------------------------------------------------------------------ exchange-rate payloads
VIEWS["v_sdmx"] = """
SELECT event_id AS k, event_type, CAST(CAST(ts AS DATE) AS STRING) AS d0, CAST(CAST(ts AS DATE) + 1 AS STRING) AS d1, CAST(CAST(ts AS DATE) + 3 AS STRING) AS d2,
  CAST(round(value * 100) AS BIGINT) AS cents,
  CASE WHEN event_id % 9 = 0 THEN '{"dataSets":[]}' ELSE
  '{"dataSets":[{"series":{"0:0:0:0:0":{"observations":{"0":[' || CAST(CAST(round(value * 100) AS BIGINT) AS STRING) || ',0,null],"1":[null],"2":[' || CAST(event_id % 100 AS STRING) || ']}}}}],"structure":{"dimensions":{"observation":[{"id":"TIME_PERIOD","values":[{"id":"'
  || CAST(CAST(ts AS DATE) AS STRING) || '"},{"id":"' || CAST(CAST(ts AS DATE) + 1 AS STRING) || '"},{"id":"' || CAST(CAST(ts AS DATE) + 3 AS STRING) || '"}]}]}}}' END AS payload
FROM {events}
"""
Q["ecb_series"] = lambda spark, sf_dir: R.ecb_series(
    view(spark, sf_dir, "v_sdmx"), keys=["k"]
).withColumn("day", F.col("day").cast("string"))
SQL["ecb_series"] = oracle("""
SELECT k, d0 AS day, CAST(cents AS DOUBLE) AS rate FROM {v_sdmx} WHERE k % 9 <> 0 AND cents IS NOT NULL
UNION ALL SELECT k, d2, CAST(k % 100 AS DOUBLE) FROM {v_sdmx} WHERE k % 9 <> 0
""")

# ------------------------------------------------------------------ submissions
VIEWS["v_submissions"] = """
SELECT CAST(s_suppkey AS STRING) AS entity_id, s_suppkey AS s, s_name AS name,
  CASE WHEN s_suppkey % 29 = 11 THEN '[1, 2]' ELSE '{"name":" ' || s_name || ' ","sic":' || CASE WHEN s_suppkey % 3 = 0 THEN '"' || CAST(1000 + (s_suppkey * 137) % 9000 AS STRING) || '"' WHEN s_suppkey % 3 = 1 THEN CAST(1000 + (s_suppkey * 137) % 9000 AS STRING) ELSE '""' END
  || ',"category":"Non-accelerated filer","entityType":"' || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'operating' END || '","tickers":["T' || CAST(s_suppkey AS STRING) || '","U"],"exchanges":["NYSE"],'
  || '"formerNames":[' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '{"name":"OLD CO","from":"2001-01-01T05:00:00.000Z","to":"' || CASE WHEN s_suppkey % 2 = 0 THEN '2025-08-31T00:00:00.000Z' ELSE '2020-02-29' END || '"},{"name":"' || upper(s_name) || '","from":"2020-01-01","to":"2026-07-30"}' END || '],'
  || '"filings":{"recent":{"form":[' || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '"10-Q","NT 10-K","10-K"' END || '],"filingDate":[' || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '"2026-07-15","' || CASE WHEN s_suppkey % 2 = 0 THEN '2024-07-15' ELSE '2024-07-14' END || '","2025-02-01"' END || ']}}}' END AS payload
FROM {supplier}
"""


def submission_profile(spark, sf_dir):
    p = R.submission_profiles(view(spark, sf_dir, "v_submissions"))
    return p.select(
        "entity_id", "name", "country", "sic", "sector", "is_excluded_sector", F.array_join("tickers", ",").alias("tickers"),
        "filer_category", "entity_type", F.size("former_names").cast("long").alias("former_names"),
        F.col("has_recent_late_filing").cast("string").alias("late"), F.col("name_changed_within_months").cast("double").alias("months"),
        "most_recent_form", F.col("most_recent_filing_date").cast("string").alias("newest"),
    )


Q["submission_profile"] = submission_profile
_SECTOR = "CASE " + " ".join(f"WHEN sic BETWEEN {lo} AND {hi} THEN '{n}'" for lo, hi, n in V.SIC_SECTORS) + " ELSE 'unknown' END"
SQL["submission_profile"] = oracle(f"""
WITH t AS (SELECT *, s % 29 = 11 AS bad, CASE WHEN s % 3 <> 2 AND s % 29 <> 11 THEN 1000 + (s * 137) % 9000 END AS sic FROM {{v_submissions}}),
     u AS (SELECT *, CASE WHEN NOT bad THEN {_SECTOR} END AS sector FROM t)
SELECT entity_id, CASE WHEN NOT bad THEN name END AS name, 'US' AS country, CAST(sic AS VARCHAR) AS sic, sector, coalesce(sector IN ('finance', 'utilities'), false) AS is_excluded_sector,
  CASE WHEN bad THEN '' ELSE 'T' || s || ',U' END AS tickers, CASE WHEN NOT bad THEN 'Non-accelerated filer' END AS filer_category, CASE WHEN NOT bad AND s % 4 <> 0 THEN 'operating' END AS entity_type,
  CAST(CASE WHEN bad OR s % 5 = 0 THEN 0 ELSE 2 END AS BIGINT) AS former_names, CASE WHEN bad OR s % 7 = 0 THEN NULL WHEN s % 2 = 0 THEN 'true' ELSE 'false' END AS late,
  CAST(CASE WHEN bad OR s % 5 = 0 THEN NULL WHEN s % 7 = 0 THEN
     (year(current_date) - CASE WHEN s % 2 = 0 THEN 2025 ELSE 2020 END) * 12 + month(current_date) - CASE WHEN s % 2 = 0 THEN 8 ELSE 2 END - CASE WHEN day(current_date) < CASE WHEN s % 2 = 0 THEN 31 ELSE 29 END THEN 1 ELSE 0 END
     WHEN s % 2 = 0 THEN 10 ELSE 76 END AS DOUBLE) AS months,
  CASE WHEN NOT bad AND s % 7 <> 0 THEN '10-Q' END AS most_recent_form, CASE WHEN NOT bad AND s % 7 <> 0 THEN '2026-07-15' END AS newest
FROM u
""")

# ------------------------------------------------------------------ price files
VIEWS["v_price_files"] = """
SELECT s_suppkey AS k, '{" A' || CAST(s_suppkey AS STRING) || ' ":' || CAST(CAST(round(s_acctbal) AS BIGINT) AS STRING) || ',"B":"' || CASE WHEN s_suppkey % 3 = 0 THEN 'Infinity' WHEN s_suppkey % 3 = 1 THEN 'abc' ELSE '2.5' END || '","C":' || CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE '4' END || '}' AS payload,
  CASE WHEN s_suppkey % 4 = 0 THEN 'C=9' WHEN s_suppkey % 4 = 1 THEN 'nothing' WHEN s_suppkey % 4 = 2 THEN ' C = -1' ELSE 'D= 7.5 ' END AS pair,
  CAST(round(s_acctbal) AS BIGINT) AS bal
FROM {supplier}
"""


def price_file(spark, sf_dir):
    files = view(spark, sf_dir, "v_price_files")
    entries = R.price_entries(files, keys=["k"]).unionByName(R.inline_prices(files, keys=["k"]))
    kept = R.merge_prices(entries, ["k"]).select("k", "entity_id", "price", F.lit(None).cast("string").alias("rejected"))
    rejected = entries.where("reject_reason is not null").select(
        "k", "entity_id", F.lit(None).cast("double").alias("price"), F.col("reject_reason").alias("rejected")
    )
    return kept.unionByName(rejected)


Q["price_file"] = price_file
SQL["price_file"] = oracle("""
WITH e AS (SELECT k, 'A' || k AS entity_id, CAST(bal AS DOUBLE) AS price, CASE WHEN bal <= 0 THEN 'must be finite and positive' END AS rejected, 0 AS pri FROM {v_price_files}
 UNION ALL SELECT k, 'B', CASE k % 3 WHEN 2 THEN 2.5 END, CASE k % 3 WHEN 0 THEN 'must be finite and positive' WHEN 1 THEN 'is not a number' END, 0 FROM {v_price_files}
 UNION ALL SELECT k, 'C', CASE WHEN k % 2 = 1 THEN 4 END, CASE WHEN k % 2 = 0 THEN 'must be a number, not a boolean' END, 0 FROM {v_price_files}
 UNION ALL SELECT k, CASE k % 4 WHEN 0 THEN 'C' WHEN 2 THEN 'C' WHEN 3 THEN 'D' END, CASE k % 4 WHEN 0 THEN 9 WHEN 3 THEN 7.5 END, CASE k % 4 WHEN 1 THEN 'expects ENTITY=VALUE' WHEN 2 THEN 'must be finite and positive' END, 1 FROM {v_price_files})
SELECT k, entity_id, max_by(price, pri) AS price, CAST(NULL AS VARCHAR) AS rejected FROM e WHERE rejected IS NULL GROUP BY k, entity_id
UNION ALL SELECT k, entity_id, NULL, rejected FROM e WHERE rejected IS NOT NULL
""")

# ------------------------------------------------------------------ submissions text
VIEWS["v_sgml"] = """
SELECT page_id, html, '<SEC-HEADER>' || chr(10) || 'CONFORMED SUBMISSION TYPE:' || chr(9) || '10-K' || chr(10) || '</SEC-HEADER>' || chr(10)
  || '<DOCUMENT>' || chr(10) || '<TYPE>EX-99' || chr(10) || '<FILENAME>ex.htm' || chr(10) || '<TEXT>' || chr(10) || '<p>' || repeat('exhibit words ', 12) || '</p>' || chr(10) || '</TEXT>' || chr(10) || '</DOCUMENT>' || chr(10)
  || '<DOCUMENT>' || chr(10) || '<TYPE>' || CASE WHEN page_id % 3 = 0 THEN '10-K405' ELSE '10-K' END || chr(10) || '<FILENAME>' || CASE WHEN page_id % 5 = 0 THEN 'main.TXT' ELSE 'main.HTM' END || chr(10) || '<TEXT>' || chr(10)
  || CASE WHEN page_id % 7 = 0 THEN 'short' ELSE html END || chr(10) || '</TEXT>' || chr(10) || '</DOCUMENT>' AS raw
FROM {pages}
"""


def primary_document(spark, sf_dir):
    return view(spark, sf_dir, "v_sgml").select(
        "page_id", F.md5(T.primary_text(F.col("raw"))).alias("text_md5"),
        F.length(T.primary_text(F.col("raw"))).cast("long").alias("chars"),
    )


Q["primary_document"] = primary_document
_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def html_sql(c: str) -> str:
    x = f"regexp_replace({c}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&"), ("&#8217;", "''"), ("&#8216;", "''")):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace(regexp_replace({x}, '&#[0-9]+;', ' ', 'g'), '&[a-z]+;', ' ', 'g')"
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


_EXHIBIT = "trim(repeat('exhibit words ', 12))"
SQL["primary_document"] = oracle(f"""
SELECT page_id, md5(t) AS text_md5, length(t) AS chars FROM (
  SELECT page_id, CASE WHEN page_id % 3 = 0 OR page_id % 5 = 0 THEN {_EXHIBIT} WHEN page_id % 7 = 0 OR length(html) < 100 THEN '' ELSE {html_sql('html')} END AS t FROM pages) u
""")
Q["page_text"] = lambda spark, sf_dir: view(spark, sf_dir, "pages").select(
    "page_id", T.html_to_text(F.col("html")).alias("text")
)
SQL["page_text"] = f"SELECT page_id, {html_sql('html')} AS text FROM pages"
