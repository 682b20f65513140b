"""Explicit schemas of every input; nothing is inferred."""

from __future__ import annotations

MANIFEST = (
    "source string, doc_id string, version int, content_sha256 string, size_bytes long, "
    "path string, filename string, ingested_at string, harvest_day date, filing_date date, "
    "form_type string, title string, url string, content_type string, "
    "entity map<string,string>, meta map<string,string>, run string"
)
RAW_FACT = (
    "accession string, taxonomy string, local_name string, value double, unit string, "
    "period_type string, period_start date, period_end date, is_dimensioned boolean, "
    "decimals int, fiscal_year int, fiscal_period string"
)
PICK = (
    "as_of date, strategy string, entity_id string, name string, cohort string, "
    "reference_price double, currency string, weight double, rank int, score double, "
    "vetoed boolean, features map<string,double>, run_id string, note string"
)
MODEL_CALL = (
    "format_version int, cached_at string, fingerprint string, "
    "response struct<text:string, reasoning:string, model:string, output_mode:string, "
    "usage:struct<input_tokens:long, output_tokens:long, cached_input_tokens:long, "
    "reasoning_tokens:long>>"
)
SUBMISSION = (
    "struct<name:string, sic:string, sicDescription:string, category:string, "
    "entityType:string, fiscalYearEnd:string, tickers:array<string>, exchanges:array<string>, "
    "formerNames:array<struct<name:string, `from`:string, `to`:string>>, "
    "filings:struct<recent:struct<form:array<string>, filingDate:array<string>>>>"
)
SDMX = (
    "struct<dataSets:array<struct<series:map<string,struct<observations:"
    "map<string,array<double>>>>>>, structure:struct<dimensions:struct<observation:"
    "array<struct<id:string, `values`:array<struct<id:string>>>>>>>"
)
OIM = (
    "struct<facts:map<string,struct<value:string, decimals:string, "
    "dimensions:map<string,string>>>>"
)
ESEF_LISTING = (
    "struct<data:array<struct<id:string, attributes:struct<json_url:string, "
    "package_url:string, report_url:string, processed:string, date_added:string, "
    "period_end:string, country:string, fxo_id:string, error_count:string>, "
    "relationships:struct<entity:struct<data:struct<id:string>>>>>, "
    "included:array<struct<id:string, type:string, "
    "attributes:struct<identifier:string, name:string>>>>"
)
EDINET_LISTING = (
    "struct<metadata:struct<status:string, message:string>, results:array<struct<"
    "docID:string, withdrawalStatus:string, xbrlFlag:string, csvFlag:string, "
    "submitDateTime:string, docTypeCode:string, docDescription:string, edinetCode:string, "
    "secCode:string, JCN:string, filerName:string>>>"
)
OPENDART_LISTING = (
    "struct<status:string, message:string, total_page:string, list:array<struct<"
    "rcept_no:string, rcept_dt:string, report_nm:string, corp_code:string, stock_code:string, "
    "corp_cls:string, corp_name:string, flr_nm:string, rm:string>>>"
)
SEARCH_RESULT = (
    "struct<hits:struct<total:struct<value:long>, hits:array<struct<_id:string, _source:struct<"
    "ciks:array<string>, display_names:array<string>, root_forms:array<string>, "
    "file_date:string>>>>>"
)
TICKER_MAP = "map<string,struct<cik_str:string, ticker:string, title:string>>"
RUN_INDEX = (
    "run_id string, generated string, model string, requested long, researched long, "
    "vetoed long, entries array<struct<entity_id:string, name:string, verdict:string, "
    "vetoed:boolean, findings:long, markdown:string, json:string, status:string>>"
)
