"""Queries over filing text: anonymization, excerpts, quotes, vetoes, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import text as T
from tallystone.operators import evidence as EV
from workload.screen_queries import r6, report
from workload.views import VIEWS, oracle, view

Q: dict = {}
SQL: dict[str, str] = {}

# Filings: documents with one planted sentence, eight filings an entity.
VIEWS["v_filings"] = """
SELECT CAST(CAST((doc_id - doc_id % 8) / 8 AS BIGINT) AS STRING) AS entity_id, 'A' || CAST(doc_id AS STRING) AS accession, doc_id AS position, doc_id,
  make_date(2026, CAST(1 + doc_id % 7 AS INT), CAST(1 + doc_id % 28 AS INT)) AS harvest_day,
  CASE WHEN doc_id % 6 <> 1 THEN make_date(2025, CAST(1 + doc_id % 12 AS INT), CAST(1 + doc_id % 27 AS INT)) END AS filing_date,
  text || ' ' || CASE doc_id % 11 WHEN 0 THEN 'There is substantial doubt about our ability to continue as a going concern.'
    WHEN 1 THEN 'The notes are convertible at the lowest quoted closing price.' WHEN 2 THEN 'A reverse stock split was approved.'
    WHEN 3 THEN 'An officer loan and other related party dealings exist.' WHEN 4 THEN 'We sell shares in an at-the-market program; dilution follows.'
    WHEN 5 THEN 'We are in default.' WHEN 6 THEN 'We reported a material weakness.' WHEN 7 THEN 'A class action was filed.' ELSE 'Nothing else.' END AS text
FROM {documents}
"""
VIEWS["o_pack"] = """
SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(CAST(filing_date AS VARCHAR), '') DESC, harvest_day DESC, position) AS place
FROM {v_filings} QUALIFY place <= 3
"""


def newest_filings(spark, sf_dir):
    return EV.newest_filings(view(spark, sf_dir, "v_filings")).select("entity_id", "accession", F.col("place").cast("long").alias("place"))


Q["newest_filings"] = newest_filings
SQL["newest_filings"] = oracle("SELECT entity_id, accession, place FROM {o_pack}")


def _pack(spark, sf_dir):
    return EV.newest_filings(view(spark, sf_dir, "v_filings"))


def anonymized_text(spark, sf_dir):
    docs = view(spark, sf_dir, "v_filings")
    targets = T.redactions(F.lit("of"), F.array(F.lit("the"), F.lit("le"), F.lit("on")))
    return docs.select("accession", F.md5(T.anonymize(F.col("text"), targets)).alias("text_md5"))


Q["anonymized_text"] = anonymized_text


def _redact(c: str, target: str, mark: str) -> str:
    one = lambda x: f"regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_]){target}([^\\p{{L}}\\p{{N}}\\p{{M}}_]|$)', '\\1{mark}\\2', 'g')"
    return one(one(c))


_HIDDEN = "text"
for _target, _mark in (("of", "[COMPANY]"), ("the", "[TICKER]"), ("le", "[TICKER1]"), ("on", "[TICKER2]")):
    _HIDDEN = _redact(_HIDDEN, _target, _mark)
SQL["anonymized_text"] = oracle(f"SELECT accession, md5({_HIDDEN}) AS text_md5 FROM {{v_filings}}")


def red_flag_excerpts(spark, sf_dir):
    rows = EV.excerpt_rows(view(spark, sf_dir, "v_filings"))
    return rows.withColumn("char_start", F.col("char_start").cast("long"))


Q["red_flag_excerpts"] = red_flag_excerpts

# ------------------------------------------------------------------ findings
VIEWS["v_findings"] = """
SELECT entity_id, doc_id AS finding_ordinal, CASE doc_id % 3 WHEN 0 THEN 'dilution' WHEN 1 THEN 'going_concern' ELSE 'auditor' END AS category,
  ' claim ' || CAST(doc_id AS STRING) || ' ' AS claim,
  CASE doc_id % 8 WHEN 1 THEN substr(text, 21, 60) || ' zzz qqq www' WHEN 3 THEN ' ' || substr(text, 1, 7) || ' ' WHEN 4 THEN lower(replace(substr(text, 21, 60), ' ', '  '))
    WHEN 5 THEN 'invented words that no filing holds' WHEN 7 THEN replace(substr(text, 21, 60), ' ', ' - ') ELSE substr(text, 21, 60) END AS quoted_span,
  CASE doc_id % 8 WHEN 2 THEN 'Z' || accession WHEN 6 THEN 'A' || CAST(doc_id + 1 AS STRING) ELSE accession END AS source_accession,
  CASE doc_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity
FROM {v_filings}
"""
VIEWS["v_skeptic"] = """
SELECT DISTINCT entity_id, CAST(entity_id AS BIGINT) % 9 = 4 AS disqualifying, 'doubt about ' || entity_id AS reasoning FROM {v_filings}
"""
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_FOLD = lambda c: f"replace(lower(trim(regexp_replace({c}, '{_SPACES}', ' ', 'g'))), 'ß', 'ss')"
_TOK = lambda c: f"regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]+')"
_OVERLAP = f"len(list_filter({_TOK('replace(lower(q), $$ß$$, $$ss$$)')}, lambda x: list_contains(list_distinct({_TOK('ft')}), x))) / nullif(len({_TOK('lower(q)')}), 0) >= 0.9"


def _verified_sql() -> str:
    return f"""
SELECT entity_id, finding_ordinal, category, claim, quoted_span, source_accession, severity,
  coalesce(length(q) >= 12 AND m IS NOT NULL, false) AS verified,
  CASE WHEN length(q) < 12 THEN 'quote too short to verify (' || length(q) || ' chars)'
    WHEN text IS NULL AND elsewhere THEN 'quote found but attributed to wrong/absent accession ''' || source_accession || ''''
    WHEN text IS NULL THEN 'cited accession ''' || source_accession || ''' not in evidence pack' ELSE coalesce(m, 'quote not found in cited filing') END AS reason
FROM (SELECT *, CASE WHEN text IS NULL OR length(q) < 12 THEN NULL WHEN contains(text, q) THEN 'exact match' WHEN contains(ft, {_FOLD('q')}) THEN 'match after whitespace normalisation'
        WHEN {_OVERLAP} THEN 'high token-overlap match' END AS m
      FROM (SELECT f.*, regexp_replace(f.quoted_span, '^{_SPACES}|{_SPACES}$', '', 'g') AS q, p.text, {_FOLD('p.text')} AS ft,
              EXISTS (SELECT 1 FROM v_filings o WHERE o.entity_id = f.entity_id AND contains({_FOLD('o.text')}, {_FOLD('f.quoted_span')})) AS elsewhere
            FROM v_findings f LEFT JOIN v_filings p ON p.entity_id = f.entity_id AND p.accession = f.source_accession) a) b
"""


_VERIFIED_CTES = oracle("SELECT * FROM {v_findings} JOIN {v_filings} ON true JOIN {v_skeptic} ON true").rsplit("\nSELECT * FROM v_findings JOIN", 1)[0]
_V = _VERIFIED_CTES + f",\no_verified AS ({_verified_sql()})\n"


def _verified(spark, sf_dir):
    return EV.verify_findings(view(spark, sf_dir, "v_findings"), view(spark, sf_dir, "v_filings"))


Q["verify_findings"] = _verified
SQL["verify_findings"] = _V + "SELECT * FROM o_verified"


def fabrication_rate(spark, sf_dir):
    return EV.fabrication_rates(_verified(spark, sf_dir)).withColumn("rate", r6("rate"))


Q["fabrication_rate"] = fabrication_rate
SQL["fabrication_rate"] = _V + """
SELECT entity_id, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS dropped, round(avg(CASE WHEN verified THEN 0.0::DOUBLE ELSE 1 END), 6) + 0.0 AS rate,
  CASE WHEN avg(CASE WHEN verified THEN 0.0::DOUBLE ELSE 1 END) > 0.3 THEN 'high citation-failure rate (' || printf('%.0f', avg(CASE WHEN verified THEN 0.0::DOUBLE ELSE 1 END) * 100) || '%): the extractor invented quotes for this candidate -- treat its findings with extra caution' END AS warning
FROM o_verified GROUP BY entity_id
"""


def veto_decision(spark, sf_dir):
    return EV.veto_decisions(_verified(spark, sf_dir), view(spark, sf_dir, "v_skeptic"))


Q["veto_decision"] = veto_decision
SQL["veto_decision"] = _V + """
SELECT s.entity_id, CASE WHEN c > 0 OR disqualifying THEN 'veto' ELSE 'no_veto' END AS verdict, coalesce(c, 0) AS critical_findings, disqualifying
FROM v_skeptic s LEFT JOIN (SELECT entity_id, count(*) FILTER (verified AND severity = 'critical') AS c FROM o_verified GROUP BY entity_id) v ON v.entity_id = s.entity_id
"""


def veto_reasons(spark, sf_dir):
    return EV.veto_reasons(_verified(spark, sf_dir), view(spark, sf_dir, "v_skeptic"))


Q["veto_reasons"] = veto_reasons
SQL["veto_reasons"] = _V + """
SELECT entity_id, 0 AS part, finding_ordinal AS position, trim(claim) AS reason FROM o_verified WHERE verified AND severity = 'critical'
UNION ALL SELECT entity_id, 1, 0, reasoning FROM v_skeptic WHERE disqualifying
"""


def finding_lines(spark, sf_dir):
    lines = EV.finding_lines(_verified(spark, sf_dir))
    return lines.select("entity_id", "finding_ordinal", "debate_line", "memo_line")


Q["finding_lines"] = finding_lines
SQL["finding_lines"] = _V + """
SELECT entity_id, finding_ordinal, '[' || category || ' / ' || severity || '] ' || claim || chr(10) || '     quote (' || source_accession || '): "' || quoted_span || '"' AS debate_line,
  '- [' || severity || '] ' || category || ': ' || claim AS memo_line FROM o_verified WHERE verified
"""

# ------------------------------------------------------------------ brief sources
VIEWS["v_run_pages"] = """
SELECT CAST(page_id AS STRING) AS run_id, page_id, CASE WHEN page_id % 5 = 0 THEN 'A' || CAST(page_id AS STRING) ELSE url END AS source, html AS text FROM {pages}
"""
VIEWS["v_run_filings"] = "SELECT CAST(doc_id AS STRING) AS run_id, doc_id, accession AS source, text FROM {v_filings}"
VIEWS["o_sources"] = """
SELECT run_id, source, text, 1 AS priority FROM {v_run_pages}
UNION ALL SELECT run_id, source, text, 0 FROM {v_run_filings} f WHERE NOT EXISTS (SELECT 1 FROM {v_run_pages} p WHERE p.run_id = f.run_id AND p.source = f.source)
"""


def _sources(spark, sf_dir):
    return EV.union_sources(view(spark, sf_dir, "v_run_filings"), view(spark, sf_dir, "v_run_pages"))


Q["evidence_catalog"] = lambda spark, sf_dir: EV.evidence_catalog(_sources(spark, sf_dir))
SQL["evidence_catalog"] = oracle("""
SELECT run_id, source, '- ' || source || ': ' || CASE priority WHEN 0 THEN 'SEC filing' ELSE 'web page' END || ' (' || format('{:,}', length(text)) || ' chars)' AS line FROM {o_sources}
""")


VIEWS["v_brief_findings"] = """
SELECT run_id, page_id AS finding_ordinal, CASE page_id % 4 WHEN 0 THEN substr(text, 31, 40) WHEN 1 THEN 'made up quote of a page' WHEN 2 THEN 'short' ELSE substr(text, 31, 40) END AS quoted_span,
  CASE WHEN page_id % 4 = 3 THEN 'elsewhere' ELSE source END AS source FROM {v_run_pages}
"""


def brief_findings(spark, sf_dir):
    return EV.verify_brief_findings(view(spark, sf_dir, "v_brief_findings"), _sources(spark, sf_dir))


Q["brief_findings"] = brief_findings
SQL["brief_findings"] = oracle("""
SELECT run_id, finding_ordinal, quoted_span, source, finding_ordinal % 4 IN (0, 3) AS verified, CASE WHEN finding_ordinal % 4 NOT IN (0, 3) THEN 'quote not found in any fetched source' END AS reason FROM {v_brief_findings}
""")


def observations(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", F.md5(T.observation(F.col("text"))).alias("shown_md5"))


Q["observations"] = observations
SQL["observations"] = """
SELECT doc_id, md5(CASE WHEN length(text) <= 6000 THEN text ELSE substr(text, 1, 6000) || chr(10) || '… [truncated ' || (length(text) - 6000) || ' chars]' END) AS shown_md5 FROM documents
"""


def prompt_rows(spark, sf_dir):
    prompts = EV.prompt_rows(report(spark, sf_dir), _pack(spark, sf_dir))
    return prompts.select("entity_id", F.length("prompt").cast("long").alias("chars"), F.md5("prompt").alias("prompt_md5"))


Q["prompt_rows"] = prompt_rows


def metric_blocks(spark, sf_dir):
    return EV.metrics_block(report(spark, sf_dir))


Q["metric_blocks"] = metric_blocks
SQL["metric_blocks"] = oracle("""
WITH g AS (SELECT entity_id, '  ' || metric || ' = ' || CASE WHEN value = CAST('Infinity' AS DOUBLE) THEN 'inf' ELSE printf('%.4g', value) END || ' [' || basis || ']' AS line,
  list_position(['gp_to_assets','accruals','roic','altman_z','cash_runway_months','ncav','ev_ebit','ev_sales','earnings_yield','price_to_book','net_cash_to_mcap','fcf_yield','ncav_to_mcap','is_net_net','piotroski_f','beneish_m','share_issuance'], metric) AS n
  FROM {o_metrics} WHERE ok)
SELECT l.entity_id, 'Period: ' || period_end || ' (' || fiscal_period || '), currency ' || currency || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY n) FROM g WHERE g.entity_id = l.entity_id) AS metrics_block
FROM {o_latest} l
""")

# ------------------------------------------------------------------ SQL of the excerpts
_LEN = "CAST(coalesce(list_sum(list_transform({0}, lambda z: length(z))), 0) AS BIGINT)"


def _category_sql(position: int, category: str, pattern: str, source: str) -> str:
    p = "(?i)" + pattern.replace("'", "''")
    return f"""SELECT entity_id, accession, text, {position} AS c, '{category}' AS category,
  regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS pieces FROM {source} WHERE regexp_matches(text, '{p}')"""


def _excerpts_sql(source: str) -> str:
    from tallystone.vocabulary import RED_FLAG_PATTERNS

    found = " UNION ALL ".join(_category_sql(i, c, p, source) for i, (c, p) in enumerate(RED_FLAG_PATTERNS))
    before = _LEN.format("pieces[1:i]") + " + " + _LEN.format("hits[1:i - 1]")
    return f"""
SELECT entity_id, accession, c, category, s AS char_start, regexp_replace(substr(text, CAST(s + 1 AS INT), CAST(e - s AS INT)), '^{_SPACES}|{_SPACES}$', '', 'g') AS text FROM (
  SELECT *, v // 1073741824 AS s, v % 1073741824 AS e FROM (
    SELECT *, unnest(list_reduce(list_transform(codes, lambda y: [y]), lambda acc, x: CASE WHEN len(acc) < 4 AND len(list_filter(acc, lambda a: abs(a // 1073741824 - x[1] // 1073741824) < 900)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS v FROM (
      SELECT *, list_transform(range(1, len(hits) + 1), lambda i: greatest({before} - 250, 0) * 1073741824 + least(length(text), {before} + length(hits[i]) + 500)) AS codes FROM ({found}) f) g) h) k
"""


def _numbered(source: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY accession ORDER BY c, char_start) - 1 AS n FROM ({_excerpts_sql(source)}) x"


_FILINGS_CTES = oracle("SELECT * FROM {v_filings}").rsplit("SELECT *", 1)[0]
SQL["red_flag_excerpts"] = _FILINGS_CTES + f"SELECT entity_id, accession, CAST(n AS INT) AS n, category, char_start, text FROM ({_numbered('v_filings')}) y"

_ALL_CTES = oracle("SELECT * FROM {o_metrics} JOIN {o_latest} ON true JOIN {o_pack} ON true").rsplit("\nSELECT * FROM o_metrics", 1)[0]
_BLOCKS = SQL["metric_blocks"][SQL["metric_blocks"].rindex("g AS (SELECT entity_id, '  '"):]
_LABEL = EV.EVIDENCE_LABEL.replace("\n", "' || chr(10) || '")
SQL["prompt_rows"] = _ALL_CTES + f""",
o_blocks AS (WITH {_BLOCKS}),
o_excerpts AS ({_numbered('o_pack')}),
o_bodies AS (SELECT entity_id, place, '=== FILING ' || accession || ' ===' || chr(10) || CASE WHEN length(text) <= 12000 THEN text
   ELSE coalesce((SELECT string_agg('[excerpt: ' || category || ']' || chr(10) || e.text, chr(10) || chr(10) ORDER BY n) FROM o_excerpts e WHERE e.accession = p.accession),
     '[text truncated for length]' || chr(10) || substr(text, 1, 12000)) END AS body FROM o_pack p),
o_prompts AS (SELECT b.entity_id, '{EV.METRICS_LABEL}' || chr(10) || metrics_block || chr(10) || chr(10) || '{_LABEL}' || chr(10) || chr(10)
  || coalesce((SELECT string_agg(body, chr(10) || chr(10) ORDER BY place) FROM o_bodies f WHERE f.entity_id = b.entity_id), '{EV.NO_EVIDENCE}') AS prompt FROM o_blocks b)
SELECT entity_id, length(prompt) AS chars, md5(prompt) AS prompt_md5 FROM o_prompts
"""
