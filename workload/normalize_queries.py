"""Queries over raw facts: identity, resolution, ambiguity, fallbacks, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.operators import normalize as NZ
from workload.views import VIEWS, oracle, view

Q: dict = {}
SQL: dict[str, str] = {}


def _inputs(spark, sf_dir):
    return view(spark, sf_dir, "v_raw_facts"), view(spark, sf_dir, "v_filing_headers")


_MAP = ", ".join(
    f"('{tag}', '{V.PERIOD_TYPE_OF[c]}', '{c}', {pos}, {pri}, '{V.TAGS[c][0]}')"
    for pos, c in enumerate(V.CONCEPT_NAMES)
    for pri, tag in enumerate(V.TAGS[c])
)
VIEWS["o_map"] = (
    f"SELECT * FROM (VALUES {_MAP}) t(tag, period_type, concept, position, priority, primary_tag)"
)
VIEWS["o_dated"] = """
SELECT f.*, h.period_of_report FROM {v_raw_facts} f JOIN {v_filing_headers} h ON f.accession = h.accession
WHERE period_of_report IS NOT NULL
"""


def _vote(field: str, expr: str) -> str:
    return f"""SELECT accession, '{field}' AS field, CAST({expr} AS VARCHAR) AS choice, count(*) AS n, min(fact_ordinal) AS first_seen
FROM {{o_dated}} WHERE period_end = period_of_report AND {expr} IS NOT NULL GROUP BY accession, {expr}"""


VIEWS["o_votes"] = " UNION ALL ".join(
    (_vote("fiscal_period", "fiscal_period"), _vote("fiscal_year", "fiscal_year"), _vote("currency", "unit_ccy"))
).replace("{o_dated}", f"(SELECT *, CASE WHEN length(unit) = 3 THEN unit END AS unit_ccy FROM {{o_dated}}) d")
VIEWS["o_identity"] = """
SELECT d.accession, d.period_of_report,
       coalesce(max(v.choice) FILTER (field = 'fiscal_period'), CASE WHEN bool_or(d.annual) THEN 'FY' END) AS fiscal_period,
       coalesce(CAST(max(v.choice) FILTER (field = 'fiscal_year') AS INT), CAST(year(d.period_of_report) AS INT)) AS fiscal_year,
       max(v.choice) FILTER (field = 'currency') AS currency
FROM (SELECT accession, period_of_report,
             bool_or(period_end = period_of_report AND period_end - period_start BETWEEN 350 AND 380) AS annual
      FROM {o_dated} GROUP BY ALL) d
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY accession, field ORDER BY n DESC, first_seen) AS rn FROM {o_votes}) t WHERE rn = 1) v
  ON v.accession = d.accession
GROUP BY d.accession, d.period_of_report
"""
_TARGET = "CASE i.fiscal_period " + " ".join(f"WHEN '{k}' THEN {d}" for k, d in V.SPAN_TARGET_DAYS.items()) + " END"
VIEWS["o_found"] = f"""
SELECT f.*, m.tag, m.concept, m.position, m.priority, m.primary_tag, i.fiscal_period AS snapshot_period, i.fiscal_year AS snapshot_year,
       {_TARGET} AS target, f.period_end - f.period_start AS span, f.period_end = f.period_of_report AS exact,
       CASE WHEN f.period_type = 'duration' THEN coalesce(abs(f.period_end - f.period_start - {_TARGET}), f.period_end - f.period_start)
            ELSE abs(f.period_end - f.period_of_report) END AS fit
FROM {{o_dated}} f JOIN {{o_map}} m ON m.tag = f.taxonomy || ':' || f.local_name AND m.period_type = f.period_type
JOIN {{o_identity}} i ON i.accession = f.accession
WHERE NOT is_dimensioned AND CASE WHEN f.period_type = 'duration' THEN f.period_end = f.period_of_report AND period_start IS NOT NULL
      ELSE f.period_end = f.period_of_report OR concept = 'shares_outstanding' END
"""
VIEWS["o_chosen"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY accession, concept ORDER BY priority, exact DESC, fit, fact_ordinal) AS rn FROM {o_found}) t WHERE rn = 1
"""
VIEWS["o_ambiguous"] = """
SELECT c.accession, c.concept, c.value AS used, count(DISTINCT round_even(f.value, 4)) AS distinct_values,
       min(round_even(f.value, 4)) AS lowest
FROM {o_chosen} c JOIN {o_found} f ON f.accession = c.accession AND f.concept = c.concept AND f.priority = c.priority
 AND f.exact AND f.span IS NOT DISTINCT FROM c.span
WHERE c.exact GROUP BY ALL HAVING count(DISTINCT round_even(f.value, 4)) > 1
"""


def canonical(spark, sf_dir):
    facts, filings = _inputs(spark, sf_dir)
    _, out = NZ.normalize(facts, filings)
    return out.select(
        "entity_id", F.col("period_end").cast("string").alias("period_end"), "fiscal_period",
        "concept", "value", "currency", F.col("period_start").cast("string").alias("period_start"),
        "fiscal_year", "accession", "source_concept", "taxonomy",
    )


Q["canonical_facts"] = canonical
SQL["canonical_facts"] = oracle("""
SELECT h.entity_id, CAST(c.period_of_report AS VARCHAR) AS period_end, snapshot_period AS fiscal_period, concept, value,
       CASE WHEN length(unit) = 3 THEN unit END AS currency, CAST(period_start AS VARCHAR) AS period_start,
       snapshot_year AS fiscal_year, c.accession, tag AS source_concept, c.taxonomy
FROM {o_chosen} c JOIN {v_filing_headers} h ON h.accession = c.accession
""")


def identity(spark, sf_dir):
    facts, filings = _inputs(spark, sf_dir)
    return NZ.period_identity(NZ.with_reporting_date(facts, filings)).withColumn(
        "period_of_report", F.col("period_of_report").cast("string")
    )


Q["period_identity"] = identity
SQL["period_identity"] = oracle(
    "SELECT accession, CAST(period_of_report AS VARCHAR) AS period_of_report, fiscal_period, fiscal_year, currency FROM {o_identity}"
)


def ambiguous_facts(spark, sf_dir):
    facts, filings = _inputs(spark, sf_dir)
    dated = NZ.with_reporting_date(facts, filings)
    found = NZ.candidates(dated, NZ.period_identity(dated))
    return NZ.ambiguities(found, NZ.resolve(found)).select(
        "accession", "concept", "distinct_values", F.element_at("smallest", 1).alias("lowest")
    )


Q["ambiguous_facts"] = ambiguous_facts
SQL["ambiguous_facts"] = oracle("SELECT accession, concept, distinct_values, lowest FROM {o_ambiguous}")


def warning_rows(spark, sf_dir):
    facts, filings = _inputs(spark, sf_dir)
    dated = NZ.with_reporting_date(facts, filings)
    resolved = NZ.resolve_with_warnings(dated, NZ.period_identity(dated))
    return resolved.select("accession", "concept", F.explode("warnings").alias("warning"))


Q["fallback_warnings"] = warning_rows
SQL["fallback_warnings"] = oracle("""
SELECT accession, concept, concept || ': closest available span is ' || span || ' days for a ' || target || '-day fiscal period -- period may not line up with peers' AS warning
FROM {o_chosen} WHERE period_type = 'duration' AND abs(span - target) > 45
UNION ALL SELECT accession, concept, 'shares_outstanding: no fact on ' || period_of_report || ', used cover-date value as of ' || period_end FROM {o_chosen} WHERE NOT exact
UNION ALL SELECT accession, concept, concept || ': resolved via fallback tag ''' || tag || ''' (primary ''' || primary_tag || ''' absent)' FROM {o_chosen} WHERE priority > 0
UNION ALL SELECT accession, concept, concept || ': 2 differing non-dimensioned values for the same period ([' || printf('%.1f', used) || ', ' || printf('%.1f', used + 1) || ']); used ' || printf('%.1f', used) FROM {o_ambiguous}
""")


def snapshot_headers(spark, sf_dir):
    facts, filings = _inputs(spark, sf_dir)
    heads, _ = NZ.normalize(facts, filings)
    return heads.select(
        "entity_id", "accession", "entity_scheme", "entity_source", "fiscal_period", "fiscal_year",
        "currency", F.col("concepts").cast("long").alias("concepts"),
        F.size("warnings").cast("long").alias("warnings"),
    )


Q["snapshot_headers"] = snapshot_headers
SQL["snapshot_headers"] = oracle("""
SELECT h.entity_id, h.accession, CASE WHEN source = 'sec' THEN 'cik' WHEN length(h.entity_id) = 20 THEN 'lei' ELSE 'national_id' END AS entity_scheme,
       h.source AS entity_source, i.fiscal_period, i.fiscal_year, i.currency, count(*) AS concepts,
       CAST(sum(CASE WHEN c.period_type = 'duration' AND abs(span - target) > 45 THEN 1 ELSE 0 END + CASE WHEN NOT exact THEN 1 ELSE 0 END
           + CASE WHEN priority > 0 THEN 1 ELSE 0 END + CASE WHEN a.concept IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS warnings
FROM {v_filing_headers} h JOIN {o_identity} i ON i.accession = h.accession JOIN {o_chosen} c ON c.accession = h.accession
LEFT JOIN {o_ambiguous} a ON a.accession = c.accession AND a.concept = c.concept
GROUP BY ALL
""")
