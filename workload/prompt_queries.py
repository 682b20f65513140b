"""Prompt bodies of the debate and memo stages, and investigation briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import evidence as EV
from tallystone.operators import prompts as P
from tallystone.operators import reports as RP
from tallystone.operators.ranking import with_rank
from tallystone.session import materialize
from workload.call_queries import _REASONS, _rows
from workload.screen_queries import report
from workload.text_queries import _V, _numbered, _sources, _verified, red_flag_excerpts, SQL as TEXT_SQL
from workload.views import VIEWS, oracle, view

Q: dict = {}
SQL: dict[str, str] = {}

def _parts(spark, sf_dir):
    return EV.metrics_block(report(spark, sf_dir)), _verified(spark, sf_dir)


def _out(lines):
    return lines.select("entity_id", "section", "part", "position", F.col("line_no").cast("long").alias("line_no"), "line")


def _evidence(spark, sf_dir):
    """Blocks, findings and, as passages, the excerpts of all filings by accession and place."""
    blocks, verified = _parts(spark, sf_dir)
    found = materialize(red_flag_excerpts(spark, sf_dir), "excerpts")
    passages = with_rank(found, ["entity_id"], [F.col("accession"), F.col("n")], "position")
    return materialize(blocks, "blocks"), verified, passages


def analyst_prompts(spark, sf_dir):
    return _out(P.analyst_lines(*_evidence(spark, sf_dir)))


def skeptic_prompts(spark, sf_dir):
    return _out(P.skeptic_lines(*_evidence(spark, sf_dir), view(spark, sf_dir, "v_points")))


def memo_prompts(spark, sf_dir):
    blocks, verified = _parts(spark, sf_dir)
    skeptic = view(spark, sf_dir, "v_skeptic")
    verdicts = EV.veto_decisions(verified, skeptic).select("entity_id", "verdict")
    return _out(P.memo_lines(
        blocks, verified, view(spark, sf_dir, "v_points"), skeptic, view(spark, sf_dir, "v_refuted"), verdicts,
        EV.veto_reasons(verified, skeptic),
    ))


Q["analyst_prompts"] = analyst_prompts
Q["skeptic_prompts"] = skeptic_prompts
Q["memo_prompts"] = memo_prompts

# The views of both sides, then the template section by section.
_ALL = oracle(
    "SELECT * FROM {o_metrics} JOIN {o_latest} ON true JOIN {v_findings} ON true JOIN {v_filings} ON true JOIN {v_points} ON true JOIN {v_skeptic} ON true JOIN {v_refuted} ON true"
).rsplit("\nSELECT * FROM o_metrics", 1)[0]
_BLOCKS = TEXT_SQL["metric_blocks"][TEXT_SQL["metric_blocks"].rindex("g AS (SELECT entity_id, '  '"):]
_HEAD = _ALL + ",\no_verified AS (" + _V.split("o_verified AS (", 1)[1] + f""",
o_blocks AS (WITH {_BLOCKS}),
o_kept AS (SELECT v.*, row_number() OVER (PARTITION BY v.entity_id ORDER BY finding_ordinal) AS i FROM o_verified v JOIN o_blocks USING (entity_id) WHERE verified),
o_passages AS (SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY accession, n) AS position, accession, category, text FROM ({_numbered('v_filings')}) p JOIN o_blocks USING (entity_id)),
o_points AS (SELECT p.* FROM v_points p JOIN o_blocks USING (entity_id)),
o_skeptic AS (SELECT s.* FROM v_skeptic s JOIN o_blocks USING (entity_id)),
o_refuted AS (SELECT r.* FROM v_refuted r JOIN o_blocks USING (entity_id)),
o_reasons AS (SELECT r.* FROM ({_REASONS}) r JOIN o_blocks USING (entity_id))
SELECT entity_id, section, part, position, line_no, line FROM (
"""
_TAIL = ") t WHERE line IS NOT NULL"
_WITH = "SELECT DISTINCT entity_id FROM {0}"
_WITHOUT = "SELECT entity_id FROM o_blocks WHERE entity_id NOT IN (SELECT entity_id FROM {0})"
_ANALYST = (
    _rows("SELECT * FROM o_blocks", 0, "0", "0",
          "'This evidence is ANONYMISED: [COMPANY] and [TICKER] tokens are redactions standing in for the real company name and tickers, removed on purpose.'", "''",
          "'COMPUTED METRICS (authoritative — use these numbers exactly, do not recompute):'", "metrics_block", "''"),
    _rows(_WITH.format("o_kept"), 1, "0", "0", "'VERIFIED FINDINGS (each quote is confirmed present in the cited filing):'"),
    _rows(_WITHOUT.format("o_kept"), 1, "0", "0", "'VERIFIED FINDINGS: none. The citation-checked extraction surfaced no red flags in the available filings.'"),
    _rows("SELECT * FROM o_kept", 1, "1", "i", "'  ' || i || '. [' || category || ' / ' || severity || '] ' || claim", "'     quote (' || source_accession || '): \"' || quoted_span || '\"'"),
    _rows(_WITH.format("o_passages"), 2, "0", "0", "''", "'EVIDENCE EXCERPTS (anonymised passages retrieved from the filings):'"),
    _rows("SELECT * FROM o_passages", 2, "1", "position", "'  [' || accession || ' / ' || category || '] ' || text"),
)
_SKEPTIC = _ANALYST + (
    _rows("SELECT * FROM o_blocks", 3, "0", "0", "''", "'BULL CASE TO REVIEW (the points you must try to refute):'"),
    _rows("SELECT * FROM o_points WHERE stance = 'bull'", 3, "1", "position", "'  ' || (position + 1) || '. ' || point"),
)
_MEMO = (
    _rows("SELECT * FROM o_blocks", 0, "0", "0", "'METRICS (authoritative, code-computed -- quote these, invent nothing):'", "metrics_block", "''", "'VERIFIED FINDINGS (each citation already confirmed against the filing):'"),
    _rows(_WITHOUT.format("o_kept"), 1, "0", "0", "'None verified.'"),
    _rows("SELECT * FROM o_kept", 1, "1", "finding_ordinal", "'- [' || severity || '] ' || category || ': ' || claim"),
    _rows("SELECT * FROM o_blocks", 2, "0", "0", "''", "'BULL CASE:'"),
    _rows("SELECT * FROM o_points", 2, "CASE stance WHEN 'bull' THEN 1 ELSE 3 END", "position", "'- ' || point"),
    _rows("SELECT * FROM o_blocks", 2, "2", "0", "''", "'BEAR CASE:'"),
    _rows("SELECT * FROM o_blocks", 3, "0", "0", "''", "'SKEPTIC:'"),
    _rows("SELECT * FROM o_skeptic", 3, "1", "0", "'Disqualifying: ' || CASE WHEN disqualifying THEN 'True' ELSE 'False' END", "'Reasoning: ' || reasoning"),
    _rows(_WITH.format("o_refuted"), 3, "2", "0", "'Refuted claims:'"),
    _rows("SELECT * FROM o_refuted", 3, "3", "position", "'- ' || text"),
    _rows("SELECT s.entity_id, s.disqualifying OR EXISTS (SELECT 1 FROM o_verified v WHERE v.entity_id = s.entity_id AND verified AND severity = 'critical') AS veto FROM o_skeptic s", 4, "0", "0",
          "''", "'DECIDED VERDICT (authoritative, do not change): ' || CASE WHEN veto THEN 'veto' ELSE 'no_veto' END"),
    _rows(_WITH.format("o_reasons"), 4, "1", "0", "'Veto reasons:'"),
    _rows(_WITHOUT.format("o_reasons"), 4, "1", "0", "'Veto reasons: none'"),
    _rows("SELECT * FROM o_reasons", 4, "part + 1", "p", "'- ' || reason"),
)
for _name, _template in (("analyst_prompts", _ANALYST), ("skeptic_prompts", _SKEPTIC), ("memo_prompts", _MEMO)):
    SQL[_name] = _HEAD + " UNION ALL ".join(_template) + _TAIL

# ------------------------------------------------------------------ investigation briefs
VIEWS["v_briefs"] = """
SELECT run_id, 'Subject ' || run_id AS subject, CASE WHEN page_id % 3 <> 0 THEN 'E' || run_id END AS entity_id, CASE WHEN page_id % 6 = 1 THEN 'veto' ELSE 'no_veto' END AS verdict, 'm-1' AS model,
  'Headline ' || run_id AS headline, 'Thesis ' || run_id AS thesis, 'Look at ' || run_id AS recommendation, CASE WHEN page_id % 5 = 2 THEN 'Period: ' || run_id ELSE '' END AS metrics_block, page_id
FROM {v_run_pages}
"""
VIEWS["v_brief_reasons"] = "SELECT run_id, CAST(0 AS BIGINT) AS position, 'reason ' || run_id AS reason FROM {v_briefs} WHERE verdict = 'veto'"
VIEWS["v_brief_warnings"] = "SELECT run_id, CAST(0 AS BIGINT) AS position, 'warning ' || run_id AS text FROM {v_briefs} WHERE page_id % 7 = 3"
VIEWS["v_brief_steps"] = """
SELECT CAST(conv_id AS STRING) AS run_id, CAST(turn AS BIGINT) + 1 AS position, role AS tool, 'in' AS tool_input, 'thought ' || CAST(turn AS STRING) AS thought, turn % 3 <> 1 AS ok FROM {conversations} WHERE conv_id % 6 <> 2
"""
VIEWS["o_brief_findings"] = """
SELECT run_id, finding_ordinal, 'claim ' || run_id AS claim, quoted_span, source, finding_ordinal % 2 = 0 AS is_red_flag, finding_ordinal % 4 IN (0, 3) AS verified, 'quote not found in any fetched source' AS reason FROM {v_brief_findings}
"""


def _brief(spark, sf_dir):
    findings = EV.verify_brief_findings(view(spark, sf_dir, "v_brief_findings"), _sources(spark, sf_dir))
    findings = findings.withColumns({"claim": F.concat(F.lit("claim "), "run_id"), "is_red_flag": F.col("finding_ordinal") % 2 == 0})
    briefs = view(spark, sf_dir, "v_briefs").drop("page_id")
    steps = view(spark, sf_dir, "v_brief_steps").join(briefs.select("run_id"), "run_id", "left_semi")
    return briefs, findings, steps, view(spark, sf_dir, "v_brief_warnings"), view(spark, sf_dir, "v_brief_reasons"), "2026-07-01T10:00:00+00:00"


def brief_markdown(spark, sf_dir):
    lines = RP.brief_lines(*_brief(spark, sf_dir))
    return lines.select("run_id", "section", "part", "position", F.col("line_no").cast("long").alias("line_no"), "line")


def brief_json(spark, sf_dir):
    """The documents, read back into their counts and a few fields."""
    docs = RP.brief_json(*_brief(spark, sf_dir)).select("run_id", F.from_json(
        "value", "struct<entity_id:string,vetoed:boolean,generated:string,veto_reasons:array<string>,verified_findings:array<struct<claim:string,is_red_flag:boolean>>,"
        "dropped_findings:array<struct<finding:struct<claim:string>,reason:string>>,steps:array<struct<tool:string,thought:string,ok:boolean>>,warnings:array<string>>").alias("d"))
    size = lambda c: F.size(f"d.{c}").cast("long").alias(c)
    return docs.select(
        "run_id", "d.entity_id", "d.vetoed", "d.generated", size("veto_reasons"), size("verified_findings"), size("dropped_findings"), size("steps"), size("warnings"),
        F.get("d.verified_findings", 0)["claim"].alias("claim"), F.get("d.dropped_findings", 0)["reason"].alias("reason"),
        F.array_join(F.transform("d.steps", lambda s: s["thought"]), "|").alias("thoughts"),
    )


Q["brief_markdown"] = brief_markdown
Q["brief_json"] = brief_json


def _brief_rows(source, *rest):
    return _rows(source, *rest).replace("SELECT entity_id,", "SELECT run_id,", 1)


_OWN_STEPS = "SELECT s.* FROM v_brief_steps s JOIN v_briefs USING (run_id)"
_POOR = "SELECT run_id FROM v_briefs WHERE run_id IN (SELECT run_id FROM o_brief_findings WHERE NOT verified) OR run_id IN (SELECT run_id FROM v_brief_warnings)"
_BRIEF_CTES = oracle("SELECT * FROM {v_briefs} JOIN {v_brief_reasons} ON true JOIN {v_brief_warnings} ON true JOIN {v_brief_steps} ON true JOIN {o_brief_findings} ON true").rsplit("\nSELECT * FROM v_briefs JOIN", 1)[0]
SQL["brief_markdown"] = _BRIEF_CTES + "\nSELECT run_id, section, part, position, line_no, line FROM (" + " UNION ALL ".join((
    _brief_rows("SELECT * FROM v_briefs", 0, "0", "0", "'# ' || subject", "''", "CASE WHEN entity_id IS NOT NULL THEN '**Entity:** `' || entity_id || '`  ' END", "'**Verdict:** ' || CASE verdict WHEN 'veto' THEN '🚫 VETO' ELSE '✅ no veto' END || '  '",
                "'**Model:** m-1  '", "'**Generated:** 2026-07-01T10:00:00+00:00  '", "'**Run:** `' || run_id || '`'", "''",
                "'> *Not investment advice. The agent may surface a candidate; the veto is decided in code and every number is code-computed.*'", "''",
                "'## Headline'", "''", "headline", "''", "'## Thesis'", "''", "thesis", "''", "'## Recommendation'", "''", "recommendation", "''"),
    _brief_rows("SELECT * FROM v_briefs WHERE verdict = 'veto'", 1, "0", "0", "'## Veto reasons (code-decided)'", "''"),
    _brief_rows("SELECT * FROM v_brief_reasons", 1, "1", "position", "'- ❌ ' || reason"),
    _brief_rows("SELECT * FROM v_briefs WHERE verdict = 'veto'", 1, "2", "0", "''"),
    _brief_rows("SELECT b.run_id, count(f.claim) AS n FROM v_briefs b LEFT JOIN (SELECT * FROM o_brief_findings WHERE verified) f USING (run_id) GROUP BY b.run_id", 2, "0", "0", "'## Findings (' || n || ' verified)'", "''",
                "CASE WHEN n = 0 THEN '_No finding survived citation verification._' END", "CASE WHEN n = 0 THEN '' END"),
    _brief_rows("SELECT * FROM o_brief_findings WHERE verified", 2, "1", "finding_ordinal", "'### ' || CASE WHEN is_red_flag THEN '🚩 ' ELSE '' END || claim", "''", "'> ' || quoted_span", "'>'", "'> — source `' || source || '`'", "''"),
    _brief_rows("SELECT * FROM v_briefs WHERE metrics_block <> ''", 3, "0", "0", "'## Code-computed metrics'", "''", "'```'", "metrics_block", "'```'", "''"),
    _brief_rows("SELECT * FROM v_briefs", 4, "0", "0", "'## What the agent did'", "''"),
    _brief_rows(_OWN_STEPS, 4, "1", "position", "position || '. **' || tool || '**' || CASE WHEN ok THEN '' ELSE ' (failed)' END || ' — ' || thought"),
    _brief_rows("SELECT * FROM v_briefs WHERE run_id NOT IN (SELECT run_id FROM v_brief_steps)", 4, "2", "0", "'_No tools were called._'"),
    _brief_rows("SELECT * FROM v_briefs", 4, "3", "0", "''"),
    _brief_rows(_POOR, 5, "0", "0", "'## Data quality'", "''"),
    _brief_rows("SELECT * FROM o_brief_findings WHERE NOT verified", 5, "1", "finding_ordinal", "'- dropped: \"' || claim || '\" — ' || reason"),
    _brief_rows("SELECT * FROM v_brief_warnings", 5, "2", "position", "'- ' || text"),
    _brief_rows(_POOR, 5, "3", "0", "''"),
)) + ") t WHERE line IS NOT NULL"
SQL["brief_json"] = _BRIEF_CTES + """
SELECT b.run_id, entity_id, verdict = 'veto' AS vetoed, '2026-07-01T10:00:00+00:00' AS generated,
  (SELECT count(*) FROM v_brief_reasons r WHERE r.run_id = b.run_id) AS veto_reasons, (SELECT count(*) FROM o_brief_findings f WHERE f.run_id = b.run_id AND verified) AS verified_findings,
  (SELECT count(*) FROM o_brief_findings f WHERE f.run_id = b.run_id AND NOT verified) AS dropped_findings, (SELECT count(*) FROM v_brief_steps s WHERE s.run_id = b.run_id) AS steps,
  (SELECT count(*) FROM v_brief_warnings w WHERE w.run_id = b.run_id) AS warnings,
  (SELECT min(claim) FROM o_brief_findings f WHERE f.run_id = b.run_id AND verified) AS claim, (SELECT min(reason) FROM o_brief_findings f WHERE f.run_id = b.run_id AND NOT verified) AS reason,
  coalesce((SELECT string_agg(thought, '|' ORDER BY position) FROM v_brief_steps s WHERE s.run_id = b.run_id), '') AS thoughts
FROM v_briefs b
"""
