"""Queries over model-call logs, research reports and the incremental jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.operators import archive as A
from tallystone.operators import calls as K
from tallystone.operators import reports as RP
from tallystone.session import fresh_path, materialize
from tallystone.streaming import jobs as J
from workload import storage_queries  # noqa: F401  its views are used below
from workload.book_queries import _picks
from workload.normalize_queries import _inputs
from workload.screen_queries import r6
from workload.text_queries import _V, _verified
from workload.views import VIEWS, oracle, view

Q: dict = {}
SQL: dict[str, str] = {}

VIEWS["v_calls"] = """
SELECT conv_id * 1000 + turn AS call_id, conv_id, turn, role, text,
  CASE turn % 4 WHEN 0 THEN 'extract' WHEN 1 THEN 'debate' WHEN 2 THEN 'memo' END AS stage,
  CASE conv_id % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' ELSE 'local' END AS provider,
  CASE conv_id % 8 WHEN 0 THEN ' Anthropic/Claude-Haiku-4-5-20251001 ' WHEN 1 THEN 'gpt-5-mini-2026' WHEN 2 THEN 'gpt-5' WHEN 3 THEN 'us.anthropic.claude-opus-4-6' WHEN 4 THEN 'ollama/qwen3'
    WHEN 5 THEN 'mystery-1' WHEN 6 THEN 'openai/gpt-4o-mini' ELSE 'deepseek-v4-pro' END AS model,
  CAST(length(text) AS BIGINT) AS input_tokens, CAST(length(text) % 97 AS BIGINT) AS output_tokens, CAST(length(text) % 31 AS BIGINT) AS cached_input_tokens, CAST(length(text) % 7 AS BIGINT) AS reasoning_tokens,
  CASE conv_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'none' END AS effort, CASE conv_id % 2 WHEN 0 THEN '{"type":"object"}' END AS json_schema, CAST(1000 + turn AS INT) AS max_tokens,
  CASE conv_id % 3 WHEN 0 THEN 'text' ELSE 'json_object' END AS output_mode, CASE conv_id % 5 WHEN 0 THEN 'v2' END AS prompt_version, 'response' AS schema_name
FROM {conversations}
"""
_PREFIXES = sorted(V.MODEL_PRICES, key=lambda p: -len(p[0]))


def _price_sql(i: int) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(m, '{p[0]}') THEN {p[i]!r}::DOUBLE" for p in _PREFIXES) + " END"


VIEWS["o_priced"] = f"""
SELECT *, {_price_sql(1)} AS p_in, coalesce((input_tokens * {_price_sql(1)} + cached_input_tokens * {_price_sql(3)} + output_tokens * {_price_sql(2)}) / 1000000, 0) AS cost_usd
FROM (SELECT *, regexp_replace(lower(trim(model)), '^(anthropic/|openai/|us\\.anthropic\\.|eu\\.anthropic\\.|anthropic\\.)', '') AS m FROM {{v_calls}}) t
"""


def call_cost_by_stage(spark, sf_dir):
    costs = K.cost_by_stage(view(spark, sf_dir, "v_calls"))
    return costs.select(F.coalesce("stage", F.lit("TOTAL")).alias("stage"), "calls", *K.USAGE, r6("cost_usd").alias("cost_usd"))


Q["call_cost_by_stage"] = call_cost_by_stage
SQL["call_cost_by_stage"] = oracle("""
SELECT CASE WHEN grouping(s) = 1 THEN 'TOTAL' ELSE s END AS stage, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, round(sum(cost_usd), 6) + 0.0 AS cost_usd
FROM (SELECT *, coalesce(stage, 'unattributed') AS s FROM {o_priced}) t GROUP BY ROLLUP (s)
""")


def call_prices(spark, sf_dir):
    calls = K.priced_calls(view(spark, sf_dir, "v_calls"))
    return calls.select("call_id", K.normalize_model_id("model").alias("model_id"), "known_model", "cost_usd")


Q["call_prices"] = call_prices
SQL["call_prices"] = oracle("SELECT call_id, m AS model_id, p_in IS NOT NULL AS known_model, cost_usd FROM {o_priced}")
Q["unknown_models"] = lambda spark, sf_dir: K.unknown_models(view(spark, sf_dir, "v_calls"))
SQL["unknown_models"] = oracle("SELECT model, count(*) AS calls, 'No price for model ''' || model || '''; counted as $0.00.' AS warning FROM {o_priced} WHERE p_in IS NULL GROUP BY model")


def _fingerprinted(spark, sf_dir):
    message = F.struct(F.col("role"), F.col("text").alias("content"))
    return view(spark, sf_dir, "v_calls").withColumns(
        {"messages": F.array(message), "temperature": F.when(F.col("turn") % 2 == 0, F.lit(0.2))}
    )


def replay_hits(spark, sf_dir):
    calls = _fingerprinted(spark, sf_dir)
    records = calls.where(F.col("conv_id") % 3 != 1).select(
        K.fingerprint().alias("key"), F.col("text").alias("text"), (F.col("conv_id") % 9 != 0).alias("usable")
    ).dropDuplicates(["key"])
    return K.replay(calls, records).select("call_id", "key", "hit")


Q["replay_hits"] = replay_hits
_J = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' ELSE CAST(to_json({c}) AS VARCHAR) END"
VIEWS["o_keys"] = f"""
SELECT *, sha256('{{"effort":' || {_J('effort')} || ',"json_schema":' || coalesce(json_schema, 'null') || ',"max_tokens":' || max_tokens || ',"messages":[{{"content":' || {_J('text')} || ',"role":' || {_J('role')} || '}}],"model":' || {_J('model')}
  || ',"output_mode":' || {_J('output_mode')} || ',"prompt_version":' || {_J('prompt_version')} || ',"provider":' || {_J('provider')} || ',"schema_name":"response","temperature":' || CASE WHEN turn % 2 = 0 THEN '0.2' ELSE 'null' END || '}}') AS key
FROM {{v_calls}}
"""
SQL["replay_hits"] = oracle("""
SELECT call_id, key, EXISTS (SELECT 1 FROM {o_keys} r WHERE r.key = k.key AND r.conv_id % 3 <> 1 AND r.conv_id % 9 <> 0) AS hit FROM {o_keys} k
""")


def replay_stats(spark, sf_dir):
    calls = _fingerprinted(spark, sf_dir)
    records = calls.where(F.col("conv_id") % 3 != 1).select(K.fingerprint().alias("key"), "text", F.lit(True).alias("usable")).dropDuplicates(["key"])
    missing = K.replay_misses(calls, records).agg(F.count(F.lit(1)).alias("to_repeat"))
    stats = K.replay_stats(K.replay(calls, records)).withColumn("hit_rate", r6("hit_rate"))
    return stats.withColumn("one", F.lit(1)).join(missing.withColumn("one", F.lit(1)), "one").drop("one")


Q["replay_stats"] = replay_stats
SQL["replay_stats"] = oracle("""
SELECT count(*) FILTER (h) AS hits, count(*) FILTER (NOT h) AS misses, round(avg(CASE WHEN h THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS hit_rate, count(*) FILTER (NOT h) AS to_repeat
FROM (SELECT EXISTS (SELECT 1 FROM {o_keys} r WHERE r.key = k.key AND r.conv_id % 3 <> 1) AS h FROM {o_keys} k) t
""")

# ------------------------------------------------------------------ reasoning and JSON
VIEWS["v_messages"] = """
SELECT conv_id * 1000 + turn AS call_id, conv_id, turn,
  CASE turn % 6 WHEN 0 THEN '<think>plan ' || CAST(conv_id AS STRING) || '</think>answer' WHEN 1 THEN 'lead in</THINK> final <think>b</think>' WHEN 2 THEN 'text <Think>never closed'
    WHEN 3 THEN '<think>only thought</think>  ' WHEN 4 THEN '' ELSE '  plain answer ' || chr(10) END AS content,
  CASE WHEN conv_id % 4 = 0 THEN ' plan ' || CAST(conv_id AS STRING) || ' ' END AS reasoning_content, CASE WHEN conv_id % 4 = 1 THEN 'r1' END AS reasoning, CASE WHEN conv_id % 8 = 1 THEN 'r1' WHEN conv_id % 8 = 2 THEN 't1' END AS thinking
FROM {conversations}
"""
Q["reasoning_split"] = lambda spark, sf_dir: K.split_reasoning(view(spark, sf_dir, "v_messages").drop("conv_id", "turn"))
SQL["reasoning_split"] = oracle("""
WITH t AS (SELECT *, CASE turn % 6 WHEN 0 THEN 'answer' WHEN 1 THEN 'final' WHEN 2 THEN 'text' WHEN 3 THEN '' WHEN 4 THEN '' ELSE 'plain answer' END AS a,
  CASE turn % 6 WHEN 0 THEN ['plan ' || conv_id] WHEN 1 THEN ['lead in', 'b'] WHEN 2 THEN ['never closed'] WHEN 3 THEN ['only thought'] ELSE [] END AS inl,
  [x for x in [trim(reasoning_content), reasoning, CASE WHEN thinking = reasoning THEN NULL ELSE thinking END] if x IS NOT NULL] AS out FROM {v_messages}),
u AS (SELECT *, array_to_string(out || [x for x in inl if NOT list_contains(out, x)], chr(10) || chr(10)) AS r FROM t)
SELECT call_id, a AS content, CASE WHEN r <> '' THEN r END AS reasoning, CASE WHEN a = '' THEN CASE WHEN r <> '' THEN 'reasoning_without_answer' ELSE 'empty_response' END END AS error FROM u
""")

_FINDING = """'{"findings":[{"category":"' || CASE conv_id % 3 WHEN 0 THEN 'dilution' WHEN 1 THEN 'gossip' ELSE 'auditor' END || '","claim":" c' || CAST(turn AS STRING) || ' ","quoted_span":"' || CASE WHEN conv_id % 5 = 2 THEN '  ' ELSE 'a {quote} here' END || '","source_accession":"A1","severity":"' || CASE WHEN turn % 3 = 1 THEN 'fatal' ELSE 'high' END || '"}],"notes":""}'"""
VIEWS["v_answers"] = f"""
SELECT call_id, conv_id, turn, js, CASE turn % 6 WHEN 0 THEN js WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || js || chr(10) || '```' WHEN 2 THEN 'Here {{not json}} it is: ' || js || ' bye }}' WHEN 3 THEN '<think>hm {{"a":1}}</think> ' || js
   WHEN 4 THEN 'nothing to see' ELSE '<think>' || js END AS text
FROM (SELECT conv_id * 1000 + turn AS call_id, conv_id, turn, {_FINDING} AS js FROM {{conversations}}) t
"""
Q["response_json"] = lambda spark, sf_dir: K.extract_json(view(spark, sf_dir, "v_answers")).select("call_id", "json_text")
SQL["response_json"] = oracle("SELECT call_id, CASE WHEN turn % 6 < 4 THEN js END AS json_text FROM {v_answers}")


def response_validity(spark, sf_dir):
    answers = K.extract_json(view(spark, sf_dir, "v_answers"))
    rows = K.finding_rows(answers, ["call_id"])
    return rows.select("call_id", "category", "claim", "quoted_span", "severity", "valid")


Q["response_validity"] = response_validity
SQL["response_validity"] = oracle("""
SELECT call_id, CASE conv_id % 3 WHEN 0 THEN 'dilution' WHEN 1 THEN 'gossip' ELSE 'auditor' END AS category, 'c' || turn AS claim, CASE WHEN conv_id % 5 = 2 THEN '' ELSE 'a {quote} here' END AS quoted_span,
  CASE WHEN turn % 3 = 1 THEN 'fatal' ELSE 'high' END AS severity, conv_id % 3 <> 1 AND conv_id % 5 <> 2 AND turn % 3 <> 1 AS valid
FROM {v_answers} WHERE turn % 6 < 4
""")
VIEWS["v_views"] = """
SELECT conv_id * 1000 + turn AS call_id, conv_id, turn, '{"stance":"' || CASE turn % 3 WHEN 0 THEN 'bull' WHEN 1 THEN 'bear' ELSE 'hold' END || '","points":[' || CASE conv_id % 3 WHEN 0 THEN '" "' WHEN 1 THEN '" p1 ","","p2"' ELSE '"1","2","3","4","5","6","7","8","9"' END || ']}' AS json_text,
  '{"headline":"h","thesis":"t","verdict":"' || CASE turn % 3 WHEN 0 THEN 'veto' WHEN 1 THEN 'no_veto' ELSE 'buy' END || '","veto_reasons":[" r ","  "]}' AS memo_text
FROM {conversations}
"""


def analyst_validity(spark, sf_dir):
    answers = view(spark, sf_dir, "v_views")
    sides = K.analyst_views(answers, ["call_id"]).select("call_id", "stance", F.array_join("points", ",").alias("points"), "valid")
    memos = K.memo_rows(answers, ["call_id"], "memo_text").select("call_id", F.col("verdict").alias("stance"), F.array_join("veto_reasons", ",").alias("points"), "valid")
    return sides.unionByName(memos)


Q["analyst_validity"] = analyst_validity
SQL["analyst_validity"] = oracle("""
SELECT call_id, CASE turn % 3 WHEN 0 THEN 'bull' WHEN 1 THEN 'bear' ELSE 'hold' END AS stance, CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'p1,p2' ELSE '1,2,3,4,5,6,7,8' END AS points, turn % 3 <> 2 AND conv_id % 3 <> 0 AS valid FROM {v_views}
UNION ALL SELECT call_id, CASE turn % 3 WHEN 0 THEN 'veto' WHEN 1 THEN 'no_veto' ELSE 'buy' END, 'r', turn % 3 <> 2 FROM {v_views}
""")


# ------------------------------------------------------------------ reports
VIEWS["v_done"] = """
SELECT 'run-' || CAST(s_suppkey % 7 AS STRING) AS run_id, CAST(s_suppkey AS STRING) AS entity_id, s_name || ' & Co.' AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'veto' ELSE 'no_veto' END AS verdict, s_suppkey % 5 AS findings
FROM {supplier} WHERE s_suppkey % 3 <> 0
"""
VIEWS["v_requested"] = "SELECT 'run-' || CAST(s_suppkey % 7 AS STRING) AS run_id, CAST(s_suppkey AS STRING) AS entity_id FROM {supplier}"
VIEWS["o_entries"] = """
SELECT q.run_id, q.entity_id, d.name, d.verdict, coalesce(d.verdict = 'veto', false) AS vetoed, coalesce(d.findings, 0) AS findings,
  d.entity_id || '-' || regexp_replace(lower(replace(d.name, ' & Co.', '')), '[^a-z0-9]+', '-', 'g') || '-co.md' AS markdown, CASE WHEN d.entity_id IS NULL THEN 'skipped' ELSE 'done' END AS status
FROM {v_requested} q LEFT JOIN {v_done} d ON d.entity_id = q.entity_id
"""


def run_entries(spark, sf_dir):
    e = RP.run_entries(view(spark, sf_dir, "v_requested"), view(spark, sf_dir, "v_done"), finished=True)
    return e.drop("json")


Q["run_entries"] = run_entries
SQL["run_entries"] = oracle("SELECT * FROM {o_entries}")
Q["run_index"] = lambda spark, sf_dir: RP.run_index(RP.run_entries(view(spark, sf_dir, "v_requested"), view(spark, sf_dir, "v_done")))
SQL["run_index"] = oracle("SELECT run_id, count(*) AS requested, count(*) FILTER (status = 'done') AS researched, count(*) FILTER (vetoed) AS vetoed FROM {o_entries} GROUP BY run_id")

VIEWS["v_memos"] = """
SELECT entity_id, CASE WHEN CAST(entity_id AS BIGINT) % 2 = 0 THEN 'Company ' || entity_id END AS name, disqualifying, reasoning, 'Headline of ' || entity_id AS headline, 'Thesis of ' || entity_id AS thesis FROM {v_skeptic}
"""
VIEWS["v_points"] = """
SELECT entity_id, CASE WHEN i < 2 THEN 'bull' ELSE 'bear' END AS stance, CAST(i % 2 AS BIGINT) AS position, 'point ' || CAST(i AS STRING) AS point FROM (SELECT entity_id, SERIES(0, 3) AS i FROM {v_skeptic}) t
"""


VIEWS["v_refuted"] = """
SELECT entity_id, CAST(i AS BIGINT) AS position, 'refuted ' || CAST(i AS STRING) AS text FROM (SELECT entity_id, SERIES(0, 1) AS i FROM {v_skeptic}) t WHERE CAST(entity_id AS BIGINT) % 3 = 0
"""
VIEWS["v_warned"] = """
SELECT entity_id, CAST(0 AS BIGINT) AS position, 'warning of ' || entity_id AS text FROM {v_skeptic} WHERE CAST(entity_id AS BIGINT) % 4 = 1
"""


def report_markdown(spark, sf_dir):
    verified = _verified(spark, sf_dir)
    skeptic = view(spark, sf_dir, "v_skeptic")
    from tallystone.operators import evidence as EV

    verdicts = EV.veto_decisions(verified, skeptic).select("entity_id", "verdict")
    memos = view(spark, sf_dir, "v_memos").join(verdicts, "entity_id")
    return RP.markdown_lines(
        memos, verified, EV.veto_reasons(verified, skeptic), view(spark, sf_dir, "v_points"), view(spark, sf_dir, "v_refuted"),
        view(spark, sf_dir, "v_warned"), "run-1", "m-1", "2026-07-01T10:00:00+00:00",
    ).select("entity_id", "section", "part", "position", F.col("line_no").cast("long").alias("line_no"), "line")


Q["report_markdown"] = report_markdown
_CRIT = "EXISTS (SELECT 1 FROM o_verified v WHERE v.entity_id = m.entity_id AND verified AND severity = 'critical')"


def _rows(source: str, section: int, part: str, position: str, *lines: str) -> str:
    arr = "[" + ", ".join(lines) + "]"
    return (
        f"SELECT entity_id, {section} AS section, CAST({part} AS INT) AS part, CAST({position} AS BIGINT) AS position, "
        f"unnest(range(0, {len(lines)})) AS line_no, unnest({arr}) AS line FROM ({source}) m"
    )


# The template of a report, section by section in its order.
_MEMOS = f"SELECT m.*, m.disqualifying OR {_CRIT} AS veto FROM v_memos m"
_VETOED = f"SELECT * FROM ({_MEMOS}) z WHERE veto"
_COUNTS = "SELECT s.entity_id, coalesce(count(*) FILTER (verified), 0) AS kept, count(*) FILTER (NOT verified) AS dropped FROM v_skeptic s LEFT JOIN o_verified v ON v.entity_id = s.entity_id GROUP BY s.entity_id"
_WARNED = f"SELECT * FROM ({_COUNTS}) z WHERE dropped > 0 OR entity_id IN (SELECT entity_id FROM v_warned)"
_REASONS = "SELECT entity_id, 1 AS part, finding_ordinal AS p, trim(claim) AS reason FROM o_verified WHERE verified AND severity = 'critical' UNION ALL SELECT entity_id, 2, 0, reasoning FROM v_skeptic WHERE disqualifying"
_CTES = oracle("SELECT * FROM {v_memos} JOIN {v_points} ON true JOIN {v_findings} ON true JOIN {v_filings} ON true JOIN {v_refuted} ON true JOIN {v_warned} ON true").rsplit("\nSELECT * FROM v_memos", 1)[0]
SQL["report_markdown"] = _CTES + ",\no_verified AS (" + _V.split("o_verified AS (", 1)[1] + "SELECT entity_id, section, part, position, line_no, line FROM (" + " UNION ALL ".join((
    _rows(_MEMOS, 0, "0", "0", "'# ' || coalesce(name, entity_id)", "''", "'**Entity:** `' || entity_id || '`  '", "'**Verdict:** ' || CASE WHEN veto THEN '🚫 VETO' ELSE '✅ no veto' END || '  '",
          "'**Model:** m-1  '", "'**Generated:** 2026-07-01T10:00:00+00:00  '", "'**Run:** `run-1`'", "''",
          "'> *Not investment advice. The LLM can veto a screened candidate; it can never recommend buying one. Every number is computed in code.*'", "''",
          "'## Headline'", "''", "headline", "''", "'## Thesis'", "''", "thesis", "''"),
    _rows(_VETOED, 1, "0", "0", "'## Veto reasons'", "''"),
    _rows(_REASONS, 1, "part", "p", "'- ❌ ' || reason"),
    _rows(_VETOED, 1, "9", "0", "''"),
    _rows(_COUNTS, 2, "0", "0", "'## Cited findings (' || kept || ')'", "''", "CASE WHEN kept = 0 THEN '_None survived citation verification._' END", "CASE WHEN kept = 0 THEN '' END"),
    _rows("SELECT * FROM o_verified WHERE verified", 2, "1", "finding_ordinal", "'### [' || severity || '] ' || category", "''", "trim(claim)", "''", "'> ' || quoted_span", "'>'", "'> — filing `' || source_accession || '`'", "''"),
    _rows("SELECT * FROM v_memos", 3, "0", "0", "'## Debate'", "''", "'**Bull**'"),
    _rows("SELECT * FROM v_points", 3, "CASE stance WHEN 'bull' THEN 1 ELSE 3 END", "position", "'- ' || point"),
    _rows("SELECT * FROM v_memos", 3, "2", "0", "''", "'**Bear**'"),
    _rows("SELECT * FROM v_memos", 3, "4", "0", "''"),
    _rows("SELECT * FROM v_memos", 4, "0", "0", "'**Skeptic** — ' || CASE WHEN disqualifying THEN 'disqualifying' ELSE 'not disqualifying' END", "''", "reasoning"),
    _rows("SELECT DISTINCT entity_id FROM v_refuted", 4, "1", "0", "''", "'Refuted claims:'"),
    _rows("SELECT * FROM v_refuted", 4, "2", "position", "'- ' || text"),
    _rows("SELECT * FROM v_memos", 4, "3", "0", "''"),
    _rows(_WARNED, 5, "0", "0", "'## Data quality'", "''", "CASE WHEN dropped > 0 THEN '- ' || dropped || ' finding(s) dropped: the quote was not found in the cited filing (fabrication rate ' || printf('%.0f', dropped / (kept + dropped) * 100) || '%).' END"),
    _rows("SELECT * FROM v_warned", 5, "1", "position", "'- ' || text"),
    _rows(_WARNED, 5, "2", "0", "''"),
)) + ") t WHERE line IS NOT NULL"

VIEWS["v_tree"] = """
SELECT '2026-07-' || lpad(CAST(1 + s_suppkey % 9 AS STRING), 2, '0') AS day, CASE k WHEN 0 THEN '_run-' || CAST(s_suppkey AS STRING) || '.json' WHEN 1 THEN CAST(s_suppkey AS STRING) || '-a.json' WHEN 2 THEN CAST(s_suppkey AS STRING) || '-brief.json' ELSE CAST(s_suppkey AS STRING) || '-odd.json' END AS file,
  CASE k WHEN 0 THEN '{"run_id":"r' || CAST(s_suppkey AS STRING) || '","entries":[{"entity_id":"' || CAST(s_suppkey AS STRING) || '","json":"' || CAST(s_suppkey AS STRING) || '-a.json","status":"done"},{"entity_id":"x","json":null' || CASE WHEN s_suppkey % 2 = 0 THEN ',"status":"pending"' ELSE '' END || '}]}'
    WHEN 1 THEN '{"entity_id":"' || CAST(s_suppkey AS STRING) || '","subject":"ref"}' WHEN 2 THEN '{"subject":"Brief ' || CAST(s_suppkey AS STRING) || '"}' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'not json' ELSE '{"other":1}' END END AS value, s_suppkey AS s, k
FROM (SELECT *, SERIES(0, 3) AS k FROM {supplier}) t
"""


def report_tree(spark, sf_dir):
    entries, briefs = RP.tree_snapshot(view(spark, sf_dir, "v_tree").select("day", "file", "value"))
    e = entries.select("day", F.lit("research").alias("kind"), "entity_id", "json", "status", F.col("detail").isNotNull().alias("has_detail"))
    b = briefs.select("day", F.lit("investigate").alias("kind"), F.col("subject").alias("entity_id"), "json", F.lit(None).cast("string").alias("status"), F.lit(True).alias("has_detail"))
    return e.unionByName(b)


Q["report_tree"] = report_tree
SQL["report_tree"] = oracle("""
SELECT day, 'research' AS kind, CAST(s AS VARCHAR) AS entity_id, s || '-a.json' AS json, 'done' AS status, true AS has_detail FROM {v_tree} WHERE k = 0
UNION ALL SELECT day, 'research', 'x', NULL, CASE WHEN s % 2 = 0 THEN 'pending' ELSE 'done' END, false FROM {v_tree} WHERE k = 0
UNION ALL SELECT day, 'investigate', 'Brief ' || s, s || '-brief.json', NULL, true FROM {v_tree} WHERE k = 2
""")


def report_files(spark, sf_dir):
    """Reports written as JSON per day, then read back as a tree."""
    path = fresh_path(spark, "reports")
    done = view(spark, sf_dir, "v_done").withColumn("day", F.concat(F.lit("2026-07-0"), F.substring("run_id", 5, 1)))
    RP.write_report_json(done, path)
    rows = spark.read.text(path).select("day", F.from_json("value", "entity_id string, name string, verdict string, findings long").alias("r"))
    return rows.select(F.col("day").cast("string").alias("day"), "r.*")


Q["report_files"] = report_files
SQL["report_files"] = oracle("SELECT '2026-07-0' || right(run_id, 1) AS day, entity_id, name, verdict, findings FROM {v_done}")


# ------------------------------------------------------------------ incremental jobs
def _landed(spark, df, label: str, parts: int, by: str):
    path = fresh_path(spark, label)
    df.repartition(parts, by).sortWithinPartitions(by).write.parquet(path)
    return path


def stream_archive(spark, sf_dir):
    """Documents stored by micro-batches; a lost checkpoint replays them all and changes nothing."""
    arrivals = view(spark, sf_dir, "v_arrivals").drop("page_id")
    path = _landed(spark, arrivals, "landing", 3, "doc_id")
    target = fresh_path(spark, "archive")
    for _ in range(2):
        stream = J.file_stream(spark, path, J.ARRIVAL_ROW, 1)
        J.archive_stream(stream, target, fresh_path(spark, "cp")).awaitTermination()
    stored = spark.read.schema(J.ARCHIVE_ROW).parquet(target)
    return stored.select("source", "doc_id", "version", "path", "size_bytes", A.digest("content").alias("payload_sha256"))


Q["stream_archive"] = stream_archive
SQL["stream_archive"] = oracle("""
SELECT source, doc_id, version, source || strftime(harvest_day, '/%Y/%m/%d/') || replace(doc_id, '/', '_') || '/v' || version || '/' || filename AS path,
  strlen(content) AS size_bytes, sha256(content) AS payload_sha256
FROM (SELECT source, doc_id, content, filename, harvest_day, CAST(row_number() OVER (PARTITION BY source, doc_id ORDER BY min(arrival)) AS INT) AS version
      FROM {v_arrivals} GROUP BY source, doc_id, content, filename, harvest_day) t
""")


def stream_ingest(spark, sf_dir):
    facts, filings = _inputs(spark, sf_dir)
    path = _landed(spark, facts, "facts", 3, "accession")
    target = fresh_path(spark, "canonical")
    stream = J.file_stream(spark, path, facts.schema.simpleString()[7:-1].replace(":", " "), 1)
    J.ingest_stream(stream, materialize(filings, "filings"), target, fresh_path(spark, "cp")).awaitTermination()
    out = spark.read.schema(J.FACT_ROW).parquet(target)
    return out.select("entity_id", F.col("period_end").cast("string").alias("period_end"), "fiscal_period", "concept", "value", "accession")


Q["stream_ingest"] = stream_ingest
SQL["stream_ingest"] = oracle("""
SELECT h.entity_id, CAST(c.period_of_report AS VARCHAR) AS period_end, snapshot_period AS fiscal_period, concept, value, c.accession FROM {o_chosen} c JOIN {v_filing_headers} h ON h.accession = c.accession
""")


def stream_ledger(spark, sf_dir):
    picks = _picks(spark, sf_dir).select("as_of", "strategy", "entity_id", "reference_price", "ordinal")
    path = _landed(spark, picks, "picks", 3, "ordinal")
    schema = "as_of date, strategy string, entity_id string, reference_price double, ordinal long"
    target = fresh_path(spark, "ledger")
    J.ledger_stream(J.file_stream(spark, path, schema, 1), target, fresh_path(spark, "cp")).awaitTermination()
    return J.ledger_state(spark, target, schema).withColumn("as_of", F.col("as_of").cast("string"))


Q["stream_ledger"] = stream_ledger
SQL["stream_ledger"] = oracle("""
SELECT CAST(as_of AS VARCHAR) AS as_of, strategy, entity_id, reference_price, ordinal FROM {v_ledger} QUALIFY row_number() OVER (PARTITION BY as_of, strategy, entity_id ORDER BY ordinal DESC) = 1
""")


def stream_run_index(spark, sf_dir):
    entries = RP.run_entries(view(spark, sf_dir, "v_requested"), view(spark, sf_dir, "v_done")).select("run_id", "entity_id", "status", "vetoed")
    path = _landed(spark, entries, "entries", 3, "entity_id")
    target = fresh_path(spark, "run_index")
    stream = J.file_stream(spark, path, "run_id string, entity_id string, status string, vetoed boolean", 1)
    J.run_index_stream(stream, target, fresh_path(spark, "cp")).awaitTermination()
    return J.run_index_state(spark, target)


Q["stream_run_index"] = stream_run_index
SQL["stream_run_index"] = SQL["run_index"]


def stream_report_changes(spark, sf_dir):
    """The change feed of a report tree, summed by day: one row of the feed for each JSON file."""
    root, target = fresh_path(spark, "reports"), fresh_path(spark, "changes")
    tree = view(spark, sf_dir, "v_tree").where("k = 1").select("day", "s")
    tree.repartition("day").write.partitionBy("day").json(root)

    def step(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    feed = J.report_changes(spark, root)
    feed.writeStream.foreachBatch(step).option("checkpointLocation", fresh_path(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    day = F.regexp_extract("path", "day=([0-9-]+)", 1).alias("day")
    return spark.read.parquet(target).groupBy(day).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


Q["stream_report_changes"] = stream_report_changes
SQL["stream_report_changes"] = oracle("""
SELECT day, CAST(1 AS BIGINT) AS files, CAST(sum(length('{"s":}') + length(CAST(s AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM {v_tree} WHERE k = 1 GROUP BY day
""")
