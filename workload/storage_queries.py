"""Queries over the archive, stored tables, ingest planning and exchange rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions.columns import human_bytes
from tallystone.operators import archive as A
from tallystone.operators import fx as X
from tallystone.operators import ingest as I
from tallystone.session import fresh_path
from tallystone.sources.keyed import KeyedTable
from workload.views import HEADER, VIEWS, oracle, view

Q: dict = {}
SQL: dict[str, str] = {}

# ------------------------------------------------------------------ archive
_DAY = "make_date(2026, 7, CAST(1 + page_id % 20 AS INT))"
_SOURCE = "CASE page_id % 5 WHEN 0 THEN 'sec' WHEN 1 THEN 'esef' WHEN 2 THEN 'edinet' WHEN 3 THEN 'opendart' ELSE 'companies_house' END"
VIEWS["v_arrivals"] = f"""
SELECT {_SOURCE} AS source, 'D/' || CAST(page_id AS STRING) AS doc_id, page_id, page_id * 10 + i AS arrival,
  CASE WHEN i = 2 THEN html || 'rev' ELSE html END AS content, 'p' || CAST(page_id AS STRING) || '.html' AS filename, {_DAY} AS harvest_day
FROM (SELECT *, SERIES(0, 3) AS i FROM {{pages}}) t
WHERE i = 0 OR (i = 1 AND page_id % 7 = 0) OR (i = 2 AND page_id % 7 = 1) OR (i = 3 AND page_id % 14 = 1)
"""
VIEWS["v_held"] = f"""
SELECT {_SOURCE} AS source, 'D/' || CAST(page_id AS STRING) AS doc_id, html AS content, length(html) AS size_bytes,
       1 AS version, make_date(2026, 6, CAST(1 + page_id % 9 AS INT)) AS harvest_day
FROM {{pages}} WHERE page_id % 4 = 0
"""


def _held(spark, sf_dir):
    return view(spark, sf_dir, "v_held").withColumn("content_sha256", A.digest("content"))


def archive_versions(spark, sf_dir):
    planned = A.plan_documents(view(spark, sf_dir, "v_arrivals"), _held(spark, sf_dir))
    return planned.select(*A.CONTENT_KEY, "version", "path", "size_bytes")


Q["archive_versions"] = archive_versions
VIEWS["o_versions"] = """
SELECT f.source, f.doc_id, f.sha AS content_sha256, f.arrival, f.content, f.harvest_day, f.page_id,
  CAST(coalesce(h.held, 0) + row_number() OVER (PARTITION BY f.source, f.doc_id ORDER BY f.arrival) AS INT) AS version
FROM (SELECT source, doc_id, sha256(content) AS sha, min(arrival) AS arrival, any_value(content) AS content, any_value(harvest_day) AS harvest_day, any_value(page_id) AS page_id
      FROM {v_arrivals} GROUP BY source, doc_id, sha256(content)) f
LEFT JOIN (SELECT source, doc_id, count(*) AS held FROM {v_held} GROUP BY ALL) h USING (source, doc_id)
WHERE NOT EXISTS (SELECT 1 FROM {v_held} g WHERE g.source = f.source AND g.doc_id = f.doc_id AND sha256(g.content) = f.sha)
"""
SQL["archive_versions"] = oracle("""
SELECT source, doc_id, content_sha256, version, source || strftime(harvest_day, '/%Y/%m/%d/') || replace(doc_id, '/', '_') || '/v' || version || '/p' || page_id || '.html' AS path,
       strlen(content) AS size_bytes FROM {o_versions}
""")


def manifest_payloads(spark, sf_dir):
    """Write the batch as an archive, scan the manifest of a day range, read payloads back."""
    root = fresh_path(spark, "archive")
    A.put_documents(
        view(spark, sf_dir, "v_arrivals").drop("page_id"), f"{root}/manifest", f"{root}/payloads", _held(spark, sf_dir)
    )
    manifest = A.read_manifest(spark, f"{root}/manifest", since="2026-07-03", until="2026-07-12")
    rows = A.read_payloads(spark, f"{root}/payloads", manifest)
    return rows.select("source", "doc_id", "version", F.md5("content").alias("payload_md5"))


Q["manifest_payloads"] = manifest_payloads
SQL["manifest_payloads"] = oracle("""
SELECT source, doc_id, version, md5(content) AS payload_md5 FROM {o_versions}
WHERE harvest_day BETWEEN DATE '2026-07-03' AND DATE '2026-07-12'
""")


def archive_status(spark, sf_dir):
    planned = A.plan_documents(view(spark, sf_dir, "v_arrivals"), _held(spark, sf_dir))
    fields = ["source", "size_bytes", "version", "harvest_day"]
    held = view(spark, sf_dir, "v_held").withColumn("size_bytes", F.octet_length("content").cast("long"))
    status = A.archive_status(planned.select(*fields).unionByName(held.select(*fields)))
    return status.select(
        F.coalesce("source", F.lit("total")).alias("source"), "documents", "bytes", human_bytes("bytes").alias("size"),
        "days", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "revisions",
    )


Q["archive_status"] = archive_status
SQL["archive_status"] = oracle("""
WITH m AS (SELECT source, strlen(content) AS b, version, harvest_day FROM {o_versions} UNION ALL SELECT source, strlen(content), version, harvest_day FROM {v_held})
SELECT coalesce(source, 'total') AS source, count(*) AS documents, CAST(sum(b) AS BIGINT) AS bytes,
  CASE WHEN sum(b) < 1024 THEN CAST(sum(b) AS VARCHAR) || ' B' WHEN sum(b) < 1048576 THEN format('{:,.1f} KB', sum(b) / 1024.0::DOUBLE) WHEN sum(b) < 1073741824 THEN format('{:,.1f} MB', sum(b) / 1048576.0::DOUBLE) ELSE format('{:,.1f} GB', sum(b) / 1073741824.0::DOUBLE) END AS size,
  count(DISTINCT harvest_day) AS days, CAST(min(harvest_day) AS VARCHAR) AS first_day, CAST(max(harvest_day) AS VARCHAR) AS last_day, count(*) FILTER (version > 1) AS revisions
FROM m GROUP BY ROLLUP (source)
""")


def harvest_counters(spark, sf_dir):
    listed = view(spark, sf_dir, "v_arrivals")
    fetched = listed.where(F.col("arrival") % 11 != 5).select("arrival", A.digest("content").alias("content_sha256"))
    held = _held(spark, sf_dir)
    counters = A.day_counters(A.harvest_outcomes(listed, fetched, held)).withColumn("mode", F.lit("skip"))
    again = A.day_counters(A.harvest_outcomes(listed, fetched, held, refetch_known=True)).withColumn("mode", F.lit("refetch"))
    return counters.unionByName(again).withColumn("harvest_day", F.col("harvest_day").cast("string"))


Q["harvest_counters"] = harvest_counters


def _outcome_sql(mode: str) -> str:
    skip = "EXISTS (SELECT 1 FROM {v_held} h WHERE h.source = a.source AND h.doc_id = a.doc_id)" if mode == "skip" else "false"
    return f"""SELECT '{mode}' AS mode, a.source, CAST(harvest_day AS VARCHAR) AS harvest_day,
  CASE WHEN {skip} THEN 'skipped_known' WHEN arrival % 11 = 5 THEN 'failed'
       WHEN EXISTS (SELECT 1 FROM {{v_held}} h WHERE h.source = a.source AND h.doc_id = a.doc_id AND h.content = a.content)
         OR EXISTS (SELECT 1 FROM {{v_arrivals}} e WHERE e.source = a.source AND e.doc_id = a.doc_id AND e.content = a.content AND e.arrival < a.arrival AND e.arrival % 11 <> 5) THEN 'unchanged'
       WHEN EXISTS (SELECT 1 FROM {{v_held}} h WHERE h.source = a.source AND h.doc_id = a.doc_id)
         OR EXISTS (SELECT 1 FROM {{v_arrivals}} e WHERE e.source = a.source AND e.doc_id = a.doc_id AND e.arrival < a.arrival AND e.arrival % 11 <> 5) THEN 'revision'
       ELSE 'stored' END AS outcome
FROM {{v_arrivals}} a"""


SQL["harvest_counters"] = oracle(f"""
SELECT mode, source, harvest_day, count(*) AS listed, count(*) FILTER (outcome IN ('stored', 'revision')) AS stored, count(*) FILTER (outcome = 'revision') AS revisions,
  count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'skipped_known') AS skipped_known, count(*) FILTER (outcome = 'failed') AS failed
FROM ({_outcome_sql('skip')} UNION ALL {_outcome_sql('refetch')}) t GROUP BY ALL
""")

# ------------------------------------------------------------------ stored tables
def _stored(spark, label, rows, keys):
    """The rows as a stored table of 16 buckets, read and rewritten by bucket from here on."""
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    table = KeyedTable(spark, fresh_path(spark, label), schema, keys, buckets=16)
    table.append(rows)
    return table


def replace_raw_facts(spark, sf_dir):
    facts = view(spark, sf_dir, "v_raw_facts")
    year = F.substring_index("accession", "-", -1).cast("int")
    existing = facts.where(year <= 1999)
    batch = facts.where((year >= 1999) & (F.col("fact_ordinal") < 8)).withColumn("value", F.col("value") + 1)
    table = _stored(spark, "raw_facts", existing, ["accession"])
    A.store_raw_facts(table, batch)
    return table.read().groupBy("accession").agg(
        F.count(F.lit(1)).alias("facts"), F.min("value").alias("lowest"), F.max("value").alias("highest")
    )


Q["replace_raw_facts"] = replace_raw_facts
SQL["replace_raw_facts"] = oracle("""
WITH t AS (SELECT *, CAST(split_part(accession, '-', 2) AS INT) AS y FROM {v_raw_facts})
SELECT accession, count(*) AS facts, min(v) AS lowest, max(v) AS highest
FROM (SELECT accession, value AS v FROM t WHERE y <= 1998 UNION ALL SELECT accession, value + 1 FROM t WHERE y >= 1999 AND fact_ordinal < 8) u GROUP BY accession
""")


def upsert_snapshots(spark, sf_dir):
    snap = view(spark, sf_dir, "v_snap").select(*HEADER, "revenue").withColumn(
        "fiscal_period", F.when(F.col("entity_id").cast("long") % 3 != 0, F.col("fiscal_period"))
    )
    existing = snap.where("fiscal_year <= 2000")
    batch = snap.where("fiscal_year >= 1999").withColumn("ordinal", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "revenue", F.col("revenue") + F.col("ordinal")
    )
    table = _stored(spark, "snapshots", existing, A.SNAPSHOT_KEY)
    A.store_snapshots(table, batch)
    return table.read().select("entity_id", F.col("period_end").cast("string").alias("period_end"), "fiscal_period", "revenue")


Q["upsert_snapshots"] = upsert_snapshots
SQL["upsert_snapshots"] = oracle("""
SELECT entity_id, CAST(period_end AS VARCHAR) AS period_end, CASE WHEN CAST(entity_id AS BIGINT) % 3 <> 0 THEN fiscal_period END AS fiscal_period,
       CASE WHEN fiscal_year <= 1998 THEN revenue ELSE revenue + 2 END AS revenue FROM {v_snap}
""")


def upsert_facts(spark, sf_dir):
    """Snapshot replacement on the fact table: concepts that vanish from a period go away."""
    from workload.views import long_facts

    snap = view(spark, sf_dir, "v_snap")
    key = ["entity_id", "period_end", "fiscal_period"]
    facts = long_facts(snap).select(*key, "concept", "value", "accession")
    batch_headers = snap.where("fiscal_year >= 2000").select(*key, "accession")
    batch = facts.join(batch_headers.select("accession"), "accession").where("concept <> 'capex'").select(*facts.columns)
    table = _stored(spark, "facts", facts, key)
    A.store_canonical_facts(table, batch_headers, batch)
    return table.read().groupBy("accession").agg(F.count(F.lit(1)).alias("concepts"), F.bool_or(F.col("concept") == "capex").alias("has_capex"))


Q["upsert_facts"] = upsert_facts
SQL["upsert_facts"] = oracle("""
SELECT accession, CAST(24 - (CASE WHEN cost_of_revenue IS NULL THEN 1 ELSE 0 END + CASE WHEN gross_profit IS NULL THEN 1 ELSE 0 END + CASE WHEN depreciation_amortization IS NULL THEN 1 ELSE 0 END
   + CASE WHEN income_tax_expense IS NULL THEN 1 ELSE 0 END + CASE WHEN short_term_investments IS NULL THEN 1 ELSE 0 END + CASE WHEN short_term_debt IS NULL THEN 1 ELSE 0 END
   + CASE WHEN long_term_debt IS NULL THEN 1 ELSE 0 END + CASE WHEN retained_earnings IS NULL THEN 1 ELSE 0 END + CASE WHEN capex IS NULL OR fiscal_year >= 2000 THEN 1 ELSE 0 END) AS BIGINT) AS concepts,
   capex IS NOT NULL AND fiscal_year < 2000 AS has_capex
FROM {v_snap}
""")


def upsert_profiles(spark, sf_dir):
    p = view(spark, sf_dir, "v_profile").select("entity_id", "name", "country")
    batch = p.where(F.col("entity_id").cast("long") % 2 == 0).select(
        "entity_id", F.concat(F.lit("New "), "name").alias("name"), "country", F.lit(1).alias("ordinal")
    )
    table = _stored(spark, "profiles", p, ["entity_id"])
    A.store_profiles(table, batch)
    return table.read()


Q["upsert_profiles"] = upsert_profiles
SQL["upsert_profiles"] = oracle(
    "SELECT entity_id, CASE WHEN CAST(entity_id AS BIGINT) % 2 = 0 THEN 'New ' || name ELSE name END AS name, country FROM {v_profile}"
)

# ------------------------------------------------------------------ ingest planning
VIEWS["v_manifest"] = """
SELECT 'D' || CAST(page_id AS STRING) AS doc_id, page_id AS position, CASE page_id % 5 WHEN 0 THEN 'sec' WHEN 1 THEN 'esef' WHEN 2 THEN 'edinet' WHEN 3 THEN 'sec' ELSE 'esef' END AS source,
  CASE page_id % 6 WHEN 0 THEN '10-K' WHEN 1 THEN ' 10-q/a' WHEN 2 THEN '8-K' WHEN 3 THEN NULL WHEN 4 THEN '20-F' ELSE '4' END AS form_type,
  CASE page_id % 3 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/plain' END AS content_type,
  CASE page_id % 4 WHEN 0 THEN 'a.zip' WHEN 1 THEN 'a.json' ELSE 'a.txt' END AS filename
FROM {pages}
"""
VIEWS["v_ingested"] = "SELECT 'D' || CAST(page_id AS STRING) AS accession FROM {pages} WHERE page_id % 8 = 5 OR page_id % 8 = 6"
VIEWS["o_classified"] = """
SELECT m.*, CASE WHEN NOT CASE source WHEN 'sec' THEN form_type IS NULL OR regexp_replace(upper(trim(form_type)), '/A$', '') IN ('10-K', '10-Q', '20-F', '40-F')
     WHEN 'esef' THEN filename NOT LIKE '%.zip' AND (coalesce(content_type LIKE '%json%', false) OR filename LIKE '%.json') ELSE false END THEN 'unsupported'
   WHEN EXISTS (SELECT 1 FROM {v_ingested} i WHERE i.accession = m.doc_id) THEN 'skipped_existing' ELSE 'todo' END AS state
FROM {v_manifest} m
"""


def _todo(spark, sf_dir, limit=None):
    todo = I.ingest_todo(view(spark, sf_dir, "v_manifest"), view(spark, sf_dir, "v_ingested"), limit=limit)
    return todo.select("doc_id", "source", "position")


Q["ingest_todo"] = _todo
SQL["ingest_todo"] = oracle("SELECT doc_id, source, position FROM {o_classified} WHERE state = 'todo'")
Q["ingest_todo_limit"] = lambda spark, sf_dir: _todo(spark, sf_dir, 50)  # the limit is the feature
SQL["ingest_todo_limit"] = SQL["ingest_todo"] + " ORDER BY position LIMIT 50"


def ingest_counters(spark, sf_dir):
    classified = I.classify(view(spark, sf_dir, "v_manifest"), view(spark, sf_dir, "v_ingested"))
    todo = classified.where("state = 'todo'")
    facts = F.when(F.col("position") % 9 != 0, F.when(F.col("position") % 10 == 1, 0).otherwise(F.col("position")))
    parsed = todo.select(F.col("doc_id").alias("accession"), facts.alias("facts"))
    heads = parsed.where("facts > 0").select("accession", F.array_repeat(F.lit("w"), (F.col("facts") % 3).cast("int")).alias("warnings"))
    return I.ingest_counters(classified, parsed, heads)


Q["ingest_counters"] = ingest_counters
SQL["ingest_counters"] = oracle("""
SELECT count(*) FILTER (state <> 'unsupported') AS considered, count(*) FILTER (state = 'unsupported') AS unsupported, count(*) FILTER (state = 'skipped_existing') AS skipped_existing,
  count(*) FILTER (state = 'todo' AND position % 9 <> 0) AS parsed, count(*) FILTER (state = 'todo' AND position % 9 = 0) AS failed,
  count(*) FILTER (state = 'todo' AND position % 9 <> 0 AND position % 10 = 1) AS no_xbrl, count(*) FILTER (state = 'todo' AND position % 9 <> 0 AND position % 10 <> 1) AS snapshots,
  CAST(coalesce(sum(CASE WHEN state = 'todo' AND position % 9 <> 0 AND position % 10 <> 1 THEN position % 3 END), 0) AS BIGINT) AS warnings_total
FROM {o_classified}
""")

# ------------------------------------------------------------------ exchange rates
VIEWS["v_fx"] = """
SELECT upper(substr(event_type, 1, 3)) AS currency, CAST(ts AS DATE) AS day,
       (1000 + CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*)) / 1000 AS rate
FROM {events} WHERE value IS NOT NULL AND day(CAST(ts AS DATE)) % 7 NOT IN (6, 0) AND day(CAST(ts AS DATE)) NOT BETWEEN 16 AND 27
GROUP BY upper(substr(event_type, 1, 3)), CAST(ts AS DATE)
"""
VIEWS["v_fx_requests"] = """
SELECT o_orderkey AS k, o_totalprice AS amount,
  CASE o_orderkey % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN ' cli ' WHEN 2 THEN 'ERR' WHEN 3 THEN 'PUR' WHEN 4 THEN 'VIE' ELSE 'US' END AS from_ccy,
  CASE o_custkey % 5 WHEN 0 THEN 'eur' WHEN 1 THEN 'CLI' WHEN 2 THEN 'ERR' WHEN 3 THEN 'PUR' ELSE 'XXX' END AS to_ccy,
  make_date(2024, 1, CAST(1 + o_orderkey % 31 AS INT)) AS "on", make_date(2024, 1, CAST(1 + o_orderkey % 31 AS INT)) AS "start",
  make_date(2024, CAST(1 + o_custkey % 2 AS INT), CAST(1 + o_custkey % 28 AS INT)) AS "end"
FROM {orders}
"""


def _requests(spark, sf_dir):
    return view(spark, sf_dir, "v_fx_requests")


def _fx_out(df, *days):
    return df.select(
        "k", "from_ccy", "to_ccy", *[F.col(d).cast("string").alias(d) for d in days],
        (F.round("converted", 4) + F.lit(0.0)).alias("converted"), "fx_error",
    )


Q["fx_convert_instant"] = lambda spark, sf_dir: _fx_out(
    X.convert_instant(_requests(spark, sf_dir), view(spark, sf_dir, "v_fx")), "on"
)
Q["fx_convert_duration"] = lambda spark, sf_dir: _fx_out(
    X.convert_duration(_requests(spark, sf_dir), view(spark, sf_dir, "v_fx")), "start", "end"
)


def fx_period_end(spark, sf_dir):
    rates = view(spark, sf_dir, "v_fx")
    asked = _requests(spark, sf_dir).select(F.upper(F.trim("from_ccy")).alias("currency"), "on").distinct()
    out = X.period_end_rates(asked, rates, "currency", "on", "rate")
    return out.select("currency", F.col("on").cast("string").alias("on"), (F.round("rate", 6) + F.lit(0.0)).alias("rate"))


def fx_period_average(spark, sf_dir):
    rates = view(spark, sf_dir, "v_fx")
    asked = _requests(spark, sf_dir).select(F.upper(F.trim("from_ccy")).alias("currency"), "start", "end").distinct()
    out = X.period_average_rates(asked, rates, "currency", "start", "end", "rate")
    return out.select(
        "currency", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"),
        (F.round("rate", 6) + F.lit(0.0)).alias("rate"),
    )


Q["fx_period_end"] = fx_period_end
Q["fx_period_average"] = fx_period_average
VIEWS["o_asof"] = """
SELECT currency, d AS "on", (SELECT rate FROM {v_fx} f WHERE f.currency = c.currency AND f.day <= d AND f.day >= d - 10 ORDER BY day DESC LIMIT 1) AS rate
FROM (SELECT DISTINCT currency FROM {v_fx}) c, (SELECT DISTINCT "on" AS d FROM {v_fx_requests}) q
"""
VIEWS["o_avg"] = """
SELECT currency, s AS "start", e AS "end", (SELECT avg(rate) FROM {v_fx} f WHERE f.currency = c.currency AND f.day BETWEEN s AND e) AS rate
FROM (SELECT DISTINCT currency FROM {v_fx}) c, (SELECT DISTINCT "start" AS s, "end" AS e FROM {v_fx_requests}) q
"""
SQL["fx_period_end"] = oracle("""
SELECT DISTINCT upper(trim(from_ccy)) AS currency, CAST(r."on" AS VARCHAR) AS "on", CASE WHEN from_ccy = 'EUR' THEN 1.0 ELSE round(o.rate, 6) END AS rate
FROM {v_fx_requests} r LEFT JOIN {o_asof} o ON o.currency = upper(trim(from_ccy)) AND o."on" = r."on"
""")
SQL["fx_period_average"] = oracle("""
SELECT DISTINCT upper(trim(from_ccy)) AS currency, CAST(r."start" AS VARCHAR) AS "start", CAST(r."end" AS VARCHAR) AS "end", CASE WHEN from_ccy = 'EUR' THEN 1.0 ELSE round(o.rate, 6) END AS rate
FROM {v_fx_requests} r LEFT JOIN {o_avg} o ON o.currency = upper(trim(from_ccy)) AND o."start" = r."start" AND o."end" = r."end"
""")


def _convert_sql(view_name: str, on: str, low: str, high: str, days: str, inverted: str) -> str:
    return oracle(f"""
WITH t AS (SELECT r.*, upper(trim(from_ccy)) AS f, upper(trim(to_ccy)) AS t, CASE WHEN upper(trim(from_ccy)) = 'EUR' THEN 1.0 ELSE a.rate END AS ra, CASE WHEN upper(trim(to_ccy)) = 'EUR' THEN 1.0 ELSE b.rate END AS rb
  FROM {{v_fx_requests}} r LEFT JOIN {{{view_name}}} a ON a.currency = upper(trim(from_ccy)) AND {on.replace('?', 'a')}
  LEFT JOIN {{{view_name}}} b ON b.currency = upper(trim(to_ccy)) AND {on.replace('?', 'b')}),
e AS (SELECT *, CASE WHEN length(f) <> 3 THEN 'Not a valid ISO 4217 currency code: ''' || f || '''' WHEN f = t THEN NULL {inverted}
  WHEN ra IS NULL THEN 'ECB returned no observations for ' || f || ' in ' || {low} || '..' || {high} || '.'
  WHEN rb IS NULL THEN 'ECB returned no observations for ' || t || ' in ' || {low} || '..' || {high} || '.' END AS fx_error FROM t)
SELECT k, from_ccy, to_ccy, {days}, CASE WHEN fx_error IS NULL THEN round(CASE WHEN f = t THEN amount ELSE amount / ra * rb END, 4) END AS converted, fx_error FROM e
""")


SQL["fx_convert_instant"] = _convert_sql(
    "o_asof", '?."on" = r."on"', '("on" - 10)', '"on"', 'CAST("on" AS VARCHAR) AS "on"', ""
)
SQL["fx_convert_duration"] = _convert_sql(
    "o_avg", '?."start" = r."start" AND ?."end" = r."end"', '"start"', '"end"',
    'CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS "end"',
    """WHEN "start" > "end" THEN 'convert_duration window is inverted: start=' || "start" || ' end=' || "end\"""",
)
