"""Queries over books, the pick ledger and forward scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.operators import books as B
from tallystone.operators import evaluation as E
from tallystone.operators.learned import InsufficientHistory, gbdt_book
from tallystone.plans.pick import evaluate, run_pick
from tallystone.session import fresh_path
from tallystone.sources import ledger as LG
from workload.screen_queries import profiles, r6, screen
from workload.views import VIEWS, oracle, view, wide_snapshots

Q: dict = {}
SQL: dict[str, str] = {}

_EV = """SELECT r.entity_id, cohort, value AS ev FROM {o_ranked} r JOIN {o_metrics} m ON m.entity_id = r.entity_id AND metric = 'ev_ebit' AND ok WHERE value > 0"""
VIEWS["o_decile"] = f"""
SELECT entity_id, row_number() OVER (ORDER BY ev, entity_id) AS rank, -ev AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY ev, entity_id) AS place, count(*) OVER (PARTITION BY cohort) AS n FROM ({_EV}) e) t
WHERE place <= greatest(1, ceil(n * CAST(0.1 AS DOUBLE)))
"""
VIEWS["o_top"] = "SELECT entity_id, row_number() OVER (ORDER BY round(composite, 9) DESC, entity_id) AS rank, composite FROM {o_ranked} WHERE composite IS NOT NULL QUALIFY rank <= 20"


def book_universe(spark, sf_dir):
    return B.equal_weight_universe(screen(spark, sf_dir).ranked).select("entity_id", r6("score").alias("score"))


Q["book_universe"] = book_universe
SQL["book_universe"] = oracle("SELECT entity_id, round(composite, 6) + 0.0 AS score FROM {o_ranked}")


def book_top_composite(spark, sf_dir):
    return B.top_composite(screen(spark, sf_dir).ranked, 20).select("entity_id", "rank", r6("score").alias("score"))


Q["book_top_composite"] = book_top_composite
SQL["book_top_composite"] = oracle("SELECT entity_id, CAST(rank AS INT) AS rank, round(composite, 6) + 0.0 AS score FROM {o_top}")


def book_ev_ebit_decile(spark, sf_dir):
    return B.ev_ebit_decile(screen(spark, sf_dir).ranked).select("entity_id", "rank", "score")


Q["book_ev_ebit_decile"] = book_ev_ebit_decile
SQL["book_ev_ebit_decile"] = oracle("SELECT entity_id, CAST(rank AS INT) AS rank, score FROM {o_decile}")


def _run(spark, sf_dir, ledger_path=None):
    market = view(spark, sf_dir, "v_market")
    decisions = market.where(F.col("entity_id").cast("long") % 4 == 1).select(
        "entity_id", (F.col("entity_id").cast("long") % 3 == 0).alias("vetoed"),
        F.array(F.lit("bad"), F.lit("worse")).alias("reasons"),
    )
    return run_pick(
        wide_snapshots(spark, sf_dir), profiles(spark, sf_dir), market, market,
        as_of="2026-07-31", run_id="run-1", decisions=decisions, ledger_path=ledger_path,
    )


def pick_batch(spark, sf_dir):
    """Books are appended to a ledger, read back and summarized."""
    path = fresh_path(spark, "ledger")
    _run(spark, sf_dir, path)
    return B.batch_summary(LG.read_ledger(spark, path))


Q["pick_batch"] = pick_batch
SQL["pick_batch"] = oracle("""
SELECT 'universe_ew' AS strategy, count(*) AS picks, count(price) AS priced FROM {o_ranked} r LEFT JOIN {v_market} m ON m.entity_id = r.entity_id
UNION ALL SELECT 'screen', count(*), count(price) FROM {o_top} r LEFT JOIN {v_market} m ON m.entity_id = r.entity_id HAVING count(*) > 0
UNION ALL SELECT 'ev_ebit_decile', count(*), count(price) FROM {o_decile} r LEFT JOIN {v_market} m ON m.entity_id = r.entity_id HAVING count(*) > 0
UNION ALL SELECT 'agent', count(*), count(price) FROM {v_market} WHERE CAST(entity_id AS BIGINT) % 4 = 1 AND CAST(entity_id AS BIGINT) % 3 <> 0 HAVING count(*) > 0
""")


def agent_book(spark, sf_dir):
    return _run(spark, sf_dir).picks.where("strategy = 'agent'").select(
        "entity_id", "name", "weight", "vetoed", "note", F.size("features").cast("long").alias("features")
    )


Q["agent_book"] = agent_book
SQL["agent_book"] = oracle("""
WITH d AS (SELECT entity_id, CAST(entity_id AS BIGINT) % 3 = 0 AS vetoed FROM {v_market} WHERE CAST(entity_id AS BIGINT) % 4 = 1)
SELECT d.entity_id, r.name, CASE WHEN vetoed THEN 0.0 ELSE 1.0::DOUBLE / (SELECT count(*) FROM d WHERE NOT vetoed) END AS weight, vetoed,
  CASE WHEN vetoed THEN 'bad; worse' END AS note,
  CASE WHEN r.entity_id IS NULL THEN 0 ELSE (SELECT count(*) FROM {o_metrics} m WHERE m.entity_id = d.entity_id AND ok AND value < CAST('Infinity' AS DOUBLE) AND metric IN ("""
    + ", ".join(f"'{n}'" for n in V.RANKED_METRICS) + """)) END AS features
FROM d LEFT JOIN {o_ranked} r ON r.entity_id = d.entity_id
""")

# ------------------------------------------------------------------ ledger fixture
VIEWS["v_ledger"] = """
SELECT CASE WHEN i < 5 THEN make_date(2026, 1, 5) ELSE make_date(2026, 2, 5) END AS as_of,
  CASE i % 5 WHEN 0 THEN 'universe_ew' WHEN 1 THEN 'screen' WHEN 2 THEN 'ev_ebit_decile' WHEN 3 THEN 'gbdt' ELSE 'agent' END AS strategy,
  CAST(s_suppkey AS STRING) AS entity_id, s_name AS name, 'c' || CAST(s_nationkey % 4 AS STRING) AS cohort,
  CASE WHEN s_suppkey % 10 = 3 THEN NULL WHEN s_suppkey % 17 = 5 THEN -1 * (1000 + abs(s_acctbal)) / 100 ELSE (1000 + abs(s_acctbal) + d) / 100 END AS reference_price,
  CASE WHEN i % 5 = 4 AND s_suppkey % 5 = 0 THEN 0 * s_acctbal WHEN i % 5 = 1 THEN CAST(1 + s_suppkey % 4 AS DOUBLE) / 4 ELSE 1 + 0 * s_acctbal END AS weight,
  CAST(s_suppkey % 50 AS INT) AS rank, s_acctbal AS score, CASE WHEN i % 5 = 4 THEN s_suppkey % 5 = 0 END AS vetoed,
  CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal / 7 END AS f_a, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS DOUBLE) END AS f_b,
  'run-' || CAST(i / 5 >= 1 AS STRING) AS run_id, s_suppkey * 20 + i * 2 + d AS ordinal
FROM (SELECT *, SERIES(0, 9) AS i FROM (SELECT *, SERIES(0, 1) AS d FROM {supplier}) u) t
WHERE (d = 0 OR s_suppkey % 12 = 0)
  AND CASE i % 5 WHEN 1 THEN s_suppkey % 3 = 0 WHEN 2 THEN s_suppkey % 7 = 0 WHEN 3 THEN s_suppkey % 40 = 0 WHEN 4 THEN s_suppkey % 2 = 0 ELSE true END
"""
VIEWS["v_forward"] = """
SELECT CAST(s_suppkey AS STRING) AS entity_id, CASE WHEN s_suppkey % 31 = 4 THEN 0 * s_acctbal ELSE (1000 + abs(s_acctbal)) / 100 * (70 + s_suppkey % 13 * 5) / 100 END AS price
FROM {supplier} WHERE s_suppkey % 10 <> 0
"""


def _picks(spark, sf_dir):
    entry = lambda k: F.when(
        F.col(f"f_{k}").isNotNull(), F.struct(F.lit(k).alias("key"), F.col(f"f_{k}").alias("value"))
    )
    p = view(spark, sf_dir, "v_ledger")
    return p.withColumns({
        "features": F.map_from_entries(F.array_compact(F.array(entry("a"), entry("b")))),
        "currency": F.lit(None).cast("string"), "note": F.lit(None).cast("string"),
    }).drop("f_a", "f_b")


VIEWS["o_scored"] = """
SELECT p.*, f.price AS exit_price, coalesce(reference_price > 0 AND f.price > 0, false) AS gradeable,
  CASE WHEN reference_price > 0 AND f.price > 0 THEN f.price / reference_price - 1 END AS gross_return,
  CASE WHEN reference_price > 0 AND f.price > 0 THEN f.price / reference_price - 1 - CAST(0.04 AS DOUBLE) END AS net_return
FROM (SELECT * FROM {v_ledger} WHERE as_of = (SELECT max(as_of) FROM {v_ledger}) QUALIFY row_number() OVER (PARTITION BY as_of, strategy, entity_id ORDER BY ordinal DESC) = 1) p
LEFT JOIN {v_forward} f ON f.entity_id = p.entity_id
"""
VIEWS["o_scores"] = """
SELECT strategy, count(*) AS n_picks, count(*) FILTER (g) AS n_scored, count(*) FILTER (weight > 0 AND NOT gradeable) AS ungradeable,
  sum(net_return * weight) FILTER (g) / sum(weight) FILTER (g) AS portfolio_return, avg(net_return) FILTER (g) AS mean, quantile_cont(net_return, 0.5) FILTER (g) AS median,
  stddev_pop(net_return) FILTER (g) AS stdev, min(net_return) FILTER (g) AS minimum, quantile_cont(net_return, 0.1) FILTER (g) AS p10, quantile_cont(net_return, 0.25) FILTER (g) AS p25,
  quantile_cont(net_return, 0.75) FILTER (g) AS p75, quantile_cont(net_return, 0.9) FILTER (g) AS p90, max(net_return) FILTER (g) AS maximum, avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (g) AS hit_rate
FROM (SELECT *, gradeable AND weight > 0 AS g FROM {o_scored}) t GROUP BY strategy
"""
_STATS = ("portfolio_return", "mean", "median", "stdev", "minimum", "p10", "p25", "p75", "p90", "maximum", "hit_rate")


def _evaluation(spark, sf_dir):
    return evaluate(E.scope_to_vintage(_picks(spark, sf_dir)), view(spark, sf_dir, "v_forward"))


def vintage_scope(spark, sf_dir):
    p = _picks(spark, sf_dir)
    scoped = E.dedup_last(E.scope_to_vintage(p)).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("picks"), F.max("ordinal").alias("last_ordinal")
    )
    note = E.scope_note(p).select(F.col("note").alias("strategy"), F.lit(0).cast("long").alias("picks"), F.lit(0).cast("long").alias("last_ordinal"))
    by_run = E.scope_to_vintage(p, run_id="run-false").agg(F.count(F.lit(1)).alias("picks"), F.max("ordinal").alias("last_ordinal"))
    return scoped.unionByName(note).unionByName(by_run.withColumn("strategy", F.lit("run-false")))


Q["vintage_scope"] = vintage_scope
SQL["vintage_scope"] = oracle("""
SELECT strategy, count(*) AS picks, max(ordinal) AS last_ordinal FROM {o_scored} GROUP BY strategy
UNION ALL SELECT 'the ledger spans 2 pick dates; grading only the latest (2026-02-05), because one forward-price snapshot cannot fairly grade picks from different dates. Pass vintage or run_id to grade another, and grade each vintage against its own forward window.', 0, 0
UNION ALL SELECT 'run-false', count(*), max(ordinal) FROM {v_ledger} WHERE run_id = 'run-false'
""")


def scored_picks(spark, sf_dir):
    return _evaluation(spark, sf_dir).scored.select(
        "strategy", "entity_id", "ordinal", "exit_price", "gradeable", r6("gross_return").alias("gross_return"), r6("net_return").alias("net_return")
    )


Q["scored_picks"] = scored_picks
SQL["scored_picks"] = oracle("SELECT strategy, entity_id, ordinal, exit_price, gradeable, round(gross_return, 6) + 0.0 AS gross_return, round(net_return, 6) + 0.0 AS net_return FROM {o_scored}")


def strategy_scores(spark, sf_dir):
    return _evaluation(spark, sf_dir).scores.select(
        "strategy", "n_picks", "n_scored", "ungradeable", *[r6(c).alias(c) for c in _STATS], "note"
    )


Q["strategy_scores"] = strategy_scores
SQL["strategy_scores"] = oracle(
    "SELECT strategy, n_picks, n_scored, ungradeable, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _STATS)
    + ", CASE WHEN n_scored = 0 THEN 'nothing in this book could be graded (missing reference or forward prices).' WHEN mean - median > 0.02 THEN 'mean sits well above median: the book''s return leans on a few big winners (Bessembinder skew), so the median is the more honest summary.' END AS note FROM {o_scores}"
)


def agent_comparison(spark, sf_dir):
    c = _evaluation(spark, sf_dir).comparisons
    return c.select("position", "baseline", *[r6(x).alias(x) for x in ("agent_return", "baseline_return", "delta", "median_delta")], "signs_disagree", "verdict")


Q["agent_comparison"] = agent_comparison
SQL["agent_comparison"] = oracle("""
WITH a AS (SELECT * FROM {o_scores} WHERE strategy = 'agent'),
 t AS (SELECT b.*, a.portfolio_return AS ar, coalesce(a.n_scored, 0) AS na, a.median AS am FROM {o_scores} b LEFT JOIN a ON true WHERE b.strategy <> 'agent'),
 u AS (SELECT *, ar IS NOT NULL AND portfolio_return IS NOT NULL AND na >= 30 AND n_scored >= 30 AS ok FROM t),
 w AS (SELECT *, CASE WHEN ok THEN ar - portfolio_return END AS d, CASE WHEN ok THEN am - median END AS m FROM u),
 x AS (SELECT *, coalesce((d > 0) <> (m > 0), false) AS dis, 'mean ' || printf('%+.1f%%', d * 100) || ', median ' || printf('%+.1f%%', m * 100) AS ph FROM w)
SELECT CAST(CASE strategy WHEN 'universe_ew' THEN 1 WHEN 'screen' THEN 2 WHEN 'ev_ebit_decile' THEN 3 ELSE 4 END AS INT) AS position, strategy AS baseline,
  round(ar, 6) + 0.0 AS agent_return, round(portfolio_return, 6) + 0.0 AS baseline_return, round(d, 6) + 0.0 AS delta, round(m, 6) + 0.0 AS median_delta, dis AS signs_disagree,
  CASE WHEN ar IS NULL THEN 'no agent book to compare yet.' WHEN portfolio_return IS NULL THEN 'the ' || strategy || ' baseline had nothing gradeable to compare against.'
   WHEN NOT ok THEN 'insufficient evidence (agent N=' || na || ', ' || strategy || ' N=' || n_scored || '; need >= 30 each). Any gap here is noise.'
   WHEN dis THEN 'mixed vs ' || strategy || ' (' || ph || '): mean and median disagree, so a few outliers are driving the average -- inconclusive, not evidence of signal.'
   WHEN strategy = 'ev_ebit_decile' AND NOT (d > 0 AND m > 0) THEN 'the agent did NOT beat the EV/EBIT decile (' || ph || '). On this evidence the LLM research layer is cost, not signal -- a one-line value screen did as well or better.'
   WHEN d > 0 AND m > 0 THEN 'the agent beat ' || strategy || ' (' || ph || ').' WHEN d = 0 AND m = 0 THEN 'the agent matched ' || strategy || ' (' || ph || ').' ELSE 'the agent trailed ' || strategy || ' (' || ph || ').' END AS verdict
FROM x
""")

Q["sample_warnings"] = lambda spark, sf_dir: _evaluation(spark, sf_dir).warnings
SQL["sample_warnings"] = oracle("""
SELECT CASE WHEN thin IS NULL THEN 'Nothing scoreable yet: no pick had both a reference and a forward price. Supply forward prices and let the picks age before reading anything into this.'
 ELSE '!! at least one strategy has only ' || thin || ' scored pick(s) -- FAR too few to mean anything. A coin flip returns 70%+ hit rates on small samples routinely, and one big winner swings the mean entirely. Treat every thin book here as a plumbing check, not evidence -- aim for 30+ per strategy, ideally 100+, before judging.' END AS warning
FROM (SELECT min(n_scored) FILTER (n_scored > 0) AS thin FROM {o_scores}) t WHERE thin IS NULL OR thin < 30
""")


def ledger_read(spark, sf_dir):
    path = fresh_path(spark, "ledger")
    LG.append_picks(_picks(spark, sf_dir).drop("ordinal"), path)
    picks = LG.read_ledger(spark, path)
    return picks.groupBy("as_of", "strategy").agg(
        F.count(F.lit(1)).alias("picks"), F.count("reference_price").alias("priced"),
        F.sum(F.size("features").cast("long")).alias("features"), F.count_if("vetoed").alias("vetoed"),
    ).withColumn("as_of", F.col("as_of").cast("string"))


Q["ledger_read"] = ledger_read
SQL["ledger_read"] = oracle("""
SELECT CAST(as_of AS VARCHAR) AS as_of, strategy, count(*) AS picks, count(reference_price) AS priced, count(f_a) + count(f_b) AS features, count(*) FILTER (vetoed) AS vetoed
FROM {v_ledger} GROUP BY ALL
""")


def ledger_runs(spark, sf_dir):
    p = _picks(spark, sf_dir)
    agents = LG.run_ids(LG.read_strategy(p, "agent")).withColumn("of", F.lit("agent"))
    return LG.run_ids(p).withColumn("of", F.lit("all")).unionByName(agents)


Q["ledger_runs"] = ledger_runs
SQL["ledger_runs"] = oracle("""
SELECT 'all' AS of, run_id, min(ordinal) AS first_ordinal FROM {v_ledger} GROUP BY run_id
UNION ALL SELECT 'agent', run_id, min(ordinal) FROM {v_ledger} WHERE strategy = 'agent' GROUP BY run_id
""")


def training_rows(spark, sf_dir):
    rows = E.labeled_observations(_evaluation(spark, sf_dir).scored)
    names = E.feature_names(rows).agg(F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("strategy"))
    per = rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("forward_return")).alias("total"))
    return per.unionByName(names.select("strategy", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total")))


Q["training_rows"] = training_rows
SQL["training_rows"] = oracle("""
SELECT strategy, count(*) AS n, round(sum(net_return), 6) + 0.0 AS total FROM {o_scored} WHERE gradeable AND weight > 0 AND (f_a IS NOT NULL OR f_b IS NOT NULL) GROUP BY strategy
UNION ALL SELECT 'a,b', 0, 0
""")


def book_gbdt(spark, sf_dir):
    """Boosted baseline trained on the graded picks of every vintage.

    A table with too little history gives one row with the reason in place of a name.
    """
    picks = _picks(spark, sf_dir)
    scored = evaluate(picks, view(spark, sf_dir, "v_forward")).scored
    newest = E.scope_to_vintage(scored).where("strategy = 'universe_ew'")
    candidates = newest.select("entity_id", F.col("features").alias("metric_values"))
    try:
        return gbdt_book(candidates, E.labeled_observations(scored), top=20)
    except InsufficientHistory as short:
        return spark.range(1).select(F.lit("gbdt").alias("strategy"), F.lit(str(short)).alias("entity_id"), F.lit(None).cast("double").alias("score"))


Q["book_gbdt"] = book_gbdt
