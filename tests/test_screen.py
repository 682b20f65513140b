"""Ranking invariants, books and scoring."""

import datetime as dt
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.operators import books as B
from tallystone.operators import evaluation as E
from tallystone.operators import screening as S
from tallystone.plans.screen import screen_notes

RANK_INPUT = (
    "entity_id string, name string, country string, accounting_standard string, sector string, "
    "metrics map<string,double>, underfollowed boolean"
)


def ranked(spark, members, **options):
    rows = [(e, e, c, "IFRS", "services", m, False) for e, c, m in members]
    return {r.entity_id: r for r in S.rank(spark.createDataFrame(rows, RANK_INPUT), **options).collect()}


def test_direction_blocks_and_small_cohorts(spark):
    got = ranked(spark, [
        ("low", "A", {"roic": 0.1, "accruals": 0.3, "cash_runway_months": 10.0}),
        ("mid", "A", {"roic": 0.2, "accruals": 0.2, "cash_runway_months": 20.0}),
        ("high", "A", {"roic": 0.3, "accruals": 0.1, "cash_runway_months": math.inf}),
        ("lone", "B", {"roic": 9.0}),
        ("same1", "C", {"roic": 1.0}), ("same2", "C", {"roic": 1.0}), ("same3", "C", {"roic": 1.0}),
        ("none1", "D", {}), ("none2", "D", {"unranked": 1.0}), ("none3", "D", {"roic": math.nan}),
    ])
    assert got["high"].composite > got["mid"].composite > got["low"].composite
    assert got["high"].cheap is None and "cheap" in got["high"].warnings[0]
    assert got["high"].metric_values["cash_runway_months"] == math.inf
    assert got["lone"].composite is None and "not enough peers" in got["lone"].warnings[0]
    assert got["same1"].composite == 0.0
    assert got["none1"].composite is None
    assert got["none1"].warnings == ["no ranked metrics available in any block; composite is None"]


def test_outlier_is_winsorized(spark):
    values = [float(v) for v in range(1, 21)] + [10_000.0]
    got = ranked(spark, [(f"e{i}", "A", {"roic": v}) for i, v in enumerate(values)])
    lo, hi = np.percentile(values, [5, 95])
    clipped = np.clip(values, lo, hi)
    z = (clipped - clipped.mean()) / clipped.std()
    for i in range(len(values)):
        assert abs(got[f"e{i}"].quality - z[i]) < 1e-9


def test_weights_are_parameters(spark):
    members = [(f"e{i}", "A", {"roic": float(i), "altman_z": float(-i)}) for i in range(4)]
    safety = ranked(spark, members, weights={"cheap": 0.0, "quality": 0.0, "safety": 1.0})
    assert safety["e0"].composite > safety["e3"].composite


def test_equal_values_score_zero_over_many_partitions(spark):
    values = spark.createDataFrame(
        [(f"e{i}", f"C{i % 40}", "IFRS", "services", "share_issuance", 0.1 + i % 40 / 7) for i in range(400)],
        "entity_id string, country string, accounting_standard string, sector string, metric string, value double",
    ).repartition(9)
    stats = S.cohort_stats(values)
    assert [r for r in stats.collect() if r["std"] != 0.0 or r["mean"] != r["lo"]] == []
    assert {r["z"] for r in S.cohort_zscores(values, stats).collect()} == {0.0}


def test_notes_count_thin_cohorts_even_when_there_are_none(spark):
    result = SimpleNamespace(
        insufficient_checks=spark.createDataFrame([("shell", 4)], "rule string, entities long"),
        cohort_sizes=spark.createDataFrame([("A", 3)], "cohort string, members long"),
        universe_size=spark.createDataFrame([(3,)], "universe_size long"),
    )
    kept = {r["position"]: r["note"] for r in screen_notes(result, has_prices=False, keep_empty=True).collect()}
    assert sorted(kept) == [1, 2, 3] and kept[3].startswith("0 cohort(s) too small")
    assert [r["position"] for r in screen_notes(result, has_prices=True, keep_empty=True).collect()] == [2, 3]
    assert [r["position"] for r in screen_notes(result, has_prices=True).collect()] == [2]


CANDIDATE = "entity_id string, name string, cohort string, composite double, metric_values map<string,double>"


def test_decile_is_the_same_with_and_without_hot_cohorts(spark):
    rows = [
        (f"{i:04d}", "n", "big" if i % 4 else f"small{i % 3}", float(i % 7), {"ev_ebit": float((i * 37) % 400) - 40})
        for i in range(600)
    ]
    candidates = spark.createDataFrame(rows, CANDIDATE)
    expected = []
    cohorts = {}
    for e, _, c, _, m in rows:
        if m["ev_ebit"] > 0:
            cohorts.setdefault(c, []).append((m["ev_ebit"], e))
    for members in cohorts.values():
        expected += sorted(members)[: max(1, math.ceil(len(members) * 0.1))]
    expected = [(e, n, -ev) for n, (ev, e) in enumerate(sorted(expected), start=1)]
    for hot in (10, None):
        got = B.ev_ebit_decile(candidates, hot_rows=hot).orderBy("rank").collect()
        assert [(r.entity_id, r.rank, r.score) for r in got] == expected


PICK = (
    "as_of date, strategy string, entity_id string, reference_price double, weight double, "
    "features map<string,double>, run_id string, ordinal long"
)
DAY = dt.date(2026, 1, 5)


def picks(spark, rows):
    return spark.createDataFrame(
        [(d, s, e, p, w, {"a": 1.0}, "r", i) for i, (d, s, e, p, w) in enumerate(rows)], PICK
    )


def prices(spark, values):
    return spark.createDataFrame(list(values.items()), "entity_id string, price double")


def test_returns_quantiles_and_weights(spark):
    returns = [-0.20, 0.0, 0.10, 0.10, 0.20]
    rows = [(DAY, "screen", f"e{i}", 100.0, 0.2) for i in range(5)]
    rows += [(DAY, "agent", "e0", 100.0, 0.0), (DAY, "agent", "e1", None, 1.0)]
    forward = prices(spark, {f"e{i}": 100 * (1 + r) for i, r in enumerate(returns)})
    scored = E.score_picks(E.dedup_last(picks(spark, rows)), forward)
    for hot in (1, None):
        scores = {r.strategy: r for r in E.strategy_scores(scored, hot_rows=hot).collect()}
        s = scores["screen"]
        net = np.array(returns) - 0.04
        assert s.n_picks == s.n_scored == 5
        for name, p in (("p10", 10), ("p25", 25), ("median", 50), ("p75", 75), ("p90", 90)):
            assert abs(s[name] - np.percentile(net, p)) < 1e-12
        assert abs(s.stdev - net.std()) < 1e-12 and abs(s.hit_rate - 0.6) < 1e-12
        a = scores["agent"]
        assert (a.n_picks, a.n_scored, a.ungradeable) == (2, 0, 1) and a.portfolio_return is None
        assert a.note == E.NOTHING_GRADED


def test_last_duplicate_and_newest_vintage_win(spark):
    later = dt.date(2026, 2, 5)
    p = picks(spark, [
        (DAY, "screen", "a", 1.0, 1.0), (later, "screen", "a", 2.0, 1.0), (later, "screen", "a", 3.0, 1.0),
    ])
    got = E.dedup_last(E.scope_to_vintage(p)).collect()
    assert [(r.as_of, r.reference_price) for r in got] == [(later, 3.0)]
    assert E.scope_note(p).count() == 1
    assert E.scope_note(p, vintage="2026-01-05").count() == 0
    assert "no picks found" in E.scope_note(p, run_id="zz").first().note


def comparison(spark, agent, base, strategy="ev_ebit_decile"):
    rows = [(DAY, "agent", f"a{i}", 100.0, 1.0) for i in range(len(agent))]
    rows += [(DAY, strategy, f"b{i}", 100.0, 1.0) for i in range(len(base))]
    forward = {f"a{i}": 100 * (1 + r) for i, r in enumerate(agent)}
    forward |= {f"b{i}": 100 * (1 + r) for i, r in enumerate(base)}
    scored = E.score_picks(picks(spark, rows), prices(spark, forward))
    return E.compare_agent(E.strategy_scores(scored)).collect()[0]


@pytest.mark.parametrize(
    "agent, base, text",
    [
        ([0.1] * 3, [0.0] * 30, "insufficient evidence (agent N=3"),
        ([0.2] * 30, [0.1] * 30, "the agent beat ev_ebit_decile (mean +10.0%, median +10.0%)."),
        ([0.0] * 30, [0.1] * 30, "the agent did NOT beat the EV/EBIT decile"),
        ([-0.1] * 29 + [9.0], [0.0] * 30, "mixed vs ev_ebit_decile"),
    ],
)
def test_verdicts(spark, agent, base, text):
    assert comparison(spark, agent, base).verdict.startswith(text)


def test_tie_is_a_match_elsewhere(spark):
    assert comparison(spark, [0.1] * 30, [0.1] * 30, "screen").verdict.startswith("the agent matched")


def test_rules(spark):
    metric = "struct<value:double,ok:boolean,reason:string>"
    schema = (
        f"entity_id string, share_issuance {metric}, cash_runway_months {metric}, revenue double, "
        "period_end date, has_profile boolean, entity_type string, has_recent_late_filing boolean, "
        "name_changed_within_months int, has_former_names boolean"
    )
    rows = [
        ("ok", (0.2, True, None), (12.0, True, None), 5.0, DAY, True, "operating", False, 25, True),
        ("bad", (0.3, True, None), (11.9, True, None), 0.5, DAY, True, "", True, -1, True),
        ("thin", (None, False, "why"), (math.inf, True, None), None, DAY, False, None, None, None, False),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("checks", S.evaluate_excludes())
    got = {
        r.entity_id: {c.rule: (c.decision, c.reason) for c in r.checks} for r in df.collect()
    }
    decisions = lambda e: [v[0] for v in got[e].values()][:5]
    assert decisions("ok") == ["pass"] * 5
    assert decisions("bad") == ["exclude"] * 5
    assert decisions("thin") == ["insufficient_data", "pass", "insufficient_data", "insufficient_data", "pass"]
    assert got["thin"]["dilution"][1] == "why"
    assert [v[0] for v in got["ok"].values()][5:] == ["insufficient_data"] * 3
    flags = df.select(S.is_excluded(F.col("checks")).alias("x")).collect()
    assert [r.x for r in flags] == [False, True, False]
