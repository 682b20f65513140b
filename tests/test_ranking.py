import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.operators import ranking
from tallystone.operators.ranking import group_percentiles, with_rank


def _rows():
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{i % 17}"
        value = 120.0 if i % 5 == 0 else round(rng.gauss(0, 50), 3)
        rows.append((None if i % 101 == 0 else key, value, i))
    return rows


@pytest.mark.parametrize("range_rows", [20, 1_000_000])
def test_rank_is_exact_on_both_paths(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ranking, "RANGE_ROWS", range_rows)
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, v double, id long")
    expected = {}
    by_key = {}
    for k, v, i in rows:
        by_key.setdefault(k, []).append((v, i))
    for k, members in by_key.items():
        for n, (_, i) in enumerate(sorted(members), start=1):
            expected[i] = n
    for hot in (1, 100, 10**9):
        got = {
            r.id: r.row_rank
            for r in with_rank(df, ["k"], [F.col("v"), F.col("id")], hot_rows=hot).collect()
        }
        assert got == expected


@pytest.mark.parametrize("range_rows", [30, 1_000_000])
def test_global_rank(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ranking, "RANGE_ROWS", range_rows)
    df = spark.createDataFrame(_rows(), "k string, v double, id long")
    got = with_rank(df, [], [-F.col("v"), F.col("id")]).orderBy("row_rank").collect()
    assert [r.row_rank for r in got] == list(range(1, 3001))
    assert [(-r.v, r.id) for r in got] == sorted((-r.v, r.id) for r in got)


def test_percentiles_are_equal_to_the_bit_on_both_paths(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 50)
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, v double, id long")
    by_key = {}
    for k, v, _ in rows:
        by_key.setdefault(k, []).append(v)
    probs = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    first = None
    for hot in (1, 100, 10**9):
        got = {r.k: r for r in group_percentiles(df, ["k"], "v", probs, hot_rows=hot).collect()}
        assert set(got) == set(by_key)
        first = first or got
        assert got == first
        for k, values in by_key.items():
            for name, p in probs.items():
                assert abs(got[k][name] - np.percentile(values, p * 100)) < 1e-9
