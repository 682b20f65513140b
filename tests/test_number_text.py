"""Numbers as text against Python's own formatting, ties included."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallystone.functions import columns as C
from tallystone.functions import number_text as N


def numbers():
    rng = random.Random(8)
    out = [k / 2**b for b in range(0, 12) for k in range(1, 400, 2)]  # ties at every digit
    out += [k + h for k in range(0, 40) for h in (0.5, 0.25, 0.125, 0.375, 0.0625, 0.005, 0.015, 0.045)]
    out += [rng.uniform(0, 10.0**rng.randint(-18, 18)) for _ in range(4000)]
    out += [round(rng.uniform(0, 1000), d) for d in range(5) for _ in range(400)]  # short decimal texts
    out += [(2 * rng.randint(10**3, 10**4) + 1) * 10.0**e / 2 for e in range(0, 14) for _ in range(60)]
    out += [10.0**k for k in range(-20, 38)] + [math.nextafter(10.0**k, s) for k in range(-12, 19) for s in (0, 1e300)]
    out += [9999.5, 9999.49999, 99995.0, 0.99995, 0.000099995, 0.00009999499, 2.0**53, 2.0**62, 2.0**63, 1e22, 1e23, 9.87654321e36, 1e-300]
    out += [0.0, math.nan, math.inf]
    return out + [-x for x in out]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(x,) for x in numbers()] + [(None,)], "x double").repartition(4)


CASES = {
    "f0": (lambda x: N.fixed(x, 0), lambda x: f"{x:.0f}"),
    "f1": (lambda x: N.fixed(x, 1), lambda x: f"{x:.1f}"),
    "f2": (lambda x: N.fixed(x, 2), lambda x: f"{x:.2f}"),
    "f4": (lambda x: N.fixed(x, 4), lambda x: f"{x:.4f}"),
    "f15": (lambda x: N.fixed(x, 15), lambda x: f"{x:.15f}"),
    "grouped": (lambda x: N.fixed(x, 0, grouped=True), lambda x: f"{x:,.0f}"),
    "grouped1": (lambda x: N.fixed(x, 1, grouped=True), lambda x: f"{x:,.1f}"),
    "percent": (lambda x: N.percent(x), lambda x: f"{x * 100:.0f}%"),
    "signed": (lambda x: C.signed_percent(x), lambda x: f"{x * 100:+.1f}%"),
}


@pytest.mark.parametrize("name", CASES)
def test_fixed_equals_python(table, name):
    ours, python = CASES[name]
    rows = table.select("x", ours(F.col("x")).alias("shown")).collect()
    assert len(rows) > 10_000
    wrong = [(r["x"], r["shown"], python(r["x"])) for r in rows if r["x"] is not None and abs(r["x"] * 100) != 1e39 and python(r["x"]) != r["shown"]
             and (not math.isfinite(r["x"]) or abs(r["x"]) < 1e34)]
    assert not wrong, (len(wrong), wrong[:5])
    assert [r["shown"] for r in rows if r["x"] is None] == [None]


@pytest.mark.parametrize("digits", [4, 1, 6])
def test_significant_equals_python(table, digits):
    rows = table.select("x", N.significant(F.col("x"), digits).alias("shown")).collect()
    wrong = [(r["x"], r["shown"], f"{r['x']:.{digits}g}") for r in rows if r["x"] is not None and f"{r['x']:.{digits}g}" != r["shown"]
             and (not math.isfinite(r["x"]) or r["x"] == 0 or N.SMALLEST <= abs(r["x"]) <= N.LARGEST)]
    assert not wrong, (len(wrong), wrong[:5])


def test_shown_numbers_of_rules_and_sizes(spark):
    rows = spark.createDataFrame([(0.625, 2560), (0.375, 1280 * 1024), (2.5, 100)], "rate double, size long")
    got = rows.select(N.percent(F.col("rate")).alias("p"), C.human_bytes("size").alias("b"), C.metric_display("rate", F.lit("pct")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("62%", "2.5 KB", "+62.5%"), ("38%", "1.2 MB", "+37.5%"), ("250%", "100 B", "+250.0%")]
