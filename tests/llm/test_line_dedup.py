"""Line dedup against its plain version, on awkward rows and on keys that many documents hold."""

import random
from collections import Counter

import pytest

from tallystone.llm import line_dedup
from tallystone.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.data import DOC_SCHEMA, documents, sentence, write

NAMES = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def awkward():
    rng = random.Random(11)
    shared = [sentence(rng, 6) for _ in range(5)]
    texts = [
        (1, "\n".join(shared)),
        (2, f"  {shared[0].upper()}\t\nown line of two\n\n{shared[1]}\x0b"),
        (3, "\n\n\n"),
        (3, f"{shared[2]}\n{shared[2]}"),  # one id, two texts
        (4, "ÄÖÜ straße zehn\nÄöÜ straße zehn\näÖÜ STRASSE ZEHN"),
        (5, "ÄÖÜ STRAße zehn\nshort one\nshort one"),
        (6, "short one\nten chars.\n"),
        (7, "Ten Chars.\n漢字漢字漢字漢字漢字\n𝒳𝒳𝒳𝒳𝒳"),
        (8, "漢字漢字漢字漢字漢字\n𝒳𝒳𝒳𝒳𝒳\x85"),
        (None, shared[3] + "\nno id at all"),
        (9, "no id at all \nno id at all"),
        (10, "\r\n".join(shared + ["tail of ten"] + shared)),
        (11, None), (12, ""), (12, ""),
        (13, "\n".join(sentence(rng, 5) for _ in range(60_000))),  # a text of 3 MB
    ]
    texts.append((14, texts[-1][1] + "\nlast of the long"))
    return texts


@pytest.mark.parametrize("least_hot", [line_dedup.LEAST_HOT, 0])
def test_op11_matches_brute_force(spark, tmp_path, least_hot, monkeypatch):
    """With no least number, every sampled key is hot."""
    monkeypatch.setattr(line_dedup, "LEAST_HOT", least_hot)
    monkeypatch.setattr(line_dedup, "SAMPLE", 2)
    docs = awkward() + [(100 + r[0] if r[0] is not None else None, r[1]) for r in documents()]
    write(spark, str(tmp_path), [(d, t, None, None, None) for d, t in docs], extra=True)
    got = QUERIES["op11_line_dedup"](spark, str(tmp_path)).select(*NAMES).collect()
    assert Counter(map(tuple, got)) == Counter(brute.line_drops(docs))


def test_bitmaps_and_texts_agree(spark):
    docs = awkward()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS lines_doc", "2 AS doc", "3 AS first", "4 AS keys")
    bitmaps = line_dedup.keep_bitmaps(df).collect()
    want = brute.line_drops(docs)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in bitmaps) == Counter(w[:3] for w in want)
    for r in bitmaps:
        runs = r["keep_runs"]
        assert sum(runs) == r["n_lines"] and sum(runs[1::2]) == r["n_dropped"] and min(runs[1:], default=1) >= 0
        assert all(n > 0 for n in runs[1:-1])
    texts = line_dedup.dedup_lines(df)
    assert texts.columns == df.columns
    got = Counter((r["doc_id"], brute.sha(r["text"] or "")) for r in texts.collect())
    assert got == Counter((w[0], w[3]) for w in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOC_SCHEMA)
    assert line_dedup.keep_bitmaps(df).count() == 0 and line_dedup.dedup_lines(df).count() == 0


def test_plan_has_no_python_and_one_range_exchange(spark):
    df = spark.range(50).selectExpr("id AS doc_id", "repeat('a line of text\n', 3) AS text")
    texts = line_dedup.materialize(line_dedup.key_table(df, "doc_id", "text", 10), "keys")
    plan = line_dedup.dropped_lines(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    below = plan.split("Window [")[1]
    assert "Exchange rangepartitioning(h1" in below and "hashpartitioning" not in below
