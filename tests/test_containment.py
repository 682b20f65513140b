"""Quotes against many texts: nothing lost, and few pairs even where a company has very many filings."""

import random

import pytest
from pyspark.sql import functions as F

from tallystone import session
from tallystone.functions import text as T
from tallystone.operators import containment as C
from tallystone.operators import evidence as EV
from tallystone.session import materialize

WORDS = [a + b for a in "abcdefghij" for b in ("lorem", "ipsum", "dolor", "é", "ß9", "x")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".", " -"]) for _ in range(n))


@pytest.mark.parametrize("pairs", [0, 10**9])
def test_brief_findings_match_brute_force(spark, pairs, monkeypatch):
    """All scopes by postings, or all as they are."""
    monkeypatch.setattr(C.candidates, "__defaults__", (None, pairs))
    rng = random.Random(5)
    sources = [(f"r{i % 3}", f"s{i}", sentence(rng, 60)) for i in range(40)] + [("r0", "dup", "one-word"), ("r9", "alone", "nothing to see here")]
    findings = []
    for i in range(120):
        run, source, text = rng.choice(sources)
        words = text.split(" ")
        at = rng.randrange(max(1, len(words) - 12))
        quote = " ".join(words[at : at + rng.choice([2, 3, 5, 12])])
        kind = i % 6
        if kind == 1:
            quote = quote.upper().replace(" ", "  ")
        elif kind == 2:
            quote = " ".join([*quote.split(" ")[:-1], "invented"])
        elif kind == 3:
            quote = quote[2:-2]  # begins and ends inside words
        elif kind == 4:
            quote = " ".join(rng.sample(quote.split(" "), len(quote.split(" "))))
        findings.append((run, i, quote, source if i % 4 == 0 else "unknown"))
    s = spark.createDataFrame(sources, "run_id string, source string, text string")
    f = spark.createDataFrame(findings, "run_id string, finding_ordinal long, quoted_span string, source string")
    got = {r["finding_ordinal"]: r["verified"] for r in EV.verify_brief_findings(f, s).collect()}
    pairs_of = s.join(f.drop("source"), "run_id").select("finding_ordinal", "run_id", "source", "text", T.strip(F.col("quoted_span")).alias("q"))
    folded = EV.folded_texts(pairs_of.withColumn("split", F.lit(True))).withColumn("hit", (F.length("q") >= 12) & (
        F.contains("text", "q") | EV.folded_match(T.fold(F.col("q")), F.col("q"), F.col("folded"), F.col("tokens")).isNotNull()))
    want = {r["finding_ordinal"]: bool(r["hit"]) for r in folded.groupBy("finding_ordinal").agg(F.bool_or("hit").alias("hit")).collect()}
    assert got == want and 20 < sum(want.values()) < 110


def test_a_company_of_ten_thousand_filings(spark):
    """Stray quotes meet the filings that hold their rarest word, not all of them."""
    n = 10_000
    texts = spark.range(n).selectExpr(
        "'big' AS entity_id", "concat('A', id) AS accession",
        "concat('the annual report says that token', id, ' and token', id % 100, ' were  Sold in the year') AS text",
    )
    rows = [("big", i, f"says that token{i} AND token{i % 100} were", "unknown") for i in range(0, n, 20)]
    rows += [("big", n + i, f"says that token{i} and nothing of it", "unknown") for i in range(200)]
    rows += [("small", 1, "says that token1 and token1 were", "unknown")]
    findings = spark.createDataFrame(rows, "entity_id string, finding_ordinal long, quoted_span string, source_accession string")
    findings = findings.withColumns({c: F.lit("x") for c in ("category", "claim", "severity")})
    got = {r["finding_ordinal"]: r["reason"] for r in EV.verify_findings(findings, texts).where("entity_id = 'big'").collect()}
    assert len(got) == len(rows) - 1
    assert all(got[i].startswith("quote found but attributed") == (i < n) for i in got)
    stray = materialize(findings.where("entity_id = 'big'").select("entity_id", "finding_ordinal", T.fold(F.col("quoted_span")).alias("fq")), "stray")
    folded = EV.folded_texts(texts.withColumn("split", F.lit(False)))
    assert C.candidates(stray, folded, ["entity_id"], ["finding_ordinal"], "accession").count() < 4 * len(rows)


def test_folded_filings_are_stored_without_their_texts_and_read_once(spark):
    texts = spark.createDataFrame(
        [("c", "A1", "The notes   are convertible at will."), ("c", "A2", "Nothing else of any kind is here.")],
        "entity_id string, accession string, text string",
    )
    findings = spark.createDataFrame(
        [("c", 1, "the notes are convertible", "A1"), ("c", 2, "nothing ELSE of any kind", "A9"),
         ("c", 3, "Nothing else of any", "A2"), ("c", 4, "no filing holds this", "A9"), ("c", 5, "convertible the notes are", "A1")],
        "entity_id string, finding_ordinal long, quoted_span string, source_accession string",
    )
    checked = EV.verify_findings(findings, texts)
    got = {r.finding_ordinal: (r.verified, r.reason) for r in checked.collect()}
    assert got == {
        1: (True, "match after whitespace normalisation"),
        2: (False, "quote found but attributed to wrong/absent accession 'A9'"),
        3: (True, "exact match"),
        4: (False, "cited accession 'A9' not in evidence pack"),
        5: (True, "high token-overlap match"),
    }
    stored = [p for p in session.STORED if "/folded-" in p][-1]
    assert sorted(spark.read.parquet(stored).columns) == ["accession", "entity_id", "folded", "tokens"]
    scans = [line for line in checked._jdf.queryExecution().sparkPlan().toString().splitlines() if "FileScan" in line]
    assert len([line for line in scans if "folded#" in line]) == 1
