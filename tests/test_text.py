"""Text operators against plain Python on whole texts."""

import random
import re

from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions import text as T
from tallystone.operators import evidence as EV


def brute_excerpts(text):
    out = []
    for category, pattern in V.RED_FLAG_PATTERNS:
        taken = []
        for m in re.finditer(pattern, text, re.I):
            start = max(0, m.start() - 250)
            if len(taken) < 4 and all(abs(start - s) >= 900 for s in taken):
                taken.append(start)
                out.append((category, start, text[start : m.end() + 500].strip()))
    return out


def test_excerpts_match_brute_force(spark):
    rng = random.Random(3)
    phrases = [
        "going concern", "Substantial Doubt", "convertible", "lowest reported trading price",
        "reverse split", "related parties", "dilution", "ATM offering", "material weakness",
        "SEC\n subpoena", "\n", "dismissed its former auditor", "é ü ß words", "plain words here",
    ]
    texts = ["", "convertible", "x" * 5000]
    for size in (5, 60, 400):
        texts += [" ".join(rng.choice(phrases) + " " + "w" * rng.randint(1, 90) for _ in range(size)) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", T.excerpts(F.col("t")).alias("e")).collect():
        assert [(x.category, x.char_start, x.text) for x in r.e] == brute_excerpts(texts[r.i])


def test_excerpts_with_alike_letters_marks_and_many_matches(spark):
    texts = [
        "\u017fub\u017ftantial doubt. loo\u212a-bac\u212a. " * 3,
        "marks \ue0a0 of \ue0a1 the text, then dilution " + "\ue0a1" * 300 + " shares issued " + "w" * 900 + " dilutive",
        "related parties " * 4000,
        "a DILUTION of dilution" + "x" * 880 + "dilution " + "equity line" * 2,
        "dismissed without anyone. lowest of all.",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", T.excerpts(F.col("t")).alias("e")).collect():
        got = None if r.e is None else [(x.category, x.char_start, x.text) for x in r.e]
        assert (got or []) == brute_excerpts(texts[r.i] or ""), r.i


def test_every_match_of_a_pattern_holds_a_stem():
    samples = {c: re.sub(r"\.\{0,\d+\}", " any text ", p.replace("'?", "'")) for c, p in V.RED_FLAG_PATTERNS}
    for category, pattern in samples.items():
        for branch in re.split(r"\|(?![^(]*\))", pattern):
            options = [""]
            for piece in re.findall(r"\([^)]*\)\??|.\??", branch):
                optional = piece.endswith("?")
                inner = piece.rstrip("?")
                words = inner[1:-1].split("|") if inner.startswith("(") else [inner]
                options = [o + w for o in options for w in words + [""] * optional]
            for text in options:
                assert re.search(dict(V.RED_FLAG_PATTERNS)[category], text, re.I), (category, text)
                assert any(s in text.lower() for s in T.RED_FLAG_STEMS[category]), (category, text)


def test_anonymize_whole_words_longest_first(spark):
    df = spark.createDataFrame(
        [("CONC warns of going concern. Conc Corp (CONC) says conc corp.", "Conc Corp", ["CONC", "ZZ"])],
        "t string, n string, k array<string>",
    )
    got = df.select(T.anonymize(F.col("t"), T.redactions(F.col("n"), F.col("k")))).first()[0]
    assert got == "[TICKER] warns of going concern. [COMPANY] ([TICKER]) says [COMPANY]."


def test_html(spark):
    html = "<STYLE>p{}</STYLE><script>x<y</script><p>A&nbsp;&amp;&#8217;B&#160;&#123;C&copy;</p>\n D"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(T.html_to_text(F.col("h"))).first()[0] == "A &'B C D"


def test_quote_ladder(spark):
    texts = spark.createDataFrame(
        [("e", "A1", "The company is in default, on its senior notes."), ("e", "A2", "Other text entirely.")],
        "entity_id string, accession string, text string",
    )
    rows = [
        (1, "is in default, on its", "A1"),
        (2, "IS IN  DEFAULT,\non its", "A1"),
        (3, "company in default on the senior notes", "A1"),
        (4, "default", "A1"),
        (5, "a fabricated sentence", "A1"),
        (6, "Other text entirely", "A9"),
        (7, "never said anywhere", "A9"),
    ]
    findings = spark.createDataFrame(
        [("e", i, "dilution", "c", q, a, "high") for i, q, a in rows],
        "entity_id string, finding_ordinal long, category string, claim string, quoted_span string, "
        "source_accession string, severity string",
    )
    got = {r.finding_ordinal: (r.verified, r.reason) for r in EV.verify_findings(findings, texts).collect()}
    assert got == {
        1: (True, "exact match"),
        2: (True, "match after whitespace normalisation"),
        3: (True, "high token-overlap match"),
        4: (False, "quote too short to verify (7 chars)"),
        5: (False, "quote not found in cited filing"),
        6: (False, "quote found but attributed to wrong/absent accession 'A9'"),
        7: (False, "cited accession 'A9' not in evidence pack"),
    }


def test_prompt_uses_whole_text_or_excerpts(spark):
    long_flag = "going concern " + "x " * 7000
    texts = spark.createDataFrame(
        [("e", "A1", "short text", 1), ("e", "A2", long_flag, 2), ("e", "A3", "y " * 7000, 3)],
        "entity_id string, accession string, text string, place int",
    )
    blocks = {r.place: r.block for r in EV.render_filings(texts).collect()}
    assert blocks[1] == "=== FILING A1 ===\nshort text"
    assert blocks[2].startswith("=== FILING A2 ===\n[excerpt: going_concern]\ngoing concern")
    assert blocks[3].startswith("=== FILING A3 ===\n[text truncated for length]\ny y")


def test_case_folding_equals_python(spark):
    texts = ["ΑΣ ΣΑΣ", "Straße ẞ", "ﬁne ﬄ ﬅ", "ſharp", "İstanbul", "ΐ ŉ ǰ", "plain Text"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.f for r in df.select(T.case_folded(F.col("t")).alias("f")).collect()] == [t.casefold() for t in texts]


def test_deeply_nested_answer_is_no_answer(spark):
    from tallystone.operators import calls as K

    texts = ["[" * 100_000, "see {\"a\": 1} here", "{bad {\"b\": [1, 2]} x", "[" * 5000 + "]" * 5000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.json_text for r in K.extract_json(df).collect()}
    assert got[0] is None and got[1] == '{"a": 1}' and got[2] == '{"b": [1, 2]}' and got[4] is None


def test_underscores_stand_between_digits(spark):
    from tallystone.sources.facts import numeric_text

    texts = ["1_000", "1__0", "1_", "_1", "1_0.5_0", "1._5", "1e1_0", " 7 ", "nan", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def python(t):
        try:
            return float(t)
        except ValueError:
            return None

    got = [r.v for r in df.select(numeric_text(F.col("t")).alias("v")).collect()]
    assert [str(g) for g in got] == [str(python(t)) for t in texts]
