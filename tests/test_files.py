"""Scans and sinks on real files."""

import json
import os

from pyspark.sql import functions as F

from tallystone.functions import columns as C
from tallystone.operators import archive as A
from tallystone.operators import calls as K
from tallystone.operators import reports as RP
from tallystone.session import fresh_path, spread
from tallystone.sources import listings as L


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        out.write(text)


def test_call_records_and_unreadable_files(spark):
    root = fresh_path(spark, "calls")
    usage = {"input_tokens": 1, "output_tokens": 2, "cached_input_tokens": 0, "reasoning_tokens": 0}
    body = {"text": "hi", "reasoning": None, "model": "gpt-5", "output_mode": "text", "usage": usage}
    put(f"{root}/ab/abc.json", json.dumps({"format_version": 1, "response": body}, indent=2))
    put(f"{root}/cd/cde.json", '{"format_version": 1, "resp')
    got = {r.key: r for r in K.read_calls(spark, root).collect()}
    assert got["abc"].usable and got["abc"].text == "hi" and got["abc"].usage.output_tokens == 2
    assert not got["cde"].usable


def test_report_tree(spark):
    root = fresh_path(spark, "reports")
    entry = {"entity_id": "1", "json": "1-a.json", "vetoed": False, "findings": 0}
    put(f"{root}/2026-07-01/run-x.json", json.dumps({"run_id": "x", "entries": [entry]}))
    put(f"{root}/2026-07-01/1-a.json", '{"entity_id": "1", "subject": "taken"}')
    put(f"{root}/2026-07-02/b.json", '{"subject": "Brief"}')
    put(f"{root}/2026-07-02/c.json", "not json")
    put(f"{root}/2026-07-02/c.md", "# text")
    entries, briefs = RP.tree_snapshot(RP.read_report_tree(spark, root))
    assert [(r.day, r.json, r.status, r.detail is not None) for r in entries.collect()] == [
        ("2026-07-01", "1-a.json", "done", True)
    ]
    assert [(r.day, r.json, r.subject) for r in briefs.collect()] == [("2026-07-02", "b.json", "Brief")]


def test_payload_files(spark):
    root = fresh_path(spark, "landing")
    put(f"{root}/sec/a.txt", "payload é")
    manifest = spark.createDataFrame([("d", "sec/a.txt"), ("e", "sec/none.txt")], "doc_id string, path string")
    row = A.read_payload_files(spark, root, manifest).select("doc_id", F.decode("content", "UTF-8").alias("t")).collect()
    assert [(r.doc_id, r.t) for r in row] == [("d", "payload é")]


def test_markdown_is_written_in_order(spark):
    lines = spark.createDataFrame(
        [(f"e{i % 3}", i % 5, 0, i, 0, f"e{i % 3}-{i % 5}-{i:03d}") for i in range(100)],
        "entity_id string, section int, part int, position long, line_no int, line string",
    )
    path = fresh_path(spark, "markdown")
    RP.write_markdown(lines, path)
    total = 0
    for i in range(3):
        folder = f"{path}/entity_id=e{i}"
        (part,) = [p for p in os.listdir(folder) if p.startswith("part")]  # one file a report
        written = open(f"{folder}/{part}").read().splitlines()
        assert written == sorted(written) and all(x.startswith(f"e{i}-") for x in written)
        total += len(written)
    assert total == 100


def test_manifest_filters_and_rejects_bad_lines(spark):
    root = fresh_path(spark, "manifest")
    good = '{"source":"%s","doc_id":"d","version":1,"content_sha256":"x","harvest_day":"2026-07-%s"}'
    put(f"{root}/m.jsonl", "\n".join([good % ("sec", "01"), good % ("sec", "05"), good % ("esef", "05")]))
    got = A.read_manifest(spark, root, source="sec", since="2026-07-02").collect()
    assert [str(r.harvest_day) for r in got] == ["2026-07-05"]
    put(f"{root}/m.jsonl", good % ("sec", "01") + "\n{broken")
    try:
        A.read_manifest(spark, root).collect()
    except Exception as error:
        assert "not a valid manifest record" in str(error)
    else:
        raise AssertionError("a broken line was accepted")


def test_think_tags_and_embedded_json(spark):
    df = spark.createDataFrame(
        [
            (1, "<think>a</think>x", None, "r", "r"),
            (2, "lead</think>y", None, None, None),
            (3, "z<think>cut", None, None, None),
            (4, "<think>only</think> ", None, None, None),
            (5, None, None, None, None),
        ],
        "i int, content string, reasoning_content string, reasoning string, thinking string",
    )
    got = {r.i: (r.content, r.reasoning, r.error) for r in K.split_reasoning(df).collect()}
    assert got == {
        1: ("x", "r\n\na", None),
        2: ("y", "lead", None),
        3: ("z", "cut", None),
        4: ("", "only", "reasoning_without_answer"),
        5: ("", None, "empty_response"),
    }
    texts = [
        '{"a": 1}', 'x ```json\n[1, 2]\n``` y', 'Sure {"note": "closes } maybe", "b": [1]} bye',
        "nothing", '<think>{"no": 1}</think> {"yes": 2}', "{bad} then [3]",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r.json_text for r in K.extract_json(rows).orderBy("i").collect()]
    assert got == [
        '{"a": 1}', "[1, 2]", '{"note": "closes } maybe", "b": [1]}', None, '{"yes": 2}', "[3]",
    ]


def test_prices_by_longest_prefix(spark):
    ids = ["gpt-5-mini-2026", "gpt-5", " Anthropic/Claude-Haiku-4-5-x", "ollama/z", "other"]
    df = spark.createDataFrame([(i,) for i in ids], "model string")
    got = [r[0] and r[0].input for r in df.select(K.price_of("model").alias("p")).collect()]
    assert got == [0.25, 1.25, 1.0, 0.0, None]


def test_small_functions(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first().x
    assert show(C.whole_months_between(F.lit("2026-01-31").cast("date"), F.lit("2026-02-28").cast("date"))) == 0
    assert str(show(C.shift_months(F.lit("2026-03-31").cast("date"), -1))) == "2026-02-28"
    assert show(C.slug(F.lit("--Ünï Co. & Sons!!"))) == "n-co-sons"
    assert show(C.slug(F.lit("***"))) == "entity"
    assert show(C.path_component(F.lit("a/b:c."))) == "a_b_c"
    assert show(C.split_forms(F.lit(" 10-K, ,8-K "))) == ["10-K", "8-K"]
    assert show(C.human_bytes(F.lit(1536))) == "1.5 KB"
    for value, text in ((1234567.0, "1.235e+06"), (0.00012346, "0.0001235"), (12.5, "12.5"), (100.0, "100"), (1e-7, "1e-07")):
        assert show(C.significant(F.lit(value))) in (text, f"{value:.4g}")
    assert show(C.accession_number(F.lit("000123456726000012"))) == "0001234567-26-000012"
    assert show(C.sector_of_sic(F.lit("x"))) == "unknown" and show(C.sector_of_sic(F.lit("6199"))) == "finance"


def test_scan_is_spread_only_when_it_has_few_splits(spark):
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide).rdd.getNumPartitions() == 64
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_limits_and_forms_of_search_pages(spark):
    page = {"hits": {"total": {"value": 2}, "hits": [
        {"_id": "a:x.htm", "_source": {"ciks": ["1"], "root_forms": ["10-K"]}},
        {"_id": "b:y.htm", "_source": {"ciks": [], "root_forms": ["8-K"]}},
    ]}}
    df = spark.createDataFrame([(json.dumps(page),), ("[]",)], "payload string")
    assert L.search_hits(df, limit=1).count() == 1
    assert [r.accession for r in L.search_hits(df, forms=["8-K"]).collect()] == ["b"]


def test_index_lines_are_parsed_once_whatever_filters_their_fields(spark):
    text = (
        "Form Type   Company\n---------\n10-K   A  Co   12   2026-07-21   edgar/data/12/0000000012-26-000001.txt\n"
        "garbage\n\n8-K   B Co   13   20261399   edgar/data/13/0000000013-26-000002.txt"
    )
    files = spark.createDataFrame([(1, text), (2, "nothing"), (3, "Form Type\n---\n")], "k int, text string")
    rows = L.parse_index(files, ["k"])
    got = sorted(((r.k, r.error or "", r.form_type, r.company, r.cik, r.file_name, r.ok) for r in rows.collect()), key=str)
    assert got == [
        (1, "", "10-K   A", "Co", "12", "edgar/data/12/0000000012-26-000001.txt", True),
        (1, "", "8-K", "B Co", "13", "edgar/data/13/0000000013-26-000002.txt", False),
        (1, "", None, None, None, None, False),
        (2, "no recognizable header", None, None, None, None, None),
        (3, "", None, None, None, None, None),
    ]
    plan = L.edgar_refs(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(L.INDEX_ROW[:24]) == 2
