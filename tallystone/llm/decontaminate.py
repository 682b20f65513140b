"""Benchmark decontamination: an Aho-Corasick automaton over normalised benchmark windows.

Words are runs of digits, lower-cased letters a-z and all characters from U+0080 on. A text becomes
its words between single blanks, so that a window of ten words is one plain pattern and one pass
over the text finds every occurrence, overlapping ones included. Ends of matches are word numbers;
word numbers map back to code points of the original text.

Defined cases: null and empty texts have no words and no hits. Repeated rows and tied ids are
judged row by row. An item with no words hits nothing; an item without an id hits and is named
"null". An empty benchmark hits nothing. Other columns pass through untouched; the result is one
struct column whose name is free in the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import add_from_text, free_name, table
from tallystone.session import materialize

WINDOW = 10
# Characters of patterns in one automaton: about 50 bytes each in a Python worker.
BLOCK_CHARS = 4_000_000
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FIELDS = "n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start:bigint,end:bigint>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def blank_joined(words: list[bytes]) -> str:
    """One character for each byte, so that matching needs no decoding."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""


def windows_of(text: str | None, window: int = WINDOW) -> list[str]:
    words = words_of(text)
    if not words:
        return []
    return [blank_joined(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def pattern_blocks(benchmark: DataFrame, window: int, block_chars: int) -> Iterator[dict[str, set[str]]]:
    """Patterns with their item ids; the benchmark passes through the driver block by block."""
    block: dict[str, set[str]] = {}
    chars = 0
    for item in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        for pattern in windows_of(item[1], window):
            if pattern not in block:
                chars += len(pattern)
            block.setdefault(pattern, set()).add(item[0] or "null")
        if chars >= block_chars:
            yield block
            block, chars = {}, 0
    if block:
        yield block


def scanner(patterns: dict[str, set[str]]):
    automaton = ahocorasick.Automaton()
    for pattern, items in patterns.items():
        automaton.add_word(pattern, (pattern.count(" ") - 1, sorted(items)))
    if patterns:
        automaton.make_automaton()

    def scan(text: str | None) -> dict:
        words = words_of(text)
        found = list(automaton.iter(blank_joined(words))) if words and patterns else []
        if not found:
            return {"n_words": len(words), "n_hit": 0, "item_ids": [], "spans": []}
        ends = np.cumsum([len(w) + 1 for w in words])  # where the blank after each word stands
        change = np.zeros(len(words) + 1, dtype=np.int64)
        items: set[str] = set()
        last = np.searchsorted(ends, [end for end, _ in found]) + 1
        for stop, (_, (size, ids)) in zip(last.tolist(), found):
            change[stop - size] += 1
            change[stop] -= 1
            items.update(ids)
        hit = np.cumsum(change[:-1]) > 0
        places = [m.span() for m in WORD.finditer(text)]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        spans = [
            {"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())
        ]
        return {"n_words": len(words), "n_hit": int(hit.sum()), "item_ids": sorted(items), "spans": spans}

    return scan


def merged(text: str | None, old: dict, new: dict) -> dict:
    """Hits of two automata over one text."""
    spans: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in [*old["spans"], *new["spans"]]):
        if spans and (s[0] <= spans[-1][1] or not words_of(text[spans[-1][1] : s[0]])):
            spans[-1][1] = max(spans[-1][1], s[1])
        else:
            spans.append(list(s))
    return {
        "n_words": new["n_words"],
        "n_hit": sum(len(words_of(text[a:b])) for a, b in spans),
        "item_ids": sorted({*old["item_ids"], *new["item_ids"]}),
        "spans": [{"start": a, "end": b} for a, b in spans],
    }


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> tuple[DataFrame, str]:
    """Documents with a struct of hits, and the name of that column.

    One automaton normally holds the whole benchmark. A larger benchmark goes through in blocks of
    `block_chars` pattern characters; the hits of each block are joined with those before.
    """
    name = free_name(docs, "leaks")
    df = None
    for block in pattern_blocks(benchmark, window, block_chars):
        if df is None:
            df = _scan(docs, text_col, name, block)
        else:
            df = _rescan(materialize(df, "leaks"), text_col, name, block)
    return (_scan(docs, text_col, name, {}) if df is None else df), name


def _scan(docs: DataFrame, text_col: str, name: str, patterns: dict[str, set[str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def maker():
        scan = scanner(shared.value)
        return lambda texts: [scan(t) for t in texts]

    return add_from_text(docs, text_col, name, FIELDS, maker)


def _rescan(docs: DataFrame, text_col: str, name: str, patterns: dict[str, set[str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    pair = free_name(docs, "pair")
    with_pair = docs.withColumn(pair, F.struct(F.col(text_col).alias("text"), F.col(name).alias("old")))

    def maker():
        scan = scanner(shared.value)
        return lambda pairs: [merged(p["text"], p["old"], scan(p["text"])) for p in pairs]

    fresh = free_name(with_pair, "fresh")
    found = add_from_text(with_pair, pair, fresh, FIELDS, maker)
    return found.drop(pair, name).withColumnRenamed(fresh, name)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col(f"{name}.n_words").alias("n_words"),
        F.col(f"{name}.n_hit").alias("n_hit"),
        F.size(f"{name}.item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(f"{name}.item_ids")).cast("binary"), 256).alias("items_sha256"),
        (F.col(f"{name}.n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH letters AS (
  SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents, letters
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark, letters
), item_windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), doc_windows AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), met AS (
  SELECT rid, i, n, item FROM doc_windows JOIN item_windows USING (n, win)
), hit AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM met) GROUP BY rid
), named AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM met GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""
