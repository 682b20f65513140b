"""Licence scans: Dice coefficient over word bigrams against licence templates.

A text is compared whole, line by line, and sentence by sentence within lines (a sentence ends after
a stop, exclamation or question mark that white space follows). Words are runs of a-z and 0-9 after
lower-casing A-Z. With a and b bigrams and c in common, counted with repeats, the coefficient is
2c / (a + b), so it can reach the threshold t only if a and b differ by a factor of at most
(2 - t) / t: templates outside that bound are not compared. A template sorted by size needs one
bisection for each bound.

Defined cases: null and empty texts, and units or templates of fewer than two words, have no bigrams
and match nothing. The best match has the highest coefficient; ties go to the first licence id.
Repeated rows are judged row by row. An empty table gives no rows. Extra columns are left out.

`find_license_runs` compares full licence texts and notices with every run of consecutive words,
whatever the lines. A run's excess is 2c - t(a + b), at least zero from the threshold on. Runs are
taken by falling excess, each disjoint from those before, until no free run of words reaches the
threshold; so a text is given to the licence, and the version, that it fits best.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import add_from_text, free_name, table

THRESHOLD = 0.8

# Public licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Reserved", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
SENTENCE = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+")
FIELDS = "n_matches bigint, license_ids array<string>, best_license string, best_dice double"
TEXTS = Path(__file__).parent / "license_texts"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def units_of(text: str | None) -> list[list[bytes]]:
    """The words of the whole text, of each line and of each sentence; equal neighbours once."""
    out = [words_of(text or "")]
    for line in (text or "").split("\n"):
        whole = words_of(line)
        if len(whole) != len(out[0]):
            out.append(whole)
        parts = SENTENCE.split(line)
        out += [words_of(p) for p in parts] if len(parts) > 1 else []
    return out


def matcher(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> Callable[[str | None], dict]:
    known = []
    for license_id, text in templates:
        words = words_of(text or "")
        if len(words) > 1:
            known.append((len(words) - 1, license_id or "", Counter(zip(words, words[1:]))))
    known.sort(key=lambda x: x[:2])
    sizes = [size for size, _, _ in known]
    factor = (2 - threshold) / threshold

    def match(text: str | None) -> dict:
        found: list[tuple[float, str]] = []
        matches = 0
        for words in units_of(text):
            size = len(words) - 1
            if size < 1:
                continue
            low, high = bisect.bisect_left(sizes, size / factor - 1e-9), bisect.bisect_right(sizes, size * factor + 1e-9)
            if low >= high:
                continue
            pairs = Counter(zip(words, words[1:]))
            hits = []
            for other, license_id, template in known[low:high]:
                common = sum(min(n, pairs[p]) for p, n in template.items() if p in pairs)
                if (dice := 2 * common / (size + other)) >= threshold:
                    hits.append((dice, license_id))
            matches += bool(hits)
            found += hits
        if not found:
            return {"n_matches": 0, "license_ids": [], "best_license": None, "best_dice": None}
        best = min(found, key=lambda x: (-x[0], x[1]))
        return {"n_matches": matches, "license_ids": sorted({i for _, i in found}), "best_license": best[1], "best_dice": best[0]}

    return match


def find_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, text_col: str = "text", threshold: float = THRESHOLD
) -> tuple[DataFrame, str]:
    """Documents with a struct of matches, and the name of that column."""
    name = free_name(docs, "licenses")
    given = list(TEMPLATES if templates is None else templates)

    def maker():
        match = matcher(given, threshold)
        return lambda texts: [match(t) for t in texts]

    return add_from_text(docs, text_col, name, FIELDS, maker), name


def license_texts() -> list[tuple[str, str]]:
    """The notices above and those of the folder, and the full texts."""
    notices = [tuple(line.split("\t", 1)) for line in (TEXTS / "notices.tsv").read_text().splitlines()]
    return [*TEMPLATES, *notices, *((p.stem, p.read_text()) for p in sorted(TEXTS.glob("*.txt")))]


def run_matcher(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> Callable[[str | None], dict]:
    ids: dict[tuple[bytes, bytes], int] = {}
    known: list[tuple[int, str, dict[int, int]]] = []
    for license_id, text in templates:
        words = words_of(text or "")
        if len(words) > 1:
            pairs = Counter(zip(words, words[1:]))
            known.append((len(words) - 1, license_id or "", {ids.setdefault(p, len(ids)): n for p, n in pairs.items()}))
    holders: dict[int, list[tuple[int, int]]] = {}
    for t, (_, _, pairs) in enumerate(known):
        for p, n in pairs.items():
            holders.setdefault(p, []).append((t, n))
    share = threshold / (2 - threshold)

    def candidates(at: list[int], seq: list[int]) -> list[tuple]:
        """The best run from each start, for places `at` of known pairs `seq` within a free stretch."""
        common: dict[int, int] = {}
        for p, c in Counter(seq).items():
            for t, n in holders[p]:
                common[t] = common.get(t, 0) + min(c, n)
        out = []
        for t, c in common.items():
            size, license_id, quota = known[t]
            if c < share * size - 1e-9:  # a run that reaches the threshold holds that share of the template
                continue
            own = [k for k, p in enumerate(seq) if p in quota]
            pos, kind = np.array([at[k] for k in own]), [seq[k] for k in own]
            before, rank = Counter(), []
            for p in kind:
                rank.append(before[p])
                before[p] += 1
            number = {p: i for i, p in enumerate(dict.fromkeys(kind))}
            num, rank = np.array([number[p] for p in kind]), np.array(rank)
            end_of = np.array([quota[p] for p in number])  # ranks below this one count
            stop = np.searchsorted(pos, pos + size / share + 1e-6, "left")
            for i in range(len(pos)):
                if stop[i] - i >= share * size - 1e-9:
                    cut = slice(i, stop[i])
                    held = np.cumsum(rank[cut] < end_of[num[cut]])
                    long = pos[cut] - pos[i] + 1
                    excess = 2 * held - threshold * (long + size)
                    k = int(np.argmax(excess))
                    if excess[k] >= -1e-9:
                        out.append((-float(excess[k]), int(pos[i]), int(pos[i + k]) + 1, license_id, float(2 * held[k] / (long[k] + size))))
                end_of[num[i]] += 1
        return out

    def match(text: str | None) -> dict:
        words = words_of(text or "")
        get = ids.get
        pairs = [(k, p) for k, w in enumerate(zip(words, words[1:])) if (p := get(w)) is not None]
        taken: list[tuple] = []
        todo = [pairs] if pairs else []
        while todo:
            stretch = todo.pop()
            chosen: list[tuple[int, int]] = []
            for run in sorted(candidates([k for k, _ in stretch], [p for _, p in stretch])):
                # A run of n pairs has n + 1 words, so runs that share a word share or touch a pair.
                at = bisect.bisect_left(chosen, (run[1], run[2]))
                if (at == 0 or chosen[at - 1][1] < run[1]) and (at == len(chosen) or run[2] < chosen[at][0]):
                    chosen.insert(at, (run[1], run[2]))
                    taken.append(run)
            if chosen:
                edges = [-1, *(x for a, b in chosen for x in (a - 1, b)), len(words)]
                for low, high in zip(edges[::2], edges[1::2]):
                    a, b = (bisect.bisect_left(stretch, (x,)) for x in (low + 1, high))
                    if a < b:
                        todo.append(stretch[a:b])
        if not taken:
            return {"n_matches": 0, "license_ids": [], "best_license": None, "best_dice": None}
        best = min(taken, key=lambda x: (-x[4], x[0], x[3]))
        return {"n_matches": len(taken), "license_ids": sorted({x[3] for x in taken}), "best_license": best[3], "best_dice": best[4]}

    return match


def find_license_runs(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, text_col: str = "text", threshold: float = THRESHOLD
) -> tuple[DataFrame, str]:
    """Documents with a struct of matching runs, and the name of that column."""
    name = free_name(docs, "licenses")
    given = license_texts() if templates is None else list(templates)

    def maker():
        match = run_matcher(given, threshold)
        return lambda texts: [match(t) for t in texts]

    return add_from_text(docs, text_col, name, FIELDS, maker), name


def op7_license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = find_license_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col(f"{name}.n_matches").alias("n_matches"),
        F.array_join(f"{name}.license_ids", ",").alias("license_ids"),
        F.col(f"{name}.best_license").alias("best_license"),
        F.col(f"{name}.best_dice").alias("best_dice"),
    )


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col(f"{name}.n_matches").alias("n_matches"),
        F.array_join(f"{name}.license_ids", ",").alias("license_ids"),
        F.col(f"{name}.best_license").alias("best_license"),
        F.col(f"{name}.best_dice").alias("best_dice"),
    )


def _sql() -> str:
    rows = ",\n    ".join("({}, {}, '{}')".format(i, f"'{k}'", t.replace("'", "''")) for i, (k, t) in enumerate(TEMPLATES))
    return rf"""
WITH templates(tid, license_id, text) AS (VALUES
    {rows}
), upper_lower AS (
  SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l
), texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT rid, text, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT rid, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM texts)
), pieces AS (
  SELECT rid, i, string_split(regexp_replace(line, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM lines
), units AS (
  SELECT rid, 0 AS i, 0 AS j, text AS unit FROM texts
  UNION ALL
  SELECT rid, i, 0, line FROM lines
  UNION ALL
  SELECT rid, i, j, parts[j] FROM (SELECT rid, i, parts, unnest(range(1, len(parts) + 1)) AS j FROM pieces WHERE len(parts) > 1)
), worded AS (
  SELECT rid, i, j, regexp_extract_all(translate(unit, u, l), '[a-z0-9]+') AS w FROM units, upper_lower
), counted AS (
  SELECT x.rid, x.i, x.j, x.w, len(x.w) - 1 AS size
  FROM worded x JOIN (SELECT rid, len(w) AS n FROM worded WHERE i = 0) whole USING (rid)
  WHERE len(x.w) > 1 AND (x.i = 0 OR x.j > 0 OR len(x.w) <> whole.n)
), template_words AS (
  SELECT tid, license_id, regexp_extract_all(translate(text, u, l), '[a-z0-9]+') AS w FROM templates, upper_lower
), template_pairs AS (
  SELECT tid, license_id, size, p, count(*) AS n FROM (
    SELECT tid, license_id, len(w) - 1 AS size, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS p
    FROM template_words) GROUP BY ALL
), unit_pairs AS (
  SELECT rid, i, j, size, p, count(*) AS n FROM (
    SELECT rid, i, j, size, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS p
    FROM counted) GROUP BY ALL
), compared AS (
  SELECT rid, i, j, tid, license_id, 2 * sum(least(a.n, b.n)) / (a.size + b.size) AS dice
  FROM unit_pairs a JOIN template_pairs b USING (p) GROUP BY rid, i, j, tid, license_id, a.size, b.size
), hits AS (
  SELECT * FROM compared WHERE dice >= 0.8
), summed AS (
  SELECT rid, count(DISTINCT (i, j)) AS n_matches, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS license_ids,
         arg_min(license_id, (-dice, license_id)) AS best_license, max(dice)::DOUBLE AS best_dice
  FROM hits GROUP BY rid
)
SELECT doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(license_ids, '') AS license_ids, best_license, best_dice
FROM texts LEFT JOIN summed USING (rid)
"""


OP7_SQL = _sql()
