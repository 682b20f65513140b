"""Exact removal of lines that earlier documents hold, in DataFrame functions only.

A line's key is the line without white space at its ends and with A-Z in lower case. Keys of at
least MIN_CHARS code points found in two documents or more lose their lines in all but the smallest
document id. The result is not text but, for each document, a run-length compressed keep bitmap:
`keep_runs` holds the lengths of runs of kept and dropped lines in turn, beginning with kept ones.
`apply_bitmap` turns a text and its bitmap into the lines that stay.

Texts are read once into a narrow stored table: place and 128-bit hash of each long enough key.
These rows are range-partitioned by hash and sorted within their range by (hash, document, place);
one window streams over each range in that order, the first row of a hash being its first occurrence
and every row of another document a drop. The range exchange already clusters the hashes, so the
window needs no second one.

Balance: a key that very many documents hold would fill one range. One row in SAMPLE (by a hash of
document and text, so the same at each run) tells which keys those are: above 1 / MOST_HOT of the
sampled rows, so fewer than MOST_HOT keys, small enough to broadcast at any size. Their first
document is the minimum over all rows, combined before the shuffle, and their rows are settled where
they are read. The sample decides only which of two exact ways a key takes.

Defined cases: null text is one empty line. Rows of one doc_id are one document; null ids are one
document before all others. Repeated rows get the same bitmap. Two texts under one id keep the lines
they share. An empty table gives no rows. Other columns, of any name, pass through `dedup_lines` and
are not read elsewhere. A very long text is one row of hashes, 20 bytes a line; its work is linear.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.llm.common import free_name, table
from tallystone.session import materialize

MIN_CHARS = 10
SAMPLE, MOST_HOT, LEAST_HOT = 32, 65_536, 32
NO_ID = -(1 << 63)
SPACE = " \t\n\x0b\x0c\r"


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(lines: Column) -> Column:
    """Only A-Z change: lower() does the same to a line of one-byte characters, and faster."""
    bare = F.transform(lines, lambda x: F.trim(x, F.lit(SPACE)))
    return F.transform(
        bare,
        lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(
            F.translate(x, ascii_uppercase, ascii_lowercase)
        ),
    )


def document_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells documents, and texts under one id, apart."""
    return F.coalesce(F.col(id_col), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def key_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Rows (doc, text_hash, n_lines, keys), keys being (place, h1, h2) of each long enough line."""
    doc, text_hash = document_keys(id_col, text_col)
    keyed = docs.select(doc.alias("doc"), text_hash.alias("text_hash"), line_keys(line_array(F.col(text_col))).alias("lines"))
    hashed = F.transform(
        "lines",
        lambda key, i: F.when(
            F.char_length(key) >= min_chars,
            F.struct(i.alias("place"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")),
        ),
    )
    return keyed.select("doc", "text_hash", F.size("lines").alias("n_lines"), F.filter(hashed, lambda x: x.isNotNull()).alias("keys"))


def hot_keys(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys above 1 / MOST_HOT of the sampled rows, with the first document of each."""
    sampled = F.pmod(F.xxhash64("doc", "text_hash"), F.lit(SAMPLE)) == 0
    total = texts.where(sampled).agg(F.sum(F.size("keys"))).first()[0] or 0
    counts = rows.where(sampled).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    candidates = counts.where(F.col("n") > max(LEAST_HOT, total // MOST_HOT)).select("h1", "h2")
    firsts = rows.join(F.broadcast(candidates), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    return materialize(firsts, "hot_lines")


def dropped_lines(texts: DataFrame) -> DataFrame:
    """Rows (doc, text_hash, place) of the lines that go."""
    rows = texts.select("doc", "text_hash", F.inline("keys"))
    hot = hot_keys(texts, rows)
    settled = rows.join(F.broadcast(hot), ["h1", "h2"], "left")
    ranges = settled.where(F.col("first").isNull()).drop("first").repartitionByRange("h1", "h2")
    in_order = Window.partitionBy("h1", "h2").orderBy("doc", "place").rowsBetween(Window.unboundedPreceding, 0)
    streamed = ranges.withColumn("first", F.first("doc").over(in_order))
    both = settled.where(F.col("first").isNotNull()).unionByName(streamed)
    return both.where(F.col("doc") != F.col("first")).select("doc", "text_hash", "place")


def run_lengths(dropped: DataFrame) -> DataFrame:
    """Sorted places to runs of kept and dropped lines in turn; the last run is kept lines."""
    at = lambda name, i: F.get(F.col(name), i)
    edges = dropped.withColumns(
        {
            "begins": F.filter("places", lambda x, i: F.coalesce(at("places", i - F.lit(1)), F.lit(-2)) != x - 1),
            "ends": F.filter("places", lambda x, i: F.coalesce(at("places", i + F.lit(1)), F.lit(-2)) != x + 1),
        }
    )
    pairs = F.transform(
        "begins",
        lambda x, i: F.array(x - F.coalesce(at("ends", i - F.lit(1)) + 1, F.lit(0)), at("ends", i) - x + 1),
    )
    tail = F.col("n_lines") - 1 - F.element_at("ends", -1)
    return edges.withColumn("keep_runs", F.concat(F.flatten(pairs), F.array(tail))).drop("begins", "ends", "places")


def bitmaps_with_drops(texts: DataFrame) -> DataFrame:
    """Rows (doc, text_hash, n_dropped, keep_runs), for documents that lose a line. The key is unique."""
    lists = dropped_lines(texts).groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("places"))
    sizes = texts.groupBy("doc", "text_hash").agg(F.max("n_lines").alias("n_lines"))
    lists = lists.join(sizes, ["doc", "text_hash"]).withColumn("n_dropped", F.size("places").cast("long"))
    return run_lengths(lists).select("doc", "text_hash", "n_dropped", "keep_runs")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row a document: its id, text hash, numbers of lines, and the keep bitmap."""
    texts = materialize(key_table(docs, id_col, text_col, min_chars), "line_keys")
    found = bitmaps_with_drops(texts)
    all_kept = F.array("n_lines")
    return texts.drop("keys").join(found, ["doc", "text_hash"], "left").select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"),
        "text_hash",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.coalesce("keep_runs", all_kept).alias("keep_runs"),
    )


def apply_bitmap(lines: Column, runs: Column) -> Column:
    """The lines that stay, joined; `lines` and `runs` belong together."""
    mask = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    zipped = F.arrays_zip(lines.alias("line"), mask.alias("kept"))
    return F.array_join(F.transform(F.filter(zipped, lambda x: x["kept"]), lambda x: x["line"]), "\n")


def joined(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, str, str]:
    """Documents beside their bitmaps; the names of (number dropped, runs), null where no line goes."""
    texts = materialize(key_table(docs, id_col, text_col, min_chars), "line_keys")
    names = {c: free_name(docs, f"lines_{c}") for c in ("doc", "text_hash", "n_dropped", "keep_runs")}
    found = bitmaps_with_drops(texts).select(*[F.col(c).alias(n) for c, n in names.items()])
    doc, text_hash = document_keys(id_col, text_col)
    on = (doc == F.col(names["doc"])) & (text_hash == F.col(names["text_hash"]))
    # Bitmaps are small and unique by key: hashing them spares sorting the texts.
    out = docs.join(found.hint("shuffle_hash"), on, "left").drop(names["doc"], names["text_hash"])
    return out, names["n_dropped"], names["keep_runs"]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All documents and columns, repeated lines cut from the text."""
    out, _, runs = joined(docs, id_col, text_col, min_chars)
    kept = F.when(F.col(runs).isNull(), F.col(text_col)).otherwise(apply_bitmap(line_array(F.col(text_col)), F.col(runs)))
    return out.withColumn(text_col, kept).select(*docs.columns)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, dropped, runs = joined(docs, "doc_id", "text", MIN_CHARS)
    out = out.withColumn("lines", line_array(F.col("text")))
    kept = F.when(F.col(runs).isNull(), F.coalesce("text", F.lit(""))).otherwise(apply_bitmap(F.col("lines"), F.col(runs)))
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


OP11_SQL = r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS doc,
         string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS MATERIALIZED (
  SELECT rid, doc, i, lines[i] AS line,
         translate(trim(lines[i], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc, lines, unnest(range(1, len(lines) + 1)) AS i FROM texts)
), firsts AS (
  SELECT key, min(doc) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc) > 1
), marked AS (
  SELECT rid, i, line, coalesce(doc <> first, false) AS dropped FROM lines LEFT JOIN firsts USING (key)
), kept AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
  FROM marked GROUP BY rid
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, kept_sha256
FROM texts JOIN kept USING (rid)
"""
