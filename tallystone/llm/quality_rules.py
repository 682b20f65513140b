"""Quality rules with cross-document line frequency, in DataFrame functions only.

Every text is read once into a narrow stored table: counts for the base rules, and a hash and the
number of words of each line that has a word. Lines are normalised first (lower case, runs of white
space as one blank, runs of digits as one 0). A line is boilerplate of its host when at least
MIN_DOCS distinct documents of the host hold it and they are at least MIN_SHARE of the host's
distinct documents. Equal texts are one document in these counts, so that copies of one article
don't make its lines boilerplate. A document whose boilerplate takes more than MAX_REMOVED of its
words is depleted and rejected; otherwise only the lines go.

Counts are grouped by (host, line, text) and then by (host, line), both combined before the
shuffle, so neither a hot host nor a hot line meets in one task; the few boilerplate lines join back
by adaptive execution.

Defined cases: null text counts as empty, which fails the base rules; a null host is a host of its
own. Repeated rows and tied ids are judged alike. An empty table gives no rows. Extra columns pass
through `clean_documents` untouched and are not read elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import free_name, table
from tallystone.session import materialize

MIN_DOCS, MIN_SHARE, MAX_REMOVED = 20, 0.05, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def line_hash(line: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(line), SPACES, " "))
    return F.xxhash64(F.regexp_replace(clean, "[0-9]+", "0"))


def content_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: without(x, SPACE) != "")


def with_repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Words that lie in a window of three words which the text has twice or more.

    Windows are compared by hash: sorted by (hash, place), a repeated one stands next to its like.
    The words under repeated windows are counted from the gaps between their sorted places.
    """
    temp = [free_name(df, x) for x in ("hashes_", "windows_", "places_")]
    hashes, windows, places = map(F.col, temp)
    third = F.lit(2)
    df = df.withColumn(temp[0], F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(
        temp[1],
        F.sort_array(
            F.transform(
                F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))),
                lambda h, i: F.struct(F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + third)).alias("h"), i.alias("i")),
            )
        ),
    )

    def same(x: Column, at: Column) -> Column:
        return F.coalesce(x["h"] == F.get(windows, at)["h"], F.lit(False))

    df = df.withColumn(
        temp[2],
        F.sort_array(
            F.transform(
                F.filter(windows, lambda x, j: same(x, j - F.lit(1)) | same(x, j + F.lit(1))), lambda x: x["i"]
            )
        ),
    )
    gaps = F.transform(places, lambda p, j: F.least(F.lit(3), p - F.coalesce(F.get(places, j - F.lit(1)), p - 3)))
    return df.withColumn(out, F.aggregate(gaps, F.lit(0), lambda s, g: s + g).cast("long")).drop(*temp)


def read_texts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The narrow table: one row a document, without its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    df = df.withColumn("words", word_array(F.col("text"))).withColumn("lines", content_lines(F.col("text")))
    df = with_repeat_words(df, "words", "n_repeat_words")
    return df.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(without(F.col("text"), SPACE)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform(
            "lines", lambda x: F.struct(line_hash(x).alias("line"), F.size(word_array(x)).alias("words"))
        ).alias("lines"),
    )


def boilerplate(texts: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """Rows (host, line) above both limits."""
    held = texts.select("host", "text_hash", F.explode("lines.line").alias("line")).distinct()
    lines = held.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    hosts = texts.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    joined = lines.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
    return joined.where(F.col("n_docs") >= min_share * F.col("host_docs")).select("host", "line", "n_docs")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    min_share: float = MIN_SHARE,
    max_removed: float = MAX_REMOVED,
) -> DataFrame:
    """One row a document: the base counts, what the method removes, and the verdict."""
    texts = materialize(read_texts(docs, id_col, text_col, host_col), "lines")
    limits = boilerplate(texts, min_docs, min_share)
    keys = ["doc_id", "host", "text_hash"]
    rows = texts.select(*keys, F.explode("lines").alias("x")).select(*keys, "x.line", "x.words")
    bad = limits.select(F.col("host").alias("of"), F.col("line").alias("bad"))
    met = rows.join(bad, (F.col("line") == F.col("bad")) & F.col("host").eqNullSafe(F.col("of")))
    # Equal rows are one key here: their lines count once.
    per_row = met.groupBy(*keys).agg(
        F.collect_set("line").alias("removed_lines"), F.sum("words").alias("sum_words"), F.count("*").alias("sum_lines")
    )
    copies = texts.groupBy(*keys).agg(F.count("*").alias("copies"))
    removed = per_row.join(copies.toDF("k0", "k1", "k2", "copies"), _equal(keys, ["k0", "k1", "k2"])).select(
        *[F.col(k).alias(f"r_{k}") for k in keys],
        "removed_lines",
        (F.col("sum_words") / F.col("copies")).cast("long").alias("n_removed_words"),
        (F.col("sum_lines") / F.col("copies")).cast("long").alias("n_removed_lines"),
    )
    out = texts.drop("lines").join(removed, _equal(keys, [f"r_{k}" for k in keys]), "left")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    n_removed = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    depleted = n_removed > max_removed * F.col("n_words")
    return out.select(
        *keys,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~depleted).alias("kept"),
        F.coalesce("n_removed_lines", F.lit(0).cast("long")).alias("n_removed_lines"),
        n_removed.alias("n_removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
    )


def _equal(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def clean_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits
) -> DataFrame:
    """Kept documents with all their columns, boilerplate lines cut from the text."""
    verdicts = judge(docs, id_col, text_col, host_col, **limits).where("kept")
    names = {c: free_name(docs, f"verdict_{c}") for c in ("doc_id", "host", "text_hash", "removed_lines")}
    one = verdicts.dropDuplicates(["doc_id", "host", "text_hash"]).select(*[F.col(c).alias(n) for c, n in names.items()])
    same = (
        F.col(id_col).eqNullSafe(F.col(names["doc_id"]))
        & F.col(host_col).eqNullSafe(F.col(names["host"]))
        & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(names["text_hash"]))
    )
    removed = F.col(names["removed_lines"])
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(removed, line_hash(x)))
    cut = F.when(F.size(removed) == 0, F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    return docs.join(one, same).withColumn(text_col, cut).select(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", "n_removed_words",
    )


OP2_SQL = r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM worded)
), repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid
), held AS (
  SELECT rid, host, text, regexp_replace(trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS line,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT rid, host, text, unnest(lines) AS x FROM worded)
), hosts AS (
  SELECT host, count(DISTINCT text) AS host_docs FROM texts GROUP BY host
), bad AS (
  SELECT host, line FROM held JOIN hosts USING (host) GROUP BY host, line
  HAVING count(DISTINCT text) >= 20 AND count(DISTINCT text) >= 0.05 * any_value(host_docs)
), removed AS (
  SELECT rid, count(*) AS n_lines, sum(n)::BIGINT AS n_words FROM held JOIN bad USING (host, line) GROUP BY rid
), counted AS (
  SELECT rid, doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM worded LEFT JOIN covered USING (rid)
)
SELECT doc_id, counted.n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       counted.n_words < 50 OR 100 * n_repeat_words > 50 * counted.n_words AS base_failed,
       NOT (counted.n_words < 50 OR 100 * n_repeat_words > 50 * counted.n_words)
         AND NOT coalesce(removed.n_words, 0) > 0.5 * counted.n_words AS kept,
       coalesce(removed.n_lines, 0)::BIGINT AS n_removed_lines,
       coalesce(removed.n_words, 0)::BIGINT AS n_removed_words
FROM counted LEFT JOIN removed USING (rid)
"""
