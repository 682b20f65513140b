"""Which texts may hold a quote: postings of words instead of all pairs.

Quotes and texts meet within a scope (a company, a run). Scopes of few pairs are joined as they are.
In the others a quote is looked up by its rarest words: words inside a quote (not its first or last,
which may be parts of longer words) stand whole in any text that holds the quote, so the rarest of
them is enough. Where an overlap of words counts too, so many of the rarest words are taken that a
text without any of them misses more of the quote than the overlap allows. Nothing is lost; the
caller still tests each pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions import text as T
from tallystone.session import materialize

# Pairs of quotes and texts up to which a scope is joined as it is.
PAIRS = 4_096


def _crowded(quotes: DataFrame, texts: DataFrame, scope: list[str], pairs: int) -> DataFrame:
    """Scopes of more pairs than that."""
    n_quotes = quotes.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_quotes"))
    n_texts = texts.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_texts"))
    return n_quotes.join(n_texts, scope).where(F.col("n_quotes") * F.col("n_texts") > pairs).select(*scope)


def candidates(
    quotes: DataFrame, texts: DataFrame, scope: list[str], ids: list[str], source: str,
    missing_share: float | None = None, pairs: int = PAIRS,
) -> DataFrame:
    """Rows (scope, ids, source): pairs outside of which no text holds its quote.

    ``quotes``: scope, ids, fq (folded). ``texts``: scope, source, folded; both stored tables.
    ``missing_share``: share of a quote's words that a text may lack, if an overlap counts.
    """
    crowded = materialize(_crowded(quotes, texts, scope, pairs), "crowded")
    plain = quotes.join(crowded, scope, "left_anti").select(*scope, *ids)
    near = texts.select(*scope, source)
    if crowded.isEmpty():
        return plain.join(near, scope)
    worded = quotes.join(crowded, scope, "left_semi").withColumn("words", T.words(F.col("fq")))
    short = worded.where(F.size("words") <= 2).select(*scope, *ids)
    return (
        plain.unionByName(short).join(near, scope)
        .unionByName(_by_rare_words(worded.where(F.size("words") > 2), texts, scope, ids, source, missing_share))
    )


def _by_rare_words(
    worded: DataFrame, texts: DataFrame, scope: list[str], ids: list[str], source: str, missing_share: float | None
) -> DataFrame:
    placed = worded.select(*scope, *ids, F.size("words").alias("n"), F.posexplode("words").alias("i", "token"))
    inside = F.col("i").between(1, F.col("n") - 2)
    # A word of a quote once, with how often it stands there.
    wanted = placed.groupBy(*scope, *ids, "n", "token").agg(F.count(F.lit(1)).alias("times"), F.bool_or(inside).alias("inside"))
    tokens = wanted.select(*scope, "token").distinct()
    postings = materialize(
        texts.select(*scope, source, F.explode(F.array_distinct(T.words(F.col("folded")))).alias("token")).join(tokens, [*scope, "token"], "left_semi"), "postings"
    )
    rarity = postings.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("n_texts"))
    ranked = wanted.join(rarity, [*scope, "token"], "left").withColumn("n_texts", F.coalesce("n_texts", F.lit(0)))
    # A quote's words are as many as the quote is long; the windows are per quote.
    by_rarity = Window.partitionBy(*scope, *ids).orderBy("n_texts", "token")
    first_inside = F.min(F.when(F.col("inside"), F.struct("n_texts", "token"))).over(Window.partitionBy(*scope, *ids))
    probe = first_inside["token"] == F.col("token")
    ranked = ranked.withColumn("rarer", F.sum("times").over(by_rarity) - F.col("times")).withColumn("is_first", probe)
    chosen = F.col("is_first")
    if missing_share is not None:
        chosen = chosen | (F.col("rarer") <= missing_share * F.col("n"))
    probes = ranked.where(chosen).select(*scope, *ids, "token")
    return probes.join(postings, [*scope, "token"]).select(*scope, *ids, source).distinct()
