"""Bounded samples of labelled rows, for the operators that fit a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import crc32_of_id


def remainder(col: str, folds: int) -> F.Column:
    """The fold of an id; a null id is in fold -1, which nothing holds out."""
    return F.coalesce(crc32_of_id(col) % folds, F.lit(-1))


def smallest_hashes(rows: DataFrame, limit: int) -> DataFrame:
    """At most `limit` rows, chosen by a hash of doc_id, so the choice depends on the data alone."""
    return rows.orderBy(F.xxhash64("doc_id"), *rows.columns).limit(limit)


def texts_of(sample: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts of sampled rows. The sample has a limit, which is what bounds the broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
