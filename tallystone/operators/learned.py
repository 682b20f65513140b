"""Gradient-boosted baseline on the recorded features, gated on enough history."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions.columns import finite_map
from tallystone.operators.evaluation import feature_names
from tallystone.session import materialize, shared_folder


class InsufficientHistory(RuntimeError):
    """Too few labelled picks to train on."""


def _columns(names: list[str]) -> list[Column]:
    """Each feature with its missing-value indicator; trees here have no branch for NULL."""
    out = []
    for i, n in enumerate(names):
        value = F.col("features")[n]
        out.append(F.coalesce(value, F.lit(0.0)).alias(f"f{i}"))
        out.append(value.isNull().cast("double").alias(f"missing{i}"))
    return out


def feature_matrix(rows: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Features in the order of ``names``, 0 where missing, each with a mark of whether it is."""
    return rows.select(*keep, *_columns(names))


def _vectors(rows: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    flat = feature_matrix(rows, names, keep)
    inputs = [c for i in range(len(names)) for c in (f"f{i}", f"missing{i}")]
    return VectorAssembler(inputCols=inputs, outputCol="vector").transform(flat)


def gbdt_book(
    candidates: DataFrame,
    history: DataFrame,
    top: int,
    min_train_rows: int = V.MIN_TRAIN_ROWS,
    rounds: int = 200,
) -> DataFrame:
    """Top names by predicted forward return; raises InsufficientHistory on a short history."""
    stored = materialize(history.select("features", "forward_return"), "history")
    count = stored.count()
    if count < min_train_rows:
        raise InsufficientHistory(
            f"the GBDT baseline needs >= {min_train_rows} scored picks to train; "
            f"the ledger has {count}."
        )
    # Feature names come from the fixed metric vocabulary, so this list is short.
    names = [r.feature for r in feature_names(stored).collect()]
    shared_folder(candidates.sparkSession)
    # Each round runs several short jobs over the history, so it is kept; a lost part is read again.
    vectors = _vectors(stored, names, ["forward_return"]).persist()
    model = GBTRegressor(
        featuresCol="vector",
        labelCol="forward_return",
        maxIter=rounds,
        stepSize=0.1,
        minInstancesPerNode=5,
        seed=0,
    ).fit(vectors)
    vectors.unpersist()
    rows = candidates.select("entity_id", finite_map("metric_values").alias("features"))
    scored = model.transform(_vectors(rows, names, ["entity_id"]))
    best = scored.orderBy(F.col("prediction").desc(), "entity_id").limit(top)
    return best.select(
        F.lit("gbdt").alias("strategy"), "entity_id", F.col("prediction").alias("score")
    )
