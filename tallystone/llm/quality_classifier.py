"""Quality classifier: Bradley-Terry ranking from preference pairs.

Each labelled sample row becomes a vector of counts and ratios of its whole text. A pair is one row
marked good and one marked bad; the chance that the good one wins is the logistic function of the
difference of their scores, so the weights are a logistic fit on differences of features. The
threshold is a quantile of the sample's scores: the share of rows marked bad lies below it. Scores
are shifted so that the quantile stands at 0.7.

Defined cases: null text counts as empty; empty texts get the score of their (all but empty)
features. Without labels of both kinds every score is 0.5. Repeated rows score alike; a null id is
scored and not held out. Other columns are left out. The fit reads at most `SAMPLE_ROWS` labelled
rows, chosen by a hash of their ids; scoring reads every text.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import add_from_text, free_name, table
from tallystone.llm.samples import remainder, smallest_hashes, texts_of

FOLDS, HELD_OUT = 4, 2
SAMPLE_ROWS = 20_000
PAIRS_PER_ROW = 4
THRESHOLD = 0.7
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
MARKS = np.frombuffer(b".,;:!?'\"()-", dtype=np.uint8)


def features(text: str | None) -> list[float]:
    """Counts and ratios of one text; every entry is finite, also for an empty text."""
    text = text or ""
    words = text.split()
    n = len(words)
    byte = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    chars = max(1, len(text))
    counts = Counter(words)
    adjacent = sum(map(str.__eq__, words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:])))
    lines = [x for x in text.split("\n") if x]
    symbols = int(byte[SYMBOLS].sum())
    return [
        math.log1p(n),
        1.0 if n < 5 else 0.0,
        min(symbols / max(1, n), 2.0),
        math.log1p(symbols),
        upper / max(1, upper + lower),
        1.0 if upper > lower else 0.0,
        min(int(byte[33]) / max(1, n), 2.0),
        int(byte[48:58].sum()) / chars,
        int(byte[MARKS].sum()) / chars,
        len(counts) / max(1, n),
        max(counts.values(), default=0) / max(1, n),
        adjacent / max(1, n),
        1.0 - triples / max(1, n - 2) if n > 2 else 0.0,
        1.0 - len(set(lines)) / max(1, len(lines)),
        min(sum(map(len, words)) / max(1, n), 30.0),
        math.log1p(max(map(len, words), default=0)),
        int(byte[124]) / max(1, n),
    ]


WIDTH = len(features(""))


def feature_rows(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    name = free_name(docs, "vector")
    made = add_from_text(
        docs, text_col, name, "x array<double>", lambda: lambda texts: [{"x": features(t)} for t in texts]
    )
    return made, name


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW) -> dict | None:
    """Weights from preference pairs by Newton steps on the ridged logistic loss."""
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(winners) or not len(losers):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    pick = np.random.default_rng(7)
    size = pairs_per_row * len(x)
    gap = z[pick.choice(winners, size)] - z[pick.choice(losers, size)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(gap @ w, -30, 30)))
        slope = gap.T @ (1 - p) / size - 1e-3 * w
        bend = (gap * (p * (1 - p))[:, None]).T @ gap / size + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    scores = z @ w
    return {"mean": mean, "scale": scale, "w": w, "cut": float(np.quantile(scores, float((~good).mean())))}


def score(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"] - model["cut"]
    return 1 / (1 + np.exp(-np.clip(z + math.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict | None:
    known = labels.where((remainder("doc_id", FOLDS) != HELD_OUT) & F.col("quality").isin(0, 1))
    sample = smallest_hashes(known.select("doc_id", "quality"), sample_rows)
    made, name = feature_rows(texts_of(sample, docs))
    rows = sorted((r[0], r[1]) for r in made.select("quality", f"{name}.x").toLocalIterator())
    if not rows:
        return None
    return fit_pairs(np.array([x for _, x in rows]), np.array([q == 1 for q, _ in rows]))


def score_documents(docs: DataFrame, model: dict | None, text_col: str = "text") -> tuple[DataFrame, str]:
    """Documents with a struct holding `score`, and the name of that column."""
    name = free_name(docs, "quality")

    def maker():
        return lambda texts: [
            {"score": s} for s in score(model, np.array([features(t) for t in texts]).reshape(-1, WIDTH)).tolist()
        ]

    return add_from_text(docs, text_col, name, "score double", maker), name


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored, name = score_documents(docs, model)
    return scored.select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.col(f"{name}.score").alias("score"),
        (F.col(f"{name}.score") >= THRESHOLD).cast("int").alias("predicted"),
    )
