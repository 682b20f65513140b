"""Toxicity: non-negative positive-unlabelled learning with numpy classifiers.

The positives are confirmed toxic rows, the unlabelled texts a sample of the whole corpus. With class prior p the
risk is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): the second part is what the
unlabelled text loses as negatives less what its toxic share would lose, and is kept from turning
negative, which is what stops overfitting. Scores are the logistic function of a linear model over
hashed words and word beginnings present in the whole text.

Defined cases: null text counts as empty and scores by the bias alone. Without confirmed rows or
without unlabelled text every score is 0. Repeated rows score alike; a null id is scored and not
held out. Other columns are left out. The fit reads at most `POSITIVES` confirmed and `UNLABELLED`
other texts outside the held-out fold, chosen by a hash of their ids; the prior is counted over all
labels outside that fold; scoring reads every text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import add_from_text, free_name, table
from tallystone.llm.samples import remainder, smallest_hashes, texts_of

FOLDS, HELD_OUT = 5, 0
POSITIVES, UNLABELLED = 6_000, 14_000
PREFIX = 8
MEMO_WORDS = 200_000
EPOCHS = 1_000
MIN_DOCS, SURPRISE = 4, 20.0
THRESHOLD = 0.5
WORD = re.compile(r"[^\W\d_]+")


class Extractor:
    """Feature numbers of a text; the numbers of a word are kept while the memo has room.

    A feature is the 32-bit checksum of a word or of a word's beginning. With `wanted`, only those.
    """

    def __init__(self, wanted=range(1 << 32), memo_words: int = MEMO_WORDS):
        self.wanted = wanted
        self.memo: dict[str, tuple[int, ...]] = {}
        self.memo_words = memo_words

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.memo.get(word)
        if found is None:
            names = [word, "^" + word[:PREFIX]] if len(word) >= PREFIX else [word]
            found = tuple(x for n in names if (x := zlib.crc32(n.encode())) in self.wanted)
            if len(self.memo) >= self.memo_words:
                self.memo = {}
            if len(word) <= 64:
                self.memo[word] = found
        return found

    def __call__(self, text: str | None) -> list[int]:
        numbers: set[int] = set()
        for word in set(WORD.findall((text or "").lower())):
            numbers.update(self.of_word(word))
        return sorted(numbers)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS) -> dict | None:
    """A linear model by Adam steps on the non-negative risk, with the smooth sigmoid loss.

    Only features take part whose texts are more likely toxic than not, as estimated from the
    prior and both shares, and whose count among positives is no chance (a likelihood ratio).
    """
    if not positive or not unlabelled or not 0 < prior < 1:
        return None
    all_positive, all_other = np.concatenate(positive), np.concatenate(unlabelled)
    known, in_positive = np.unique(all_positive, return_counts=True)
    if not len(known):
        return None
    spot = np.minimum(np.searchsorted(known, all_other), len(known) - 1)
    in_other = np.bincount(spot[known[spot] == all_other], minlength=len(known))
    chance = len(positive) * (in_other + 1) / len(unlabelled)  # positive rows with it, were it no sign
    surprise = 2 * (in_positive * np.log(np.maximum(in_positive, 1) / chance) - (in_positive - chance))
    toxic_share = prior * in_positive / len(positive)
    likely = toxic_share >= 0.5 * (in_other + 1) / len(unlabelled)
    useful = known[(in_positive >= MIN_DOCS) & likely & (surprise >= SURPRISE)]

    def matrix(rows: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of each useful feature that a row holds."""
        hit = np.isin(flat, useful)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[hit]
        return owner, np.searchsorted(useful, flat[hit])

    (po, pc), (uo, uc) = matrix(positive, all_positive), matrix(unlabelled, all_other)
    w, bias = np.zeros(len(useful) + 1), -2.0
    w[-1] = bias
    first, second = np.zeros_like(w), np.zeros_like(w)

    def margin(owner: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        return np.clip(np.bincount(owner, w[column], minlength=n) + w[-1], -30, 30)

    def slope(owner: np.ndarray, column: np.ndarray, each: np.ndarray) -> np.ndarray:
        out = np.zeros_like(w)
        out[:-1] = np.bincount(column, each[owner], minlength=len(useful))
        out[-1] = each.sum()
        return out

    for step in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-margin(po, pc, len(positive))))
        u = 1 / (1 + np.exp(-margin(uo, uc, len(unlabelled))))
        # Loss of a positive is log(1/p); of a negative it is log(1/(1-p)).
        negative_part = -np.log1p(-np.minimum(u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(p, 1 - 1e-12)).mean()
        correction = slope(uo, uc, u / len(unlabelled)) - slope(po, pc, prior * p / len(positive))
        if negative_part >= 0:
            g = slope(po, pc, prior * (p - 1) / len(positive)) + correction
        else:
            g = -correction  # step back until the negative part is not below zero
        g[:-1] += 1e-5 * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return {"weights": dict(zip(useful.tolist(), w[:-1].tolist())), "bias": float(w[-1])}


def train(
    docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED
) -> dict | None:
    open_labels = labels.where((remainder("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isin(0, 1))
    counted = open_labels.agg(F.avg("toxic")).first()[0]
    confirmed = open_labels.where("toxic = 1").select("doc_id").distinct()
    chosen = smallest_hashes(confirmed, positives).withColumn("confirmed", F.lit(1))
    open_docs = docs.where(remainder("doc_id", FOLDS) != HELD_OUT).select("doc_id").distinct()
    others = smallest_hashes(open_docs, unlabelled)  # confirmed rows too: the prior is of the whole corpus
    sample = chosen.unionByName(others.withColumn("confirmed", F.lit(0)))
    name = "features"
    made = add_from_text(texts_of(sample, docs), "text", name, "x binary", _extract)
    rows = sorted((r[0], bytes(r[1])) for r in made.select("confirmed", f"{name}.x").toLocalIterator())
    positive, others = ([np.frombuffer(x, dtype="<u4") for c, x in rows if c == k] for k in (1, 0))
    return fit(positive, others, counted or 0.0)


def _extract():
    extract = Extractor()
    return lambda texts: [{"x": np.array(extract(t), dtype="<u4").tobytes()} for t in texts]


def score_documents(docs: DataFrame, model: dict | None, text_col: str = "text") -> tuple[DataFrame, str]:
    """Documents with a struct holding `score`, and the name of that column."""
    name = free_name(docs, "toxicity")

    def maker():
        if model is None:
            return lambda texts: [{"score": 0.0} for _ in texts]
        weights = model["weights"]
        extract = Extractor(weights)

        def run(texts: list) -> list[dict]:
            margins = [sum(weights[f] for f in extract(t)) + model["bias"] for t in texts]
            z = np.clip(np.array(margins), -500, 500)
            return [{"score": s} for s in (1 / (1 + np.exp(-z))).tolist()]

        return run

    return add_from_text(docs, text_col, name, "score double", maker), name


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, name = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.col(f"{name}.score").alias("score"),
        (F.col(f"{name}.score") >= THRESHOLD).cast("int").alias("predicted"),
    )
