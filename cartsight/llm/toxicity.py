"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents carry a label; the rest of the training text is unlabelled and may be
either. A linear model on word presence minimises
  prior * E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - prior * E_P[l(g, -1)]),
the risk that corrects for the toxic documents among the unlabelled by the class prior and keeps
the part of the negatives from falling below zero.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartsight.llm.common import fold, labelled_sample, one_text_each

_WORD = re.compile(r"[^\W\d_]+")
FOLDS, HELD_OUT = 5, 0


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    """A weight per word that is in the vocabulary, and a constant."""

    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        known = self.weights.keys() & words_of(text)
        g = self.bias + sum(self.weights[w] for w in sorted(known))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, g))))


def train(
    positive: list[set[str]],
    unlabelled: list[set[str]],
    prior: float,
    vocabulary: int = 256,
    rounds: int = 500,
    rate: float = 0.05,
    ridge: float = 1e-4,
) -> Model:
    """Fit on word sets. Without positives or unlabelled sets the model says 0 for everything."""
    if not positive or not unlabelled:
        return Model(bias=-60.0)
    in_p = Counter(w for x in positive for w in x)
    in_u = Counter(w for x in unlabelled for w in x)
    n_p, n_u = len(positive), len(unlabelled)

    def surprise(w: str) -> float:
        """How far the word is more common in the positives, in standard deviations."""
        p, u = in_p[w] / n_p, in_u[w] / n_u
        both = (in_p[w] + in_u[w]) / (n_p + n_u)
        return abs(p - u) / math.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-9)

    several = [w for w in in_p.keys() | in_u.keys() if in_p[w] + in_u[w] >= 5]
    chosen = sorted(several, key=lambda w: (-surprise(w), w))[:vocabulary]
    number = {w: i for i, w in enumerate(chosen)}

    def matrix(rows: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(chosen) + 1))
        out[:, -1] = 1
        for i, x in enumerate(rows):
            out[i, [number[w] for w in number.keys() & x]] = 1
        return out

    p, u = matrix(positive), matrix(unlabelled)
    weights = np.zeros(len(chosen) + 1)
    weights[-1] = math.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)

    def sigmoid(g: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(g, -60, 60)))

    for step in range(1, rounds + 1):
        s_p, s_u = sigmoid(p @ weights), sigmoid(u @ weights)
        # logistic loss: l(g, +1) = -log s, l(g, -1) = -log(1 - s)
        loss = lambda s: -np.log(np.maximum(1 - s, 1e-12))
        negatives = loss(s_u).mean() - prior * loss(s_p).mean()
        positives = -prior * p.T @ (1 - s_p) / n_p
        rest = u.T @ s_u / n_u - prior * (p.T @ s_p) / n_p
        # below zero the risk of the negatives is overfitted: step back up instead
        slope = positives + rest if negatives >= 0 else -rest
        slope[:-1] += ridge * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(float(weights[-1]), {w: float(weights[i]) for w, i in number.items()})


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most_positive: int = 2000,
    most_unlabelled: int = 4000,
    prior: float | None = None,
) -> Model:
    """Train on at most ``most_positive`` toxic and ``most_unlabelled`` other documents.

    All come from outside the held-out fold. The unlabelled ones are drawn by hash from all
    documents, so their labels, if any, are not used. ``prior`` is the part of toxic documents;
    without one it is estimated as that part of the labelled rows outside the held-out fold.
    """
    known = labels.where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT)
    )
    toxic = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, most_positive, only=1)
    if prior is None:
        share = known.agg(F.avg("toxic")).first()[0]
        prior = min(0.9, max(0.01, share or 0.01))
    ids = docs.where(F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id").distinct()
    some = ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit("unlabelled")), "doc_id").limit(most_unlabelled)
    wanted = (
        toxic.select("doc_id", F.lit(1).alias("p"))
        .unionByName(some.select("doc_id", F.lit(0).alias("p")))
        .groupBy("doc_id")
        .agg(F.max("p").alias("p"), F.min("p").alias("u"))
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(sorted(words_of(t))) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["p"], batch["u"], pa.array(found, pa.string())], ["p", "u", "w"])

    rows = (
        one_text_each(docs, wanted).select("p", "u", "text").mapInArrow(sets, "p int, u int, w string").collect()
    )
    rows.sort(key=lambda r: r["w"])
    return train(
        [set(r["w"].split()) for r in rows if r["p"] == 1],
        [set(r["w"].split()) for r in rows if r["u"] == 0],
        prior,
    )


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    NULL and empty texts get the score of a text without known words. A NULL id is scored and
    returned. Repeated rows get equal scores; other columns are ignored; texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
