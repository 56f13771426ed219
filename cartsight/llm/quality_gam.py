"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is put into one of a few bins. Boosting goes round the features in turn and
fits a shallow tree on one feature at a time to what is left unexplained; the trees of a feature
add up to a lookup table by bin. Then tables over pairs of features follow in the same way. A score
is the sum of the tables' entries, computed for many texts at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartsight.llm.common import fold, labelled_sample, stored, text_bytes

FOLDS, HELD_OUT = 4, 2
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_HIGH = bytes(range(0x80, 0x100))
NAMES = (
    "words", "mean_word", "long_words", "short_words", "distinct", "top_word", "pairs_again", "lines",
    "words_a_line", "lines_again", "upper", "letters", "digits", "symbols", "pipes", "stops", "shouts",
    "ends", "high", "same_next",
)


def features(text: bytes) -> list[float]:
    """The figures NAMES of one text; zeros for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = n - 1 - len(set(zip(words, words[1:], strict=False)))
    lengths = np.fromiter(map(len, words), np.int32, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)

    def share(chars: bytes) -> float:
        return (size - len(text.translate(None, chars))) / size

    upper, letters = share(_UPPER), share(_UPPER + _LOWER + _HIGH)
    return [
        math.log1p(n),
        float(lengths.mean()),
        float((lengths > 12).mean()),
        float((lengths <= 3).mean()),
        len(counts) / n,
        max(counts.values()) / n,
        pairs / n,
        math.log1p(len(lines)),
        math.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        upper / letters if letters else 0.0,
        letters,
        share(_DIGITS),
        share(b"#*$%&<>@^~={}[]\\") * size / n,
        text.count(b"|") / n,
        (text.count(b".") + text.count(b",")) / n,
        (text.count(b"!") + text.count(b"?")) / n,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)),
        share(_HIGH),
        sum(map(bytes.__eq__, words, words[1:])) / n,
    ]


@dataclass
class Model:
    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)  # of each feature
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)  # by coarse bins

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if not self.cuts:
            return out
        bins = binned(x, self.cuts)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for j, k, t in self.pairs:
            out += t[_coarse(bins[:, j]), _coarse(bins[:, k])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)


def _coarse(bins: np.ndarray) -> np.ndarray:
    return bins // 4


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 20.0, ridge: float = 1.0) -> np.ndarray:
    """Leaf value by bin of a tree of ``depth`` on one axis, from sums of slope and curvature."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if not depth or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl * 4 < least / 4) | (hr * 4 < least / 4)] = -1
    cut = int(gain.argmax())
    if gain[cut] <= 1e-9:
        return out
    out[: cut + 1] = _tree(g[: cut + 1], h[: cut + 1], depth - 1, least, ridge)
    out[cut + 1 :] = _tree(g[cut + 1 :], h[cut + 1 :], depth - 1, least, ridge)
    return out


def _tree_2d(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """A split on one axis and then one on the other in each half: leaf value by cell, and gain."""
    best, best_gain = np.zeros_like(g), 0.0
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(gg)):
            cells, gain = np.empty_like(gg), -(g.sum() ** 2) / (h.sum() + ridge)
            for part in (slice(0, cut), slice(cut, None)):
                line = _tree(gg[part].sum(axis=0), hh[part].sum(axis=0), 1, 5.0, ridge)
                cells[part] = line
                s, c = gg[part].sum(axis=0), hh[part].sum(axis=0)
                for v in np.unique(line):
                    gain += s[line == v].sum() ** 2 / (c[line == v].sum() + ridge)
            if gain > best_gain:
                best, best_gain = (cells.T if turn else cells).copy(), gain
    return best, best_gain


def train(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pair_rounds: int = 30, most_pairs: int = 6, rate: float = 0.15) -> Model:
    """Fit on features [rows, NAMES] and labels; a constant where there is one label or none."""
    if not len(y) or y.min() == y.max():
        return Model(bias=0.0 if not len(y) else 6.0 * (2 * float(y[0]) - 1))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = binned(x, cuts)
    p = y.mean()
    model = Model(float(np.log(p / (1 - p))), cuts, [np.zeros(len(c) + 1) for c in cuts])
    f = np.full(len(y), model.bias)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        s = 1 / (1 + np.exp(-f))
        return y - s, s * (1 - s)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = rest()
            n = len(table)
            step = rate * np.clip(_tree(np.bincount(b[:, j], g, n), np.bincount(b[:, j], h, n), 2), -4, 4)
            table += step
            f += step[b[:, j]]
    c = _coarse(b)
    side = (bins - 1) // 4 + 1

    def grid(j: int, k: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, j] * side + c[:, k], v, side * side).reshape(side, side)

    g, h = rest()
    gains = [
        (-_tree_2d(grid(j, k, g), grid(j, k, h))[1], j, k)
        for j in range(x.shape[1])
        for k in range(j + 1, x.shape[1])
        if len(cuts[j]) and len(cuts[k])
    ]
    model.pairs = [(j, k, np.zeros((side, side))) for _, j, k in sorted(gains)[:most_pairs]]
    for _ in range(pair_rounds):
        for j, k, table in model.pairs:
            g, h = rest()
            step = rate * np.clip(_tree_2d(grid(j, k, g), grid(j, k, h))[0], -4, 4)
            table += step
            f += step[c[:, j], c[:, k]]
    return model


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in text_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


def fit(rows: DataFrame, labels: DataFrame, most: int = 20_000) -> Model:
    """Train on at most ``most`` labelled rows of :func:`featured`, outside the held-out fold."""
    chosen = labelled_sample(rows, labels, "quality", FOLDS, HELD_OUT, most)
    # one row for each id: what comes to the driver is bounded by the choice, however often ids repeat
    found = rows.join(chosen.hint("broadcast"), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    found.sort(key=lambda r: (r["y"], r["x"]))
    x = np.array([r["x"] for r in found], np.float64).reshape(-1, len(NAMES))
    return train(x, np.array([r["y"] for r in found], float))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    NULL and empty texts have all features zero and are scored so. A NULL id is scored and
    returned, but not learned from. Repeated rows get equal scores. Without labels the score is
    0.5. Other columns are ignored. Texts are read whole.
    """
    rows = stored(featured(docs), "features")
    model = fit(rows, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(x.astype(float)))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
