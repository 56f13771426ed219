"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A text is cut into windows of bytes. In each window one GRU reads forwards and one backwards; both
states together give the probability of each language at every byte. The probabilities of all
bytes of a document are pooled. Training is backpropagation through time on labelled windows,
where every byte carries the language of its document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartsight.llm.common import fold

WINDOW, HIDDEN = 64, 8
#: Windows that are read at a time.
BATCH = 4096
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter: Unicode category L, so no numeral such as a half or a Roman one."""
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    """``x``, ``u``: input table [3h, 256] and recurrent weights [3h, h] of each direction."""

    langs: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    out: np.ndarray  # [langs, 2h]
    bias: np.ndarray  # [langs, 1]

    def parameters(self) -> list[np.ndarray]:
        return [*self.x, *self.u, self.out, self.bias]


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    def draw(*shape):
        return (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return Model(
        langs,
        [draw(3 * hidden, 256) for _ in range(2)],
        [draw(3 * hidden, hidden) for _ in range(2)],
        draw(len(langs), 2 * hidden),
        np.zeros((len(langs), 1), np.float32),
    )


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * a) + np.float32(0.5)


def _step(x: np.ndarray, u: np.ndarray, byte: np.ndarray, h: np.ndarray) -> tuple:
    """One GRU step for all windows: new state, update gate, reset gate, candidate, u_n h."""
    hidden = u.shape[1]
    given, past = np.take(x, byte, axis=1), u @ h
    gates = _sigmoid(given[: 2 * hidden] + past[: 2 * hidden])
    z, r, un = gates[:hidden], gates[hidden:], past[2 * hidden :]
    n = np.tanh(given[2 * hidden :] + r * un)
    return n + z * (h - n), z, r, n, un


def probabilities(model: Model, windows: np.ndarray, there: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position, probabilities [langs, windows]) for ``windows`` [length, windows] of bytes.

    ``there`` is 1 where a window has a byte and 0 behind its end. The backward network starts at the
    last byte, as in training: padding leaves its state at zero.
    """
    length, n = windows.shape
    hidden = model.u[0].shape[1]
    ahead = np.empty((length, hidden, n), np.float32)
    h = np.zeros((hidden, n), np.float32)
    for t in range(length):
        h = ahead[t] = _step(model.x[0], model.u[0], windows[t], h)[0]
    h = np.zeros((hidden, n), np.float32)
    for t in reversed(range(length)):
        h = _step(model.x[1], model.u[1], windows[t], h)[0] * there[t]
        logits = model.out[:, :hidden] @ ahead[t] + model.out[:, hidden:] @ h + model.bias
        e = np.exp(logits - logits.max(axis=0))
        yield t, e / e.sum(axis=0)


# --- training ----------------------------------------------------------------------------------


def loss_and_slopes(model: Model, windows: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all bytes ``there``, and its slope for each parameter."""
    length, n = windows.shape
    hidden, total = model.u[0].shape[1], np.float32(there.sum())
    states: list[list] = [[], []]
    for way, order in ((0, range(length)), (1, range(length - 1, -1, -1))):
        h = np.zeros((hidden, n), np.float32)
        for t in order:
            before = h
            h, z, r, c, un = _step(model.x[way], model.u[way], windows[t], h)
            h = np.where(there[t], h, before)  # padding leaves the state as it is
            states[way].append((t, before, h, z, r, c, un))
    at = [{s[0]: s[2] for s in states[way]} for way in (0, 1)]
    slopes = [np.zeros_like(p) for p in model.parameters()]
    into: list[list] = [[None] * length, [None] * length]
    loss, each = 0.0, np.arange(n)
    for t in range(length):
        both = np.concatenate([at[0][t], at[1][t]])
        logits = model.out @ both + model.bias
        e = np.exp(logits - logits.max(axis=0))
        p = e / e.sum(axis=0)
        loss -= float((np.log(p[y, each] + 1e-12) * there[t]).sum())
        p[y, each] -= 1
        p *= there[t] / total
        slopes[4] += p @ both.T
        slopes[5] += p.sum(axis=1, keepdims=True)
        back = model.out.T @ p
        into[0][t], into[1][t] = back[:hidden], back[hidden:]
    for way in (0, 1):
        later = np.zeros((hidden, n), np.float32)
        for t, before, _, z, r, c, un in reversed(states[way]):
            dh = later + into[way][t]
            live = dh * there[t]
            dn = live * (1 - z) * (1 - c * c)
            dz = live * (before - c) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            pre = np.concatenate([dz, dr, dn])
            rec = np.concatenate([dz, dr, dn * r])
            slopes[2 + way] += rec @ before.T
            np.add.at(slopes[way].T, windows[t], pre.T)
            later = dh * (1 - there[t]) + live * z + model.u[way].T @ rec
    return loss / float(total), slopes


def train(langs: list[str], texts: list[tuple[int, bytes]], rounds: int = 300, batch: int = 128, seed: int = 7) -> Model:
    """Adam on batches that hold as many windows of each language."""
    model, rng = new_model(langs, seed=seed), np.random.default_rng(seed)
    by_lang = [[w for k, w in texts if k == i] for i in range(len(langs))]
    shares = [k for k, ws in enumerate(by_lang) if ws]
    if len(shares) < 2:
        model.bias[shares] += 20
        model.out[:] = 0
        return model
    first = [np.zeros_like(p) for p in model.parameters()]
    second = [np.zeros_like(p) for p in model.parameters()]
    for step in range(1, rounds + 1):
        y = np.array([shares[i % len(shares)] for i in range(batch)])
        some = [by_lang[k][rng.integers(len(by_lang[k]))] for k in y]
        windows, there = packed(some)
        _, slopes = loss_and_slopes(model, windows, there, y)
        rate = 0.02 * (1 - step / (rounds + 1))
        for p, g, a, b in zip(model.parameters(), slopes, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def packed(windows: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bytes [length, windows], and 1.0 where a window has a byte."""
    data = np.frombuffer(b"".join(w.ljust(length, b"\0") for w in windows), np.uint8)
    sizes = np.array([len(w) for w in windows])
    there = (np.arange(length)[:, None] < sizes[None]).astype(np.float32)
    return np.ascontiguousarray(data.reshape(len(windows), length).T), there


def fit(docs: DataFrame, per_lang: int = 400, windows: int = 8, rounds: int = 300) -> Model:
    """Train on at most ``per_lang`` texts of each language and ``windows`` windows of each.

    Texts come from outside the held-out fold and have a language. The windows are spread over
    the whole text.
    """
    slim = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "lang", "text", "xxhash64(text) AS h").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)
    )
    ids = slim.select("doc_id", "lang", "h").distinct()
    counts = ids.groupBy(F.col("lang").alias("l")).agg(F.count("doc_id").alias("n"))
    # a draw of about twice the bound goes to the window, however common the language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    few = ids.join(counts, F.col("lang") == F.col("l")).where(draw * F.col("n") <= 2 * per_lang * (1 << 30))
    order = Window.partitionBy("lang").orderBy(draw, "doc_id", "h")
    chosen = few.select("doc_id", "lang", "h").withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = (text or "").encode()
                if not has_letter(text):
                    continue
                last = max(0, len(data) - WINDOW)
                for at in sorted({last * i // max(1, windows - 1) for i in range(windows)}):
                    rows.append((lang, data[at : at + WINDOW]))
            langs, parts = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "w"])

    some = chosen.selectExpr("doc_id AS d", "lang AS l", "h AS g").hint("broadcast")
    same = (F.col("doc_id") == F.col("d")) & (F.col("lang") == F.col("l")) & (F.col("h") == F.col("g"))
    # equal rows are one: what comes to the driver is bounded by the choice, however often rows repeat
    drawn = slim.join(some, same).groupBy("doc_id", "lang", "h").agg(F.min("text").alias("text"))
    rows = drawn.select("lang", "text").mapInArrow(cut, "lang string, w binary").collect()
    texts = sorted((r["lang"], bytes(r["w"])) for r in rows)
    langs = sorted({k for k, _ in texts})
    number = {k: i for i, k in enumerate(langs)}
    return train(langs, [(number[k], w) for k, w in texts], rounds=rounds)


# --- scoring -----------------------------------------------------------------------------------


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean probability of each language over all bytes of each text [texts, langs]."""
    total = np.zeros((len(texts), len(model.langs)))
    counts = np.array([-(-len(t) // WINDOW) for t in texts])
    padded = b"".join(t.ljust(c * WINDOW, b"\0") for t, c in zip(texts, counts, strict=True))
    data = np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts) - 1
    sizes = np.full(len(data), WINDOW)
    some = counts > 0
    sizes[ends[some]] = [len(t) - (c - 1) * WINDOW for t, c in zip(texts, counts, strict=True) if c]
    for at in range(0, len(data), BATCH):
        part, size = data[at : at + BATCH], sizes[at : at + BATCH]
        sums = np.zeros((len(model.langs), len(part)), np.float32)
        there = (np.arange(WINDOW)[:, None] < size).astype(np.float32)
        for t, p in probabilities(model, np.ascontiguousarray(part.T), there):
            sums += p * there[t]
        np.add.at(total, owner[at : at + BATCH], sums.T)
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def label(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """All columns of ``rows``, where column ``row`` has a field ``text``, and lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                texts = batch["row"].field(text).to_pylist()
                known = [bool(model.langs) and has_letter(t) for t in texts]
                means = pooled(model, [t.encode() if k else b"" for t, k in zip(texts, known, strict=True)])
                best = means.argmax(axis=1) if model.langs else [0] * len(texts)
                langs = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = [float(min(1.0, m[b])) if k else 0.0 for m, b, k in zip(means, best, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch["row"], pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                    ["row", "lang_pred", "score"],
                )

    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema, *extra]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text).

    A text that is NULL, empty or without letters is ``und`` with score 0, as is every text when
    no language could be learned. A NULL id is returned as NULL; repeated rows get equal results;
    other columns are ignored. Texts are read whole, in windows.
    """
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).alias("row"))
    return label(rows, model, "text").select(
        F.col("row.doc_id").alias("doc_id"),
        (fold("row.doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "lang_pred",
        "score",
    )


def accepted(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``."""
    rows = label(docs.select(F.struct("*").alias("row")), model, "text")
    return rows.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
