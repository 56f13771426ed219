"""Quality rules: a linear-chain CRF marks each line as content or boilerplate.

The CRF has two states, a few features of the line and four transition weights. It is trained by
exact gradient ascent (forward and backward sums over the lines) on a bounded sample of labelled
documents; every line carries the label of its document. Viterbi decoding then labels the lines of
all documents, and a document stays if enough of its words are on content lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cartsight.llm.common import one_text_each, text_bytes

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_HIGH = bytes(range(0x80, 0x100))
_MARKS = bytes(set(range(33, 127)) - set(_UPPER + _LOWER + _DIGITS))
N_FEATURES = 11
#: Lines of one document that the training may use, and the lines of one training sequence.
TRAIN_LINES, CHUNK = 512, 64


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[float]:
    """What the CRF sees of a line that has at least one word."""
    n, size = len(words), max(1, len(line))
    upper, letters = _count(line, _UPPER), _count(line, _UPPER + _LOWER + _HIGH)
    lengths = [len(w) for w in words]
    return [
        1.0,
        math.log1p(n) / 5,
        min(2.0, _count(line, SYMBOLS) / n),
        letters / size,
        upper / max(1, letters),
        len(set(words)) / n,
        sum(x <= 3 for x in lengths) / n,
        min(2.0, sum(lengths) / n / 10),
        _count(line, _DIGITS) / size,
        min(2.0, _count(line, _MARKS) / n),
        float(repeated),
    ]


def _lines(text: bytes) -> Iterator[tuple[int, list[float]]]:
    """(number of words, features) of each line that has a word."""
    seen = set()
    for line in text.split(b"\n"):
        if words := line.split():
            yield len(words), line_features(line, words, line in seen)
            seen.add(line)


# --- the chain ---------------------------------------------------------------------------------


def _marginals(unary: np.ndarray, moves: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the labels of each line [n, lines, 2] and of each two lines [n, lines - 1, 2, 2]."""
    longest = unary.shape[1]
    length = there.sum(axis=1)
    forward, backward = np.zeros_like(unary), np.zeros_like(unary)
    forward[:, 0] = unary[:, 0]
    for t in range(1, longest):
        forward[:, t] = unary[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + moves[None], axis=1)
    for t in range(longest - 2, -1, -1):
        after = np.logaddexp.reduce(moves[None] + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(there[:, t + 1, None], after, 0)
    log_z = np.logaddexp.reduce(forward[np.arange(len(unary)), length - 1], axis=1)
    node = np.where(there[..., None], forward + backward - log_z[:, None, None], -np.inf)
    pair = forward[:, :-1, :, None] + moves + (unary + backward)[:, 1:, None, :]
    return np.exp(node), np.exp(np.where(there[:, 1:, None, None], pair - log_z[:, None, None, None], -np.inf))


def _guessed(
    unary: np.ndarray, moves: np.ndarray, there: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_marginals` of low texts, tilted so far that ``least`` of their lines are boilerplate."""
    low, high = np.zeros(len(unary)), np.full(len(unary), 40.0)
    need = least * there.sum(axis=1)

    def tilted(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _marginals(unary + by[:, None, None] * np.array([1.0, 0.0]), moves, there)

    met = tilted(low)[0][..., 0].sum(axis=1) >= need
    for _ in range(12):
        middle = (low + high) / 2
        enough = tilted(middle)[0][..., 0].sum(axis=1) >= need
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    return tilted(np.where(met, 0.0, high))


def train_crf(
    sequences: list[tuple[np.ndarray, int]],
    rounds: int = 80,
    rate: float = 0.3,
    ridge: float = 1e-3,
    turns: int = 5,
    least_low: float = 0.5,
) -> tuple[np.ndarray, np.ndarray]:
    """(weights [2, features], transitions [2, 2]) from (features per line, label of the text).

    The lines of a good text are content. Which lines of a low one are boilerplate nobody has said,
    only that ``least_low`` of them are, so these labels are estimated: expectation maximisation on
    the chain. At first all lines of a low text count as boilerplate, without any moves; then, ``turns``
    times, the chain says how likely each line and each move is, and is fitted to that. So lines of low
    texts that look like those of good ones become content, and moves between both are learned.

    Adam on the mean conditional log likelihood. Without sequences all weights are zero, and
    every line then decodes as content.
    """
    weights, moves = np.zeros((2, N_FEATURES)), np.zeros((2, 2))
    chunks = [(x[i : i + CHUNK], y) for x, y in sequences for i in range(0, len(x), CHUNK)]
    if not chunks:
        return weights, moves
    longest = max(len(x) for x, _ in chunks)
    data = np.zeros((len(chunks), longest, N_FEATURES))
    label = np.array([y for _, y in chunks])
    length = np.array([len(x) for x, _ in chunks])
    for i, (x, _) in enumerate(chunks):
        data[i, : len(x)] = x
    there = np.arange(longest)[None] < length[:, None]
    bad = label == 0
    line = np.zeros((len(chunks), longest, 2))
    line[np.arange(len(chunks)), :, label] = there
    truth_m = np.diag([(length[label == y] - 1).sum() for y in (0, 1)]).astype(float)
    first, second, total = np.zeros(2 * N_FEATURES + 4), np.zeros(2 * N_FEATURES + 4), there.sum()
    for step in range(1, rounds + 1):
        warm = rounds // 2
        if step > warm and (step - warm - 1) % max(1, (rounds - warm) // turns) == 0 and bad.any():
            line[bad], pair = _guessed(data[bad] @ weights.T, moves, there[bad], least_low)
            truth_m = pair.sum((0, 1)) + np.diag([0.0, (length[~bad] - 1).sum()])
        truth_w = np.einsum("ntk,ntf->kf", line, data)
        node, pair = _marginals(data @ weights.T, moves, there)
        slope = np.concatenate(
            [
                ((truth_w - np.einsum("ntk,ntf->kf", node, data)) / total - ridge * weights).ravel(),
                ((truth_m - pair.sum((0, 1))) / total - ridge * moves).ravel() * (step > warm),
            ]
        )
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights += move[: 2 * N_FEATURES].reshape(2, -1)
        moves += move[2 * N_FEATURES :].reshape(2, 2)
    return weights, moves


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best label sequence for unary ``scores`` [lines, 2]; content (1) wins ties."""
    (m00, m01), (m10, m11) = moves.tolist()
    rows = scores.tolist()
    a, b = rows[0]
    back = []
    for u, v in rows[1:]:
        to0, to1 = b + m10 >= a + m00, b + m11 >= a + m01
        back.append((to0, to1))
        a, b = u + (b + m10 if to0 else a + m00), v + (b + m11 if to1 else a + m01)
    label = int(b >= a)
    path = [label]
    for choice in reversed(back):
        label = int(choice[label])
        path.append(label)
    return path[::-1]


# --- documents ---------------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in ``words``."""
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if n < 4 or len(number) == n:
        return 0
    if len(number) < 2_000_000:
        keys = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * np.int64(n) + pairs[1:]
    _, where, copies = np.unique(keys, return_inverse=True, return_counts=True)
    hit = copies[where] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= hit
    return int(covered.sum())


def base_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return (
        len(words),
        len(text.translate(None, _SPACE + _CONTINUED)),
        _count(text, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _chunks(lines: list) -> list[list]:
    """All lines, or of a longer text ``TRAIN_LINES`` in runs that are spread over the whole of it."""
    if len(lines) <= TRAIN_LINES:
        return [lines] if lines else []
    runs = TRAIN_LINES // CHUNK
    last = len(lines) - CHUNK
    return [lines[at : at + CHUNK] for at in (last * i // (runs - 1) for i in range(runs))]


def training_lines(docs: DataFrame, chosen: DataFrame) -> list[tuple[np.ndarray, int]]:
    """Features per line of the documents of ``chosen`` (doc_id, y), a bounded sample."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for i, text in enumerate(text_bytes(batch["text"])):
                for lines in _chunks([f for _, f in _lines(text)]):
                    found.append(np.array(lines, np.float32).tobytes())
                    owner.append(i)
            own = batch.select(["doc_id", "y"]).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.binary())], ["doc_id", "y", "x"])

    rows = (
        one_text_each(docs, chosen)
        .select("doc_id", "y", "text")
        .mapInArrow(features, "doc_id long, y int, x binary")
        .collect()
    )
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["x"])))
    out = [(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES), r["y"]) for r in rows]
    return [(x.astype(float), y) for x, y in out if len(x)]


def judge(
    docs: DataFrame,
    chosen: DataFrame,
    least_words: int = 50,
    most_repeated: int = 50,
    least_content: float = 0.5,
) -> DataFrame:
    """Figures and verdict for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``chosen`` holds (doc_id, y) of the labelled training sample, already bounded. A NULL or empty
    text has no words, zero figures, a content share of 0 and fails the base rule. A NULL id is
    returned as NULL. Repeated rows and ids are judged row by row. A text is read whole, at any
    length; an empty table gives an empty result.
    """
    weights, moves = train_crf(training_lines(docs, chosen), rounds=160)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in text_bytes(batch["text"]):
                n, chars, symbols, dups, repeats = base_figures(text)
                lines = list(_lines(text))
                content = 0
                if lines:
                    path = viterbi(np.array([f for _, f in lines]) @ weights.T, moves)
                    content = sum(k for (k, _), mark in zip(lines, path, strict=True) if mark)
                failed = n < least_words or 100 * repeats > most_repeated * n
                share = content / n if n else 0.0
                kept = not failed and share >= least_content
                rows.append((n, chars, symbols, dups, repeats, failed, kept, content, share))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names,
            )

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean, content_words long, "
        "content_share double"
    )
    names = re.findall(r"(\w+) \w+", schema)
    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(figures, schema)
