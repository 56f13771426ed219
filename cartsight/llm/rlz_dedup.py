"""Repeated passages by relative Lempel-Ziv parsing over words.

The surroundings of shared anchors (see :mod:`sieve`) that one task holds are its reference block. Its
index has, for each length, the hash values of all runs of words in it and the smallest document that
has each. Every document's stretch is factored greedily against the block: the longest run from the
present word on that an earlier document has, then on behind it. Factors of 13 words or more are
repeated: their windows stand in an earlier document, and the index tells in which. Of the other
windows only those over the end of one factor can, and only if the next factor reaches as far as they
do: whatever a window has behind that end would else be a longer factor. These are looked up at the
boundary. No other window is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartsight.llm.common import WORD
from cartsight.llm.sieve import CROWD, NO_ID, Batch, Kind, covered, solve

LENGTH, ANCHOR = 13, 5
_U = np.uint64


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash value of 48 bits for each word. Zero stands for no word."""
    number: dict[bytes, int] = {}
    parts, counts = [], []
    for text in texts:
        words = text.split()
        counts.append(len(words))
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(w, 1) >> 16 | 1 for w in number), _U, len(number))
    every = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return (values[every] if len(values) else np.zeros(0, _U)), np.array(counts, np.int64)


class ReferenceBlock:
    """Runs of ANCHOR to ``width`` words of all rows, by length, with the smallest document."""

    def __init__(self, rows: np.ndarray, inside: np.ndarray, docs: np.ndarray):
        self.n, self.width = rows.shape
        self.hashes: dict[int, np.ndarray] = {}  # [rows, starts]; 0 where the run leaves its document
        self.keys: dict[int, np.ndarray] = {}
        self.least: dict[int, np.ndarray] = {}
        value = np.full(rows.shape, 0x9E3779B97F4A7C15, _U)
        for length in range(1, self.width + 1):
            starts = self.width - length + 1
            value = (value[:, :starts] ^ rows[:, length - 1 :]) * _U(0xBF58476D1CE4E5B9)
            value ^= value >> _U(31)
            if length < ANCHOR:
                continue
            whole = inside[:, :starts] & inside[:, length - 1 :]
            found = np.where(whole, value | _U(1), _U(0))
            keys, which = np.unique(found, return_inverse=True)
            least = np.full(len(keys), NO_ID)
            np.minimum.at(least, which.ravel(), np.repeat(docs, starts))
            if len(keys) and keys[0] == 0:
                least[0] = NO_ID
            self.hashes[length], self.keys[length], self.least[length] = found, keys, least

    def first(self, length: int, row: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The smallest document that has the run of ``length`` words from ``start`` in ``row``."""
        return self.least[length][np.searchsorted(self.keys[length], self.hashes[length][row, start])]

    def longest(self, row: np.ndarray, start: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Length of the longest run from ``start`` that a document before ``docs`` has; 0: none."""
        low = np.zeros(len(row), np.int64)
        for length in range(ANCHOR, self.width + 1):  # a longer run is in no more documents
            can = np.flatnonzero((start + length <= self.width) & (low >= length - 1 if length > ANCHOR else True))
            if not len(can):
                break
            hit = self.first(length, row[can], start[can]) < docs[can]
            low[can[hit]] = length
        return low


def first_documents(around: np.ndarray, inside: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window of each row the smallest document that has it, as far as that is a factor's.

    Where no earlier document has the window, the row's own document is given.
    """
    block = ReferenceBlock(around, inside, docs)
    n, width = around.shape
    starts = width - LENGTH + 1
    out = np.repeat(docs[:, None], starts, axis=1)
    row, at = np.arange(n), np.zeros(n, np.int64)
    length = block.longest(row, at, docs[row])
    while len(row):
        step = np.maximum(length, 1)
        end = at + step
        following = block.longest(row, end, docs[row])
        for k in range(int(step.max())):  # windows that start in the factor
            start = at + k
            beyond = start + LENGTH - end
            # fewer words than an anchor are in no index: such a rest proves nothing
            over = (k > 0) & ((beyond < ANCHOR) | (following >= beyond))
            here = (k < step) & (start < starts) & ((beyond <= 0) | over)
            r, s = row[here], start[here]
            out[r, s] = np.minimum(out[r, s], block.first(LENGTH, r, s))
        on = end < starts
        row, at, length = row[on], end[on], following[on]
    return out


def removed(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept for every row of ``docs`` (doc_id, text).

    A word goes if a window of 13 words that covers it also starts in a document with a smaller id.
    A NULL text has no words. Rows with a NULL id come after all ids and lose nothing to each other,
    as do rows with the same id. Texts with fewer than 13 words keep everything. ``kept`` is what
    is left, words joined by one space. Words are compared by 47 bits of a hash. Other columns are
    ignored. An anchor with more than
    ``crowd`` occurrences is split by window, which changes no result.
    """

    def report(batch: Batch, hit: np.ndarray) -> pa.RecordBatch:
        gone = covered(hit, LENGTH)
        rows = []
        for i, (text, a, b) in enumerate(zip(batch.texts, batch.begins, batch.ends, strict=True)):
            words, out = text.split(), gone[a:b]
            if out.any():
                words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
            rest = b" ".join(words)
            doc = None if batch.ids[i] == NO_ID else int(batch.ids[i])
            rows.append((doc, int(b - a), int(out.sum()), hashlib.sha256(rest).hexdigest(), rest))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )

    kind = Kind(LENGTH, ANCHOR, "<u8", 6, _words, first_documents)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    return solve(docs, kind, report, schema, crowd).withColumn("kept", F.col("kept").cast("string"))


#: The same rows in SQL, from all windows of all documents.
_RUN = ", ".join(["word"] + [f"lead(word, {k}) OVER ahead" for k in range(1, LENGTH)])
ORACLE = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id,
           coalesce(doc_id, {NO_ID}) AS place,
           regexp_extract_all(coalesce(text, ''), '{WORD}') AS words
    FROM documents),
words AS (
    SELECT r, place, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
runs AS (
    SELECT r, place, word, i,
           CASE WHEN lead(i, {LENGTH - 1}) OVER ahead IS NOT NULL
                THEN concat_ws(' ', {_RUN}) END AS run
    FROM words WINDOW ahead AS (PARTITION BY r ORDER BY i)),
firsts AS (SELECT run, min(place) AS least FROM runs WHERE run IS NOT NULL GROUP BY run),
starts AS (
    SELECT r, i, word, coalesce(least < place, false) AS hit
    FROM runs LEFT JOIN firsts USING (run)),
marked AS (
    SELECT r, i, word, bool_or(hit) OVER (PARTITION BY r ORDER BY i
               ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone
    FROM starts),
kept AS (
    SELECT r, count(*) FILTER (gone) AS n_removed,
           string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS rest
    FROM marked GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
