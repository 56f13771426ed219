"""Repeated byte strings by merging Burrows-Wheeler transforms.

The surroundings of shared anchors (see :mod:`sieve`) that one task holds are split into shards. Each
shard gets its own transform. The transforms are then merged without sorting suffixes again: an
interleave says which row of which shard comes next in the merged order; one refinement, a stable
distribution of the rows by their symbol in the transform, turns the order by the first j bytes into
the order by the first j + 1. Where a row leads is told by its rank: the k-th row of a shard with a
symbol is one byte to the right of the shard's k-th suffix that begins with it, which holds only as
each transform is sorted. Rows that fall apart in round j + 1 have a common prefix of j bytes.
After 50 rounds the intervals that still hold together are the repeated strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cartsight.llm.sieve import CROWD, NO_ID, Batch, Kind, covered, solve

LENGTH, ANCHOR = 50, 24
#: Surroundings in a shard.
SHARD = 256


def transform(strings: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of rows [n, width] of symbols from 1 to 255; ``used``: their lengths.

    Each row ends with a mark 0 of its own; marks are ordered as the rows are. Gives by row of the
    transform its symbol, the row that starts one byte further left, and its place in ``strings``.
    """
    n, width = strings.shape
    text = np.zeros((n, width + 1), np.int64)
    text[:, :width] = strings
    text[np.arange(width + 1)[None] >= used[:, None]] = 0
    real = (np.arange(width + 1)[None] <= used[:, None]).ravel()
    flat, number = text.ravel(), np.flatnonzero(real)  # what lies behind a mark is left out
    flat = flat[number]
    size, ends = len(flat), np.cumsum(used + 1) - 1
    left = np.repeat(ends, used + 1) - np.arange(size)  # symbols up to the mark
    key = np.zeros(size, np.int64)
    for k in range(7):
        part = np.zeros(size, np.int64)
        part[: size - k] = flat[k:]
        key = key << 8 | np.where(left >= k, part, 0)
    # a key that holds a mark is told from equal ones by the number of its row
    mine = np.where(left < 7, np.repeat(np.arange(n), used + 1), 0)
    order, reach = np.lexsort((mine, key)), 7
    while True:
        k, m = key[order], mine[order]
        new = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        rank = np.empty(size, np.int64)
        rank[order] = np.r_[0, np.cumsum(new)]
        if new.all() or reach > width:
            break
        after = np.zeros(size, np.int64)
        after[: size - reach] = rank[reach:]
        key, mine = rank * (size + 1) + np.where(left < reach, 0, after), np.zeros(size, np.int64)
        order = np.argsort(key, kind="stable")
        reach *= 2
    before = np.arange(size) - 1
    starts = ends - used
    before[starts] = ends  # what stands before a row's first byte is its mark
    at = np.empty(size, np.int64)
    at[order] = np.arange(size)
    return flat[before][order].astype(np.uint8), at[before][order].astype(np.int32), number[order]


def step_left(symbols: np.ndarray) -> np.ndarray:
    """For each row of a transform the row that begins one byte further left, by the rank of its symbol
    among equal ones. Rows with the mark lead to no suffix that anything asks for."""
    left = np.empty(len(symbols), np.int32)
    left[np.argsort(symbols, kind="stable")] = np.arange(len(symbols), dtype=np.int32)
    return left


def merge(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the transforms, in merged order, that share a prefix of ``rounds`` bytes with another,
    the numbers of their intervals, and for all rows the common prefix: the bytes, up to ``rounds``,
    that a row shares with the one it is most like.

    Rows are numbered through all shards. The order starts as it is and is refined by distributing
    the rows stably by symbol; each then stands for the suffix one byte to its left. Rows that are
    alone in their interval stay alone whatever comes before them, and are dropped as settled, as are
    marks.
    """
    symbols = np.concatenate(transforms)
    starts = np.cumsum([0, *map(len, transforms[:-1])])
    left = np.concatenate([step_left(t) + np.int32(at) for t, at in zip(transforms, starts, strict=True)])
    row = np.arange(len(symbols), dtype=np.int32)
    interval = np.zeros(len(symbols), np.int32)
    prefix = np.zeros(len(symbols), np.uint8)
    for done in range(1, rounds + 1):
        symbol = symbols[row]
        on = symbol != 0
        row, interval, symbol = row[on], interval[on], symbol[on]
        order = np.argsort(symbol, kind="stable")
        row, symbol, block = left[row[order]], symbol[order], interval[order]
        new = np.ones(len(row) + 1, bool)
        new[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        several = ~(new[:-1] & new[1:])
        row, interval = row[several], np.cumsum(new[:-1][several], dtype=np.int32) - 1
        prefix[row] = done
        if not len(row):
            break
    return row, interval, prefix


def first_documents(around: np.ndarray, inside: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each 50-byte window of each row the smallest document that has it [rows, windows]."""
    n, width = around.shape
    starts = width - LENGTH + 1
    out = np.repeat(docs[:, None], starts, axis=1)
    # bytes of a row outside its document lie at its ends: rows are moved to the left, and end early
    used, first = inside.sum(axis=1), inside.argmax(axis=1)
    moved = np.take_along_axis(
        around, np.minimum(np.arange(width)[None] + first[:, None], width - 1), axis=1
    )
    _, codes = np.unique(moved, return_inverse=True)
    codes = codes.reshape(moved.shape) + 1  # fewer than 256: some byte values are in no UTF-8 text
    transforms, places = [], []
    for at in range(0, n, SHARD):
        symbols, _, place = transform(codes[at : at + SHARD], used[at : at + SHARD])
        transforms.append(symbols)
        places.append(place + at * (width + 1))
    rows, interval, _ = merge(transforms, LENGTH)
    if not len(rows):
        return out
    row, column = np.divmod(np.concatenate(places)[rows], width + 1)
    column += first[row]
    use = column < starts
    least = np.full(int(interval[-1]) + 1, NO_ID)
    np.minimum.at(least, interval[use], docs[row[use]])
    out[row[use], column[use]] = least[interval[use]]
    return out


def _bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


def removed(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept for every row of ``docs``.

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id.
    A NULL text is empty. Rows with a NULL id come after all ids and lose nothing to each other, as
    do rows with the same id. Texts shorter than 50 bytes keep everything. ``kept`` is what is left,
    as bytes, since a cut may fall inside a character. Other columns are ignored. An anchor with more than
    ``crowd`` occurrences is split by window, which changes no result.
    """

    def report(batch: Batch, hit: np.ndarray) -> pa.RecordBatch:
        gone = covered(hit, LENGTH)
        rows = []
        for i, (text, a, b) in enumerate(zip(batch.texts, batch.begins, batch.ends, strict=True)):
            out = gone[a:b]
            rest = batch.tokens[a:b][~out].tobytes() if out.any() else text
            spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
            doc = None if batch.ids[i] == NO_ID else int(batch.ids[i])
            rows.append((doc, len(text), int(out.sum()), spans, hashlib.sha256(rest).hexdigest(), rest))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )

    kind = Kind(LENGTH, ANCHOR, "u1", 1, _bytes, first_documents)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return solve(docs, kind, report, schema, crowd)


#: The same rows in SQL, from all byte strings of all documents.
_RUN = ", ".join(["digit"] + [f"lead(digit, {k}) OVER ahead" for k in range(1, LENGTH)])
ORACLE = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id,
           coalesce(doc_id, {NO_ID}) AS place,
           regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS digits
    FROM documents),
bytes AS (
    SELECT r, place, unnest(digits) AS digit, generate_subscripts(digits, 1) AS i FROM docs),
runs AS (
    SELECT r, place, digit, i,
           CASE WHEN lead(i, {LENGTH - 1}) OVER ahead IS NOT NULL
                THEN unhex(concat({_RUN})) END AS run
    FROM bytes WINDOW ahead AS (PARTITION BY r ORDER BY i)),
firsts AS (SELECT run, min(place) AS least FROM runs WHERE run IS NOT NULL GROUP BY run),
starts AS (
    SELECT r, i, digit, coalesce(least < place, false) AS hit
    FROM runs LEFT JOIN firsts USING (run)),
marked AS (
    SELECT r, i, digit, bool_or(hit) OVER (PARTITION BY r ORDER BY i
               ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone
    FROM starts),
edges AS (
    SELECT r, i, digit, gone,
           gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens
    FROM marked),
kept AS (
    SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
           string_agg(digit, '' ORDER BY i) FILTER (NOT gone) AS rest
    FROM edges GROUP BY r)
SELECT doc_id, CAST(len(digits) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
