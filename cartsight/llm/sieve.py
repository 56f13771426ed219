"""Windows that occur in several documents: the part that byte and word matching share.

Documents are packed into batches of a few megabytes. In every window of W tokens the run of k tokens
with the smallest hash is its anchor; equal windows have equal anchors at equal places. So windows
of different documents can only be equal where they share an anchor, and everything else is left
out exactly. Three rounds follow, each a shuffle on Spark:

1. every batch sends its distinct anchors to the owners of their hash values, and learns which of
   them occur in other documents too;
2. for these it sends the surroundings (every window around the anchor) with the smallest id that
   has them, equal ones once. The owner of an anchor compares surroundings and answers which of the
   windows occur in a document with a smaller id;
3. every batch puts the answers together.

A message holds the values of one batch for one owner, so a passage that a third of all documents
share is sent once for each batch at most. An anchor with many occurrences may have as many different
surroundings. It is crowded: its windows are sent one by one, to owners by their own hash, and no task
gets more than a bounded number of surroundings of one anchor. The batches are filed by number, so
that answers come to them without moving a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartsight.llm.common import bucketed, stored

BATCH_BYTES = 4 << 20
#: An anchor with more occurrences than this is crowded.
CROWD = 1 << 17
NO_ID = np.iinfo(np.int64).max
_SCHEMA = "batch long, ids array<long>, sizes array<int>, data binary"
_U = np.uint64
_STRIDE, _PIECE = 1 << 16, 1 << 13


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(docs: DataFrame) -> DataFrame:
    """Batches of whole documents: ids, sizes in bytes, and all texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            out = [[number], [ids], [[len(t) for t in texts]], [_zip(b"".join(texts))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["batch", "ids", "sizes", "data"]
            )

        for batch in batches:
            data = batch["text"].cast(pa.binary())
            for i, doc in enumerate(batch["doc_id"].to_pylist()):
                text = data[i].as_py() or b""
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield row()

    slim = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")
    return bucketed(slim.mapInArrow(run, _SCHEMA), "packed", "batch")


@dataclass
class Kind:
    """What tokens are, and how surroundings are compared. Messages hold ``sent`` bytes of a token.

    ``tokens(texts)`` gives the tokens of a list of texts one after the other, and their number by
    text. ``first(around, inside, docs)`` gets surroundings [n, 2W - k], which of their tokens
    exist, and the smallest document of each; it gives for each window of each the smallest document
    that has it [n, W - k + 1].
    """

    window: int
    anchor: int
    dtype: str
    sent: int
    tokens: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    first: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]

    @property
    def starts(self) -> int:
        return self.window - self.anchor + 1

    @property
    def around(self) -> int:
        return 2 * self.window - self.anchor


@dataclass
class Batch:
    """One row of :func:`packed`, ready to work on."""

    ids: np.ndarray
    texts: list[bytes]
    tokens: np.ndarray
    ends: np.ndarray  # of the documents, in tokens
    begins: np.ndarray


def unpacked(kind: Kind, ids: list, sizes: list, data: bytes) -> Batch:
    whole, cuts = _unzip(data), np.r_[0, np.cumsum(sizes)].astype(int).tolist()
    texts = [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    tokens, counts = kind.tokens(texts)
    ends = np.cumsum(counts)
    return Batch(np.array([NO_ID if i is None else i for i in ids], np.int64), texts, tokens, ends, ends - counts)


def anchors(kind: Kind, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hash values and document numbers of the anchors of all windows in the batch."""
    n = len(batch.tokens) - kind.window + 1
    docs = np.repeat(np.arange(len(batch.ends), dtype=np.int32), batch.ends - batch.begins)
    places, values = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for low in range(0, n, _STRIDE):  # pieces that fit the processor's cache
        part = batch.tokens[low : low + _STRIDE + kind.window - 1]
        h = _hashes(part, kind.anchor)
        # leftmost smallest value of each run of ``starts`` places, by doubling
        value, place, width = h, np.arange(len(h), dtype=np.int32), 1
        while 2 * width <= kind.starts:
            value, place = _smaller(value, place, width)
            width *= 2
        if width < kind.starts:
            value, place = _smaller(value, place, kind.starts - width)
        at = np.arange(low, low + len(place))
        place = place[at + kind.window <= batch.ends[docs[at]]]
        if len(place):
            place = place[np.r_[True, place[1:] != place[:-1]]]
            places.append(place + np.int64(low))
            values.append(h[place])
    place, h = np.concatenate(places), np.concatenate(values)
    new = np.r_[True, place[1:] != place[:-1]][: len(place)]  # pieces may meet at an anchor
    place, h = place[new], h[new]
    return place, h, docs[place]


def _smaller(value: np.ndarray, place: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    right = value[shift:] < value[:-shift]
    return np.where(right, value[shift:], value[:-shift]), np.where(right, place[shift:], place[:-shift])


def _hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` tokens: eight bytes at a time, or one long at a time."""
    if tokens.dtype == np.uint8:
        words = np.ndarray((len(tokens) - 7,), "<u8", np.ascontiguousarray(tokens), strides=(1,)).copy()
        step, parts = 8, length // 8
    else:
        words, step, parts = tokens, 1, length
    n = len(tokens) - length + 1
    return _mixed((words[i * step : i * step + n] for i in range(parts)), n)


def _mixed(columns: Iterable[np.ndarray], n: int) -> np.ndarray:
    h = np.full(n, 0x9E3779B97F4A7C15, _U)
    for column in columns:
        h ^= column
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    return h


def surroundings(kind: Kind, batch: Batch, place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens around each anchor [n, around], and which lie in its document; others are 0."""
    out = np.zeros((len(place), kind.around), batch.tokens.dtype)
    inside = np.zeros((len(place), kind.around), bool)
    across = np.arange(kind.around)[None] - (kind.window - kind.anchor)
    for low in range(0, len(place), _PIECE):
        part, d = place[low : low + _PIECE], doc[low : low + _PIECE]
        at = part[:, None] + across
        here = (at >= batch.begins[d][:, None]) & (at < batch.ends[d][:, None])
        found = batch.tokens[np.clip(at, 0, len(batch.tokens) - 1)]
        found[~here] = 0
        out[low : low + _PIECE], inside[low : low + _PIECE] = found, here
    return out, inside


def _rows_equal(around: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first of equal rows, and for each row which of these it is."""
    if not len(around):
        return np.zeros(0, int), np.zeros(0, int)
    flags = np.packbits(inside, axis=1)
    whole = np.ascontiguousarray(np.concatenate([np.ascontiguousarray(around).view(np.uint8).reshape(len(around), -1), flags], axis=1))
    _, at, which = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return at, which.ravel()


# --- the three rounds ---------------------------------------------------------------------------


def _messages(number: int, owner: np.ndarray, make: Callable[[np.ndarray], bytes]) -> list[tuple]:
    """(owner, batch, message) with the rows of each owner; ``owner`` is sorted."""
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else [0]
    return [(int(owner[a]), number, make(np.arange(a, b))) for a, b in zip(cuts, cuts[1:], strict=False)]


def _each(rows: pa.RecordBatch) -> Iterator[dict]:
    for i in range(rows.num_rows):
        yield rows.slice(i, 1).to_pylist()[0]


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_LONG, _BIN = pa.int64(), pa.binary()


def _distinct(kind: Kind, batch: Batch, owners: int) -> tuple:
    """Anchors with their distinct values in the order of the messages."""
    place, h, doc = anchors(kind, batch)
    values, which = np.unique(h, return_inverse=True)
    owner = (values % _U(owners)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return place, doc, values[order], owner[order], rank[which.ravel()]


def _ask_anchors(kind: Kind, owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in _each(rows):
                batch = unpacked(kind, r["ids"], r["sizes"], r["data"])
                _, doc, values, owner, which = _distinct(kind, batch, owners)
                if not len(values):
                    continue
                low = np.full(len(values), NO_ID)
                high = np.full(len(values), np.iinfo(np.int64).min)
                np.minimum.at(low, which, batch.ids[doc])
                np.maximum.at(high, which, batch.ids[doc])
                # 42 bits of the value tell anchors apart well enough: a mistaken one only costs
                # a comparison. Five bits say how many occurrences the batch has, as a power of two,
                # and the lowest that several of its documents have it.
                power = np.ceil(np.log2(np.bincount(which, minlength=len(values)))).astype(_U)
                short = (values >> _U(22) << _U(6)) | (power << _U(1)) | (low != high).astype(_U)

                def message(i: np.ndarray, short=short) -> bytes:
                    return (short[i] >> _U(32)).astype("<u2").tobytes() + short[i].astype("<u4").tobytes()

                yield _table(_messages(r["batch"], owner, message), ["owner", "batch", "m"], [_LONG, _LONG, _BIN])

    return run


def _answer_anchors(crowd: int):
    def answer(group: pa.Table) -> pa.Table:
        batches, messages = group["batch"].to_pylist(), group["m"].to_pylist()
        parts = []
        for m in messages:
            n = len(m) // 6
            parts.append(np.frombuffer(m, "<u2", n).astype(_U) << _U(32) | np.frombuffer(m, "<u4", n, 2 * n).astype(_U))
        every = np.concatenate(parts)
        _, which, copies = np.unique(every >> _U(6), return_inverse=True, return_counts=True)
        shared = copies > 1
        np.logical_or.at(shared, which, (every & _U(1)).astype(bool))
        crowded = np.bincount(which, np.exp2((every >> _U(1) & _U(31)).astype(float)), len(copies)) > crowd
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        answers = [
            np.packbits(s).tobytes() + np.packbits(c).tobytes()
            for s, c in zip(np.split(shared[which], cuts), np.split(crowded[which], cuts), strict=True)
        ]
        rows = list(zip(group["owner"].to_pylist(), batches, answers, strict=True))
        return pa.Table.from_batches([_table(rows, ["owner", "batch", "m"], [_LONG, _LONG, _BIN])])

    return answer


def _gathered(answers: DataFrame) -> DataFrame:
    """(batch, answers): the answers to one batch; a few bits for each thing it has asked for."""
    return answers.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("owner", "m"))).alias("answers"))


@dataclass
class Shared:
    """Anchors of a batch that other documents have too, and the different surroundings they have.

    What is sent are surroundings, or single windows of those of crowded anchors. It is in the order
    of the owners, which is that of the messages.
    """

    place: np.ndarray
    doc: np.ndarray
    same: np.ndarray  # which surroundings an anchor has
    sent: np.ndarray  # [surroundings, starts]: what was sent for each of their windows
    owner: np.ndarray
    least: np.ndarray  # the smallest id in the batch that has them
    around: np.ndarray
    inside: np.ndarray


def _shared(kind: Kind, batch: Batch, owners: int, answers: list | None) -> Shared:
    place, doc, values, owner, which = _distinct(kind, batch, owners)
    shared, crowded = np.zeros(len(values), bool), np.zeros(len(values), bool)
    for a in answers or []:
        lo, hi = np.searchsorted(owner, [a["owner"], a["owner"] + 1])
        both = np.unpackbits(np.frombuffer(a["m"], np.uint8)).reshape(2, -1)[:, : hi - lo]
        shared[lo:hi], crowded[lo:hi] = both.astype(bool)
    some = shared[which] if len(which) else np.zeros(0, bool)
    place, doc, which = place[some], doc[some], which[some]
    around, inside = surroundings(kind, batch, place, doc)
    at, same = _rows_equal(around, inside)
    least = np.full(len(at), NO_ID)
    np.minimum.at(least, same, batch.ids[doc])
    around, inside, to = around[at], inside[at], owner[which[at]]
    sent = np.repeat(np.arange(len(at), dtype=np.int32)[:, None], kind.starts, axis=1)
    many = crowded[which[at]] if len(at) else np.zeros(0, bool)
    if many.any():
        around, inside, to, least, sent = _by_window(kind, around, inside, to, least, sent, many, owners)
    order = np.argsort(to, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return Shared(place, doc, same, rank[sent], to[order], least[order], around[order], inside[order])


def _by_window(kind: Kind, around, inside, to, least, sent, many, owners: int) -> tuple:
    """Replaces the surroundings ``many`` by their different windows, each with an owner by its hash.

    A window is sent as a row of surroundings that has nothing outside of it.
    """
    crowd = np.flatnonzero(many)
    rows, flags, owner, low = ([x[~many]] for x in (around, inside, to, least))
    number = np.cumsum(~many) - 1
    sent = np.where(many[:, None], 0, number[:, None]).astype(np.int32).repeat(kind.starts, axis=1)
    n = len(rows[0])
    for start in range(kind.starts):
        span = slice(start, start + kind.window)
        whole = crowd[inside[crowd, span].all(axis=1)]
        if not len(whole):
            continue
        row = np.zeros((len(whole), kind.around), around.dtype)
        row[:, span] = around[whole, span]
        flag = np.zeros((len(whole), kind.around), bool)
        flag[:, span] = True
        at, same = _rows_equal(row, flag)
        first = np.full(len(at), NO_ID)
        np.minimum.at(first, same, least[whole])
        words = np.ascontiguousarray(row[at, span])
        if words.dtype == np.uint8:
            words = np.ascontiguousarray(words[:, : kind.window // 8 * 8]).view("<u8")
        rows.append(row[at])
        flags.append(flag[at])
        owner.append((_mixed(words.T, len(words)) % _U(owners)).astype(np.int64))
        low.append(first)
        sent[whole, start] = n + same
        n += len(at)
    return *(np.concatenate(x) for x in (rows, flags, owner, low)), sent


def _ask_around(kind: Kind, owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in _each(rows):
                found = _shared(kind, unpacked(kind, r["ids"], r["sizes"], r["data"]), owners, r["answers"])
                own = np.ascontiguousarray(found.around).view(np.uint8)
                own = own.reshape(len(own), -1, found.around.itemsize)[:, :, : kind.sent] if len(own) else own
                flags = np.packbits(found.inside, axis=1)

                def message(i: np.ndarray, found=found, own=own, flags=flags) -> bytes:
                    return _zip(found.least[i].astype("<i8").tobytes() + flags[i].tobytes() + own[i].tobytes())

                out = _messages(r["batch"], found.owner, message)
                if out:
                    yield _table(out, ["owner", "batch", "m"], [_LONG, _LONG, _BIN])

    return run


def _agreement(rows: np.ndarray) -> np.ndarray:
    """How many leading tokens each row has in common with another row at most."""
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    order = np.argsort(flat.view(f"S{flat.shape[1]}").ravel() if not (flat == 0).any() else _ranked(flat))
    ahead = rows[order]
    same = np.concatenate([ahead[1:] == ahead[:-1], np.zeros((len(rows) - 1, 1), bool)], axis=1)
    length = same.argmin(axis=1)
    out = np.zeros(len(rows), np.int64)
    out[order[1:]] = length
    out[order[:-1]] = np.maximum(out[order[:-1]], length)
    return out


def _ranked(flat: np.ndarray) -> np.ndarray:
    return np.unique(flat.view(f"V{flat.shape[1]}").ravel(), return_inverse=True)[1].ravel()


def comparable(
    kind: Kind, around: np.ndarray, size: int = 4096
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that may share a window with another row, in groups of about ``size``, and which of
    their tokens can be part of it.

    Rows with one anchor stay together. A row that agrees with others in too few tokens on the left
    and on the right of the anchor to make up a window, taken together, shares none.
    """
    if len(around) < 2:
        return
    cut, end = kind.window - kind.anchor, kind.window
    right = _agreement(around[:, cut:]) - kind.anchor
    left = _agreement(np.concatenate([around[:, cut:end], around[:, :cut][:, ::-1]], axis=1)) - kind.anchor
    some = np.flatnonzero((right >= 0) & (right + left >= cut))
    if not len(some):
        return
    centre = np.ascontiguousarray(around[some, cut:end]).view(np.uint8).reshape(len(some), -1)
    which = _ranked(centre)
    order = np.argsort(which, kind="stable")
    sorted_by, begin = which[order], 0
    at = np.arange(around.shape[1])
    while begin < len(some):
        stop = min(begin + size, len(some))
        stop = int(np.searchsorted(sorted_by, sorted_by[stop - 1], side="right"))
        rows = some[order[begin:stop]]
        yield rows, (at >= cut - left[rows, None]) & (at < end + right[rows, None])
        begin = stop


def _answer_around(kind: Kind):
    width, flag_bytes = kind.around, -(-kind.around // 8)

    def answer(group: pa.Table) -> pa.Table:
        messages = [_unzip(m) for m in group["m"].to_pylist()]
        wide = np.dtype(kind.dtype).itemsize
        size = 8 + flag_bytes + width * kind.sent
        counts = [len(m) // size for m in messages]
        docs, inside, around = [], [], []
        for m, n in zip(messages, counts, strict=True):
            docs.append(np.frombuffer(m, "<i8", n))
            flags = np.frombuffer(m, np.uint8, n * flag_bytes, 8 * n).reshape(n, -1)
            inside.append(np.unpackbits(flags, axis=1, count=width).astype(bool))
            sent = np.frombuffer(m, np.uint8, n * width * kind.sent, (8 + flag_bytes) * n)
            full = np.zeros((n, width, wide), np.uint8)
            full[:, :, : kind.sent] = sent.reshape(n, width, kind.sent)
            around.append(full.view(kind.dtype).reshape(n, width))
        docs, inside, around = map(np.concatenate, (docs, inside, around))
        at, same = _rows_equal(around, inside)
        least = np.full(len(at), NO_ID)
        np.minimum.at(least, same, docs)
        own, there = around[at], inside[at]
        first = np.repeat(least[:, None], kind.starts, axis=1)
        for some, near in comparable(kind, own):
            first[some] = kind.first(own[some], there[some] & near, least[some])
        bits = first[same] < docs[:, None]
        cuts = np.cumsum(counts)[:-1]
        answers = [_zip(np.packbits(b).tobytes()) for b in np.split(bits, cuts)]
        rows = list(zip(group["owner"].to_pylist(), group["batch"].to_pylist(), answers, strict=True))
        return pa.Table.from_batches([_table(rows, ["owner", "batch", "m"], [_LONG, _LONG, _BIN])])

    return answer


def repeated_starts(kind: Kind, batch: Batch, found: Shared, answers: list | None) -> np.ndarray:
    """Which tokens of the batch start a window that also occurs in a document with a smaller id."""
    hit = np.zeros(len(batch.tokens), bool)
    earlier, at = np.zeros((len(found.least), kind.starts), bool), 0
    for a in answers or []:
        bits = np.unpackbits(np.frombuffer(_unzip(a["m"]), np.uint8))
        rows = len(bits) // kind.starts
        earlier[at : at + rows] = bits[: rows * kind.starts].reshape(rows, -1)
        at += rows
    across = np.arange(kind.starts)[None] - (kind.window - kind.anchor)
    for low in range(0, len(found.place), _PIECE):
        place, doc, same = (x[low : low + _PIECE] for x in (found.place, found.doc, found.same))
        row = found.sent[same]
        # a document after the first that has what was sent has no window of it that is new
        again = batch.ids[doc][:, None] > found.least[row]
        start = place[:, None] + across
        fits = (start >= batch.begins[doc][:, None]) & (start + kind.window <= batch.ends[doc][:, None])
        hit[start[fits & (earlier[row, np.arange(kind.starts)] | again)]] = True
    return hit


def covered(hit: np.ndarray, window: int) -> np.ndarray:
    """Which tokens lie in a window that starts at a hit."""
    total = np.cumsum(hit)
    before = np.r_[np.zeros(min(window, len(hit)), total.dtype), total[:-window]] if len(hit) > window else 0
    return total - before > 0


def solve(
    docs: DataFrame, kind: Kind, report: Callable[[Batch, np.ndarray], pa.RecordBatch], schema: str, crowd: int = CROWD
) -> DataFrame:
    """Rows of ``report(batch, repeated starts)`` for every batch of ``docs`` (doc_id, text).

    The result does not depend on ``crowd``; it bounds what one task gets to compare for one anchor.
    """
    spark = docs.sparkSession
    batches = packed(docs)
    n = batches.count()
    owners = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n)
    names = "owner long, batch long, m binary"
    asked = batches.mapInArrow(_ask_anchors(kind, owners), names)
    shared = _gathered(stored(asked.groupBy("owner").applyInArrow(_answer_anchors(crowd), names), "shared"))
    informed = batches.join(shared.withColumnRenamed("answers", "shared"), "batch", "left")
    around = informed.withColumnRenamed("shared", "answers").mapInArrow(_ask_around(kind, owners), names)
    compared = around.groupBy("owner").applyInArrow(_answer_around(kind), names)
    final = informed.join(_gathered(compared), "batch", "left")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for r in _each(part):
                batch = unpacked(kind, r["ids"], r["sizes"], r["data"])
                found = _shared(kind, batch, owners, r["shared"])
                yield report(batch, repeated_starts(kind, batch, found, r["answers"]))

    return final.select("batch", "ids", "sizes", "data", "shared", "answers").mapInArrow(run, schema)
