"""Byte-level BPE of whole texts: the merges are replayed once over the words of the whole corpus.

``encode`` works in three steps.

1. Each task cuts its texts into words by the tokenizer's pattern, in blocks of ``BLOCK_CHARS`` code
   points. A text becomes the numbers of its words in the list of distinct words of its block; both
   are written to the shared folder, so texts are read and cut once and never shuffled.
2. The words of all blocks are shuffled by a share of them, told by a hash, so that each distinct word
   of the corpus meets the merges once. ``replay`` holds an inverted index from token pair to the
   positions where it stands in the words; it takes the pairs in the order of their ranks, merges all
   positions of a pair and updates the index for the touched neighbours only.
3. The ids go back to their block, where the texts are put together from them.

A word occurs once per block at most, however common it is, so no word fills a task. A block holds
a bounded amount of text, or a single longer one. What is shuffled is a row for each block and share,
with its words or ids side by side. ``decode`` turns ids back into bytes.

NULL and empty texts have no ids. Repeated rows and NULL keys are rows like any other; an empty
table gives an empty one. Other columns than the text and the keys are not read.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartsight.llm.common import shared_path

#: Code points of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 1 << 25
#: Words, and code points of words, after which a replay takes no further share.
REPLAY_WORDS, REPLAY_CHARS = 1 << 17, 1 << 24
#: Shares of the words for each shuffle partition.
SHARES = 4
_WORD_END = -1
#: Texts that go from or to Spark at once.
_TEXTS = 512


class Vocabulary:
    """Tokens by rank, and the rank into which a pair of tokens merges."""

    def __init__(self, rank_file: bytes):
        self.ranks = {
            base64.b64decode(token): int(rank)
            for token, rank in map(bytes.split, filter(None, rank_file.splitlines()))
        }
        self.size = max(self.ranks.values()) + 1
        #: Key of a pair: left rank times ``size`` plus right rank.
        self.pairs = {
            self.ranks[token[:cut]] * self.size + self.ranks[token[cut:]]: rank
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in self.ranks and token[cut:] in self.ranks
        }
        keys = np.array(sorted(self.pairs), np.int64)
        self.pair_keys = keys
        self.pair_ranks = np.array([self.pairs[k] for k in keys.tolist()], np.int64)
        self.byte_ranks = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())


@lru_cache(maxsize=4)
def vocabulary(rank_file: bytes) -> Vocabulary:
    return Vocabulary(rank_file)


def replay(words: Sequence[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, offsets of each word's first id and the end).

    All words lie in one sequence with a mark behind each. ``places`` is the inverted index: for
    each pair, by the rank it merges into, the positions of its left token. Pairs that spell the same
    token share an entry, as the rank file gives them one rank. The lowest rank is taken first, its
    positions from left to right. Should a merge give rise to a pair of an even lower rank, the
    remaining positions in that word wait until the lower one has been done, so every word sees its
    merges in exactly the order that it would see alone. A word that is a token is that token.
    """
    whole = [vocab.ranks.get(word) for word in words]
    open_words = [word for word, rank in zip(words, whole) if rank is None and word]
    text = np.frombuffer(b"".join(open_words), np.uint8)
    lengths = np.fromiter(map(len, open_words), np.int64, len(open_words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    word_at = np.repeat(np.arange(len(open_words)), lengths + 1)
    tokens = np.full(len(word_at), _WORD_END, np.int64)
    tokens[np.arange(len(text)) + np.repeat(np.arange(len(open_words)), lengths)] = vocab.byte_ranks[text]

    places: dict[int, list[int]] = {}
    if len(tokens):
        left, right = tokens[:-1], tokens[1:]
        keys = np.where((left >= 0) & (right >= 0), left * vocab.size + right, -1)
        slot = np.minimum(np.searchsorted(vocab.pair_keys, keys), len(vocab.pair_keys) - 1)
        known = np.nonzero(vocab.pair_keys[slot] == keys)[0]
        ranks = vocab.pair_ranks[slot[known]]
        order = np.argsort(ranks, kind="stable")
        found, first = np.unique(ranks[order], return_index=True)
        for rank, group in zip(found.tolist(), np.split(known[order], first[1:])):
            places[rank] = group.tolist()

    now, after = tokens.tolist(), list(range(1, len(tokens) + 1))
    before = list(range(-1, len(tokens) - 1))
    pair_rank, size = vocab.pairs.get, vocab.size
    ranks_left = list(places)
    heapq.heapify(ranks_left)

    def add(rank: int, position: int) -> None:
        held = places.get(rank)
        if held is None:
            places[rank] = [position]
            heapq.heappush(ranks_left, rank)
        else:
            held.append(position)

    while ranks_left:
        rank = heapq.heappop(ranks_left)
        waiting, until = [], -1
        for p in sorted(places.pop(rank)):
            if p < until:
                waiting.append(p)
                continue
            a = now[p]
            if a < 0:
                continue
            q = after[p]
            b = now[q]
            if b < 0 or pair_rank(a * size + b) != rank:
                continue
            now[p], now[q] = rank, _WORD_END
            r = after[p] = after[q]
            before[r] = p
            lower = False
            c = now[r]
            if c >= 0 and (new := pair_rank(rank * size + c)) is not None:
                add(new, p)
                lower = new < rank
            o = before[p]
            if o >= 0 and now[o] >= 0 and (new := pair_rank(now[o] * size + rank)) is not None:
                add(new, o)
                lower = lower or new < rank
            if lower:
                until = int(starts[word_at[p]] + lengths[word_at[p]])
        for p in waiting:
            add(rank, p)

    left_over = np.array(now, np.int64)
    stand = np.nonzero(left_over >= 0)[0]
    merged, counts = left_over[stand], np.bincount(word_at[stand], minlength=len(open_words))
    # Words that are tokens, and empty ones, go between the others.
    each = np.array([rank is not None for rank in whole], np.int64)
    is_open = np.array([rank is None and bool(word) for word, rank in zip(words, whole)], bool)
    each[is_open] = counts
    offsets = np.concatenate([[0], np.cumsum(each)])
    ids = np.empty(offsets[-1], np.int32)
    from_open = np.repeat(is_open, each)
    ids[from_open] = merged
    ids[~from_open] = [rank for rank in whole if rank is not None]
    return ids, offsets


def _planes(numbers) -> bytes:
    """Numbers as four planes of bytes, lowest first; the upper ones hardly take room compressed."""
    return np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    raw = np.frombuffer(planes, np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(raw).view("<u4").reshape(-1).astype(np.int64)


def _pieces(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of pieces that begin at ``starts`` and are ``counts`` long, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _cut(pattern: str, n_keys: int, block_chars: int, shares: int):
    """Rows of texts to rows (block, keys, numbers) and, for each share of its words, (block, share,
    numbers, words) with the words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words_of = regex.compile(pattern).findall
        block = TaskContext.get().partitionId() << 32
        number: dict[str, int] = {}
        chars, kinds = 0, []
        names = ["block", *[f"key{i}" for i in range(n_keys)], "numbers", "share", "words"]

        def rows(batch: pa.RecordBatch, planes: list[bytes], start: int) -> pa.RecordBatch:
            n = len(planes)
            keys = [batch.column(i).slice(start, n) for i in range(n_keys)]
            rest = [pa.array(planes, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *keys, *rest], names=names)

        def words() -> pa.RecordBatch:
            listed: list[list[str]] = [[] for _ in range(shares)]
            for word in sorted(number):
                listed[zlib.crc32(word.encode()) % shares].append(word)
            used = [i for i in range(shares) if listed[i]]
            n = len(used)
            keys = [pa.nulls(n, kind) for kind in kinds]
            planes = [_planes([number[word] for word in listed[i]]) for i in used]
            rest = [pa.array(planes, pa.binary()), pa.array(used, pa.int32()), pa.array([listed[i] for i in used], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *keys, *rest], names=names)

        for batch in batches:
            kinds = [batch.column(i).type for i in range(n_keys)]
            planes, start = [], 0
            for at, text in enumerate(batch.column(n_keys)):
                found = words_of(text.as_py() or "")
                size = sum(map(len, found))
                if chars and chars + size > block_chars:
                    yield rows(batch, planes, start)
                    yield words()
                    block, chars, number, planes, start = block + 1, 0, {}, [], at
                chars += size
                planes.append(_planes([number.setdefault(w, len(number)) for w in found]))
                if len(planes) == _TEXTS:
                    yield rows(batch, planes, start)
                    planes, start = [], at + 1
            yield rows(batch, planes, start)
        if number:
            yield words()

    return run


def _replayed(rank_file: bytes, most_words: int, most_chars: int):
    """Rows (share, block, numbers, words), shares in order, to (block, numbers, counts, ids).

    A share is replayed as a whole, unless it alone exceeds the bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(rank_file)
        held: list[tuple[int, bytes, list[str]]] = []

        def done() -> pa.RecordBatch:
            code: dict[str, int] = {}
            codes = [np.array([code.setdefault(w, len(code)) for w in words], np.int64) for _, _, words in held]
            ids, offsets = replay([w.encode() for w in code], vocab)
            counts = np.diff(offsets)
            own = [ids[_pieces(offsets[c], counts[c])] for c in codes]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block for block, _, _ in held], pa.int64()),
                    pa.array([numbers for _, numbers, _ in held], pa.binary()),
                    pa.array([_planes(counts[c]) for c in codes], pa.binary()),
                    pa.array([_planes(x) for x in own], pa.binary()),
                ],
                names=["block", "numbers", "counts", "ids"],
            )

        last, size, n = None, 0, 0
        for batch in batches:
            for share, block, numbers, words in zip(*[column.to_pylist() for column in batch.columns]):
                full = n >= most_words or size >= most_chars
                if held and (full and share != last or n >= 16 * most_words or size >= 16 * most_chars):
                    yield done()
                    held, size, n = [], 0, 0
                held.append((block, numbers, words))
                last, size, n = share, size + sum(map(len, words)), n + len(words)
        if held:
            yield done()

    return run


def _encoded(texts: pa.Table, names: list[str]) -> pa.Schema:
    return pa.schema([*[texts.schema.field(name) for name in names], ("ids", pa.list_(pa.int32()))])


def _put_together(n_keys: int):
    """The texts of a block, and the ids of its words, to (keys, ids)."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        def joined(name: str) -> np.ndarray:
            parts = [_numbers(planes) for planes in answers[name].to_pylist()]
            return np.concatenate(parts) if parts else np.empty(0, np.int64)

        order = np.argsort(joined("numbers"))
        counts, ids = joined("counts"), joined("ids").astype(np.int32)
        starts = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        names = [f"key{i}" for i in range(n_keys)]
        parts = []
        for batch in texts.to_batches(max_chunksize=_TEXTS):
            own = []
            for planes in batch.column("numbers"):
                words = _numbers(planes.as_py())
                own.append(ids[_pieces(starts[words], counts[words])])
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(own), pa.int32()))
            parts.append(pa.RecordBatch.from_arrays([*[batch.column(name) for name in names], lists], names=[*names, "ids"]))
        return pa.Table.from_batches(parts, schema=_encoded(texts, names))

    return run


def encode(
    docs: DataFrame,
    rank_file: bytes,
    pattern: str,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
    replay_words: int = REPLAY_WORDS,
) -> DataFrame:
    """(keys, ids): the ids of every whole text, as ``encode_ordinary`` of a BPE library gives them.

    ``rank_file`` is the content of a rank file, a bounded piece of data; ``pattern`` splits texts
    into words. Special tokens are text like any other.
    """
    spark = docs.sparkSession
    n = len(keys)
    kinds = [T.StructField(f"key{i}", docs.schema[k].dataType) for i, k in enumerate(keys)]
    cut_schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            *kinds,
            T.StructField("numbers", T.BinaryType()),
            T.StructField("share", T.IntegerType()),
            T.StructField("words", T.ArrayType(T.StringType())),
        ]
    )
    chosen = docs.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("t"))
    # Filed by block, so that the texts need not be shuffled when their ids come back.
    path = shared_path(spark, "blocks")
    entry = f"llm_{path.rsplit('/', 1)[1].replace('-', '_')}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = chosen.mapInArrow(_cut(pattern, n, block_chars, SHARES * buckets), cut_schema)
    cut.write.bucketBy(buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(entry)
    blocks = spark.table(entry)

    answers = (
        blocks.where(F.col("share").isNotNull())
        .select("share", "block", "numbers", "words")
        .repartition("share")
        .sortWithinPartitions("share")
        .mapInArrow(_replayed(rank_file, replay_words, REPLAY_CHARS), "block long, numbers binary, counts binary, ids binary")
    )
    texts = blocks.where(F.col("share").isNull()).drop("share", "words")
    schema = T.StructType([*kinds, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    encoded = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_put_together(n), schema)
    # A block whose texts have no words has no answers, but its texts stand on the left side.
    return encoded.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], "ids")


def decode(df: DataFrame, rank_file: bytes, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for; NULL stays NULL. An unknown id is an error."""
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(rank_file).tokens
        for batch in batches:
            for start in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(start, _TEXTS)
                lists = part.column(at)
                spelled = tokens.take(lists.flatten())
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                bounds = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int64())
                joined = pc.binary_join(
                    pa.LargeListArray.from_arrays(bounds, spelled), pa.scalar(b"", pa.large_binary())
                )
                joined = pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.large_binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, joined.cast(pa.binary())], names=[*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType())]))
