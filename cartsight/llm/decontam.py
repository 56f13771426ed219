"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

Test items are cut into parts of at most 64 words, documents into passages of 128 words that start
every 64 words, so every part that a document holds lies inside one passage. Postings carry the
BM25 impact of a term on a part, divided by the part's score for itself, and lie in blocks with the
largest impact of each. Block-max WAND retrieves all parts that a passage scores above a threshold;
question and answer of the item are then looked for in the document.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
PART, PASSAGE, STEP = 64, 128, 64
SHINGLE = 5
K1, B = 1.2, 0.75
#: Postings of a block, and words of the test items that one index holds at most.
BLOCK, INDEX_WORDS = 64, 2_000_000
#: Ranges of parts whose bounds all passages are tested against before they query.
RANGES = 64


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of all sentences but the last, and of the last; of one sentence, of its last quarter."""
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; of fewer words the whole run."""
    if len(words) <= SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def overlap(words: list[str], there: list[str]) -> float:
    """The part of the shingles of ``words`` that ``there`` holds; 1 for no words."""
    wanted = shingles(words)
    if not wanted:
        return 1.0
    size = len(next(iter(wanted)))
    held = set(zip(*(there[i:] for i in range(size)), strict=False))
    return len(wanted & held) / len(wanted)


@dataclass
class Index:
    """Postings by term: part numbers, impacts, and the largest impact and last part of each block."""

    parts: list[int] = field(default_factory=list)  # the item of each part
    items: dict[int, list[str]] = field(default_factory=dict)  # the texts with an id
    postings: dict[str, tuple[list[int], list[float]]] = field(default_factory=dict)
    blocks: dict[str, tuple[list[int], list[float]]] = field(default_factory=dict)
    top: dict[str, float] = field(default_factory=dict)
    # the same for ``width`` parts in a row: terms by number, and their largest impacts
    number: dict[str, int] = field(default_factory=dict)
    width: int = 1
    bounds: np.ndarray | None = None  # [terms, ranges]

    def query(
        self, terms: set[str], threshold: float, low: int, high: int
    ) -> list[tuple[int, float]]:
        """(part, score) of the parts from ``low`` to before ``high`` that score at least
        ``threshold``: block-max WAND. ``terms`` are terms of the index.
        """
        lists = []
        for t in sorted(terms):
            at = self.postings[t][0]
            if (k := bisect_left(at, low)) < len(at) and at[k] < high:
                lists.append([at[k], t, k])
        out = []
        while True:
            lists.sort()
            bound, pivot = 0.0, None
            for i, (part, term, _) in enumerate(lists):
                bound += self.top[term]
                if bound >= threshold - 1e-9:
                    pivot = part
                    last = i
                    break
            if pivot is None:
                return out
            while last + 1 < len(lists) and lists[last + 1][0] == pivot:
                last += 1
            # the bound once more, from the blocks that the pivot would lie in
            bound, after = 0.0, math.inf
            for _, term, _ in lists[: last + 1]:
                ends, most = self.blocks[term]
                if (k := bisect_left(ends, pivot)) < len(ends):
                    bound += most[k]
                    after = min(after, ends[k] + 1)
            if last + 1 < len(lists):
                after = min(after, lists[last + 1][0])
            if bound >= threshold - 1e-9:
                score = 0.0
                for _, term, _ in lists[: last + 1]:
                    at, weight = self.postings[term]
                    k = bisect_left(at, pivot)
                    if k < len(at) and at[k] == pivot:
                        score += weight[k]
                if score >= threshold - 1e-9:
                    out.append((pivot, score))
                after = pivot + 1
            after = max(after, pivot + 1)  # no part before this one can reach the threshold
            for entry in lists[: last + 1]:
                at = self.postings[entry[1]][0]
                entry[2] = bisect_left(at, after, entry[2])
                entry[0] = at[entry[2]] if entry[2] < len(at) else high
            lists = [x for x in lists if x[0] < high]

    def passages(self, docs: list[list[str]], threshold: float) -> list[dict[int, float]]:
        """For each document (its words) the best score of each item over all passages.

        The block-max test of all passages comes first: the bounds of a passage on every block of
        parts are the sums of its terms' largest impacts there. Passages with a block that can
        reach the threshold are queried.
        """
        out: list[dict[int, float]] = [{} for _ in docs]
        counts = np.array([len(range(0, max(1, len(w) - STEP), STEP)) for w in docs])
        lo = 0
        while lo < len(docs):  # some thousands of passages at a time
            hi = lo + 1
            while hi < len(docs) and counts[lo : hi + 1].sum() <= 2_000:
                hi += 1
            for d, k, words in self._promising(docs[lo:hi], counts[lo:hi], threshold):
                terms, at = self.top.keys() & set(words), k * self.width
                for part, score in self.query(terms, threshold, at, at + self.width):
                    item, mine = self.parts[part], out[lo + d]
                    mine[item] = max(score, mine.get(item, 0.0))
            lo = hi
        return out

    def _promising(
        self, docs: list[list[str]], counts: np.ndarray, threshold: float
    ) -> Iterator[tuple[int, int, list[str]]]:
        """(document, range, words of the passage) where the bound reaches the threshold."""
        sizes, number = np.array([len(w) for w in docs]), self.number.get
        ids = np.fromiter((number(w, -1) for words in docs for w in words), np.int64, sizes.sum())
        known = np.flatnonzero(ids >= 0)
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, known, side="right")
        base = np.cumsum(counts) - counts
        own = (known - (ends - sizes)[doc]) // STEP  # the last passage that the word is in
        term, last = ids[known], np.minimum(own, counts[doc] - 1)
        again = (own > 0) & (own - 1 < last)
        place = np.r_[(base[doc] + last), (base[doc] + own - 1)[again]]
        pairs = np.unique(place * len(self.number) + np.r_[term, term[again]])
        place, term = np.divmod(pairs, max(1, len(self.number)))
        if not len(place):
            return
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        bound = np.add.reduceat(self.bounds[term], first, axis=0)
        for row, k in zip(*(x.tolist() for x in np.nonzero(bound >= threshold - 1e-4)), strict=True):
            p = int(place[first[row]])
            d = int(np.searchsorted(base + counts, p, side="right"))
            start = (p - int(base[d])) * STEP
            yield d, k, docs[d][start : start + PASSAGE]


def build(parts: list[tuple[int, list[str]]], texts: list[tuple[int, str]], df: dict[str, int], n: int, mean: float) -> Index:
    """Index ``parts`` (item, words), with document frequencies of all ``n`` parts there are."""
    index = Index()
    for item, text in texts:
        index.items.setdefault(item, []).append(text)
    for number, (item, words) in enumerate(parts):
        index.parts.append(item)
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        impact = {}
        for w, tf in counts.items():
            idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
            impact[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
        own = sum(impact.values())
        for w, x in impact.items():
            at, weight = index.postings.setdefault(w, ([], []))
            at.append(number)
            weight.append(x / own)
    for w, (at, weight) in index.postings.items():
        cuts = range(0, len(at), BLOCK)
        index.blocks[w] = ([at[min(i + BLOCK, len(at)) - 1] for i in cuts], [max(weight[i : i + BLOCK]) for i in cuts])
        index.top[w] = max(weight)
    index.number = {w: i for i, w in enumerate(index.postings)}
    index.width = max(1, -(-len(parts) // RANGES))
    index.bounds = np.zeros((len(index.number), -(-len(parts) // index.width)), np.float32)
    for w, (at, weight) in index.postings.items():
        np.maximum.at(index.bounds[index.number[w]], np.array(at) // index.width, weight)
    return index


def indexes(spark: SparkSession, items: DataFrame) -> Iterator[Index]:
    """Indexes over all of ``items`` (item_id, text), each of about INDEX_WORDS words at most.

    Statistics are those of all items, counted by Spark. What the driver holds and sends out at a
    time is one index, whose size is bounded.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                rows += [(item, words[i : i + PART]) for i in range(0, len(words), PART)]
            ids, parts = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.list_(pa.string()))], ["item_id", "words"])

    known = items.selectExpr("CAST(item_id AS BIGINT) item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    parts = known.mapInArrow(cut, "item_id long, words array<string>")
    n, total = parts.agg(F.count("item_id"), F.sum(F.size("words"))).first()
    if not n:
        return
    places = math.ceil(total / INDEX_WORDS)
    place = F.pmod(F.xxhash64("item_id"), F.lit(places))
    frequency = parts.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("w").alias("df"))
    for k in range(places):
        mine = sorted((r[0], r[1]) for r in parts.where(place == k).collect())
        texts = sorted((r[0], r[1]) for r in known.where(place == k).collect())
        if not mine:
            continue
        if places > 1:
            own = parts.where(place == k).select(F.explode("words").alias("w")).distinct()
            df = dict(frequency.join(own, "w", "left_semi").collect())
        else:
            df = dict(frequency.collect())
        yield build(mine, texts, df, n, total / n)


def leaks(index: Index, texts: list[str | None], threshold: float, least: float) -> list[list[tuple]]:
    """For each text the (item, score, question overlap, answer overlap) that it gives away."""
    docs = [words_of(t) if t else [] for t in texts]
    out = []
    for words, found in zip(docs, index.passages(docs, threshold), strict=True):
        mine = []
        for item, score in sorted(found.items()):
            halves = map(question_and_answer, index.items[item])
            best = max(((overlap(q, words), overlap(a, words)) for q, a in halves), key=min)
            if min(best) >= least:
                mine.append((item, score, *best))
        out.append(mine)
    return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row for each document that
    holds question and answer of a test item.

    ``threshold`` is the part of an item part's own BM25 score that a passage must reach, ``least``
    the part of the five-word shingles of question and of answer that the document must hold.
    NULL or empty texts hold nothing; NULL ids are returned as NULL; equal rows give one row; items
    without id or text are left out; without items or documents the result is empty. Other columns
    are ignored. Texts are read whole.
    """
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    slim = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")
    for index in indexes(spark, items):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
                every = leaks(sent.value, texts, threshold, least)
                rows = [(d, *x) for d, found in zip(ids, every, strict=True) for x in found]
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                kinds = [pa.int64()] * 2 + [pa.float64()] * 3
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    figures = ["score", "question_overlap", "answer_overlap"]
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in figures))


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.5, least: float = 0.8) -> DataFrame:
    """``docs`` without the rows that :func:`contaminated` finds, all columns as they are."""
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"))
    for index in indexes(spark, items):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch["row"].field("text").to_pylist()
                keep = [not found for found in leaks(sent.value, texts, threshold, least)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("row.*")
