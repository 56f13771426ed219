"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has 64 bits. Two that differ in at most ``radius`` bits agree in at least one choice of
half their blocks, so equal choices bring them together. There, bit plane p holds bit p of many
fingerprints side by side. One pass over the planes counts the differing bits of 64 pairs a word
with a carry-save counter, and words whose pairs all exceed the radius are abandoned early.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartsight.llm.common import components, stored, text_bytes

_ONE = np.uint64(1)


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the ``width``-word shingles of ``text``, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: only A to Z change
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    hashes = np.array(
        [
            digest(joined[a : b - 1], 42)
            for a, b in zip(starts[: len(words) - width + 1], ends[width - 1 :], strict=True)
        ],
        "<u8",
    )
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch["row"].field("text"))
            found = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found)], ["row", "fp"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("fp", T.LongType())]))


# --- bit-sliced comparison ----------------------------------------------------------------------


def _packed(bits: np.ndarray) -> np.ndarray:
    """Flags to words of 64, with a zero word at the end."""
    data = np.packbits(bits, bitorder="little")
    out = np.zeros(len(bits) // 64 + 2, "<u8")
    out.view(np.uint8)[: len(data)] = data
    return out


def close_pairs(prints: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple]:
    """Index arrays (i, j) of all pairs of one group that differ in at most ``radius`` bits.

    Rows of a group lie together. A step compares every row with the one ``shift`` places on.
    """
    n = len(prints)
    sizes = np.diff(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]))
    planes = [_packed(((prints >> np.uint64(p)) & _ONE).astype(bool)) for p in range(64)]
    width = int(radius).bit_length()
    for shift in range(1, int(sizes.max(initial=1))):
        pairs = _packed(group[shift:] == group[: n - shift])[:-1]
        alive = np.flatnonzero(pairs)
        if not len(alive):
            break
        skip, turn = alive + shift // 64, np.uint64(shift % 64)
        beyond = np.minimum(skip + 1, len(planes[0]) - 1)
        over = ~pairs[alive]
        count = [np.zeros(len(alive), np.uint64) for _ in range(width)]
        for p, plane in enumerate(planes):
            other = plane[skip] >> turn
            if turn:
                other |= plane[beyond] << (np.uint64(64) - turn)
            carry = plane[alive] ^ other
            for k in range(width):  # carry-save: count += differs
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if p % 8 == 7:
                if radius + 1 < 1 << width:  # between the radius and the end of the counter
                    over |= _exceeds(count, radius)
                rest = over != ~np.uint64(0)
                if not rest.all():
                    alive, skip, beyond, over = alive[rest], skip[rest], beyond[rest], over[rest]
                    count = [c[rest] for c in count]
                    if not len(alive):
                        break
        if len(alive):
            found = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(found)
            first = alive[word] * 64 + bit
            yield first, first + shift


def _exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Flags of the counters that are over ``radius``."""
    over, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            equal &= count[k]
        else:
            over |= equal & count[k]
            equal &= ~count[k]
    return over


def _forest(prints: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs that connect what the close pairs connect, one less than the rows at most."""
    tree, edges = np.arange(len(prints)), []

    def top(x: int) -> int:
        while tree[x] != x:
            tree[x] = x = tree[tree[x]]
        return x

    for i, j in close_pairs(prints, group, radius):
        new = tree[i] != tree[j]
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                tree[max(x, y)] = min(x, y)
                edges.append((prints[a], prints[b]))
        if new.any():  # every row knows its root again
            while (tree[tree] != tree).any():
                tree = tree[tree]
    return edges


def block_keys(radius: int) -> list[list[tuple[int, int]]]:
    """Choices of bits (lowest, number) that any two fingerprints within ``radius`` share one of.

    The 64 bits are cut into twice ``radius`` blocks, and a key takes half of them: at most ``radius``
    blocks differ, so there is a choice among the others. For a radius of 3 these are 20 keys of 32 bits.
    """
    n = max(1, 2 * radius)
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [list(chosen) for chosen in itertools.combinations(blocks, max(1, n - radius))]


def links(distinct: DataFrame, radius: int = 3, block: int = 1024) -> DataFrame:
    """Edges (a, b) between the fingerprints ``fp`` of ``distinct`` that connect close ones.

    Fingerprints meet that share one of :func:`block_keys`; with 32 bits a key, few do by chance. A key
    that many fingerprints share is cut into blocks of about ``block``, and every two blocks meet in a
    place of their own, so no task holds more than two blocks of a group.
    """

    def key(bits: list[tuple[int, int]]) -> Column:
        if bits == [(0, 64)]:
            return F.col("fp")
        parts = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << size) - 1)) for lo, size in bits]
        joined = parts[0]
        for part, (_, size) in zip(parts[1:], bits[1:], strict=True):
            joined = F.shiftleft(joined, size).bitwiseOR(part)
        return joined

    keys = F.array(
        *(F.struct(F.lit(i).alias("band"), key(bits).alias("key")) for i, bits in enumerate(block_keys(radius)))
    )
    rows = stored(distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.*"), "bands")
    crowd = (
        rows.groupBy("band", "key")
        .agg(F.count("fp").alias("size"))
        .where("size > 1")
        .select("band", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = (
        rows.join(crowd, ["band", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "band", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
            "fp",
        )
        .repartition("band", "key", "x", "y")
        .sortWithinPartitions("band", "key", "x", "y")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(df: pd.DataFrame) -> pd.DataFrame:
            group = df.groupby(["band", "key", "x", "y"], sort=False).ngroup().to_numpy()
            pairs = _forest(df["fp"].to_numpy().view(np.uint64), group, radius)
            return pd.DataFrame(
                np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"]
            )

        for df in batches:
            held.append(df)
            if sum(map(len, held)) < 20_000:
                continue
            df = pd.concat(held, ignore_index=True)
            last = (df[["band", "key", "x", "y"]] == df[["band", "key", "x", "y"]].iloc[-1]).all(axis=1)
            held = [df[last]]  # its group may go on
            if not last.all():
                yield done(df[~last])
        if held:
            yield done(pd.concat(held, ignore_index=True))

    return met.mapInPandas(compare, "a long, b long")


def classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of ``prints`` (doc_id, fp).

    ``root`` is a fingerprint and names the component; ``component_id``, the smallest id in it, is
    NULL where all ids are, and may be that of several components where ids repeat.
    """
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(distinct, radius))
    linked = stored(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "root", F.coalesce("root", "fp")
        ),
        "linked",
    )
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(linked.join(ids, "root").select("fp", "root", "component_id"), "classes")


def components_of(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    A NULL or empty text has fingerprint zero and is linked like any other. A NULL id counts in no
    minimum; a component of NULL ids alone has a NULL id. Rows that repeat an id are rows of
    their own. Texts are read whole; other columns are ignored; no rows give no rows.
    """
    slim = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")
    prints = stored(fingerprints(slim, width).select("row.doc_id", "fp"), "simhash")
    return prints.join(classes(prints, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row for each component: the one with the smallest id.

    Where the smallest id occurs on several rows of a component, the row with the smallest
    fingerprint stays, and of those with the same fingerprint one. A component of NULL ids alone
    keeps a row too. All columns are kept as they are.
    """
    rows = stored(fingerprints(docs, width), "simhash_rows")
    prints = rows.select("row.doc_id", "fp")
    found = prints.distinct().join(classes(prints, radius), "fp")
    stay = (
        found.groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("k"))
        .select("k.doc_id", "k.fp")
    )
    kept = rows.alias("r").join(
        stay.alias("s"), F.col("r.row.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.fp") == F.col("s.fp"))
    )
    return (
        kept.select("r.row", "r.fp", F.col("r.row.doc_id").alias("_id"))
        .dropDuplicates(["_id", "fp"])
        .select("row.*")
    )
