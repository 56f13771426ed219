"""Prefix trie of conversations, by vertical bitmaps in shards.

A shard is a run of conversations by id, ``SHARD_CONVERSATIONS`` at most and ``SHARD_TURNS`` turns, if
no single one has more. In a shard, each pair (position, turn) has a bitset with a bit for every
conversation that has this turn there. Depth first, the bitset of a node intersected with such a
posting is that of a child; its popcount is the number of members, and its intersection with the
conversations of that length lists those that end there.

Nodes that several shards have in common meet by a digest of their path, one row for each shard.
Each such node belongs to the shard with the smallest member. A second pass over the stored shards
adds up every subtree, where lengths and childless nodes count in the owner alone; so sums over shards
are right without any walk up the trie. However many conversations begin alike, they come
as one row for each shard.

NULL roles and texts are empty. Turns go by number, NULL first; those with the same number, by digest.
A turn that occurs twice counts twice. Rows without a conv_id belong to no conversation. An empty
table has no nodes, not even the root, as it has no smallest member. The turns of one conversation
meet in one task, as digests of 32 bytes and not as texts. The ids that end in one node pass through
one task, a row for each shard, since their hash takes them in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartsight.llm.common import stored
from cartsight.llm.merkle import _crc32

SHARD_CONVERSATIONS, SHARD_TURNS = 1024, 1 << 16
#: Conversations of one hundred take their beginning from the first; up to this many turns, less one.
FAMILY, BEGINNINGS = 100, 6
_DIGEST = 32


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, size): turns in order from 0, and the code points of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    known = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).cast("long").alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return known.withColumn("place", F.row_number().over(order) - 1).drop("turn")


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, part, place, digest, size): the turns of every conversation after rebuilding.

    Part 0 comes from the first conversation of its hundred, part 1 from itself. A row in part -1
    stands for the conversation, which may be left without turns.
    """
    conv = F.col("conv_id")
    taken = (F.crc32(conv.cast("string").cast("binary")) % BEGINNINGS).alias("taken")
    ids = own.where("place = 0").select("conv_id", (conv - conv % FAMILY).alias("first_id"), taken)
    nothing = F.lit(None)
    marks = ids.select(
        "conv_id", F.lit(-1).alias("part"), F.lit(0).alias("place"), nothing.cast("binary").alias("digest"), nothing.cast("long").alias("size")
    )
    columns = [F.col("place"), F.col("digest"), F.col("size")]
    beginnings = own.where(F.col("place") < BEGINNINGS - 1).withColumnRenamed("conv_id", "from_id")
    given = (
        ids.where("taken > 0")
        .join(beginnings, (F.col("first_id") == F.col("from_id")) & (F.col("place") < F.col("taken")))
        .select("conv_id", F.lit(0).alias("part"), *columns)
    )
    kept = own.where(F.col("place") >= F.crc32(conv.cast("string").cast("binary")) % BEGINNINGS)
    return marks.unionByName(given).unionByName(kept.select("conv_id", F.lit(1).alias("part"), *columns))


def _pack(most: int, most_turns: int):
    """Sorted rows (conv_id, part, digest, size) to a row for each shard."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64())]
    names = ["shard", "ids", "lengths", "digests", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        lengths: list[int] = []
        digests: list[bytes] = []
        sizes: list[int] = []

        def row(upto: int) -> pa.RecordBatch:
            n = sum(lengths[:upto])
            values = [ids[0]], [ids[:upto]], [lengths[:upto]], [b"".join(digests[:n])], [sizes[:n]]
            del ids[:upto], lengths[:upto], digests[:n], sizes[:n]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            for conv_id, part, digest, size in zip(*[c.to_pylist() for c in batch.columns]):
                if part < 0:
                    if len(ids) >= most or len(digests) >= most_turns:
                        yield row(len(ids))
                    ids.append(conv_id)
                    lengths.append(0)
                else:
                    lengths[-1] += 1
                    digests.append(digest)
                    sizes.append(size)
        if ids:
            yield row(len(ids))

    return run


def shards(conversations: DataFrame, most: int = SHARD_CONVERSATIONS, most_turns: int = SHARD_TURNS) -> DataFrame:
    """The rebuilt conversations in stored shards: shard (its first id), ids, lengths, digests, sizes."""
    rows = rebuilt(stored(turns(conversations), "turns"))
    ordered = (
        rows.repartitionByRange("conv_id")
        .sortWithinPartitions("conv_id", "part", "place")
        .select("conv_id", "part", "digest", "size")
    )
    schema = "shard long, ids array<long>, lengths array<int>, digests binary, sizes array<long>"
    return stored(ordered.mapInArrow(_pack(most, most_turns), schema), "shards")


class Bitmaps:
    """The vertical bitmaps of a shard: bit i stands for its i-th conversation."""

    def __init__(self, lengths: list[int], digests: bytes, sizes: list[int]):
        codes: dict[bytes, int] = {}
        self.turns: list[list[int]] = []
        self.digest: list[bytes] = []
        self.size: list[int] = []
        #: For each position, the bitset of every turn there.
        self.postings: list[dict[int, int]] = [{} for _ in range(max(lengths, default=0))]
        #: For each length, the conversations that have it.
        self.ends: dict[int, int] = {}
        at = 0
        for i, length in enumerate(lengths):
            bit = 1 << i
            own = []
            for position in range(length):
                digest = digests[at * _DIGEST : (at + 1) * _DIGEST]
                code = codes.setdefault(digest, len(codes))
                if code == len(self.digest):
                    self.digest.append(digest)
                    self.size.append(sizes[at])
                posting = self.postings[position]
                posting[code] = posting.get(code, 0) | bit
                own.append(code)
                at += 1
            self.turns.append(own)
            self.ends[length] = self.ends.get(length, 0) | bit
        self.all = (1 << len(lengths)) - 1

    def nodes(self) -> list[tuple[int, int, int, int, int]]:
        """(parent, depth, turn, members, ends) in depth-first order; the root has no parent: -1.

        Only the turns that some member has next are tried: the lowest member left names one, and its
        posting takes all that share it.
        """
        found = []
        left = [(-1, 0, -1, self.all)]
        while left:
            parent, depth, turn, members = left.pop()
            ended = members & self.ends.get(depth, 0)
            me = len(found)
            found.append((parent, depth, turn, members, ended))
            rest = members ^ ended
            children = []
            while rest:
                lowest = (rest & -rest).bit_length() - 1
                code = self.turns[lowest][depth]
                child = members & self.postings[depth][code]
                children.append((me, depth + 1, code, child))
                rest ^= child
            left.extend(reversed(children))
        return found


def _bits(members: int) -> list[int]:
    found = []
    while members:
        lowest = members & -members
        found.append(lowest.bit_length() - 1)
        members ^= lowest
    return found


def _keys(bitmaps: Bitmaps, nodes: list[tuple[int, int, int, int, int]]) -> list[bytes]:
    """A digest of the path to each node, equal in all shards."""
    keys: list[bytes] = []
    for parent, _, turn, _, _ in nodes:
        path = b"" if parent < 0 else keys[parent] + bitmaps.digest[turn]
        keys.append(hashlib.sha256(path).digest()[:16])
    return keys


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shard, conv_id, has_children) of every node of each shard."""
    for batch in batches:
        for row in batch.to_pylist():
            bitmaps = Bitmaps(row["lengths"], row["digests"], row["sizes"])
            nodes = bitmaps.nodes()
            least = [row["ids"][(n[3] & -n[3]).bit_length() - 1] for n in nodes]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_keys(bitmaps, nodes), pa.binary()),
                    pa.array([row["shard"]] * len(nodes), pa.int64()),
                    pa.array(least, pa.int64()),
                    pa.array([n[3] != n[4] for n in nodes], pa.bool_()),
                ],
                names=["key", "shard", "conv_id", "has_children"],
            )


_SUMS = [
    ("key", "binary", pa.binary()),
    ("shard", "long", pa.int64()),
    ("shared", "boolean", pa.bool_()),
    ("conv_id", "long", pa.int64()),
    ("depth", "long", pa.int64()),
    ("parent_conv_id", "long", pa.int64()),
    ("n_convs", "long", pa.int64()),
    ("n_children", "long", pa.int64()),
    ("n_leaves", "long", pa.int64()),
    ("saved_tokens", "long", pa.int64()),
    ("ends", "array<long>", pa.list_(pa.int64())),
    ("ends_sha256", "string", pa.string()),
]


def _as_text(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def _totals(shard: pa.Table, common: pa.Table) -> pa.Table:
    """What a shard adds to each of its nodes. ``common``: its nodes that other shards have too."""
    columns: list[list] = [[] for _ in _SUMS]
    known = {
        key: (owner, conv_id, has_children)
        for key, owner, conv_id, has_children in zip(*[common[c].to_pylist() for c in ("key", "owner", "conv_id", "has_children")])
    }
    for row in shard.to_pylist():
        ids = row["ids"]
        bitmaps = Bitmaps(row["lengths"], row["digests"], row["sizes"])
        nodes = bitmaps.nodes()
        keys = _keys(bitmaps, nodes)
        n = len(nodes)
        conv, shared, saved, leaves, children = [0] * n, [False] * n, [0] * n, [0] * n, [0] * n
        for i, (parent, _, turn, members, ended) in enumerate(nodes):
            owner, conv[i], has_children = known.get(keys[i]) or (
                row["shard"],
                ids[(members & -members).bit_length() - 1],
                members != ended,
            )
            shared[i] = keys[i] in known
            mine = owner == row["shard"]
            # Summed over shards: a text once for each member, less once for the node.
            size = 0 if turn < 0 else bitmaps.size[turn]
            saved[i] = (members.bit_count() - mine) * size
            leaves[i] = int(mine and not has_children)
            if parent >= 0:
                children[parent] += mine
        for i in range(n - 1, 0, -1):
            parent = nodes[i][0]
            saved[parent] += saved[i]
            leaves[parent] += leaves[i]
        for i, (parent, depth, _, members, ended) in enumerate(nodes):
            ends = [ids[bit] for bit in _bits(ended)]
            digest = None if shared[i] else hashlib.sha256(_as_text(ends)).hexdigest()
            values = (
                keys[i], row["shard"], shared[i], conv[i], depth, conv[parent] if parent >= 0 else None,
                members.bit_count(), children[i], leaves[i], saved[i], ends or None, digest,
            )
            for column, value in zip(columns, values):
                column.append(value)
    return pa.Table.from_arrays([pa.array(v, kind) for v, (_, _, kind) in zip(columns, _SUMS)], names=[c for c, _, _ in _SUMS])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ends) in order to (key, ends_sha256); the hash takes one row at a time."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    for key, group in groupby(rows, key=lambda row: row[0]):
        state = hashlib.sha256()
        for i, (_, ends) in enumerate(group):
            state.update(b"," * (i > 0) + _as_text(ends))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"]
        )


def trie(conversations: DataFrame, most: int = SHARD_CONVERSATIONS, most_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each node: key (digest of its path), conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    packed = shards(conversations, most, most_turns)
    outline = packed.mapInArrow(_outline, "key binary, shard long, conv_id long, has_children boolean")
    alike = Window.partitionBy("key")
    common = (
        outline.select(
            "key",
            "shard",
            F.min("shard").over(alike).alias("owner"),
            F.min("conv_id").over(alike).alias("conv_id"),
            F.max("has_children").over(alike).alias("has_children"),
            F.count("shard").over(alike).alias("shards"),
        )
        .where("shards > 1")
        .drop("shards")
    )
    schema = ", ".join(f"{name} {kind}" for name, kind, _ in _SUMS)
    sums = stored(packed.groupBy("shard").cogroup(common.groupBy("shard")).applyInArrow(_totals, schema), "sums")
    shared = sums.where("shared")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    added = shared.groupBy("key").agg(
        *[F.min(c).alias(c) if c in names[:3] else F.sum(c).alias(c) for c in names]
    )
    ends = (
        shared.where(F.col("ends").isNotNull())
        .select("key", "ends", "shard")
        .repartition("key")
        .sortWithinPartitions("key", "shard")
        .select("key", "ends")
        .mapInArrow(_hash_ends, "key binary, ends_sha256 string")
    )
    no_ends = F.sha2(F.lit("").cast("binary"), 256)
    merged = added.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", no_ends))
    columns = ["key", *names, "ends_sha256"]
    return sums.where("NOT shared").select(*columns).unionByName(merged.select(*columns))


ORACLE = f"""WITH own AS (
  SELECT conv_id, digest, length(text) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text,
               sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id, {_crc32("conv_id::VARCHAR")} % {BEGINNINGS} AS taken FROM own WHERE place = 0),
parts AS (
  SELECT ids.conv_id, 0 AS part, place, digest, size
  FROM ids JOIN own ON own.conv_id = ids.conv_id - ids.conv_id % {FAMILY} AND place < taken
  UNION ALL
  SELECT conv_id, 1, place, digest, size FROM ids JOIN own USING (conv_id) WHERE place >= taken),
placed AS (
  SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM parts),
members AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS size FROM ids
  UNION ALL
  SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth), size FROM placed),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM members GROUP BY path, depth),
parents AS (
  SELECT n.path, p.path AS parent, p.conv_id AS parent_conv_id
  FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1
  JOIN nodes p ON p.path = m.path),
children AS (SELECT parent AS path, count(*) AS n_children FROM parents GROUP BY parent),
below AS (
  SELECT a.path, sum((n.n_convs - 1) * n.size) AS saved_tokens,
         count(*) FILTER (WHERE c.path IS NULL) AS n_leaves
  FROM nodes n JOIN members a ON a.conv_id = n.conv_id AND a.depth <= n.depth
  LEFT JOIN children c ON c.path = n.path
  GROUP BY a.path),
ended AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM members) WHERE depth = last GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.parent_conv_id, n.n_convs,
       coalesce(c.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(e.ends, '')) AS ends_sha256
FROM nodes n LEFT JOIN parents p USING (path) LEFT JOIN children c USING (path)
JOIN below b USING (path) LEFT JOIN ended e USING (path)"""
