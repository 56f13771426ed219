"""Merkle manifest of a dataset: a persistent tree, and a version of it for every tampered leaf.

Leaves are the digests of the rows. The leaves of a source, by id, form a tree of runs of ``RUN``
nodes; the roots of the sources, by source, form one more tree above them.

The tree is built in tiers. A tier takes aligned blocks of ``RUN ** LEVELS`` nodes, each to a task,
which gives up to ``LEVELS`` levels of it; the tops of the blocks are the nodes of the next tier. No
task holds more than one block, so a source may have any number of rows, and there may be any
number of sources. Then every block learns its path to the root, from the top tier downwards: the
place and the siblings on each level, a few kilobytes.

A tampered leaf makes a version of the tree by path copying: its ancestors are made anew, first those
within the block, then those on the path above it, and all other nodes are shared with the first
version. Each version is made where its block lies, so versions never meet in one task.

Order of the leaves: NULL ids first; rows with the same id by digest. NULL and the empty text are
different sources and different texts. Repeated rows are leaves of their own. An empty table has
no leaves and gives no rows. Columns that are not digested are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartsight.llm.common import stored

#: Nodes below one node, and levels that a block spans.
RUN, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Hexadecimal digits of a digest.
WIDTH = 64


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the columns as text, each with its length in bytes before it, or as ``-`` if NULL."""
    texts = [c.cast("string") for c in columns]
    parts = [
        F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
        for t in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def without_capitals(text: str | Column) -> Column:
    """The tampering: A to Z as a to z."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def is_chosen(doc_id: str | Column) -> Column:
    """Rows that are tampered with: 5 divides the CRC of the decimal id; never where that is NULL."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, digest, tampered): the leaf of every row, and the leaf it has once tampered with.

    ``tree`` is the source. ``tampered`` is NULL where nobody touches the row.
    """
    own = [F.col(c) for c in FIELDS]
    changed = [without_capitals("text") if c == "text" else F.col(c) for c in FIELDS]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("tree"),
        leaf_digest(own).alias("digest"),
        F.when(is_chosen("doc_id"), leaf_digest(changed)).alias("tampered"),
    )


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``place``, from 0 within each ``tree`` by ``order``, and the ``total`` of the tree.

    One sort by range, which cuts a dominant tree and equal rows; then each sorted piece adds the
    counts of the pieces before it, one row for each piece and tree.
    """
    # Equal rows may get any order, but they need one that spreads over the pieces.
    rows = stored(df.withColumn("tie", F.monotonically_increasing_id()), "rows")
    by = ["tree", *order, "tie"]
    pieces = stored(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("piece", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id())
        .drop("tie"),
        "sorted",
    )
    counts = pieces.groupBy("tree", "piece").agg(F.min("row").alias("first"), F.count("row").alias("n"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("tree").alias("of"),
        F.col("piece").alias("at"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("total"),
    )
    here = F.col("tree").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("at"))
    placed = pieces.join(starts, here).withColumn("place", F.col("row") + F.col("shift"))
    return placed.drop("piece", "row", "of", "at", "shift")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with the same first two columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            if row[:2] != key and held:
                yield key, held
                held = []
            key = row[:2]
            held.append(row[2:])
    if held:
        yield key, held


def block_runs(digests: list[str], total: int, run: int, levels: int) -> tuple[list[list[str]], str]:
    """The runs of a block on each level, each as one string of digests, and the top of the block.

    A tree that fits in one block ends where one node is left; a larger one takes all ``levels``.
    """
    several = total > run**levels
    found = []
    while len(found) < levels if several else len(digests) > 1:
        runs = ["".join(digests[i : i + run]) for i in range(0, len(digests), run)]
        found.append(runs)
        digests = [_hash(text) for text in runs]
    return found, digests[0]


def path_of(runs: list[list[str]], place: int, run: int) -> list[tuple[int, str]]:
    """(place in its run, digests of the others) on each level of a block, upwards."""
    path = []
    for level in runs:
        above, at = divmod(place, run)
        text = level[above]
        path.append((at, text[: at * WIDTH] + text[(at + 1) * WIDTH :]))
        place = above
    return path


def copy_path(digest: str, path: Sequence[tuple[int, str]]) -> list[str]:
    """New ancestors of a leaf, up to the root of the version. All that ``path`` names is shared."""
    copied = []
    for at, others in path:
        digest = _hash(others[: at * WIDTH] + digest + others[at * WIDTH :])
        copied.append(digest)
    return copied


def _in_blocks(nodes: DataFrame, size: int) -> DataFrame:
    block = F.floor(F.col("place") / size).cast("long")
    placed = nodes.withColumn("block", block)
    first = ["tree", "block", "place"]
    rest = [c for c in placed.columns if c not in first]
    return (
        placed.select(*first, *rest)
        .repartition("tree", "block")
        .sortWithinPartitions("tree", "block", "place")
    )


def _climb(nodes: DataFrame, run: int, levels: int) -> DataFrame:
    """The tops of all blocks of a tier as the nodes of the next one."""
    size = run**levels

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (tree, block), rows in _groups(batches):
            total = rows[0][2]
            top = block_runs([r[1] for r in rows], total, run, levels)[1]
            out.append((tree, block, top, -(-total // size)))
            if len(out) == 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["tree", "place", "digest", "total"])

    blocks = _in_blocks(nodes.select("tree", "place", "digest", "total"), size)
    return blocks.mapInArrow(tops, "tree string, place long, digest string, total long")


_PATH = "array<struct<at:int,others:string>>"
_ARROW_PATH = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())]))


def _steps(path: Sequence[tuple[int, str]]) -> list[dict]:
    return [{"at": at, "others": others} for at, others in path]


def _with_paths(nodes: DataFrame, paths: DataFrame, size: int) -> DataFrame:
    """The nodes of a tier in blocks; the first row of each block is its path to the root.

    Columns tree, block, place, digest, total, doc_id, tampered, path, subroot, root.
    """
    empty = {"doc_id": "long", "tampered": "string", "path": _PATH, "subroot": "string", "root": "string"}
    given = nodes.withColumns({c: F.lit(None).cast(t) for c, t in empty.items() if c not in nodes.columns})
    above = paths.withColumnRenamed("place", "block").select(
        "tree",
        (F.col("block") * size - 1).alias("place"),
        "block",
        *[F.lit(None).cast(t).alias(c) for c, t in (("digest", "string"), ("total", "long"), ("doc_id", "long"), ("tampered", "string"))],
        "path",
        "subroot",
        "root",
    )
    given = given.withColumn("block", F.floor(F.col("place") / size).cast("long"))
    both = given.select(*above.columns).unionByName(above)
    order = ["tree", "block", "place"]
    rest = ["digest", "total", "doc_id", "tampered", "path", "subroot", "root"]
    return both.select(*order, *rest).repartition("tree", "block").sortWithinPartitions(*order)


def _blocks_with_path(batches: Iterator[pa.RecordBatch], run: int, levels: int):
    """(tree, runs, rows of the nodes, path of the block, subroot, root) of each block."""
    for (tree, _), rows in _groups(batches):
        head, nodes = rows[0], rows[1:]
        runs, _ = block_runs([r[1] for r in nodes], nodes[0][2], run, levels)
        upper = [(step["at"], step["others"]) for step in head[5]]
        yield tree, runs, nodes, upper, head[6], head[7]


def _descend(nodes: DataFrame, paths: DataFrame, run: int, levels: int) -> DataFrame:
    """(tree, place, path, subroot, root) of each node of a tier, from the paths of its blocks."""
    size = run**levels

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, runs, rows, upper, subroot, root in _blocks_with_path(batches, run, levels):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tree] * len(rows), pa.string()),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([_steps(path_of(runs, r[0] % size, run) + upper) for r in rows], _ARROW_PATH),
                    pa.array([subroot] * len(rows), pa.string()),
                    pa.array([root] * len(rows), pa.string()),
                ],
                names=["tree", "place", "path", "subroot", "root"],
            )

    blocks = _with_paths(nodes, paths, size)
    return blocks.mapInArrow(go, f"tree string, place long, path {_PATH}, subroot string, root string")


def _versions(nodes: DataFrame, paths: DataFrame, run: int, levels: int) -> DataFrame:
    """The rows of :func:`audit`, from the leaves and the paths of their blocks."""
    size = run**levels

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, runs, rows, upper, subroot, root in _blocks_with_path(batches, run, levels):
            above = "".join(others for _, others in upper).encode()
            out = []
            for place, digest, _, doc_id, tampered, *_ in rows:
                inside = path_of(runs, place % size, run)
                proof = hashlib.sha256("".join(others for _, others in inside).encode())
                proof.update(above)
                copied = copy_path(tampered or digest, inside + upper)
                folded = copied[-1] if copied else tampered or digest
                out.append((doc_id, tree, digest, subroot, root, proof.hexdigest(), folded, copied if tampered else None))
            kinds = [pa.int64(), *[pa.string()] * 6, pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)

    names = ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "copied"]
    schema = "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, copied array<string>"
    return _with_paths(nodes, paths, size).mapInArrow(go, schema)


def tiers(nodes: DataFrame, run: int = RUN, levels: int = LEVELS) -> list[DataFrame]:
    """The stored nodes of every tier, from the given ones up to one node for each tree."""
    found = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        found.append(stored(_climb(found[-1], run, levels), "tier"))
        most = -(-most // run**levels)
    return found


def audit(docs: DataFrame, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """A row for each row of ``docs``: its place in the manifest, and the version after tampering.

    doc_id, source, leaf, subroot (of its source), root, proof_sha256 (of all siblings on the way to
    the root), folded_root (root of its version; recomputed from the leaf where nobody touched it)
    and copied (the nodes that the version does not share, upwards; NULL without a version).
    """
    placed = stored(numbered(leaves(docs), ["doc_id", "digest"]), "leaves")
    below = tiers(placed, run, levels)
    sources = below[-1].select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = stored(numbered(sources, ["source"]), "sources")
    above = tiers(sources, run, levels)
    # From the root down to the source, then from the source down to its leaves.
    paths = above[-1].select(
        "tree",
        "place",
        F.array().cast(_PATH).alias("path"),
        F.lit(None).cast("string").alias("subroot"),
        F.col("digest").alias("root"),
    )
    for nodes in reversed(above[:-1]):
        paths = stored(_descend(nodes, paths, run, levels), "paths")
    own = sources.select(F.col("place").alias("number"), "source", "digest")
    paths = paths.join(own, F.col("place") == F.col("number")).select(
        F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root"
    )
    for nodes in reversed(below[1:-1]):
        paths = stored(_descend(nodes, paths, run, levels), "paths")
    # Where every source has one leaf there is no tier; a block of one leaf does the same.
    return _versions(placed, paths, run, levels)


def _crc32(text: str) -> str:
    """SQL for the CRC of an ASCII text, bit by bit."""
    ones = "4294967295::UBIGINT"
    bits = "lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::UBIGINT)"
    step = f"lambda c, b: list_reduce([xor(c, b)] || range(8)::UBIGINT[], {bits})"
    return f"xor(list_reduce({codes}, {step}, {ones}), {ones})"


def _oracle(leaf_levels: int = 6, source_levels: int = 3) -> str:
    """SQL for trees of up to 16^6 leaves and 16^3 sources, level by level."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase

    def digest(text: str) -> str:
        fields = [text if c == "text" else f"{c}::VARCHAR" for c in FIELDS]
        return "sha256(concat(" + ", ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + "))"

    changed = digest(f"translate(text, '{upper}', '{lower}')")
    parts = [
        f"""leaves AS (
  SELECT doc_id, source, {digest("text")} AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {changed} END AS tampered
  FROM documents)""",
        """placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves)""",
        "a_0 AS (SELECT source, pos, leaf AS h FROM placed)",
        "w_0 AS (SELECT doc_id, source, pos, leaf, coalesce(tampered, leaf) AS f, '' AS proof FROM placed)",
    ]

    def level(node: str, walk: str, k: int, next_walk: str) -> None:
        run = "PARTITION BY source, pos // 16 ORDER BY pos ROWS BETWEEN"
        parts.append(f"""{node}n_{k} AS (
  SELECT source, pos, h, count(*) OVER (PARTITION BY source) AS n,
         coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
         coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi
  FROM {node}_{k})""")
        parts.append(f"""{node}_{k + 1} AS (
  SELECT source, pos // 16 AS pos,
         CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h
  FROM {node}n_{k} GROUP BY source, pos // 16)""")
        kept = "w.doc_id, w.own, w.leaf, w.subroot" if node == "b" else "w.doc_id, w.leaf"
        parts.append(f"""{next_walk} AS (
  SELECT {kept}, w.source, w.pos // 16 AS pos,
         CASE WHEN n > 1 THEN sha256(lo || f || hi) ELSE f END AS f,
         CASE WHEN n > 1 THEN proof || lo || hi ELSE proof END AS proof
  FROM {walk} w JOIN {node}n_{k} a ON w.source IS NOT DISTINCT FROM a.source AND w.pos = a.pos)""")

    for k in range(leaf_levels):
        level("a", f"w_{k}", k, f"w_{k + 1}")
    parts.append(f"""sources AS (
  SELECT source AS own, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM a_{leaf_levels})""")
    parts.append("b_0 AS (SELECT 0 AS source, pos, h FROM sources)")
    parts.append(f"""v_0 AS (
  SELECT w.doc_id, w.leaf, w.f, w.proof, s.own, s.h AS subroot, 0 AS source, s.pos
  FROM w_{leaf_levels} w JOIN sources s ON w.source IS NOT DISTINCT FROM s.own)""")
    for k in range(source_levels):
        level("b", f"v_{k}", k, f"v_{k + 1}")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.doc_id, v.leaf, v.subroot, b.h AS root, sha256(v.proof) AS proof_sha256, v.f AS folded_root,
       v.f = b.h AS verified
FROM v_{source_levels} v CROSS JOIN b_{source_levels} b"""


ORACLE = _oracle()
