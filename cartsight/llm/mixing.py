"""Mixing sources to target weights along a curriculum. DataFrame functions only.

A source's share of the training words is a weight; when they come is its schedule, a weight over
training time 0 to 1, given by knots between which it is linear. The integral of the schedule, as a
part of its whole, says which part of the source's words is due by time t. Its inverse gives the
position of a document from the words of its source that come before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartsight.llm.common import WORD, stored

#: Weights and schedules by rank of the source; both repeat.
WEIGHTS = (5, 2, 1)
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),  # the same all the time
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)),  # fades
    ((0.0, 0.25), (0.75, 1.0), (1.0, 3.0)),  # comes late
)
#: A source is used this many times over at most.
MOST = 3


def n_words(text: str | Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def position(part: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which ``part`` of all the words that ``schedule`` brings has come."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        pieces.append((total, t0, t1, w0, w1, area))
        total += area
    out = None
    for before, t0, t1, w0, w1, area in pieces:
        rest = part * F.lit(total) - F.lit(before)
        slope = (w1 - w0) / (t1 - t0)
        # w0 * x + slope / 2 * x * x = rest, in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        at = F.least(F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + root), F.lit(t1))
        here = part * F.lit(total) <= F.lit(before + area)
        out = F.when(here, at) if out is None else out.when(here, at)
    return out.otherwise(F.lit(schedule[-1][0]))


def targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST
) -> DataFrame:
    """source, rank, docs, source_size, target for each source of ``sized`` (source, size).

    Targets share out all words by weight, but stop at ``most`` times the source's size; what is
    over goes to the others by weight until none is above. That is target = min(limit, level *
    weight) for the one level at which the targets add up to all words. Sources are few; one task
    holds the row of each.
    """
    sources = sized.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("docs")
    )
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank")
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")
    )
    limit = F.col("source_size") * F.lit(float(most))
    ranked = (
        sources.select("*", rank)
        .withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    found = ranked.withColumn("level", level)
    # the first source, by ratio, that its share does not lift above its limit sets the level
    lowest = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(
        all_rows
    )["level"]
    due = F.least("limit", F.coalesce(lowest, F.lit(0.0)) * F.col("weight"))
    return found.withColumn("target", due).select(
        "source", "rank", "docs", "source_size", "target"
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    most: float = MOST,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, position, positions of every row of
    ``docs``.

    Documents of a source follow each other in the order of md5(doc_id), again and again; a round
    that reaches the target ends with the document whose middle lies before it. So the words taken
    miss the target by half a document at most. ``positions`` has the time of each copy: that of
    copy k is where the schedule has brought the k rounds before it and the words ahead of it in its
    own. ``position`` is the first of them. Both are NULL if the document is not taken.

    NULL or empty texts have size 0 and take no words. NULL sources are one source, the last. A
    NULL id sorts first in its source; rows that repeat an id follow each other. Other columns are
    ignored. Empty tables, and tables without words, take nothing.
    """
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            n_words("text").alias("size"),
        ),
        "sized",
    )
    return place(sized, weights, schedules, most)


def place(
    sized: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    most: float = MOST,
) -> DataFrame:
    """:func:`mix` for rows whose words are counted: (doc_id, source, size).

    Further columns of ``sized`` follow behind those of :func:`mix`.
    """
    others = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    goals = stored(targets(sized, weights, most), "targets")
    order = F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    by = ["rank", "o", "doc_id", "size", "tie"]
    # One sort by range cuts a large source, and an id that stands on many rows, into pieces.
    rows = stored(
        sized.withColumn("tie", F.monotonically_increasing_id())
        .withColumnRenamed("source", "s")
        .join(goals, F.col("s").eqNullSafe(F.col("source")))
        .withColumn("o", order)
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("piece", F.spark_partition_id()),
        "pieces",
    )
    sums = rows.groupBy("rank", "piece").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("rank").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("rank").alias("r"),
        F.col("piece").alias("p"),
        F.coalesce(F.sum("words").over(ahead), F.lit(0)).cast("long").alias("start"),
    )
    inside = Window.partitionBy("rank", "piece").orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    middle = F.col("start") + F.col("inside") + F.col("size") / 2.0
    copies = F.when(
        F.col("size") > 0, F.ceil(F.try_divide(F.col("target") - F.col("middle"), F.col("source_size").cast("double")))
    ).otherwise(0)

    def due(k: Column) -> Column:
        """The time of copy ``k``."""
        words = F.col("middle") + k * F.col("source_size")
        part = F.least(F.try_divide(words, F.col("target")), F.lit(1.0))
        at = None
        for i, schedule in enumerate(schedules):
            mine = F.col("rank") % len(schedules) == i
            at = F.when(mine, position(part, schedule)) if at is None else at.when(mine, position(part, schedule))
        return at

    rounds = F.sequence(F.lit(0), F.greatest(F.col("copies").cast("int") - 1, F.lit(0)))
    return (
        within.join(starts, (F.col("rank") == F.col("r")) & (F.col("piece") == F.col("p")))
        .withColumn("middle", middle)
        .withColumn("copies", F.greatest(copies, F.lit(0)).cast("long"))
        .withColumn("positions", F.when(F.col("copies") > 0, F.transform(rounds, due)))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies",
            (F.col("size") * F.col("copies")).alias("taken"),
            F.col("positions")[0].alias("position"), "positions", *others,
        )
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows by training position; what is not taken comes last. A range sort, not one task."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


_PLACED = """
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3.0::DOUBLE AS lim FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)
          - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT *, least(lim, weight * (SELECT level FROM levels WHERE level <= lim / weight
                                 ORDER BY lim / weight, rank LIMIT 1)) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.rank,
         coalesce(sum(s.size) OVER (PARTITION BY g.rank ORDER BY md5(s.doc_id::VARCHAR), s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
"""
_COPIES = "CASE WHEN size > 0 THEN greatest(ceil((target - middle) / source_size), 0) ELSE 0 END"
ORACLE = f"""{_PLACED}
SELECT doc_id, size, source_size, round(target, 3) AS target, (size * {_COPIES})::BIGINT AS taken
FROM placed
"""


def _time_sql(part: str) -> str:
    """SQL of :func:`position` for the schedule of the rank."""
    ways = []
    for i, schedule in enumerate(SCHEDULES):
        steps = list(zip(schedule, schedule[1:], strict=False))
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in steps]
        due = f"({part}) * {sum(areas)!r}::DOUBLE"
        cases, before = [], 0.0
        for ((t0, w0), (t1, w1)), area in zip(steps, areas, strict=True):
            rest, slope = f"({due} - {before!r}::DOUBLE)", (w1 - w0) / (t1 - t0)
            root = f"sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0))"
            at = f"least({t0!r}::DOUBLE + 2 * {rest} / ({w0!r}::DOUBLE + {root}), {t1!r}::DOUBLE)"
            cases.append(f"WHEN {due} <= {before + area!r}::DOUBLE THEN {at}")
            before += area
        ways.append(f"WHEN rank % {len(SCHEDULES)} = {i} THEN CASE {' '.join(cases)} ELSE {schedule[-1][0]!r} END")
    return f"CASE {' '.join(ways)} END"


def _copy_sql(k: str) -> str:
    part = f"least((middle + {k} * source_size) / target, 1.0::DOUBLE)"
    return f"round(CASE WHEN copies > 0 THEN {_time_sql(part)} END, 9)"


#: :data:`ORACLE` with the times of the first and the last copy.
POSITIONS_ORACLE = f"""{_PLACED}
SELECT doc_id, size, source_size, round(target, 3) AS target, (size * copies)::BIGINT AS taken,
       {_copy_sql("0")} AS position, {_copy_sql("(copies - 1)")} AS last_position
FROM (SELECT *, {_COPIES} AS copies FROM placed)
"""
