"""Ranks, running sums and earlier rows within groups of any size: segmented scans in place of one window per group.

chunks() range-sorts rows by group and order and writes them; a chunk is one file of that order, so a group with a third of all rows
lies in a third of the chunks. Each scan works within (chunk, group), in parallel, and carries on what the chunks before hold of the
same group: their counts, sums or last row, a table of at most chunks + groups rows. A window over that table has at most one row
per chunk in a group.

Rows that are equal in group and order are told apart by the place they are read at, so they may lie in many chunks. Null groups
are groups. Columns named chunk and at are replaced. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import cut


def chunks(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "chunks") -> DataFrame:
    """rows with chunk (place of a file in the order) and at (place in the file)."""
    keys = [*group, *order, "_tie"]
    dealt = rows.drop("chunk", "at").withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    return cut(dealt.withColumns({"chunk": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)


def _carried(rows: DataFrame, summary: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """rows with columns of their (chunk, group)."""
    marks = [f"_{g}" for g in ("chunk", *group)]
    right = summary.select(*[F.col(g).alias(m) for g, m in zip(("chunk", *group), marks, strict=True)], *columns)
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(m)) for g, m in zip(("chunk", *group), marks, strict=True)))
    return rows.join(right, same).drop(*marks)


def with_rank(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """rows with their rank in the group, from 1."""
    placed = chunks(rows, group, order, "ranks")
    held = placed.groupBy("chunk", *group).agg(F.min("at").alias("_first"), F.count("*").alias("_size"))
    held = held.withColumn("_base", F.sum("_size").over(Window.partitionBy(*group).orderBy("chunk")) - F.col("_size") - F.col("_first") + 1)
    return _carried(placed, held, group, ["_base"]).withColumn(name, F.col("_base") + F.col("at")).drop("_base", "chunk", "at")


def with_sum(placed: DataFrame, group: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Rows of chunks() with the sum of value over the group's rows up to this one, or before it."""
    valued = placed.withColumn("_value", value)
    held = valued.groupBy("chunk", *group).agg(F.coalesce(F.sum("_value"), F.lit(0)).alias("_total"))
    held = held.withColumn("_base", F.sum("_total").over(Window.partitionBy(*group).orderBy("chunk")) - F.col("_total"))
    own = Window.partitionBy("chunk", *group).orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = valued.withColumn(name, F.coalesce(F.sum("_value").over(own), F.lit(0)))
    return _carried(local, held, group, ["_base"]).withColumn(name, F.col("_base") + F.col(name)).drop("_base", "_value")


def with_max(placed: DataFrame, group: list[str], value: Column, name: str) -> DataFrame:
    """Rows of chunks() with the largest value of the group's rows up to this one."""
    valued = placed.withColumn("_value", value)
    held = valued.groupBy("chunk", *group).agg(F.max("_value").alias("_most"))
    held = held.withColumn("_before", F.max("_most").over(Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    own = Window.partitionBy("chunk", *group).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    local = valued.withColumn(name, F.max("_value").over(own))
    return _carried(local, held, group, ["_before"]).withColumn(name, F.greatest("_before", name)).drop("_before", "_value")


def with_previous(placed: DataFrame, group: list[str], columns: dict[str, str]) -> DataFrame:
    """Rows of chunks() with columns (new name: source) of the group's row before; null for its first."""
    own = Window.partitionBy("chunk", *group).orderBy("at")
    kept = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    held = placed.groupBy("chunk", *group).agg(F.max_by(kept, "at").alias("_last"))
    held = held.withColumn("_before", F.lag("_last").over(Window.partitionBy(*group).orderBy("chunk")))
    local = placed.withColumn("_own", F.lag(kept).over(own))
    both = _carried(local, held, group, ["_before"]).withColumn("_own", F.coalesce("_own", "_before"))
    return both.select(*placed.columns, *[F.col("_own")[n].alias(n) for n in columns])


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, n: the ends of edges, numbered in the order of their ids; and a, b: the ends of each edge as numbers, which are few bytes to shuffle."""
    named = with_rank(edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct(), [], ["id"], "n")
    named = cut(named.select("id", F.col("n").cast("long").alias("n")), "numbered")
    ends = edges.select("from_id", "to_id").join(named.select(F.col("id").alias("from_id"), F.col("n").alias("a")), "from_id").join(named.select(F.col("id").alias("to_id"), F.col("n").alias("b")), "to_id")
    return named, cut(ends.select("a", "b"), "pairs")
