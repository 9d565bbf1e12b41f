"""Paths read off a traversal's predecessor table, and neighbours in common.

A traversal writes, level by level, through which node and edge each node was first reached; paths are walked back over that table, a join
for each hop, for all targets at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .work import cut

# The types of edges that a recall's walk follows at its first step, and beyond.
FIRST_STEP, LATER_STEPS = ("CALLS", "IMPORTS", "IMPLEMENTS"), ("CALLS",)


def predecessors(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """id, parent, type, incoming, hop: how a walk from seeds(id) over edges, either way, first reaches each node; of equals, through the
    parent that sorts first, and along the edge's direction before against it. incoming: the edge leads from id to parent."""
    forth = edges.select(F.col("from_id").alias("parent"), F.col("to_id").alias("next"), F.lit(False).alias("incoming"), "type")
    back = edges.select(F.col("to_id").alias("parent"), F.col("from_id").alias("next"), F.lit(True).alias("incoming"), "type")
    steps = forth.unionByName(back)
    frontier = seen = seeds.select("id").distinct()
    found: list[DataFrame] = []
    for hop in range(1, depth + 1):
        use = steps.where(F.col("type").isin(*(FIRST_STEP if hop == 1 else LATER_STEPS)))
        reached = use.join(frontier.select(F.col("id").alias("parent")), "parent").groupBy(F.col("next").alias("id")).agg(F.min(F.struct("parent", "incoming", "type")).alias("via"))
        level = cut(reached.join(seen, "id", "left_anti").select("id", "via.parent", "via.type", "via.incoming", F.lit(hop).alias("hop")), "predecessors")
        found.append(level)
        frontier = level.select("id")
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, found)


def _named(rows: DataFrame, nodes: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the name of the node `key`; what is no node has the last part of its id."""
    known = nodes.select(F.col("id").alias(key), F.col("name").alias("_name"))
    return rows.join(known, key, "left").withColumn(name, F.coalesce("_name", F.substring_index(key, "::", -1))).drop("_name")


def arrow(kind: Column, incoming: Column) -> Column:
    """What stands between two nodes of a path, the seed's side at the left."""
    return F.when(incoming, F.concat(F.lit(" ←["), kind, F.lit("]- "))).otherwise(F.concat(F.lit(" →["), kind, F.lit("]→ ")))


def paths(found: DataFrame, nodes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """id, path, hops: from a seed to each target(id) that the walk reached (or to all), as names and typed arrows. found: see predecessors. A
    seed has no path."""
    steps = cut(_named(found, nodes, "id", "name").select("id", "parent", "hop", F.concat(arrow(F.col("type"), F.col("incoming")), "name").alias("piece")), "steps", by="hop")
    wanted = steps.join(targets.select("id").distinct(), "id", "left_semi") if targets is not None else steps
    walked = None
    for hop in range(steps.agg(F.max("hop")).first()[0] or 0, 0, -1):
        own = wanted.where(F.col("hop") == hop).select("id", F.col("id").alias("at"), F.lit("").alias("path"), F.col("hop").alias("hops"))
        here = own if walked is None else walked.unionByName(own)
        walked = here.join(steps.where(F.col("hop") == hop).select(F.col("id").alias("at"), "parent", "piece"), "at").select("id", F.col("parent").alias("at"), F.concat("piece", "path").alias("path"), "hops")
    if walked is None:
        return found.select("id", F.lit("").alias("path"), F.lit(0).alias("hops")).limit(0)
    return _named(walked, nodes, "at", "seed").select("id", F.concat("seed", "path").alias("path"), "hops")


def _both_ways(edges: DataFrame) -> DataFrame:
    """a, b: distinct pairs of neighbours, in either order."""
    pairs = edges.where("from_id <> to_id").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def common_neighbours(edges: DataFrame) -> DataFrame:
    """a, b, common: pairs of neighbours (a < b) and how many neighbours they share, at least one.

    Edges point from the end with fewer neighbours to the one with more, so no node has more than sqrt(2 * edges) of them ahead; pairs
    of those are the only wedges, and a hub never pairs up its neighbours. A wedge is looked up only if its far end is in a mask of 256
    bits of what lies ahead of its near end, which tells most wedges that no edge closes before anything is shuffled. Nodes are numbers, in the
    order of their ids, until the end."""
    named, ends = scans.numbered(edges.select("from_id", "to_id").where("from_id <> to_id"))
    pairs = cut(_both_ways(ends.toDF("from_id", "to_id")), "pairs")
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    ends = pairs.join(degree.withColumnRenamed("n", "na"), "a").join(degree.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b")
    ahead = cut(ends.where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))).select("a", "b", F.col("nb").alias("n")), "ahead")
    bit = F.pmod(F.xxhash64("b"), F.lit(256)).cast("int")
    marked = ahead.select("a", bit.alias("bit"))
    masks = [F.bit_or(F.expr(f"if(bit div 64 = {k}, shiftleft(1L, bit % 64), 0L)")).alias(f"m{k}") for k in range(4)]
    mask = marked.groupBy(F.col("a").alias("y")).agg(*masks).select("y", F.array("m0", "m1", "m2", "m3").alias("mask"))
    y = ahead.select("a", F.col("b").alias("y"), F.col("n").alias("ny")).join(mask, "y")
    z = ahead.select("a", F.col("b").alias("z"), F.col("n").alias("nz"), bit.alias("bit"))
    wedges = y.join(z, "a").where((F.col("ny") < F.col("nz")) | ((F.col("ny") == F.col("nz")) & (F.col("y") < F.col("z"))))
    wedges = wedges.where("shiftright(mask[bit div 64], bit % 64) & 1 = 1").select("a", "y", "z")
    closed = wedges.join(ahead.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"], "left_semi")
    sides = closed.select(F.explode(F.array(F.struct("a", F.col("y").alias("b")), F.struct("a", F.col("z").alias("b")), F.struct(F.col("y").alias("a"), F.col("z").alias("b")))).alias("e"))
    found = sides.groupBy(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).agg(F.count("*").alias("common"))
    for end in ("a", "b"):
        found = found.join(named.select(F.col("n").alias(end), F.col("id").alias(f"{end}_id")), end).drop(end).withColumnRenamed(f"{end}_id", end)
    return found.select("a", "b", "common")


def neighbour_overlaps(work: DataFrame, asked: DataFrame, edges: DataFrame, keep: int = 3) -> DataFrame:
    """session, other, overlap: sessions asked about (a stated set) and others whose entities are direct neighbours, with the first `keep` such
    pairs as 'entity→neighbour'. Sessions that share an entity are left out: that is a nearer kind of overlap. work: session, entity."""
    work = work.distinct()
    mine = work.join(asked.select("session").distinct(), "session", "left_semi")
    near = mine.withColumnRenamed("entity", "a").join(_both_ways(edges), "a").select("session", "a", "b")
    others = work.select(F.col("session").alias("other"), F.col("entity").alias("b"))
    shared = mine.withColumnRenamed("entity", "b").join(others, "b").select("session", "other").distinct()
    pairs = near.join(others, "b").where("session <> other").join(shared, ["session", "other"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("session", "other").orderBy("a", "b"))
    few = pairs.withColumn("rank", rank).where(F.col("rank") <= keep)
    named = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("a", F.lit("→"), "b").alias("pair")))), lambda x: x["pair"])
    return few.groupBy("session", "other").agg(F.array_join(named, ", ").alias("overlap"))
