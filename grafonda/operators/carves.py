"""Ego graphs of many roots at once, also over sibling projects: carve's stages with everything keyed by (project, root).

A hop weighs the steps of the nodes that it starts at, once for all roots; it is one join for all roots together, so a hundred roots take as many rounds as
one. Windows are those of one root's nodes.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import carve, graph
from .work import cut

_ROOT = ["project", "root"]


def walk_steps(nodes: DataFrame, edges: DataFrame, decay: float = 0.5, cross_domain: float = 0.5, of: DataFrame | None = None) -> DataFrame:
    """project, from_id, to_id, factor: what a step either way along an edge leaves of a score: the strongest edge's weight, times a factor
    between domains, times decay / (1 + log2(degree + 1)). of(project, id): only the steps that start at these nodes are weighed."""
    weight = graph.chosen(F.col("type"), graph.EDGE_WEIGHTS, graph.OTHER_WEIGHT)
    domain = nodes.select("project", F.col("id"), F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("code")).alias("domain"))
    both = edges.select("project", "from_id", "to_id", weight.alias("w"))
    both = both.unionByName(both.select("project", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "w"))
    if of is not None:
        both = cut(both.join(of.select("project", F.col("id").alias("from_id")), ["project", "from_id"], "left_semi"), "walk_ends")
        ids = both.select("project", F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
        domain = domain.join(ids, ["project", "id"], "left_semi")
    for end in ("from", "to"):
        both = both.join(domain.select("project", F.col("id").alias(f"{end}_id"), F.col("domain").alias(f"{end}_domain")), ["project", f"{end}_id"], "left")
    both = both.select("project", "from_id", "to_id", F.when(F.col("from_domain") != F.col("to_domain"), F.col("w") * cross_domain).otherwise(F.col("w")).alias("w"))
    steps = both.groupBy("project", "from_id", "to_id").agg(F.max("w").alias("w"), F.count("*").alias("n"))
    degree = steps.groupBy("project", "from_id").agg(F.sum("n").alias("degree"))
    return steps.join(degree, ["project", "from_id"]).select("project", "from_id", "to_id", (F.col("w") * decay / (1 + F.log2(F.col("degree") + 1))).alias("factor"))


def starts(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """project, root, id, rank: a root with 1; the methods named after a struct or interface, an interface's implementors and the methods
    named after these with less."""
    own = nodes.join(roots.select("project", F.col("root").alias("id")), ["project", "id"], "left_semi").select("project", F.col("id").alias("root"), "name", "type")
    methods = nodes.where("type = 'method' and contains(name, '.')").select("project", "id", F.expr("left(name, length(name) - length(substring_index(name, '.', -1)) - 1)").alias("name"))
    typed = own.where("type in ('struct', 'interface')")
    makers = edges.where("type = 'IMPLEMENTS'").join(own.where("type = 'interface'").select("project", F.col("root").alias("to_id")), ["project", "to_id"], "left_semi")
    makers = makers.where("from_id <> to_id").select("project", F.col("to_id").alias("root"), F.col("from_id").alias("id")).distinct().join(nodes.select("project", "id", "name"), ["project", "id"])
    parts = own.select(*_ROOT, F.col("root").alias("id"), F.lit(1.0).alias("rank"))
    parts = parts.unionByName(typed.join(methods, ["project", "name"]).select(*_ROOT, "id", F.lit(0.9).alias("rank")))
    parts = parts.unionByName(makers.select(*_ROOT, "id", F.lit(0.85).alias("rank")))
    parts = parts.unionByName(makers.select(*_ROOT, "name").join(methods, ["project", "name"]).select(*_ROOT, "id", F.lit(0.85).alias("rank")))
    return parts.groupBy(*_ROOT, "id").agg(F.max("rank").alias("rank"))


def spread(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 3, decay: float = 0.5) -> DataFrame:
    """project, root, id, rank: carve.spread_scores for each of roots(project, root). A hop weighs the steps of its frontier's nodes only."""
    frontier = seen = cut(starts(nodes, edges, roots), "starts")
    for _ in range(depth):
        steps = cut(walk_steps(nodes, edges, decay, of=frontier), "walk_steps").withColumnRenamed("from_id", "id")
        grown = frontier.join(steps, ["project", "id"]).groupBy(*_ROOT, F.col("to_id").alias("id")).agg(F.max(F.col("rank") * F.col("factor")).alias("grown"))
        both = cut(grown.join(seen, [*_ROOT, "id"], "full"), "spread")
        seen = both.select(*_ROOT, "id", F.greatest("grown", "rank").alias("rank"))
        frontier = both.where("rank is null").select(*_ROOT, "id", F.col("grown").alias("rank"))
    return seen


def carved(nodes: DataFrame, edges: DataFrame, roots: DataFrame, budget: int = 4000, depth: int = 3, cost: Column | None = None, least: float = carve.MIN_RELEVANCE, decay: float = 0.5) -> DataFrame:
    """project, root, id, relevance, hop, pool, cost, running: the nodes of each root's ego graph within the budget. nodes and edges have a
    column project; roots that are no nodes have no rows."""
    asked = cut(nodes.select("project", F.col("id").alias("root"), (F.col("type") == "interface").alias("is_interface")).join(roots.select(*_ROOT).distinct(), _ROOT, "left_semi"), "roots")
    kind = lambda name: F.col("type") == name
    callers = edges.where("from_id <> to_id").join(asked.withColumnRenamed("root", "to_id"), ["project", "to_id"])
    callees = edges.where("from_id <> to_id").join(asked.withColumnRenamed("root", "from_id"), ["project", "from_id"])
    flags = callers.select("project", F.col("to_id").alias("root"), F.col("from_id").alias("id"), kind("CALLS").alias("caller"), F.lit(False).alias("callee"), (kind("IMPLEMENTS") & F.col("is_interface")).alias("maker"))
    flags = flags.unionByName(callees.select("project", F.col("from_id").alias("root"), F.col("to_id").alias("id"), F.lit(False).alias("caller"), kind("CALLS").alias("callee"), F.lit(False).alias("maker")))
    flags = flags.groupBy(*_ROOT, "id").agg(*[F.max(c).alias(c) for c in ("caller", "callee", "maker")])
    both = spread(nodes, edges, asked, depth, decay).join(flags, [*_ROOT, "id"], "full").fillna(False, ["caller", "callee", "maker"])
    floor = F.when(F.col("maker"), carve.IMPLEMENTOR_FLOOR).when(F.col("caller") | F.col("callee"), carve.NEIGHBOUR_FLOOR).otherwise(0.0)
    is_root = F.col("id") == F.col("root")
    scored = both.withColumn("relevance", F.when(is_root, 1.0).otherwise(F.greatest(F.coalesce("rank", F.lit(0.0)), floor))).where("relevance > 0")
    rank = F.row_number().over(Window.partitionBy(*_ROOT, "caller").orderBy(F.desc("relevance"), "id"))
    held = scored.withColumn("kept", F.col("caller") & (rank <= carve.PROTECTED) & F.lit(least <= carve.PROTECT_UP_TO))
    held = held.withColumn("relevance", F.when(F.col("kept"), F.greatest("relevance", F.lit(2 * least))).otherwise(F.col("relevance")))
    held = held.where((F.col("relevance") >= least) | F.col("kept") | is_root).drop("kept", "rank", "maker").join(nodes, ["project", "id"])
    hop = F.when(is_root, 0).otherwise(F.round(F.abs(F.log(F.col("relevance")) / log(decay)))).cast("int")
    pool = F.when(is_root, "root").when(F.col("caller"), "caller").when(F.col("callee"), "callee").otherwise("other")
    cost = carve.token_cost("id", "type", "name", "package", "file") if cost is None else cost
    pooled = held.withColumns({"hop": hop, "pool": pool, "cost": cost})
    own = F.max(F.when(is_root, F.col("cost"))).over(Window.partitionBy(*_ROOT))
    running = F.sum("cost").over(Window.partitionBy(*_ROOT, "pool").orderBy(F.desc("relevance"), "hop", "id").rowsBetween(Window.unboundedPreceding, 0))
    left = F.greatest(F.lit(0), F.lit(budget) - F.col("own"))
    share = F.when(F.col("pool") == "root", F.greatest(F.lit(budget), F.col("own"))).otherwise(F.floor(left * graph.chosen(F.col("pool"), carve.POOLS, 0) / 100))
    fits = pooled.withColumns({"own": own, "running": running}).where(F.col("running") <= share)
    return fits.select(*_ROOT, "id", "relevance", "hop", "pool", "cost", "running")


def sections(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """project, root, section, n: how many of each root's carved nodes stand in which section (see carve.directional)."""
    ids = kept.where("id <> root").select(*_ROOT, "id")
    out = edges.select("project", F.col("from_id").alias("root"), F.col("to_id").alias("id"), "type", F.lit(False).alias("incoming"))
    at = out.unionByName(edges.select("project", F.col("to_id").alias("root"), F.col("from_id").alias("id"), "type", F.lit(True).alias("incoming")))
    calls = F.col("type") == "CALLS"
    role = (
        F.when(F.col("incoming") & calls, 0).when(~F.col("incoming") & calls, 1).when(F.col("type").isin("EXPLAINS", "DOCUMENTED_BY", "DOCUMENTS", "CONTAINS"), 2)
        .when(F.col("type").isin("CONTRADICTS", "CAUSED_BY", "INSTANCE_OF", "RELATES_TO"), 3).when(F.col("type").isin(*graph.CROSS_DOMAIN), 4).otherwise(5)
    )
    best = at.join(ids, [*_ROOT, "id"], "left_semi").groupBy(*_ROOT, "id").agg(F.min(role).alias("role"))
    names = F.array(*map(F.lit, carve.SECTIONS))
    named = ids.join(best, [*_ROOT, "id"], "left").withColumn("section", F.element_at(names, F.coalesce("role", F.lit(len(carve.SECTIONS) - 1)) + 1))
    return named.groupBy(*_ROOT, "section").agg(F.count("*").alias("n"))


def fingerprints(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """project, root, hash: 12 digits that stand for what was carved: the root, the other nodes and the edges between them, sorted. A budget
    bounds the nodes of a root."""
    ids = kept.select(*_ROOT, "id")
    inside = edges.select("project", F.col("from_id").alias("id"), "to_id", "type").join(ids, ["project", "id"]).withColumnRenamed("id", "from_id")
    inside = inside.join(ids.withColumnRenamed("id", "to_id"), [*_ROOT, "to_id"]).select(*_ROOT, F.concat("from_id", F.lit(">"), "to_id", F.lit(":"), "type").alias("part"))
    parts = ids.select(*_ROOT, F.col("id").alias("part")).unionByName(inside)
    return parts.groupBy(*_ROOT).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), ""), 256), 1, 12).alias("hash"))


def contexts(kept: DataFrame, edges: DataFrame, violations: DataFrame, annotations: DataFrame, memories: DataFrame, quality: DataFrame) -> DataFrame:
    """project, root, nodes, callers, callees, tokens, notes, memories, broken_rules, confidence, hash: one answer for each root, of what was
    carved and of what the stores hold on it: annotations(project, node_id, stale) and memories(project, node_id, memory_id) of its nodes,
    violations(project, from_id, to_id) that touch the root, and quality(project, root, quality, signals) of earlier answers."""
    per = kept.groupBy(*_ROOT).agg(F.count("*").alias("nodes"), F.sum((F.col("pool") == "caller").cast("long")).alias("callers"), F.sum((F.col("pool") == "callee").cast("long")).alias("callees"), F.sum("cost").alias("tokens"))
    at = kept.select(*_ROOT, F.col("id").alias("node_id"))
    notes = at.join(annotations, ["project", "node_id"]).groupBy(*_ROOT).agg(F.count("*").alias("notes"), F.max("stale").alias("stale"))
    known = at.join(memories, ["project", "node_id"]).groupBy(*_ROOT).agg(F.countDistinct("memory_id").alias("memories"))
    ends = violations.select("project", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("root"))
    broken = ends.groupBy(*_ROOT).agg(F.count("*").alias("broken_rules"))
    out = per
    for part in (notes, known, broken, quality.select(*_ROOT, "quality", "signals"), fingerprints(kept, edges)):
        out = out.join(part, _ROOT, "left")
    out = out.fillna(0, ["notes", "memories", "broken_rules", "signals"]).fillna(0.0, ["quality"])
    sure = scalars.context_confidence(F.col("quality"), F.col("signals"), F.lit(False), F.coalesce("stale", F.lit(False)))
    return out.withColumn("confidence", sure).drop("quality", "signals", "stale")
