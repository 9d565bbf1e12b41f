"""The ego graph of a root within a token budget, stage by stage: score, floors, filters, boosts, pools, edges between what is kept.

Scores come from the bounded walk of graph.personalized_pagerank or from the level-wise spread below; both look at no more than
graph.CANDIDATES nodes, so the windows over them are bounded too, whatever the size of the graph.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .work import cut

# Floors, thresholds and shares.
IMPLEMENTOR_FLOOR, NEIGHBOUR_FLOOR = 0.5, 0.05
MIN_RELEVANCE, PROTECT_UP_TO, PROTECTED = 0.01, 0.05, 10
CENTRALITY_BETA, QUALITY_BETA, QUALITY_SCALE, BLEND = 0.2, 0.2, 5.0, 0.3
POOLS = {"caller": 35, "callee": 35, "other": 30}
PROVENANCE = {"generated": 0.5, "vendored": 0.3, "external": 0.2}


def token_cost(*columns: str) -> Column:
    """Bytes of a node's texts over four, plus one."""
    return (F.floor(reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in columns]) / 4) + 1).cast("long")


def spread_scores(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 3, decay: float = 0.5, **weighing) -> DataFrame:
    """id, rank: the largest relevance over paths of up to depth steps either way: each step multiplies by the edge's weight and by
    decay / (1 + log2(degree + 1)). Structs and interfaces pass on through their methods and implementors as well. A node that is reached
    again may score higher, but passes on only what it had when it was first reached."""
    start = graph.teleport(nodes, edges, root)
    top = start.agg(F.max("share")).first()[0]
    frontier = start.select("id", (F.col("share") / top).alias("rank"))
    seen = frontier
    for hop in range(depth):
        touched = graph.undirected(edges).join(frontier, F.col("from_id") == F.col("id")).select("from_id", "to_id", "rank")
        degree = touched.groupBy("from_id").agg(F.count("*").alias("degree"))
        near = edges.join(frontier.select(F.col("id").alias("from_id")), "from_id", "left_semi").unionByName(graph.reversed_edges(edges).join(frontier.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type")).distinct()
        steps = graph.walk_weights(near, nodes, **weighing).groupBy("from_id", "to_id").agg(F.max("w").alias("w"))
        grown = steps.join(frontier.withColumnRenamed("id", "from_id"), "from_id").join(degree, "from_id")
        grown = grown.groupBy(F.col("to_id").alias("id")).agg(F.max(F.col("rank") * F.col("w") * decay / (1 + F.log2(F.col("degree") + 1))).alias("rank"))
        both = cut(grown.join(seen.withColumnRenamed("rank", "before"), "id", "full"), "spread")
        seen = both.select("id", F.greatest("rank", "before").alias("rank"))
        frontier = both.where("before is null").select("id", "rank")
    return seen


def with_floors(ranks: DataFrame, nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """id, relevance, caller, callee: root has 1; an interface's implementors and a root's direct callers and callees have a floor."""
    own = edges.where((F.col("to_id") == root) | (F.col("from_id") == root)).where("from_id <> to_id")
    is_interface = F.lit(root).isin([r[0] for r in nodes.where((F.col("id") == root) & (F.col("type") == "interface")).select("id").collect()] or [""])
    flags = own.select(
        F.when(F.col("to_id") == root, F.col("from_id")).otherwise(F.col("to_id")).alias("id"),
        ((F.col("to_id") == root) & (F.col("type") == "CALLS")).alias("caller"), ((F.col("from_id") == root) & (F.col("type") == "CALLS")).alias("callee"),
        ((F.col("to_id") == root) & (F.col("type") == "IMPLEMENTS") & is_interface).alias("maker"),
    ).groupBy("id").agg(*[F.max(c).alias(c) for c in ("caller", "callee", "maker")])
    both = ranks.select("id", "rank").join(flags, "id", "full")
    floor = F.when(F.col("maker"), IMPLEMENTOR_FLOOR).when(F.col("caller") | F.col("callee"), NEIGHBOUR_FLOOR).otherwise(0.0)
    kept = both.select("id", F.when(F.col("id") == root, 1.0).otherwise(F.greatest(F.coalesce("rank", F.lit(0.0)), F.coalesce(floor, F.lit(0.0)))).alias("relevance"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("caller", "callee")])
    return kept.where("relevance > 0")


def filtered(scored: DataFrame, nodes: DataFrame, root: str, least: float = MIN_RELEVANCE, without_types: tuple[str, ...] = (), is_test: Column | None = None, decay: float = 0.5) -> DataFrame:
    """scored with hop, without what is irrelevant, of an excluded type or (if is_test is given) in a test file. The PROTECTED best callers
    stay, at twice the least relevance or more."""
    rank = F.row_number().over(Window.partitionBy("caller").orderBy(F.desc("relevance"), "id"))
    held = scored.withColumn("kept", F.col("caller") & (rank <= PROTECTED) & F.lit(least <= PROTECT_UP_TO))
    held = held.withColumn("relevance", F.when(F.col("kept"), F.greatest("relevance", F.lit(2 * least))).otherwise(F.col("relevance")))
    held = held.where((F.col("relevance") >= least) | F.col("kept") | (F.col("id") == root)).drop("kept").join(nodes, "id")
    if without_types:
        held = held.where(~F.col("type").isin(*without_types) | (F.col("id") == root))
    if is_test is not None:
        held = held.where(~is_test)
    hop = F.when(F.col("id") == root, 0).otherwise(F.round(F.abs(F.log(F.col("relevance")) / log(decay)))).cast("int")
    return held.withColumn("hop", hop)


def boosted(scored: DataFrame, root: str, provenance: str | None = None, centrality: DataFrame | None = None, similarity: DataFrame | None = None, quality: DataFrame | None = None, blend: float = BLEND) -> DataFrame:
    """relevance by where code comes from (a column of scored), centrality(id, centrality), similarity(id, similarity to root) and
    quality(id, quality), in this order; root keeps 1."""
    out = scored
    if provenance:
        out = out.withColumn("relevance", F.col("relevance") * graph.chosen(F.coalesce(provenance, F.lit("")), PROVENANCE, 1.0))
    if centrality is not None:
        out = out.join(centrality, "id", "left").withColumn("relevance", F.col("relevance") * (1 + CENTRALITY_BETA * F.coalesce("centrality", F.lit(0.0)))).drop("centrality")
    if similarity is not None:
        mixed = (1 - blend) * F.least("relevance", F.lit(1.0)) + blend * F.greatest("similarity", F.lit(0.0))
        out = out.join(similarity, "id", "left").withColumn("relevance", F.when(F.col("similarity").isNotNull(), mixed).otherwise(F.col("relevance"))).drop("similarity")
    if quality is not None:
        factor = 1 + QUALITY_BETA * F.tanh(F.col("quality") / QUALITY_SCALE)
        out = out.join(quality, "id", "left").withColumn("relevance", F.col("relevance") * F.coalesce(factor, F.lit(1.0))).drop("quality")
    return out.withColumn("relevance", F.when(F.col("id") == root, 1.0).otherwise(F.col("relevance")))


def budgeted(scored: DataFrame, root: str, budget: int, cost: Column) -> DataFrame:
    """scored with pool, cost and running: of callers, callees and others those that fit into their share of what root leaves of the budget,
    by falling relevance, up to the first that does not fit."""
    pooled = cut(scored.withColumns({"pool": F.when(F.col("id") == root, "root").when(F.col("caller"), "caller").when(F.col("callee"), "callee").otherwise("other"), "cost": cost}), "pooled")
    own = pooled.where(F.col("id") == root).agg(F.max("cost")).first()[0] or 0
    left = max(0, budget - own)
    running = F.sum("cost").over(Window.partitionBy("pool").orderBy(F.desc("relevance"), "hop", "id").rowsBetween(Window.unboundedPreceding, 0))
    share = graph.chosen(F.col("pool"), {k: left * v // 100 for k, v in POOLS.items()}, max(budget, own))
    return pooled.withColumn("running", running).where(F.col("running") <= share)


def induced(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between kept nodes, each once."""
    ids = kept.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").distinct()


def carve(nodes: DataFrame, edges: DataFrame, root: str, budget: int = 4000, ranks: DataFrame | None = None, cost: Column | None = None, least: float = MIN_RELEVANCE, without_types: tuple[str, ...] = (), is_test: Column | None = None, **boosts) -> DataFrame:
    """The nodes of root's ego graph with relevance, hop, pool, cost and running cost (see induced for its edges). ranks: scores of
    personalized_pagerank (the default) or spread_scores."""
    ranks = graph.personalized_pagerank(nodes, edges, root) if ranks is None else ranks
    scored = boosted(filtered(with_floors(ranks, nodes, edges, root), nodes, root, least, without_types, is_test), root, **boosts)
    return budgeted(scored, root, budget, token_cost("id", "type", "name", "package", "file") if cost is None else cost)


# The sections that a carved node may stand in, by what ties it to the root.
SECTIONS = ("callers", "callees", "docs", "knowledge", "cross_domain", "related")


def directional(kept: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """id, section: what a carved node is to the root, by the first that applies of SECTIONS."""
    at = edges.where((F.col("from_id") == root) | (F.col("to_id") == root))
    role = (
        F.when((F.col("to_id") == root) & (F.col("type") == "CALLS"), 0).when((F.col("from_id") == root) & (F.col("type") == "CALLS"), 1)
        .when(F.col("type").isin("EXPLAINS", "DOCUMENTED_BY", "DOCUMENTS", "CONTAINS"), 2).when(F.col("type").isin("CONTRADICTS", "CAUSED_BY", "INSTANCE_OF", "RELATES_TO"), 3)
        .when(F.col("type").isin(*graph.CROSS_DOMAIN), 4).otherwise(5)
    )
    best = at.select(F.when(F.col("to_id") == root, F.col("from_id")).otherwise(F.col("to_id")).alias("id"), role.alias("role")).groupBy("id").agg(F.min("role").alias("role"))
    names = F.array(*map(F.lit, SECTIONS))
    return kept.where(F.col("id") != root).select("id").join(best, "id", "left").select("id", F.element_at(names, F.coalesce("role", F.lit(len(SECTIONS) - 1)) + 1).alias("section"))


# What tells where data comes in and goes out: (role, label, what is looked at, how, words), the first that fits.
ROLES = (
    ("source", "http_input", "signature", "contains", ("*http.Request", "gin.Context", "echo.Context", "fiber.Ctx")),
    ("source", "stream_input", "signature", "contains", ("io.Reader",)),
    ("source", "parser", "name", "prefix", ("parse", "decode", "unmarshal")),
    ("source", "env_input", "name", "contains", ("getenv", "lookupenv")),
    ("sink", "sql_sink", "signature", "contains", ("*sql.DB", "*sql.Tx")),
    ("sink", "sql_sink", "name", "equals", ("exec", "query", "queryrow", "querycontext", "execcontext", "prepare", "preparecontext")),
)


def data_role(name: Column, signature: Column, configured: tuple[tuple[Column, str], ...] = ()) -> Column:
    """source, sink or null: configured (condition, role) first, then ROLES on the last part of the name and the signature; writers that
    take a writer or a file are sinks too."""
    short, signature = F.lower(F.substring_index(name, ".", -1)), F.coalesce(signature, F.lit(""))
    tests = {"contains": F.contains, "prefix": F.startswith, "equals": lambda a, b: a == b}
    out = reduce(lambda acc, r: acc.when(r[0], r[1]), configured, F.when(F.lit(False), F.lit("")))
    for role, _, column, how, words in ROLES:
        at = signature if column == "signature" else short
        out = out.when(reduce(lambda a, b: a | b, [tests[how](at, F.lit(w)) for w in words]), role)
    writes = F.startswith(short, F.lit("write")) & (F.contains(signature, F.lit("io.Writer")) | F.contains(signature, F.lit("*os.File")))
    return out.when(writes, "sink")
