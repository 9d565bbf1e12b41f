"""Traversals and scores over nodes(id, type, ...) and edges(from_id, to_id, type), as frontier joins.

A frontier is joined to the edge table level by level and new nodes are told from visited ones by anti joins. Each level is
written to the shared folder (see work), so plans stay small and a lost executor costs one level; nothing but sizes and the
largest change of a round reaches the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from . import power, scans
from .orders import levels
from .work import cut, forget

# How strongly each type of edge ties its ends; the same for spreading activation; and the tiers of impact.
EDGE_WEIGHTS = {
    "CALLS": 1.0, "DATA_FLOWS": 0.95, "IMPLEMENTS": 0.9, "EMBEDS": 0.85, "DEPENDS_ON": 0.8, "IMPORTS": 0.7, "EXPORTS": 0.5, "DEFINES": 0.15, "HANDLES": 0.9, "CONTAINS": 0.15,
    "EXPLAINS": 0.7, "DOCUMENTED_BY": 0.6, "LINKS_TO": 0.3, "MANUAL": 0.5, "DEPLOYS": 0.75, "CONSUMES": 0.75, "CONFIGURED_BY": 0.65, "DOCUMENTS": 0.65, "MENTIONS": 0.55,
    "CONTRADICTS": 0.6, "CAUSED_BY": 0.5, "INSTANCE_OF": 0.4, "RELATES_TO": 0.3,
}
OTHER_WEIGHT = 0.5
SPREAD_WEIGHTS = {"CALLS": 1.0, "IMPLEMENTS": 0.7, "IMPORTS": 0.5}
TIERS = ((1, "direct", 1.0), (2, "indirect", 0.6), (3, "peripheral", 0.3))
CROSS_DOMAIN = ("DEPLOYS", "CONSUMES", "CONFIGURED_BY", "DOCUMENTS", "MENTIONS", "MANUAL", "CONTRADICTS", "CAUSED_BY", "INSTANCE_OF", "RELATES_TO")
CROSS_DOMAIN_CAPS = {"DEPLOYS": 30, "CONSUMES": 30, "CONFIGURED_BY": 20, "DOCUMENTS": 20, "MANUAL": 20, "MENTIONS": 15}
CATEGORIES = {"DEPLOYS": "infra", "CONSUMES": "api", "CONFIGURED_BY": "config", "DOCUMENTS": "docs"}
#: Nodes that a walk from a root looks at, and how far from its seeds they may be.
CANDIDATES, HORIZON = 10_000, 6


def chosen(kind: Column, values: dict, other) -> Column:
    """The value of a key, or other."""
    return reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), values.items(), F.when(F.lit(False), F.lit(other))).otherwise(other)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type")


def reachable(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """id, hop: the nodes within depth steps of seeds(id), at their least distance; seeds have hop 0. most: the walk ends with that many
    nodes, those of the last hop that sort first."""
    steps = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("next"))
    frontier = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    seen, n = frontier, frontier.count() if most else 0
    for hop in range(1, depth + 1):
        grown = frontier.join(steps, "id").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        frontier = cut(grown, "frontier") if hop < depth or most else grown
        if most:
            new = frontier.count()
            if n + new >= most:
                return seen.unionByName(frontier.orderBy("id").limit(most - n))
            n += new
        seen = seen.unionByName(frontier)
        if hop < depth and frontier.isEmpty():
            break
    return seen


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3, nodes: DataFrame | None = None) -> DataFrame:
    """id, depth, label, confidence: who is affected if seeds change, by callers and implementations. With nodes also the entities of
    files that import a seed's package, at the full depth."""
    hit = reachable(reversed_edges(edges.where(F.col("type").isin("CALLS", "IMPLEMENTS"))), seeds, depth)
    if nodes is not None:
        hit = cut(hit, "impact")
        packages = nodes.join(seeds, "id", "left_semi").where("package <> ''").select(F.col("package").alias("name")).distinct()
        imported = nodes.where("type = 'package'").join(packages, "name", "left_semi").select(F.col("id").alias("to_id"))
        importers = edges.where("type = 'IMPORTS'").join(imported, "to_id", "left_semi").select(F.col("from_id").alias("id"))
        files = nodes.join(importers, "id", "left_semi").where("file <> ''").select("file").distinct()
        there = nodes.where("type not in ('file', 'package')").join(files, "file", "left_semi").select("id").join(hit, "id", "left_anti")
        hit = hit.unionByName(there.withColumn("hop", F.lit(depth)))
    label, sure = (reduce(lambda acc, t, k=k: acc.when(F.col("hop") == t[0], t[k]), TIERS, F.when(F.lit(False), TIERS[-1][k])).otherwise(TIERS[-1][k]) for k in (1, 2))
    return hit.where("hop > 0").select("id", F.col("hop").alias("depth"), label.alias("label"), sure.alias("confidence"))


def impact_tiers(affected: DataFrame, nodes: DataFrame, cap: int = 50) -> DataFrame:
    """Per tier: how many are affected, in how many files, and the first `cap` names, listed."""
    named = affected.join(nodes.select("id", "name", "file"), "id")
    first = Window.partitionBy("depth").orderBy("name", "id")
    listed = named.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= cap).groupBy("depth").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count("*").alias("listed"))
    return named.groupBy("depth", "label").agg(F.count("*").alias("total"), F.countDistinct("file").alias("files")).join(listed, "depth")


def cross_domain_impact(nodes: DataFrame, edges: DataFrame, root: str, most: int = 100) -> DataFrame:
    """id, name, type, category: what lies one step across domains from root, capped by type of edge."""
    out = edges.where((F.col("from_id") == root) & F.col("type").isin(*CROSS_DOMAIN)).select(F.col("to_id").alias("id"), "type")
    back = edges.where((F.col("to_id") == root) & F.col("type").isin("DOCUMENTS", "MENTIONS", "MANUAL")).select(F.col("from_id").alias("id"), "type")
    refs = out.unionByName(back).where(F.col("id") != root).distinct().join(nodes.select("id", "name"), "id")
    rank = F.row_number().over(Window.partitionBy("type").orderBy("name", "id"))
    kept = refs.withColumn("rank", rank).where(F.col("rank") <= chosen(F.col("type"), CROSS_DOMAIN_CAPS, 10))
    return kept.select("id", "name", "type", chosen(F.col("type"), CATEGORIES, "related").alias("category")).orderBy("category", "name", "id").limit(most)


def aggregated_impact(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 3, methods: int = 30) -> DataFrame:
    """impact of a struct or interface: that of itself and of its first `methods` methods; the nearest tier counts."""
    own = nodes.where(F.col("id") == root).select(F.concat("name", F.lit(".")).alias("prefix"))
    parts = nodes.where("type = 'method'").join(F.broadcast(own), F.expr("startswith(name, prefix)")).select("id", "name").orderBy("name", "id").limit(methods).select("id")
    seeds = nodes.where(F.col("id") == root).select("id").unionByName(parts)
    return impact(edges, seeds, depth)


def tests_for(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, is_test: Column, depth: int = 5) -> DataFrame:
    """file, distance, priority: test files that reach a seed over calls; the walk does not go on from test files."""
    back = reversed_edges(edges.where("type = 'CALLS'"))
    files = nodes.select("id", "file", is_test.alias("test"))
    seen = frontier = seeds.select("id").distinct()
    found = None
    for hop in range(1, depth + 1):
        grown = frontier.join(back.select(F.col("from_id").alias("id"), F.col("to_id").alias("next")), "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti")
        level = cut(grown.join(files, "id"), "callers")
        hit = level.where("test").select("file", F.lit(hop).alias("distance"))
        found = hit if found is None else found.unionByName(hit)
        seen = seen.unionByName(level.select("id"))
        frontier = level.where("not test").select("id")
        if frontier.isEmpty():
            break
    best = found.groupBy("file").agg(F.min("distance").alias("distance"))
    return best.withColumn("priority", F.when(F.col("distance") <= 1, "critical").when(F.col("distance") <= 2, "likely").otherwise("peripheral"))


def call_chain(edges: DataFrame, source: str, target: str, depth: int = 30) -> DataFrame:
    """hops, path (ids joined by ' > '): the shortest chain of calls, implementations (either way) or handlers; of equals, the path that
    sorts first."""
    forth = edges.where(F.col("type").isin("CALLS", "IMPLEMENTS", "HANDLES"))
    steps = forth.unionByName(reversed_edges(edges.where("type = 'IMPLEMENTS'"))).select(F.col("from_id").alias("id"), F.col("to_id").alias("next"))
    frontier = edges.sparkSession.createDataFrame([(source, source)], "id string, path string").withColumn("hops", F.lit(0))
    seen = frontier
    for hop in range(1, depth + 1):
        grown = frontier.join(steps, "id").select(F.col("next").alias("id"), F.concat_ws(" > ", "path", "next").alias("path"))
        frontier = cut(grown.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)), "chain")
        seen = seen.unionByName(frontier)
        if frontier.isEmpty() or not frontier.where(F.col("id") == target).isEmpty():
            break
    return seen.where(F.col("id") == target).select("hops", "path")


def spreading_activation(edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 500) -> DataFrame:
    """id, activation: seeds have 1; a node gives weight / fan-out of its own to each neighbour, over calls, imports and
    implementations either way at the first step and calls alone beyond; the best path counts. Only nodes that are new at a step pass
    activation on. The `most` nodes that are nearest to the seeds, then most active, are kept."""
    level = seeds.select("id", F.lit(1.0).alias("activation")).distinct()
    total = level.withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        use = undirected(edges.where(F.col("type").isin(*SPREAD_WEIGHTS) if hop == 1 else F.col("type") == "CALLS"))
        near = use.join(level, use["from_id"] == level["id"]).select("from_id", "to_id", "activation", chosen(F.col("type"), SPREAD_WEIGHTS, 0.4).alias("w"))
        fan = near.groupBy("from_id").agg(F.count("*").alias("fan"))
        grown = near.join(fan, "from_id").groupBy(F.col("to_id").alias("id")).agg(F.max(F.col("activation") * F.col("w") / F.col("fan")).alias("activation"))
        both = cut(grown.join(total.groupBy("id").agg(F.min("hop").alias("first")), "id", "left"), "activation")
        total = total.unionByName(both.select("id", "activation", F.coalesce("first", F.lit(hop)).alias("hop")))
        level = both.where("first is null").select("id", "activation")
    best = total.groupBy("id").agg(F.max("activation").alias("activation"), F.min("hop").alias("hop"))
    return best.orderBy("hop", F.desc("activation"), "id").limit(most).select("id", "activation")


def teleport(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """id, share (sum 1): where a walk from root starts over. A struct or interface shares with its methods, an interface also with its
    implementors and theirs."""
    own = nodes.where(F.col("id") == root).select("id", "name", "type")
    typed = own.where("type in ('struct', 'interface')")
    methods = nodes.where("type = 'method'").select("id", "name")
    named = lambda owners, share: methods.join(F.broadcast(owners.select(F.concat("name", F.lit(".")).alias("prefix"))), F.expr("startswith(name, prefix)"), "left_semi").select("id", F.lit(share).alias("share"))
    makers = edges.where((F.col("to_id") == root) & (F.col("type") == "IMPLEMENTS")).join(F.broadcast(own.where("type = 'interface'").select(F.col("id").alias("to_id"))), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    makers = nodes.select("id", "name").join(makers, "id", "left_semi").where(F.col("id") != root)
    parts = own.select("id", F.lit(1.0).alias("share")).unionByName(named(typed, 0.9)).unionByName(makers.select("id", F.lit(0.85).alias("share"))).unionByName(named(makers, 0.85))
    best = parts.groupBy("id").agg(F.max("share").alias("share"))
    return cut(best.join(F.broadcast(best.agg(F.sum("share").alias("all")))).select("id", (F.col("share") / F.col("all")).alias("share")), "teleport")


def walk_weights(edges: DataFrame, nodes: DataFrame, weights: dict[str, float] | None = None, cross_domain: float = 0.5, boost: float = 0.0, learned: DataFrame | None = None) -> DataFrame:
    """from_id, to_id, w: how strongly a walk goes each way along each edge. cross_domain: a factor between domains (an empty one is code).
    boost: calls are followed forwards (above 0) or backwards (below) the more. learned(from_id, to_id, type, factor)."""
    w = chosen(F.col("type"), weights or EDGE_WEIGHTS, OTHER_WEIGHT)
    both = edges.select("from_id", "to_id", "type", w.alias("w"))
    if learned is not None:
        both = both.join(learned, ["from_id", "to_id", "type"], "left").withColumn("w", F.col("w") * F.coalesce("factor", F.lit(1.0))).drop("factor")
    forth = both.withColumn("w", F.when(F.col("type") == "CALLS", F.col("w") * (1 + max(boost, 0.0))).otherwise(F.col("w")))
    back = both.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type", F.when(F.col("type") == "CALLS", F.col("w") * (1 + max(-boost, 0.0))).otherwise(F.col("w")).alias("w"))
    every = forth.unionByName(back).select("from_id", "to_id", "w")
    if not 0 < cross_domain < 1:
        return every
    domain = nodes.select("id", F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("code")).alias("domain"))
    ends = every.join(domain.select(F.col("id").alias("from_id"), F.col("domain").alias("a")), "from_id", "left").join(domain.select(F.col("id").alias("to_id"), F.col("domain").alias("b")), "to_id", "left")
    return ends.select("from_id", "to_id", F.when(F.col("a") != F.col("b"), F.col("w") * cross_domain).otherwise(F.col("w")).alias("w"))


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, root: str, alpha: float = 0.15, rounds: int = 100, tolerance: float = 1e-6, **weighing) -> DataFrame:
    """id, rank, hop for the CANDIDATES nearest nodes within HORIZON steps (of equally near ones those that sort first): a weighted walk
    that starts over at teleport(root) with probability alpha and from nodes without edges, until no rank moves by tolerance. As the
    candidates are so bounded, the rounds run in one task."""
    start = teleport(nodes, edges, root)
    near = cut(reachable(undirected(edges), start, HORIZON, CANDIDATES), "near")
    inside = edges.join(near.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(near.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    steps = walk_weights(inside, nodes.join(near.select("id"), "id", "left_semi"), **weighing).groupBy("from_id", "to_id").agg(F.sum("w").alias("w"))
    rows = near.join(start, "id", "left").select("id", F.lit(None).cast("string").alias("to_id"), F.coalesce("share", F.lit(0.0)).alias("w"), "hop")
    rows = rows.unionByName(steps.select(F.col("from_id").alias("id"), "to_id", "w", F.lit(-1).alias("hop")))

    def solve(table: pa.Table) -> pa.Table:
        is_node = np.array(table.column("to_id").is_null())
        own, links = table.filter(pa.array(is_node)), table.filter(pa.array(~is_node))
        own = own.sort_by("id")
        ids = own.column("id").to_pylist()
        place = {x: k for k, x in enumerate(ids)}
        a, b = (np.array([place[x] for x in links.column(c).to_pylist()], dtype=np.int64) for c in ("id", "to_id"))
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], links.column("w").to_numpy()[order]
        start = own.column("w").to_numpy()
        out = np.bincount(a, weights=w, minlength=len(ids))
        p = w / out[a]
        rank = np.zeros(len(ids))
        rank[place[root]] = 1.0
        for _ in range(rounds):
            new = alpha * start + (1 - alpha) * (np.bincount(b, weights=rank[a] * p, minlength=len(ids)) + rank[out <= 0].sum() * start)
            moved = np.abs(new - rank).max()
            rank = new
            if moved < tolerance:
                break
        return pa.table({"id": pa.array(ids, pa.string()), "rank": rank, "hop": own.column("hop")})

    return cut(rows.groupBy().applyInArrow(solve, "id string, rank double, hop int"), "ranks")


#: Pairs of neighbours up to which centrality is found in one task.
FEW_PAIRS = 1 << 22


def eigenvector_centrality(edges: DataFrame, rounds: int = 50, tolerance: float = 1e-6, few: int = FEW_PAIRS) -> DataFrame:
    """id, centrality: power iteration of A + I over edges either way, scaled by the largest value each round, until none moves by
    tolerance. Up to `few` pairs of neighbours go to one task; beyond that parts of the graph hand each other sums (see power)."""
    pairs = cut(undirected(edges).groupBy(F.col("from_id").alias("id"), "to_id").agg(F.count("*").alias("n")), "adjacency")
    if pairs.count() <= few:

        def solve(table: pa.Table) -> pa.Table:
            ids, places = _numbered(table, "id", "to_id")
            a, b, n = places[: table.num_rows], places[table.num_rows :], table.column("n").to_numpy().astype(float)
            x = np.ones(len(ids))
            for _ in range(rounds):
                new = x + np.bincount(b, weights=x[a] * n, minlength=len(ids))
                new /= new.max()
                moved, x = np.abs(new - x).max(), new
                if moved < tolerance:
                    break
            return pa.table({"id": ids, "centrality": x})

        return pairs.groupBy().applyInArrow(solve, "id string, centrality double")
    return power.iterate(pairs, rounds, tolerance)


def _numbered(table: pa.Table, *columns: str) -> tuple[pa.Array, np.ndarray]:
    """(the distinct values of all columns, the place of each column's rows among them, one column after the other)."""
    both = pa.chunked_array([c for name in columns for c in table.column(name).chunks]).combine_chunks()
    both = both.dictionary_encode()
    return both.dictionary, both.indices.to_numpy()


def moved_centrality(before: DataFrame, after: DataFrame, threshold: float) -> DataFrame:
    """id, change: nodes whose centrality moved by more than threshold; new and lost ones count from 0."""
    both = before.withColumnRenamed("centrality", "a").join(after.withColumnRenamed("centrality", "b"), "id", "full")
    change = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return both.select("id", change.alias("change")).where(F.col("change") > threshold)


def path_pattern(nodes: DataFrame, edges: DataFrame, kinds: list[str], start: Column, end: Column) -> DataFrame:
    """start_id, end_id: typed paths along exactly these edge types, between nodes that meet start and end; each pair once. The last step goes
    along edges to nodes that meet end only, so no other pair is made."""
    level = nodes.where(start).select(F.col("id").alias("start_id"), F.col("id").alias("end_id"))
    ends = nodes.where(end)
    if not kinds:
        return level.join(ends.select(F.col("id").alias("end_id")), "end_id", "left_semi")
    for k, kind in enumerate(kinds):
        step = edges.where(F.col("type") == kind).select(F.col("from_id").alias("end_id"), "to_id")
        if k == len(kinds) - 1:
            step = step.join(ends.select(F.col("id").alias("to_id")), "to_id", "left_semi")
        if k and k == len(kinds) - 1:
            return _listed_ends(level, step, edges.where(F.col("type") == kinds[k - 1]).select(F.col("to_id").alias("end_id")))
        level = level.join(step, "end_id").select("start_id", F.col("to_id").alias("end_id")).distinct()
    return level


#: Ends that a row lists at most, about, and pairs of a task that tells them apart.
LISTED, TASK_PAIRS = 256, 1 << 20


def _listed_ends(level: DataFrame, step: DataFrame, into: DataFrame) -> DataFrame:
    """start_id, end_id: distinct pairs of level(start_id, end_id) taken on along step(end_id, to_id). A node's next ends go to the starts as lists, and
    pairs are made and told apart there, in tasks of about TASK_PAIRS of them. into(end_id): a row for each way into a node, to tell how many there are."""
    degree = step.groupBy("end_id").agg(F.ceil(F.count("*") / LISTED).alias("k"))
    piece = F.pmod(F.xxhash64("to_id"), "k")
    lists = cut(step.join(degree, "end_id").groupBy("end_id", piece.alias("k")).agg(F.collect_list("to_id").alias("ends")).select("end_id", "ends"), "ends")
    pairs = into.groupBy("end_id").count().join(lists.groupBy("end_id").agg(F.sum(F.size("ends")).alias("n")), "end_id").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    tasks = max(1, -(-(pairs or 0) // TASK_PAIRS))
    return level.join(lists, "end_id").select("start_id", "ends").repartition(tasks, "start_id").select("start_id", F.explode("ends").alias("end_id")).distinct()


def data_flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, hops: int = 4) -> DataFrame:
    """source, sink, hop: which sinks each source reaches over calls. A pair goes on only to nodes from which some sink is near enough for the
    hops that are left, so pairs that lead nowhere are not made."""
    steps = edges.where("type = 'CALLS'").select(F.col("from_id").alias("id"), F.col("to_id").alias("next"))
    near = cut(reachable(reversed_edges(edges.where("type = 'CALLS'")), sinks, hops - 1), "near").select(F.col("id").alias("next"), F.col("hop").alias("left"))
    frontier = sources.select(F.col("id").alias("source"), "id").withColumn("hop", F.lit(0))
    seen = frontier
    for hop in range(1, hops + 1):
        useful = steps.join(near.where(F.col("left") <= hops - hop), "next", "left_semi")
        frontier = frontier.join(useful, "id").select("source", F.col("next").alias("id")).distinct().join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("hop", F.lit(hop))
        frontier = cut(frontier, "flows") if hop < hops else frontier
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0").join(sinks.select("id"), "id", "left_semi").select("source", F.col("id").alias("sink"), "hop")


def invalidated(nodes: DataFrame, edges: DataFrame, file: str) -> DataFrame:
    """Files to look at again when a file changes: itself, files of callers up to two steps, and its packages' files."""
    own = nodes.where(F.col("file") == file)
    near = reachable(reversed_edges(edges.where("type = 'CALLS'")), own, 2).join(nodes, "id").select("file")
    same = nodes.join(own.select("package").distinct(), "package").select("file")
    return near.unionByName(same).distinct()


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sizes, density, orphans, the share of edges that cross files, and fan-in's and fan-out's maximum, median and 95th percentile
    (the value at the place floor((n - 1) * p / 100) in rising order, over all nodes)."""
    files = nodes.select("id", "file")
    ends = edges.join(files.select(F.col("id").alias("from_id"), F.col("file").alias("f")), "from_id").join(files.select(F.col("id").alias("to_id"), F.col("file").alias("g")), "to_id")
    e = ends.agg(F.count("*").alias("edges"), F.sum((F.col("type") == "CALLS").cast("long")).alias("calls"), F.sum((F.col("f") != F.col("g")).cast("long")).alias("cross"))
    touched = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    orphans = nodes.join(touched, "id", "left_anti").agg(F.count("*").alias("orphans"))
    out = nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(e)).join(F.broadcast(orphans))
    for name, end in (("fanin", "to_id"), ("fanout", "from_id")):
        counted = nodes.select("id").join(edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("d")), "id", "left")
        # degrees take few values, so their histogram is small: running counts need one window over it
        held = counted.groupBy(F.coalesce("d", F.lit(0)).alias("d")).agg(F.count("*").alias("n"))
        upto = held.withColumn("upto", F.sum("n").over(Window.orderBy("d"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
        at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * p / 100), F.col("d"))).alias(f"{name}_p{p}")  # noqa: E731, B023
        out = out.join(F.broadcast(upto.agg(F.max("d").alias(f"{name}_max"), at(50), at(95))))
    density, cross = F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9), F.round(100 * F.col("cross") / F.col("edges"), 6)
    return out.select("nodes", "edges", "calls", "orphans", density.alias("density"), cross.alias("cross_file_pct"), *[f"{n}_{k}" for n in ("fanin", "fanout") for k in ("max", "p50", "p95")])


def directory_coupling(nodes: DataFrame, edges: DataFrame, least_share: float = 0.85, least: int = 3, keep: int = 5) -> DataFrame:
    """Suggested rules: pairs of files' folders where nearly all callers that leave their folder call into one other."""
    folder = F.substring_index("file", "/", 1)
    at = nodes.select("id", folder.alias("dir"))
    out = edges.where("type = 'CALLS'").join(at.select(F.col("id").alias("from_id"), F.col("dir").alias("from_dir")), "from_id").join(at.select(F.col("id").alias("to_id"), F.col("dir").alias("to_dir")), "to_id").where("from_dir <> to_dir")
    every = out.groupBy("from_dir").agg(F.countDistinct("from_id").alias("leaving"))
    pairs = out.groupBy("from_dir", "to_dir").agg(F.countDistinct("from_id").alias("callers")).join(every, "from_dir")
    share = F.round(F.col("callers") / F.col("leaving"), 2)
    return pairs.withColumn("confidence", share).where((F.col("callers") / F.col("leaving") >= least_share) & (F.col("callers") >= least)).orderBy(F.desc("confidence"), F.desc("callers"), "from_dir", "to_dir").limit(keep)


#: Links that a task of label propagation holds, about.
TASK_LINKS = 1 << 20


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, community: each round a node takes its neighbours' most frequent label, the smallest of equals (all nodes at once). Nodes are
    numbered in the order of their ids, so rounds shuffle and compare numbers."""
    named, forth = scans.numbered(edges)
    # neighbours lie with the node whose label they hear of; nothing but labels moves in a round
    # fewer tasks than a join has by itself would be dealt anew in each round
    tasks = max(-(-2 * forth.count() // TASK_LINKS), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    step = forth.unionByName(forth.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition(tasks, "b").distinct().persist(StorageLevel.DISK_ONLY)
    # in the first round all labels have one vote: the least neighbour's is taken
    label = cut(step.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("community")), "labels") if rounds else named.select("n", F.col("n").alias("community"))
    for _ in range(1, rounds):
        heard = step.join(label.withColumnRenamed("n", "b"), "b").select("a", "community").repartition("a")
        votes = heard.groupBy("a", "community").agg(F.count("*").alias("votes"))
        fresh = cut(votes.groupBy(F.col("a").alias("n")).agg(F.min_by("community", F.struct(-F.col("votes"), "community")).alias("community")), "labels")
        forget(label)
        label = fresh
    step.unpersist()
    names = named.select(F.col("n").alias("community"), F.col("id").alias("name"))
    return label.join(named, "n").join(names, "community").select("id", F.col("name").alias("community"))


def longest_chain(edges: DataFrame) -> DataFrame:
    """id, length: the longest call chain that ends in each node, in topological order: a node has a length once all its callers have one,
    so nodes on and behind a cycle have none."""
    return levels(cut(edges.where("type = 'CALLS' and from_id <> to_id").select("from_id", "to_id").distinct(), "calls"))
