"""Operators whose results rest on an order of the nodes, without taking the whole graph to one task: label propagation in the order
of ids, strongly connected components, breaking of cycles.

Steps are joins; each is written (see work). Tasks get a piece of the graph only within a checked bound: consecutive levels of few
edges, or one component of few edges; beyond it the same work is done by joins.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans
from .work import cut, forget

#: Edges that a task may take at a time.
FEW = 1 << 16
#: Edges of one component that a task may take, as numbers.
FEW_OF_COMPONENT = 1 << 20


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def levels(steps: DataFrame) -> DataFrame:
    """id, length: the longest chain of steps (from_id, to_id), distinct and without loops, that ends in each node. A node has a length once all before
    it have one, so nodes on and behind a cycle have none. One round of joins for each length."""
    waiting = cut(steps.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("need")), "waiting")
    frontier = cut(steps.select(F.col("from_id").alias("id")).distinct().join(waiting, "id", "left_anti").withColumn("length", F.lit(0)), "level")
    done = [frontier]
    while not frontier.isEmpty():
        told = steps.join(frontier.withColumnRenamed("id", "from_id"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("got"), (F.max("length") + 1).alias("length"))
        # the last to come are the longest: lengths rise by round
        after = cut(waiting.join(told, "id", "left").select("id", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"), "length"), "waiting")
        forget(waiting)
        frontier = cut(after.where("need = 0").select("id", "length"), "level")
        waiting = cut(after.where("need > 0").select("id", "need"), "waiting")
        forget(after)
        done.append(frontier)
    return _union(done)


def _settle(table: pa.Table) -> pa.Table:
    """New labels of a batch of levels: nodes in order of level, each seeing what is new by then."""
    label, links, level = {}, {}, {}
    rows = zip(*(table.column(c).to_pylist() for c in ("id", "level", "own", "neighbour", "n", "label")), strict=True)
    for node, depth, own, neighbour, n, other in rows:
        label[node], level[node] = own, depth
        links.setdefault(node, []).append((neighbour, n, other))
    for node in sorted(links, key=level.__getitem__):
        votes: dict[str, int] = {}
        for neighbour, n, other in links[node]:
            now = label.get(neighbour, other)
            votes[now] = votes.get(now, 0) + n
        label[node] = min(votes, key=lambda x: (-votes[x], x))
    return pa.table({"id": pa.array(list(links), pa.string()), "label": pa.array([label[x] for x in links], pa.string())})


def ordered_communities(edges: DataFrame, rounds: int = 10, few: int = FEW) -> DataFrame:
    """id, community (numbered from 0 by their least member): label propagation in the order of ids. A node takes its neighbours' most
    frequent label, the smallest of equals, and sees labels that are already new of those before it.

    The nodes before a node are its neighbours with smaller ids. A node's level is the longest chain of such neighbours below it, so
    all nodes of a level depend on lower levels alone and are settled together: the same labels as one by one. A level is one join;
    consecutive levels of at most `few` links together are one bounded task. Time follows the longest rising chain of ids."""
    pairs = edges.select("from_id", "to_id").distinct()
    both = pairs.unionByName(pairs.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    links = cut(both.groupBy(F.col("from_id").alias("id"), F.col("to_id").alias("neighbour")).agg(F.count("*").alias("n")), "links")
    below = cut(links.where("neighbour < id").select(F.col("neighbour").alias("from_id"), F.col("id").alias("to_id")), "below")
    known = levels(below)
    alone = links.select("id").distinct().join(known.select("id"), "id", "left_anti").select("id", F.lit(0).alias("length"))  # only loops
    level = cut(known.unionByName(alone).withColumnRenamed("length", "level"), "levels")
    linked = cut(links.join(level, "id"), "linked", by="level")
    sizes = [(r["level"], r["count"]) for r in linked.groupBy("level").count().orderBy("level").toLocalIterator()]  # one for each round of levels()
    batches: list[list[int]] = []
    room = 0
    for k, size in sizes:
        if batches and size <= room:
            batches[-1].append(k)
            room -= size
        else:
            batches.append([k])
            room = few - size
    labels = [cut(level.where(F.col("level").between(b[0], b[-1])).select("id", F.col("id").alias("label")), "labels") for b in batches]
    size_of = dict(sizes)
    for _ in range(rounds):
        moved = False
        for k, batch in enumerate(batches):
            now = _union(labels)
            own = linked.where(F.col("level").between(batch[0], batch[-1]))
            asked = own.join(now.select(F.col("id").alias("neighbour"), "label"), "neighbour")
            if sum(map(size_of.get, batch)) <= few:
                fresh = asked.join(labels[k].select("id", F.col("label").alias("own")), "id").groupBy().applyInArrow(_settle, "id string, label string")
            else:
                votes = asked.groupBy("id", "label").agg(F.sum("n").alias("votes"))
                fresh = votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("votes"), "label")).alias("label"))
            fresh = cut(fresh, "labels")
            moved |= not fresh.join(labels[k], ["id", "label"], "left_anti").isEmpty()
            forget(labels[k])
            labels[k] = fresh
        if not moved:
            break
    found = _union(labels)
    numbers = scans.with_rank(found.groupBy("label").agg(F.min("id").alias("least")), [], ["least"], "community")
    return found.join(numbers, "label").select("id", (F.col("community") - 1).cast("long").alias("community"))


def _placed(table: pa.Table, *columns: str) -> tuple[pa.Array, np.ndarray]:
    """(the distinct values of all columns in order, the place of each column's rows among them, one column after the other)."""
    both = pa.chunked_array([c for name in columns for c in table.column(name).chunks], table.schema.field(columns[0]).type).combine_chunks()
    ids = pc.unique(both)
    ids = ids.take(pc.sort_indices(ids))
    return ids, pc.index_in(both, ids).to_numpy()


def _links(table: pa.Table) -> tuple[list[str], list[int], list[int]]:
    """(the nodes of a table of edges in order, where each one's neighbours begin, neighbours in order), nodes as places in that order."""
    ids, places = _placed(table, "from_id", "to_id")
    a, b = places[: table.num_rows], places[table.num_rows :]
    order = np.lexsort((b, a))
    return ids.to_pylist(), np.searchsorted(a[order], np.arange(len(ids) + 1)).tolist(), b[order].tolist()


def _closed(n: int, begin: list[int], links: list[int]) -> list[int]:
    """The least node of each node's component, by one depth-first search: a component is closed where no node of its branch leads further back."""
    number, back, at, component = [-1] * n, [0] * n, begin[:-1], [-1] * n
    count, branch = 0, []
    for start in range(n):
        stack = [start] if number[start] < 0 else []
        while stack:
            x = stack[-1]
            if number[x] < 0:
                number[x] = back[x] = count
                count += 1
                branch.append(x)
            if at[x] < begin[x + 1]:
                y = links[at[x]]
                at[x] += 1
                if number[y] < 0:
                    stack.append(y)
                elif component[y] < 0:
                    back[x] = min(back[x], number[y])
                continue
            stack.pop()
            if stack:
                back[stack[-1]] = min(back[stack[-1]], back[x])
            if back[x] == number[x]:
                own = [branch.pop()]
                while own[-1] != x:
                    own.append(branch.pop())
                least = min(own)
                for y in own:
                    component[y] = least
    return component


def _components_of(table: pa.Table) -> pa.Table:
    """id, component of a table of edges."""
    ids, begin, links = _links(table)
    name = pa.array(ids, pa.string())
    return pa.table({"id": name, "component": name.take(pa.array(_closed(len(ids), begin, links), pa.int64()))})


def _least_joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the n places that each one hangs together with by pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _gathered(few: int):
    """Links a, b, up to `few` at a time, as links of each node to the least one that these lead it to."""

    def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        ids, place = _placed(table, "a", "b")
        least = _least_joined(place[: table.num_rows], place[table.num_rows :], len(ids))
        own = np.flatnonzero(least != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(own)), ids.take(pa.array(least[own]))], ["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= few:
                yield joined(held)
                held, size = [], 0
        if size:
            yield joined(held)

    return run


def weak_components(links: DataFrame, few: int = FEW_OF_COMPONENT) -> DataFrame:
    """id, component: nodes of links(from_id, to_id) by the least node that links, taken either way, lead to; loops say nothing.

    Links of one start lie together, and a task turns up to `few` of them into at most one for each of their nodes. Then, in rounds,
    every node hands its larger neighbours to the least node around it, then its smaller ones, in turn, until all point at a least node.
    Ways shrink as they go, so rounds grow with the logarithm of the longest way."""
    kind = links.schema["from_id"].dataType.simpleString()
    together = links.where("from_id <> to_id").select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).repartition("a")
    pairs = cut(together.mapInArrow(_gathered(few), f"a {kind}, b {kind}").distinct(), "weak")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.where("b > a").join(around, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "weak")
        forget(pairs)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        passed = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = cut(least.select("a", F.col("m").alias("b")).unionByName(passed).distinct(), "weak")
        forget(large)
        ends = pairs.select("a", F.lit(1).alias("up")).unionByName(pairs.select(F.col("b").alias("a")).distinct().withColumn("up", F.lit(1)))
        if ends.groupBy("a").count().where("count > 1").isEmpty():  # each points at one node, which points at none
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _trimmed(rest: DataFrame) -> DataFrame:
    """Most nodes outside components go here: nothing leads to them, or nothing leads on. A round that takes under a tenth is the last."""
    size = rest.count()
    for _ in range(3):
        some = rest.join(rest.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi")
        rest = cut(some.join(some.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi").select("from_id", "to_id"), "edges")
        before, size = size, rest.count()
        if size * 10 > before * 9:
            break
    return rest


def _by_reach(rest: DataFrame, few: int) -> list[DataFrame]:
    """Tables of id, component. Each round, every node learns the least node that reaches it; nodes of the same least node that reach it back are its
    component. The rest of the edges between nodes of one least node go on to the next round: a component never crosses such a class."""
    found: list[DataFrame] = []
    while True:
        size = rest.count()
        if size <= few:
            if size:
                found.append(cut(rest.groupBy().applyInArrow(_components_of, "id string, component string"), "component"))
            return found
        least = cut(rest.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().withColumn("least", F.col("id")), "least")
        front = least
        while not front.isEmpty():
            told = rest.join(front.withColumnRenamed("id", "from_id"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.min("least").alias("told"))
            both = cut(least.join(told, "id", "left").select("id", F.least("least", "told").alias("least"), (F.col("told") < F.col("least")).alias("new")), "least")
            least, front = both.select("id", "least"), both.where("new").select("id", "least")
        least = cut(least, "least")
        back = rest.join(least.select(F.col("id").alias("from_id"), F.col("least").alias("a")), "from_id").join(least.select(F.col("id").alias("to_id"), F.col("least").alias("b")), "to_id").where("a = b")
        back = cut(back.select("from_id", "to_id", F.col("a").alias("least")), "inner")
        hit = front = cut(least.where("id = least"), "hit")
        while not front.isEmpty():
            grown = back.join(front.select(F.col("id").alias("to_id")), "to_id").select(F.col("from_id").alias("id"), "least").distinct()
            front = cut(grown.join(hit.select("id"), "id", "left_anti"), "hit")
            hit = hit.unionByName(front)
        hit = cut(hit, "component")
        found.append(hit.select("id", F.col("least").alias("component")))
        rest = cut(back.join(hit.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(hit.select(F.col("id").alias("to_id")), "to_id", "left_anti").select("from_id", "to_id"), "edges")
        rest = _trimmed(rest)


def _shortened(rest: DataFrame, few: int) -> list[DataFrame] | None:
    """Tables of id, component, where chains are taken for one node each; None where they are under a tenth of the edges.

    A link is one of a chain if its start leads nowhere else and nothing else leads to its end: both ends are in one component, or in none.
    A chain is named by its least node. It closes upon itself if it is a ring or another edge leads back into it."""
    one = rest.groupBy("from_id").agg(F.count("*").alias("n"), F.min("to_id").alias("to_id")).where("n = 1").select("from_id", "to_id")
    chain = cut(one.join(rest.groupBy("to_id").count().where("count = 1").select("to_id"), "to_id", "left_semi").select("from_id", "to_id"), "chain")
    if chain.count() * 10 < rest.count():
        return None
    member = cut(weak_components(chain), "member")
    ends = rest.join(chain.withColumn("within", F.lit(True)), ["from_id", "to_id"], "left")
    for end, name in (("from_id", "a"), ("to_id", "b")):
        ends = ends.join(member.select(F.col("id").alias(end), F.col("component").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
    ends = cut(ends.select("a", "b", F.coalesce("within", F.lit(False)).alias("within")), "ends")
    inner = strong_components(ends.where("a <> b").select(F.col("a").alias("from_id"), F.col("b").alias("to_id")), few)
    rings = ends.where("within").groupBy(F.col("a").alias("id")).count().join(member.groupBy(F.col("component").alias("id")).agg(F.count("*").alias("size")), "id").where("count = size")
    closed = ends.where("a = b and not within").select(F.col("a").alias("id")).unionByName(rings.select("id")).distinct()
    inner = cut(inner, "component")
    whole = inner.unionByName(closed.join(inner, "id", "left_anti").withColumn("component", F.col("id")))
    every = whole.join(member.select(F.col("component").alias("id"), F.col("id").alias("node")), "id", "left")
    return [cut(every.select(F.coalesce("node", "id").alias("id"), "component"), "component")]


def _dealt(rest: DataFrame, size: int, few: int) -> DataFrame:
    """from_id, to_id, size, task of `size` edges: how large the weakly connected piece of an edge is, and whose task it is. Small pieces share tasks."""
    # nodes as hashes: should two of them share one, pieces are the larger for it, and nothing else changes
    key = lambda end: F.xxhash64(end).alias(end)
    weak = weak_components(rest.select(key("from_id"), key("to_id"))).select(F.col("id").alias("key"), F.col("component").alias("weak"))
    pieces = cut(rest.withColumn("key", F.xxhash64("from_id")).join(weak, "key", "left").select("from_id", "to_id", F.coalesce("weak", "key").alias("weak")), "pieces")
    much = few // 8
    sizes = pieces.groupBy("weak").agg(F.count("*").alias("size"))
    task = F.when(F.col("size") > much, F.struct(F.lit(0).alias("of"), F.col("weak").alias("k"))).otherwise(F.struct(F.lit(1).alias("of"), F.pmod(F.xxhash64("weak"), F.lit(-(-size // max(much, 1)))).alias("k")))
    return cut(pieces.join(sizes, "weak").select("from_id", "to_id", "size", task.alias("task")), "pieces")


def _by_task(dealt: DataFrame, size: int, few: int):
    """The pieces of at most `few` edges by their tasks, which take long for their bytes and so are not put together by these."""
    return dealt.where(F.col("size") <= few).select("from_id", "to_id", "task").repartition(min(-(-8 * size // max(few, 1)), 4096), "task").groupBy("task")


def strong_components(edges: DataFrame, few: int = FEW_OF_COMPONENT) -> DataFrame:
    """id, component: nodes of strongly connected components of two nodes and more, named by their least node.

    Up to `few` edges go to one task. Beyond that, weakly connected pieces of at most `few` edges go to one task each (small ones together):
    a search's time does not follow the longest way. Larger pieces have their chains shortened first, and the rest goes by joins, whose
    rounds follow the longest way that is left."""
    rest = _trimmed(cut(edges.where("from_id <> to_id").select("from_id", "to_id").distinct(), "edges"))
    size = rest.count()
    if not size:
        return edges.select(F.col("from_id").alias("id"), F.col("from_id").alias("component")).limit(0)
    if size <= few:
        found = [cut(rest.groupBy().applyInArrow(_components_of, "id string, component string"), "component")]
    else:
        dealt = _dealt(rest, size, few)
        found = [cut(_by_task(dealt, size, few).applyInArrow(_components_of, "id string, component string"), "component")]
        large = dealt.where(F.col("size") > few).select("from_id", "to_id")
        if not large.isEmpty():
            large = cut(large, "edges")
            found += _shortened(large, few) or _by_reach(large, few)
    every = _union(found)
    return every.join(every.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("id", "component")


def _cut_back(ids: list[str], begin: list[int], links: list[int], inner: np.ndarray, roots: list[int]) -> pa.Table:
    """The edges that a depth-first search from each root along inner ones, neighbours in order, does not find to lead back to an open node."""
    state, at, inner = [0] * len(ids), begin[:-1], inner.tolist()  # 1: open, 2: closed
    kept = [True] * len(links)
    for root in roots:
        stack, state[root] = [root], 1
        while stack:
            x = stack[-1]
            if at[x] == begin[x + 1]:
                state[x] = 2
                stack.pop()
                continue
            k = at[x]
            at[x] += 1
            if not inner[k]:
                continue
            y = links[k]
            if state[y] == 1:
                kept[k] = False
            elif not state[y]:
                state[y] = 1
                stack.append(y)
    source = np.repeat(np.arange(len(ids)), np.diff(begin))[kept]
    name = pa.array(ids, pa.string())
    return pa.table({"from_id": name.take(pa.array(source)), "to_id": name.take(pa.array(np.array(links, np.int64)[kept]))})


def _searched(table: pa.Table) -> pa.Table:
    """What is left of one component's edges when it is searched from its root."""
    ids, begin, links = _links(table)
    return _cut_back(ids, begin, links, np.ones(len(links), bool), [bisect_left(ids, table.column("root")[0].as_py())])


def _pieces_searched(table: pa.Table) -> pa.Table:
    """What is left of the edges of whole pieces: components are found and searched from their roots, see acyclic."""
    ids, begin, links = _links(table)
    component, b = np.array(_closed(len(ids), begin, links), np.int64), np.array(links, np.int64)
    inner = component[np.repeat(np.arange(len(ids)), np.diff(begin))] == component[b]
    root = np.full(len(ids), len(ids))
    np.minimum.at(root, component[b[~inner]], b[~inner])
    own = np.unique(component[b[inner]])  # components of two nodes and more, as there are no loops
    return _cut_back(ids, begin, links, inner, np.where(root[own] < len(ids), root[own], own).tolist())


def _long_path(table: pa.Table) -> pa.Table:
    """id, place (from 1), component: the longest path that a depth-first search from the root over some edges of a component comes to."""
    component, root = table.column("component")[0].as_py(), table.column("root")[0].as_py()
    ids, begin, links = _links(table)
    start = bisect_left(ids, root)
    best = [root]
    if start < len(ids) and ids[start] == root:
        seen, at, stack, most = {start}, begin[:-1], [start], 1
        while stack:
            x = stack[-1]
            if at[x] == begin[x + 1]:
                stack.pop()
                continue
            y = links[at[x]]
            at[x] += 1
            if y not in seen:
                seen.add(y)
                stack.append(y)
                if len(stack) > most:
                    most, best = len(stack), [ids[k] for k in stack]
    return pa.table({"id": pa.array(best, pa.string()), "place": pa.array(range(1, len(best) + 1), pa.int32()), "component": pa.array([component] * len(best), pa.string())})


def _peeled(inner: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """(edges that stay, edges to look at again) of large components (from_id, to_id, component, size, root): one branch of the search at once.

    The branch is a long path from the root, found over a share of about `few` of a component's edges. A node beside it is searched
    from the last node of the path that reaches it (without the path), while that one and those before it are open: edges from it to these
    are dropped, edges to later ones stay."""
    share = inner.where((F.pmod(F.xxhash64("from_id", "to_id"), F.ceil(F.col("size") / few)) == 0) | ((F.col("from_id") == F.col("root")) & (F.pmod(F.xxhash64("to_id"), F.ceil(F.col("size") / few)) == 0)))
    roots = inner.select("component", "root").distinct().select(F.col("root").alias("from_id"), F.col("root").alias("to_id"), "component", "root")  # a path at least
    path = cut(share.select("from_id", "to_id", "component", "root").unionByName(roots).groupBy("component").applyInArrow(_long_path, "id string, place int, component string"), "path")
    placed = inner.join(path.select(F.col("id").alias("from_id"), F.col("place").alias("pa")), "from_id", "left").join(path.select(F.col("id").alias("to_id"), F.col("place").alias("pb")), "to_id", "left")
    placed = cut(placed.select("from_id", "to_id", "pa", "pb"), "placed")
    beside = placed.where("pa is null and pb is null")
    front = cut(placed.where("pa is not null and pb is null").groupBy(F.col("to_id").alias("id")).agg(F.max("pa").alias("last")), "last")
    last = front
    while not front.isEmpty():
        told = beside.join(front.withColumnRenamed("id", "from_id"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.max("last").alias("told"))
        both = cut(last.join(told, "id", "full").select("id", F.greatest("last", "told").alias("last"), ((F.col("told") > F.col("last")) | F.col("last").isNull()).alias("new")), "last")
        last, front = both.select("id", "last"), both.where("new").select("id", "last")
    known = placed.join(last.select(F.col("id").alias("from_id"), F.col("last").alias("la")), "from_id", "left").join(last.select(F.col("id").alias("to_id"), F.col("last").alias("lb")), "to_id", "left")
    known = cut(known.withColumns({"i": F.coalesce("pa", "la"), "j": F.coalesce("pb", "lb")}), "known")
    open_ = F.col("pb").isNotNull() & (F.col("pb") <= F.col("i"))
    again = F.col("pb").isNull() & (F.col("i") == F.col("j"))
    return known.where(~open_ & ~again).select("from_id", "to_id"), known.where(again).select("from_id", "to_id")


def acyclic(edges: DataFrame, few: int = FEW_OF_COMPONENT) -> DataFrame:
    """from_id, to_id: distinct edges that remain when those that close a cycle are taken out. The rest has no cycle, and each edge that was
    taken out would close one again.

    Only edges within a strongly connected component can. A component is searched depth-first from its root, the least node with an edge
    from outside or else its least node, and what leads back to an open node is dropped: in one task for each weakly connected piece of at
    most `few` edges, or else for each such component. A larger component is searched along one long path by joins (see _peeled), what is
    left beside the path is looked at again."""
    left = cut(edges.where("from_id <> to_id").select("from_id", "to_id").distinct(), "edges")
    kept: list[DataFrame] = []
    size = left.count()
    if size <= few:
        return cut(left.groupBy().applyInArrow(_pieces_searched, "from_id string, to_id string"), "searched") if size else left
    dealt = _dealt(left, size, few)
    kept.append(cut(_by_task(dealt, size, few).applyInArrow(_pieces_searched, "from_id string, to_id string"), "searched"))
    left = cut(dealt.where(F.col("size") > few).select("from_id", "to_id"), "edges")
    while True:
        component = cut(strong_components(left, few), "components")
        if component.isEmpty():
            return _union([*kept, left])
        ends = left.join(component.select(F.col("id").alias("from_id"), F.col("component").alias("a")), "from_id", "left")
        ends = cut(ends.join(component.select(F.col("id").alias("to_id"), F.col("component").alias("b")), "to_id", "left"), "ends")
        outer, inner = ends.where("not (a <=> b) or a is null"), ends.where("a = b")
        entry = outer.where("b is not null").groupBy("b").agg(F.min("to_id").alias("entry"))
        sizes = inner.groupBy("b").agg(F.count("*").alias("size")).join(entry, "b", "left").select("b", "size", F.coalesce("entry", "b").alias("root"))
        inner = cut(inner.join(sizes, "b").select("from_id", "to_id", F.col("b").alias("component"), "size", "root"), "inner")
        small, large = inner.where(F.col("size") <= few), inner.where(F.col("size") > few)
        kept += [outer.select("from_id", "to_id"), cut(small.groupBy("component").applyInArrow(_searched, "from_id string, to_id string"), "searched")]
        if large.isEmpty():
            return _union(kept)
        stay, left = _peeled(large, few)
        kept.append(stay)
        left = cut(left, "edges")
