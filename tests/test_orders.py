"""Operators that rest on an order, against one-by-one Python: communities, components, cycles, segmented scans."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from grafonda.operators import orders, scans

from .test_sizes import shuffled


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], "from_id string, to_id string, type string")


def one_by_one(pairs, rounds=10):
    links = {}
    for a, b in set(pairs):
        links.setdefault(a, []).append(b)
        links.setdefault(b, []).append(a)
    label = {x: x for x in links}
    for _ in range(rounds):
        before = dict(label)
        for x in sorted(links):
            votes = {}
            for y in links[x]:
                votes[label[y]] = votes.get(label[y], 0) + 1
            label[x] = min(votes, key=lambda k: (-votes[k], k))
        if label == before:
            break
    first = {}
    for x in sorted(label):
        first.setdefault(label[x], len(first))
    return {x: first[label[x]] for x in label}


@pytest.mark.parametrize("few", [12, orders.FEW])
def test_ordered_communities(spark, few):
    rng = random.Random(7)
    pairs = [(f"n{rng.randint(0, 9)}{c}", f"n{rng.randint(0, 9)}{c}") for c in "abc" for _ in range(11)] + [("n0a", "n0b"), ("n5b", "n1c"), ("z", "z"), ("n0a", "n1a"), ("n1a", "n0a")]
    got = {r.id: r.community for r in orders.ordered_communities(edges_of(spark, pairs), 4, few).collect()}
    assert got == one_by_one(pairs, 4)


def reach(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = {}
    for x in {x for p in pairs for x in p}:
        seen, todo = set(), [x]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        found[x] = seen
    return found


def random_graph(seed, nodes, n):
    rng = random.Random(seed)
    return [(f"v{rng.randint(0, nodes)}", f"v{rng.randint(0, nodes)}") for _ in range(n)]


@pytest.mark.parametrize("seed,few", [(1, 0), (2, 1 << 20)])
def test_strong_components(spark, seed, few):
    pairs = random_graph(seed, 40, 60) + [("tail", "v1"), ("v2", "end"), ("x", "y"), ("y", "x")]
    there = reach(pairs)
    want = {x: min(y for y in there if y in there[x] and x in there[y]) for x in there if any(y != x and y in there[x] and x in there[y] for y in there)}
    assert {r.id: r.component for r in orders.strong_components(edges_of(spark, pairs), few).collect()} == want
    assert orders.strong_components(edges_of(spark, [])).count() == 0


def test_long_rings_take_few_rounds(spark, monkeypatch):
    """Rings of 300 nodes beyond what a task takes, with and without edges beside them: steps grow with the logarithm of a ring's length."""
    ring = lambda name, n: [(f"{name}{k:03}", f"{name}{(k + 1) % n:03}") for k in range(n)]
    pairs = ring("a", 300) + ring("b", 300) + [("b007", "c000"), ("b100", "b050"), ("c009", "d000")] + ring("c", 10) + [(f"d{k:03}", f"d{k + 1:03}") for k in range(300)]
    steps = []
    monkeypatch.setattr(orders, "cut", lambda df, *a, real=orders.cut, **k: steps.append(1) or real(df, *a, **k))
    got = {r.id: r.component for r in orders.strong_components(edges_of(spark, pairs), 20).collect()}
    assert got == {x: f"{x[0]}000" for x, _ in pairs if x[0] != "d"}
    assert len(steps) < 200
    assert {r.id: r.component for r in orders.weak_components(edges_of(spark, [("x", "y"), ("z", "y"), ("q", "r")])).collect()} == {"x": "x", "y": "x", "z": "x", "q": "q", "r": "q"}


@pytest.mark.parametrize("seed,nodes,n,few", [(1, 30, 70, 1 << 20), (2, 9, 36, 8)])
def test_cycles_are_broken_where_they_must_be(spark, seed, nodes, n, few):
    """No cycle is left, and each edge taken out would close one; also where components are searched by joins."""
    pairs = {p for p in random_graph(seed, nodes, n) if p[0] != p[1]}
    kept = [(r.from_id, r.to_id) for r in orders.acyclic(edges_of(spark, sorted(pairs)), few).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= pairs
    there = reach(kept)
    assert all(x not in there[x] for x in there)
    assert all(a in there.get(b, ()) for a, b in pairs - set(kept))


def test_scans_equal_windows(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 20), k, rng.choice([None, 1, 2, 3])) for k in range(400)] + [("hot", 5, 1000 + k, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, t int, id long, v int").repartition(6)
    w = Window.partitionBy("g").orderBy(F.desc("t"), "id")
    want = df.select("id", F.row_number().over(w).alias("rank")).collect()
    assert {r.id: r["rank"] for r in scans.with_rank(df, ["g"], [F.desc("t"), "id"]).collect()} == {r.id: r["rank"] for r in want}
    up = Window.partitionBy("g").orderBy("t", "id")
    want = {r.id: (r.s or 0, r.b, r.c) for r in df.select("id", F.sum("v").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("v").over(up).alias("b"), F.lag("t").over(up).alias("c")).collect()}
    placed = scans.chunks(df, ["g"], ["t", "id"])
    got = scans.with_sum(scans.with_previous(placed, ["g"], {"b": "v", "c": "t"}), ["g"], F.col("v"), "s")
    assert {r.id: (r.s, r.b, r.c) for r in got.collect()} == want
    assert scans.with_rank(df.limit(0), ["g"], ["t"]).count() == 0
    # equal rows of a hot group lie in many chunks
    same = spark.createDataFrame([("hot", 1)] * 5000, "g string, t int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranks = scans.with_rank(same, ["g"], ["t"])
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(1, 5001))
    assert scans.chunks(same, ["g"], ["t"]).groupBy("chunk").count().count() > 2
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_links_of_a_start_are_one_for_each_node(spark):
    """Rounds of joins carry at most a link for each node that a task holds, not all links."""
    rng = random.Random(11)
    pairs = [(f"a{k}{rng.randint(0, 40):02}", f"b{k}{rng.randint(0, 40):02}") for k in range(5) for _ in range(2000)] + [("z", "z"), ("b000", "b100")]
    links = edges_of(spark, pairs).repartition(3)
    want: dict = {}
    for x, near in reach(pairs + [(b, a) for a, b in pairs]).items():
        want[x] = min(near)
    want.pop("z")
    for few in (50, orders.FEW_OF_COMPONENT):
        assert {r.id: r.component for r in orders.weak_components(links, few).collect()} == want
    rows, n = shuffled(spark, lambda: orders.weak_components(links))
    assert len(rows) == len(want) and n < 14_000  # 10,000 links once
