"""What operators shuffle grows with their input, not with its pairs; results against plain Python."""

import contextlib
import random
from itertools import combinations

from pyspark.sql import functions as F

from grafonda.functions import words
from grafonda.operators import alike, carves, coordination, graph, knowledge, links, memory, model, orders, paths, power, rules, search, store, telemetry, work


@contextlib.contextmanager
def held(spark, **conf):
    """Settings of spark.sql for a while."""
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k.replace('_', '.')}", v)
    yield
    for k in conf:
        spark.conf.unset(f"spark.sql.{k.replace('_', '.')}")


def shuffled(spark, run):
    """(rows of run(), rows that its stages wrote to shuffles)."""
    sc = spark.sparkContext

    def stages():
        each = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()).iterator()
        found = {}
        while each.hasNext():
            s = each.next()
            found[s.stageId()] = s.shuffleWriteRecords()
        return found

    before = stages()
    with held(spark, autoBroadcastJoinThreshold="-1"):
        rows = run().collect()
    return rows, sum(n for k, n in stages().items() if k not in before)


def test_overlaps_of_a_common_file(spark):
    rng = random.Random(5)
    work = {f"s{k:03}": ({f"f{rng.randint(0, 2)}" for _ in range(2)} if k % 3 else set(), {f"e{rng.randint(0, 9)}" for _ in range(3)}) for k in range(400)}
    df = spark.createDataFrame([(s, sorted(f), sorted(e)) for s, (f, e) in work.items()], "session_id string, files array<string>, entities array<string>").repartition(4)
    want = {}
    for a, b in combinations(sorted(work), 2):
        shared = [sorted(work[a][k] & work[b][k]) for k in (0, 1)]
        level = 0 if shared[0] else 1
        if shared[level]:
            want[a, b] = (level, ",".join(shared[level][:3]))
    rows, n = shuffled(spark, lambda: coordination.overlaps(df))
    assert len(rows) == len(want) and {(r.a, r.b): (r.level, r.shared) for r in rows} == want
    assert n < 20_000 < len(want)
    assert {tuple(r) for r in coordination._meeting(df, "files", 7).select("a", "b", "x").collect()} == {(a, b, x) for a, b in combinations(sorted(work), 2) for x in work[a][0] & work[b][0]}


def test_targets_of_a_name_that_a_package_has_many_times(spark):
    nodes = spark.createDataFrame([(f"n{k:03}", "p", "run") for k in range(300)] + [("m1", "p", "A.run"), ("m0", "q", "run")], "id string, package string, name string")
    sites = spark.createDataFrame([(f"s{k}", "p", "run") for k in range(300)] + [("s0", "q", "run"), ("t", "q", "run"), ("u", "q", "gone")], "site string, package string, func string")
    rows, n = shuffled(spark, lambda: links.package_targets(sites, nodes))
    assert {r.site: r.to_id for r in rows} == {f"s{k}": "m1" for k in range(300)} | {"t": "m0"}
    plan = links.package_targets(sites, nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert n < 3_000 and plan.index("Join") < plan.rindex("Aggregate")  # names are told apart below the join


def test_wedges_that_nothing_closes(spark):
    rng = random.Random(3)
    tops = [f"t{k:02}" for k in range(60)]
    pairs = {(f"m{k:03}", t) for k in range(120) for t in rng.sample(tops, 20)} | {("t00", "t01"), ("t05", "t06"), ("m000", "m001"), ("m001", "m000"), ("t09", "t09")}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {(a, b): len(near[a] & near[b]) for a in near for b in near[a] if a < b and near[a] & near[b]}
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in sorted(pairs)], "from_id string, to_id string, type string")
    rows, n = shuffled(spark, lambda: paths.common_neighbours(edges))
    assert {(r.a, r.b): r.common for r in rows} == want
    wedges = sum(len(x) * (len(x) - 1) // 2 for k, x in near.items() if k[0] == "m")
    assert wedges > 22_000 and n < 30_000


def test_a_large_file_is_saved_by_several_tasks(spark, tmp_path):
    nodes = spark.range(0, 40_000, 1, 8).select(F.sha1(F.col("id").cast("string")).alias("id"), F.lit("function").alias("type"), F.lit("one.tbl").alias("file"))
    edges = nodes.limit(3).select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("CALLS").alias("type"))
    with held(spark, adaptive_advisoryPartitionSizeInBytes="200k"):
        store.save_graph(nodes, edges, f"file://{tmp_path}/g")
    assert len(list((tmp_path / "g" / "nodes").glob("bucket=*/*.parquet"))) > 2
    assert store.load_graph(spark, f"file://{tmp_path}/g")[0].select("id").distinct().count() == 40_000


def test_pairs_of_a_path_are_made_for_its_ends_only(spark):
    nodes = spark.createDataFrame([(f"s{k:02}", "s") for k in range(40)] + [("mid", "m")] + [(f"e{k:03}", "e" if k < 2 else "x") for k in range(300)], "id string, type string")
    edges = spark.createDataFrame([(f"s{k:02}", "mid", "A") for k in range(40)] + [("mid", f"e{k:03}", "B") for k in range(300)], "from_id string, to_id string, type string")
    rows, n = shuffled(spark, lambda: graph.path_pattern(nodes, edges, ["A", "B"], F.col("type") == "s", F.col("type") == "e"))
    assert {tuple(r) for r in rows} == {(f"s{k:02}", f"e{j:03}") for k in range(40) for j in range(2)}
    assert n < 2_000  # 12,000 pairs without the ends
    assert {tuple(r) for r in graph.path_pattern(nodes, edges, [], F.col("type") == "s", F.col("id") == "s03").select("start_id", "end_id").collect()} == {("s03", "s03")}


def test_edges_that_no_rule_fits_are_not_shuffled_twice(spark):
    nodes = spark.createDataFrame([(f"a{k:03}", "f" if k < 5 else "g", "P", f"d/{k}.go", f"n{k}") for k in range(500)], "id string, type string, package string, file string, name string")
    edges = spark.createDataFrame([(f"a{k:03}", f"a{(k * j) % 500:03}", "CALLS") for k in range(500) for j in range(20)], "from_id string, to_id string, type string")
    found = spark.createDataFrame([("r", "error", "f", "g", "CALLS", "", ""), ("r", "error", "f", "", "", "", "p"), ("none", "error", "", "", "", "", ""), ("q", "error", "f", "", "OTHER", "", "")], rules.SCHEMA)
    rows, n = shuffled(spark, lambda: rules.violations(nodes, edges, found))
    want = [("r", f"a{k:03}", f"a{(k * j) % 500:03}") for k in range(5) for j in range(20) for m in range(2) if m or (k * j) % 500 >= 5]
    assert sorted((r.rule_id, r.from_id, r.to_id) for r in rows) == sorted(want)
    assert n < 15_000  # 10,000 edges once
    many, rules.MANY = rules.MANY, 1
    assert sorted((r.rule_id, r.from_id, r.to_id) for r in rules.violations(nodes, edges, found).collect()) == sorted(want)
    rules.MANY = many


def test_many_nodes_that_fit_a_rule_are_not_broadcast(spark, monkeypatch):
    nodes = spark.range(3000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit("f").alias("type"), F.lit("p").alias("package"), F.lit("x").alias("file"), F.lit("y").alias("name"))
    edges = nodes.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("CALLS").alias("type"))
    found = spark.createDataFrame([("r", "error", "f", "f", "", "", "")], rules.SCHEMA)
    monkeypatch.setattr(rules, "FEW_NODES", 100)
    got = rules.violations(nodes, edges, found)
    assert got.count() == 3000
    assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2


def test_alike_sets_of_common_words_meet_at_no_word(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    sets = {f"m{k:03}": set(rng.sample(words, rng.choice((1, 5, 40, 60, 90, 200)))) for k in range(300)}
    for k in range(0, 300, 10):  # near ones, some of them about at the threshold
        sets[f"n{k:03}"] = {w for w in sets[f"m{k:03}"] if rng.random() < 0.5 + k / 600} | {"x"}
    sets["p"] = set(sets["m000"])
    tier = {k: None if k == "m010" else "ab"[int(k[1:] or 0) % 20 == 3] for k in sets}
    df = spark.createDataFrame([(k, tier[k], "e", " ".join(sorted(w))) for k, w in sets.items()], "id string, tier string, entity_id string, content string").repartition(4)
    copies: dict = {}
    for k in sorted(sets):
        copies.setdefault((tier[k] or "", frozenset(sets[k])), []).append(k)
    classes, n = {x[0]: w for (_, w), x in copies.items()}, {x[0]: len(x) for x in copies.values()}
    likeness = {(a, b): len(classes[a] & classes[b]) / len(classes[a] | classes[b]) for a, b in combinations(sorted(classes), 2) if tier[a] is not None and tier[a] == tier[b]}
    want = {(a, b, n[a], n[b]) for (a, b), x in likeness.items() if x > 0.5} | {(a, a, k, k) for a, k in n.items() if k > 1}
    assert len(want) > 10
    rows, moved = shuffled(spark, lambda: memory.duplicates(df, 0.5))
    assert {(r.a, r.b, r.n_a, r.n_b) for r in rows} == want and len(rows) == len(want)
    assert moved < 3_000
    monkeypatch.setattr(alike, "TILE", 7)
    grouped = df.where(F.col("id").isin(*classes)).select("id", "tier", "entity_id", F.split("content", " ").alias("words"))
    for least in (0.3, 0.5, 0.9):
        met = [(min(r), max(r)) for r in alike.candidates(grouped, ["tier", "entity_id"], "words", least, block=20).collect()]
        assert len(met) == len(set(met)) < len(likeness) and {k for k, x in likeness.items() if x >= least} <= set(met)


def test_rounds_of_centrality_do_not_shuffle_pairs(spark, monkeypatch):
    rng = random.Random(11)
    pairs = {(f"n{rng.randint(0, 199)}", f"n{int(200 * rng.random() ** 2)}") for _ in range(2500)}
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in sorted(pairs)], "from_id string, to_id string, type string")
    whole = {r.id: r.centrality for r in graph.eigenvector_centrality(edges, rounds=6, tolerance=0.0).collect()}
    monkeypatch.setattr(power.iterate, "__defaults__", (700,))
    _, few = shuffled(spark, lambda: graph.eigenvector_centrality(edges, rounds=2, tolerance=0.0, few=0))
    rows, more = shuffled(spark, lambda: graph.eigenvector_centrality(edges, rounds=6, tolerance=0.0, few=0))
    assert len(rows) == len(whole) and all(abs(whole[r.id] - r.centrality) < 1e-9 for r in rows)
    assert more - few < 4 * 300  # messages between parts, not sums for each node


def test_flows_that_lead_to_no_sink_are_not_followed(spark):
    pairs = [(f"s{k:02}", f"a{j:02}") for k in range(40) for j in range(40)] + [(f"a{j:02}", f"b{j % 20:02}") for j in range(40)] + [("b00", "sink"), ("sink", "b00"), ("s03", "sink"), ("s04", "b00"), ("b03", "c"), ("c", "far")]
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs] + [("s01", "b00", "OTHER")], "from_id string, to_id string, type string")
    sources = spark.createDataFrame([(f"s{k:02}",) for k in range(40)], "id string")
    sinks = spark.createDataFrame([("sink",), ("far",), ("gone",)], "id string")
    step = {}
    for a, b in pairs:
        step.setdefault(a, set()).add(b)
    want = set()
    for k in range(40):
        seen, front = {f"s{k:02}"}, {f"s{k:02}"}
        for hop in range(1, 5):
            front = {y for x in front for y in step.get(x, ())} - seen
            seen |= front
            want |= {(f"s{k:02}", x, hop) for x in front if x in ("sink", "far")}
    rows, n = shuffled(spark, lambda: graph.data_flows(edges, sources, sinks, 4))
    assert {tuple(r) for r in rows} == want and {h for *_, h in want} == {1, 2, 3, 4}
    assert n < 17_000  # 20,832 while every pair went on


def test_steps_far_from_all_roots_are_not_weighed(spark):
    nodes = spark.createDataFrame([("p", f"n{k:04}", "function", f"n{k}", "", "f", "code" if k % 3 else "") for k in range(2000)], "project string, id string, type string, name string, package string, file string, domain string")
    edges = spark.createDataFrame([("p", f"n{k:04}", f"n{(k + j) % 2000:04}", "CALLS") for k in range(2000) for j in (1, 2)], "project string, from_id string, to_id string, type string")
    roots = spark.createDataFrame([("p", "n0000"), ("p", "n1000")], "project string, root string")
    rows, n = shuffled(spark, lambda: carves.spread(nodes, edges, roots, 1))
    assert {(r.root, r.id) for r in rows} == {(f"n{k:04}", f"n{(k + j) % 2000:04}") for k in (0, 1000) for j in (-2, -1, 0, 1, 2)}
    _, whole = shuffled(spark, lambda: carves.walk_steps(nodes, edges))
    assert n < whole * 0.75
    near = carves.walk_steps(nodes, edges, of=roots.select("project", F.col("root").alias("id")))
    assert {tuple(r) for r in near.collect()} == {tuple(r) for r in carves.walk_steps(nodes, edges).collect() if r.from_id in ("n0000", "n1000")}


def test_nodes_of_a_name_meet_in_blocks_of_two_domains(spark, monkeypatch):
    domain = ("code", "infra", "docs", "other", "api")
    nodes = spark.createDataFrame([(f"n{k:03}", "Pay-Bill" if k % 7 else "PayBill" if k % 2 else "Rare", "struct" if k % 3 else "table", domain[min(k % 9, 3)] if k % 9 < 8 else None, f"d{k % 2}/f.go") for k in range(300)], "id string, name string, type string, domain string, file string")
    place = lambda r: links.DOMAIN_ORDER.get(r.domain, 9)
    held = [r for r in nodes.collect() if place(r) < 9]
    want = {(a.id, b.id) for a in held for b in held if a.name.replace("-", "").lower() == b.name.replace("-", "").lower() and place(a) < place(b)}
    monkeypatch.setattr(links, "BLOCK", 10)
    got = [(r.from_id, r.to_id) for r in links.cross_domain_mentions(nodes).collect()]
    assert set(got) == want and len(got) == len(want) > 1000
    plan = links.cross_domain_mentions(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "a_block" in plan and "b_place" in plan  # pairs of one domain are never made
    assert links.cross_domain_mentions(nodes).rdd.getNumPartitions() > 20  # nor all of a name's pairs in one task
    assert not links.cross_domain_mentions(nodes.limit(0)).count()


def test_cycles_of_small_pieces_are_broken_without_joins(spark):
    rng = random.Random(13)
    pairs = sorted({(f"{p:02}n{rng.randint(0, 19):02}", f"{p:02}n{rng.randint(0, 19):02}") for p in range(30) for _ in range(45)})
    edges = spark.createDataFrame(pairs, "from_id string, to_id string")
    whole = {tuple(r) for r in orders.acyclic(edges).collect()}
    rows, n = shuffled(spark, lambda: orders.acyclic(edges, few=200))
    assert {tuple(r) for r in rows} == whole and len(rows) == len(whole) < len(pairs) - 100
    assert not orders.strong_components(spark.createDataFrame(sorted(whole), "from_id string, to_id string")).count()
    assert n < 26_000  # 32,113 while components were joined to edges


def test_rounds_of_labels_compare_numbers(spark):
    rng = random.Random(17)
    pairs = sorted({(f"é{rng.randint(0, 30)}", f"n{rng.randint(0, 60)}") for _ in range(200)} | {(f"n{k}", f"n{k * 7 % 61}") for k in range(61)})
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], "from_id string, to_id string, type string")
    label = {x: x for x in near}
    for _ in range(3):
        votes = {x: [label[y] for y in near[x]] for x in near}
        label = {x: min(v, key=lambda c: (-v.count(c), c)) for x, v in votes.items()}
    got = graph.label_propagation(edges, 3)
    assert {tuple(r) for r in got.collect()} == set(label.items()) and got.count() == len(label)
    read = []
    plain, graph.cut = graph.cut, lambda df, name: read.append((name, dict(df.dtypes))) or plain(df, name)
    try:
        graph.label_propagation(edges, 2)
    finally:
        graph.cut = plain
    assert [t for name, t in read if name == "labels"] == [{"n": "bigint", "community": "bigint"}] * 2


def largest_task(spark, run):
    """Bytes of memory that the largest task of run() used for sorts and hash tables."""
    sc = spark.sparkContext
    store_ = sc._jsc.sc().statusStore()

    def stages():
        each = store_.stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()).iterator()
        return {s.stageId(): s.attemptId() for s in iter(lambda: each.next() if each.hasNext() else None, None)}

    before = stages()
    run()
    tasks = [t.taskMetrics() for k, attempt in stages().items() if k not in before for t in iter_java(store_.taskList(k, attempt, 10_000))]
    return max(m.get().peakExecutionMemory() for m in tasks if m.isDefined())


def iter_java(found):
    each = found.iterator()
    while each.hasNext():
        yield each.next()


def test_a_save_sorts_nothing(spark, tmp_path):
    edges = spark.range(200_000, numPartitions=2).selectExpr("concat('a', id) as from_id", "concat('b', id) as to_id", "concat('T', id % 3) as type")
    nodes = spark.range(60_000).selectExpr("concat('a', id) as id", "concat('f', id % 200) as file")
    path = str(tmp_path / "graph")
    spark.conf.set(store._WRITERS, "5")
    try:
        assert largest_task(spark, lambda: store.save_graph(nodes, edges, path)) < 4 << 20  # 13 MB (12,582,880 bytes) while rows were sorted by type
        assert spark.conf.get(store._WRITERS) == "5"
    finally:
        spark.conf.unset(store._WRITERS)
    n, e = store.load_graph(spark, path)
    assert e.select("from_id", "to_id", "type").exceptAll(edges).isEmpty() and e.count() == 200_000
    assert n.select("id", "file").exceptAll(nodes).isEmpty() and n.count() == 60_000


def test_edges_are_told_apart_in_tasks_of_a_size(spark):
    line = spark.range(20_000).selectExpr("id % 5000 as a", "id % 7 as b", "id as c")
    got = model._distinct(line, "a", "b", rows=1000)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1500 and sum(sizes) == line.select("a", "b").distinct().count()
    assert not got.exceptAll(line.select("a", "b").distinct()).count()
    assert model._distinct(line.limit(0), "a").count() == 0

def test_files_asked_about_meet_nodes_where_they_lie(spark):
    nodes = spark.range(20_000).selectExpr("'x' as type", "concat('f', id % 200) as file", "cast(id as int) as line", "concat('n', id) as name")
    rows, n = shuffled(spark, lambda: knowledge.file_context(nodes, spark.createDataFrame([("f7",), ("gone",)], "file string")))
    assert [tuple(r) for r in rows] == [("f7", ",".join(f"n{k}" for k in range(7, 20_000, 200)))]
    assert n < 100  # 20,000 while all nodes were shuffled


def test_texts_are_searched_once_for_names_and_signals(spark):
    text = "see `Big Cat`, \"the thing\"\nTokenBucket depends on RateCard, uses (GraphStore) and is used by tokenbucket.\nno signal here"
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(words.relation_signals(F.col("text")).alias("s"))
    got = [r.s and [tuple(x) for x in r.s] for r in df.collect()]
    assert got[0] == [("tokenbucket", "depends on", "ratecard"), ("ratecard", "uses", "graphstore"), ("graphstore", "used by", "tokenbucket")] and not got[1] and not got[2]
    assert str(df._jdf.queryExecution().analyzed()).count("regexp_extract_all") < 8  # more while each use of the names searched the text again
    few = work.spread(spark.range(1000, numPartitions=1), 100)
    assert [r["count"] for r in few.groupBy(F.spark_partition_id()).count().collect()] == [100] * 10


def test_a_delta_leaves_other_files_edges_where_they_are(spark, tmp_path):
    nodes = spark.range(2000).selectExpr("concat('n', id) as id", "concat('f', id % 50) as file")
    edges = spark.range(20_000).selectExpr("concat('n', id % 2000) as from_id", "concat('n', id * 7 % 1999) as to_id", "concat('T', id % 3) as type").distinct()
    path = str(tmp_path / "graph")
    store.save_graph(nodes, edges, path)
    own = nodes.where("file = 'f7' and id <> 'n7'")
    new = own.selectExpr("id as from_id", "'x' as to_id", "'T1' as type").unionByName(spark.createDataFrame([("n8", "y", "T0"), ("n8", "y", "T0"), (edges.where("from_id = 'n8'").first())], "from_id string, to_id string, type string"))
    n, e = store.with_file(nodes, edges, "f7", own, new)
    want = ({tuple(r) for r in n.select("id", "file").collect()}, {tuple(r) for r in e.collect()})
    before = len(want[1])
    _, moved = shuffled(spark, lambda: store.save_delta(spark, path, "f7", own, new) or spark.range(0))
    got = store.load_graph(spark, path)
    rows = [tuple(r) for r in got[1].select("from_id", "to_id", "type").collect()]
    assert set(rows) == want[1] and len(rows) == before and {tuple(r) for r in got[0].select("id", "file").collect()} == want[0]
    assert moved < 2000 < before


def test_texts_are_searched_for_words_once_for_all_weights(spark):
    docs = spark.createDataFrame([(1, "red ring red"), (2, "blue ring"), (3, "blue bolt")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "red ring red")], "item_id int, words string")
    got = search.tfidf_cosine(docs, "doc_id", "text", asked, "item_id", "words")
    assert [(r.doc_id, round(r.score, 6)) for r in sorted(got.collect(), key=lambda r: r["rank"])][0] == (1, 1.0) and got.count() == 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "words#" in plan and not [x for x in plan.splitlines() if "regexp_extract_all" in x and "text#" in x]


def test_deliveries_meet_the_last_correction_only(spark):
    """A scan in time: no delivery is held against all corrections of its entity."""
    from datetime import datetime, timedelta

    rng, start = random.Random(2), datetime(2024, 1, 1)
    at = lambda: start + timedelta(hours=rng.randint(0, 400))
    fixed = [(rng.choice(("a", "b", "c", None)), at(), rng.choice(("correction", "task_done"))) for _ in range(40)] + [("d", start, "correction"), ("e", None, "correction")]
    given = [(rng.choice(("a", "b", "c", "x", None)), at(), rng.choice(("click", "view", None))) for _ in range(300)] + [("d", start + timedelta(hours=h), "edge") for h in (0, 24, 25)] + [("d", None, "edge"), ("d", start - timedelta(hours=1), "edge")]
    want: dict = {}
    for e, t, name in given:
        if e and t and any(f == e and k == "correction" and u and u <= t <= u + timedelta(hours=24) for f, u, k in fixed):
            want[name] = want.get(name, 0) + 1
    cd, os = spark.createDataFrame(given, "entity string, created_at timestamp, tool_name string"), spark.createDataFrame(fixed, "entity string, created_at timestamp, signal_type string")
    got = telemetry.stale_deliveries(cd, os)
    assert {r.tool_name: r.stale for r in got.collect()} == want and want["edge"] == 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_sessions_that_hold_the_same_meet_as_one(spark, monkeypatch):
    held_by = [(["f1"], ["e1"]), (["f1", "f2"], ["e2"]), (["f3"], ["e1", "e2"]), ([], [])]
    work = {f"s{k:03}": held_by[k % 4] for k in range(300)}
    df = spark.createDataFrame([(s, f, e) for s, (f, e) in work.items()], "session_id string, files array<string>, entities array<string>").repartition(4)
    want = {}
    for a, b in combinations(sorted(work), 2):
        shared = [sorted(set(work[a][k]) & set(work[b][k])) for k in (0, 1)]
        if any(shared):
            want[a, b] = (int(not shared[0]), ",".join(shared[int(not shared[0])]))
    rows, n = shuffled(spark, lambda: coordination.overlaps(df))
    assert len(rows) == len(want) and {(r.a, r.b): (r.level, r.shared) for r in rows} == want
    assert n < 2_000
    monkeypatch.setattr(coordination, "NAMED", 10)
    rows = coordination._meeting(df, "entities", 30).select("a", "b", "x").collect()
    assert sorted(map(tuple, rows)) == sorted((a, b, x) for a, b in combinations(sorted(work), 2) for x in set(work[a][1]) & set(work[b][1]))


def test_ends_of_a_path_go_to_its_starts_as_lists(spark, monkeypatch):
    rng = random.Random(4)
    ahead = {f"m{k:02}": rng.sample(range(300), 100) for k in range(20)}
    nodes = spark.createDataFrame([(f"s{k:02}", "s") for k in range(40)] + [(m, "m") for m in ahead] + [(f"e{k:03}", "e" if k % 3 else "x") for k in range(300)], "id string, type string")
    edges = spark.createDataFrame([(f"s{k:02}", m, "A") for k in range(40) for m in ahead if k or m < "m05"] + [(m, f"e{k:03}", "B") for m, x in ahead.items() for k in x], "from_id string, to_id string, type string")
    want = {(f"s{k:02}", f"e{e:03}") for k in range(40) for m, x in ahead.items() for e in x if e % 3 and (k or m < "m05")}
    find = lambda: graph.path_pattern(nodes, edges, ["A", "B"], F.col("type") == "s", F.col("type") == "e")
    rows, n = shuffled(spark, find)
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert n < 12_000  # over 50,000 pairs lead over the middle
    monkeypatch.setattr(graph, "LISTED", 7)
    monkeypatch.setattr(graph, "TASK_PAIRS", 500)
    assert sorted(map(tuple, find().collect())) == sorted(want)


def test_rounds_of_labels_shuffle_what_is_heard_only(spark):
    rng = random.Random(9)
    pairs = {(f"n{rng.randint(0, 149):03}", f"n{rng.randint(0, 149):03}") for _ in range(1500)}
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {x: x for x in near}
    for _ in range(3):
        votes = {x: [label[y] for y in ys] for x, ys in near.items()}
        label = {x: min(set(v), key=lambda y: (-v.count(y), y)) for x, v in votes.items()}
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in sorted(pairs)], "from_id string, to_id string, type string")
    rows, n = shuffled(spark, lambda: graph.label_propagation(edges, 3))
    assert {r.id: r.community for r in rows} == label
    links = sum(map(len, near.values()))
    assert links > 2_500 and n < 18_000  # what is heard in two rounds; links themselves move once


def test_wedges_carry_numbers(spark, monkeypatch):
    """Ids of any length move twice with their edges, not with every wedge."""
    kinds = []
    kept = paths.cut
    monkeypatch.setattr(paths, "cut", lambda df, *x: kinds.append({t for _, t in df.dtypes}) or kept(df, *x))
    pairs = [("b", "a"), ("c", "b"), ("a", "c"), ("d", "a"), ("d", "c"), ("e", "e"), ("e", "d")]
    rows = paths.common_neighbours(spark.createDataFrame([(a * 99, b * 99, "CALLS") for a, b in pairs], "from_id string, to_id string, type string"))
    assert {(r.a[0], r.b[0], r.common) for r in rows.collect()} == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("a", "d", 1), ("c", "d", 1)}
    assert {len(r.a) for r in rows.collect()} == {99}
    assert kinds and all(k == {"bigint"} for k in kinds)
