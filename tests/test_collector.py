"""The bounded collector as a stream against one-by-one rings, and interval sums against pairs."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from grafonda.operators import resolve, rules
from grafonda.streaming import collector

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def rows_of(seed, n=600):
    rng = random.Random(seed)
    at = 0.0
    out = []
    for k in range(n):
        at += rng.choice([0.001, 0.001, 0.002, 0.4])
        out.append((k, rng.choice(["hot", "hot", "hot", "cold", None]), START + timedelta(seconds=at)))
    return out


def by_hand(rows, capacity, seconds):
    """source: flushes (interval, kind, ids) and counters of one ring each, with plain lists."""
    out = defaultdict(list)
    held, now, early, counts = defaultdict(list), {}, {}, defaultdict(lambda: [0, 0, 0])
    for k, source, at in sorted(rows, key=lambda r: (r[2], r[0])):
        interval = int(at.timestamp() * 1000) // (1000 * seconds)
        if interval != now.get(source):
            if held[source]:
                out[source].append((now[source], "timer", held[source]))
            held[source], now[source], early[source] = [], interval, False
        c = counts[source]
        c[0] += 1
        held[source] = [*held[source], k]
        if len(held[source]) > capacity:
            held[source] = held[source][1:]
            c[1] += 1
        c[2] = max(c[2], len(held[source]))
        if len(held[source]) >= 0.8 * capacity and not early[source]:
            out[source].append((interval, "early", held[source]))
            held[source], early[source] = [], True
    for source, rest in held.items():
        if rest:
            out[source].append((now[source], "timer", rest))
    return out, counts


def listed(flushes):
    out = defaultdict(list)
    for r in flushes.orderBy("enqueued").collect():
        out[r.source].append((r.interval, r.kind, list(r.ids)))
    return out


def test_rings_of_a_table(spark):
    rows = rows_of(1)
    got = collector.collected(spark.createDataFrame(rows, "id long, source string, at timestamp"), "source", "id", "at", capacity=10, seconds=5)
    want, counts = by_hand(rows, 10, 5)
    assert listed(got) == want
    rates = {r.source: [r.enqueued, r.dropped, r.high_water] for r in collector.drop_rates(got).collect()}
    assert rates == dict(counts) and sum(c[1] for c in counts.values()) > 50


def test_a_stream_flushes_alike_and_counts_late_rows(spark, tmp_path):
    rows = rows_of(2)
    tail = [(9000, "end", START + timedelta(hours=3))]  # moves the watermark, so that timers fire
    late = (8000, "hot", rows[300][2])
    parts = [rows[:200], rows[200:450], [*rows[450:], late], tail, [(9001, "end", START + timedelta(hours=4))]]
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = collector.collected(spark.readStream.schema("id long, source string, at timestamp").option("maxFilesPerTrigger", 1).parquet(source), "source", "id", "at", capacity=10, seconds=5, late="1 hour")
    for k, part in enumerate(parts):  # a run for each part, all on one checkpoint
        spark.createDataFrame(part, "id long, source string, at timestamp").coalesce(1).write.mode("append").parquet(source)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    got = spark.read.schema(collector._OUT).parquet(str(tmp_path / "out"))
    assert all(n <= 10 for (n,) in got.select("n").collect())
    want, counts = by_hand(rows, 10, 5)
    assert listed(got.where("source = 'cold'"))["cold"] == want["cold"]
    hot = {r.source: r for r in collector.drop_rates(got).collect()}["hot"]
    assert hot.enqueued == counts["hot"][0] + 1 and hot.late == 1 and hot.dropped >= counts["hot"][1] > 0 and hot.high_water == 10
    kept = [k for r in got.where("source = 'hot'").collect() for k in r.ids]
    assert len(kept) == len(set(kept)) == hot.enqueued - hot.dropped


def test_shards_of_a_hot_source(spark):
    rows = rows_of(3, 300)
    got = collector.collected(spark.createDataFrame(rows, "id long, source string, at timestamp"), "source", "id", "at", capacity=1000, shards=4)
    assert got.where("source = 'hot'").select("shard").distinct().count() == 4
    assert sorted(k for r in got.collect() for k in r.ids) == [r[0] for r in rows]
    assert collector.collected(spark.createDataFrame([], "id long, source string, at timestamp"), "source", "id", "at").count() == 0


def test_coverage_by_running_sums(spark):
    rng = random.Random(4)
    blocks = [(rng.choice("fg"), a := rng.randint(1, 900), a + rng.choice([0, 3, 400]), rng.randint(1, 5), rng.randint(0, 2)) for _ in range(300)]
    spots = [(f"e{k}", rng.choice("fgh"), a := rng.randint(1, 1000), a + rng.choice([0, 5, 300])) for k in range(80)]
    got = {r.id: r.covered_pct for r in resolve.coverage(spark.createDataFrame(blocks, "file string, start int, end int, statements int, count int"), spark.createDataFrame(spots, "id string, file string, first int, last int")).collect()}
    want = {}
    for e, f, first, last in spots:
        near = [b for b in blocks if b[0] == f and b[2] >= first and b[1] <= last]
        if near:
            want[e] = round(100 * sum(b[3] for b in near if b[4]) / sum(b[3] for b in near), 2)
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 0.011 for e in want)


def test_globs(spark):
    globs = [("*.go", "a/b/x.go"), ("*/db/*", "src/db/x.go"), ("b/*.go", "a/b/x.go"), ("*/db/*", "db/x.go"), ("a.c", "abc"), ("x?z", "xyz"), ("[ab].go", "q/b.go"), ("a*b", "a/b"), ("(x)+$", "(x)+$")]
    df = spark.createDataFrame(globs, "glob string, path string")
    got = [r[0] for r in df.withColumn("p", rules.glob_pattern(F.col("glob"))).selectExpr("rlike(path, p)").collect()]
    assert got == [True, True, True, False, False, True, True, False, True]
