"""Nearest neighbours in blocks against brute force; the index's recall, hot cells, added and removed rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grafonda.operators import nearest


def vectors_of(spark, data, first=0):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    return spark.createDataFrame([(first + k, x.tolist()) for k, x in enumerate(unit)], "id long, vector array<double>"), unit


def by_hand(left, right, k, least):
    out = {}
    for q, x in left.items():
        scores = sorted(((-float(x @ y), i) for i, y in right.items() if float(x @ y) >= least))[:k]
        out[q] = [i for _, i in scores]
    return out


def listed(found):
    out = {}
    for r in found.orderBy("left_id", F.desc("score"), "right_id").collect():
        out.setdefault(r.left_id, []).append(r.right_id)
    return out


def test_exact_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 50)
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rows, unit = vectors_of(spark, np.random.default_rng(1).normal(size=(230, 8)))
    rows = rows.unionByName(spark.createDataFrame([(None, [1.0] * 8), (900, None)], rows.schema))
    got = listed(nearest.exact(rows.where("id % 10 = 0"), rows, 5, 0.2))
    everything = dict(enumerate(unit))
    want = by_hand({k: v for k, v in everything.items() if k % 10 == 0}, everything, 5, 0.2)
    assert got == want
    assert nearest.exact(rows.limit(0), rows, 5, 0.2).count() == 0 and nearest.exact(rows, rows.limit(0), 5, 0.2).count() == 0


def test_index_recall_on_tables(spark):
    from grafonda.plans.link_queries import _vectors

    rows = _vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).select("id", "vector")
    asked = rows.where("id % 100 = 0")
    index = nearest.build(rows)
    assert index.table.count() == rows.count()
    got = nearest.search(index, asked)
    assert nearest.recall(got, nearest.exact(asked, rows, 10, -1.0)) >= 0.9


def test_hot_cells_added_and_removed_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 40)
    rng = np.random.default_rng(2)
    hot = np.concatenate((np.tile(rng.normal(size=(1, 6)), (200, 1)), rng.normal(size=(150, 6))))
    rows, unit = vectors_of(spark, hot)
    index = nearest.build(rows, cells=9)
    assert index.blocks.max() >= 5
    got = listed(nearest.search(index, rows.where("id in (0, 5, 300)"), 4, probes=9))
    assert got == by_hand({k: unit[k] for k in (0, 5, 300)}, dict(enumerate(unit)), 4, -1.0)
    more, other = vectors_of(spark, rng.normal(size=(20, 6)), first=340)
    index = index.with_rows(more).without(spark.createDataFrame([(0,), (1,)], "id long"))
    left = {k: v for k, v in enumerate(unit) if 1 < k < 340} | {340 + k: v for k, v in enumerate(other)}
    assert listed(nearest.search(index, more.where("id < 343"), 6, probes=9)) == by_hand({340 + k: other[k] for k in range(3)}, left, 6, -1.0)
    assert nearest.search(nearest.build(rows.limit(0)), rows).count() == 0


def test_probes_reach_the_target(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows, _ = vectors_of(spark, centres[rng.integers(0, 30, 3000)] + 0.25 * rng.normal(size=(3000, 16)))
    index = nearest.build(rows, sample=800)
    asked = rows.where("id % 100 = 0")
    assert index.probes < len(index.centroids)
    assert nearest.recall(nearest.search(index, asked), nearest.exact(asked, rows, 10, -1.0)) >= 0.9
