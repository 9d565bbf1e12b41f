"""Nearest neighbours of a set of query vectors among all rows: exactly, in blocks, and by an index of inverted lists.

Both ways end in the same step: a block of rows meets a block of queries in one task, as a matrix product of which each query's k best
go on. The exact way cuts both sides into blocks by hashes of their ids and brings every pair of blocks together once; nothing is
collected or broadcast. The index puts every row into the cell of its nearest centroid; a query looks into its nearest cells only. Cells with
many rows are cut into blocks, so a cell with a third of all rows is many tasks.

The centroids are fitted in one task on about SAMPLE rows, chosen by a hash of the id (a documented bound); every row is indexed. The number of
cells to look into is set there too: the least that finds TARGET of the true k best among the sample. At most CELLS centroids go to the driver
and to the tasks, a bound of CELLS * 8 bytes for each dimension.

Vectors are unit vectors. Null ids and vectors: such rows are left out. Ties: the smaller id first. Equal vectors: each row counts. Empty
tables: empty results. Ids are told apart by value; queries that repeat an id are one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import cut

ROWS, QUERIES = 16384, 4096
SAMPLE, CELLS, TARGET, K = 20_000, 1024, 0.97, 10


@dataclass
class Index:
    """centroids: a row each; blocks: of each cell; probes: cells to look into; table: cell, block, id, vector."""

    centroids: np.ndarray
    blocks: np.ndarray
    probes: int
    table: DataFrame

    def without(self, ids: DataFrame) -> Index:
        """The index without some rows (id)."""
        return Index(self.centroids, self.blocks, self.probes, self.table.join(ids.select("id"), "id", "left_anti"))

    def with_rows(self, vectors: DataFrame) -> Index:
        """The index with more rows (id, vector), in place of those of the same ids. The centroids stay."""
        if not len(self.centroids):
            return build(vectors)
        new = _in_cells(_clean(vectors), self.centroids)
        placed = _in_blocks(new, self.blocks)
        old = self.without(vectors).table
        return Index(self.centroids, self.blocks, self.probes, cut(old.unionByName(placed.select(*old.columns)), "index", by="cell"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _clean(vectors: DataFrame) -> DataFrame:
    return vectors.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))


def _best(left: DataFrame, right: DataFrame, keys: list[str], k: int, least: float) -> DataFrame:
    """left_id, right_id, score: the k best of right for each row of left, among those with equal keys. Both: keys, id, vector."""

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out = ([], [], [])
        if ours.num_rows and theirs.num_rows:
            theirs = theirs.sort_by("id")
            scores = matrix(ours.column("vector")) @ matrix(theirs.column("vector")).T
            for q, row in enumerate(scores):
                good = np.flatnonzero(row >= least)
                if len(good) > k:  # all that reach the k-th best score, in order of id
                    good = good[row[good] >= np.partition(row[good], len(good) - k)[len(good) - k]]
                good = good[np.argsort(-row[good], kind="stable")][:k]
                out[0].append(np.full(len(good), q))
                out[1].append(good)
                out[2].append(row[good])
        a, b, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.table({"left_id": ours.column("id").take(pa.array(a, pa.int64())), "right_id": theirs.column("id").take(pa.array(b, pa.int64())), "score": pa.array(s, pa.float64())})

    kinds = [d.schema["id"].dataType.simpleString() for d in (left, right)]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"left_id {kinds[0]}, right_id {kinds[1]}, score double")
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _part(salt: int, n: int):
    return F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")


def _every(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def exact(left: DataFrame, right: DataFrame, k: int, least: float) -> DataFrame:
    """left_id, right_id, score: for each of left(id, vector) the k most similar of right(id, vector), at least `least`."""
    left, right = _clean(left), _clean(right)
    parts, blocks = -(-left.count() // QUERIES) or 1, -(-right.count() // ROWS) or 1
    ours = left.withColumn("part", _part(1, parts)).withColumn("block", _every(blocks))
    theirs = right.withColumn("block", _part(2, blocks)).withColumn("part", _every(parts))
    return _best(ours, theirs, ["block", "part"], k, least)


def _fit(table: pa.Table, cells: int, rounds: int = 12, queries: int = 200) -> pa.Table:
    """One row: centroids (rows of doubles, end to end) and probes, from a sample. Means of cells, scaled to length one; an empty cell takes the
    row that is farthest from its own."""
    data = matrix(table.sort_by("id").column("vector"))
    pick = np.random.default_rng(11).permutation(len(data))
    centres = data[pick[: min(cells, len(data))]].copy()
    for _ in range(rounds):
        likeness = data @ centres.T
        own = likeness.argmax(1)
        far = iter(np.argsort(likeness.max(1)))
        for c in range(len(centres)):
            rows = data[own == c]
            mean = rows.sum(0) if len(rows) else data[next(far)]
            centres[c] = mean / (np.linalg.norm(mean) or 1.0)
    own = (data @ centres.T).argmax(1)
    asked = data[pick[:queries]]
    # the place of each true neighbour's cell in a query's order of cells: probes are the quantile that finds enough of them
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    true = np.argsort(-(asked @ data.T), axis=1)[:, : K + 1]
    places = np.sort(np.take_along_axis(order, own[true], axis=1).ravel())
    probes = int(places[min(len(places) - 1, int(np.ceil(TARGET * len(places))) - 1)]) + 1
    return pa.table({"centroids": pa.array([centres.ravel().tolist()], pa.list_(pa.float64())), "cells": pa.array([len(centres)], pa.int32()), "probes": pa.array([probes], pa.int32())})


def _in_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, vector, cell."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema["id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                cell = (matrix(batch.column(1)) @ shared.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["id", "vector", "cell"])

    return vectors.select("id", "vector").mapInArrow(place, f"id {kind}, vector array<double>, cell int")


def _in_blocks(placed: DataFrame, blocks: np.ndarray) -> DataFrame:
    """With the block of each row, of as many as its cell has."""
    many = F.get(F.array(*map(F.lit, blocks.tolist())), F.col("cell"))
    return placed.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "id"), many).cast("int"))


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of vectors(id, vector), with a table in the shared folder."""
    vectors = _clean(vectors)
    n = vectors.count()
    cells = cells or int(min(CELLS, max(1, round(min(n, sample) ** 0.5))))
    some = vectors if n <= sample else vectors.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    fitted = some.groupBy().applyInArrow(lambda t: _fit(t, cells), "centroids array<double>, cells int, probes int").first()
    if fitted is None:
        return Index(np.zeros((0, 0)), np.ones(0, np.int64), 1, vectors.limit(0).select(F.lit(0).alias("cell"), F.lit(0).alias("block"), "id", "vector"))
    centroids = np.array(fitted["centroids"]).reshape(fitted["cells"], -1)
    placed = cut(_in_cells(vectors, centroids), "in_cells")
    blocks = np.ones(len(centroids), np.int64)
    for r in placed.groupBy("cell").count().toLocalIterator():  # at most CELLS rows
        blocks[r["cell"]] = -(-r["count"] // ROWS)
    table = _in_blocks(placed, blocks).select("cell", "block", "id", "vector").repartition("cell", "block")
    return Index(centroids, blocks, fitted["probes"], cut(table, "index", by="cell"))


def search(index: Index, queries: DataFrame, k: int = K, least: float = -1.0, probes: int | None = None) -> DataFrame:
    """left_id, right_id, score: for each of queries(id, vector) the k best rows of its nearest cells."""
    queries = _clean(queries).dropDuplicates(["id"])
    queries = queries if len(index.centroids) else queries.limit(0)
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.blocks))
    look, kind = min(probes or index.probes, len(index.centroids)), queries.schema["id"].dataType.simpleString()
    parts = -(-queries.count() // (QUERIES * 16)) or 1

    def ask(batches):
        centres, blocks = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            likeness = matrix(batch.column(1)) @ centres.T
            near = np.argpartition(-likeness, look - 1, axis=1)[:, :look].ravel()
            row = np.repeat(np.arange(batch.num_rows), look)
            many = blocks[near]
            row, cell = np.repeat(row, many), np.repeat(near, many)
            block = np.arange(len(cell)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(block, pa.int32())], ["id", "vector", "cell", "block"])

    asked = queries.mapInArrow(ask, f"id {kind}, vector array<double>, cell int, block int").withColumn("part", _part(1, parts))
    return _best(asked, index.table.withColumn("part", _every(parts)), ["cell", "block", "part"], k, least)


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true pairs (left_id, right_id) that were found."""
    pairs = true.select("left_id", "right_id").distinct()
    hits = pairs.join(found.select("left_id", "right_id").distinct(), ["left_id", "right_id"], "left_semi").count()
    return hits / max(pairs.count(), 1)
