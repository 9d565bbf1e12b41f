"""Power iteration over more pairs of neighbours than one task takes. Nodes are dealt to parts and numbered within them; a part's scores
are one array, its pairs another, sorted by where they lead. A round sends sums from part to part as arrays, not rows; pairs stay where they are."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import cut, forget

#: Pairs of a part, about.
PART = 1 << 20


def _number(table: pa.Table) -> pa.Table:
    return table.append_column("i", pa.array(np.arange(table.num_rows, dtype=np.int32)))


def _pack(table: pa.Table) -> pa.Table:
    """A part's pairs in one row: starts i and weights n, in the order of ends; where each end's pairs begin; ends j, by part q."""
    i, q, j, n = (table.column(c).to_numpy() for c in ("i", "q", "j", "n"))
    order = np.lexsort((j, q))
    i, q, j, n = i[order], q[order], j[order], n[order]
    first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (j[1:] != j[:-1])))
    blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    return pa.table({"p": table.column("p").slice(0, 1), "i": blob(i, np.int32), "n": blob(n, np.float64), "first": blob(first, np.int64), "q": blob(q[first], np.int32), "j": blob(j[first], np.int32)})


def _tell(top: float):
    """What each part hands to others: p (whom), j, got."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                i, q, j = (np.frombuffer(row[c], np.int32) for c in ("i", "q", "j"))
                x = np.frombuffer(row["x"]) / top
                got = np.add.reduceat(x[i] * np.frombuffer(row["n"]), np.frombuffer(row["first"], np.int64))
                at = np.append(np.flatnonzero(np.append(True, q[1:] != q[:-1])), len(q))
                cuts = list(zip(at[:-1], at[1:]))
                yield pa.RecordBatch.from_pydict({"p": pa.array(q[at[:-1]]), "j": pa.array([j[a:b].tobytes() for a, b in cuts], pa.binary()), "got": pa.array([got[a:b].tobytes() for a, b in cuts], pa.binary())})

    return run


def _gather(top: float):
    def run(told: pa.Table, own: pa.Table) -> pa.Table:
        old = np.frombuffer(own.column("x")[0].as_py()) / top
        x = old.copy()
        for j, got in zip(told.column("j"), told.column("got")):
            x[np.frombuffer(j.as_py(), np.int32)] += np.frombuffer(got.as_py())
        return pa.table({"p": own.column("p"), "x": pa.array([x.tobytes()], pa.binary()), "old": pa.array([old.tobytes()], pa.binary()), "top": pa.array([x.max()])})

    return run


def _moved(top: float):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"moved": pa.array([np.abs(np.frombuffer(x.as_py()) / top - np.frombuffer(old.as_py())).max() for x, old in zip(batch.column("x"), batch.column("old"))], pa.float64())})

    return run


def _ones(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"p": batch.column("p"), "x": pa.array([np.ones(m).tobytes() for m in batch.column("m").to_pylist()], pa.binary())})


def _named(top: float):
    def run(ids: pa.Table, own: pa.Table) -> pa.Table:
        x = np.frombuffer(own.column("x")[0].as_py()) / top
        return pa.table({"id": ids.column("id"), "centrality": x[ids.column("i").to_numpy()]})

    return run


def iterate(pairs: DataFrame, rounds: int, tolerance: float, part: int = PART) -> DataFrame:
    """id, centrality: power iteration of A + I over pairs (id, to_id, n; either way), scaled by the largest value each round, until none moves
    by tolerance. A task holds one part's pairs; the largest value and change of a round go to the driver."""
    parts = ceil(pairs.count() / part)
    ids = pairs.select("id").distinct().withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    numbered = cut(ids.groupBy("p").applyInArrow(_number, "id string, p int, i int"), "numbered")
    known = pairs.join(numbered, "id").join(numbered.select(F.col("id").alias("to_id"), F.col("p").alias("q"), F.col("i").alias("j")), "to_id").select("p", "i", "q", "j", "n")
    packed = known.groupBy("p").applyInArrow(_pack, "p int, i binary, n binary, first binary, q binary, j binary")
    step = packed.repartition(parts, "p").persist()
    score, top = cut(numbered.groupBy("p").agg(F.count("*").alias("m")).mapInArrow(_ones, "p int, x binary"), "centrality"), 1.0
    for _ in range(rounds):
        told = step.join(score.select("p", "x").repartition(parts, "p"), "p").mapInArrow(_tell(top), "p int, j binary, got binary")
        new = cut(told.groupBy("p").cogroup(score.groupBy("p")).applyInArrow(_gather(top), "p int, x binary, old binary, top double"), "centrality")
        top = new.agg(F.max("top")).first()[0]
        moved = new.mapInArrow(_moved(top), "moved double").agg(F.max("moved")).first()[0]
        forget(score)
        score = new
        if moved < tolerance:
            break
    step.unpersist()
    return numbered.groupBy("p").cogroup(score.groupBy("p")).applyInArrow(_named(top), "id string, centrality double")
