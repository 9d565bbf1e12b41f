"""Rankers of few candidates per query, and how well they do: mixes of BM25 and vectors, n-grams, clusters, and macro averages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def adaptive_b(n: Column) -> Column:
    """Length normalisation by the number of candidates: .75 up to seven, then rising to .95."""
    return 0.75 + 0.2 * F.greatest(F.lit(0.0), F.least((n - 7) / 8, F.lit(1.0)))


def ranked_bm25(pairs: DataFrame, adaptive: bool = False, k1: float = 1.5) -> DataFrame:
    """query_id, id, bm25 of pairs(query_id, query, id, text): each query ranks its own candidates; statistics are those of the candidates."""
    terms = pairs.select("query_id", "id", scalars.ir_tokens(F.col("query")).alias("q"), scalars.ir_tokens(F.col("text")).alias("t"))
    size = Window.partitionBy("query_id")
    sized = terms.withColumns({"n": F.count("*").over(size), "avgdl": F.greatest(F.avg(F.size("t")).over(size), F.lit(1.0)), "length": F.size("t")})
    b = adaptive_b(F.col("n")) if adaptive else F.lit(0.75)
    each = sized.withColumn("b", b).select("query_id", "id", "n", "avgdl", "length", "b", "t", F.explode_outer("q").alias("term"))
    counted = each.withColumn("tf", F.size(F.filter("t", lambda x: x == F.col("term")))).drop("t")
    df = F.size(F.collect_set(F.when(F.col("tf") > 0, F.col("id"))).over(Window.partitionBy("query_id", "term")))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - F.col("b") + F.col("b") * F.col("length") / F.col("avgdl")))
    return counted.withColumn("df", df).groupBy("query_id", "id").agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("bm25"))


def scaled(scores: DataFrame, column: str) -> Column:
    """A score over the largest of its query, 0 where that is 0 or the score is no number."""
    clean = F.when(F.isnan(column) | (F.abs(F.col(column)) == float("inf")), 0.0).otherwise(F.col(column))
    top = F.max(clean).over(Window.partitionBy("query_id"))
    return F.when(top > 0, clean / top).otherwise(0.0)


def mixed(scores: DataFrame, first: str, second: str, alpha: Column | None = None, bonus: float = 0.0) -> DataFrame:
    """query_id, id, score: alpha of one scaled score and the rest of another; by default .4, or .7 with over ten candidates. bonus: for the
    first candidate, falling to 0 for the last."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("id")) - 1
    a = F.when(n > 10, 0.7).otherwise(0.4) if alpha is None else alpha
    value = a * scaled(scores, first) + (1 - a) * scaled(scores, second) + bonus * (1 - place / n)
    return scores.select("query_id", "id", value.alias("score"))


def mixed_ranks(scores: DataFrame, columns: list[str], k: int = 60) -> DataFrame:
    """query_id, id, score: 1 / (k + rank) by each of the scores, added up."""
    rank = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(c, 9)), "id"))
    total = sum((1 / (k + rank(c)) for c in columns), F.lit(0.0))
    return scores.select("query_id", "id", total.alias("score"))


def bigrams(s: Column) -> Column:
    words = scalars.ir_tokens(s)
    return F.when(F.size(words) > 1, F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))


def bigram_dice(a: Column, b: Column) -> Column:
    """Twice the common word pairs over all, 0 without any."""
    x, y = bigrams(a), bigrams(b)
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2 * F.size(F.array_intersect(x, y)) / total).otherwise(0.0)


def clustered(vectors: DataFrame, clusters: int = 3, rounds: int = 10) -> DataFrame:
    """query_id, id, cluster of vectors(query_id, id, vector): each query's few candidates by cosine k-means, started from the first candidate and
    then always the one that is farthest from those chosen."""

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = np.array(table.column("vector").to_pylist(), dtype=np.float64)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        seeds = [0]
        while len(seeds) < min(clusters, len(x)):
            seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
        centre, label = x[seeds], np.zeros(len(x), np.int64)
        for _ in range(rounds):
            new = (x @ centre.T).argmax(axis=1)
            for c in range(len(centre)):
                own = x[new == c]
                if len(own):
                    centre[c] = own.mean(axis=0) / max(np.linalg.norm(own.mean(axis=0)), 1e-12)
            if (new == label).all():
                break
            label = new
        return pa.table({"query_id": table.column("query_id"), "id": table.column("id"), "cluster": pa.array(label)})

    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("query_id", "id"))
    return vectors.groupBy("query_id").applyInArrow(split, f"{kinds}, cluster long")


def macro(results: DataFrame, by: list[str]) -> DataFrame:
    """*by (null: all), n, precision, recall, f1: plain means over queries, for all, by each of by, and by all of them."""
    sets = [[], *[[c] for c in by], by]
    out = None
    for own in {tuple(s): s for s in sets}.values():
        agg = results.groupBy(*own).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])
        agg = agg.select(*[F.col(c) if c in own else F.lit(None).cast("string").alias(c) for c in by], "n", "precision", "recall", "f1")
        out = agg if out is None else out.unionByName(agg)
    return out


def accuracy_at(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """One row: queries and the share whose gold candidate is among the first k."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    hit = ranked.withColumn("rank", rank).join(gold.select("query_id", "id"), ["query_id", "id"])
    return hit.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias("accuracy"))


def suite(expected: DataFrame, returned: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenario (null: all), queries, precision, recall, f1, passed: plain means over the queries (scenario, query_id) of the sets expected and
    returned (scenario, query_id, id; a null id: nothing), against each scenario's threshold of mean f1, scenarios(scenario, threshold). Both
    sets empty is 1, one of them 0. Scenarios without queries have 0; of all, passed says whether every one did."""
    key = ["scenario", "query_id"]
    sets = expected.select(*key, "id", F.lit(1).alias("e"), F.lit(0).alias("r")).unionByName(returned.select(*key, "id", F.lit(0).alias("e"), F.lit(1).alias("r")))
    items = sets.groupBy(*key, "id").agg(F.max("e").alias("e"), F.max("r").alias("r"))
    real = F.col("id").isNotNull().cast("int")
    counts = items.groupBy(*key).agg(F.sum(F.col("e") * real).alias("n"), F.sum(F.col("r") * real).alias("m"), F.sum(F.col("e") * F.col("r") * real).alias("k"))
    nothing = (F.col("n") == 0) & (F.col("m") == 0)
    share = lambda a, b: F.when(nothing, 1.0).when((F.col("n") == 0) | (F.col("m") == 0), 0.0).otherwise(F.col(a) / F.col(b))
    both = counts.select(*key, share("k", "m").alias("precision"), share("k", "n").alias("recall"))
    each = both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("precision", "recall", "f1")]
    asked = scenarios.join(each, "scenario", "left")
    own = asked.groupBy("scenario").agg(F.count("query_id").alias("queries"), *means, F.any_value("threshold").alias("threshold"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("plain"))
    own = own.withColumn("passed", F.col("plain") >= F.col("threshold"))
    total = asked.agg(F.count("query_id").alias("queries"), *means).join(F.broadcast(own.agg(F.bool_and("passed").alias("passed"))))
    return own.select("scenario", "queries", "precision", "recall", "f1", "passed").unionByName(total.select(F.lit(None).cast("string").alias("scenario"), "queries", "precision", "recall", "f1", "passed"))


def fuzzy_names(a: Column, b: Column) -> Column:
    """Whether names match: equal, or one is the other's last part."""
    return (F.lower(a) == F.lower(b)) | F.endswith(F.lower(a), F.concat(F.lit("."), F.lower(b))) | F.endswith(F.lower(b), F.concat(F.lit("."), F.lower(a)))
