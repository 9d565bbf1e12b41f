"""Versioned memories with time: memories(id, tier, content, created_at, ...), versions(memory_id, version, content, created_at, superseded_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import micros
from .alike import candidates
from .work import cut


def as_of(memories: DataFrame, versions: DataFrame, at: Column) -> DataFrame:
    """id, content as they were at a time: the highest version then in force, else the memory's own content."""
    live = versions.where((F.col("created_at") <= at) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > at)))
    best = live.groupBy("memory_id").agg(F.max_by("content", "version").alias("old"))
    return memories.where(F.col("created_at") <= at).join(best, F.col("id") == F.col("memory_id"), "left").select("id", F.coalesce("old", "content").alias("content"))


def next_versions(memories: DataFrame, updates: DataFrame) -> DataFrame:
    """memory_id, version, content, created_at, superseded_at from all writes (id, content, at): each write ends the one before."""
    writes = memories.select("id", "content", F.col("created_at").alias("at")).unionByName(updates.select("id", "content", "at"))
    w = Window.partitionBy("id").orderBy("at", "content")
    return writes.select(F.col("id").alias("memory_id"), F.row_number().over(w).alias("version"), "content", F.col("at").alias("created_at"), F.lead("at").over(w).alias("superseded_at"))


def live(memories: DataFrame, now: Column) -> DataFrame:
    return memories.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def live_children(memories: DataFrame, child: DataFrame, now: Column) -> DataFrame:
    """Rows of a child table (memory_id, ...) that stay when expired memories go: those whose memory is live."""
    return child.join(live(memories, now).select(F.col("id").alias("memory_id")), "memory_id", "left_semi")


def decayed(memories: DataFrame, now: Column) -> DataFrame:
    """memories with strength: importance faded by age since last access; pinned ones stay at 1."""
    age = (micros(now) - micros(F.coalesce("last_accessed_at", "created_at"))) / 3.6e9
    half = scalars.tier_half_life(F.col("tier"), F.col("source") == "manual")
    return memories.withColumn("strength", F.when(F.col("tier") == "pinned", 1.0).otherwise(F.col("importance") * scalars.recency_decay(age, F.col("access_count"), half)))


def duplicates(memories: DataFrame, threshold: float = 0.85, vectors: DataFrame | None = None, loose: float = 0.5, alike: float = 0.9) -> DataFrame:
    """a, b, similarity, n_a, n_b: pairs of token sets (within a tier and entity) that are alike by more than threshold, named by the least id
    of each set; with vectors(id, vector) also those of `loose` or more whose vectors' cosine is over `alike`. Memories with one token set
    are one class (n_a, n_b: how many) that stands for all pairs among them: a = b.

    Which pairs may be that alike is told from sketches, in blocks (see alike); words are fetched for those pairs alone."""
    least = threshold if vectors is None else loose
    sets = memories.select("id", "tier", "entity_id", F.array_sort(scalars.token_set(F.col("content"))).alias("words")).where(F.size("words") > 0)
    classes = cut(sets.groupBy("tier", "entity_id", "words").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")
    found = candidates(classes, ["tier", "entity_id"], "words", least)
    near = cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "near")
    full = lambda x, n: classes.select(F.col("id").alias(x), F.struct("tier", "entity_id").alias(f"g_{x}"), F.col("words").alias(f"w_{x}"), F.col("n").alias(n))
    both = near.join(full("a", "n_a"), "a").join(full("b", "n_b"), "b").where("g_a = g_b").withColumn("similarity", scalars.jaccard(F.col("w_a"), F.col("w_b")))
    if vectors is None:
        good = both.where(F.col("similarity") > threshold)
    else:
        v = lambda x: vectors.select(F.col("id").alias(x), F.col("vector").alias(f"v_{x}"))
        both = both.join(v("a"), "a", "left").join(v("b"), "b", "left")
        good = both.where((F.col("similarity") > threshold) | ((F.col("similarity") >= loose) & (scalars.cosine(F.col("v_a"), F.col("v_b")) > alike)))
    own = classes.where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    return good.select("a", "b", "similarity", "n_a", "n_b").unionByName(own)


def stale_by_anchor(anchors: DataFrame, changed: DataFrame) -> DataFrame:
    """memory_id of memories all of whose anchors (memory_id, node_id) changed."""
    marked = anchors.join(changed.select("node_id").distinct().withColumn("hit", F.lit(1)), "node_id", "left")
    return marked.groupBy("memory_id").agg(F.count("*").alias("n"), F.count("hit").alias("k")).where("n = k").select("memory_id")


def recall(lists: DataFrame, strengths: DataFrame, least: float = 0.05, keep: int = 10) -> DataFrame:
    """Ranked memories from channel lists (channel, id, score), fused by rank, times strength, above a floor."""
    from .search import reciprocal_rank_fusion

    fused = reciprocal_rank_fusion(lists).join(strengths.select("id", "strength"), "id").where(F.col("strength") >= least)
    return fused.withColumn("value", F.col("score") * F.col("strength")).orderBy(F.desc("value"), "id").limit(keep)


def learned_weights(delivered: DataFrame, outcomes: DataFrame) -> DataFrame:
    """from_id, to_id, weight: edges whose ends were delivered together in sessions that ended well or badly; within 0.3 and 2."""
    moves = delivered.join(outcomes, "session_id").withColumn("step", F.when(F.col("good"), 0.1).otherwise(-0.05))
    return moves.groupBy("from_id", "to_id").agg(F.greatest(F.lit(0.3), F.least(F.lit(2.0), 1 + F.sum("step"))).alias("weight"))


def dormant(weights: DataFrame, now: Column, days: int = 30, factor: float = 0.7) -> DataFrame:
    """weights(from_id, to_id, weight, last_used_at, marked) where those that were not used for so many days fade, once."""
    old = (F.col("last_used_at") < now - F.expr(f"INTERVAL {days} DAY")) & ~F.col("marked")
    faded = F.greatest(F.lit(0.3), F.col("weight") * factor)
    return weights.withColumns({"weight": F.when(old, faded).otherwise(F.col("weight")), "marked": F.col("marked") | old})
