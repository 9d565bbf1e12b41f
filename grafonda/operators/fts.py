"""Full-text search over weighted columns, and recall of memories over four channels.

An index is a table of postings (id, column, term, tf) with columns' lengths, built once and stored; a search semi-joins it with the
query's few terms first, so only matching postings move. Scores are BM25 summed over columns with a weight for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, words
from . import search
from .graph import chosen
from .work import cut

# Weights of the columns, and the saturation of term frequencies.
WEIGHTS = {"name": 10.0, "split_name": 8.0, "description": 7.0, "signature": 5.0, "doc": 2.0}
K1, B = 1.2, 0.75
RECALL_LEAST, VISIBLE = 0.3, 0.05


def index_rows(nodes: DataFrame) -> DataFrame:
    """id, name, split_name, description, signature, doc of nodes(id, type, name, signature, doc, body, context): doc falls back to body and
    to context."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) if c in nodes.columns else F.lit("")
    none = F.array().cast("array<string>")
    doc = F.coalesce(F.nullif(blank("doc"), F.lit("")), F.nullif(blank("body"), F.lit("")), blank("context"))
    described = words.described(F.col("type"), F.col("name"), blank("signature"), doc, none, none)
    return nodes.select("id", F.col("name"), scalars.split_camel_all(F.col("name")).alias("split_name"), described.alias("description"), blank("signature").alias("signature"), doc.alias("doc"))


def build_index(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """id, column, term, tf, length: terms are runs of letters and digits in lower case."""
    columns = list(weights or WEIGHTS)
    term = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    each = rows.select("id", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), term(c).alias("terms")) for c in columns])))
    return each.select("id", "column", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("id", "column", "length", "term").agg(F.count("*").alias("tf"))


def query_terms(spark, query: str) -> list[tuple[str, bool]]:
    """(term, whether it stands for all that begin with it)."""
    found = spark.range(1).select(words.search_terms(F.lit(query)).alias("t")).first()["t"]
    return list(dict.fromkeys((r["term"], r["is_prefix"]) for r in found))


def full_text(index: DataFrame, documents: int, query: str, weights: dict[str, float] | None = None, keep: int | None = None) -> DataFrame:
    """id, score of the rows that have any of the query's terms, best first. documents: rows of the index. A prefix term is one term: its
    frequency in a column is the sum over the words that begin with it."""
    weights = weights or WEIGHTS
    spark = index.sparkSession
    asked = query_terms(spark, query)
    none = spark.createDataFrame([], "id string, score double")
    if not asked:
        return none
    fits = lambda t, prefix: F.startswith(F.col("term"), F.lit(t)) if prefix else F.col("term") == t
    any_of = F.lit(False)
    for t, prefix in asked:
        any_of = any_of | fits(t, prefix)
    hits = index.where(any_of).withColumn("place", F.explode(F.filter(F.array(*[F.when(fits(t, p), F.lit(k)) for k, (t, p) in enumerate(asked)]), lambda x: x.isNotNull())))
    hits = hits.groupBy("id", "column", "length", "place").agg(F.sum("tf").alias("tf"))
    sizes = index.select("id", "column", "length").distinct().groupBy("column").agg((F.sum("length") / documents).alias("mean"))
    df = hits.groupBy("place").agg(F.countDistinct("id").alias("df"))
    idf = F.greatest(F.log((documents - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    scored = hits.join(F.broadcast(sizes), "column").join(F.broadcast(df), "place")  # both have a row for each column or term of the query
    weight = chosen(F.col("column"), weights, 0.0)
    weighted = scored.groupBy("id", "place", "df").agg(F.sum(weight * F.col("tf") / (1 - B + B * F.col("length") / F.col("mean"))).alias("wtf"))
    out = weighted.groupBy("id").agg(F.sum(idf * F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1)).alias("score"))
    return out if keep is None else out.orderBy(F.desc(F.round("score", 9)), "id").limit(keep)


def like_search(rows: DataFrame, query: str, keep: int = 50) -> DataFrame:
    """id, score (1): rows whose name or doc holds any word of the query; the shortest names first."""
    hit = F.lit(False)
    for w in query.lower().split():
        hit = hit | F.contains(F.lower("name"), F.lit(w)) | F.contains(F.lower("doc"), F.lit(w))
    return rows.where(hit).orderBy(F.length("name"), "id").limit(keep).select("id", F.lit(1.0).alias("score"))


def node_search(nodes: DataFrame, rows: DataFrame, index: DataFrame, documents: int, query: str, domain: str | None = None, keep: int = 50) -> DataFrame:
    """id, name, score, exact: full text, or parts of words where that finds nothing; rows whose name is the query come first. domain: only
    nodes of it."""
    found = cut(full_text(index, documents, query), "hits")
    if found.isEmpty():
        found = like_search(rows, query, keep)
    named = found.join(nodes.select("id", "name", F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("code")).alias("domain")), "id")
    named = named.where(F.col("domain") == domain) if domain else named
    return named.withColumn("exact", F.lower("name") == query.lower()).orderBy(F.desc("exact"), F.desc(F.round("score", 9)), "id").limit(keep).select("id", "name", "score", "exact")


def hybrid_search(text_hits: DataFrame, vector_hits: DataFrame, keep: int = 20) -> DataFrame:
    """id, score, channels: both lists (id, score) fused by rank."""
    lists = text_hits.select(F.lit("bm25").alias("channel"), "id", "score").unionByName(vector_hits.select(F.lit("vector").alias("channel"), "id", "score"))
    return search.reciprocal_rank_fusion(lists).orderBy(F.desc(F.round("score", 12)), "id").limit(keep)


def memory_search(memories: DataFrame, hits: DataFrame, now: Column, with_stale: bool = False) -> DataFrame:
    """memories that a search hit (id, score), without expired and (unless asked for) stale ones."""
    kept = memories.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    kept = kept if with_stale else kept.where("not stale")
    return kept.join(hits, "id")


def anchor_nodes(anchors: DataFrame, memories: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """node_id: what the memories that a search hit are anchored to."""
    return anchors.join(memory_search(memories, hits, now).select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("node_id").distinct()


def anchored(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """memory_id of memories anchored to any of nodes(node_id)."""
    return anchors.join(nodes, "node_id", "left_semi").select("memory_id").distinct()


def without_embedding(memories: DataFrame, embeddings: DataFrame) -> DataFrame:
    """id, why: memories without an embedding, with a stale one, or with one of other content."""
    hashed = memories.select("id", F.sha2("content", 256).alias("now"))
    both = hashed.join(embeddings.select("id", "stale", "content_hash"), "id", "left")
    why = F.when(F.col("content_hash").isNull(), "missing").when(F.col("stale"), "stale").when(F.col("content_hash") != F.col("now"), "changed")
    return both.select("id", why.alias("why")).where("why is not null")


def not_surfaced(memories: DataFrame, surfaced: DataFrame, agent: str) -> DataFrame:
    """Stale memories that this agent has not been told of."""
    return memories.where("stale").join(surfaced.where(F.col("agent_id") == agent).select(F.col("memory_id").alias("id")), "id", "left_anti")


def recent(memories: DataFrame, now: Column, days: int = 7, keep: int = 50) -> DataFrame:
    """id, score: memories of the last days, the newest first; the score falls with age."""
    age = (scalars.micros(now) - scalars.micros("created_at")) / 3.6e9
    return memories.where((F.col("created_at") <= now) & (F.col("created_at") > now - F.expr(f"INTERVAL {days} DAY"))).orderBy(F.desc("created_at"), "id").limit(keep).select("id", (1 / (1 + age / 24)).alias("score"))


def channel_weights(wins: DataFrame, defaults: dict[str, float]) -> dict[str, float]:
    """Weights of channels: what was learned from wins(channel, rate), at least .05, if two channels or more were learned; else defaults."""
    learned = {r["channel"]: max(r["rate"], 0.05) for r in wins.select("channel", "rate").collect()}  # a row for each channel
    return {c: learned.get(c, w) for c, w in defaults.items()} if len(learned) >= 2 else dict(defaults)


def quad_recall(memories: DataFrame, text_hits: DataFrame, vector_hits: DataFrame, activated: DataFrame, anchors: DataFrame, now: Column, weights: dict[str, float] | None = None, keep: int = 10) -> DataFrame:
    """id, score, channels, strength: memories by full text, by vectors (at least RECALL_LEAST alike), by activation of the nodes that they are
    anchored to and by recency, fused by rank and weighed by how strong they still are; weaker ones than VISIBLE are left out."""
    from .memory import decayed

    live = cut(decayed(memories.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)), now), "live")
    graph_hits = anchors.join(activated.select(F.col("id").alias("node_id"), "activation"), "node_id").groupBy(F.col("memory_id").alias("id")).agg(F.max("activation").alias("score"))
    lists = {"bm25": text_hits, "semantic": vector_hits.where(F.col("score") >= RECALL_LEAST), "graph": graph_hits, "temporal": recent(live, now)}
    every = None
    for name, hits in lists.items():
        own = hits.join(live.select("id"), "id", "left_semi").select(F.lit(name).alias("channel"), "id", F.col("score").cast("double").alias("score"))
        every = own if every is None else every.unionByName(own)
    fused = search.reciprocal_rank_fusion(every, weights)
    return fused.join(live.select("id", "strength"), "id").where(F.col("strength") >= VISIBLE).orderBy(F.desc(F.round("score", 12)), "id").limit(keep)


def convex_recall(text_hits: DataFrame, vector_hits: DataFrame, graph_hits: DataFrame, temporal_hits: DataFrame, alpha: float = 0.4) -> DataFrame:
    """id, score: alpha of full text, the rest of vectors, .3 of the graph and .2 of recency, each scaled to 0..1 over its hits."""
    lists = {"bm25": (text_hits, alpha), "semantic": (vector_hits, 1 - alpha), "graph": (graph_hits, 0.3), "temporal": (temporal_hits, 0.2)}
    every = None
    for name, (hits, _) in lists.items():
        own = hits.select(F.lit(name).alias("channel"), "id", F.col("score").cast("double").alias("score"))
        every = own if every is None else every.unionByName(own)
    return search.convex_fusion(every, {name: w for name, (_, w) in lists.items()})


def episodes_about(episodes: DataFrame, hits: DataFrame | None = None, outcome: str | None = None, node: str | None = None, keep: int = 20) -> DataFrame:
    """Episodes that a search hit, of an outcome or about a node, the newest first."""
    out = episodes if hits is None else episodes.join(hits.select("id"), "id", "left_semi")
    out = out if outcome is None else out.where(F.col("outcome") == outcome)
    out = out if node is None else out.where(F.array_contains("nodes", node))
    return out.orderBy(F.desc("created_at"), "id").limit(keep)


def rule_candidates(episodes: DataFrame, least: int = 3) -> DataFrame:
    """decision, n, ids: decisions that failed at least so many times."""
    return episodes.where("outcome = 'failure'").groupBy("decision").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids")).where(F.col("n") >= least)


def memories_of(memories: DataFrame, entities: DataFrame, keep: int = 5) -> DataFrame:
    """The newest memories of each of entities(entity_id), with rank."""
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("created_at"), "id"))
    return memories.join(entities, "entity_id", "left_semi").withColumn("rank", rank).where(F.col("rank") <= keep)


def touched(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """memories with access_count and last_accessed_at moved on by accesses(memory_id, at)."""
    counted = accesses.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("more"), F.max("at").alias("last"))
    both = memories.join(counted, "id", "left")
    return both.withColumns({"access_count": F.col("access_count") + F.coalesce("more", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "last")}).drop("more", "last")


def embedding_text(nodes: DataFrame, edges: DataFrame, callees: int = 5, callers: int = 3) -> DataFrame:
    """id, text: name, signature and doc, with the names of some callees and callers."""
    calls, names = edges.where("type = 'CALLS'"), nodes.select("id", "name")

    def some(at: str, other: str, most: int, label: str) -> DataFrame:
        named = calls.join(names.withColumnRenamed("id", other), other)
        rank = F.row_number().over(Window.partitionBy(at).orderBy("name", other))
        return named.withColumn("rank", rank).where(F.col("rank") <= most).groupBy(F.col(at).alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias(label))

    both = nodes.join(some("from_id", "to_id", callees, "callees"), "id", "left").join(some("to_id", "from_id", callers, "callers"), "id", "left")
    own = [c for c in ("signature", "doc") if c in nodes.columns]
    return both.select("id", F.concat_ws(" ", "name", *own, "callees", "callers").alias("text"))


def suggested_tools(intents: DataFrame, tools: DataFrame) -> DataFrame:
    """intent, tool, how of tools(tool, keyword): an intent's word is a keyword, or has its stem."""
    asked = intents.select("intent", F.explode(F.array_distinct(F.filter(F.split(F.lower("intent"), r"[^a-z]+"), lambda w: w != ""))).alias("word")).withColumn("stem", words.stemmed(F.col("word")))
    known = tools.withColumn("stem", words.stemmed(F.col("keyword")))
    hits = asked.join(known.select("tool", "keyword", "stem"), "stem").select("intent", "tool", F.when(F.col("word") == F.col("keyword"), "exact").otherwise("stem").alias("how"))
    return hits.groupBy("intent", "tool").agg(F.min("how").alias("how"))
