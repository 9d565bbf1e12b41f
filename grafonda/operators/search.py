"""Keyword, BM25, TF-IDF and vector search, and fusion of ranked lists; everything is a DataFrame of (query or channel, id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import scans
from .work import cut

K1, B, RRF_K = 1.5, 0.75, 60


def postings(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, length: term counts by document with the document's length in terms."""
    terms = corpus.select(F.col(key), scalars.ir_tokens(F.col(text)).alias("terms"))
    return terms.select(key, F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25(corpus: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, keep: int = 10, b: float = B) -> DataFrame:
    """query_key, key, score, rank: the best `keep` documents of each query; repeated query terms count each time.

    Terms that no query has are dropped before anything is shuffled."""
    asked = queries.select(query_key, F.explode(scalars.ir_tokens(F.col(query_text))).alias("term"))
    lengths = corpus.select(key, F.size(scalars.ir_tokens(F.col(text))).alias("length"))
    size = lengths.agg(F.count("*").alias("docs"), F.greatest(F.avg("length"), F.lit(1.0)).alias("avgdl"))
    hits = postings(corpus, key, text).join(asked.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    scored = hits.join(df, "term").join(F.broadcast(size)).select("term", key, (idf * gain).alias("part")).join(asked, "term").groupBy(query_key, key).agg(F.sum("part").alias("score"))
    return top(scored, [query_key], key, keep)


def top(scored: DataFrame, by: list[str], key: str, keep: int) -> DataFrame:
    """The best `keep` rows of each group with their rank from 1; equals by key."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= keep)


def tfidf_cosine(corpus: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, keep: int = 10) -> DataFrame:
    """tf * ln(N / df) vectors of documents, and of queries over the same df; cosine by a sparse join."""
    docs = cut(postings(corpus, key, text), "postings")  # texts are searched for words once
    n = corpus.agg(F.count("*").alias("docs"))
    idf = docs.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", F.log(F.col("docs") / F.col("df")).alias("idf"))
    weighed = docs.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    asked = postings(queries, query_key, query_text).join(idf, "term").select(query_key, "term", (F.col("tf") * F.col("idf")).alias("q"))
    sizes = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    lengths = asked.groupBy(query_key).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
    both = weighed.join(asked, "term").groupBy(query_key, key).agg(F.sum(F.col("w") * F.col("q")).alias("dot")).join(sizes, key).join(lengths, query_key)
    return top(both.select(query_key, key, (F.col("dot") / (F.col("size") * F.col("length"))).alias("score")), [query_key], key, keep)


def vector_search(vectors: DataFrame, key: str, column: str, query: list[float], keep: int = 10, least: float = 0.0) -> DataFrame:
    """Exact cosine top-k: per-task heaps, then one merge of k rows a task."""
    return scored(vectors, key, column, query, least).orderBy(F.desc("score"), key).limit(keep)


def scored(vectors: DataFrame, key: str, column: str, query: list[float], least: float = 0.0) -> DataFrame:
    """key, score: cosine with one stated vector, of all rows above least."""
    return vectors.select(key, scalars.cosine(F.col(column), F.array(*map(F.lit, map(float, query)))).alias("score")).where(F.col("score") > least)


def reciprocal_rank_fusion(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """id, score, channels of (channel, id, score): weight / (k + rank) summed over channels. Channels may be of any length."""
    weight = F.coalesce(F.create_map(*[x for c, w in (weights or {}).items() for x in (F.lit(c), F.lit(float(w)))])[F.col("channel")], F.lit(1.0)) if weights else F.lit(1.0)
    ranked = scans.with_rank(lists.select("channel", "id", "score"), ["channel"], [F.desc("score"), "id"])
    parts = ranked.withColumn("part", weight / (k + F.col("rank")))
    return parts.groupBy("id").agg(F.sum("part").alias("score"), F.concat_ws(",", F.array_sort(F.collect_set("channel"))).alias("channels"))


def convex_fusion(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """id, score: min-max scaled scores (1 where a channel is constant), weighed and summed."""
    clean = lists.withColumn("score", F.when(F.isnan("score") | (F.abs("score") == float("inf")), 0.0).otherwise(F.col("score")))
    ends = clean.groupBy("channel").agg(F.min("score").alias("low"), F.max("score").alias("high"))  # a row for each channel
    share = (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))
    scaled = clean.join(F.broadcast(ends), "channel").withColumn("s", F.when(F.col("high") == F.col("low"), 1.0).otherwise(share))
    weight = F.create_map(*[x for c, v in weights.items() for x in (F.lit(c), F.lit(float(v)))])[F.col("channel")]
    return scaled.groupBy("id").agg(F.sum(weight * F.col("s")).alias("score"))


def keyword_score(query: str, name: Column, path: Column, doc: Column) -> Column:
    """Points for how a node's name, path and text meet a query."""
    q = query.lower()
    low = F.lower(name)
    base = F.when(low == q, 30).when(F.startswith(low, F.lit(q)), 20).when(F.contains(low, F.lit(q)), 10).otherwise(0)
    words = [w for w in q.split() if w]
    several = sum((F.when(F.contains(low, F.lit(w)), 3).otherwise(0) for w in words), F.lit(0)) if len(words) > 1 else F.lit(0)
    return base + F.when(F.contains(F.lower(path), F.lit(q)), 8).otherwise(0) + several + F.when(F.contains(F.lower(doc), F.lit(q)), 5).otherwise(0)


def retrieval_quality(found: DataFrame, relevant: DataFrame, by: str, item: str) -> DataFrame:
    """by, precision, recall, f1 of found(by, item) against relevant(by, item); 1 where both are empty."""
    hits = found.select(by, item).distinct().join(relevant.select(by, item).distinct(), [by, item]).groupBy(by).agg(F.count("*").alias("hits"))
    n = found.groupBy(by).agg(F.countDistinct(item).alias("n"))
    m = relevant.groupBy(by).agg(F.countDistinct(item).alias("m"))
    all_ = n.join(m, by, "full").join(hits, by, "left").na.fill(0, ["n", "m", "hits"])
    p = F.when((F.col("n") == 0) & (F.col("m") == 0), 1.0).when(F.col("n") == 0, 0.0).otherwise(F.col("hits") / F.col("n"))
    r = F.when((F.col("n") == 0) & (F.col("m") == 0), 1.0).when(F.col("m") == 0, 0.0).otherwise(F.col("hits") / F.col("m"))
    return all_.select(by, p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


#: Passages without a whole word inside that are looked for in every text (by a broadcast, so their number is checked).
FEW_PASSAGES = 1000


def containing(corpus: DataFrame, key: str, text: str, passages: DataFrame, passage_key: str, passage: str) -> DataFrame:
    """passage_key, key: the texts that contain a passage as it stands. A text that does has all words that lie whole inside the passage, so only
    texts with the rarest of them are compared."""
    found_words = lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))
    asked = passages.where(F.col(passage).isNotNull()).select(passage_key, F.col(passage).alias("_passage"))
    inside = asked.select(passage_key, found_words(F.col("_passage")).alias("w")).where("size(w) > 2").select(passage_key, F.explode(F.array_distinct(F.slice("w", 2, F.size("w") - 2))).alias("word"))
    held = corpus.select(key, F.explode(F.array_distinct(found_words(F.col(text)))).alias("word")).join(inside.select("word").distinct(), "word", "left_semi")
    held = cut(held, "held_words")
    rare = inside.join(held.groupBy("word").agg(F.count("*").alias("df")), "word", "left").groupBy(passage_key).agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    pairs = rare.join(held, "word").select(passage_key, key).join(corpus.select(key, F.col(text).alias("_text")), key).join(asked, passage_key)
    out = pairs.where(F.contains("_text", F.col("_passage"))).select(passage_key, key)
    wordless = cut(asked.join(rare.select(passage_key), passage_key, "left_anti"), "wordless")
    n = wordless.count()
    if n:
        side = F.broadcast(wordless) if n <= FEW_PASSAGES else wordless
        out = out.unionByName(corpus.select(key, F.col(text).alias("_text")).join(side, F.contains("_text", F.col("_passage"))).select(passage_key, key))
    return out.distinct()
