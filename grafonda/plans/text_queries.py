"""Search, fusion, text hygiene, memories and coordination over documents, pages, conversations, vectors and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import coordination, memory, model, search

QUERIES: dict = {}


def _add(name, tables, run, sql):
    QUERIES[f"text_{name}"] = (lambda spark, d: run(*(model.table(spark, d, t) for t in tables.split())), sql)


_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
_TERMS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{Nd}}_]+'), lambda x: strlen(x) > 1 AND x NOT IN (" + _STOP + "))"
_POST = f"p AS MATERIALIZED (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents)), q AS MATERIALIZED (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark), "
_few = lambda b: b  # noqa: E731  the whole benchmark against all documents
_BM25 = f"WITH {_POST} n AS (SELECT count(*) AS docs, greatest(avg(len({_TERMS.format('text')})), 1.0) AS avgdl FROM documents), tf AS MATERIALIZED (SELECT doc_id, length, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), sc AS (SELECT item_id, doc_id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY ALL)"
_add("bm25", "documents benchmark", lambda d, b: search.bm25(d, "doc_id", "text", _few(b), "item_id", "text").select("item_id", "doc_id", "rank", F.round("score", 6).alias("score")), _BM25 + " SELECT item_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 10")
_add("tfidf", "documents benchmark", lambda d, b: search.tfidf_cosine(d, "doc_id", "text", _few(b), "item_id", "text", 5).select("item_id", "doc_id", F.round("score", 6).alias("score")), f"WITH {_POST} tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), idf AS MATERIALIZED (SELECT term, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM tf GROUP BY 1), w AS MATERIALIZED (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)), a AS (SELECT item_id, term, count(*) * any_value(idf) AS q FROM q JOIN idf USING (term) GROUP BY ALL), sz AS (SELECT doc_id, sqrt(sum(w * w)) AS s FROM w GROUP BY 1), ln_ AS (SELECT item_id, sqrt(sum(q * q)) AS l FROM a GROUP BY 1), sc AS (SELECT item_id, doc_id, sum(w * q) / any_value(s * l) AS score FROM w JOIN a USING (term) JOIN sz USING (doc_id) JOIN ln_ USING (item_id) GROUP BY ALL) SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM sc) WHERE r <= 5")


def _vector(d, k=10):
    query = list(d.where("vec_id = 0").first()["embedding"])
    return search.vector_search(d, "vec_id", "embedding", query, k)


_COS = "(SELECT e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
_add("vector_search", "embeddings", lambda d: _vector(d).select("vec_id", F.round("score", 6).alias("score")), f"SELECT vec_id, round(score, 6) AS score FROM {_COS} WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 10")


def _channels(d):
    """All rows of two channels: likeness to a stated vector, and a score by label."""
    a = search.scored(d, "vec_id", "embedding", list(d.where("vec_id = 0").first()["embedding"])).select(F.lit("semantic").alias("channel"), F.col("vec_id").alias("id"), "score")
    b = d.select(F.lit("label").alias("channel"), F.col("vec_id").alias("id"), (F.col("label") * 10 + F.col("vec_id") % 10).cast("double").alias("score"))
    return a.unionByName(b)


_CH = f"ch AS MATERIALIZED ((SELECT 'semantic' AS channel, vec_id AS id, score FROM {_COS} WHERE score > 0) UNION ALL (SELECT 'label', vec_id, (label * 10 + vec_id % 10)::DOUBLE AS sc FROM embeddings))"
_add("rrf", "embeddings", lambda d: search.reciprocal_rank_fusion(_channels(d)).withColumn("score", F.round("score", 9)), f"WITH {_CH} SELECT id, round(sum(1.0 / (60 + r)), 9)::DOUBLE AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, id) AS r FROM ch) GROUP BY 1")
_add("convex", "embeddings", lambda d: search.convex_fusion(_channels(d), {"semantic": 0.7, "label": 0.3}).withColumn("score", F.round("score", 6)), f"WITH {_CH} SELECT id, round(sum((CASE channel WHEN 'semantic' THEN 0.7 ELSE 0.3 END)::DOUBLE * (score - lo) / (hi - lo)), 6) AS score FROM (SELECT *, min(score) OVER (PARTITION BY channel) lo, max(score) OVER (PARTITION BY channel) hi FROM ch) GROUP BY 1")
_add("retrieval_quality", "documents benchmark", lambda d, b: _quality(d, b), _BM25 + ", f AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM sc) WHERE r <= 10), rel AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), m AS (SELECT item_id, coalesce(n, 0) n, coalesce(m, 0) m, coalesce(h, 0) h FROM (SELECT item_id, count(*) n FROM f GROUP BY 1) FULL JOIN (SELECT item_id, count(*) m FROM rel GROUP BY 1) USING (item_id) LEFT JOIN (SELECT item_id, count(*) h FROM f JOIN rel USING (item_id, doc_id) GROUP BY 1) USING (item_id)) SELECT item_id, round(CASE WHEN n = 0 THEN 0 ELSE h / n::DOUBLE END, 6)::DOUBLE AS precision, round(CASE WHEN m = 0 THEN 0 ELSE h / m::DOUBLE END, 6)::DOUBLE AS recall, round(CASE WHEN h = 0 THEN 0 ELSE 2.0 * h / (n + m) END, 6)::DOUBLE AS f1 FROM m")


def _quality(d, b):
    found = search.bm25(d, "doc_id", "text", _few(b), "item_id", "text")
    relevant = search.containing(d, "doc_id", "text", b, "item_id", "text")
    return search.retrieval_quality(found, relevant, "item_id", "doc_id").select("item_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_add("keyword_score", "part", lambda p: p.select("p_partkey", search.keyword_score("widget", F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("score")).where("score > 0"), "SELECT p_partkey, score::INT AS score FROM (SELECT p_partkey, CASE WHEN lower(p_name) = 'widget' THEN 30 WHEN starts_with(lower(p_name), 'widget') THEN 20 WHEN contains(lower(p_name), 'widget') THEN 10 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'widget') THEN 8 ELSE 0 END + CASE WHEN contains(lower(p_name), 'steel') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_name), '1') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_type), 'widget') THEN 5 ELSE 0 END AS score FROM part) WHERE score > 0")
_add("token_sets", "conversations", lambda c: c.select("conv_id", "turn", F.size(S.token_set(F.col("text"))).alias("n")), "SELECT conv_id, turn, len(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '')))::INT AS n FROM conversations")
_add("camel_split", "part", lambda p: p.select("p_partkey", S.split_camel_all(F.col("p_type")).alias("split"), S.normalized_name(F.concat_ws("-", "p_brand", "p_type")).alias("name")), "SELECT p_partkey, CASE WHEN p_type = '' THEN '' ELSE left(p_type, 1) || regexp_replace(substr(p_type, 2), '([A-Z])', ' \\1', 'g') END AS split, lower(translate(p_brand || '-' || p_type, '-_./', '')) AS name FROM part")
_add("token_estimate", "documents", lambda d: d.groupBy("lang").agg(F.sum(S.token_estimate(F.col("text"))).cast("long").alias("tokens"), F.max(F.length("text")).alias("longest")), "SELECT lang, sum(strlen(text) // 4 + 1)::BIGINT AS tokens, max(length(text))::INT AS longest FROM documents GROUP BY 1")
_add("html_text", "pages", lambda p: p.select("page_id", S.html_text(F.col("html")).alias("text")), None)
_add("injections", "conversations", lambda c: c.select("conv_id", "turn", F.array_join(S.injections(F.col("text")), ",").alias("found")).where("found <> ''"), None)
_add("identifiers", "pages", lambda p: p.select("page_id", F.explode(S.identifiers(F.col("html"))).alias("name")).groupBy("name").agg(F.countDistinct("page_id").alias("pages")), None)


def _now():
    return F.lit("2024-02-01").cast("timestamp")



def _memories(e):
    """Events as memories: one each, with the tier and source by type."""
    return e.selectExpr("event_id as id", "case event_type when 'error' then 'session_log' when 'view' then 'project' when 'signup' then 'pinned' else 'entity' end as tier", "if(event_type = 'purchase', 'manual', 'auto') as source", "concat(event_type, ' ', props) as content", "get_json_object(props, '$.k') as entity_id", "ts as created_at", "cast(null as timestamp) as last_accessed_at", "if(event_id % 4 = 0, ts + interval 10 days, null) as expires_at", "(event_id % 10) / 10.0D as importance", "event_id % 7 as access_count")


_MEM = "m AS (SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'session_log' WHEN 'view' THEN 'project' WHEN 'signup' THEN 'pinned' ELSE 'entity' END AS tier, event_type = 'purchase' AS manual, ts AS created_at, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 10 DAY END AS expires_at, (event_id % 10) / 10.0::DOUBLE AS importance, event_id % 7 AS access_count, event_type || ' ' || props AS content, json_extract_string(props, '$.k') AS entity_id FROM events)"
_add("memory_decay", "events", lambda e: memory.decayed(_memories(e), _now()).select("id", F.round("strength", 6).alias("strength")), f"WITH {_MEM} SELECT id, round(CASE WHEN tier = 'pinned' THEN 1.0 ELSE importance / (1 + greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 3.6e9, 0) / (CASE tier WHEN 'session_log' THEN 72.0 WHEN 'project' THEN 336.0 ELSE CASE WHEN manual THEN 504.0 ELSE 168.0 END END * log2(greatest(access_count, 1) + 1))) END, 6)::DOUBLE AS strength FROM m")
_add("memory_live", "events", lambda e: memory.live(_memories(e), _now()).groupBy("tier").agg(F.count("*").alias("n")), f"WITH {_MEM} SELECT tier, count(*) AS n FROM m WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01' GROUP BY 1")


def _versions(e):
    """A user's events as writes to one memory of theirs."""
    writes = e.selectExpr("user_id as id", "event_type as content", "ts as at")
    stored = "crc32(cast(cast(at as string) as binary)) % 2 = 0"  # half of the writes are in the store already
    return memory.next_versions(writes.where(stored).selectExpr("id", "content", "at as created_at"), writes.where(f"not ({stored})"))


_VER = "v AS (SELECT user_id AS memory_id, row_number() OVER w AS version, event_type AS content, ts AS created_at, lead(ts) OVER w AS superseded_at FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type))"
_add("memory_versions", "events", _versions, f"WITH {_VER} SELECT memory_id, version::INT AS version, content, created_at, superseded_at FROM v")
_add("memory_as_of", "events", lambda e: memory.as_of(e.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("created_at"), F.lit("none").alias("content")), _versions(e), F.lit("2024-01-15").cast("timestamp")), f"WITH {_VER} SELECT memory_id AS id, max_by(content, version) AS content FROM v WHERE created_at <= TIMESTAMP '2024-01-15' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '2024-01-15') GROUP BY 1")


def _tasks(o):
    return o.selectExpr("cast(o_orderkey as string) as id", "cast(o_custkey as string) as plan_id", "if(o_orderstatus = 'F', 'done', 'pending') as status", "o_orderpriority as priority", "array(cast(o_orderkey - 1 as string), cast(o_orderkey - 7 as string)) as depends_on")


_add("pending_tasks", "orders", lambda o: coordination.pending_tasks(_tasks(o)).select("id", "priority", F.array_join("blocked_by", ",").alias("blocked_by")), "WITH d AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT o_orderkey AS id, unnest([o_orderkey - 1, o_orderkey - 7]) AS dep FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT id, string_agg(dep::VARCHAR, ',' ORDER BY dep::VARCHAR) AS by_ FROM n WHERE dep NOT IN (SELECT k FROM d) GROUP BY 1) SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS priority, coalesce(by_, '') AS blocked_by FROM orders LEFT JOIN b ON b.id = o_orderkey WHERE o_orderstatus <> 'F'")
_add("plan_progress", "orders customer", lambda o, c: coordination.plan_progress(c.selectExpr("cast(c_custkey as string) as id"), _tasks(o)).select("id", "total", "done", F.coalesce("complete", F.lit(False)).alias("complete")), "SELECT c_custkey::VARCHAR AS id, count(o_orderkey) AS total, count(o_orderkey) FILTER (o_orderstatus = 'F') AS done, count(o_orderkey) > 0 AND count(o_orderkey) = count(o_orderkey) FILTER (o_orderstatus = 'F') AS complete FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_add("inbox", "events", lambda e: coordination.inbox(e.selectExpr("event_id as seq", "if(event_type = 'signup', null, cast(user_id % 10 as string)) as to_agent", "if(event_type = 'error', ts, null) as read_at", "props as payload"), "3", 100).select("seq", "payload"), "SELECT event_id AS seq, props AS payload FROM events WHERE event_id > 100 AND (event_type = 'signup' OR (user_id % 10 = 3 AND event_type <> 'error'))")
