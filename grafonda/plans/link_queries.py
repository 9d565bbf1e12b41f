"""Stored graphs and their differences, derived links, tests, federation and further rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars, words
from ..operators import calls, enrichment, federation, graph, handlers, links, model, nearest, orders, paths, ranking, resolve, rules, store
from ..operators.carve import data_role, spread_scores
from ..operators.model import GRAPH_SQL
from ..operators.work import cut, shared_dir
from .graph_queries import _BACK, _LABEL, _UNDIRECTED, ROOT, SUPPLIER, _bfs, _seed

QUERIES: dict = {}


def _add(name, run, sql):
    QUERIES[f"graph_{name}"] = (lambda spark, d: run(*model.graph(spark, d)), f"WITH RECURSIVE {GRAPH_SQL} {sql}" if sql else None)


def _table(name, tables, run, sql):
    QUERIES[f"graph_{name}"] = (lambda spark, d: run(*(model.table(spark, d, t) for t in tables.split())), sql)


def _counts(n, e):
    return n.groupBy("type").agg(F.count("*").alias("n")).unionByName(e.groupBy(F.concat(F.lit("edge "), "type").alias("type")).agg(F.count("*").alias("n")))


def _stored(n, e):
    path = f"{shared_dir(n.sparkSession)}/saved-{uuid.uuid4().hex}"
    store.save_graph(n, e, path)
    return path


_FILE = "customer/CHINA.tbl"
_add("saved", lambda n, e: _counts(*store.load_graph(n.sparkSession, _stored(n, e))), "SELECT type, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'edge ' || type, count(*) FROM edges GROUP BY 1")


def _delta(n, e):
    path = _stored(n, e)
    own = n.where(F.col("file") == _FILE).where("line % 2 = 0")
    store.save_delta(n.sparkSession, path, _FILE, own, e.join(store.side_of(own.select(F.col("id").alias("from_id"))), "from_id", "left_semi").select("from_id", "to_id", "type"))
    return _counts(*store.load_graph(n.sparkSession, path))


_add(
    "saved_delta", _delta,
    f", gone AS (SELECT id FROM nodes WHERE file = '{_FILE}' AND line % 2 <> 0) SELECT type, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM gone) GROUP BY 1 UNION ALL SELECT 'edge ' || type, count(*) FROM edges WHERE from_id NOT IN (SELECT id FROM gone) GROUP BY 1",
)
_add("without_file", lambda n, e: _counts(*store.without_file(n, e, _FILE)), f", left_ AS (SELECT * FROM nodes WHERE file <> '{_FILE}') SELECT type, count(*) AS n FROM left_ GROUP BY 1 UNION ALL SELECT 'edge ' || type, count(*) FROM edges WHERE from_id IN (SELECT id FROM left_) AND to_id IN (SELECT id FROM left_) GROUP BY 1")


def _manual(e, shift):
    at = F.lit("2024-01-01").cast("timestamp")
    return e.where("type = 'IMPORTS'").select("from_id", F.concat(F.lit("tpch::region::"), (F.substring_index("to_id", "::", -1).cast("int") + shift).cast("string")).alias("to_id"), F.lit("MANUAL").alias("type"), at.alias("at"), F.endswith(F.col("from_id"), F.lit("1")).alias("suppressed"))


_MANUAL = "ma AS (SELECT from_id, 'tpch::region::' || (split_part(to_id, '::', 3)::INT + 1) AS to_id, from_id LIKE '%1' AS suppressed FROM edges WHERE type = 'IMPORTS')"
_add("manual_edges", lambda n, e: store.upsert_edges(_manual(e, 1), _manual(e, 1).withColumn("suppressed", F.lit(False))).select("from_id", "to_id", "suppressed"), f", {_MANUAL} SELECT from_id, to_id, bool_or(suppressed) AS suppressed FROM ma GROUP BY ALL")
_add("manual_edges_pruned", lambda n, e: store.pruned_edges(_manual(e, 1), n).select("from_id", "to_id"), f", {_MANUAL} SELECT from_id, to_id FROM ma WHERE to_id IN (SELECT id FROM nodes)")
_add("manual_edges_loaded", lambda n, e: store.reinjected(e, _manual(e, 1), n).groupBy("type").agg(F.count("*").alias("n")), f", {_MANUAL} SELECT type, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT 'MANUAL', count(*) FROM ma WHERE NOT suppressed AND to_id IN (SELECT id FROM nodes)")
_add("index_snapshot", lambda n, e: store.index_snapshot(n, e).select("id", "fan_in", "fan_out", F.coalesce(F.size("targets"), F.lit(0)).alias("targets")), "SELECT id, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out, coalesce(o, 0)::INT AS targets FROM nodes LEFT JOIN (SELECT to_id AS id, count(*) AS i FROM edges GROUP BY 1) USING (id) LEFT JOIN (SELECT from_id AS id, count(*) AS o FROM edges GROUP BY 1) USING (id)")


def _halves(n, e):
    a, b = n.where("type <> 'function'"), n.where("type in ('function', 'struct')").withColumn("name", F.lit("other"))
    return store.merged(a, e.where("type = 'CALLS'"), b, e.where("type in ('CALLS', 'IMPORTS')"))


_add("merged", lambda n, e: _counts(*_halves(n, e)), "SELECT type, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'edge ' || type, count(*) FROM edges WHERE type IN ('CALLS', 'IMPORTS') GROUP BY 1")
_add("upserted_nodes", lambda n, e: store.upsert_nodes(n, n.where("line < 5").withColumn("name", F.upper("name"))).agg(F.count("*").alias("n"), F.count_if(F.col("name") == F.upper("name")).alias("upper")), "SELECT count(*) AS n, count(*) FILTER (line < 5 OR name = upper(name)) AS upper FROM nodes")
_sign = lambda n, shift: n.where("type = 'function'").select("id", F.concat(F.lit("f(a"), F.when(F.col("line") % shift == 0, F.lit(", b")).otherwise(F.lit("")), F.lit(") int")).alias("signature"))
_add("changed_signatures", lambda n, e: store.changed_signatures(_sign(n, 3), _sign(n, 4)).select("id", "before", "after", words.signature_change(F.col("before"), F.col("after")).alias("change")), "SELECT id, CASE WHEN line % 3 = 0 THEN 'f(a, b) int' ELSE 'f(a) int' END AS before, CASE WHEN line % 4 = 0 THEN 'f(a, b) int' ELSE 'f(a) int' END AS after, CASE WHEN line % 4 = 0 THEN 'Params: added ''b''' ELSE 'Params: removed ''b''' END AS change FROM nodes WHERE type = 'function' AND (line % 3 = 0) <> (line % 4 = 0)")
_add("shifted_fan_in", lambda n, e: store.shifted_fan_in(e, e.where("from_id not like '%7'"), 2), ", a AS (SELECT to_id AS id, count(*) AS before, count(*) FILTER (from_id NOT LIKE '%7') AS after FROM edges WHERE type = 'CALLS' GROUP BY 1) SELECT * FROM a WHERE before - after >= 2")
_add("stable_ids", lambda n, e: store.migrated_ids(n.withColumn("stable_id", F.concat(F.lit("s"), F.sha2("id", 256))), n.withColumns({"stable_id": F.lit("new"), "name": F.when(F.col("line") % 5 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name"))})).groupBy((F.col("stable_id") == "new").alias("fresh")).agg(F.count("*").alias("n")), "SELECT line % 5 = 0 AS fresh, count(*) AS n FROM nodes GROUP BY 1")
_add("fingerprints", lambda n, e: store.fingerprints(n, e.where("type <> 'CALLS'")), ", m AS (SELECT from_id AS id, type || '>' || to_id AS mark FROM edges WHERE type <> 'CALLS' UNION ALL SELECT to_id, type || '<' || from_id FROM edges WHERE type <> 'CALLS') SELECT id, sha1(any_value(type) || ':' || any_value(name) || '|' || coalesce(string_agg(mark, '|' ORDER BY mark), '')) AS fingerprint FROM nodes LEFT JOIN m USING (id) GROUP BY id")
_add("project_statistics", store.project_statistics, "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT file) FROM nodes) AS files, (SELECT count(DISTINCT package) FROM nodes) AS packages, (SELECT count(DISTINCT domain) FROM nodes) AS domains, 0::BIGINT AS manual")
_add("moved_centrality", lambda n, e: graph.moved_centrality(n.select("id", (F.col("line") / 100).alias("centrality")), n.where("line < 40").select("id", (F.col("line") % 7 / 100).alias("centrality")), 0.1).select("id", F.round("change", 6).alias("change")), "SELECT id, round(change, 6) AS change FROM (SELECT id, abs(line / 100.0 - CASE WHEN line < 40 THEN (line % 7) / 100.0 ELSE 0 END) AS change FROM nodes) WHERE change > 0.1")
_add("tests_for", lambda n, e: graph.tests_for(n, e, _seed(e, ROOT), F.col("file").like("customer/%")), ", st AS MATERIALIZED (SELECT DISTINCT to_id AS id, from_id AS nx FROM edges WHERE type = 'CALLS'), w(id, hop) AS (SELECT '" + ROOT + "', 0 UNION SELECT nx, hop + 1 FROM w JOIN st USING (id) JOIN nodes n ON n.id = w.id WHERE hop < 5 AND n.file NOT LIKE 'customer/%'), d AS (SELECT id, min(hop) AS hop FROM w GROUP BY 1) SELECT file, min(hop)::INT AS distance, CASE min(hop) WHEN 1 THEN 'critical' WHEN 2 THEN 'likely' ELSE 'peripheral' END AS priority FROM d JOIN nodes USING (id) WHERE file LIKE 'customer/%' GROUP BY 1")
_add("aggregated_impact", lambda n, e: graph.aggregated_impact(n, e, ROOT, 2), _bfs(f"SELECT '{ROOT}' AS id", _BACK, 2) + f"SELECT id, hop AS depth, {_LABEL} AS label, CASE hop WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM b WHERE hop > 0")


def _cross(n):
    kind = F.element_at(F.array(*map(F.lit, ("DEPLOYS", "CONSUMES", "MENTIONS", "RELATES_TO"))), F.col("line") % 4 + 1)
    return n.where("type in ('interface', 'struct')").select(F.lit("tpch::region::1").alias("from_id"), F.col("id").alias("to_id"), kind.alias("type"))


_add(
    "cross_domain_impact", lambda n, e: graph.cross_domain_impact(n, _cross(n), "tpch::region::1"),
    ", x AS (SELECT id, name, ['DEPLOYS', 'CONSUMES', 'MENTIONS', 'RELATES_TO'][line % 4 + 1] AS type FROM nodes WHERE type IN ('interface', 'struct')), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY name, id) AS r FROM x) "
    "SELECT id, name, type, CASE type WHEN 'DEPLOYS' THEN 'infra' WHEN 'CONSUMES' THEN 'api' ELSE 'related' END AS category FROM k WHERE r <= CASE type WHEN 'MENTIONS' THEN 15 WHEN 'RELATES_TO' THEN 10 ELSE 30 END ORDER BY category, name, id LIMIT 100",
)
_WEIGHT = "CASE edges.type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in graph.EDGE_WEIGHTS.items()) + " ELSE 0.5 END::DOUBLE"
_add(
    "spread_scores", lambda n, e: spread_scores(n, e, ROOT, 1).select("id", F.round("rank", 9).alias("rank")),
    f", ew AS (SELECT from_id AS f, to_id AS t, {_WEIGHT} * CASE WHEN x.domain <> y.domain THEN 0.5 ELSE 1.0 END AS w FROM edges LEFT JOIN nodes x ON x.id = from_id LEFT JOIN nodes y ON y.id = to_id), bo AS (SELECT f, t, w FROM ew UNION ALL SELECT t, f, w FROM ew), o AS (SELECT t, w, count(*) OVER () AS deg FROM bo WHERE f = '{ROOT}') "
    f"SELECT id, round(max(rank), 9) AS rank FROM (SELECT '{ROOT}' AS id, 1.0::DOUBLE AS rank UNION ALL SELECT t, w * 0.5 / (1 + log2(deg + 1)) FROM o) GROUP BY 1",
)
_ARROW = "CASE WHEN {0}.inc THEN ' ←[' || {0}.type || ']- ' ELSE ' →[' || {0}.type || ']→ ' END"
_add(
    "traversal_paths", lambda n, e: paths.paths(paths.predecessors(e, _seed(e, ROOT)), n),
    ", st AS MATERIALIZED (SELECT from_id AS a, to_id AS b, type, false AS inc FROM edges UNION ALL SELECT to_id, from_id, type, true FROM edges), "
    f"p1 AS MATERIALIZED (SELECT * FROM (SELECT b AS id, a AS parent, inc, type, row_number() OVER (PARTITION BY b ORDER BY a, inc, type) AS r FROM st WHERE a = '{ROOT}' AND b <> a AND type IN ('CALLS', 'IMPORTS', 'IMPLEMENTS')) WHERE r = 1), "
    f"p2 AS MATERIALIZED (SELECT * FROM (SELECT b AS id, a AS parent, st.inc, st.type, row_number() OVER (PARTITION BY b ORDER BY a, st.inc, st.type) AS r FROM st JOIN p1 ON a = p1.id WHERE st.type = 'CALLS' AND b <> '{ROOT}' AND b NOT IN (SELECT id FROM p1)) WHERE r = 1) "
    f"SELECT p1.id, x.name || {_ARROW.format('p1')} || n.name AS path, 1::INT AS hops FROM p1 JOIN nodes x ON x.id = parent JOIN nodes n ON n.id = p1.id "
    f"UNION ALL SELECT p2.id, x.name || {_ARROW.format('p1')} || m.name || {_ARROW.format('p2')} || n.name, 2 FROM p2 JOIN p1 ON p1.id = p2.parent JOIN nodes x ON x.id = p1.parent JOIN nodes m ON m.id = p1.id JOIN nodes n ON n.id = p2.id",
)
_UND = "un AS MATERIALIZED (SELECT DISTINCT from_id AS a, to_id AS b FROM edges WHERE from_id <> to_id UNION SELECT to_id, from_id FROM edges WHERE from_id <> to_id)"
_add("common_neighbours", lambda n, e: paths.common_neighbours(e), f", {_UND} SELECT e.a, e.b, count(*) AS common FROM un e JOIN un x ON x.a = e.a JOIN un y ON y.a = e.b AND y.b = x.b WHERE e.a < e.b GROUP BY 1, 2")


def _neighbour_overlaps(spark, d):
    """Customers as sessions that work on what their orders hold; every hundredth is asked about."""
    _, e = model.graph(spark, d)
    calls = e.where("type = 'CALLS'")
    work = calls.where("from_id like 'tpch::customer::%'").select(F.col("from_id").alias("session"), F.col("to_id").alias("order")).join(calls.select(F.col("from_id").alias("order"), F.col("to_id").alias("entity")), "order").select("session", "entity")
    asked = work.select("session").where("cast(substring_index(session, '::', -1) as long) % 100 = 0")
    return paths.neighbour_overlaps(work, asked, calls.where("from_id like 'tpch::part::%'"))


QUERIES["graph_neighbour_overlaps"] = (
    _neighbour_overlaps,
    f"WITH RECURSIVE {GRAPH_SQL}, wk AS MATERIALIZED (SELECT DISTINCT a.from_id AS session, b.to_id AS entity FROM edges a JOIN edges b ON b.from_id = a.to_id AND b.type = 'CALLS' WHERE a.type = 'CALLS' AND a.from_id LIKE 'tpch::customer::%'), "
    "me AS MATERIALIZED (SELECT * FROM wk WHERE split_part(session, '::', 3)::BIGINT % 100 = 0), un AS MATERIALIZED (SELECT from_id AS a, to_id AS b FROM edges WHERE type = 'CALLS' AND from_id LIKE 'tpch::part::%' AND from_id <> to_id UNION SELECT to_id, from_id FROM edges WHERE type = 'CALLS' AND from_id LIKE 'tpch::part::%' AND from_id <> to_id), "
    "sh AS MATERIALIZED (SELECT DISTINCT me.session, wk.session AS other FROM me JOIN wk USING (entity)), pr AS (SELECT DISTINCT me.session, wk.session AS other, un.a, un.b FROM me JOIN un ON un.a = me.entity JOIN wk ON wk.entity = un.b WHERE me.session <> wk.session AND (me.session, wk.session) NOT IN (SELECT (session, other) FROM sh)) "
    "SELECT session, other, string_agg(a || '→' || b, ', ' ORDER BY a, b) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY session, other ORDER BY a, b) AS r FROM pr) WHERE r <= 3 GROUP BY 1, 2",
)
_NAMES = "['parseRow', 'writeAll', 'query', 'getenvMap', 'runner', 'decodeAll'][p_partkey % 6 + 1]"
_SIGNS = "['', '(w io.Writer)', '(r io.Reader)'][p_size % 3 + 1]"
_table(
    "data_roles", "part", lambda p: p.select("p_partkey", data_role(F.element_at(F.array(*map(F.lit, ("parseRow", "writeAll", "query", "getenvMap", "runner", "decodeAll"))), (F.col("p_partkey") % 6 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("", "(w io.Writer)", "(r io.Reader)"))), (F.col("p_size") % 3 + 1).cast("int"))).alias("role")),
    f"SELECT p_partkey, CASE WHEN s LIKE '%io.Reader%' THEN 'source' WHEN n IN ('parseRow', 'decodeAll', 'getenvMap') THEN 'source' WHEN n = 'query' THEN 'sink' WHEN n = 'writeAll' AND s LIKE '%io.Writer%' THEN 'sink' END AS role FROM (SELECT p_partkey, {_NAMES} AS n, {_SIGNS} AS s FROM part)",
)
_add("entity_finder", lambda n, e: links.entity_finder("supplier#00000001", n, e, scalars.is_test_file(F.col("file"))), ", m AS (SELECT *, CASE WHEN type IN ('struct', 'interface') THEN 0 WHEN type IN ('function', 'method') THEN 1 ELSE 2 END::INT AS tier FROM nodes WHERE contains(lower(name), 'supplier#00000001') ORDER BY tier, strlen(file), file, id LIMIT 50) SELECT id, name, type, file, tier, (SELECT count(*) FROM edges WHERE to_id = m.id AND type = 'CALLS') AS callers, (SELECT count(*) FROM edges WHERE from_id = m.id AND type = 'CALLS') AS callees FROM m")

# symbol tables for the resolver: suppliers' nations stand for types, regions for their parents, parts for methods
_table(
    "typed_methods", "supplier nation part", lambda s, n, p: links.typed_methods(
        s.selectExpr("s_suppkey as site", "'f' as file", "concat('v', s_nationkey) as var", "concat('m', s_suppkey % 9) as func"), n.selectExpr("'f' as file", "concat('v', n_nationkey) as var", "concat('T', n_nationkey) as type"),
        n.selectExpr("concat('T', n_nationkey, '.m', n_nationkey % 9) as id", "concat('T', n_nationkey) as owner", "concat('m', n_nationkey % 9) as method").unionByName(n.selectExpr("concat('R', n_regionkey, '.m', n_regionkey) as id", "concat('R', n_regionkey) as owner", "concat('m', n_regionkey) as method").distinct()),
        n.selectExpr("concat('T', n_nationkey) as type", "concat('R', n_regionkey) as parent")),
    "SELECT s_suppkey AS site, CASE WHEN n_nationkey % 9 = s_suppkey % 9 THEN 'T' || n_nationkey || '.m' || (n_nationkey % 9) ELSE 'R' || n_regionkey || '.m' || n_regionkey END AS to_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 9 = s_suppkey % 9 OR n_regionkey = s_suppkey % 9",
)
_add("package_targets", lambda n, e: links.package_targets(n.where("type = 'struct'").select(F.col("id").alias("site"), "package", F.concat(F.lit("Customer#"), F.lpad((F.col("line") + 1).cast("string"), 9, "0")).alias("func")), n), "SELECT a.id AS site, min(b.id) AS to_id FROM nodes a JOIN nodes b ON b.package = a.package AND b.name = 'Customer#' || lpad((a.line + 1)::VARCHAR, 9, '0') WHERE a.type = 'struct' GROUP BY 1")
_add("file_links", lambda n, e: links.file_links(n.where("type = 'struct'").select(F.col("id").alias("section"), F.when(F.col("line") % 2 == 0, F.col("file")).otherwise(F.substring_index("file", "/", -1)).alias("path")), n.select("file").distinct()), ", fs AS (SELECT DISTINCT file FROM nodes), sx AS (SELECT file, file AS path FROM fs UNION SELECT file, split_part(file, '/', 2) FROM fs) SELECT DISTINCT id AS section, sx.file FROM (SELECT id, CASE WHEN line % 2 = 0 THEN file ELSE split_part(file, '/', 2) END AS path FROM nodes WHERE type = 'struct') JOIN sx USING (path)")
_add("block_links", lambda n, e: links.block_links(n.where("type = 'file'").select(F.col("id").alias("section"), F.concat(F.lit("text NOPE\n```go\nuse "), "name", F.lit(" and "), "package", F.lit("\n```\n")).alias("text")), n.where("type in ('file', 'package')")), "SELECT DISTINCT s.id AS section, t.id AS to_id FROM (SELECT id, unnest([name, package]) AS w FROM nodes WHERE type = 'file') s JOIN nodes t ON t.name = s.w AND t.type IN ('file', 'package') WHERE length(s.w) >= 4 AND s.w NOT LIKE '% %'")
_add("name_matches", lambda n, e: links.cross_domain_mentions(n.select("id", F.concat(F.lit("Unit-"), (F.col("line") % 40).cast("string")).alias("name"), "type", "domain", "file").where("type in ('struct', 'interface')")), ", h AS (SELECT id, type, domain, regexp_replace(file, '/[^/]*$', '') AS dir, line % 40 AS k FROM nodes WHERE type IN ('struct', 'interface')) SELECT a.id AS from_id, b.id AS to_id, round(0.65 + 0.1 + CASE WHEN a.dir = b.dir THEN 0.1 ELSE 0 END, 2)::DOUBLE AS confidence FROM h a JOIN h b ON a.k = b.k AND a.domain = 'code' AND b.domain = 'infra' WHERE strlen('unit' || a.k) >= 4")
_add("references", lambda n, e: links.reference_edges(n.where("type = 'interface'").select(F.col("id").alias("from_id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("line") * 2).cast("string"), 9, "0")).alias("ref")), n), "SELECT DISTINCT a.id AS from_id, b.id AS to_id FROM nodes a JOIN nodes b ON b.name = 'Supplier#' || lpad((a.line * 2)::VARCHAR, 9, '0') WHERE a.type = 'interface' AND a.id <> b.id")
_add("acyclic", lambda n, e: orders.acyclic(e.where("from_id like 'tpch::part%' and to_id like 'tpch::part%' and type = 'CALLS'")), None)


def _order_of_rest(n, e):
    """Nodes that are on no cycle of what is left of a graph full of cycles: all of them, if none is left."""
    mutual = e.where("type in ('DEPENDS_ON', 'IMPLEMENTS')")
    every = mutual.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return every.join(orders.strong_components(cut(orders.acyclic(mutual), "acyclic")).select("id"), "id", "left_anti")


_add("acyclic_order", _order_of_rest, "SELECT from_id AS id FROM edges WHERE type IN ('DEPENDS_ON', 'IMPLEMENTS') UNION SELECT to_id FROM edges WHERE type IN ('DEPENDS_ON', 'IMPLEMENTS')")
_add("components", lambda n, e: orders.strong_components(e.where("type = 'CALLS' and from_id like 'tpch::part::%'")), ", st AS MATERIALIZED (SELECT DISTINCT from_id, to_id FROM edges WHERE type = 'CALLS' AND from_id LIKE 'tpch::part::%' AND from_id <> to_id), w(id, start) AS (SELECT from_id, from_id FROM st UNION SELECT to_id, start FROM w JOIN st ON from_id = id), m AS (SELECT a.start AS id, min(a.id) AS component FROM w a JOIN w b ON a.id = b.start AND b.id = a.start GROUP BY 1) SELECT id, component FROM m WHERE component IN (SELECT component FROM m GROUP BY 1 HAVING count(*) > 1)")
_add("aliased_paths", lambda n, e: links.aliased_paths(n.select("file", F.col("file").alias("path")).distinct(), n.sparkSession.createDataFrame([("part/*", "src/*"), ("part/Brand#1*", "one/*"), ("orders/5-LOW.tbl", "low")], "pattern string, target string")), "SELECT DISTINCT file, file AS path, CASE WHEN file LIKE 'part/Brand#1%' THEN 'one/' || substr(file, 13) WHEN file LIKE 'part/%' THEN 'src/' || substr(file, 6) WHEN file = 'orders/5-LOW.tbl' THEN 'low' ELSE file END AS resolved FROM nodes")
_add("type_references", lambda n, e: links.type_references(n.where("type = 'struct'").select(F.col("id").alias("from_id"), F.concat(F.lit("pkg."), "package").alias("type")), n.where("type = 'package'")), "SELECT a.id AS from_id, b.id AS to_id FROM nodes a JOIN nodes b ON b.type = 'package' AND b.name = a.package WHERE a.type = 'struct'")
_table("task_links", "part region", lambda p, r: links.task_links(p.select(F.col("p_partkey").alias("task_id"), F.concat("p_name", F.lit(" for "), F.element_at(F.array(*map(F.lit, ("africa", "asia", "europe"))), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("text")), r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))), "SELECT p_partkey AS task_id, r_regionkey AS node_id, 1::INT AS rank FROM part JOIN region ON lower(r_name) = ['africa', 'asia', 'europe'][p_partkey % 3 + 1]")
_table("concepts", "region nation", lambda r, n: links.concepts(n.select(F.col("n_nationkey").alias("section"), F.concat(F.lit("in `"), "n_name", F.lit("` we use TokenBucket and `Rate Card`")).alias("text")), r.select(F.col("r_name").alias("name")).unionByName(n.where("n_nationkey < 5").select(F.col("n_name").alias("name"))))[0].select("id", "confidence"), "SELECT 'concept::' || lower(n_name) AS id, 0.9::DOUBLE AS confidence FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT 'concept::tokenbucket', 0.75 UNION ALL SELECT 'concept::rate card', 0.9")
_unit = "aggregate(zip_with(embedding, embedding, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)"


def _vectors(v):
    return v.select(F.col("vec_id").alias("id"), "label", F.expr(f"transform(embedding, x -> cast(x as double) / sqrt({_unit}))").alias("vector"))


_UNIT = "u AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS vector FROM embeddings)"
_KNN = f"{_UNIT}, kn AS (SELECT * FROM (SELECT a.id AS left_id, b.id AS right_id, list_dot_product(a.vector, b.vector) AS score, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.vector, b.vector), 9) DESC, b.id) AS r FROM u a JOIN u b ON true WHERE a.id % 100 = 0 AND list_dot_product(a.vector, b.vector) >= 0.1) WHERE r <= 10)"
_near = lambda v: nearest.exact(_vectors(v).where("id % 100 = 0"), _vectors(v), 10, 0.1)
_table("nearest", "embeddings", lambda v: _near(v).select("left_id", "right_id", F.round("score", 6).alias("score")), f"WITH {_KNN} SELECT left_id, right_id, round(score, 6) AS score FROM kn")
_indexed = lambda v, k: nearest.search(nearest.build(_vectors(v)), _vectors(v).where("id % 100 = 0"), k, 0.1)
_table("indexed_nearest", "embeddings", lambda v: _indexed(v, 10).select("left_id", "right_id", F.round("score", 6).alias("score")), None)
_table("indexed_first", "embeddings", lambda v: _indexed(v, 1).select("left_id", "right_id", F.round("score", 6).alias("score")), f"WITH {_KNN} SELECT left_id, right_id, round(score, 6) AS score FROM kn WHERE r = 1")
_table("embedded_relations", "embeddings", lambda v: links.embedded_relations(_near(v), _near(v).where("right_id % 2 = 0").select(F.col("right_id").alias("from_id"), F.col("left_id").alias("to_id"))).select("a", "b", F.round("score", 6).alias("score")), f"WITH {_KNN}, p AS (SELECT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b, max(score) AS score, bool_or(right_id % 2 = 0) AS linked FROM kn WHERE left_id <> right_id GROUP BY 1, 2) SELECT a, b, round(score, 6) AS score FROM p WHERE NOT linked")
_table(
    "embedded_doc_links", "embeddings", lambda v: links.embedded_doc_links(v.selectExpr("vec_id % 50 as section", "vec_id as to_id", "case vec_id % 3 when 0 then 'entity' when 1 then 'file' else 'module' end as level", "(vec_id * 37 % 100) / 100.0D as score")),
    "WITH m AS (SELECT vec_id % 50 AS section, vec_id AS to_id, ['entity', 'file', 'module'][vec_id % 3 + 1] AS level, (vec_id * 37 % 100) / 100.0::DOUBLE AS score, vec_id % 3 AS o FROM embeddings), g AS (SELECT * FROM m WHERE score >= CASE level WHEN 'entity' THEN 0.6 WHEN 'file' THEN 0.55 ELSE 0.5 END), "
    "f AS (SELECT *, min(o) OVER (PARTITION BY section) AS best FROM g) SELECT section, to_id, level, score FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, to_id) AS r FROM f WHERE o = best) WHERE r <= 3",
)
_add("cross_repo_calls", lambda n, e: federation.cross_repo_calls(e.select(F.concat(F.when(F.endswith(F.col("from_id"), F.lit("3")), F.lit("other")).otherwise(F.lit("tpch")), F.expr("substring(from_id, 5)")).alias("from_id"), "to_id", "type")), "SELECT 'other' AS from_repo, 'tpch' AS to_repo, count(*) AS calls FROM edges WHERE type = 'CALLS' AND from_id LIKE '%3'")

# federation: parts of two brands stand for the projects
_part = lambda n, at: n.where("type = 'function'").where(F.col("line") % 2 == at).select("id", "name", F.concat(F.lit("f("), (F.col("line") % 7).cast("string"), F.lit(")")).alias("signature"))
_add("federated_search", lambda n, e: federation.find_entities({"a": _part(n, 0), "b": _part(n, 1)}, "cold", 5), "SELECT project, id, name FROM (SELECT CASE line % 2 WHEN 0 THEN 'a' ELSE 'b' END AS project, id, name, row_number() OVER (PARTITION BY line % 2 ORDER BY name, id) AS r FROM nodes WHERE type = 'function' AND contains(lower(name), 'cold')) WHERE r <= 5")
_deps = lambda n: n.where("type = 'function'").select(F.lit("b").alias("project"), F.col("name").alias("entity"), F.col("file").alias("used_in"), F.when(F.col("line") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("f("), (F.col("line") % 5).cast("string"), F.lit(")"))).alias("verified_signature"))
_DRIFT = "dp AS (SELECT name AS entity, file AS used_in, CASE WHEN line % 3 = 0 THEN '' ELSE 'f(' || (line % 5) || ')' END AS v FROM nodes WHERE type = 'function'), th AS (SELECT name AS entity, min('f(' || (line % 7) || ')') AS s FROM nodes WHERE type = 'function' AND line % 2 = 1 GROUP BY 1)"
_add("dependency_drift", lambda n, e: federation.drift(_deps(n), {"b": _part(n, 1)}).groupBy("change").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities")), f", {_DRIFT} SELECT CASE WHEN s IS NULL THEN 'removed' ELSE 'signature_changed' END AS change, count(*) AS n, count(DISTINCT entity) AS entities FROM dp LEFT JOIN th USING (entity) WHERE s IS NULL OR (v <> '' AND v <> s) GROUP BY 1")
_add("detected_dependencies", lambda n, e: federation.detected(n.where("type = 'struct'").select("file", F.concat(F.lit("import { "), "name", F.lit(" } from '@proj/"), F.lower("package"), F.lit("'")).alias("text")), n.where("type = 'package'").select(F.lower("name").alias("module"), "id")), "SELECT DISTINCT a.file, b.id FROM nodes a JOIN nodes b ON b.type = 'package' AND lower(b.name) = lower(a.package) WHERE a.type = 'struct'")
_add("merged_alerts", lambda n, e: federation.merged_alerts(n.where("type = 'struct'").select(F.col("package").alias("entity"), "file", F.concat(F.lit("c"), (F.col("line") % 3).cast("string")).alias("caller"))), "SELECT package AS entity, file, string_agg(DISTINCT 'c' || (line % 3), ',' ORDER BY 'c' || (line % 3)) AS callers FROM nodes WHERE type = 'struct' GROUP BY 1, 2")

# rules
_add("path_rules", lambda n, e: rules.path_violations(n, e, [("far", "error", ("CALLS", "DEPENDS_ON"), F.col("type") == "method", F.col("package") == "AFRICA")]), "SELECT DISTINCT 'far' AS rule_id, 'error' AS severity, a.from_id AS start_id, b.to_id AS end_id FROM edges a JOIN edges b ON a.to_id = b.from_id AND a.type = 'CALLS' AND b.type = 'DEPENDS_ON' JOIN nodes x ON x.id = a.from_id AND x.type = 'method' JOIN nodes y ON y.id = b.to_id AND y.package = 'AFRICA'")
_add("verified_changes", lambda n, e: rules.verification(store.changed_signatures(_sign(n, 3), _sign(n, 4)), e, 12), ", ch AS (SELECT id FROM nodes WHERE type = 'function' AND (line % 3 = 0) <> (line % 4 = 0)), ca AS (SELECT to_id AS id, count(DISTINCT from_id) AS callers FROM edges WHERE type = 'CALLS' GROUP BY 1) SELECT id, coalesce(callers, 0) AS callers, coalesce(callers, 0) >= 12 AS high_fan_in FROM ch LEFT JOIN ca USING (id)")
_add("claims", lambda n, e: rules.verified_claims(n.where("type = 'function'").select("id", F.element_at(F.array(*map(F.lit, ("widely used", "untested", "leaf function", "hello"))), F.col("line") % 4 + 1).alias("claim")), n, e, F.col("file").like("customer/%")), None)
_add("review_summary", lambda n, e: rules.review_summary(graph.impact(e, _seed(e, ROOT), 3), n, F.col("file").like("customer/%")), _bfs(f"SELECT '{ROOT}' AS id", _BACK, 3) + "SELECT count(*) FILTER (hop = 1) AS direct, count(*) FILTER (hop > 1) AS transitive, count(DISTINCT file) AS files, count(*) FILTER (file LIKE 'customer/%') AS tests FROM b JOIN nodes USING (id) WHERE hop > 0")
_table(
    "line_coverage", "lineitem orders",
    lambda li, o: resolve.coverage(
        li.selectExpr("cast(l_suppkey % 10 as string) as file", "cast(l_partkey as int) as start", "cast(l_partkey + l_quantity as int) as end", "cast(l_linenumber as int) as statements", "cast(l_quantity % 3 as int) as count"),
        o.selectExpr("o_orderkey as id", "cast(o_custkey % 11 as string) as file", "cast(o_orderkey % 3000 as int) as first", "cast(o_orderkey % 3000 + 20 as int) as last"),
    ),
    "SELECT o_orderkey AS id, round(100 * sum(CASE WHEN l_quantity::INT % 3 > 0 THEN l_linenumber ELSE 0 END)::DOUBLE / sum(l_linenumber), 2) AS covered_pct FROM orders JOIN lineitem ON l_suppkey % 10 = o_custkey % 11 AND (l_partkey + l_quantity)::INT >= o_orderkey % 3000 AND l_partkey <= o_orderkey % 3000 + 20 GROUP BY 1",
)
_add(
    "explained", lambda n, e: handlers.explained(n, e, scalars.is_test_file(F.col("file"))),
    ", rf AS MATERIALIZED (SELECT n.*, r.v FROM nodes n JOIN (SELECT to_id, count(*) AS v FROM edges WHERE type NOT IN ('DEFINES', 'IMPORTS') GROUP BY 1) r ON r.to_id = n.id) "
    "SELECT 'scale' AS section, 1::INT AS place, 'files' AS name, count(*) AS value FROM nodes WHERE type = 'file' UNION ALL SELECT 'scale', 2, 'functions', count(*) FROM nodes WHERE type IN ('function', 'method') UNION ALL SELECT 'scale', 3, 'structs', count(*) FROM nodes WHERE type = 'struct' UNION ALL SELECT 'scale', 4, 'edges', count(*) FROM edges "
    "UNION ALL SELECT 'types', r::INT, name, v FROM (SELECT name, v, row_number() OVER (ORDER BY v DESC, id) AS r FROM rf WHERE type IN ('struct', 'interface')) WHERE r <= 10 "
    "UNION ALL SELECT 'packages', r::INT, package, v FROM (SELECT package, sum(v)::BIGINT AS v, row_number() OVER (ORDER BY sum(v) DESC, package) AS r FROM rf GROUP BY 1) WHERE r <= 12",
)


def _working_state(spark, d):
    """Orders as changes of their customers' files, in the last days of the table."""
    n, e = model.graph(spark, d)
    customers = n.where("type = 'struct'").select("id", "file")
    changed = model.table(spark, d, "orders").select(F.concat(F.lit("tpch::customer::"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderdate").cast("timestamp").alias("at")).join(customers, "id").select("file", "at")
    return handlers.working_state(changed, n, e.withColumn("type", F.when(F.col("type") == "DEFINES", "CALLS").otherwise(F.col("type"))).unionByName(e.where("type = 'CALLS' and from_id like 'tpch::customer::%'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type")), F.lit("1998-08-01").cast("timestamp"), 60 * 24 * 20).withColumn("last", F.col("last").cast("string"))


QUERIES["graph_working_state"] = (
    _working_state,
    f"WITH {GRAPH_SQL}, ch AS (SELECT file, o_orderdate::TIMESTAMP AS t FROM orders JOIN nodes ON id = 'tpch::customer::' || o_custkey), re AS MATERIALIZED (SELECT file, count(*) AS changed, max(t) AS last FROM ch WHERE t > TIMESTAMP '1998-07-12' AND t <= TIMESTAMP '1998-08-01' GROUP BY 1), "
    "la AS MATERIALIZED (SELECT file FROM re ORDER BY last DESC, file LIMIT 5), ca AS (SELECT to_id AS id FROM edges WHERE type IN ('CALLS', 'DEFINES') UNION ALL SELECT from_id FROM edges WHERE type = 'CALLS' AND from_id LIKE 'tpch::customer::%'), "
    "en AS (SELECT n.id, n.file, count(*) AS callers FROM ca JOIN nodes n USING (id) WHERE n.file IN (SELECT file FROM la) GROUP BY 1, 2 HAVING count(*) > 3) SELECT file, changed, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, id, coalesce(callers, 0) AS callers FROM re LEFT JOIN en USING (file)",
)


def _call_stages(n, e):
    """Customers as callers: of parts by name, in a brand that an alias names, their own or one that their file imports."""
    callers = n.where("type = 'struct'")
    names = n.where("type = 'function'").select(F.col("id").alias("part"), F.col("name").alias("func"))
    sites = callers.withColumn("part", F.concat(F.lit("tpch::part::"), (F.col("line") % 200).cast("string"))).join(names, "part").selectExpr(
        "id as site", "id as caller_id", "name as caller_name", "concat('Brand#', cast(11 + line % 5 as string)) as package", "file", "case line % 3 when 0 then 'br' when 2 then 'x' end as alias", "func",
    )
    files = callers.select("file").distinct()
    imports = files.selectExpr("file", "inline(array(named_struct('alias', 'br', 'path', concat('lib/Brand#', cast(21 + length(file) % 5 as string))), named_struct('alias', 'other', 'path', concat('lib/Brand#', cast(31 + length(file) % 5 as string)))))")
    nothing = files.limit(0)
    return calls.resolved(sites, n, imports, nothing.selectExpr("file", "file as var", "file as type"), nothing.selectExpr("file as type", "file as parent")).select("site", "to_id", "stage")


_add(
    "call_stages", _call_stages,
    ", si AS MATERIALIZED (SELECT a.id AS site, 'Brand#' || (11 + a.line % 5) AS package, 'Brand#' || (21 + length(a.file) % 5) AS b2, 'Brand#' || (31 + length(a.file) % 5) AS b3, a.line % 3 AS k, p.name AS func FROM nodes a JOIN nodes p ON p.id = 'tpch::part::' || (a.line % 200) WHERE a.type = 'struct'), "
    "fn AS MATERIALIZED (SELECT package, name AS func, min(id) AS to_id FROM nodes WHERE type = 'function' GROUP BY 1, 2), "
    "al AS (SELECT site, coalesce(CASE WHEN k = 0 THEN x2.to_id END, x1.to_id, x2.to_id, x3.to_id) AS to_id, CASE WHEN k = 0 AND x2.to_id IS NOT NULL THEN 2 WHEN x1.to_id IS NOT NULL THEN 4 ELSE 5 END::INT AS stage "
    "FROM si LEFT JOIN fn x1 ON x1.package = si.package AND x1.func = si.func LEFT JOIN fn x2 ON x2.package = b2 AND x2.func = si.func LEFT JOIN fn x3 ON x3.package = b3 AND x3.func = si.func) SELECT * FROM al WHERE to_id IS NOT NULL",
)


def _log(o):
    """Orders as commits on the files of parts."""
    return o.selectExpr("cast(o_orderkey as string) as hash", "o_orderpriority as author", "cast(o_orderdate as timestamp) as at", "o_orderstatus as subject", "concat('part/Brand#', cast(11 + o_custkey % 45 as string), '.tbl') as file")


def _refreshed(spark, d):
    """A first pass over half of the log's files, refreshed for the others."""
    n, _ = model.graph(spark, d)
    log, today = _log(model.table(spark, d, "orders")), F.lit("1998-08-01").cast("date")
    odd = log.select("file").distinct().where("crc32(cast(file as binary)) % 2 = 1")
    first = enrichment.enriched(n, log.join(odd, "file", "left_anti"), today)
    return enrichment.refreshed(first, n, log, odd, today)


QUERIES["graph_enriched"] = (
    _refreshed,
    f"WITH {GRAPH_SQL}, lg AS (SELECT o_orderkey::VARCHAR AS hash, o_orderpriority AS author, o_orderdate::DATE AS day, o_orderstatus AS subject, 'part/Brand#' || (11 + o_custkey % 45) || '.tbl' AS file FROM orders WHERE o_orderdate::DATE <= DATE '1998-08-01'), "
    "la AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY day DESC, hash DESC) AS r, count(*) FILTER (day > DATE '1998-08-01' - 90) OVER (PARTITION BY file) AS churn FROM lg) "
    "SELECT n.id, n.file, author AS blame_author, day::VARCHAR AS blame_date, hash AS blame_commit, subject AS blame_subject, churn, round((DATE '1998-08-01' - day) * ln(1 + churn), 1)::DOUBLE AS staleness FROM la JOIN nodes n USING (file) WHERE r = 1 AND n.type IN ('function', 'method')",
)


def _suite(spark, d):
    """Do the parts of an order tell its suppliers? For each priority, against what the lines say."""
    lines, parts = (model.table(spark, d, t) for t in ("lineitem", "orders"))
    asked = lines.join(parts, lines.l_orderkey == parts.o_orderkey)
    expected = asked.selectExpr("o_orderpriority as scenario", "o_orderkey as query_id", "l_suppkey as id")
    returned = asked.selectExpr("o_orderpriority as scenario", "o_orderkey as query_id", "if(l_linenumber % 2 = 0, l_suppkey, l_partkey % 7) as id")
    limits = parts.selectExpr("o_orderpriority as scenario").distinct().withColumn("threshold", F.when(F.col("scenario") == "1-URGENT", 0.99).otherwise(0.1)).unionByName(spark.createDataFrame([("none", 0.5)], "scenario string, threshold double"))
    return ranking.suite(expected, returned, limits)


QUERIES["graph_scenarios"] = (
    _suite,
    "WITH a AS (SELECT o_orderpriority AS scenario, o_orderkey AS query_id, l_suppkey AS e, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey ELSE l_partkey % 7 END AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "k AS (SELECT scenario, query_id, count(*) AS k FROM (SELECT scenario, query_id, e AS id FROM a INTERSECT SELECT scenario, query_id, r FROM a) GROUP BY 1, 2), "
    "q AS (SELECT scenario, query_id, coalesce(k, 0)::DOUBLE / count(DISTINCT r) AS p, coalesce(k, 0)::DOUBLE / count(DISTINCT e) AS rc FROM a LEFT JOIN k USING (scenario, query_id) GROUP BY scenario, query_id, k), "
    "f AS (SELECT *, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END AS f1 FROM q), s AS (SELECT scenario, count(*) AS queries, avg(p) AS p, avg(rc) AS rc, avg(f1) AS f1 FROM f GROUP BY 1 UNION ALL SELECT 'none', 0, 0, 0, 0) "
    "SELECT scenario, queries, round(p, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, f1 >= CASE scenario WHEN '1-URGENT' THEN 0.99 WHEN 'none' THEN 0.5 ELSE 0.1 END AS passed FROM s "
    "UNION ALL SELECT NULL, count(*), round(avg(p), 6), round(avg(rc), 6), round(avg(f1), 6), false FROM f",
)
