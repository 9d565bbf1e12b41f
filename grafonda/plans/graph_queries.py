"""Filters, traversals, scores, rules and derived edges over the property graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import carve, carves, dsl, graph, model, orders, resolve, rules
from ..operators.model import GRAPH_SQL
from ..operators.work import cut

QUERIES: dict = {}
ROOT = "tpch::part::5"
SUPPLIER = "tpch::supplier::1"


def _add(name, run, sql):
    """run(nodes, edges) as a query of (spark, sf_dir)."""
    QUERIES[f"graph_{name}"] = (lambda spark, d: run(*model.graph(spark, d)), f"WITH RECURSIVE {GRAPH_SQL} {sql}" if sql else None)


def _seed(df, *ids):
    return df.sparkSession.createDataFrame([(x,) for x in ids], "id string")


_DEG = "(SELECT n.*, coalesce(i.c, 0) AS fanin, coalesce(o.c, 0) AS fanout FROM nodes n LEFT JOIN (SELECT to_id, count(*) c FROM edges GROUP BY 1) i ON i.to_id = n.id LEFT JOIN (SELECT from_id, count(*) c FROM edges GROUP BY 1) o ON o.from_id = n.id)"
for _name, _q, _w in (
    ("node_filter", 'NODES WHERE type="function" AND fanin > 30', "type = 'function' AND fanin > 30"),
    ("filter_file_contains", 'NODES WHERE file="BRAND#1" AND exported=true', "contains(lower(file), 'brand#1') AND exported"),
    ("filter_domain", 'nodes where domain = infra and fanout >= 10 and package != "asia"', "lower(domain) = 'infra' AND fanout >= 10 AND NOT contains(lower(package), 'asia')"),
    ("filter_name", 'NODES WHERE name="order.7" AND fanin <= 1', "lower(name) = 'order.7' AND fanin <= 1"),
):
    _add(_name, lambda n, e, q=_q: dsl.select_nodes(q, n, e), f"SELECT * FROM {_DEG} WHERE {_w}")

_add("find_by_name", lambda n, e: n.where((F.lower("name") == "7") | (F.lower(F.substring_index("name", ".", -1)) == "7")), "SELECT * FROM nodes WHERE lower(name) = '7' OR lower(regexp_extract(name, '[^.]*$')) = '7'")
_add("find_by_substring", lambda n, e: n.where(F.contains(F.lower("name"), F.lit("order.1"))).orderBy("id").limit(20), "SELECT * FROM nodes WHERE contains(lower(name), 'order.1') ORDER BY id LIMIT 20")
_add("find_by_file", lambda n, e: n.where((F.col("file") == "region.tbl") | F.endswith("file", F.lit("/region.tbl"))), "SELECT * FROM nodes WHERE file = 'region.tbl' OR suffix(file, '/region.tbl')")
_add("find_by_type", lambda n, e: n.where("type = 'interface'").orderBy("id"), "SELECT * FROM nodes WHERE type = 'interface'")
_add("edges_by_file", lambda n, e: e.join(n.where("file = 'region/region.tbl'").select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id", "type"), "SELECT from_id, to_id, e.type FROM edges e WHERE to_id IN (SELECT id FROM nodes WHERE file = 'region/region.tbl')")
_add("edge_counts", lambda n, e: e.groupBy("type").agg(F.count("*").alias("n")), "SELECT type, count(*) AS n FROM edges GROUP BY 1")
_add("node_counts", lambda n, e: n.groupBy("type", "domain").agg(F.count("*").alias("n"), F.sum(F.col("exported").cast("long")).alias("exported")), "SELECT type, domain, count(*) AS n, sum(exported::BIGINT)::BIGINT AS exported FROM nodes GROUP BY ALL")
_add("degrees", dsl.degrees, f"SELECT * FROM {_DEG}")
_add("connectivity", lambda n, e: e.where("type not in ('DEFINES', 'IMPORTS')").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n")), "SELECT to_id AS id, count(*) AS n FROM edges WHERE type NOT IN ('DEFINES', 'IMPORTS') GROUP BY 1")
def _degree_sql(end, name):
    d = f"(SELECT coalesce(c, 0) AS d FROM nodes LEFT JOIN (SELECT {end} AS id, count(*) c FROM edges GROUP BY 1) USING (id))"
    at = lambda p: f"(SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS n FROM {d}) WHERE r = floor((n - 1) * {p} / 100) + 1)::BIGINT AS {name}_p{p}"
    return f"(SELECT max(d) FROM {d})::BIGINT AS {name}_max, {at(50)}, {at(95)}"


_add(
    "topology", graph.topology,
    "SELECT n AS nodes, e AS edges, c AS calls, o AS orphans, round(e / (n * (n - 1.0)), 9) AS density, round(100.0 * x / e, 6) AS cross_file_pct, " + _degree_sql("to_id", "fanin") + ", " + _degree_sql("from_id", "fanout")
    + " FROM (SELECT (SELECT count(*) FROM nodes) n, (SELECT count(*) FROM edges) e, (SELECT count(*) FROM edges WHERE type = 'CALLS') c, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT from_id FROM edges UNION SELECT to_id FROM edges)) o, "
    "(SELECT count(*) FROM edges JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE a.file <> b.file) x)",
)
_add("repo_map", lambda n, e: dsl.degrees(n, e).withColumn("dir", F.substring_index("file", "/", 1)).withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc(F.col("fanin") + F.col("fanout")), "id"))).where("rank <= 5").select("dir", "rank", "id", "fanin", "fanout"), f"SELECT * FROM (SELECT split_part(file, '/', 1) AS dir, row_number() OVER (PARTITION BY split_part(file, '/', 1) ORDER BY fanin + fanout DESC, id)::INT AS rank, id, fanin, fanout FROM {_DEG}) WHERE rank <= 5")
_add("identity", lambda n, e: dsl.degrees(n, e).where("type not in ('file', 'package')").withColumn("degree", F.col("fanin") + F.col("fanout")).orderBy(F.desc("degree"), "id").limit(10).select("id", "type", "degree"), f"SELECT id, type, fanin + fanout AS degree FROM {_DEG} WHERE type NOT IN ('file', 'package') ORDER BY 3 DESC, 1 LIMIT 10")
_USED = "type not in ('DEFINES', 'IMPORTS')"
_add(
    "dead_code", lambda n, e: dsl.degrees(n, e.where(_USED)).where("fanin = 0 and not exported").select("id", "type"),
    "SELECT id, type FROM nodes WHERE NOT exported AND id NOT IN (SELECT to_id FROM edges WHERE type NOT IN ('DEFINES', 'IMPORTS'))",
)
_add("directory_coupling", graph.directory_coupling, "SELECT from_dir, to_dir, callers, leaving, round(callers::DOUBLE / leaving, 2) AS confidence FROM (SELECT a.d AS from_dir, b.d AS to_dir, count(DISTINCT from_id) AS callers FROM edges JOIN (SELECT id, split_part(file, '/', 1) d FROM nodes) a ON a.id = from_id JOIN (SELECT id, split_part(file, '/', 1) d FROM nodes) b ON b.id = to_id WHERE type = 'CALLS' AND a.d <> b.d GROUP BY ALL) JOIN (SELECT a.d AS from_dir, count(DISTINCT from_id) AS leaving FROM edges JOIN (SELECT id, split_part(file, '/', 1) d FROM nodes) a ON a.id = from_id JOIN (SELECT id, split_part(file, '/', 1) d FROM nodes) b ON b.id = to_id WHERE type = 'CALLS' AND a.d <> b.d GROUP BY ALL) USING (from_dir) WHERE callers::DOUBLE / leaving >= 0.85 AND callers >= 3 ORDER BY confidence DESC, callers DESC, from_dir, to_dir LIMIT 5")


def _bfs(start, step, depth):
    """SQL of hop levels: b(id, hop) at least distances, unrolled so that each level sees only new nodes."""
    parts = [f"st AS MATERIALIZED ({step})", f"b0 AS MATERIALIZED ({start})"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM b{j}" for j in range(k))
        parts.append(f"b{k} AS MATERIALIZED (SELECT DISTINCT st.nx AS id FROM b{k - 1} JOIN st ON st.id = b{k - 1}.id WHERE st.nx NOT IN ({seen}))")
    return ", " + ", ".join(parts) + ", b AS (" + " UNION ALL ".join(f"SELECT id, {k}::INT AS hop FROM b{k}" for k in range(depth + 1)) + ") "


_BACK = "SELECT DISTINCT to_id AS id, from_id AS nx FROM edges WHERE type IN ('CALLS', 'IMPLEMENTS')"
_ONE = f"SELECT '{ROOT}' AS id"
_LABEL = "CASE hop WHEN 1 THEN 'direct' WHEN 2 THEN 'indirect' ELSE 'peripheral' END"
_add("k_hop", lambda n, e: graph.reachable(e, _seed(e, ROOT), 2), _bfs(_ONE, "SELECT DISTINCT from_id AS id, to_id AS nx FROM edges", 2) + "SELECT * FROM b")
_add("undirected_k_hop", lambda n, e: graph.reachable(graph.undirected(e), _seed(e, SUPPLIER), 1), _bfs(f"SELECT '{SUPPLIER}' AS id", "SELECT DISTINCT from_id AS id, to_id AS nx FROM edges UNION SELECT to_id, from_id FROM edges", 1) + "SELECT * FROM b")
_add("impact", lambda n, e: graph.impact(e, _seed(e, ROOT), 3), _bfs(_ONE, _BACK, 3) + f"SELECT id, hop AS depth, {_LABEL} AS label, CASE hop WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM b WHERE hop > 0")
_add("changeset_impact", lambda n, e: graph.impact(e, n.where("file = 'part/Brand#11.tbl'"), 2), _bfs("SELECT id FROM nodes WHERE file = 'part/Brand#11.tbl'", _BACK, 2) + f"SELECT id, hop AS depth, {_LABEL} AS label, CASE hop WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM b WHERE hop > 0")
_add(
    "impact_tiers", lambda n, e: graph.impact_tiers(graph.impact(e, _seed(e, ROOT), 3), n),
    _bfs(_ONE, _BACK, 3) + f", nm AS (SELECT hop, name, file, row_number() OVER (PARTITION BY hop ORDER BY name, id) AS r FROM b JOIN nodes USING (id) WHERE hop > 0) SELECT hop AS depth, {_LABEL} AS label, count(*) AS total, count(DISTINCT file) AS files, "
    "string_agg(name, ',' ORDER BY name) FILTER (r <= 50) AS names, least(count(*), 50)::BIGINT AS listed FROM nm GROUP BY ALL",
)
_add(
    "call_chain", lambda n, e: graph.call_chain(e, SUPPLIER, "tpch::part::36", 4),
    ", st AS MATERIALIZED (SELECT DISTINCT from_id AS id, to_id AS nx FROM edges WHERE type IN ('CALLS', 'IMPLEMENTS', 'HANDLES') UNION SELECT to_id, from_id FROM edges WHERE type = 'IMPLEMENTS'), "
    f"w(id, path, hops) AS (SELECT '{SUPPLIER}', '{SUPPLIER}', 0 UNION SELECT nx, min(path || ' > ' || nx), any_value(hops) + 1 FROM w JOIN st USING (id) WHERE hops < 4 GROUP BY nx) "
    "SELECT hops::INT AS hops, min(path) AS path FROM w WHERE id = 'tpch::part::36' AND hops = (SELECT min(hops) FROM w WHERE id = 'tpch::part::36') GROUP BY 1",
)
_add("path_pattern", lambda n, e: graph.path_pattern(n, e, ["CALLS", "DEPENDS_ON"], F.col("type") == "method", F.col("package") == "ASIA"), "SELECT DISTINCT a.from_id AS start_id, b.to_id AS end_id FROM edges a JOIN edges b ON a.to_id = b.from_id AND a.type = 'CALLS' AND b.type = 'DEPENDS_ON' JOIN nodes x ON x.id = a.from_id AND x.type = 'method' JOIN nodes y ON y.id = b.to_id AND y.package = 'ASIA'")
_add(
    "data_flows", lambda n, e: graph.data_flows(e, n.where("type = 'struct' and exported"), n.where("type = 'function' and line = 1"), 4),
    ", st AS MATERIALIZED (SELECT DISTINCT from_id AS id, to_id AS nx FROM edges WHERE type = 'CALLS'), w(source, id, hop) AS (SELECT id, id, 0 FROM nodes WHERE type = 'struct' AND exported UNION SELECT source, nx, hop + 1 FROM w JOIN st USING (id) WHERE hop < 4) "
    "SELECT source, id AS sink, min(hop)::INT AS hop FROM w WHERE hop > 0 AND id IN (SELECT id FROM nodes WHERE type = 'function' AND line = 1) GROUP BY 1, 2",
)
_add("invalidated", lambda n, e: graph.invalidated(n, e, "part/Brand#13.tbl"), _bfs("SELECT id FROM nodes WHERE file = 'part/Brand#13.tbl'", "SELECT DISTINCT to_id AS id, from_id AS nx FROM edges WHERE type = 'CALLS'", 2) + "SELECT file FROM b JOIN nodes USING (id) UNION SELECT file FROM nodes WHERE package IN (SELECT package FROM nodes WHERE file = 'part/Brand#13.tbl')")
_W3 = "CASE type WHEN 'CALLS' THEN 1.0 WHEN 'IMPLEMENTS' THEN 0.7 ELSE 0.5 END::DOUBLE"
_add(
    "spreading_activation", lambda n, e: graph.spreading_activation(e, _seed(e, SUPPLIER)).select("id", F.round("activation", 9).alias("activation")),
    f", u AS MATERIALIZED (SELECT from_id AS f, to_id AS t, type FROM edges UNION ALL SELECT to_id, from_id, type FROM edges), l1 AS (SELECT t AS id, max({_W3} / n) AS a FROM (SELECT *, count(*) OVER () AS n FROM u WHERE f = '{SUPPLIER}' AND type IN ('CALLS', 'IMPORTS', 'IMPLEMENTS')) GROUP BY 1), "
    f"l2 AS (SELECT t AS id, max(a / n) AS a FROM (SELECT u.t, a, count(*) OVER (PARTITION BY u.f) AS n FROM u JOIN l1 ON l1.id = u.f WHERE type = 'CALLS' AND l1.id <> '{SUPPLIER}') GROUP BY 1) "
    f"SELECT id, round(max(a), 9) AS activation FROM (SELECT '{SUPPLIER}' AS id, 1.0::DOUBLE AS a, 0 AS hop UNION ALL SELECT id, a, 1 FROM l1 UNION ALL SELECT id, a, 2 FROM l2) GROUP BY 1 ORDER BY min(hop), max(a) DESC, 1 LIMIT 500",
)
_WEIGHT = "CASE edges.type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in graph.EDGE_WEIGHTS.items()) + " ELSE 0.5 END::DOUBLE"
_UNDIRECTED = "SELECT DISTINCT from_id AS id, to_id AS nx FROM edges UNION SELECT to_id, from_id FROM edges"


def _ppr_sql(final):
    """The walk over the 10,000 nearest nodes within six steps, until no rank moves by a millionth."""
    return _bfs(_ONE, _UNDIRECTED, graph.HORIZON).rstrip() + (
        f", c AS MATERIALIZED (SELECT id, hop FROM (SELECT *, row_number() OVER (ORDER BY hop, id) AS r FROM b) WHERE r <= {graph.CANDIDATES}), "
        f"ew AS (SELECT from_id AS f, to_id AS t, {_WEIGHT} * CASE WHEN x.domain <> y.domain THEN 0.5 ELSE 1.0 END AS w FROM edges JOIN c a ON a.id = from_id JOIN c b ON b.id = to_id LEFT JOIN nodes x ON x.id = from_id LEFT JOIN nodes y ON y.id = to_id), "
        "pw AS (SELECT f, t, sum(w) AS w FROM (SELECT f, t, w FROM ew UNION ALL SELECT t, f, w FROM ew) GROUP BY 1, 2), pp AS MATERIALIZED (SELECT f, t, w / sum(w) OVER (PARTITION BY f) AS p FROM pw), "
        f"it(k, id, rank, d) AS (SELECT 0, id, (id = '{ROOT}')::INT::DOUBLE, 1.0::DOUBLE FROM c UNION ALL SELECT k, id, rank, max(abs(rank - prev)) OVER () FROM (SELECT i.k + 1 AS k, i.id, 0.15 * (i.id = '{ROOT}')::INT + 0.85 * coalesce(g, 0) AS rank, i.rank AS prev "
        "FROM it i LEFT JOIN (SELECT t, sum(rank * p) AS g FROM it JOIN pp ON f = id GROUP BY 1) s ON s.t = i.id WHERE i.k < 100 AND i.d >= 1e-6)), last AS MATERIALIZED (SELECT id, rank FROM it WHERE k = (SELECT max(k) FROM it)) "
    ) + final


def _ranks(n, e):
    return graph.personalized_pagerank(n, e, ROOT).withColumn("rank", F.round("rank", 9))


_add("ppr", lambda n, e: _ranks(n, e).select("id", "rank"), _ppr_sql("SELECT id, round(rank, 9) AS rank FROM last"))


def _carve(n, e):
    quality = n.where("type = 'function'").select("id", (F.col("line") % 11 - 5).alias("quality"))
    return carve.carve(n, e, ROOT, 4000, ranks=_ranks(n, e), quality=quality).select("id", F.round("relevance", 6).alias("relevance"), "hop", "pool", "cost", "running")


_COST = "(strlen(id) + strlen(type) + strlen(name) + strlen(package) + strlen(file)) // 4 + 1"
_CARVED = (
    f", fl AS (SELECT id, bool_or(caller) AS caller, bool_or(callee) AS callee FROM (SELECT from_id AS id, type = 'CALLS' AS caller, false AS callee FROM edges WHERE to_id = '{ROOT}' AND from_id <> to_id UNION ALL SELECT to_id, false, type = 'CALLS' FROM edges WHERE from_id = '{ROOT}' AND from_id <> to_id) GROUP BY 1), "
    f"sc AS (SELECT id, CASE WHEN id = '{ROOT}' THEN 1.0 ELSE greatest(coalesce(round(rank, 9), 0), CASE WHEN caller OR callee THEN 0.05 ELSE 0 END) END AS rel, coalesce(caller, false) AS caller, coalesce(callee, false) AS callee FROM last FULL JOIN fl USING (id)), "
    "pr AS (SELECT id, caller, callee, caller AND row_number() OVER (PARTITION BY caller ORDER BY rel DESC, id) <= 10 AS kept, rel FROM sc WHERE rel > 0), "
    f"fi AS (SELECT id, caller, callee, CASE WHEN kept THEN greatest(rel, 0.02) ELSE rel END AS rel FROM pr WHERE kept OR rel >= 0.01 OR id = '{ROOT}'), "
    f"hp AS (SELECT n.*, caller, callee, rel, CASE WHEN id = '{ROOT}' THEN 0 ELSE round(abs(ln(rel) / ln(0.5))) END::INT AS hop FROM fi JOIN nodes n USING (id)), "
    f"bo AS (SELECT id, hop, CASE WHEN id = '{ROOT}' THEN 'root' WHEN caller THEN 'caller' WHEN callee THEN 'callee' ELSE 'other' END AS pool, ({_COST})::BIGINT AS cost, CASE WHEN id = '{ROOT}' THEN 1.0 WHEN type = 'function' THEN rel * (1 + 0.2 * tanh((line % 11 - 5) / 5.0)) ELSE rel END AS relevance FROM hp), "
    f"rs AS (SELECT *, sum(cost) OVER (PARTITION BY pool ORDER BY relevance DESC, hop, id ROWS UNBOUNDED PRECEDING)::BIGINT AS running, greatest(0, 4000 - (SELECT cost FROM bo WHERE id = '{ROOT}')) AS rest FROM bo) "
    "SELECT id, round(relevance, 6) AS relevance, hop, pool, cost, running FROM rs WHERE running <= CASE pool WHEN 'root' THEN 4000 WHEN 'other' THEN rest * 30 // 100 ELSE rest * 35 // 100 END"
)
_add("carve", _carve, _ppr_sql(_CARVED))
_add("carve_edges", lambda n, e: carve.induced(_carve(n, e), e), _ppr_sql(_CARVED.replace("SELECT id, round(relevance, 6) AS relevance, hop, pool, cost, running FROM rs", ", ke AS (SELECT id FROM rs") + ") SELECT from_id, to_id, type FROM edges WHERE from_id IN (SELECT id FROM ke) AND to_id IN (SELECT id FROM ke)"))


def _projects(n, e):
    return n.withColumn("project", F.lit("tpch")), e.withColumn("project", F.lit("tpch"))


def _many(n, e):
    """Every hundredth part as a root, one step around each."""
    nodes, edges = _projects(n, e)
    roots = n.where("type = 'function' and cast(substring_index(id, '::', -1) as long) % 100 = 0").select(F.lit("tpch").alias("project"), F.col("id").alias("root"))
    kept = carves.carved(nodes, edges, roots, 1500, 1)
    return cut(kept.withColumn("relevance", F.round("relevance", 6)), "many_carves"), nodes, edges


def _contexts(n, e):
    kept, nodes, edges = _many(n, e)
    here = lambda df: df.withColumn("project", F.lit("tpch"))
    notes = here(n.where("type = 'interface' and exported").select(F.col("id").alias("node_id"), (F.col("line") % 2 == 0).alias("stale")))
    memories = here(n.where("type = 'method'").select(F.col("id").alias("node_id"), (F.col("line") % 40).alias("memory_id")))
    broken = here(e.where("type = 'IMPLEMENTS'").select("from_id", "to_id"))
    quality = here(n.where("type = 'function' and line > 10").select(F.col("id").alias("root"), (F.col("line") - 30).cast("double").alias("quality"), F.lit(1).alias("signals")))
    return carves.contexts(kept, edges, broken, notes, memories, quality).drop("project")


_MANY = (
    f", ew AS MATERIALIZED (SELECT from_id AS f, to_id AS t, {_WEIGHT} * CASE WHEN x.domain <> y.domain THEN 0.5 ELSE 1.0 END AS w FROM edges LEFT JOIN nodes x ON x.id = from_id LEFT JOIN nodes y ON y.id = to_id), bo AS MATERIALIZED (SELECT f, t, w FROM ew UNION ALL SELECT t, f, w FROM ew), "
    "ro AS MATERIALIZED (SELECT id AS root FROM nodes WHERE type = 'function' AND split_part(id, '::', 3)::BIGINT % 100 = 0), dg AS MATERIALIZED (SELECT f, count(*) AS deg FROM bo GROUP BY 1), "
    "sp AS (SELECT root, id, max(rank) AS rank FROM (SELECT root, root AS id, 1.0::DOUBLE AS rank FROM ro UNION ALL SELECT root, t, w * 0.5 / (1 + log2(deg + 1)) FROM ro JOIN bo ON bo.f = root JOIN dg ON dg.f = root) GROUP BY 1, 2), "
    "fl AS (SELECT root, id, bool_or(caller) AS caller, bool_or(callee) AS callee FROM (SELECT to_id AS root, from_id AS id, type = 'CALLS' AS caller, false AS callee FROM edges WHERE to_id IN (SELECT root FROM ro) AND from_id <> to_id UNION ALL SELECT from_id, to_id, false, type = 'CALLS' FROM edges WHERE from_id IN (SELECT root FROM ro) AND from_id <> to_id) GROUP BY 1, 2), "
    "sc AS (SELECT root, id, CASE WHEN id = root THEN 1.0 ELSE greatest(coalesce(rank, 0), CASE WHEN caller OR callee THEN 0.05 ELSE 0 END) END AS rel, coalesce(caller, false) AS caller, coalesce(callee, false) AS callee FROM sp FULL JOIN fl USING (root, id)), "
    "pr AS (SELECT *, caller AND row_number() OVER (PARTITION BY root, caller ORDER BY rel DESC, id) <= 10 AS kept FROM sc WHERE rel > 0), "
    "fi AS (SELECT root, id, caller, callee, CASE WHEN kept THEN greatest(rel, 0.02) ELSE rel END AS rel FROM pr WHERE kept OR rel >= 0.01 OR id = root), "
    "hp AS (SELECT n.*, root, caller, callee, rel, CASE WHEN n.id = root THEN 0 ELSE round(abs(ln(rel) / ln(0.5))) END::INT AS hop FROM fi JOIN nodes n USING (id)), "
    f"po AS (SELECT root, id, hop, rel, CASE WHEN id = root THEN 'root' WHEN caller THEN 'caller' WHEN callee THEN 'callee' ELSE 'other' END AS pool, ({_COST})::BIGINT AS cost FROM hp), "
    "rs AS (SELECT *, sum(cost) OVER (PARTITION BY root, pool ORDER BY rel DESC, hop, id ROWS UNBOUNDED PRECEDING)::BIGINT AS running, greatest(0, 1500 - max(CASE WHEN id = root THEN cost END) OVER (PARTITION BY root)) AS rest FROM po), "
    "ke AS MATERIALIZED (SELECT root, id, round(rel, 6) AS relevance, hop, pool, cost, running FROM rs WHERE running <= CASE pool WHEN 'root' THEN 1500 WHEN 'other' THEN rest * 30 // 100 ELSE rest * 35 // 100 END) "
)
_HASHED = "ha AS (SELECT root, left(sha256(string_agg(part, '' ORDER BY part)), 12) AS hash FROM (SELECT root, id AS part FROM ke UNION ALL SELECT a.root, from_id || '>' || to_id || ':' || type FROM edges JOIN ke a ON a.id = from_id JOIN ke b ON b.id = to_id AND a.root = b.root) GROUP BY 1)"
_add("many_carves", lambda n, e: _many(n, e)[0].drop("project"), _MANY + "SELECT * FROM ke")
_add(
    "contexts", _contexts,
    _MANY + ", " + _HASHED + ", nt AS (SELECT root, count(*) AS notes, bool_or(line % 2 = 0) AS stale FROM ke JOIN nodes n USING (id) WHERE n.type = 'interface' AND n.exported GROUP BY 1), me AS (SELECT root, count(DISTINCT line % 40) AS memories FROM ke JOIN nodes n USING (id) WHERE n.type = 'method' GROUP BY 1), "
    "br AS (SELECT root, count(*) AS broken FROM (SELECT from_id AS root FROM edges WHERE type = 'IMPLEMENTS' UNION ALL SELECT to_id FROM edges WHERE type = 'IMPLEMENTS' AND from_id <> to_id) GROUP BY 1), "
    "pe AS (SELECT root, count(*) AS nodes, count(*) FILTER (pool = 'caller') AS callers, count(*) FILTER (pool = 'callee') AS callees, sum(cost)::BIGINT AS tokens FROM ke GROUP BY 1) "
    "SELECT pe.*, coalesce(notes, 0) AS notes, coalesce(memories, 0) AS memories, coalesce(broken, 0) AS broken_rules, hash, round(CASE WHEN q.line > 10 THEN 0.15 + 0.8 / (1 + exp(-(q.line - 30) / 2.0)) ELSE 0.75 END - CASE WHEN coalesce(stale, false) THEN 0.05 ELSE 0 END, 2) AS confidence "
    "FROM pe JOIN nodes q ON q.id = root LEFT JOIN nt USING (root) LEFT JOIN me USING (root) LEFT JOIN br USING (root) LEFT JOIN ha USING (root)",
)
_SECTION = "CASE WHEN to_id = '{0}' AND type = 'CALLS' THEN 'callers' WHEN from_id = '{0}' AND type = 'CALLS' THEN 'callees' ELSE 'related' END".format(ROOT)
_add(
    "carve_sections", lambda n, e: carve.directional(_carve(n, e), e, ROOT).groupBy("section").agg(F.count("*").alias("n")),
    _ppr_sql(_CARVED.replace("SELECT id, round(relevance, 6) AS relevance, hop, pool, cost, running FROM rs", ", ke AS (SELECT id FROM rs")
    + f"), se AS (SELECT CASE WHEN to_id = '{ROOT}' THEN from_id ELSE to_id END AS id, min({_SECTION}) AS section FROM edges WHERE from_id = '{ROOT}' OR to_id = '{ROOT}' GROUP BY 1) SELECT coalesce(section, 'related') AS section, count(*) AS n FROM ke LEFT JOIN se USING (id) WHERE id <> '{ROOT}' GROUP BY 1"),
)
_add(
    "eigenvector", lambda n, e: graph.eigenvector_centrality(e).select("id", F.round("centrality", 6).alias("centrality")),
    ", st AS MATERIALIZED (SELECT f, t, count(*) AS n FROM (SELECT from_id AS f, to_id AS t FROM edges UNION ALL SELECT to_id, from_id FROM edges) GROUP BY 1, 2), "
    "it(k, id, x, d) AS (SELECT 0, id, 1.0::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT f AS id FROM st) UNION ALL SELECT k, id, x, max(abs(x - prev)) OVER () FROM (SELECT k, id, y / max(y) OVER () AS x, prev FROM (SELECT i.k + 1 AS k, i.id, i.x + coalesce(g, 0) AS y, i.x AS prev "
    "FROM it i LEFT JOIN (SELECT t, sum(x * n) AS g FROM it JOIN st ON f = id GROUP BY 1) s ON s.t = i.id WHERE i.k < 50 AND i.d >= 1e-6))) SELECT id, round(x, 6) AS centrality FROM it WHERE k = (SELECT max(k) FROM it)",
)
_add("communities", lambda n, e: graph.label_propagation(e, 3), None)


def _settled(rounds):
    """SQL of label propagation over nations, their customers, suppliers and regions, in the order of ids: a kind of node at a time, as none
    has neighbours of its own kind."""
    parts = ["ee AS MATERIALIZED (SELECT DISTINCT from_id, to_id FROM edges WHERE type IN ('DEFINES', 'IMPORTS'))", "lk AS MATERIALIZED (SELECT id, nb, count(*) AS n FROM (SELECT from_id AS id, to_id AS nb FROM ee UNION ALL SELECT to_id, from_id FROM ee) GROUP BY 1, 2)", "s0 AS MATERIALIZED (SELECT DISTINCT id, id AS label FROM lk)"]
    k = 0
    for _ in range(rounds):
        for kind in ("customer", "nation", "region", "supplier"):
            votes = f"SELECT lk.id, p.label, row_number() OVER (PARTITION BY lk.id ORDER BY sum(n) DESC, p.label) AS r FROM lk JOIN s{k} p ON p.id = nb WHERE lk.id LIKE 'tpch::{kind}::%' GROUP BY 1, 2"
            parts.append(f"s{k + 1} AS MATERIALIZED (SELECT s.id, coalesce(v.label, s.label) AS label FROM s{k} s LEFT JOIN (SELECT * FROM ({votes}) WHERE r = 1) v USING (id))")
            k += 1
    return ", " + ", ".join(parts) + f" SELECT id, dense_rank() OVER (ORDER BY least) - 1 AS community FROM (SELECT id, min(id) OVER (PARTITION BY label) AS least FROM s{k})"


_add("ordered_communities", lambda n, e: orders.ordered_communities(e.where("type in ('DEFINES', 'IMPORTS')")), _settled(10))
_add(
    "longest_chain", lambda n, e: graph.longest_chain(e),
    ", st AS MATERIALIZED (SELECT DISTINCT from_id, to_id FROM edges WHERE type = 'CALLS' AND from_id <> to_id), w(id, k) AS (SELECT id, 0 FROM (SELECT from_id AS id FROM st UNION SELECT to_id FROM st) UNION SELECT to_id, k + 1 FROM w JOIN st ON from_id = id WHERE k < 40) "
    "SELECT id, max(k)::INT AS length FROM w GROUP BY 1 HAVING max(k) < 40",  # what is behind a cycle has chains of any length
)
_RULE = [("no_asia", "error", "struct", "method", "CALLS", "", "1-URGENT"), ("infra_calls", "warning", "interface", "function", "IMPLEMENTS", "asia", ""), ("empty", "error", "", "", "", "", "")]
_add("edge_rules", lambda n, e: rules.violations(n, e, e.sparkSession.createDataFrame(_RULE, rules.SCHEMA)), "SELECT 'no_asia' AS rule_id, 'error' AS severity, from_id, to_id, e.type FROM edges e JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE a.type = 'struct' AND b.type = 'method' AND e.type = 'CALLS' AND contains(lower(b.package), '1-urgent') UNION ALL SELECT 'infra_calls', 'warning', from_id, to_id, e.type FROM edges e JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE a.type = 'interface' AND b.type = 'function' AND e.type = 'IMPLEMENTS' AND contains(lower(a.package), 'asia')")
_GLOBS = [("urgent", "error", "", "", "CALLS", "", "", "orders/1-*.tbl", "part/Brand#1?.tbl", ""), ("name", "warning", "", "", "", "", "", "*.tbl", "", "Supplier#00000000"), ("none", "error", "", "", "", "", "", "1-*.tbl/x", "", "")]
_add(
    "rule_globs", lambda n, e: rules.violations(n, e, e.sparkSession.createDataFrame(_GLOBS, rules.SCHEMA + ", from_file string, to_file string, to_name string")),
    "SELECT 'urgent' AS rule_id, 'error' AS severity, from_id, to_id, e.type FROM edges e JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE e.type = 'CALLS' AND regexp_matches(a.file, '(^|/)orders/1-[^/]*\\.tbl$') AND regexp_matches(b.file, '(^|/)part/Brand#1[^/]\\.tbl$') "
    "UNION ALL SELECT 'name', 'warning', from_id, to_id, e.type FROM edges e JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE contains(b.name, 'Supplier#00000000') AND suffix(a.file, '.tbl')",
)
_add("what_if", lambda n, e: rules.what_if(n, e, _seed(e, "tpch::supplier::2"), _seed(e, "tpch::part::1", "tpch::part::2"), e.sparkSession.createDataFrame([("calls", "error", "interface", "function", "CALLS", "", "")], rules.SCHEMA)), "SELECT 'calls' AS rule_id, 'error' AS severity, 'tpch::supplier::2' AS from_id, id AS to_id, 'CALLS' AS type FROM nodes WHERE id IN ('tpch::part::1', 'tpch::part::2')")
_add("violation_log", lambda n, e: rules.log_of(rules.violations(n, e, e.sparkSession.createDataFrame(_RULE, rules.SCHEMA))), "SELECT rule_id, count(*) AS found, count(DISTINCT from_id) AS sources FROM (SELECT 'no_asia' AS rule_id, from_id FROM edges e JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE a.type = 'struct' AND b.type = 'method' AND e.type = 'CALLS' AND contains(lower(b.package), '1-urgent') UNION ALL SELECT 'infra_calls', from_id FROM edges e JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE a.type = 'interface' AND b.type = 'function' AND e.type = 'IMPLEMENTS' AND contains(lower(a.package), 'asia')) GROUP BY 1")
def _owned(e, kind, owner, method):
    return e.where(F.col("type") == kind).select(F.col(owner).alias("owner"), F.col(method).alias("method"))


_add(
    "structural_implements", lambda n, e: resolve.structural_implements(_owned(e, "IMPLEMENTS", "from_id", "to_id"), _owned(e, "DEPENDS_ON", "to_id", "from_id")),
    ", i AS (SELECT from_id AS owner, to_id AS method FROM edges WHERE type = 'IMPLEMENTS'), k AS (SELECT to_id AS owner, from_id AS method FROM edges WHERE type = 'DEPENDS_ON') "
    "SELECT interface, struct FROM (SELECT i.owner AS interface, k.owner AS struct, count(*) AS have FROM i JOIN k USING (method) GROUP BY ALL) JOIN (SELECT owner AS interface, count(*) AS need FROM i GROUP BY 1) USING (interface) WHERE have = need",
)
_add(
    "orphans", lambda n, e: resolve.orphaned(n.where("type = 'function'").select(F.concat(F.lit("tpch::part::"), (F.col("line") * 50).cast("string")).alias("ref")), n).distinct(),
    "SELECT DISTINCT 'tpch::part::' || (line * 50) AS ref FROM nodes WHERE type = 'function' AND 'tpch::part::' || (line * 50) NOT IN (SELECT id FROM nodes)",
)
_add("cross_domain", lambda n, e: e.join(n.select(F.col("id").alias("from_id"), F.col("domain").alias("from_domain")), "from_id").join(n.select(F.col("id").alias("to_id"), F.col("domain").alias("to_domain")), "to_id").where("from_domain <> to_domain").groupBy("from_domain", "to_domain", "type").agg(F.count("*").alias("n")), "SELECT a.domain AS from_domain, b.domain AS to_domain, e.type, count(*) AS n FROM edges e JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE a.domain <> b.domain GROUP BY ALL")
_add("best_node", lambda n, e: resolve.best_nodes(dsl.degrees(n, e).where("type in ('function', 'struct', 'interface')"), "package").select("package", "id", "tier"), f"SELECT package, id, tier FROM (SELECT package, id, t AS tier, row_number() OVER (PARTITION BY package ORDER BY t, fanin + fanout DESC, id) r FROM (SELECT *, CASE WHEN type IN ('struct', 'interface') THEN 1 WHEN type = 'function' AND exported THEN 2 WHEN type = 'function' THEN 3 ELSE 4 END::INT AS t FROM {_DEG} WHERE type IN ('function', 'struct', 'interface'))) WHERE r = 1")
