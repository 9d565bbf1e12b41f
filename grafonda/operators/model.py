"""The engine's tables as views of the driver's: a typed property graph, and telemetry facts of the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .work import shared_dir, spread

NODE_COLUMNS = ("id", "type", "name", "package", "file", "line", "exported", "domain")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"tpch::{kind}::"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, name, package, file, line, exported, domain."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))

    def shape(df, kind, key, type_, name, package, file, line, exported, domain):
        return df.select(_id(kind, key).alias("id"), F.lit(type_).alias("type"), F.expr(name).alias("name"), F.expr(package).alias("package"), F.expr(file).alias("file"), F.expr(line).cast("int").alias("line"), F.expr(exported).alias("exported"), F.lit(domain).alias("domain"))

    customer = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [
        shape(region, "region", "r_regionkey", "package", "r_name", "r_name", "'region/region.tbl'", "r_regionkey", "true", "docs"),
        shape(nation, "nation", "n_nationkey", "file", "n_name", "r_name", "'nation/' || r_name || '.tbl'", "n_nationkey", "true", "docs"),
        shape(customer, "customer", "c_custkey", "struct", "c_name", "r_name", "'customer/' || n_name || '.tbl'", "c_custkey", "c_acctbal > 0", "code"),
        shape(supplier, "supplier", "s_suppkey", "interface", "s_name", "r_name", "'supplier/' || n_name || '.tbl'", "s_suppkey", "s_acctbal > 0", "infra"),
        shape(table(spark, sf_dir, "part"), "part", "p_partkey", "function", "p_name", "p_brand", "'part/' || p_brand || '.tbl'", "p_size", "p_size > 25", "api"),
        shape(table(spark, sf_dir, "orders"), "orders", "o_orderkey", "method", "'Order.' || cast(o_orderkey as string)", "o_orderpriority", "'orders/' || o_orderpriority || '.tbl'", "o_orderkey", "false", "code"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _distinct(table: DataFrame, *by: str, rows: int = 1 << 19) -> DataFrame:
    """Distinct values of columns by, in tasks of about `rows` rows whatever the table's size. Few rows repeat: none are combined before the shuffle."""
    return spread(table.select(*by), rows, *by).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_id, to_id, type; a set of triples."""
    t = lambda name: table(spark, sf_dir, name)
    pick = lambda df, a, ak, b, bk, kind: df.select(_id(a, ak).alias("from_id"), _id(b, bk).alias("to_id"), F.lit(kind).alias("type"))
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    supply = _distinct(line, "l_partkey", "l_suppkey")
    n = t("part").agg(F.count("*").alias("n"))
    chain = t("part").join(F.broadcast(n)).select("p_partkey", ((7 * F.col("p_partkey") + 1) % F.col("n")).alias("next"))
    out = pick(t("customer"), "nation", "c_nationkey", "customer", "c_custkey", "DEFINES")
    for p in (
        pick(t("supplier"), "nation", "s_nationkey", "supplier", "s_suppkey", "DEFINES"),
        pick(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "IMPORTS"),
        pick(t("orders"), "customer", "o_custkey", "orders", "o_orderkey", "CALLS"),
        pick(_distinct(line, "l_orderkey", "l_partkey"), "orders", "l_orderkey", "part", "l_partkey", "CALLS"),
        pick(supply, "part", "l_partkey", "supplier", "l_suppkey", "DEPENDS_ON"),
        pick(supply.where("(l_partkey + l_suppkey) % 7 = 0"), "supplier", "l_suppkey", "part", "l_partkey", "IMPLEMENTS"),
        pick(chain, "part", "p_partkey", "part", "next", "CALLS"),
    ):
        out = out.unionByName(p)
    return out


_saved: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of sf_dir, saved once a session (see store.save_graph) and loaded from there by every query after the first."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _saved:
        path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
        store.save_graph(nodes(spark, sf_dir), edges(spark, sf_dir), path)
        _saved[key] = store.load_graph(spark, path)
    return _saved[key]


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tool_calls: one row per event."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "event_type as tool_name", "user_id as agent_id", "user_id % 5 as project_id", "get_json_object(props, '$.k') as entity", "cast(floor(value * 10) as bigint) as duration_ms",
        "if(event_type <> 'error', 1, 0) as success", "ts as created_at", "cast(ts as date) as created_date", "concat(cast(user_id as string), '-', cast(cast(ts as date) as string)) as session_id",
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """context_deliveries: clicks and views."""
    return calls(spark, sf_dir).where("tool_name in ('click', 'view')").selectExpr(
        "*", "id * 37 % 1500 as response_tokens", "id * 53 % 4000 as baseline_tokens", "cast(id % 3 = 0 as int) as cache_hit", "cast(id % 4 = 0 as int) as brain_enriched",
        "cast(id % 7 = 0 as int) as truncated", "case id % 4 when 0 then 'modify' when 1 then 'understand' when 2 then 'review' else 'debug' end as intent",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sessions: a user's day; every tenth user leaves sessions open."""
    return calls(spark, sf_dir).groupBy("session_id", "agent_id", "project_id").agg(
        F.min("created_at").alias("started_at"), F.expr("if(agent_id % 10 = 3, null, max(created_at))").alias("ended_at"), F.count("*").alias("tool_calls"), F.sum("duration_ms").alias("busy_ms"),
        F.sum(F.expr("if(tool_name = 'view', id * 53 % 4000 - id * 37 % 1500, 0)")).alias("tokens_saved"), F.sum(F.expr("cast(tool_name = 'purchase' as bigint)")).alias("tasks_completed"),
    ).withColumn("model", F.expr("concat('model-', cast(agent_id % 3 as string), if(agent_id % 2 = 0, '-20240115', ''))"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """outcome_signals: purchases are tasks done, errors are corrections."""
    return calls(spark, sf_dir).where("tool_name in ('purchase', 'error')").selectExpr("id", "project_id", "agent_id", "entity", "session_id", "created_at", "created_date", "if(tool_name = 'purchase', 'task_done', 'correction') as signal_type", "if(tool_name = 'purchase', 1.0D, -1.0D) as signal_weight")


#: The same views for the SQL checks.
GRAPH_SQL = """
nodes AS (
  SELECT 'tpch::region::' || r_regionkey AS id, 'package' AS type, r_name AS name, r_name AS package, 'region/region.tbl' AS file, r_regionkey::INT AS line, true AS exported, 'docs' AS domain FROM region
  UNION ALL SELECT 'tpch::nation::' || n_nationkey, 'file', n_name, r_name, 'nation/' || r_name || '.tbl', n_nationkey::INT, true, 'docs' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'tpch::customer::' || c_custkey, 'struct', c_name, r_name, 'customer/' || n_name || '.tbl', c_custkey::INT, c_acctbal > 0, 'code' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'tpch::supplier::' || s_suppkey, 'interface', s_name, r_name, 'supplier/' || n_name || '.tbl', s_suppkey::INT, s_acctbal > 0, 'infra' FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'tpch::part::' || p_partkey, 'function', p_name, p_brand, 'part/' || p_brand || '.tbl', p_size::INT, p_size > 25, 'api' FROM part
  UNION ALL SELECT 'tpch::orders::' || o_orderkey, 'method', 'Order.' || o_orderkey, o_orderpriority, 'orders/' || o_orderpriority || '.tbl', o_orderkey::INT, false, 'code' FROM orders),
edges AS (
  SELECT 'tpch::nation::' || c_nationkey AS from_id, 'tpch::customer::' || c_custkey AS to_id, 'DEFINES' AS type FROM customer
  UNION ALL SELECT 'tpch::nation::' || s_nationkey, 'tpch::supplier::' || s_suppkey, 'DEFINES' FROM supplier
  UNION ALL SELECT 'tpch::nation::' || n_nationkey, 'tpch::region::' || n_regionkey, 'IMPORTS' FROM nation
  UNION ALL SELECT 'tpch::customer::' || o_custkey, 'tpch::orders::' || o_orderkey, 'CALLS' FROM orders
  UNION ALL SELECT DISTINCT 'tpch::orders::' || l_orderkey, 'tpch::part::' || l_partkey, 'CALLS' FROM lineitem
  UNION ALL SELECT DISTINCT 'tpch::part::' || l_partkey, 'tpch::supplier::' || l_suppkey, 'DEPENDS_ON' FROM lineitem
  UNION ALL SELECT DISTINCT 'tpch::supplier::' || l_suppkey, 'tpch::part::' || l_partkey, 'IMPLEMENTS' FROM lineitem WHERE (l_partkey + l_suppkey) % 7 = 0
  UNION ALL SELECT 'tpch::part::' || p_partkey, 'tpch::part::' || ((7 * p_partkey + 1) % (SELECT count(*) FROM part)), 'CALLS' FROM part)"""

EVENT_SQL = """
tc AS (SELECT event_id AS id, event_type AS tool_name, user_id AS agent_id, user_id % 5 AS project_id, json_extract_string(props, '$.k') AS entity, floor(value * 10)::BIGINT AS duration_ms,
  CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS success, ts AS created_at, ts::DATE AS created_date, user_id::VARCHAR || '-' || (ts::DATE)::VARCHAR AS session_id FROM events),
cd AS (SELECT *, id * 37 % 1500 AS response_tokens, id * 53 % 4000 AS baseline_tokens, (id % 3 = 0)::INT AS cache_hit, (id % 4 = 0)::INT AS brain_enriched, (id % 7 = 0)::INT AS truncated,
  CASE id % 4 WHEN 0 THEN 'modify' WHEN 1 THEN 'understand' WHEN 2 THEN 'review' ELSE 'debug' END AS intent FROM tc WHERE tool_name IN ('click', 'view')),
s AS (SELECT session_id, agent_id, project_id, min(created_at) AS started_at, CASE WHEN agent_id % 10 = 3 THEN NULL ELSE max(created_at) END AS ended_at, count(*) AS tool_calls, sum(duration_ms)::BIGINT AS busy_ms,
  sum(CASE WHEN tool_name = 'view' THEN id * 53 % 4000 - id * 37 % 1500 ELSE 0 END)::BIGINT AS tokens_saved, sum((tool_name = 'purchase')::BIGINT)::BIGINT AS tasks_completed,
  'model-' || (agent_id % 3) || CASE WHEN agent_id % 2 = 0 THEN '-20240115' ELSE '' END AS model FROM tc GROUP BY session_id, agent_id, project_id),
os AS (SELECT id, project_id, agent_id, entity, session_id, created_at, created_date, CASE WHEN tool_name = 'purchase' THEN 'task_done' ELSE 'correction' END AS signal_type,
  CASE WHEN tool_name = 'purchase' THEN 1.0 ELSE -1.0 END::DOUBLE AS signal_weight FROM tc WHERE tool_name IN ('purchase', 'error'))"""
