"""Graphs out: DOT, Mermaid and GraphML lines, packets of text within a budget, and partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import chosen
from ..operators.store import compacted


def _safe(c: str):
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


# Classes of nodes in Mermaid, by type.
_CLASSES = {"function": "funcStyle", "method": "funcStyle", "struct": "structStyle", "interface": "ifaceStyle", "variable": "varStyle"}
_STYLES = {"funcStyle": "fill:#ddf,stroke:#339,color:#000", "structStyle": "fill:#dfd,stroke:#393,color:#000", "ifaceStyle": "fill:#fdf,stroke:#939,color:#000", "varStyle": "fill:#ffd,stroke:#993,color:#000"}
_KEYS = (("d0", "node", "type", "string"), ("d1", "node", "name", "string"), ("d2", "node", "package", "string"), ("d3", "node", "file", "string"), ("d4", "node", "line", "int"), ("d5", "edge", "type", "string"))


def _lines(spark, *lines: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], "line string")


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line: one statement for each node, and for each edge with both ends, for a digraph's body."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\])', "\\\\$1"), F.lit('"'))
    a = nodes.select(F.concat(quoted("id"), F.lit(" [label="), quoted("name"), F.lit("];")).alias("line"))
    return a.unionByName(compacted(edges, nodes).select(F.concat(quoted("from_id"), F.lit(" -> "), quoted("to_id"), F.lit(" [label="), quoted("type"), F.lit("];")).alias("line")))


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line: nodes with their class, edges with both ends, and a definition for each class in use."""
    style = chosen(F.col("type"), _CLASSES, "")
    a = nodes.select(F.concat(F.lit("  "), _safe("id"), F.lit('["'), F.regexp_replace("name", '"', "'"), F.lit('"]'), F.when(style != "", F.concat(F.lit(":::"), style)).otherwise(F.lit(""))).alias("line"))
    used = nodes.select(style.alias("style")).distinct().where("style <> ''").select(F.concat(F.lit("  classDef "), F.col("style"), F.lit(" "), chosen(F.col("style"), _STYLES, "")).alias("line"))
    return a.unionByName(compacted(edges, nodes).select(F.concat(F.lit("  "), _safe("from_id"), F.lit(" --> |"), F.col("type"), F.lit("| "), _safe("to_id")).alias("line"))).unionByName(used)


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line: elements of the keys, of nodes, and of edges with both ends."""
    text = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    keys = _lines(nodes.sparkSession, *[f'<key id="{k}" for="{f}" attr.name="{n}" attr.type="{t}"/>' for k, f, n, t in _KEYS])
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), F.coalesce(text(c), F.lit("")), F.lit("</data>"))
    a = nodes.select(F.concat(F.lit('<node id="'), text("id"), F.lit('">'), *[data(k, n) for k, f, n, _ in _KEYS if f == "node"], F.lit("</node>")).alias("line"))
    return keys.unionByName(a).unionByName(compacted(edges, nodes).select(F.concat(F.lit('<edge source="'), text("from_id"), F.lit('" target="'), text("to_id"), F.lit('">'), data("d5", "type"), F.lit("</edge>")).alias("line")))


def json_rows(**tables: DataFrame) -> DataFrame:
    """kind, json: the rows of several tables as JSON, for one export."""
    parts = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json")) for kind, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_summary(rows: DataFrame) -> DataFrame:
    """kind, n of json_rows."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def report_lines(metrics: DataFrame, title: str) -> DataFrame:
    """place, line: a Markdown table of metrics(name, value), by name."""
    head = metrics.sparkSession.createDataFrame([(0, f"# {title}"), (1, "| metric | value |"), (2, "|-|-|")], "place int, line string")
    rank = F.row_number().over(Window.orderBy("name")) + 2  # a report's few rows
    return head.unionByName(metrics.select(rank.alias("place"), F.concat(F.lit("| "), F.col("name"), F.lit(" | "), F.format_number("value", 4), F.lit(" |")).alias("line")))


def write_facts(df: DataFrame, path: str, day: str = "created_date") -> None:
    """Facts by day: files of a day are written by few tasks, and reads prune by day."""
    df.repartition(day).sortWithinPartitions(day).write.mode("overwrite").partitionBy(day).parquet(path)


def pruned(df: DataFrame, day: str, last, keep_days: int) -> DataFrame:
    return df.where(F.datediff(last, F.col(day)) < keep_days)
