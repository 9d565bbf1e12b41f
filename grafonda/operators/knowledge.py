"""Side stores of knowledge: patterns of what is used together, decisions, summaries and packets; gaps, annotations and web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import chosen

# What each part of a packet adds to its quality; sections by phase and gates by mode; severities in order.
PACKET_PARTS = {"summary": 0.1, "callees": 0.4, "rules": 0.1, "insight": 0.4}
SEVERITIES = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def co_occurrence(decisions: DataFrame, least: int = 1) -> DataFrame:
    """a, b, together, confidence of decisions(id, items): how often two items stand in one decision, and as a share of a's decisions. Pairs
    come from each decision's own items, both ways."""
    each = decisions.select("id", F.array_distinct("items").alias("items"))
    pairs = each.select(F.explode("items").alias("a"), "items").select("a", F.explode("items").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("together"))
    total = each.select(F.explode("items").alias("a")).groupBy("a").agg(F.count("*").alias("total"))
    return pairs.where(F.col("together") >= least).join(total, "a").select("a", "b", "together", F.round(F.col("together") / F.col("total"), 6).alias("confidence"))


def patterns_for(patterns: DataFrame, triggers: DataFrame, keep: int = 10) -> DataFrame:
    """patterns(trigger, co_change, confidence) of some triggers(trigger), the surest first."""
    return patterns.join(triggers, "trigger", "left_semi").orderBy(F.desc("confidence"), "trigger", "co_change").limit(keep)


def decisions_for_file(decisions: DataFrame, file: str) -> DataFrame:
    """decisions(id, linked) whose linked patterns stand in a file's path."""
    return decisions.where(F.exists("linked", lambda p: F.contains(F.lit(file), p) & (p != "")))


def latest_summaries(summaries: DataFrame) -> DataFrame:
    """node_id, summary: the last written for each node."""
    return summaries.groupBy("node_id").agg(F.max_by("summary", F.struct("at", "summary")).alias("summary"))


def packet_quality(**present: Column) -> Column:
    """The sum of PACKET_PARTS that are there, at most 1."""
    total = F.lit(0.0)
    for name, there in present.items():
        total = total + F.when(there, PACKET_PARTS[name]).otherwise(0.0)
    return F.least(F.round(total, 6), F.lit(1.0))


def profile(phases: DataFrame, sections: DataFrame) -> DataFrame:
    """phase, sections: what each phase shows, of a dimension (phase, section, place)."""
    listed = sections.groupBy("phase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda x: x["section"]), ",").alias("sections"))
    return phases.join(F.broadcast(listed), "phase")  # a row for each phase


def matched_prompts(files: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """file, template: the first template (name, pattern) whose pattern a file's path matches."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in templates:
        out = out.when(F.rlike("file", F.lit(pattern)), name)
    return files.select("file", out.alias("template")).where("template is not null")


def gaps(found: DataFrame, status: str = "open", severity: str | None = None, file: str | None = None, keep: int = 1000) -> DataFrame:
    """Quality gaps by status, severity or file, the most severe first."""
    out = found.where(F.col("status") == status)
    out = out if severity is None else out.where(F.col("severity") == severity)
    out = out if file is None else out.where((F.col("file") == file) | F.endswith("file", F.lit("/" + file)))
    return out.orderBy(chosen(F.col("severity"), SEVERITIES, 9), "id").limit(keep)


def annotations_of(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, notes: the notes on some nodes(node_id), in order, joined by bars."""
    kept = annotations.join(nodes, "node_id", "left_semi")
    return kept.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "note"))), lambda x: x["note"]), "|").alias("notes"))


def cached_pages(pages: DataFrame, now: Column) -> DataFrame:
    """pages(key, fetched_at, ttl_hours) that still hold."""
    return pages.where(F.col("fetched_at").cast("timestamp") + F.make_interval(hours=F.col("ttl_hours")) > now)


def without_prefix(pages: DataFrame, prefix: str) -> DataFrame:
    return pages.where(~F.startswith("key", F.lit(prefix)))


def file_context(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """file, entities: what some files(file) define, by line. The files are a stated set and are broadcast, so only their nodes are shuffled."""
    kept = nodes.where("type not in ('file', 'package')").join(F.broadcast(files), "file", "left_semi")
    return kept.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]), ",").alias("entities"))


def edge_catalog(edges: DataFrame, weights: dict[str, float], cross: tuple[str, ...]) -> DataFrame:
    """name, weight, cross_domain, n: a row for each type of edge, with the edges there are of it."""
    known = edges.sparkSession.createDataFrame([(k, v, k in cross) for k, v in sorted(weights.items())], "name string, weight double, cross_domain boolean")
    counts = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n"))
    return known.join(counts, "name", "left").select("name", "weight", "cross_domain", F.coalesce("n", F.lit(0)).alias("n"))


def tiered_sections(sections: DataFrame, budget: int, by: list[str] | None = None) -> DataFrame:
    """sections(name, tier, place, cost) of each answer (columns by) that fit into its budget: critical ones all, then relevant, then available, by
    place, up to the first that does not fit."""
    order = chosen(F.col("tier"), {"critical": 0, "relevant": 1, "available": 2}, 3)
    running = F.sum("cost").over(Window.partitionBy(*(by or [])).orderBy(order, "place").rowsBetween(Window.unboundedPreceding, 0))  # an answer's few sections
    return sections.withColumn("running", running).where((F.col("tier") == "critical") | (F.col("running") <= budget))


def trimmed_impact(tiers: DataFrame, budget: int, by: list[str] | None = None) -> DataFrame:
    """tiers(depth, cost) of each answer (columns by) that fit into its budget when the far ones go first: all up to the largest depth whose
    running cost fits; depth 1 stays."""
    running = F.sum("cost").over(Window.partitionBy(*(by or [])).orderBy("depth"))  # a row for each depth
    return tiers.withColumn("running", running).where((F.col("depth") == 1) | (F.col("running") <= budget))
