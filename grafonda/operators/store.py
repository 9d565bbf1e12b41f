"""The graph as stored tables: full and per-file saves, loads, hand-made edges, snapshots' differences, removal and merging.

A saved graph is a folder of Parquet: nodes/ by bucket of their file, edges/ by type, so a reader of one type reads that folder only,
and a change of one file rewrites one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import cut, delete, forget

BUCKETS = 64
#: Nodes of one file that may be broadcast.
FEW_NODES = 1 << 18
EDGE_KEY = ["from_id", "to_id", "type"]
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _bucket(file: str = "file", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(file, F.lit(""))), F.lit(buckets)).cast("int")


def _write(table: DataFrame, path: str, by: str, mode: str = "static") -> None:
    """Replaces folders of path, one for each value of by. A task keeps a file of up to BUCKETS folders open, and sorts rows only beyond that:
    its memory does not grow with its rows."""
    conf = table.sparkSession.conf
    before = conf.get(_WRITERS, None)
    conf.set(_WRITERS, str(BUCKETS))
    try:
        table.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "zstd").partitionBy(by).parquet(path)
    finally:
        conf.unset(_WRITERS) if before is None else conf.set(_WRITERS, before)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replaces what is stored at path. A bucket with a large file is cut into several tasks."""
    _write(nodes.withColumn("bucket", _bucket()).hint("rebalance", "bucket"), f"{path}/nodes", "bucket")
    _write(edges, f"{path}/edges", "type")


def load_graph(spark: SparkSession, path: str, manual: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes, edges; with manual (see upsert_edges) the hand-made edges whose ends exist are put back."""
    nodes, edges = spark.read.parquet(f"{path}/nodes").drop("bucket"), spark.read.parquet(f"{path}/edges")
    return nodes, edges if manual is None else reinjected(edges, manual, nodes)


def side_of(ids: DataFrame) -> DataFrame:
    """ids as a side of a join: broadcast up to FEW_NODES rows. Ids compress so well that a file's size says little of their number."""
    return F.broadcast(ids) if ids.count() <= FEW_NODES else ids.hint("merge")


def save_delta(spark: SparkSession, path: str, file: str, nodes: DataFrame, edges: DataFrame) -> None:
    """Replaces the rows of one file: its nodes, and the edges from its nodes. Only the bucket of the file, and the folders of the types
    of its old and new edges, are rewritten."""
    old_nodes, old_edges = load_graph(spark, path)
    edges = cut(edges.select(*EDGE_KEY), "edges")  # whatever makes them is done once
    own = old_nodes.where(F.col("file") == file).select(F.col("id").alias("from_id"))
    bucket = spark.range(1).select(_bucket_of(file)).first()[0]
    kept = spark.read.parquet(f"{path}/nodes").where((F.col("bucket") == bucket) & (F.col("file") != file))
    # edges from other nodes than these stay as they are, and are a set already
    starts = cut(own.withColumn("own", F.lit(True)).unionByName(edges.select("from_id", F.lit(False).alias("own"))).groupBy("from_id").agg(F.max("own").alias("own")), "starts")
    met = side_of(starts)
    near = cut(old_edges.join(met, "from_id").select(*EDGE_KEY, "own"), "near")
    kinds = [r[0] for r in near.where("own").select("type").unionByName(edges.select("type")).distinct().collect()]
    touched = F.col("type").isin(*kinds) if kinds else F.lit(False)
    new_nodes = kept.unionByName(nodes.withColumn("bucket", _bucket()))
    far = old_edges.where(touched).join(met, "from_id", "left_anti").select(*EDGE_KEY)
    new_edges = far.unionByName(near.where(touched & ~F.col("own")).select(*EDGE_KEY).unionByName(edges.select(*EDGE_KEY)).distinct())
    # a folder can't be read and replaced in one go: both tables are written aside first
    held = [(cut(df, "delta"), name, by, touched) for df, name, by, touched in ((new_nodes, "nodes", "bucket", [bucket]), (new_edges, "edges", "type", kinds))]
    for table, name, by, touched in held:
        left = {r[0] for r in table.select(by).distinct().collect()}  # one bucket, or a few types
        _write(table, f"{path}/{name}", by, "dynamic")
        for gone in set(touched) - left:
            delete(spark, f"{path}/{name}/{by}={gone}")
        forget(table)
    for table in (starts, near, edges):
        forget(table)


def _bucket_of(file: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(file)), F.lit(BUCKETS)).cast("int")


def with_file(nodes: DataFrame, edges: DataFrame, file: str, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges as save_delta would leave them."""
    own = nodes.where(F.col("file") == file).select(F.col("id").alias("from_id"))
    return nodes.where(F.col("file") != file).unionByName(new_nodes), edges.join(own, "from_id", "left_anti").select(*EDGE_KEY).unionByName(new_edges.select(*EDGE_KEY)).distinct()


def without_file(nodes: DataFrame, edges: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without a file's nodes and every edge at them."""
    gone = nodes.where(F.col("file") == file).select("id")
    left = nodes.join(gone, "id", "left_anti")
    return left, compacted(edges, left)


def compacted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """new rows replace those with their id."""
    return nodes.join(new.select("id"), "id", "left_anti").select(*nodes.columns).unionByName(new.select(*nodes.columns))


def merged(nodes: DataFrame, edges: DataFrame, other_nodes: DataFrame, other_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of two graphs: of nodes with one id the first graph's; edges are a set."""
    return nodes.unionByName(other_nodes.join(nodes.select("id"), "id", "left_anti").select(*nodes.columns)), edges.select(*EDGE_KEY).unionByName(other_edges.select(*EDGE_KEY)).distinct()


def patched(nodes: DataFrame, patch: DataFrame) -> DataFrame:
    """nodes(id, metadata) with the entries of patch(id, metadata) added or replaced."""
    held = nodes.join(patch.select("id", F.col("metadata").alias("patch")), "id", "left")
    kept = F.map_filter(F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.coalesce(F.map_contains_key("patch", k), F.lit(False)))
    return held.withColumn("metadata", F.when(F.col("patch").isNull(), F.col("metadata")).otherwise(F.map_concat(kept, "patch"))).drop("patch")


def upsert_edges(manual: DataFrame, new: DataFrame) -> DataFrame:
    """from_id, to_id, type, at, suppressed: hand-made or derived edges, keyed by ends and type. The latest write counts, but an edge that
    was suppressed stays so."""
    every = manual.unionByName(new)
    return every.groupBy(*EDGE_KEY).agg(F.max("at").alias("at"), F.max("suppressed").alias("suppressed"))


def pruned_edges(manual: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those whose ends both exist."""
    return compacted(manual, nodes)


def reinjected(edges: DataFrame, manual: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the unsuppressed hand-made ones whose ends exist."""
    return edges.select(*EDGE_KEY).unionByName(pruned_edges(manual.where("not suppressed"), nodes).select(*EDGE_KEY)).distinct()


def changed_signatures(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, before, after: nodes(id, signature) of both snapshots whose signature differs."""
    both = before.select("id", F.col("signature").alias("before")).join(after.select("id", F.col("signature").alias("after")), "id")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def shifted_fan_in(before: DataFrame, after: DataFrame, least: int = 1) -> DataFrame:
    """id, before, after: nodes whose number of callers changed by least or more between two snapshots of edges."""
    count = lambda e, name: e.where("type = 'CALLS'").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias(name))
    both = count(before, "before").join(count(after, "after"), "id", "full").select("id", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.where(F.abs(F.col("after") - F.col("before")) >= least)


def migrated_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """new(id, file, name, type, stable_id) where an entity keeps the stable id it had under its file, name and type."""
    first = Window.partitionBy("file", "name", "type").orderBy("id")
    held = old.withColumn("k", F.row_number().over(first)).where("k = 1").select("file", "name", "type", F.col("stable_id").alias("kept"))
    return new.join(held, ["file", "name", "type"], "left").withColumn("stable_id", F.coalesce("kept", "stable_id")).select(*new.columns)


def index_snapshot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_out, fan_in, targets (by type, sorted): adjacency in columns, to be written and loaded as one table."""
    out = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("fan_out"), F.array_sort(F.collect_list(F.struct("type", "to_id"))).alias("targets"))
    back = edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("fan_in"))
    held = nodes.select("id").join(out, "id", "left").join(back, "id", "left")
    return held.select("id", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"), "targets")


def call_sites_for(sites: DataFrame, files: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Call sites of some files(file) or package aliases(pkg_alias)."""
    out = sites if files is None else sites.join(files, F.col("caller_file") == files["file"], "left_semi")
    return out if aliases is None else out.join(aliases, "pkg_alias", "left_semi")


def fingerprints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fingerprint: a hash of a node's type and name and of its edges, which changes if and only if they do."""
    marks = edges.select(F.col("from_id").alias("id"), F.concat_ws(">", "type", "to_id").alias("mark")).unionByName(edges.select(F.col("to_id").alias("id"), F.concat_ws("<", "type", "from_id").alias("mark")))
    each = marks.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("mark")), "|").alias("marks"))
    return nodes.join(each, "id", "left").select("id", F.sha1(F.concat(F.concat_ws(":", "type", "name"), F.lit("|"), F.coalesce("marks", F.lit("")))).alias("fingerprint"))


def project_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, files, packages, domains, edges by hand."""
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("file").alias("files"), F.countDistinct("package").alias("packages"), F.countDistinct("domain").alias("domains"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("type") == "MANUAL").alias("manual"))
    return n.join(F.broadcast(e)).select("nodes", "edges", "files", "packages", "domains", "manual")
