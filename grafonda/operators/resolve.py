"""Edges derived by joins: calls from call sites, implementations, mentions in text, coverage by range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import scans


def resolved_calls(sites: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """from_id, to_id, stage of call sites (caller_id, caller_package, file, alias, func). Stages in order: an import alias names the package,
    the caller's own package, then any imported package; a site takes its first stage that gives one target, and none if a stage is ambiguous."""
    named = nodes.select(F.col("id").alias("to_id"), F.col("package").alias("target_package"), F.lower(F.substring_index("name", ".", -1)).alias("func_key"))
    keyed = sites.withColumn("func_key", F.lower("func")).withColumn("site", F.sha1(F.concat_ws("|", "caller_id", "file", F.coalesce("alias", F.lit("")), "func")))
    by_alias = keyed.where("alias is not null and alias <> ''").join(imports, ["file", "alias"]).select("site", "caller_id", "func_key", F.col("path").alias("target_package"), F.lit(1).alias("stage"))
    plain = keyed.where("alias is null or alias = ''")
    same = plain.select("site", "caller_id", "func_key", F.col("caller_package").alias("target_package"), F.lit(2).alias("stage"))
    imported = plain.join(imports.select("file", "path").distinct(), "file").select("site", "caller_id", "func_key", F.col("path").alias("target_package"), F.lit(3).alias("stage"))
    found = by_alias.unionByName(same).unionByName(imported).join(named, ["target_package", "func_key"])
    first = found.withColumn("best", F.min("stage").over(Window.partitionBy("site"))).where("stage = best")
    return first.groupBy("site", "stage").agg(F.any_value("caller_id").alias("from_id"), F.min("to_id").alias("to_id"), F.count_distinct("to_id").alias("n")).where("n = 1").select("from_id", "to_id", "stage").distinct()


def structural_implements(interface_methods: DataFrame, struct_methods: DataFrame) -> DataFrame:
    """interface, struct: relational division of (owner, method): structs that have every method of an interface. An interface meets only the
    structs that have its rarest method, so methods that all have pair nothing."""
    asked, held = interface_methods.distinct().withColumnRenamed("owner", "interface"), struct_methods.distinct().withColumnRenamed("owner", "struct")
    common = held.groupBy("method").agg(F.count("*").alias("df"))
    counted = asked.join(common, "method", "left")
    rarest = counted.groupBy("interface").agg(F.count("*").alias("need"), F.count("df").alias("known"), F.min_by("method", F.struct("df", "method")).alias("method")).where("need = known")
    pairs = rarest.join(held, "method").select("interface", "struct", "need")
    have = pairs.join(asked, "interface").join(held, ["struct", "method"], "left_semi").groupBy("interface", "struct", "need").agg(F.count("*").alias("have"))
    return have.where("have = need").select("interface", "struct")


def heritage(nodes: DataFrame) -> DataFrame:
    """from_id, to_id, type of nodes with lists `implements` and `extends`: each name's node, in the same package first."""
    named = nodes.select(F.col("id").alias("to_id"), F.lower("name").alias("key"), F.col("package").alias("to_package"))
    asked = nodes.select(F.col("id").alias("from_id"), "package", F.inline(F.concat(F.transform("implements", lambda x: F.struct(x.alias("base"), F.lit("IMPLEMENTS").alias("type"))), F.transform("extends", lambda x: F.struct(x.alias("base"), F.lit("EXTENDS").alias("type"))))))
    hits = asked.withColumn("key", F.lower(F.trim("base"))).join(named, "key").where("from_id <> to_id")
    rank = F.row_number().over(Window.partitionBy("from_id", "key", "type").orderBy(F.col("package") != F.col("to_package"), "to_id"))
    return hits.withColumn("rank", rank).where("rank = 1").select("from_id", "to_id", "type")


def mentions(texts: DataFrame, nodes: DataFrame, least: int = 4, most: int = 3) -> DataFrame:
    """doc_id, to_id: identifiers in prose that name a node; short names and names of more than `most` nodes say nothing."""
    named = nodes.where(F.length("name") >= least).select(F.col("id").alias("to_id"), F.lower("name").alias("key"))
    clear = named.groupBy("key").agg(F.collect_set("to_id").alias("ids")).where(F.size("ids") <= most)
    asked = texts.select("doc_id", F.explode(scalars.identifiers(F.col("text"))).alias("word")).select("doc_id", F.lower("word").alias("key")).distinct()
    return asked.join(clear, "key").select("doc_id", F.explode("ids").alias("to_id"))


def coverage(blocks: DataFrame, entities: DataFrame) -> DataFrame:
    """id, covered_pct: statements of coverage blocks (file, start, end, statements, count) that overlap an entity's lines (file, first, last).

    The blocks that overlap are those that start by the entity's last line, less those that end before its first: two running sums over
    the lines of a file, so that no pair of a block and an entity is made."""
    counted = F.when(F.col("count") > 0, F.col("statements")).otherwise(0)
    mark = lambda df, sign, line, order, *own: df.select("file", F.lit(sign).alias("sign"), F.col(line).alias("line"), F.lit(order).alias("order"), *own)
    of_block = (F.lit(None).cast(entities.schema["id"].dataType).alias("id"), F.col("statements").cast("long").alias("statements"), counted.cast("long").alias("covered"))
    of_entity = ("id", F.lit(0).cast("long").alias("statements"), F.lit(0).cast("long").alias("covered"))
    # at one line: starts, then what asks, then ends
    marks = [mark(blocks, 1, "start", 0, *of_block), mark(blocks, -1, "end", 2, *of_block), mark(entities, 1, "last", 1, *of_entity), mark(entities, -1, "first", 1, *of_entity)]
    placed = scans.chunks(reduce(DataFrame.unionByName, marks), ["file", "sign"], ["line", "order"], "lines")
    for name in ("statements", "covered"):
        placed = scans.with_sum(placed, ["file", "sign"], F.col(name), f"all_{name}")
    total = lambda name: F.sum(F.col("sign") * F.col(f"all_{name}"))
    found = placed.where("order = 1").groupBy("id").agg(total("statements").alias("n"), total("covered").alias("k"))
    return found.where("n > 0").select("id", F.round(100 * F.col("k") / F.col("n"), 2).alias("covered_pct"))


def orphaned(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """References (ref) to nodes that are gone."""
    return references.join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti")


def best_nodes(nodes: DataFrame, by: str) -> DataFrame:
    """The best node of each group: types before exported functions before others, tests last, then by degree."""
    tier = F.when(scalars.is_test_file(F.col("file")), 5).when(F.col("type").isin("struct", "interface"), 1).when((F.col("type") == "function") & F.col("exported"), 2).when(F.col("type") == "function", 3).otherwise(4)
    ranked = nodes.withColumn("tier", tier.cast("int")).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("tier", F.desc(F.col("fanin") + F.col("fanout")), "id")))
    return ranked.where("rank = 1")


def routes(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, handler_id of source lines (file, text) that register a route: a handler in the same file comes first."""
    found = lines.select("file", F.regexp_extract("text", r"""(?i)\.(?:get|post|put|delete|handle(?:func)?)\(\s*["'](/[^"']*)["']\s*,\s*([\w.]+)""", 1).alias("path"), F.regexp_extract("text", r"""(?i)\.(?:get|post|put|delete|handle(?:func)?)\(\s*["'](/[^"']*)["']\s*,\s*([\w.]+)""", 2).alias("handler")).where("path <> ''")
    named = nodes.select(F.col("id").alias("handler_id"), F.lower("name").alias("key"), F.col("file").alias("handler_file"))
    hits = found.withColumn("key", F.lower(F.substring_index("handler", ".", -1))).join(named, "key")
    rank = F.row_number().over(Window.partitionBy("file", "path").orderBy(F.col("file") != F.col("handler_file"), "handler_id"))
    return hits.withColumn("rank", rank).where("rank = 1").select("path", "handler_id")
