"""Call sites resolved to their targets in stages, and resolved anew after changes of a few files.

A stage looks at the sites that no stage before has settled: calls on self, this or super by the caller's class and its ancestors; on an import's
alias in that package; on a variable by its declared type and its ancestors; then any name in the caller's own package, and in the
packages that its file imports, the first by path that has one. With instantiated types a method name means all methods whose type is
ever made.

Side tables: sites (site, caller_id, caller_name, package, file, alias, func), imports (file, alias, path), variables (file, var, type), parents (type,
parent), folders (folder, package: where a folder's name is not its package's).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import links
from .work import cut

# What stands for the caller's own class, and names that say too little to be looked for in other packages.
SELF, SUPER = ("self", "this"), "super"
TOO_COMMON = (
    "write", "read", "get", "set", "close", "open", "init", "run", "start", "stop", "send", "recv", "push", "pop", "add", "remove", "delete", "update", "create", "reset",
    "clear", "flush", "load", "save", "parse", "render", "handle", "process", "execute", "call", "format", "validate", "copy", "clone", "merge", "split", "encode", "decode",
    "dump", "append", "extend", "insert", "keys", "values", "items", "next", "iter", "len", "str", "repr", "hash", "eq",
)


def last_part(path: str | object):
    return F.substring_index(path, "/", -1)


def _by_type(asked: DataFrame, methods: DataFrame, line: DataFrame, with_own: bool = True) -> DataFrame:
    """site, to_id for asked(site, type, func, own): the method of the type, or of its nearest ancestor that has one."""
    near = asked.join(line, "type", "left").withColumns({"owner": F.coalesce("ancestor", "type"), "distance": F.coalesce("distance", F.lit(0))})
    near = near.where("own or distance > 0")
    hits = near.join(methods, ["owner", "func"])
    return hits.groupBy("site").agg(F.min_by("to_id", F.struct("distance", "to_id")).alias("to_id"))


def resolved(sites: DataFrame, nodes: DataFrame, imports: DataFrame, variables: DataFrame, parents: DataFrame, folders: DataFrame | None = None, instantiated: DataFrame | None = None) -> DataFrame:
    """site, from_id, to_id, stage: stage 1 self, 2 import alias, 3 variable, 4 own package, 5 imported packages."""
    callable_ = cut(nodes.where("type in ('function', 'method')").select("id", "package", "name"), "callable")
    methods = callable_.where("contains(name, '.')").select(F.col("id").alias("to_id"), F.expr("left(name, length(name) - length(substring_index(name, '.', -1)) - 1)").alias("owner"), F.substring_index("name", ".", -1).alias("func"))
    line = cut(links.ancestors(parents), "line")
    plain = F.regexp_replace(F.coalesce("alias", F.lit("")), r"^(self|this)\.", "")
    left = cut(sites.select("site", "caller_id", "caller_name", "package", "file", plain.alias("alias"), F.coalesce("alias", F.lit("")).alias("written"), "func").distinct(), "sites")
    in_folders = folders if folders is not None else imports.limit(0).select(F.col("path").alias("folder"), F.col("path").alias("package"))
    named = imports.select("file", "alias", "path", last_part("path").alias("folder"))
    packages = named.select("file", "alias", "path", F.col("folder").alias("package"), F.lit(0).alias("second"))
    packages = cut(packages.unionByName(named.join(in_folders, "folder").select("file", "alias", "path", "package", F.lit(1).alias("second"))), "packages")
    found: list[DataFrame] = []

    def settle(hits: DataFrame, stage: int) -> None:
        nonlocal left
        own = cut(hits.select("site", "to_id").distinct().withColumn("stage", F.lit(stage)), "stage")
        found.append(own)
        left = left.join(own.select("site"), "site", "left_anti")

    def first_package(asked: DataFrame, order: list[str]) -> DataFrame:
        """site, to_id in the first of a site's packages, by order, that has the name."""
        keyed = asked.withColumn("place", F.struct(*order))
        some = links.package_targets(keyed.select(F.struct("site", "place", F.col("package").alias("in")).alias("site"), "package", "func").distinct(), callable_, instantiated)
        rank = F.dense_rank().over(Window.partitionBy("key").orderBy("place", "in"))
        best = some.select(F.col("site.site").alias("key"), F.col("site.place").alias("place"), F.col("site.in").alias("in"), "to_id").withColumn("rank", rank).where("rank = 1")
        return best.select(F.col("key").alias("site"), "to_id")

    of_class = F.expr("left(caller_name, length(caller_name) - length(substring_index(caller_name, '.', -1)) - 1)")
    mine = left.where(F.col("alias").isin(*SELF, SUPER) & F.contains("caller_name", F.lit(".")))
    settle(_by_type(mine.select("site", of_class.alias("type"), "func", (F.col("alias") != SUPER).alias("own")), methods, line), 1)
    settle(first_package(left.where("alias <> ''").drop("package").join(packages, ["file", "alias"]), ["second"]), 2)
    typed = left.where("alias <> ''").select("site", "file", "func", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.col("alias").alias("var")), F.struct(F.lit(1).alias("place"), F.col("written").alias("var")))).alias("v"))
    typed = typed.select("site", "file", "func", "v.place", "v.var").join(variables, ["file", "var"])
    by_place = [_by_type(typed.where(F.col("place") == k).select("site", "type", "func", F.lit(True).alias("own")), methods, line).withColumn("place", F.lit(k)) for k in (0, 1)]
    settle(by_place[0].unionByName(by_place[1]).groupBy("site").agg(F.min_by("to_id", F.struct("place", "to_id")).alias("to_id")), 3)
    settle(links.package_targets(left.select("site", "package", "func"), callable_, instantiated), 4)
    wide = left.where(F.lower("func").isin(*TOO_COMMON) & (F.col("alias") == ""))
    beyond = left.join(wide.select("site"), "site", "left_anti").drop("package", "alias").join(packages.drop("alias").distinct(), "file")
    settle(first_package(beyond, ["path", "second"]), 5)
    every = reduce(DataFrame.unionByName, found)
    return every.join(sites.select("site", F.col("caller_id").alias("from_id")).distinct(), "site").select("site", "from_id", "to_id", "stage")


def edges_of(calls: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """from_id, to_id, type: each pair once, without calls that edges has already."""
    new = calls.select("from_id", "to_id", F.lit("CALLS").alias("type")).distinct()
    return new if edges is None else new.join(edges.where("type = 'CALLS'").select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")


def touched(sites: DataFrame, before: DataFrame, after: DataFrame, changed: DataFrame, parents_before: DataFrame, parents_after: DataFrame) -> DataFrame:
    """site: sites whose targets may be others once the files changed(file) are: those in these files, those that ask for a name that came or
    went with them, and, where an inheritance changed, calls on self or on a variable. Every lookup goes by the name that is called, so no other site can
    change."""
    key = ["id", "package", "name", "type"]
    moved = before.select(*key).exceptAll(after.select(*key)).unionByName(after.select(*key).exceptAll(before.select(*key)))
    names = moved.select(F.substring_index("name", ".", -1).alias("func")).distinct()
    lines = parents_before.select("type", "parent").exceptAll(parents_after.select("type", "parent")).unionByName(parents_after.select("type", "parent").exceptAll(parents_before.select("type", "parent")))
    # up to the first changed line, if any
    inherited = sites.where("coalesce(alias, '') <> ''").join(F.broadcast(lines.limit(1).select(F.lit(1).alias("any"))))
    hit = sites.join(changed, "file", "left_semi").select("site").unionByName(sites.join(names, "func", "left_semi").select("site")).unionByName(inherited.select("site"))
    return hit.distinct()


def refreshed(old: DataFrame, again: DataFrame, sites: DataFrame, nodes: DataFrame, imports: DataFrame, variables: DataFrame, parents: DataFrame, folders: DataFrame | None = None, instantiated: DataFrame | None = None) -> DataFrame:
    """old calls (site, from_id, to_id, stage) with the sites of again(site) resolved anew and those of sites that are gone left out: the same as
    resolving all."""
    kept = old.join(again, "site", "left_anti").join(sites.select("site"), "site", "left_semi")
    new = resolved(sites.join(again, "site", "left_semi"), nodes, imports, variables, parents, folders, instantiated)
    return kept.unionByName(new)
