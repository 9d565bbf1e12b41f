"""Several projects' graphs as one: searches over all, dependencies between them and how they drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def united(projects: dict[str, DataFrame]) -> DataFrame:
    """The rows of all projects with their project; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select(F.lit(name).alias("project"), *df.columns) for name, df in projects.items()])


def allowed(projects: DataFrame, mine: str, grants: DataFrame) -> DataFrame:
    """Rows of projects that grants(project, reader) lets `mine` read, and its own."""
    open_ = grants.where(F.col("reader").isin(mine, "*")).select("project").distinct()
    return projects.where(F.col("project") == mine).unionByName(projects.where(F.col("project") != mine).join(open_, "project", "left_semi"))


def find_entities(projects: dict[str, DataFrame], query: str, keep: int = 100) -> DataFrame:
    """project, id, name: up to `keep` entities of each project whose name holds query."""
    hits = united(projects).where(F.contains(F.lower("name"), F.lit(query.lower())))
    rank = F.row_number().over(Window.partitionBy("project").orderBy("name", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= keep).select("project", "id", "name")


def find_texts(projects: dict[str, DataFrame], query: str, keep: int = 20) -> DataFrame:
    """project, id, text: the newest episodes or memories of all projects that hold a word of query."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(w)) for w in query.lower().split()], F.lit(False))
    return united(projects).where(hit).orderBy(F.desc("created_at"), "project", "id").limit(keep).select("project", "id", "text")


def cross_repo_calls(edges: DataFrame) -> DataFrame:
    """from_repo, to_repo, calls: calls between nodes whose ids begin with different repositories."""
    repo = lambda c: F.substring_index(c, "::", 1)
    out = edges.where("type = 'CALLS'").select(repo("from_id").alias("from_repo"), repo("to_id").alias("to_repo")).where("from_repo <> to_repo")
    return out.groupBy("from_repo", "to_repo").agg(F.count("*").alias("calls"))


def drift(dependencies: DataFrame, projects: dict[str, DataFrame]) -> DataFrame:
    """project, entity, used_in, change, now: dependencies(project, entity, used_in, verified_signature) that are gone or whose signature is
    another; those without a verified signature yet are only refreshed."""
    there = united(projects).groupBy("project", F.col("name").alias("entity")).agg(F.min("signature").alias("now"))
    both = dependencies.join(there, ["project", "entity"], "left")
    change = F.when(F.col("now").isNull(), "removed").when((F.col("verified_signature") != "") & (F.col("verified_signature") != F.col("now")), "signature_changed")
    return both.withColumn("change", change).where("change is not null").select("project", "entity", "used_in", "change", "now")


def refreshed(dependencies: DataFrame, projects: dict[str, DataFrame]) -> DataFrame:
    """dependencies with the signature of now where none was verified."""
    there = united(projects).groupBy("project", F.col("name").alias("entity")).agg(F.min("signature").alias("now"))
    both = dependencies.join(there, ["project", "entity"], "left")
    return both.withColumn("verified_signature", F.coalesce(F.nullif(F.col("verified_signature"), F.lit("")), "now", F.lit(""))).select(*dependencies.columns)


def detected(lines: DataFrame, modules: DataFrame) -> DataFrame:
    """file, id: source lines(file, text) that import a module of modules(module, id), by the last part of the import's path."""
    path = F.regexp_extract("text", r"""(?:from|import|require)\s*\(?\s*["']([^"']+)["']""", 1)
    asked = lines.select("file", path.alias("path")).where("path <> ''").select("file", F.lower(F.substring_index("path", "/", -1)).alias("module"))
    return asked.join(modules, "module").select("file", "id").distinct()


def merged_alerts(alerts: DataFrame) -> DataFrame:
    """entity, file, callers: one alert for each entity and file, its callers joined by commas."""
    return alerts.groupBy("entity", "file").agg(F.array_join(F.array_sort(F.collect_set("caller")), ",").alias("callers"))


def by_commit(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """Dependencies whose file changed since the commit that they were verified at, changed(project, commit, file)."""
    return dependencies.join(changed.select("project", F.col("commit").alias("verified_commit"), F.col("file").alias("entity_file")).distinct(), ["project", "verified_commit", "entity_file"], "left_semi")


def touches(line: Column, entity: str) -> Column:
    """Whether a line of a diff adds or removes the declaration of an entity."""
    return F.rlike(line, F.lit(rf"^[+-]\s*(?:export\s+|public\s+|async\s+|pub\s+)*(?:func|function|def|class|type|struct|interface|fn|const|var|let)\b[^\n]*\b{entity}\b"))
