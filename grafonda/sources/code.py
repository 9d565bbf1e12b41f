"""Source trees as nodes and edges: a file scan, light extractors by language, manifests, commit logs and coverage profiles.

Extraction reads each file's text once in mapInPandas; everything after that is relational.
"""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import languages

# Folders that are never scanned.
SKIPPED = ("vendor", "node_modules", ".git", "dist", "build", "target", "__pycache__", ".venv")
_NODE = "id string, type string, name string, file string, line int, exported boolean, language string, signature string, doc string"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, modified, language, text of all source files below root but in skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = files.where(~F.col("path").rlike("/(" + "|".join(map(re.escape, SKIPPED)) + ")/"))
    text = kept.select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.assign(language=[languages.language_of(p, t or "") for p, t in zip(rows["path"], rows["text"], strict=True)])
            yield rows[["path", "modified", "language", "text"]]

    return text.mapInPandas(told, "path string, modified timestamp, language string, text string").where("language is not null")


def listing_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, changed, removed) between two listings (path, modified)."""
    both = old.select("path", F.col("modified").alias("was")).join(new.select("path", F.col("modified").alias("now")), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def extract(files: DataFrame) -> DataFrame:
    """Nodes of scanned files (path, language, text): a file node each, and entities by the patterns of its language, with their signature
    and the comment above them."""

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, language, text in rows[["path", "language", "text"]].itertuples(index=False):
                base = path.rsplit("/", 1)[-1]
                out.append((f"repo::{path}::{base}", "file", base, path, 1, True, language, "", ""))
                for kind, name, line, _, signature, doc in languages.entities(language, text or ""):
                    last = name.rsplit(".", 1)[-1]
                    shown = last[:1].isupper() if language == "go" else not last.startswith("_")
                    out.append((f"repo::{path}::{name}", kind, name, path, line, shown, language, signature, doc))
            yield pd.DataFrame(out, columns=["id", "type", "name", "file", "line", "exported", "language", "signature", "doc"])

    return files.select("path", "language", "text").mapInPandas(nodes, _NODE).dropDuplicates(["id", "type"])


def _listed(files: DataFrame, found, schema: str) -> DataFrame:
    """Rows of found(language, text) for each file, after its path."""
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(path, *x) for path, language, text in rows[["path", "language", "text"]].itertuples(index=False) for x in found(language, text or "")], columns=columns)

    return files.select("path", "language", "text").mapInPandas(rows_of, schema)


def call_sites(files: DataFrame) -> DataFrame:
    """file, caller, alias, func, caller_id: calls in the bodies of functions."""
    return _listed(files, languages.call_sites, "file string, caller string, alias string, func string").withColumn("caller_id", F.concat_ws("::", F.lit("repo"), "file", "caller"))


def bases(files: DataFrame) -> DataFrame:
    """file, type, base: inheritance by name."""
    return _listed(files, languages.bases, "file string, type string, base string")


def import_aliases(files: DataFrame) -> DataFrame:
    """file, alias, path."""
    return _listed(files, languages.imported, "file string, alias string, path string").distinct()


def plugin_extract(files: DataFrame, command: list[str], allowed: dict[str, str], timeout: int = 30) -> DataFrame:
    """file, kind (node or edge), json: what a program of our own choice says of each file: it gets {"path", "content"} as JSON and answers
    {"nodes": [...], "edges": [...]}. It runs only if its SHA-256 is the one that allowed has for its path; a file that it fails on gives
    nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program = Path(command[0])
        if program.is_symlink() or allowed.get(command[0]) != hashlib.sha256(program.read_bytes()).hexdigest():
            raise PermissionError(f"{command[0]} is not allowed")
        for rows in batches:
            out = []
            for path, text in rows[["path", "text"]].itertuples(index=False):
                try:
                    said = subprocess.run(command, input=json.dumps({"path": path, "content": text}), capture_output=True, text=True, timeout=timeout, check=True)
                    answer = json.loads(said.stdout)
                except (subprocess.SubprocessError, ValueError):
                    continue
                out += [(path, kind, json.dumps(x)) for kind in ("node", "edge") for x in answer.get(f"{kind}s", [])]
            yield pd.DataFrame(out, columns=["file", "kind", "json"])

    return files.select("path", "text").mapInPandas(run, "file string, kind string, json string")


def defines(nodes: DataFrame) -> DataFrame:
    files = nodes.where("type = 'file'").select("file", F.col("id").alias("from_id"))
    return nodes.where("type <> 'file'").join(files, "file").select("from_id", F.col("id").alias("to_id"), F.lit("DEFINES").alias("type"))


def imports(files: DataFrame) -> DataFrame:
    """file, path: what files import, by language."""
    return import_aliases(files).select("file", "path").distinct()


def classified(files: DataFrame) -> DataFrame:
    return files.withColumn("provenance", scalars.provenance(F.col("path"), F.col("text")))


def commits(lines: DataFrame) -> DataFrame:
    """hash, author, at, subject, files of log records in one text column: 0x1e before each, 0x1f between fields, files by lines."""
    record = F.explode(F.filter(F.split("value", "\u001e"), lambda r: r != "")).alias("r")
    part = F.split("r", "\u001f")
    return lines.select(record).select(F.trim(part[0]).alias("hash"), part[1].alias("author"), F.try_to_timestamp(part[2]).alias("at"), part[3].alias("subject"), F.filter(F.split(F.coalesce(F.get(part, F.lit(4)), F.lit("")), "\n"), lambda f: f != "").alias("files"))


def churn(log: DataFrame, since) -> DataFrame:
    """file, commits since a time."""
    return log.where(F.col("at") >= since).select(F.explode("files").alias("file")).groupBy("file").agg(F.count("*").alias("commits"))


def recent_commits(log: DataFrame, keep: int = 3) -> DataFrame:
    each = log.select("hash", "subject", "at", F.explode("files").alias("file"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("at"), "hash"))).where(F.col("rank") <= keep)


def coverage_blocks(lines: DataFrame) -> DataFrame:
    """file, start, end, statements, count of a coverage profile's lines: file:line.col,line.col statements count."""
    p = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ (\d+) (\d+)$"
    pick = lambda k: F.regexp_extract("value", p, k)
    return lines.where(F.col("value").rlike(p)).select(pick(1).alias("file"), pick(2).cast("int").alias("start"), pick(3).cast("int").alias("end"), pick(4).cast("int").alias("statements"), pick(5).cast("int").alias("count"))


def manifest_dependencies(manifests: DataFrame, keep: int = 10) -> DataFrame:
    """path, name of up to `keep` dependencies of each manifest (path, text): module files, package files, requirements, crates and Python projects."""
    name = F.substring_index("path", "/", -1)
    found = (
        F.when(name == "go.mod", F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:require )?([\w.-]+\.[\w.-]+/[\w./-]+) v"), F.lit(1)))
        .when(name == "package.json", F.map_keys(F.map_concat(F.coalesce(F.from_json("text", "dependencies map<string,string>")["dependencies"], F.create_map().cast("map<string,string>")))))
        .when(name == "requirements.txt", F.regexp_extract_all("text", F.lit(r"(?m)^([A-Za-z0-9][\w.-]*)"), F.lit(1)))
        .when(name == "Cargo.toml", F.regexp_extract_all(F.regexp_extract("text", r"(?s)\[dependencies\](.*?)(\n\[|$)", 1), F.lit(r"(?m)^([\w-]+)\s*="), F.lit(1)))
        .when(name == "pyproject.toml", F.regexp_extract_all(F.regexp_extract("text", r"(?s)dependencies\s*=\s*\[(.*?)\]", 1), F.lit(r"""["']([A-Za-z0-9][\w.-]*)"""), F.lit(1)))
        .otherwise(F.array().cast("array<string>"))
    )
    return manifests.select("path", F.posexplode(F.slice(found, 1, keep)).alias("place", "name"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def profile_shares(lines: DataFrame) -> DataFrame:
    """name, flat_pct of the lines of a profile's top table: flat flat% sum% cum cum% function."""
    p = r"^\s*\S+\s+([\d.]+)%\s+[\d.]+%\s+\S+\s+[\d.]+%\s+(.+?)\s*$"
    return lines.where(F.rlike("value", F.lit(p))).select(F.regexp_extract("value", p, 2).alias("name"), F.regexp_extract("value", p, 1).cast("double").alias("flat_pct"))


def profiled(nodes: DataFrame, shares: DataFrame) -> DataFrame:
    """id, flat_pct: a profile's shares on the functions and methods of their short name (package and pointer marks taken off)."""
    short = F.regexp_replace(F.substring_index("name", "/", -1), r"^[^.]*\.|\(\*?|\)", "")
    named = shares.select(F.lower(short).alias("key"), "flat_pct").groupBy("key").agg(F.sum("flat_pct").alias("flat_pct"))
    return nodes.where("type in ('function', 'method')").select("id", F.lower("name").alias("key")).join(named, "key").select("id", "flat_pct")


def workspaces(manifests: DataFrame) -> DataFrame:
    """path, member: folders that a package file's workspaces or a module file's local replacements name."""
    name = F.substring_index("path", "/", -1)
    found = F.when(name == "package.json", F.from_json("text", "workspaces array<string>")["workspaces"]).when(name == "go.mod", F.regexp_extract_all("text", F.lit(r"=>\s+(\.{1,2}/\S+)"), F.lit(1)))
    return manifests.select("path", F.explode(found).alias("member"))
