"""What a commit log says of functions and methods, for all files or for those that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

#: Days of the log that count as churn.
CHURN_DAYS = 90
COLUMNS = ("blame_author", "blame_date", "blame_commit", "blame_subject", "churn", "staleness")


def of_files(log: DataFrame, today: Column, days: int = CHURN_DAYS) -> DataFrame:
    """file with the COLUMNS: its latest commit (of equal times the one that sorts last) and how often it changed of late. log: hash, author,
    at, subject, file."""
    day = F.col("at").cast("date")
    last = F.max_by(F.struct("author", day.cast("string").alias("date"), "hash", "subject"), F.struct("at", "hash"))
    found = log.where(day <= today).groupBy("file").agg(last.alias("c"), F.count(F.when(day > F.date_sub(today, days), 1)).alias("churn"))
    age = F.datediff(today, F.col("c.date").cast("date"))
    return found.select("file", *[F.col(f"c.{c}").alias(f"blame_{n}") for n, c in (("author", "author"), ("date", "date"), ("commit", "hash"), ("subject", "subject"))], "churn", F.round(scalars.staleness(age, F.col("churn")), 1).alias("staleness"))


def _asked(nodes: DataFrame) -> DataFrame:
    own = nodes.where("type in ('function', 'method')")
    return own.where("coalesce(provenance, '') not in ('vendored', 'generated')") if "provenance" in nodes.columns else own


def enriched(nodes: DataFrame, log: DataFrame, today: Column, days: int = CHURN_DAYS) -> DataFrame:
    """id, file and the COLUMNS of functions and methods of first-party files that have a commit."""
    return _asked(nodes).select("id", "file").join(of_files(log, today, days), "file")


def refreshed(old: DataFrame, nodes: DataFrame, log: DataFrame, changed: DataFrame, today: Column, days: int = CHURN_DAYS) -> DataFrame:
    """old rows of enriched() with the files of changed(file) looked at anew, new nodes and lost ones included; other files' rows stay as they
    are. Only those files' part of the log is read into the shuffle."""
    files = changed.select("file").distinct()
    kept = old.join(files, "file", "left_anti")
    new = enriched(nodes.join(files, "file", "left_semi"), log.join(files, "file", "left_semi"), today, days)
    return kept.unionByName(new.select(*kept.columns))
