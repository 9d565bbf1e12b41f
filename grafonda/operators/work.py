"""Tables written between the steps of an operator, in the folder that all machines share: lineage ends there, so plans stay small
and a lost executor costs no step twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, and in local mode (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", _OWN)
        found = _OWN
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """df, written and read back. by: a column whose values become folders, so that readers of one value prune the others."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def forget(table: DataFrame) -> None:
    """Deletes a table of cut() that nothing reads any more."""
    where, files = _path(table.sparkSession, table._work_path)
    files.delete(where, True)


def delete(spark: SparkSession, path: str) -> None:
    where, files = _path(spark, path)
    files.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _path(spark, path)
    return files.exists(where)


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df in tasks of about `rows` rows, by columns or in turn: for work that the bytes of a table say little about."""
    return df.repartition(max(1, -(-df.count() // rows)), *by)
