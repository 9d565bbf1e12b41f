"""Work tables in the folder that all machines share, and small helpers for plans.

Nulls: any column may be null; a null doc_id is never held out and its rows share one place in a sample. Empty tables give
empty work tables. Names that clash: see fresh.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = "file:///tmp/checkpoints"
#: Bytes of an Arrow batch on its way to a Python worker, so that a worker's memory does not follow the length of the texts.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, and in local mode (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", _OWN)
        found = _OWN
    return found.rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session hands Arrow batches of at most BATCH_BYTES (or one row) to Python workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name).removesuffix("b")) <= BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder of its own, not made yet, in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard_at_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def work_table(df: DataFrame, name: str, held: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, a lost executor costs no recomputation. held: rows of a row group,
    which is what writers and readers hold at once; for rows of megabytes.

    The folder goes with forget(), or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.row.count.limit", str(held)) if held else writer).parquet(path)
    discard_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def forget(table: DataFrame) -> None:
    """Deletes a work table that nothing reads any more."""
    spark = table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(table._work_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like names that df does not use (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus is remainder; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sampled(df: DataFrame, doc_id: str, most: int, total: int, seed: int = 7) -> DataFrame:
    """About most of total rows, chosen by a seeded hash of doc_id: the same rows on every run."""
    if total <= most:
        return df
    cut = int(most / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 30)) < cut)
