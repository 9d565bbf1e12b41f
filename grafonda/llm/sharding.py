"""Sharding by a two-pass external shuffle.

Pass one scatters every row to a bucket by a seeded hash; a bucket is small enough for memory. Pass two shuffles each
bucket with Fisher-Yates and deals its rows out. A bucket's first place in the whole order is the number of rows in the
buckets before it, so row i of the order goes to shard i mod shards at slot i div shards: counts are at most one apart
and slots have no gaps. The scatter has at most PARTS partitions; beyond that many buckets a partition sorts its own.

Nulls: a null text counts as empty (size 1, CRC-32 of nothing, 0); a null key is hashed like a value. Ties and repeated
rows: the scatter hash also takes a row's place in the scan, so copies spread over buckets and each keeps its own slot; one seed
gives one order for files that are split alike, and another for files split otherwise. Very long texts: a bucket holds one row at
least. Empty table: an empty result. Columns of the input with the names of the outcome (shard, slot) are replaced; work columns
get names that the input doesn't use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import fresh, small_batches, work_table

#: Partitions of the scatter at most; with more buckets than these a partition holds several, sorted, and shuffles one after the other.
PARTS = 1 << 15


def external_shuffle(df: DataFrame, shards: int, seed: int = 17, bucket_bytes: int = 24 << 20, text: str = "text") -> DataFrame:
    """All columns and rows of df, with shard (int) and slot (long). The order of slots is a seeded uniform shuffle."""
    df = df.drop("shard", "slot")
    weight, scatter, bucket = fresh(df, "weight", "scatter", "bucket")
    scattered = work_table(
        df.withColumns(
            {
                weight: F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 64,
                scatter: F.xxhash64(F.lit(seed), *[c for c, kind in df.dtypes if kind in ("bigint", "int", "string")], F.monotonically_increasing_id()),
            }
        ),
        "scattered",
    )
    total = scattered.agg(F.sum(weight)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    each = -(-buckets // PARTS)
    parts = -(-buckets // each)
    dealt = scattered.drop(weight).withColumn(bucket, F.pmod(F.col(scatter), F.lit(buckets)))
    part = (F.floor(F.col(bucket) / each)).cast("int")
    sizes = np.zeros(parts + 1, np.int64)
    for r in dealt.groupBy(part.alias("part")).count().collect():  # at most PARTS rows
        sizes[r["part"] + 1] = r["count"]
    offsets = df.sparkSession.sparkContext.broadcast(np.cumsum(sizes))
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    names = [f.name for f in schema.fields]

    def fisher_yates(batches):
        held, number, at = [], -1, 0

        def out():
            nonlocal at
            table = pa.Table.from_batches(held)
            rows = np.random.Generator(np.random.PCG64([seed, number])).permutation(table.num_rows)
            place = at + np.arange(len(rows))
            at += len(rows)
            held.clear()
            for batch in table.select(table.column_names[: len(names) - 2]).take(pa.array(rows)).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], names)

        for batch in batches:
            own = batch.column(batch.num_columns - 1).to_numpy()
            edges = np.flatnonzero(np.diff(own)) + 1
            for a, b in zip([0, *edges], [*edges, len(own)], strict=True):
                if b > a and own[a] != number:
                    if held:
                        yield from out()
                    else:
                        at = int(offsets.value[own[a] // each])
                    number = int(own[a])
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from out()

    # a partition for each run of buckets; its rows are sorted, on disk if need be, so a task holds one bucket at a time
    rows = dealt.select(*df.columns, scatter, bucket).repartitionById(parts, part).sortWithinPartitions(bucket, scatter).select(*df.columns, bucket)
    return small_batches(rows).mapInArrow(fisher_yates, schema)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard; files hold runs of slots in order."""
    shuffled.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_external_shuffle(spark, sf_dir: str) -> DataFrame:
    """Law: rows."""
    out = external_shuffle(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
