"""Token ids as ORC files: integer runs, row indexes and Bloom filters on document ids, for reads by stripe and by document.

A row is a document: its id, part (the file's place in the order), at (ids before it in its part), n_tokens and ids. Texts are range-sorted by
document id, and the task that writes a part encodes it, so ids are never shuffled. ORC keeps whole numbers as runs and short differences
(its integer run-length encoding), in stripes that are read in parallel, with an index entry every ROWS_INDEXED rows. Readers of
a few documents push their ids down: stripes and row groups are left out by the index and the Bloom filter. Readers of part, at and n_tokens do
not touch the ids. A document's start is the sum of the parts before its own, from the files, plus at.

Nulls: a null text is an empty one, of the end id alone; null document ids come first. Ties: rows that share an id come in the order they are
read, and each is a row with its own start. Repeated rows: each is written. Texts of any length are encoded whole. Empty table: files
without rows, an empty result. Only the key and the text are read, so other columns never clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import packing, tokens
from .storage import discard_at_exit, shared_path, small_batches

STRIPE_BYTES = 8 << 20
ROWS_INDEXED = 1000
FALSE_POSITIVES = 0.01


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """key, part, at, n_tokens, ids in ascending key order within and across partitions."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(packing.common_words(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), path))
    order = ["key", "tie"]
    dealt = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("tie")).repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches):
        bpe = packing._tokenizer(path)
        bpe.recall(shared.value)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, raw, rows in tokens.chunks(batch.column(1), 1 << 21):
                ids, first = bpe.encode(raw, rows)
                flat = np.insert(ids, first[1:], end).astype(np.int32)
                first = first + np.arange(len(first))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(at + first[:-1]), pa.array(np.diff(first)), lists], [key, "part", "at", "n_tokens", "ids"])
                at += int(first[-1])
        bpe.forget()

    return small_batches(dealt.select("key", "text")).mapInArrow(encode, f"`{key}` {kind}, part int, at long, n_tokens long, ids array<int>")


def write(docs: DataFrame, to: str, path: str, key: str = "doc_id", text: str = "text", end: int = 0) -> None:
    """Writes all documents' ids to ORC files in the folder `to`."""
    rows = encoded(docs, path, key, text, end)
    options = {"orc.bloom.filter.columns": key, "orc.bloom.filter.fpp": FALSE_POSITIVES, "orc.row.index.stride": ROWS_INDEXED, "orc.stripe.size": STRIPE_BYTES, "compression": "zstd"}
    rows.write.options(**options).orc(to)


def read(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.orc(where)


def of_documents(spark: SparkSession, where: str, ids: list, key: str = "doc_id") -> DataFrame:
    """The rows of the documents asked for (a stated, short list), by index and Bloom filter."""
    return read(spark, where).where(F.col(key).isin(ids))


def part_starts(spark: SparkSession, where: str) -> DataFrame:
    """part, base (ids in all parts before it): one row per file, read without the ids."""
    sizes = read(spark, where).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    return sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))


def positions(spark: SparkSession, where: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, from the files: length and crc are those of the ids read."""
    files = read(spark, where)
    kind = files.schema[key].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            ids = batch.column(3)
            first = ids.offsets.to_numpy().astype(np.int64)
            data = memoryview(ids.values.to_numpy().astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(first)), pa.array(crc, pa.int64())], [key, "part", "at", "n_tokens", "ids_crc32"])

    rows = small_batches(files.select(key, "part", "at", "ids")).mapInArrow(digest, f"`{key}` {kind}, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(part_starts(spark, where), "part").select(key, (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op13_token_orc(spark, sf_dir: str) -> DataFrame:
    where = shared_path(spark, "token_ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), where, packing.tokenizer_path())
    discard_at_exit(spark, where)
    return positions(spark, where)
