"""Token counts from pre-token frequencies, without materialising ids.

1. One pass finds the distinct pre-tokens of all texts with their frequencies (numpy hashes; summed in a shuffle).
2. Each distinct pre-token is counted once by the tokenizer's library.
3. A second pass joins the counts to each document's pre-token frequencies and sums. Pre-tokens with at least one in
   2**HEAD_BITS of all occurrences number at most 2**HEAD_BITS (a proven bound of 12 bytes each): they are broadcast, so
   hot pre-tokens never meet in a shuffle. All others, each with few occurrences, go through an ordinary join.

A pre-token of the sentencepiece BPE model is a run of blanks with the word after it, cut also before a line break: no
piece of the vocabulary crosses such a place (checked when the model is loaded; if a piece does, whole texts are the
pre-tokens), so no merge does.

Nulls: a null text has 0 bytes and 0 tokens; a null doc_id is a row like any other. Empty table: an empty result. Pre-tokens of any
length and texts of any length are handled whole. Repeated rows: each row, also one that repeats a doc_id, gets its own count. Ties:
none can arise. Pre-tokens that share a hash are found out and joined by their bytes instead. Only key and text are read, so other columns
never clash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .storage import forget, small_batches, work_table

HEAD_BITS = 21
#: Shared hashes that go to the workers at most (8 bytes each); were there more, all rare pre-tokens would be joined by their bytes.
SHARED = 1 << 16
#: Distinct pre-tokens that a task gathers before it passes them on.
GATHER = 1 << 19


@lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    whole = any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
    return model, whole


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pre_tokens(column: pa.Array, whole: bool):
    """Per run of rows: (row, end row, bytes, starts, ends, first). U+2581 is the model's own blank."""
    column = tokens.strings(column)
    if pc.any(pc.match_substring(column, "▁")).as_py():
        column = pc.replace_substring(column, "▁", " ")
    for i, j, raw, at in tokens.chunks(column):
        if whole:
            full = np.flatnonzero(np.diff(at))
            yield i, j, raw, at[full], at[full + 1], np.searchsorted(full, np.arange(j - i + 1))
            continue
        n = len(raw)
        blank = raw == 32
        begin = blank.copy()  # a blank after anything else begins a pre-token
        begin[1:] &= ~blank[:-1]
        begin |= raw == 10
        begin = np.append(begin, True)
        begin[at] = True
        starts = np.flatnonzero(begin[:n])
        ends = np.append(starts[1:], n) if len(starts) else starts
        yield i, j, raw, starts, ends, np.searchsorted(starts, at)


def pieces_of(texts: list[str], path: str) -> list[int]:
    """Tokens of each pre-token. The library puts a blank before every text: a leading blank is taken off, or the added token."""
    model, whole = _library(path)
    if whole:
        return [len(x) for x in model.encode(texts, num_threads=1)]
    got = model.encode([t[1:] if t[:1] == " " else t if t[:1] == "\n" else "\n" + t for t in texts], num_threads=1)
    # alone, "" has no token, but a blank pre-token has one
    return [len(x) if t[:1] == " " and len(t) > 1 else 1 if t == " " else len(x) - 1 if t[:1] == "\n" else len(x) - 2 for t, x in zip(texts, got, strict=True)]


def _hashes(raw, starts, ends, first) -> np.ndarray:
    """The first pre-token of a text without a leading blank gets one (the model's dummy prefix), so texts and words share it."""
    h = tokens.span_hashes(raw, starts, ends)
    lead = first[:-1][np.diff(first) > 0]
    h[lead] = tokens.mix(h[lead] ^ np.uint64(0x5851F42D4C957F2D))
    return h


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """hash, term, n (occurrences), pieces: one row per distinct pre-token of all texts, counted once. Pre-tokens are told apart by their
    bytes, so two rows may have a hash in common."""

    def distinct(batches):
        _, whole = _library(path)
        seen: list[pa.Table] = []

        def out():
            merged = pa.concat_tables(seen).group_by(["hash", "term"]).aggregate([("n", "sum")]).select(["hash", "term", "n_sum"]).rename_columns(["hash", "term", "n"])
            seen.clear()
            return merged.combine_chunks().to_batches()

        held = 0
        for batch in batches:
            for i, j, raw, starts, ends, first in _pre_tokens(batch.column(0), whole):
                if not len(starts):
                    continue
                data = raw.tobytes()
                code = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, ends[-1])), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()
                lead = np.zeros(len(starts), np.int64)
                lead[first[:-1][np.diff(first) > 0]] = 1
                _, at, n = np.unique(2 * code.astype(np.int64) + lead, return_index=True, return_counts=True)
                # the prefix of a text's first pre-token is made explicit: " word" as in the middle of a text
                terms = pa.array([(b" " if x and not whole else b"") + data[a:b] for a, b, x in zip(starts[at].tolist(), ends[at].tolist(), lead[at].tolist(), strict=True)], pa.binary())
                seen.append(pa.table({"hash": tokens.as_signed(_hashes(raw, starts, ends, first)[at]), "term": terms, "n": pa.array(n)}))
                held += len(at)
                if held > GATHER:
                    yield from out()
                    held = 0
        if seen:
            yield from out()

    def count(batches):
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column("term").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("term"), batch.column("n"), pa.array(pieces_of(texts, path), pa.int32())], ["hash", "term", "n", "pieces"])

    found = small_batches(docs.select(text)).mapInArrow(distinct, "hash long, term binary, n long")
    return found.groupBy("hash", "term").agg(F.sum("n").alias("n")).mapInArrow(count, "hash long, term binary, n long, pieces int")


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens: a row for each row of docs."""
    spark = docs.sparkSession
    every = vocabulary(docs, path, text)
    terms = work_table(every.drop("term"), "pieces")
    total = terms.agg(F.sum("n")).first()[0] or 0
    least = total / (1 << HEAD_BITS)
    twice = work_table(terms.groupBy("hash").count().where("count > 1").select("hash"), "shared_hashes")
    clashes = twice.limit(SHARED + 1).toArrow().column("hash").to_numpy()
    by_bytes = len(clashes) > SHARED  # all rare pre-tokens, then
    told = spark.sparkContext.broadcast(np.sort(clashes[:SHARED]))
    marked = terms.join(twice.withColumn("twice", F.lit(True)), "hash", "left")
    head = marked.where((F.col("n") >= least) & F.col("twice").isNull()).select("hash", "pieces").toArrow()
    order = np.argsort(keys := head.column("hash").to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast((keys[order], head.column("pieces").to_numpy()[order]))

    def rows_of(ids, base, row, hashes, words, n):
        columns = [ids.take(pa.array(row)), pa.array(base + row), pa.array(np.zeros(len(row), np.int64)), tokens.as_signed(hashes), words, pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, ["k", "line", "n_bytes", "hash", "term", "n"])

    def frequencies(batches):
        """Rows of a document: one with its head sum (term null), and one per tail pre-token with its frequency."""
        _, whole = _library(path)
        known, pieces = shared.value
        base = 0
        for batch in batches:
            for i, j, raw, starts, ends, first in _pre_tokens(batch.column(1), whole):
                h, inverse = np.unique(_hashes(raw, starts, ends, first), return_inverse=True)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                sums = tokens.segment_sums(np.where(hit, pieces[at] if len(known) else 0, 0)[inverse].astype(np.int64), first)
                sizes = np.diff(tokens.bytes_of(batch.column(1).slice(i, j - i))[1])
                ids = batch.column(0).slice(i, j - i)
                lines = pa.array(np.arange(base + i, base + j))
                nothing = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([ids, lines, pa.array(sizes), nothing, pa.nulls(j - i, pa.binary()), pa.array(sums)], ["k", "line", "n_bytes", "hash", "term", "n"])
                rare = np.flatnonzero(~hit[inverse])
                if len(rare):
                    pair = tokens.rows_of(first)[rare] * len(h) + inverse[rare]
                    clash = by_bytes | np.isin(h.view(np.int64), told.value)
                    plain, tf = np.unique(pair[~clash[inverse[rare]]], return_counts=True)
                    yield rows_of(ids, base + i, plain // len(h), h[plain % len(h)], pa.nulls(len(plain), pa.binary()), tf)
                    if (own := rare[clash[inverse[rare]]]).size:  # each occurrence by its bytes, as vocabulary() spells them
                        lead = np.zeros(len(starts), bool)
                        lead[first[:-1][np.diff(first) > 0]] = True
                        data = raw.tobytes()
                        words = [(b" " if lead[x] and not whole else b"") + data[starts[x] : ends[x]] for x in own.tolist()]
                        yield rows_of(ids, base + i, tokens.rows_of(first)[own], h[inverse[own]], pa.array(words, pa.binary()), np.ones(len(own), np.int64))
            base += batch.num_rows

    kind = docs.schema[key].dataType.simpleString()
    parts = small_batches(docs.select(key, text)).mapInArrow(frequencies, f"k {kind}, line long, n_bytes long, hash long, term binary, n long").withColumn("line", F.struct(F.spark_partition_id().alias("p"), "line"))
    parts = work_table(parts, "frequencies")
    rare = parts.where("hash is not null")
    plain = marked.where(F.col("twice").isNull() & (F.col("n") < least))
    tail = rare.where("term is null").select("k", "line", "n", "hash").join(plain.select("hash", "pieces"), "hash")
    if len(clashes):  # hardly ever: the bytes are gathered once more, of these alone
        spelled = work_table(every if by_bytes else every.join(F.broadcast(twice), "hash", "left_semi"), "spelled")
        tail = tail.unionByName(rare.where("term is not null").select("k", "line", "n", "hash", "term").join(spelled.select("hash", "term", "pieces"), ["hash", "term"]).drop("term"))
    every = parts.where("hash is null").select("k", "line", "n_bytes", "n").unionByName(tail.select("k", "line", F.lit(0).cast("long").alias("n_bytes"), (F.col("n") * F.col("pieces")).alias("n")))
    return every.groupBy("line").agg(F.any_value("k").alias(key), F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).drop("line")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, model_path()).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
