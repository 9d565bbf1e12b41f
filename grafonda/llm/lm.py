"""Language-model scoring with a log-frequency Bloom filter.

The model is a 4-gram model over words: P(w|h) = (c(h,w) + MASS * P(w)) / (c(h) + MASS) with the three words h before w, and
P(w) = (c(w) + 1) / (N + V + 1). Counts of 4-grams and of the 3-grams before them are kept from LEAST on (what occurs once says
nothing about a second text) and quantised by their logarithm: an n-gram of level q is put into the filter q times, as (n-gram, 1)
to (n-gram, q). A scorer probes level after level until one is missing, and takes the middle of that level's counts. The filter is
built in segments by a hash of the n-gram, on the executors; a segment holds about SEGMENT n-grams at any size of the corpus. All bits
of an n-gram lie in one block of 512, those of a level in one word of it.

A filter of up to PART_BYTES is broadcast. Beyond that no worker holds all of it: the distinct n-grams of each run of texts go to the
task that has their segment and their levels come back to the run, a shuffle in proportion to the texts; n-grams with at least one in
2**HEAD_BITS of all occurrences (at most 2**HEAD_BITS by proof) are broadcast, so that none is hot there.

What separates texts: a text whose word sequences occur elsewhere in the corpus scores about log10(c / (c + MASS)) a token, any other
about log10(P(w)); so copied, quoted and boilerplate texts stand out whatever their language.

Exact word counts for P(w) and the base score are joined: words with at least one in 2**HEAD_BITS of all occurrences are broadcast, all
others go through an ordinary join and are rare, so no key is hot.

Nulls: a null text is an empty one: one token, the end; a null doc_id is a row like any other. No training texts: every count is 0,
and scores are 0. Empty tables: an empty result. Repeated rows are scored each, and alike. Words are known by 64-bit hashes. Texts of
any length are read whole. Only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .storage import forget, held_out, small_batches, work_table

BASE = 1.5
ORDER = 4
LEAST = 2
MASS = 0.5
#: Bits of the filter for each n-gram and level, and those set.
BITS, PROBES = 12, 5
HEAD_BITS = 21
PART_BYTES = 96 << 20
#: N-grams that a task gathers before it passes them on, and that a segment is meant to hold.
GATHER, SEGMENT = 1 << 21, 1 << 20
#: Bytes of the texts that ask a segment together, and such runs in a row group: a reader holds a whole row group of large rows at once.
RUN_BYTES, RUNS_HELD = 4 << 20, 4
END, START = np.uint64(0xE17A1465EB7C1C2B), np.uint64(0x2D358DCCAA6C78A5)
_LEVELS = 80


def _level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts / LEAST) / log(BASE) + 1e-9).astype(np.int64)


def _level_counts() -> np.ndarray:
    """The count that a level stands for: the middle of the whole numbers in it; 0 for level 0."""
    low = np.ceil(LEAST * BASE ** np.arange(_LEVELS) - 1e-9)
    high = np.maximum(np.ceil(LEAST * BASE ** np.arange(1, _LEVELS + 1) - 1e-9) - 1, low)
    return np.concatenate(([0.0], (low + high) / 2))


def texts_tokens(column: pa.Array, most: int = 1 << 20):
    """(row, end row, token hashes, first) per run of rows: words between ASCII white space, ASCII capitals lowered, and an end for each row."""
    for i, j, raw, at in tokens.chunks(column, most):
        hashes, first = tokens.words(raw, at, tokens.INK)
        yield i, j, np.insert(hashes, first[1:], END), first + np.arange(len(first))


def _grams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ORDER-gram and of the (ORDER - 1)-gram that end in each token; before a text there are START tokens."""
    key, keys = h, [h]
    opening = first[:-1]
    for _ in range(ORDER - 1):
        before = np.empty_like(key)
        before[1:] = key[:-1]
        before[opening] = START
        key = tokens.mix(before * np.uint64(0xD6E8FEB86659FD93) + h)
        keys.append(key)
    return keys[-1], tokens.mix(keys[-2] ^ np.uint64(0x9FB21C651E98DF25))


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts[order], new) if len(keys) else counts


def _short(keys: np.ndarray, wide: int) -> np.ndarray:
    """The segment's number (wide leading bits) and the next 32 bits of each key, as one number."""
    return keys >> np.uint64(32 - wide)


def _places(keys: np.ndarray, level: int, blocks: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(word, mask) of (key, level) in segments of so many blocks."""
    a = tokens.mix(keys)
    word = ((a >> np.uint64(32)) * np.uint64(blocks) if np.isscalar(blocks) else (a >> np.uint64(32)) * blocks) >> np.uint64(32)
    b = tokens.mix(a + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    mask = np.zeros(len(keys), np.uint64)
    for k in range(PROBES):
        mask |= np.uint64(1) << (b >> np.uint64(3 + 6 * k) & np.uint64(63))
    return word * np.uint64(8) + (b & np.uint64(7)), mask


def _filled(keys: np.ndarray, level: np.ndarray) -> bytes:
    """A segment's bits."""
    blocks = max(1, ceil(int(level.sum()) * BITS / 512))
    seen = np.zeros(blocks * 512, dtype=bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        word, mask = _places(keys[level >= q], q, blocks)
        for bit in range(64):
            seen[(word[(mask >> np.uint64(bit) & np.uint64(1)).astype(bool)] * np.uint64(64) + np.uint64(bit)).astype(np.int64)] = True
    return np.packbits(seen, bitorder="little").tobytes()


class Filter:
    """Some of a filter's segments, by number; n-grams of other segments have level 0."""

    def __init__(self, segments: dict[int, bytes], wide: int):
        self.wide, self.low = wide, min(segments, default=0)
        size = np.array([len(segments.get(k, b"")) for k in range(self.low, max(segments, default=-1) + 1)], np.uint64)
        self.blocks, self.start = size // np.uint64(64), (np.cumsum(size) - size) // np.uint64(8)
        self.data = np.frombuffer(b"".join(x for _, x in sorted(segments.items())), np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 if it is not there."""
        out, short = np.zeros(len(keys), np.int8), _short(keys, self.wide)
        segment = (short >> np.uint64(32)).astype(np.int64) - self.low
        left = np.flatnonzero((segment >= 0) & (segment < len(self.blocks)))
        left = left[self.blocks[segment[left]] > 0]
        short, blocks, start = short[left], self.blocks[segment[left]], self.start[segment[left]]
        level = 1
        while len(left) and level <= _LEVELS:
            word, mask = _places(short, level, blocks)
            there = self.data[(word + start).astype(np.int64)] & mask == mask
            left, short, blocks, start = left[there], short[there], blocks[there], start[there]
            out[left] = level
            level += 1
        return out


def word_counts(training: DataFrame) -> DataFrame:
    """hash, n: every token of the training texts, ends included."""

    def count(batches):
        keys, held = [], 0

        def out():
            k, n = _merged(np.concatenate([x[0] for x in keys]), np.concatenate([x[1] for x in keys]))
            keys.clear()
            return pa.RecordBatch.from_arrays([tokens.as_signed(k), pa.array(n)], ["hash", "n"])

        for batch in batches:
            for _, _, h, _ in texts_tokens(batch.column(0)):
                keys.append(np.unique(h, return_counts=True))
                held += len(keys[-1][0])
                if held > GATHER:
                    yield out()
                    held = 0
        if keys:
            yield out()

    return small_batches(training.select("text")).mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def build_segments(training: DataFrame, total: int) -> tuple[DataFrame, int]:
    """(segment, bits, head, levels) rows and the number of leading bits of a key that choose its segment. head: keys (see _short) of the
    n-grams that have at least one in 2**HEAD_BITS of all occurrences."""
    wide = max(1, (2 * total // SEGMENT).bit_length())
    shift, least = np.uint64(64 - wide), 2 * total / (1 << HEAD_BITS)

    def count(batches):
        held, size = [], 0

        def out():
            k, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            many = -(-n // 255)  # a count takes a byte; larger ones are dealt over several
            last, rest = np.cumsum(many) - 1, n - 255 * (many - 1)
            k, n = np.repeat(k, many), np.full(int(many.sum()), 255)
            n[last] = rest
            cut = np.searchsorted(k, np.arange(1 << wide, dtype=np.uint64) << shift)
            short, n = _short(k, wide).astype(np.uint32), n.astype(np.uint8)
            for number, (a, b) in enumerate(zip(cut, [*cut[1:], len(k)], strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([short[a:b].tobytes()], pa.binary()), pa.array([n[a:b].tobytes()], pa.binary())], ["segment", "keys", "counts"])

        for batch in batches:
            for _, _, h, first in texts_tokens(batch.column(0)):
                held += _grams(h, first)
                size += 2 * len(h)
                if size > GATHER:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    def fill(table: pa.Table) -> pa.Table:
        number = table.column("segment")[0].as_py()
        keys, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", np.uint32), ("counts", np.uint8)))
        keys, counts = _merged(keys.astype(np.uint64) | np.uint64(number << 32), counts.astype(np.int64))
        keys, counts = keys[counts >= LEAST], counts[counts >= LEAST]
        bits, top = _filled(keys, _level(counts)), keys[counts >= max(least, LEAST)]
        told = Filter({number: bits}, wide).levels(top << np.uint64(32 - wide))  # what the filter itself says
        binary = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([bits], pa.binary()), "head": binary(top), "levels": binary(told)})

    parts = small_batches(training.select("text")).mapInArrow(count, "segment int, keys binary, counts binary")
    return parts.groupBy("segment").applyInArrow(fill, "segment int, bits binary, head binary, levels binary"), wide


def scored_sums(docs: DataFrame, counts: DataFrame, total: int, kinds: int, mass: float, found: Filter | None) -> DataFrame:
    """doc_id, n_tokens, n_known, logs (the sum of log10(c + 1)) and score for each row of docs (doc_id, text and, without a filter, levels:
    a byte for each token's 4-gram and then for each one's 3-gram); line tells rows apart."""
    least = total / (1 << HEAD_BITS)
    context = docs.sparkSession.sparkContext
    head = counts.where(F.col("n") >= least).toArrow()
    keys = head.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = context.broadcast((keys[order], head.column("n").to_numpy()[order].astype(np.float64)))
    filtered = context.broadcast(found)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "line", "n_tokens", "hash", "known", "logs", "score", "whole", "before"]

    def frequencies(batches):
        known, value = shared.value
        by_level = _level_counts()
        base = 0
        for batch in batches:
            for i, j, h, first in texts_tokens(batch.column(1)):
                u, inverse = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(known, u), max(len(known) - 1, 0))
                hit = known[at] == u if len(known) else np.zeros(len(u), bool)
                c = np.where(hit, value[at] if len(known) else 0.0, 0.0)
                if filtered.value is not None:
                    whole, above = (filtered.value.levels(k) for k in _grams(h, first))
                else:
                    both, size = np.frombuffer(b"".join(batch.column(2).slice(i, j - i).to_pylist()), np.int8), np.diff(first)
                    where = np.repeat(first[:-1], size) + np.arange(len(h))
                    whole, above = both[where], both[where + np.repeat(size, size)]
                logs = np.add.reduceat(np.where(hit, np.log10(c + 1), 0.0)[inverse], first[:-1])
                before = np.zeros(len(h), np.int8)
                before[1:] = above[:-1]
                before[first[:-1]] = 0
                before = np.maximum(before, whole)
                seen = hit[inverse]  # a rare word's own count is not known here
                p = (by_level[whole] + mass * (c[inverse] + 1) / (total + kinds + 1)) / (by_level[before] + mass)
                own = np.where(seen, np.log10(p), 0.0)
                ids, lines = batch.column(0).slice(i, j - i), np.arange(base + i, base + j)
                zero = pa.array(np.zeros(j - i))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lines), pa.array(np.diff(first)), pa.nulls(j - i, pa.int64()), pa.array(np.add.reduceat(seen.astype(np.int64), first[:-1])), pa.array(logs), pa.array(np.add.reduceat(own, first[:-1])), zero, zero], names)
                rare = np.flatnonzero(~seen)
                if len(rare):
                    # equal words of a text with equal counts around them make one row
                    state = ((tokens.rows_of(first)[rare] * len(u) + inverse[rare]) << 14) + (whole[rare].astype(np.int64) << 7) + before[rare]
                    state, tf = np.unique(state, return_counts=True)
                    row, word = (state >> 14) // len(u), (state >> 14) % len(u)
                    nothing = pa.array(np.zeros(len(row)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(lines[row]), pa.array(np.zeros(len(row), np.int64)), tokens.as_signed(u[word]), pa.array(tf), nothing, nothing, pa.array(by_level[state >> 7 & 127]), pa.array(by_level[state & 127])], names)
            base += batch.num_rows

    kinds_of = f"doc_id {kind}, line long, n_tokens long, hash long, known long, logs double, score double, whole double, before double"
    asked = docs.select("doc_id", "text") if found is not None else docs.select("doc_id", "text", "levels")
    parts = small_batches(asked).mapInArrow(frequencies, kinds_of).withColumn("line", F.struct(F.spark_partition_id().alias("p"), "line"))
    parts = work_table(parts, "frequencies")
    shared.destroy()
    filtered.destroy()
    n = F.coalesce("n", F.lit(0))
    p = (F.col("whole") + mass * (n + 1) / (total + kinds + 1)) / (F.col("before") + mass)
    tail = parts.where("hash is not null").drop("logs", "score").join(counts.where(F.col("n") < least), "hash", "left").select("doc_id", "line", "n_tokens", F.when(F.col("n").isNotNull(), F.col("known")).otherwise(0).alias("known"), (F.col("known") * F.log10(n + 1)).alias("logs"), (F.col("known") * F.log10(p)).alias("score"))
    every = parts.where("hash is null").select("doc_id", "line", "n_tokens", "known", "logs", "score").unionByName(tail)
    return every.groupBy("line").agg(F.any_value("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("logs").alias("logs"), F.sum("score").alias("score"))


def levels_by_join(docs: DataFrame, segments: DataFrame, wide: int) -> DataFrame:
    """doc_id, text, levels for each row of docs: n-grams go to their segments and levels come back."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run_up(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, _, _ in tokens.chunks(batch.column(1), RUN_BYTES):
                one = pa.array([0, j - i], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(one, batch.column(0).slice(i, j - i)), pa.ListArray.from_arrays(one, batch.column(1).slice(i, j - i))], ["run", "ids", "texts"])
                number += 1

    runs = work_table(small_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).mapInArrow(run_up, f"run long, ids array<{kind}>, texts array<string>"), "runs", RUNS_HELD)
    tops = segments.select("head", "levels").where("octet_length(head) > 0").toArrow()
    keys, level = (np.frombuffer(b"".join(tops.column(c).to_pylist()), t) for c, t in (("head", np.uint64), ("levels", np.int8)))
    order = np.argsort(keys)
    head = docs.sparkSession.sparkContext.broadcast((keys[order], level[order]))

    def distinct(texts: pa.Array):
        """(tokens' first, places of the 4-grams and then the 3-grams among the distinct keys, the keys, their levels or -1)."""
        known, top = head.value
        _, _, h, first = next(texts_tokens(texts, 1 << 62))
        keys, place = np.unique(_short(np.concatenate(_grams(h, first)), wide), return_inverse=True)
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        level = np.where(known[at] == keys, top[at], -1) if len(known) else np.full(len(keys), -1)
        return first, place, keys, level.astype(np.int8)

    def ask(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                _, _, keys, level = distinct(batch.column("texts").slice(k, 1).flatten())
                keys = keys[level < 0]
                segment = (keys >> np.uint64(32)).astype(np.int32)
                cut = np.flatnonzero(np.append(True, np.diff(segment) != 0)) if len(keys) else np.zeros(0, np.int64)
                parts = [keys[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, np.append(cut, len(keys))[1:], strict=True)]  # without the segment's number
                yield pa.RecordBatch.from_arrays([pa.array(segment[cut]), pa.array(np.full(len(cut), batch.column("run")[k].as_py())), pa.array(parts, pa.binary())], ["segment", "run", "keys"])

    def tell(asked: pa.Table, held: pa.Table) -> pa.Table:
        number = asked.column("segment")[0].as_py() if asked.num_rows else 0
        known = Filter({number: held.column("bits")[0].as_py()} if held.num_rows else {}, wide)
        whole = lambda x: (np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(number << 32)) << np.uint64(32 - wide)
        keys = asked.column("keys").to_pylist()
        found: list[bytes] = []
        a = 0
        while a < len(keys):  # the keys of many runs at a time: a run has few in a segment
            b, n = a, 0
            while b < len(keys) and (b == a or n + len(keys[b]) <= 4 * SEGMENT):
                n += len(keys[b])
                b += 1
            told, at = known.levels(whole(b"".join(keys[a:b]))).tobytes(), 0
            for x in keys[a:b]:
                found.append(told[at : at + len(x) // 4])
                at += len(x) // 4
            a = b
        return pa.table({"run": asked.column("run"), "segment": asked.column("segment"), "told": pa.array(found, pa.binary())})

    told = small_batches(runs).mapInArrow(ask, "segment int, run long, keys binary").groupBy("segment").cogroup(segments.select("segment", "bits").groupBy("segment")).applyInArrow(tell, "run long, segment int, told binary")

    def gather(run: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts = [], []
        levels: list[bytes] = []
        if run.num_rows:
            ids, texts = run.column("ids").combine_chunks().flatten(), run.column("texts").combine_chunks().flatten()
            first, place, _, level = distinct(texts)
            level = level.copy()
            level[level < 0] = np.frombuffer(b"".join(told.sort_by("segment").column("told").to_pylist()), np.int8)
            n = len(place) // 2
            levels = [level[place[a:b]].tobytes() + level[place[n + a : n + b]].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.table({"doc_id": ids, "text": texts, "levels": pa.array(levels, pa.binary())})

    return runs.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(gather, f"doc_id {kind}, text string, levels binary")


def score(docs: DataFrame, training: DataFrame, mass: float = MASS, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs. A filter of up to part_bytes is broadcast."""
    counts = work_table(word_counts(training), "words")
    kinds, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    segments, wide = build_segments(training, total)
    segments = work_table(segments, "segments")
    size = segments.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    if size <= part_bytes:
        held = Filter({r["segment"]: r["bits"] for r in segments.select("segment", "bits").toArrow().to_pylist()}, wide)
        forget(segments)
        sums = scored_sums(docs, counts, total, kinds, mass, held)
    else:
        sums = scored_sums(levels_by_join(docs, segments, wide), counts, total, kinds, mass, None)
    least = F.log10(F.lit(float(total + kinds + 1)))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * least).alias("base_score"), "score")


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 7, 2)
    return score(docs, docs.where(~held)).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
