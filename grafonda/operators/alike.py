"""Pairs of word sets of at least a Jaccard similarity, exactly, without meeting at words: at a low threshold half of each set's words
would have to be joined on.

Each set has a sketch: every word flips one bit of it. Two sketches differ in at most as many bits as their sets differ in words, so
pairs whose sketches differ in more than the similarity allows are none. Sets meet in a grid of blocks by size; a task holds two
blocks' sketches, never words. The pairs that are looked at grow with the square of the sets of one group, what is shuffled for them with
the sets times the blocks of near sizes.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sets in a block; sets that a task compares at a time; least and greatest number of a sketch's bits (powers of 2).
BLOCK, TILE, BITS = 8192, 1024, (64, 32768)


def _bits(size: np.ndarray) -> np.ndarray:
    """Bits of a sketch that tells sets of up to so many words apart: four times as many and more."""
    return np.clip(2 ** np.ceil(np.log2(4 * np.maximum(size, 1))), *BITS).astype(np.int64)


def _sketches(wide: float):
    """Batches of (..., size, hashes) with a sketch in place of hashes, wide enough for sets `wide` times as large (a tile's sizes differ too)."""

    def run(batches):
        for batch in batches:
            hashes = batch.column("hashes")
            flat, at = hashes.flatten().to_numpy().view(np.uint64), hashes.offsets.to_numpy() - hashes.offsets[0].as_py()
            bits = _bits(batch.column("size").to_numpy() * wide)
            out = [np.packbits(np.bincount((flat[at[k] : at[k + 1]] & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1).tobytes() for k, w in enumerate(bits.tolist())]
            rest = [n for n in batch.schema.names if n != "hashes"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(out, pa.binary())], [*rest, "sketch"])

    return run


def _signs(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches, folded to a width, as rows of 1 and -1."""
    out = np.empty((len(sketches), width), np.float32)
    for k, s in enumerate(sketches):
        bits = np.unpackbits(np.frombuffer(s, np.uint8))
        if len(bits) > width:
            bits = np.bitwise_xor.reduce(bits.reshape(-1, width), axis=0)
        out[k] = 1 - 2 * bits.astype(np.float32)
    return out


def _tiles(sizes: np.ndarray, some: np.ndarray) -> list[np.ndarray]:
    """Places by size, in runs of at most TILE whose sizes lie within half an octave."""
    some = some[np.argsort(sizes[some], kind="stable")]
    runs = np.split(some, np.flatnonzero(np.diff(np.floor(2 * np.log2(sizes[some])))) + 1)
    return [run[k : k + TILE] for run in runs for k in range(0, len(run), TILE)]


def _near(sizes: np.ndarray, sketches: list[bytes], left: np.ndarray, right: np.ndarray | None, least: float):
    """Places of the pairs (of left with right; of left with itself if right is None) that may be as similar as `least`."""
    allowed = (1 - least) / (1 + least)
    rows = _tiles(sizes, left)
    columns = rows if right is None else _tiles(sizes, right)
    for i, a in enumerate(rows):
        signs: dict[int, np.ndarray] = {}
        for j in range(i if right is None else 0, len(columns)):
            b = columns[j]
            if sizes[b[0]] * least > sizes[a[-1]] or sizes[a[0]] * least > sizes[b[-1]]:
                continue
            width = int(_bits(np.array([max(sizes[a[-1]], sizes[b[-1]])]))[0])
            width = min(width, 8 * min(min(len(sketches[k]) for k in a), min(len(sketches[k]) for k in b)))
            if width not in signs:
                signs[width] = _signs([sketches[k] for k in a], width)
            differ = (width - signs[width] @ _signs([sketches[k] for k in b], width).T) / 2
            small, large = np.minimum.outer(sizes[a], sizes[b]), np.maximum.outer(sizes[a], sizes[b])
            good = (differ <= allowed * (small + large) + 1e-3) & (small >= least * large - 1e-9)
            x, y = np.nonzero(np.triu(good, 1) if right is None and i == j else good)
            yield a[x], b[y]


def _compare(least: float):
    def run(table: pa.Table) -> pa.Table:
        group, block, sizes = (table.column(c).to_numpy() for c in ("of", "block", "size"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        sketches = table.column("sketch").to_pylist()
        order = np.argsort(group, kind="stable")
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if low == high:
                found += _near(sizes, sketches, own, None, least)
            else:
                found += _near(sizes, sketches, own[block[own] == low], own[block[own] == high], least)
        ids = table.column("id").combine_chunks()
        return pa.table({"a": ids.take(pa.array(np.concatenate([x for x, _ in found]))), "b": ids.take(pa.array(np.concatenate([y for _, y in found])))})

    return run


def candidates(sets: DataFrame, group: list[str], words: str, least: float, block: int = BLOCK) -> DataFrame:
    """a, b: pairs of ids of sets(id, group columns, words: distinct), each once and in no order, among which are all pairs within a group
    that are as similar as `least`. Sets whose group has a null are in no pair."""
    kind = sets.schema["id"].dataType.simpleString()
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    band = F.floor(2 * F.log2(F.size(words))).cast("int")
    known = sets.dropna(subset=group).select("id", F.xxhash64(*group).alias("of"), F.size(words).alias("size"), band.alias("band"), hashes.alias("hashes"))
    sketched = known.mapInArrow(_sketches(1.5 / least), f"id {kind}, of long, size int, band int, sketch binary")
    counts = known.groupBy("of", "band").agg(F.count("*").alias("n"))
    blocks = counts.groupBy("of").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("n") / block).cast("int")))).alias("blocks"))
    few = max(1, ceil((blocks.where(F.col("all") <= block).agg(F.sum("all")).first()[0] or 0) / block))
    near = range(ceil(2 * log2(1 / least)) + 1)
    spread = lambda c, own, up: F.transform(  # noqa: E731  a block's tasks with those of another band
        F.sequence(F.lit(0), F.col("blocks")[c] - 1), lambda k: F.struct(*[x.alias(n) for x, n in zip((own, _code(c, k)) if up else (_code(c, k), own), ("low", "high"))])
    )
    dealt = sketched.join(blocks, "of").withColumn("block", _code(F.col("band"), F.pmod(F.xxhash64("id"), F.col("blocks")[F.col("band")]).cast("int")))
    deals = F.array_distinct(F.flatten(F.filter(F.array(*[F.when(F.col("blocks")[F.col("band") + d].isNotNull(), spread(F.col("band") + d, F.col("block"), d >= 0)) for s in near for d in {s, -s}]), lambda x: x.isNotNull())))
    same = F.transform(deals, lambda x: F.struct(F.least(x["low"], x["high"]).alias("low"), F.greatest(x["low"], x["high"]).alias("high")))
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high")))
    small = F.col("all") <= block
    each = dealt.select("id", "of", "size", "block", "sketch", F.when(small, F.pmod("of", F.lit(few))).otherwise(F.col("of")).alias("task"), F.inline(F.when(small, whole).otherwise(F.array_distinct(same))))
    return each.groupBy("task", "low", "high").applyInArrow(_compare(least), f"a {kind}, b {kind}")


def _code(band: Column, k: Column) -> Column:
    return band.cast("long") * (1 << 24) + k
