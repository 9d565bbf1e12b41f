"""Edit-distance name join: tries of names, descended with rows of a dynamic programme, in shards by length.

A shard holds left names of one length that share one segment. A left name is cut into max+1 segments; at most max edits leave
one of them as it is, at a place that can move by no more than the edits beside it, so a right name asks in the shards of the lengths
within max for its own pieces at those places. A transposition across the end of a segment would spoil two of them; a piece is
therefore also asked for with its last character replaced by the next. No pair of the wanted distance is missed, and nothing is
broadcast or gathered that grows with the names.

In a shard the left names, sorted, are a trie: a node is a run of names with a common prefix. Right names descend together, level by
level: each pair of a right name and a node has the row of the dynamic programme that belongs to the node's prefix (of 2 max + 1
cells around the diagonal) and the row before it, which transpositions need. A child's row is worked out once for all names below it; a pair
goes when all cells of its live rows exceed max. A pair of names meets in several shards and counts in the first.

Shards with many names are cut into a grid of blocks of both sides by hashes of the names: the number of blocks follows from the shard's
counts, every block holds about max(BLOCK, all / 2**HOT_BITS) names of a side. Only shards that are cut are listed in a broadcast, by
a hash of 8 bytes; by the rule they number at most 2**HOT_BITS for each side.

Distance: insertions, deletions and substitutions of a code point, exchanges of adjacent ones, no substring edited twice.

Nulls and empty names take no part. A null id counts as a row, but neither as a first id nor in sums. Repeated rows: equal names are
one entry with their counts; every row counts. Ties: none can arise. Names of any length are compared whole. Empty tables: an empty
result. Only the columns named are read, so others never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import work_table

MAX = 2
BLOCK = 1024
HOT_BITS = 14
#: Rows of shards that a task descends at a time, and pairs of a right name and a left name that they may come to.
GATHER = 1 << 16
FRONTIER = 1 << 20
_KEY = ["length", "part", "segment", "left_block", "right_block"]
_ROW = "length int, part int, segment string, name string"


def lowered(name: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(name, capitals, capitals.lower())


@lru_cache(maxsize=4096)
def segments(length: int, most: int) -> tuple[tuple[int, int], ...]:
    """(start, size) of the most + 1 segments of a name; the later ones take what is left over."""
    at = [length * i // (most + 1) for i in range(most + 2)]
    return tuple((a, b - a) for a, b in zip(at, at[1:], strict=False))


def probes(name: str, length: int, part: int, most: int) -> set[str]:
    """What a left name of this length may have as this segment if it is within most edits of name."""
    (start, size), more = segments(length, most)[part], len(name) - length
    out = set()
    # the edits before a kept segment are at most `part`, those after it at most `most - part`
    for shift in range(max(-part, more - (most - part)), min(part, more + (most - part)) + 1):
        a, b = start + shift, start + shift + size
        if a < 0 or b > len(name):
            continue
        out.add(name[a:b])
        if size and b < len(name):
            out.add(name[a : b - 1] + name[b])
    return out


def _left_rows(names: DataFrame, most: int) -> DataFrame:
    """A row for each segment of each name."""
    other = [f for f in names.schema if f.name != "name"]

    def cut(batches):
        for batch in batches:
            texts = batch.column("name").to_pylist()
            found = [(len(t), i, t[a : a + n], k) for k, t in enumerate(texts) for i, (a, n) in enumerate(segments(len(t), most))]
            if found:
                length, part, segment, row = zip(*found, strict=True)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(part, pa.int32()), pa.array(segment, pa.string()), batch.column("name").take(row), *(batch.column(f.name).take(row) for f in other)], ["length", "part", "segment", "name", *(f.name for f in other)])

    return names.mapInArrow(cut, ", ".join([_ROW, *(f"`{f.name}` {f.dataType.simpleString()}" for f in other)]))


def _right_rows(names: DataFrame, most: int) -> DataFrame:
    """A row for each shard that a name asks in."""

    def ask(batches):
        for batch in batches:
            found = [(length, i, piece, t) for t in batch.column("name").to_pylist() for length in range(max(1, len(t) - most), len(t) + most + 1) for i in range(most + 1) for piece in probes(t, length, i, most)]
            if found:
                length, part, segment, name = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(part, pa.int32()), pa.array(segment, pa.string()), pa.array(name, pa.string())], ["length", "part", "segment", "name"])

    return names.select("name").mapInArrow(ask, _ROW)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def descend(left: list[str], left_group: np.ndarray, right: list[str], right_group: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(right index, left index, distance) of the pairs within a group that are at most `most` apart. The left names have one length, and
    are sorted by group and code points without repeats; group numbers of both sides rise."""
    n, length, width = len(left), len(left[0]) if left else 0, 2 * most + 1
    if not n or not right:
        return
    chars = _codes(left).reshape(n, length)
    # the first character in which a name differs from the one before it; -1 where a group begins: there a root begins
    split = np.full(n, -1, np.int64)
    unlike = chars[1:] != chars[:-1]
    split[1:] = np.where(left_group[1:] != left_group[:-1], -1, np.where(unlike.any(1), unlike.argmax(1), length))
    roots = np.flatnonzero(split < 0)
    root = np.searchsorted(left_group[roots], right_group)
    asked = np.flatnonzero(left_group[roots][np.minimum(root, len(roots) - 1)] == right_group)
    pad = np.full(2 * most + 2, 0xFFFFFFFF, np.uint32)  # stands for no character
    size = np.array([len(t) for t in right])
    flat = np.concatenate([x for t in right for x in (pad, _codes([t]))] + [pad])
    begin = np.cumsum(size + len(pad)) - size
    bound = np.diff(np.append(roots, n))[root[asked]]  # left names under a right name's root
    runs = np.cumsum(bound) // FRONTIER
    offset = np.arange(-most, most + 1)
    for run in np.unique(runs):
        who = asked[runs == run]
        node, starts = root[who], roots
        row = np.broadcast_to(np.where(offset >= 0, offset, most + 1).astype(np.int8), (len(who), width)).copy()
        before = np.full_like(row, most + 1)
        for depth in range(length):
            below = np.flatnonzero(split <= depth)
            first = np.searchsorted(below, starts)
            many = np.diff(np.append(first, len(below)))[node]
            parent = np.repeat(np.arange(len(node)), many)
            child = first[node][parent] + np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)
            name = below[child]
            who, row, before = who[parent], row[parent], before[parent]
            place = begin[who][:, None] + depth + offset[None, :]  # of the character that a cell's column ends with
            own, mine = chars[name, depth][:, None], flat[place]
            new = row + (own != mine)
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
            if depth:
                crossed = (own == flat[place - 1]) & (chars[name, depth - 1][:, None] == mine)
                new = np.where(crossed, np.minimum(new, before + 1), new)
            column = depth + 1 + offset[None, :]
            new[(column < 0) | (column > size[who][:, None])] = most + 1
            for k in range(1, width):
                new[:, k] = np.minimum(new[:, k], new[:, k - 1] + 1)
            new[column > size[who][:, None]] = most + 1
            new = np.minimum(new, most + 1).astype(np.int8)
            live = np.flatnonzero((new.min(1) <= most) | (row.min(1) < most))
            who, node, before, row, starts = who[live], child[live], row[live], new[live], below
            if not len(who):
                break
        if len(who):
            distance = row[np.arange(len(who)), size[who] - length + most]
            near = np.flatnonzero(distance <= most)
            yield who[near], starts[node[near]], distance[near].astype(np.int64)


def _shards(batches, key: list[str]) -> Iterator[pa.Table]:
    """Whole shards, GATHER rows or more at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= GATHER:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_begins(table, key))[-1])
            if last:
                yield table.slice(0, last).combine_chunks()
            held = table.slice(last).combine_chunks().to_batches()
            rows = table.num_rows - last
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _begins(table: pa.Table, key: list[str]) -> np.ndarray:
    """Where a shard begins."""
    out = np.ones(table.num_rows, bool)
    out[1:] = False
    for name in key:
        column = table.column(name)
        out[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
    return out


def _grid(left: DataFrame, right: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with left_block and right_block."""
    limit = max(BLOCK, total >> HOT_BITS)
    key = F.xxhash64("length", "part", "segment").alias("key")
    counts = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = counts.groupBy("key").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where((F.col("l") > limit) | (F.col("r") > limit))
    hot = work_table(counts.select("key", F.ceil(F.greatest("l", F.lit(1)) / limit).cast("int").alias("ls"), F.ceil(F.greatest("r", F.lit(1)) / limit).cast("int").alias("rs")), "hot_shards")

    def placed(side: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        joined = side.withColumn("key", key).join(F.broadcast(hot), "key", "left")
        mine = F.pmod(F.xxhash64(F.lit(11), "name"), F.coalesce(own_blocks, F.lit(1))).cast("int")
        return joined.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other_blocks, F.lit(1)) - 1))).drop("key", "ls", "rs")

    return placed(left, "left_block", "ls", "right_block", "rs"), placed(right, "right_block", "rs", "left_block", "ls")


def _near(left: DataFrame, right: DataFrame, most: int, find, schema: str) -> DataFrame:
    """find(shards, most) over all shards. left: name and other columns, right: name; both without repeats."""
    total = left.count() * (most + 1)
    ours, theirs = _grid(_left_rows(left, most), _right_rows(right, most), total)
    both = ours.withColumn("side", F.lit(0)).unionByName(theirs.withColumn("side", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(*_KEY).sortWithinPartitions(*_KEY, "side", "name")
    return both.mapInArrow(lambda batches: find(_shards(batches, _KEY)), schema)


def _pairs_of(table: pa.Table, most: int):
    """(right row, left row, distance) of a table of shards; pairs that an earlier segment finds too are left to it."""
    group = np.cumsum(_begins(table, _KEY))
    side, length, part = (table.column(c).to_numpy() for c in ("side", "length", "part"))
    names = table.column("name").to_pylist()
    known = lru_cache(maxsize=1 << 14)(lambda name, n, i: probes(name, n, i, most))
    for n in np.unique(length):
        ours, theirs = np.flatnonzero((length == n) & (side == 0)), np.flatnonzero((length == n) & (side == 1))
        for r, m, distance in descend([names[k] for k in ours], group[ours], [names[k] for k in theirs], group[theirs], most):
            r, m = theirs[r], ours[m]
            cuts = segments(int(n), most)
            own = np.array([not any(names[b][cuts[i][0] : sum(cuts[i])] in known(names[a], int(n), i) for i in range(part[a])) for a, b in zip(r.tolist(), m.tolist(), strict=True)], bool)
            yield r[own], m[own], distance[own]


def name_pairs(left: DataFrame, right: DataFrame, most: int = MAX) -> DataFrame:
    """right, left, distance: every pair of different or equal names at most `most` apart. Both sides: one row per name, in a column name."""

    def find(shards):
        for table in shards:
            name = table.column("name")
            for r, m, distance in _pairs_of(table, most):
                yield from pa.table({"right": name.take(pa.array(r)), "left": name.take(pa.array(m)), "distance": pa.array(distance, pa.int32())}).to_batches()

    return _near(left.select("name"), right.select("name"), most, find, "right string, left string, distance int")


def name_counts(left: DataFrame, right: DataFrame, most: int = MAX) -> DataFrame:
    """name (of the right side), distance, n, first, crc: sums and the least over the left names at that distance. left: name, n, first,
    crc. Pairs are summed where they are found, so rows out follow the shards asked, not the pairs."""

    def find(shards):
        for table in shards:
            n, first, crc = (pc.fill_null(table.column(c), v).to_numpy() for c, v in (("n", 0), ("first", (1 << 63) - 1), ("crc", 0)))
            for r, m, distance in _pairs_of(table, most):
                if not len(r):
                    continue
                key, at = np.unique(r * (most + 1) + distance, return_inverse=True)
                sums, least = np.zeros((2, len(key)), np.int64), np.full(len(key), (1 << 63) - 1)
                np.add.at(sums[0], at, n[m])
                np.add.at(sums[1], at, crc[m])
                np.minimum.at(least, at, first[m])
                yield from pa.table({"name": table.column("name").take(pa.array(key // (most + 1))), "distance": pa.array(key % (most + 1), pa.int32()), "n": sums[0], "first": least, "crc": sums[1]}).to_batches()

    found = _near(left.select("name", "n", "first", "crc"), right, most, find, "name string, distance int, n long, first long, crc long")
    found = found.groupBy("name", "distance").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc"))
    return found.withColumn("first", F.nullif("first", F.lit((1 << 63) - 1)))


def names_of(rows: DataFrame, key: str, name: Column) -> DataFrame:
    """name, n, first, crc: one row per name that is neither null nor empty."""
    named = rows.select(name.alias("name"), F.col(key).cast("long").alias("id")).where("name is not null and name != ''")
    return named.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.coalesce(F.sum(F.crc32(F.col("id").cast("string").cast("binary"))), F.lit(0)).alias("crc"))


def misspelt(name: Column, key: Column) -> Column:
    """name with two neighbours exchanged where the crc32 of the key's digits is even: the contract's vendors."""
    h, size = F.crc32(key.cast("string").cast("binary")), F.length(name)
    at = (h % F.greatest(size - 1, F.lit(1))).cast("int")
    other = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 3, size))
    return F.when((h % 2 == 0) & (size >= 2), other).otherwise(name)


def join_counts(clients: DataFrame, vendors: DataFrame, most: int = MAX) -> DataFrame:
    """vendor_id, name, distance, n_clients, first_client_id, clients_crc: a row per vendor's id, name and exact distance. vendors: vendor_id
    and name as it is to be compared; rows that repeat both are one."""
    sellers = work_table(vendors.where("name is not null and name != ''").select("vendor_id", "name").distinct(), "sellers")
    counts = name_counts(work_table(names_of(clients, "client_id", lowered(F.col("name"))), "names"), sellers.select("name").distinct(), most)
    counts = counts.select("name", "distance", F.col("n").alias("n_clients"), F.col("first").alias("first_client_id"), F.col("crc").alias("clients_crc"))
    return sellers.join(counts, "name").select("vendor_id", "name", "distance", "n_clients", "first_client_id", "clients_crc")


def op11_name_join(spark, sf_dir: str) -> DataFrame:
    vendors = spark.read.parquet(f"{sf_dir}/vendors.parquet").select("vendor_id", lowered(misspelt(F.col("name"), F.col("vendor_id"))).alias("name"))
    return join_counts(spark.read.parquet(f"{sf_dir}/clients.parquet"), vendors).drop("name")
