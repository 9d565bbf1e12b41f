"""Best-fit packing of token sequences by large-item matching.

Documents become pieces of at most `capacity` tokens. The packer sees only how many pieces there are of each length, so
its work is bounded by the capacity, not by the data: pieces longer than a third of the capacity are matched, at most two
to a bin, the largest with the largest that still fits; then smaller ones, in falling order, go into the fullest bin that
still has room. A plan is a list of (lengths in a bin, number of such bins). Pieces take their places in the plan by
their rank among pieces of equal length, and ranks come from counts per (length, salt), so a length that a third of all
pieces share is ranked in many tasks.

Nulls: a null text is an empty one, of one token (the end); a null doc_id is a row like any other. Ties and repeated rows: any
order among equal lengths; every row gets its own place. Empty table: an empty result. Texts of any length are tokenised whole, a
run of bytes at a time. Of the input only doc_id and text are read, so other columns never clash; place() replaces columns named
sequence_id and offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .storage import fresh, sampled, small_batches, work_table

CAPACITY = 2048
SALTS = 64
#: Distinct pre-tokens that a worker knows at a time, until its partition ends.
REMEMBER = 1 << 19
#: Plain texts are ASCII without control characters and apostrophes, and Latin-1 letters: bytes that stand alone, and those after 0xC3.
_ONE, _TWO = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_ONE[32:127] = _ONE[[9, 10, 13]] = True
_ONE[39] = False
_TWO[0x80:0xC0] = True
_TWO[[0x97, 0xB7]] = False
_KIND = np.full(256, 3, dtype=np.uint8)  # 0 letter, 1 number, 2 white space, 3 other
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 0
_KIND[48:58] = 1
_KIND[[32, 9, 10, 13]] = 2


def _letters() -> dict[int, str]:
    """How a byte-level vocabulary spells each byte: printable Latin-1 as itself, the others in turn from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [x for x in range(256) if x not in printable]
    return {x: chr(x if x in printable else 0x100 + others.index(x)) for x in range(256)}


class ByteBpe:
    """Ids of the library's tokenizer for byte_bpe_50k.json. Plain texts are cut into pre-tokens in numpy, of which the library's model
    encodes each distinct one once; all other texts go to the library whole. At most REMEMBER pre-tokens are known at a time, by
    their bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker is one of many
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, _letters()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Appends pre-tokens that are not known yet."""
        ids, ends, base = [], [], len(self.ids)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        for word in words:
            ids += [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]
            ends.append(len(ids))
        self.ids = np.concatenate((self.ids, np.array(ids, np.uint32)))
        self.start = np.concatenate((self.start, base + np.array(ends, np.int64)))

    def known(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        return list(self.place), self.ids, self.start

    def recall(self, known: tuple[list[bytes], np.ndarray, np.ndarray]) -> None:
        """Starts from what another one knows."""
        self.place, self.ids, self.start = {w: k for k, w in enumerate(known[0])}, known[1], known[2]

    def _entries(self, words: list[bytes]) -> np.ndarray:
        """The place of each distinct pre-token."""
        if len(self.place) + len(words) > REMEMBER:
            self.forget()
        get = self.place.get
        entry = [get(w, -1) for w in words]
        new = [w for w, e in zip(words, entry, strict=True) if e < 0]
        if new:
            self.learn(new)
            get = self.place.__getitem__
            entry = [e if e >= 0 else get(w) for w, e in zip(words, entry, strict=True)]
        return np.array(entry, dtype=np.int64)

    def _plain(self, raw: np.ndarray, at: np.ndarray, data: bytes) -> np.ndarray:
        """Which rows are plain."""
        after = _TWO[raw]
        after[1:] &= raw[:-1] == 0xC3
        after[0] = False
        lead = raw == 0xC3
        lead[:-1] &= after[1:]
        lead[-1] = False
        out = tokens.segment_sums(~(_ONE[raw] | after | lead), at) == 0
        if any(x in data for x in self.special):
            out &= np.array([not any(data.find(x, a, b) >= 0 for x in self.special) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], dtype=bool)
        return out

    def cut(self, raw: np.ndarray, at: np.ndarray, data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pre-tokens of all plain rows, each row's first, which rows are plain)."""
        n = len(raw)
        plain = self._plain(raw, at, data)
        kind = _KIND[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        # a run of one kind is a pre-token; of white space before other things its last character stands apart, and joins what follows if it is a blank
        begin = edge.copy()
        begin[1:n] |= kind[1:] != kind[:-1]
        space = kind == 2
        last = np.zeros(n, dtype=bool)
        last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
        begin[:n] |= last
        last[:-1] &= raw[:-1] == 32
        begin[1:n] &= ~last[:-1] | edge[1:n]
        if not plain.all():  # a text that is not plain is one stretch, which is left out below
            begin[:n] &= np.repeat(plain, np.diff(at)) | edge[:n]
        begin[n] = True
        cuts = np.flatnonzero(begin)
        words = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        first = np.searchsorted(cuts[:-1], at)
        if not plain.all():
            mine = np.repeat(plain, np.diff(first))
            words, cuts = words.filter(pa.array(mine)), cuts[:-1][mine]
            first = np.searchsorted(cuts, at)
        return words.dictionary_encode(), first, plain

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, each row's first)."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        data = raw.tobytes()
        words, first, plain = self.cut(raw, at, data)
        known, bounds = self._entries(words.dictionary.to_pylist()), self.start
        size = (bounds[known + 1] - bounds[known])[kinds := words.indices.to_numpy()]
        begun = bounds[known][kinds]
        count = tokens.segment_sums(size, first)
        ahead = np.cumsum(size)
        flat = self.ids[np.repeat(begun - (ahead - size), size) + np.arange(ahead[-1] if len(ahead) else 0)]
        other = {int(i): np.array(self.library.encode(data[at[i] : at[i + 1]].decode(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(~plain)}
        for i, ids in other.items():
            count[i] = len(ids)
        row = np.zeros(len(at), np.int64)
        np.cumsum(count, out=row[1:])
        if not other:
            return flat, row
        out = np.empty(row[-1], np.uint32)
        out[np.repeat(plain, count)] = flat
        for i, ids in other.items():
            out[row[i] : row[i + 1]] = ids
        return out, row


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def common_words(docs: DataFrame, path: str, rows: int = 4000, most: int = 1 << 17, longest: int = 32) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The `most` commonest pre-tokens (of at most `longest` bytes, so they have a proven size) of about `rows` rows, with their ids. They
    spare tasks work and change no result."""

    def count(batches):
        bpe = _tokenizer(path)
        for batch in batches:
            for _, _, raw, at in tokens.chunks(batch.column(0), 1 << 21):
                if len(raw):
                    words, _, _ = bpe.cut(raw, at, raw.tobytes())
                    n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                    short = pc.less_equal(pc.binary_length(words.dictionary), longest)
                    yield pa.RecordBatch.from_arrays([words.dictionary.filter(short).cast(pa.binary()), pa.array(n).filter(short)], ["word", "n"])

    some = sampled(docs.where("text is not null").select("doc_id", "text"), "doc_id", rows, docs.count()).select("text")
    found = small_batches(some).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).toArrow()
    bpe = ByteBpe(path)
    bpe.learn(found.column("word").to_pylist())
    return bpe.known()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (4 bytes each, little-endian) of every document's pieces.
    A document longer than capacity is cut from its end, so only its first piece may be shorter."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(common_words(docs, path))

    def cut(batches):
        bpe = _tokenizer(path)
        bpe.recall(shared.value)
        for batch in batches:
            for i, j, raw, at in tokens.chunks(batch.column(1), 1 << 21):
                ids, row = bpe.encode(raw, at)
                flat = np.insert(ids, row[1:], end).astype("<u4")
                row = row + np.arange(len(row))
                size = np.diff(row)
                many = -(-size // capacity)
                number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                owner = np.repeat(np.arange(j - i), many)
                short = size - (many - 1) * capacity
                start = np.where(number == 0, 0, short[owner] + (number - 1) * capacity)
                length = np.where(number == 0, short[owner], capacity)
                a = row[owner] + start
                data = memoryview(flat.tobytes())
                parts = [data[4 * x : 4 * (x + y)] for x, y in zip(a.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(i, j - i).take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
        bpe.forget()

    return small_batches(docs.select("doc_id", "text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, bins) for counts of pieces by length."""
    left = {length: n for length, n in counts.items() if n}
    large = sorted(length for length in left if 3 * length > capacity)
    bins: list[tuple[tuple[int, ...], int]] = []
    while large:
        x = large[-1]
        if 2 * x <= capacity and left[x] >= 2:
            bins.append(((x, x), left[x] // 2))
            left[x] %= 2
        else:
            k = bisect_left(large, capacity - x + 1) - 1
            if k >= 0 and large[k] == x:  # one piece of this length is left; it needs another partner
                k -= 1
            if k < 0:
                bins.append(((x,), left[x]))
                left[x] = 0
            else:
                y = large[k]
                n = min(left[x], left[y])
                bins.append(((x, y), n))
                left[x] -= n
                left[y] -= n
                if not left[y]:
                    large.remove(y)
        if not left[x]:
            large.remove(x)
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        if n and gap not in room:
            room[gap] = []
            insort(gaps, gap)
        if n:
            room[gap].append((lengths, n))

    for lengths, n in bins:
        put(lengths, n)
    for s in sorted((length for length in left if 3 * length <= capacity), reverse=True):
        n = left[s]
        while n:
            k = bisect_left(gaps, s)
            if k == len(gaps):
                each = capacity // s
                put((s,) * each, n // each)
                put((s,) * (n % each), 1 if n % each else 0)
                break
            gap = gaps[k]
            lengths, have = room[gap].pop()
            if not room[gap]:
                del room[gap], gaps[k]
            each = gap // s
            full = min(have, n // each)
            put((*lengths, *(s,) * each), full)
            n -= full * each
            rest = have - full
            if rest and n < each:
                put((*lengths, *(s,) * n), 1)
                rest, n = rest - 1, 0
            put(lengths, rest)
    return [x for group in room.values() for x in group]


def place(rows: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """rows with sequence_id and offset (long). rows must give the same rows each time they are read."""
    rows = rows.drop("sequence_id", "offset")
    spark = rows.sparkSession
    salt, rank, base = fresh(rows, "salt", "rank", "base")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*[c for c, k in rows.dtypes if k in ("bigint", "int", "string")]), F.lit(SALTS)))
    sizes = salted.groupBy(length, salt).agg(F.count("*").alias(base)).toArrow().to_pylist()  # at most capacity * SALTS rows
    total: dict[int, int] = {}
    before = []
    for r in sorted(sizes, key=lambda r: (r[length], r[salt])):
        before.append((r[length], r[salt], total.get(r[length], 0)))
        total[r[length]] = total.get(r[length], 0) + r[base]
    taken, slots, at = dict.fromkeys(total, 0), [], 0
    for lengths, n in plan_bins(total, capacity):
        offset = 0
        for x in lengths:
            slots.append((x, taken[x], at, offset))
            taken[x] += n
            offset += x
        at += n
    if not before:
        return rows.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    by_length: dict[int, list] = {}
    for x, first, number, offset in slots:
        by_length.setdefault(x, []).append((first, number, offset))
    starts = spark.createDataFrame(before, f"`{length}` long, `{salt}` long, `{base}` long")
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy(length, salt).orderBy(*[c for c, k in rows.dtypes if k in ("bigint", "int", "string")])) - 1)
    ranked = ranked.join(F.broadcast(starts), [length, salt]).withColumn(rank, F.col(rank) + F.col(base)).select(*rows.columns, rank)

    # the first ranks of each length's slots in rising order; plan and starts are bounded by the capacity
    shared = spark.sparkContext.broadcast({x: tuple(map(np.array, zip(*v, strict=True))) for x, v in by_length.items()})
    names = rows.columns

    def look_up(batches):
        known = shared.value
        for batch in batches:
            sizes, ranks = batch.column(names.index(length)).to_numpy(), batch.column(len(names)).to_numpy()
            number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for x in np.unique(sizes):
                own = np.flatnonzero(sizes == x)
                first, bins, offsets = known[int(x)]
                k = np.searchsorted(first, ranks[own], "right") - 1
                number[own], offset[own] = bins[k] + ranks[own] - first[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(number), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "sequence_id long, offset long"])
    return ranked.mapInArrow(look_up, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return place(work_table(pieces(docs, path, capacity, with_ids=with_ids), "pieces"), capacity)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


def stage_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces with their ids and places, of every row of docs: null and empty texts are pieces of the end alone, rows
    that repeat or have no id are packed each. An empty table gives an empty result. Other columns of docs are not looked at."""
    return pack(docs, tokenizer_path(), with_ids=True)
