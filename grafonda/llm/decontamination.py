"""Benchmark decontamination: rare words as seeds, then Smith-Waterman alignment.

The score is the best local alignment over the item's length, so edited and paraphrased copies count and shared phrases do not.
No pair at the threshold is missed: such an alignment matches at least `need` words of the item (threshold times its length)
within `span` words of the document, as each match adds 1 and each other word of it takes 1/2. So of any length - need + least
of the item's words it matches `least` or more; those that are rarest over all documents are the item's seeds, and where `least`
of them lie within a span, the words around are aligned to the item's. The counts make this fast and do not change the result.
Documents are joined to items where they lie: the benchmark's word ids and seeds are broadcast in blocks of at most BLOCK_WORDS
words, one pass over the documents a block, so the benchmark may be of any size.

Words are runs of ASCII letters, digits, "_" and non-ASCII characters; ASCII capitals are lowered. Items shorter than N words
must occur whole. Nulls: a null text gives no pair, nor does an item without text or item_id; a document without a doc_id is searched
like any other, and its pairs have a null doc_id. Repeated rows: each document row gives its own pair; items that repeat an item_id are
items of their own. Ties: of equally good alignments the first in the text. Very long texts are searched whole, and aligned only around
seeds. Empty tables: an empty result. Only doc_id, item_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .storage import small_batches

N = 3
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
BLOCK_WORDS = 1 << 21
#: Pairs of a word and an item that holds it, looked at in one go.
ENTRIES = 1 << 21


class Items:
    """A block of the benchmark, made to be broadcast."""

    def __init__(self, ids: pa.Array, texts: pa.Array, n: int = N, threshold: float = THRESHOLD):
        hashes, self.first = tokens.words(*tokens.bytes_of(texts))
        self.ids, self.n = ids, n
        self.vocabulary, self.words = np.unique(hashes, return_inverse=True)
        grams, first = tokens.grams(hashes, self.first, n, short=True)
        self.grams = np.split(grams, first[1:-1])
        self.size = np.diff(self.first)
        self.short = self.size < n
        self.need = np.ceil(threshold * self.size - 1e-9).astype(np.int64)
        self.span = self.size + np.floor((self.size - threshold * self.size) / -GAP + 1e-9).astype(np.int64)
        self.least = np.clip(-(-self.size // 6), 1, np.maximum(self.need, 1))
        only = np.flatnonzero(self.short & (self.size > 0))
        self.whole, self.whole_item = grams[first[only]], only

    def seed(self, counts: np.ndarray) -> None:
        """Keeps each item's rarest words, as many as prove that no alignment is missed; counts: of the vocabulary, over all documents."""
        item = tokens.rows_of(self.first)
        order = np.lexsort((self.words, counts[self.words], item))
        rank = np.arange(len(order)) - self.first[item]
        keep = order[(rank < np.minimum(self.size, self.size - self.need + self.least)[item]) & ~self.short[item]]
        pairs = np.unique(np.stack((self.words[keep], item[keep])), axis=1)
        self.item, self.edges = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.vocabulary) + 1))


def _known(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each hash in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """(best local alignment score, end of it in text) of two arrays of word ids, with linear gaps: a row of the table at a time."""
    slope = GAP * np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1), 0.0, 0
    for x in item:
        new = np.zeros(len(text) + 1)
        np.maximum(row[:-1] + np.where(text == x, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new - slope) + slope  # gaps in the item, from the left
        k = int(new.argmax())
        if new[k] > best:
            best, end = float(new[k]), k
        row = new
    return best, end


def _whole(hashes: np.ndarray, first: np.ndarray, items: Items):
    """(row, item, low, high) of each place where an item shorter than n words occurs whole."""
    for k in np.unique(items.size[items.whole_item]).tolist():
        own = np.flatnonzero(items.size[items.whole_item] == k)
        own = own[np.argsort(items.whole[own], kind="stable")]
        part, rows = tokens.grams(hashes, first, k)
        begin = np.arange(len(part)) - np.repeat(rows[:-1] - first[:-1], np.diff(rows))
        padded = np.zeros(len(part), dtype=np.uint64)
        for x in range(items.n):  # a short item's only gram is padded as tokens.grams pads it
            padded = tokens.mix(padded * np.uint64(0xD6E8FEB86659FD93) + (hashes[begin + x] if x < k else np.uint64(x + 1)))
        low, high = (np.searchsorted(items.whole[own], padded, side) for side in ("left", "right"))
        at, entry = _spread(low, high)
        yield np.searchsorted(first, begin[at], "right") - 1, items.whole_item[own[entry]], begin[at], begin[at] + k


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, x) for each k and each x from low[k] to high[k] - 1."""
    many = high - low
    at = np.repeat(np.arange(len(many)), many)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + low[at]


def _windows(known: np.ndarray, first: np.ndarray, items: Items):
    """(row, item, low, high) of runs of words that may hold an alignment at the threshold; high is exclusive."""
    word = np.flatnonzero(known >= 0)
    word = word[items.edges[known[word] + 1] > items.edges[known[word]]]
    many = items.edges[known[word] + 1] - items.edges[known[word]]
    row, total = np.searchsorted(first, word, "right") - 1, np.cumsum(many)
    i = 0
    while i < len(word):  # whole rows
        j = max(int(np.searchsorted(total, (total[i - 1] if i else 0) + ENTRIES, "right")), i + 1)
        j = int(np.searchsorted(row, row[j], "left")) if j < len(word) else j
        j = j if j > i else int(np.searchsorted(row, row[i], "right"))
        at, entry = _spread(items.edges[known[word[i:j]]], items.edges[known[word[i:j]] + 1])
        item, at = items.item[entry], at + i
        key = (row[at] - row[i]) * len(items.ids) + item
        order = np.argsort(key, kind="stable")  # words ascend within a row and item
        key, item, place = key[order], item[order], word[at[order]]
        last = np.arange(len(order)) + items.least[item] - 1
        fits = np.flatnonzero(last < len(order))
        fits = fits[(key[last[fits]] == key[fits]) & (place[last[fits]] - place[fits] < items.span[item[fits]])]
        r, own = row[at[order[fits]]], item[fits]
        yield r, own, np.maximum(first[r], place[last[fits]] - items.span[own] + 1), np.minimum(first[r + 1], place[fits] + items.span[own])
        i = j


def _may(item: np.ndarray, text: np.ndarray, seen: np.ndarray, least: float) -> bool:
    """Whether an alignment may score least: bounds by the item's words that text has, and by text's words that the item has. seen: all
    False, by word id."""
    seen[text] = True
    common = seen[item].sum() * MATCH
    seen[text] = False
    if common < least:
        return False
    seen[item] = True
    total = np.concatenate(([0.0], np.cumsum(np.where(seen[text], MATCH, GAP))))
    seen[item] = False
    return (total - np.minimum.accumulate(total)).max() >= least


def _pairs(items: Items, hashes: np.ndarray, first: np.ndarray, threshold: float):
    """(row, item, score, start, end, shared n-grams) for each row and item at the threshold or above; start and end in words of the row."""
    known, seen = _known(hashes, items.vocabulary), np.zeros(len(items.vocabulary) + 1, dtype=bool)  # the last one is for -1
    for row, item, low, high in (*_windows(known, first, items), *_whole(hashes, first, items)):
        order = np.lexsort((low, item, row))
        row, item, low, high = row[order], item[order], low[order], high[order]
        other = (np.diff(row) != 0) | (np.diff(item) != 0)
        for own in np.split(np.arange(len(row)), np.flatnonzero(other) + 1) if len(row) else []:
            r, i = int(row[own[0]]), int(item[own[0]])
            target = items.words[items.first[i] : items.first[i + 1]]
            best = (0.0, 0, 0)
            for run in np.split(own, np.flatnonzero(low[own][1:] > high[own][:-1]) + 1):
                a, b = int(low[run[0]]), int(high[run[-1]])
                text = known[a:b]
                if not _may(target, text, seen, threshold * items.size[i]):
                    continue
                score, end = align(target, text)
                if score > best[0]:
                    back = align(target[::-1], text[:end][::-1])[1] if score >= threshold * items.size[i] else 0
                    best = (score, a + end - back - int(first[r]), a + end - int(first[r]))
            if best[0] >= threshold * items.size[i]:
                words = hashes[first[r] : first[r + 1]]
                if items.short[i]:
                    shared = len(own)
                else:
                    shared = int(np.isin(tokens.grams(words, np.array([0, len(words)]), items.n)[0], items.grams[i]).sum())
                yield r, i, best[0] / items.size[i], best[1], best[2], shared


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """doc_id, item_id, score (0 to 1), doc_start, doc_end (words, end exclusive), n_seeds (the document's n-grams that are the
    item's): a row for each document row and item whose best alignment reaches threshold."""
    doc_kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {doc_kind}, item_id {item_kind}, score double, doc_start long, doc_end long, n_seeds long"
    texts = docs.where("text is not null").select("doc_id", "text")
    out = None
    for items in _blocks(texts, benchmark, threshold, n):
        found = _match(texts, items, schema, threshold)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(texts: DataFrame, benchmark: DataFrame, threshold: float, n: int):
    """Items of each block of the benchmark, seeded by the words of texts."""
    kept = benchmark.where("text is not null and item_id is not null").select("item_id", "text", F.ceil(F.octet_length("text") / 2).alias("most"))
    blocks = max(1, -(-(kept.agg(F.sum("most")).first()[0] or 0) // BLOCK_WORDS))
    for k in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").select("item_id", "text").toArrow().combine_chunks()
        items = Items(*(tokens.strings(rows.column(c)) if c == "text" else pa.concat_arrays(rows.column(c).chunks or [pa.array([], rows.schema.field(c).type)]) for c in ("item_id", "text")), n, threshold)
        items.seed(_counts(texts, items.vocabulary))
        yield items


def _counts(texts: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the vocabulary occurs in all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        own = shared.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            for _, _, raw, at in tokens.chunks(batch.column(0), 1 << 20):
                known = _known(tokens.words(raw, at)[0], own)
                total += np.bincount(known[known >= 0], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["key", "n"])

    # at most a row for each word of the block
    found = small_batches(texts.select("text")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(vocabulary), np.int64)
    counts[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return counts


def _match(texts: DataFrame, items: Items, schema: str, threshold: float) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        own = shared.value
        for batch in batches:
            for i, _, raw, at in tokens.chunks(batch.column(1), 1 << 20):
                got = list(_pairs(own, *tokens.words(raw, at), threshold))
                if got:
                    row, item, *rest = zip(*got, strict=True)
                    ids = batch.column(0).take(pa.array([i + r for r in row]))
                    yield pa.RecordBatch.from_arrays([ids, own.ids.take(pa.array(item)), *map(pa.array, rest)], ["doc_id", "item_id", "score", "doc_start", "doc_end", "n_seeds"])

    return small_batches(texts).mapInArrow(search, schema)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


def stage_decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited or not, go. Rows are judged where they lie, whatever their doc_id; null and
    empty texts stay, as do repeated rows of clean texts, and all columns. An empty table, or an empty benchmark, changes nothing."""
    out = docs
    for items in _blocks(docs.where("text is not null"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), THRESHOLD, N):
        out = _without(out, items, THRESHOLD)
    return out


def _without(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    """The rows of docs with no alignment to an item at the threshold or above."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def clean(batches):
        own = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for i, _, raw, at in tokens.chunks(batch.column("text"), 1 << 20):
                keep[[i + r for r, *_ in _pairs(own, *tokens.words(raw, at), threshold)]] = False
            yield batch.filter(pa.array(keep))

    return small_batches(docs).mapInArrow(clean, docs.schema)
