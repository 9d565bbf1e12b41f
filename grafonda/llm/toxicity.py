"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed byte n-grams (with word edges), so unseen misspellings share
vectors with the words they come from. A window of WINDOW words is averaged and passed through a linear softmax; a
document is as toxic as its most toxic window, in training too (the gradient of a document flows through that window),
so a few words in a long text are not averaged away. After training, embeddings and softmax collapse into one number per
n-gram, which is broadcast (BUCKETS floats) and summed in numpy.

Nulls: a null text is an empty one; texts without words get the share of toxic labels as their score. Null labels and ids are not
learnt from. No labelled rows, or one class only: the score is the share of toxic labels (0 without labels). Whole texts of any
length are scored, in runs of bounded size. Repeated rows are scored each, and alike. Several labels of one doc_id: the largest
counts; several texts: the one that sorts first is learnt from. Ties between windows: the first. Empty tables: an empty result. A
column named score stays; the new one then gets another name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .storage import fresh, held_out, sampled, small_batches

GRAMS = (3, 4, 5, 7)
BUCKETS = 1 << 17
WINDOW = 8
LEADING = 3
#: Scores from here on are flagged.
FLAG = 0.3
#: How much more a missed toxic row weighs than a flagged clean one, as the square root.
MISSED = 2.0


def _word_grams(raw: np.ndarray, at: np.ndarray):
    """(bucket, word) of every n-gram of every word, the words' first index per row. Words: runs of word bytes, ASCII lower case;
    n-grams may take in the edge on either side."""
    low = tokens.ASCII_LOWER[raw]
    starts, ends, first = tokens.spans(low, at, tokens.WORD)
    size = ends - starts + 2
    where = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=where[1:])
    flat = np.full(where[-1], 1, dtype=np.uint32)  # <word> after <word>, 1 for the edges
    inside = np.ones(where[-1], dtype=bool)
    inside[where[:-1]] = inside[where[1:] - 1] = False
    covered = np.repeat(starts - where[:-1] - 1, size) + np.arange(where[-1])
    flat[inside] = low[covered[inside]]
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), size)
    buckets, words = [], []
    for n in GRAMS:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        fits = owner[:m] == owner[n - 1 :]
        mixed = np.full(m, n, dtype=np.uint32)
        for k in range(n):
            mixed = (mixed ^ flat[k : k + m]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(13)
        buckets.append(mixed[fits] & np.uint32(BUCKETS - 1))
        words.append(owner[:m][fits])
    return (np.concatenate(buckets) if buckets else np.zeros(0, np.uint32)), (np.concatenate(words) if words else np.zeros(0, np.int32)), len(starts), first


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window, plus the end; first window of each row): WINDOW words, the last as long as is left."""
    count = np.diff(first)
    many = -(-count // WINDOW)
    row = np.zeros(len(first), np.int64)
    np.cumsum(many, out=row[1:])
    begin = np.repeat(first[:-1], many) + (np.arange(row[-1]) - np.repeat(row[:-1], many)) * WINDOW
    return np.stack([begin, np.minimum(begin + WINDOW, np.repeat(first[1:], many))]), row


def _leading(mean: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, row) of the LEADING most toxic windows of each row, or all if it has fewer."""
    owner = tokens.rows_of(row)
    order = np.lexsort((-mean, owner))
    top = order[np.arange(len(order)) - np.repeat(row[:-1], np.diff(row)) < LEADING]
    return top, owner[top]


def _odds(share: float) -> float:
    return float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))


@dataclass
class ToxicityModel:
    #: The collapsed weight of each n-gram bucket, and the softmax's bias.
    weights: np.ndarray
    bias: float
    #: The share of toxic documents: the score of texts without words.
    prior: float = 0.0

    def logits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        bucket, word, n, first = _word_grams(raw, at)
        share = np.bincount(word, weights=self.weights[bucket], minlength=n) / np.maximum(np.bincount(word, minlength=n), 1)
        total = np.concatenate(([0.0], np.cumsum(share)))
        (a, b), row = _windows(first)
        mean = (total[b] - total[a]) / np.maximum(b - a, 1)
        lead, held = _leading(mean, row)
        found = np.bincount(held, weights=mean[lead], minlength=len(at) - 1) / LEADING + self.bias
        return np.where(np.diff(row) > 0, found, _odds(self.prior))


def fit(texts: pa.Array, toxic: np.ndarray, dim: int = 8, rounds: int = 90, rate: float = 0.3, decay: float = 1e-7, seed: int = 5) -> ToxicityModel:
    """Full-batch gradient descent with momentum on embeddings and softmax together, over the n-grams of distinct words."""
    if not len(toxic) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return ToxicityModel(np.zeros(BUCKETS, np.float32), _odds(share), share)
    raw, at = tokens.bytes_of(texts)
    hashes, first = tokens.words(raw, at)
    kinds, sample, ids = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends, _ = tokens.spans(tokens.ASCII_LOWER[raw], at, tokens.WORD)
    spelled = pa.array([raw[a:b].tobytes() for a, b in zip(starts[sample], ends[sample], strict=True)], pa.binary()).cast(pa.string())
    bucket, word, n, _ = _word_grams(*tokens.bytes_of(spelled))
    # non-ASCII or digits never split a word here: each spelled word is one word again
    order = np.argsort(word, kind="stable")
    bucket, word = bucket[order].astype(np.int32), word[order]
    del order, raw, spelled
    grams = np.bincount(word, minlength=n).astype(np.float32)
    many = grams.astype(np.int64)
    edges = np.concatenate(([0], np.cumsum(many)))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (BUCKETS, dim)).astype(np.float32)
    table[np.bincount(bucket, minlength=BUCKETS) == 0] = 0  # n-grams that are never seen weigh nothing
    soft = rng.normal(0, 1, dim).astype(np.float32)
    bias = np.zeros(1, np.float32)
    (a, b), row = _windows(first)
    docs = np.flatnonzero(np.diff(row))
    label = toxic[docs].astype(np.float32)
    weight = np.where(label > 0, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1)).astype(np.float32)
    speed = [np.zeros_like(x) for x in (table, soft, bias)]
    for t in range(rounds):
        # the mean vector of a word times soft, by way of each n-gram's own product with soft
        share = np.add.reduceat((table @ soft)[bucket], edges[:-1]) / grams
        total = np.concatenate(([0.0], np.cumsum(share[ids], dtype=np.float64)))
        mean = (total[b] - total[a]) / (b - a)
        lead, held = _leading(mean, row)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(held, weights=mean[lead], minlength=len(row) - 1)[docs] / LEADING + bias, -60, 60)))
        g = np.zeros(len(row) - 1)
        g[docs] = (p - label) * weight
        # words of the leading windows get their share of the gradient
        size = (b - a)[lead]
        spread = np.repeat(a[lead] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        by_word = np.bincount(ids[spread], weights=np.repeat(g[held] / size / LEADING, size), minlength=n).astype(np.float32)
        by_gram = np.bincount(bucket, weights=np.repeat(by_word / grams, many), minlength=BUCKETS).astype(np.float32)
        down = (by_gram[:, None] * soft[None, :] + decay * table, by_gram @ table + decay * soft, np.array([g.sum()], np.float32))
        for x, d, v in zip((table, soft, bias), down, speed, strict=True):
            v *= 0.8
            v -= d / (np.abs(d).max() + 1e-9)  # one scale for a whole layer: rare n-grams move little
            x += (rate if x is table else 0.02) * v
    return ToxicityModel(table @ soft, float(bias[0]))


def best_shift(logits: np.ndarray, toxic: np.ndarray, share: float) -> float:
    """What to add to logits so that FLAG separates labels best: the middle of the thresholds with the highest F-score, in which a toxic row
    that is missed weighs MISSED**2 times a clean one that is flagged, if a share of all rows were toxic."""
    order = np.argsort(logits)
    x, y = logits[order], toxic[order]
    weight = np.where(y > 0, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    above = lambda w: np.append(np.cumsum(w[::-1])[::-1], 0.0)  # noqa: E731  from each place on
    hit, miss = above(weight * y), above(weight * (1 - y))
    f1 = (1 + MISSED**2) * hit / np.maximum(hit + miss + MISSED**2 * share, 1e-12)
    edges = np.concatenate(([x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]))
    f1[1:-1][x[1:] == x[:-1]] = -1  # equal logits can't be parted
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    run = best[: int(np.argmax(np.append(np.diff(best) > 1, True))) + 1]  # the first run of equals
    return _odds(FLAG) - float(edges[run].mean())


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 2600) -> ToxicityModel:
    """Fits on about max_docs labelled rows, chosen by a hash of doc_id; these go to one task. A fit on three quarters of them sets the
    bias by the last quarter, then all are fitted."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"), 4, 2))
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    toxic = sampled(known.where("toxic = 1"), "doc_id", max_docs // 2, n.get(1, 0))
    clean = sampled(known.where("toxic = 0"), "doc_id", max_docs // 2, n.get(0, 0))
    rows = docs.select("doc_id", "text").join(F.broadcast(toxic.unionByName(clean)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    share = n.get(1, 0) / max(sum(n.values()), 1)

    def fitted(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            sample = pa.Table.from_batches(held).sort_by("doc_id")
            texts, label = tokens.strings(sample.column("text")), sample.column("toxic").to_numpy()
            rank = np.where(label > 0, np.cumsum(label > 0), np.cumsum(label <= 0))  # every fourth of each label
            tried, shift = rank % 4 == 0, 0.0
            if len(np.unique(label[tried])) == len(np.unique(label[~tried])) == 2:
                part = fit(texts.filter(pa.array(~tried)), label[~tried])
                shift = best_shift(part.logits(*tokens.bytes_of(texts.filter(pa.array(tried)))), label[tried], share)
            model = fit(texts, label)
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias + shift])], ["weights", "bias"])

    # one executor fits on the bounded sample, so the driver holds the collapsed weights only
    found = rows.repartition(1).mapInArrow(fitted, "weights binary, bias double").first()
    if found is None:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), _odds(0.0))
    return ToxicityModel(np.frombuffer(found["weights"], np.float32), found["bias"], share)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (or all) with score (double, 0 to 1; spelled as storage.fresh does where keep has that name)."""
    keep = keep if keep is not None else docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    asked = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    text, names = asked.columns.index("text"), [*keep, *fresh(docs.select(*keep), "score")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(names[-1], T.DoubleType())])

    def batches_of(batches):
        for batch in batches:
            for i, j, raw, at in tokens.chunks(batch.column(text), 1 << 19):
                out = 1 / (1 + np.exp(-np.clip(shared.value.logits(raw, at), -500, 500)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[: len(keep)], pa.array(out)], names)

    return small_batches(asked).mapInArrow(batches_of, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= FLAG).cast("int").alias("predicted"))
