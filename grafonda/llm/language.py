"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (buckets x languages per n-gram order, a few MB for tens of languages) is broadcast; workers
score batches in numpy by gathering the rows of the n-grams that occur and summing them per document.

Nulls and texts without a letter: language `und`, score 0. A null doc_id is kept, and learnt from like any other. Empty training
set: every text is `und`. Empty tables: an empty result. Texts of any length are read whole, in runs of bounded size, and go to
the workers once. Ties: the language that sorts first. Repeated rows are scored alike. Columns named lang_pred or score stay; the
new ones then get other names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import fresh, held_out, sampled, small_batches
from .tokens import chunks, strings

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Characters handled at a time; n-grams that cross the edge of a run are counted with the run before.
RUN = 1 << 18
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts with a space before and after each, and where each begins."""
    parts = [f" {t.lower()} " for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((points < 0x30) | ((points > 0x39) & (points < 0x41)), np.uint32(32), points), at


def _features(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place; order-1 fewer than points. Buckets of an order follow those before."""
    n = len(points) - order + 1
    mixed = np.full(max(n, 0), order, dtype=np.uint32)
    for k in range(order):
        mixed = (mixed ^ points[k : k + n]) * _FACTORS[k]
        mixed ^= mixed >> np.uint32(15)
    return (mixed & np.uint32(BUCKETS - 1)) + np.uint32(ORDERS.index(order) * BUCKETS)


def _crossing(at: np.ndarray, order: int) -> np.ndarray:
    """Where the n-grams begin that reach from a text into the next: they count for none."""
    return np.concatenate([at[1:-1] - k for k in range(1, order)]) if order > 1 else at[:0]


def _groups(column) -> list[tuple[int, list[str]]]:
    """Runs of rows of about RUN characters."""
    texts, out, i, size = strings(column).to_pylist(), [], 0, 0
    for j, t in enumerate(texts):
        size += len(t)
        if size >= RUN:
            out.append((i, texts[i : j + 1]))
            i, size = j + 1, 0
    return [*out, (i, texts[i:])] if i < len(texts) else out


@dataclass
class LanguageModel:
    languages: list[str]
    #: float32, len(ORDERS)*BUCKETS x languages
    weights: np.ndarray
    prior: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """Log probabilities, texts x languages: whole texts, a run of characters at a time."""
        points, at = _code_points(texts)
        out = np.tile(self.prior, (len(texts), 1))
        step = 4 * RUN
        for a in range(0, max(len(points) - 1, 1), step):
            run = points[a : a + step + ORDERS[-1] - 1]
            edges = np.clip(at - a, 0, step)
            for order in ORDERS:
                rows = self.weights[_features(run, order)[: min(step, max(len(run) - order + 1, 0))]]
                over = _crossing(at, order) - a
                rows[over[(over >= 0) & (over < len(rows))]] = 0
                begin = np.minimum(edges[:-1], len(rows))
                full = np.flatnonzero(begin < np.minimum(edges[1:], len(rows)))
                if len(full):
                    out[full] += np.add.reduceat(rows, begin[full], axis=0)
        return out


def train(docs: DataFrame, max_docs: int = 6000, smoothing: float = 0.5) -> LanguageModel:
    """Fits on about max_docs of docs' rows (text, lang; chosen by a hash of doc_id). Counts are summed on the executors;
    the driver gets len(ORDERS) * BUCKETS numbers for each language."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    rows = sampled(rows, "doc_id", max_docs, rows.count())

    def count(batches):
        total: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, texts in _groups(batch.column("text")):
                for lang in sorted(set(langs[i : i + len(texts)])):
                    own = [t for t, x in zip(texts, langs[i : i + len(texts)], strict=True) if x == lang]
                    points, at = _code_points(own)
                    got = total.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS, np.int64))
                    for order in ORDERS:
                        got += np.bincount(np.delete(_features(points, order), _crossing(at, order)), minlength=len(got))
                    docs_of[lang] = docs_of.get(lang, 0) + len(own)
        for lang, got in total.items():
            used = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(used) + 1)), pa.array([-1, *used], pa.int32()), pa.array([docs_of[lang], *got[used]], pa.int64())], ["lang", "bucket", "n"])

    counts = small_batches(rows.select("lang", "text")).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counts.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(names))
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    weights = np.full((len(ORDERS) * BUCKETS, len(languages)), smoothing, np.float64)
    prior = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = names == lang
        prior[k] = n[own & (bucket < 0)].sum()
        weights[bucket[own & (bucket >= 0)], k] += n[own & (bucket >= 0)]
    blocks = weights.reshape(len(ORDERS), BUCKETS, -1)
    blocks[:] = np.log(blocks / blocks.sum(axis=1, keepdims=True)) if languages else 0
    return LanguageModel(languages, blocks.reshape(weights.shape).astype(np.float32), np.log(prior / prior.sum()).astype(np.float32) if languages else prior)


def _slices(batch: pa.RecordBatch, text: int, model: LanguageModel) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, language by place or -1 for none, posterior) of runs of rows of about RUN bytes of text; a longer row stands alone."""
    whole = strings(batch.column(text))
    for i, j, _, _ in chunks(whole, RUN):
        own = whole.slice(i, j - i)
        lettered = pc.match_substring_regex(own, r"\p{L}").to_numpy(zero_copy_only=False)
        best, sure = np.full(j - i, -1), np.zeros(j - i)
        if model.languages and lettered.any():
            logs = model.score(own.to_pylist()).astype(np.float64) / len(ORDERS)
            logs -= logs.max(axis=1, keepdims=True)
            best, sure = np.where(lettered, logs.argmax(axis=1), -1), np.where(lettered, 1 / np.exp(logs).sum(axis=1), 0.0)
        yield batch.slice(i, j - i), best, sure


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (or all), and two more: lang_pred and score, the winner's posterior at the likelihood of one n-gram order.
    Where keep has these names already, the new ones are spelled as storage.fresh spells them."""
    keep = keep if keep is not None else docs.columns
    asked = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    text, names = asked.columns.index("text"), [*keep, *fresh(docs.select(*keep), "lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        spelled = np.array([*shared.value.languages, "und"], dtype=object)
        for batch in batches:
            for rows, best, sure in _slices(batch, text, shared.value):
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(spelled[best], pa.string()), pa.array(sure)], names)

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(names[-2], T.StringType()), T.StructField(names[-1], T.DoubleType())])
    return small_batches(asked).mapInArrow(predict, schema)


def known_only(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of docs in a learned language with a posterior of least or more; all rows if the model knows no language. The texts
    pass through the workers once, and no column is added or renamed."""
    text, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        for batch in batches:
            for rows, best, sure in _slices(batch, text, shared.value):
                yield rows.filter(pa.array((best >= 0) & (sure >= least)))

    return small_batches(docs).mapInArrow(kept, docs.schema) if model.languages else docs


def train_on_labelled(docs: DataFrame) -> LanguageModel:
    return train(docs.where(~held_out(F.col("doc_id"), 4, 2)))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), train_on_labelled(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def stage_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language (und, or a posterior under one half) go, so null, empty and blank texts do; every other row
    stays as it is, repeated rows and rows without an id too. Where docs has no labelled row there is no language to hold on to, and
    all rows stay. Ties go to the language that sorts first. An empty table gives an empty one. Any other columns pass through."""
    return known_only(docs, train_on_labelled(docs))
