"""N-gram Jaccard join: MinHash banding, then pairs verified on full n-gram sets.

Texts become sets of n-grams of n words (a shorter text is one n-gram of all its words; one without words has none).
Words are runs of ASCII letters, digits, "_" and non-ASCII characters; ASCII capitals are lowered. Equal sets form a copy
class, kept once from there on, so copies are never paired. Bands are chosen for a target recall at the threshold; band
hashes are shuffled with partial minima, so a band that thousands share yields one star of links, not all pairs. Candidate
groups are the stars' components, cut into blocks by a hash of the class; each pair of blocks is one task group that verifies the
pairs which share a band, on whole n-gram sets. Components of more than MOST classes, which common phrases may link to any size, are
dealt by band instead: a pair is verified in its first shared band, and a class goes to the bands it shares, however large the
component is. Verification returns the links of each class and a spanning forest of them, never the pairs, so the result stays
linear while no link between different texts is lost.

Nulls: a null text is an empty one; texts without words are one copy class. A null doc_id is a row like any other; a
class whose ids are all null has class_id null. Repeated rows: each gives a row. Ties: the smallest doc_id names a class.
Very long texts are shingled whole. Empty table: an empty result. Class keys are 64-bit hashes of n-gram sets. Only doc_id and text
are read, so other columns never clash.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .components import components
from .storage import fresh, small_batches, work_table

N = 5
THRESHOLD = 0.8
ROWS = 6
RECALL = 0.999
#: Classes in a task group; larger components are cut into blocks, at most BLOCKS of them, and those of more than MOST classes are
#: dealt by band. GRAMS: n-grams in a block, so that a task's memory follows no group's size.
GROUP, BLOCKS, MOST, GRAMS = 160, 16, 4096, 1 << 21


def band_count(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands with which a pair at the threshold shares one with the probability recall."""
    return ceil(log(1 - recall) / log(1 - threshold**rows))


def shingle_sets(raw: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of all rows, first)."""
    hashes, first = tokens.grams(*tokens.words(raw, at), n, short=True)
    row = tokens.rows_of(first)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(first)))


def class_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens.mix(hashes + np.uint64(1)), dtype=np.uint64)))
        return tokens.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


def band_keys(hashes: np.ndarray, first: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """MinHash band hashes, sets x bands; empty sets get zeros."""
    rng = np.random.default_rng(8191)
    factor = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, bands), dtype=np.uint64)
    if not len(full):
        return out
    short, begin = (hashes >> np.uint64(32)).astype(np.uint32), first[full]
    for b in range(bands):
        key = np.full(len(full), b + 1, dtype=np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            mixed = short * factor[r] + shift[r]
            mixed ^= mixed >> np.uint32(16)
            key = tokens.mix(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(mixed * np.uint32(0x85EBCA6B), begin))
        out[full, b] = key
    return out


def _block_links(key: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], left: np.ndarray, within: bool, threshold: float, at: int = -1):
    """(links per class, forest as pairs of places) among classes that share a band: left ones with the others, or all with all if
    within. at: only pairs whose first shared band is this one (-1: all)."""
    m = len(key)
    links, forest = np.zeros(m, np.int64), []
    if m < 2:
        return links, forest
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    _, term = np.unique(every, return_inverse=True)
    order = np.argsort(term, kind="stable")
    term, owner = term[order], owner[order]
    rows = np.arange(m) if within else np.flatnonzero(left)
    columns = np.arange(m) if within else np.flatnonzero(~left)
    place = np.full(m, -1)
    place[columns] = np.arange(len(columns))
    edge = np.searchsorted(term, np.arange(term[-1] + 2))
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    terms_of = [term_ids for term_ids in np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner, minlength=m))[:-1])]
    for i in rows:
        same = bands[columns] == bands[i]
        shares = same.any(axis=1) if at < 0 else same[:, at] & ~same[:, :at].any(axis=1)
        near = size[columns] * threshold <= size[i]
        near &= size[i] * threshold <= size[columns]
        want = shares & near & (columns > i if within else True)
        if not want.any():
            continue
        mine = term[terms_of[i]]
        spread = edge[mine + 1] - edge[mine]
        hits = owner[np.repeat(edge[mine] - np.concatenate(([0], np.cumsum(spread)[:-1])), spread) + np.arange(spread.sum())]
        common = np.bincount(hits, minlength=m)[columns]
        good = want & (common >= threshold * (size[i] + size[columns] - common) - 1e-9)
        to = columns[good]
        links[i] += len(to)
        links[to] += 1
        for j in to:
            x, y = root(int(i)), root(int(j))
            if x != y:
                parent[y] = x
                forest.append((int(i), int(j)))
    return links, forest


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """A row for each row of docs: doc_id, copy_class (smallest doc_id with an equal set), class_id (smallest doc_id that links lead
    to), n_copies (rows of its copy class), n_links (other copy classes at the threshold or above)."""
    signed, named, linked = _groups(docs, n, threshold, rows, recall)
    counts = linked.groupBy("a").agg(F.sum("n").alias("n_links")).where("n_links > 0").withColumnRenamed("a", "class")
    names = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    info = named.join(names, "root").join(counts, "class", "left").select("class", F.col("first_id").alias("copy_class"), "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return signed.select("doc_id", "class").join(info, "class").drop("class")


def _groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of docs (doc_id, class), copy classes (class, first_id, n_copies, root: the same for all that links lead to) and links (a, b, n)."""
    bands = band_count(threshold, rows, recall)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))

    def sign(batches):
        for batch in batches:
            for i, j, raw, at in tokens.chunks(batch.column(1), 1 << 20):
                hashes, first = shingle_sets(raw, at, n)
                keys = pa.array(band_keys(hashes, first, bands, rows).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), keys)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), tokens.as_signed(class_keys(hashes, first)), pa.array(np.diff(first)), lists], ["doc_id", "h", "class", "size", "bands"])

    signed = work_table(small_batches(keyed).mapInArrow(sign, f"doc_id {kind}, h long, class long, size long, bands array<long>"), "signed")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("own")
    classes = work_table(signed.groupBy("class").agg(F.min("doc_id").alias("first_id"), own, F.count("*").alias("n_copies"), F.any_value("bands").alias("bands"), F.any_value("size").alias("size")), "classes")
    posted = classes.where("size > 0").select(F.col("class").alias("node"), F.posexplode("bands").alias("at", "band"))
    shared = posted.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("m")).where("low < high").select("band", "low", "m")
    # a class's star centres, at most one a band: the class is tied to the least of them, and that one to the others
    centres = posted.join(shared, "band").groupBy("node").agg(F.collect_set("low").alias("lows"), F.collect_list(F.struct(F.col("band").alias("task"), "at", "m")).alias("posts"))
    centres = work_table(centres.withColumn("least", F.array_min("lows")), "centres")
    ties = centres.select(F.col("least").alias("a"), F.explode("lows").alias("b")).where("a <> b").distinct()
    groups = components(centres.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(ties))
    known = groups.join(classes.select(F.col("class").alias("node"), "own", "size", "bands"), "node")
    weights = known.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("grams"))
    heavy = F.ceil(F.col("grams") / GRAMS)
    blocks = F.greatest(F.when(F.col("m") <= GROUP, 1).otherwise(F.least(F.ceil(F.col("m") / GROUP), F.lit(BLOCKS))), heavy).cast("int")
    # a component of up to MOST classes is dealt whole, in blocks; of a larger one each shared band is a group of its own
    weighed = weights.select("root", F.when((F.col("m") <= MOST) & (heavy <= BLOCKS), blocks).alias("blocks"), (F.col("grams") / F.col("m")).alias("mean"))
    total = known.agg(F.count("*"), F.sum("size")).first()
    few = max(1, ceil(total[0] / GROUP), ceil((total[1] or 0) / GRAMS))
    whole = F.array(F.struct(F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(few))).otherwise(F.col("root")).alias("task"), F.lit(-1).alias("at"), "blocks"))
    by_band = F.transform("posts", lambda x: F.struct(x["task"].alias("task"), x["at"].alias("at"), F.greatest(F.ceil(x["m"] / MOST), F.ceil(x["m"] * F.col("mean") / GRAMS)).cast("int").alias("blocks")))
    dealt = known.join(weighed, "root").join(centres.select("node", "posts"), "node")
    wanted = dealt.select(F.col("own.doc_id").alias("doc_id"), F.col("own.h").alias("h"), F.col("node").alias("class"), "root", "bands", F.when(F.col("blocks").isNotNull(), whole).otherwise(by_band).alias("deal"))
    wanted = work_table(wanted, "wanted")
    names = ["class", "root", "bands", "deal"]

    def resolve(batches):
        seen: set[int] = set()  # rows that repeat a doc_id and a text count once
        for batch in batches:
            for i, j, raw, at in tokens.chunks(batch.column("text"), 1 << 20):
                part = batch.slice(i, j - i).select(names)
                keys = part.column("class").to_pylist()
                new = [k not in seen and not seen.add(k) for k in keys]
                hashes, first = shingle_sets(raw, at, n)
                new = np.array(new, dtype=bool) & (class_keys(hashes, first).view(np.int64) == part.column("class").to_numpy())
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), tokens.as_signed(hashes))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*names, "grams"]).filter(pa.array(new))

    # the text of one document for each candidate class
    texts = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["doc_id"]) & (keyed["h"] == wanted["h"])).select("text", *names)
    deal = "array<struct<task:bigint,at:int,blocks:int>>"
    sets = small_batches(texts).mapInArrow(resolve, f"class long, root long, bands array<long>, deal {deal}, grams array<long>")
    each = sets.select("class", "root", "bands", "grams", F.inline("deal")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = each.select(
        F.when(F.col("at") >= 0, 2).when(F.col("blocks") > 1, 1).otherwise(0).alias("kind"), "task", "at",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "root", "class", "block", "bands", "grams",
    )

    def verify(table: pa.Table) -> pa.Table:
        roots, key, part = (table.column(c).to_numpy() for c in ("root", "class", "block"))
        low, high, at = (table.column(c)[0].as_py() for c in ("low", "high", "at"))
        lists = table.column("grams").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        keys = table.column("bands").combine_chunks()
        keys = (keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys).flatten().to_numpy().reshape(len(key), bands)
        order = np.lexsort((key, roots))
        order = order[np.append(True, (key[order][1:] != key[order][:-1]) | (roots[order][1:] != roots[order][:-1]))]  # repeated rows once
        out_a, out_b, out_n = [], [], []
        for own in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            links, forest = _block_links(key[own], keys[own], [values[offsets[k] : offsets[k + 1]] for k in own], part[own] == low, low == high, threshold, at)
            some = np.flatnonzero(links)
            out_a += [key[own][some], key[own][[x for x, _ in forest]]]
            out_b += [key[own][some], key[own][[y for _, y in forest]]]
            out_n += [links[some], np.zeros(len(forest), np.int64)]
        join_ = lambda xs: pa.array(np.concatenate(xs).astype(np.int64))
        return pa.table({"a": join_(out_a), "b": join_(out_b), "n": join_(out_n)})

    linked = work_table(paired.groupBy("kind", "task", "low", "high").applyInArrow(verify, "a long, b long, n long"), "linked")
    roots = components(linked.select("a", "b")).withColumnRenamed("node", "class")
    named = classes.select("class", "first_id", "n_copies").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    return signed, named, linked


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "copy_class", "n_copies", "n_links")


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays (one row, if rows repeat it; nulls come last, and of different texts
    with that id the one with the least class key); texts without words all stay but copies."""
    named = _groups(docs)[1]
    own = F.min(F.struct(F.col("first_id").isNull().alias("last"), "first_id", "class")).alias("own")
    key, first_id, row = fresh(docs, "class", "first_id", "row")
    kept = named.groupBy("root").agg(own).select(F.col("own.class").alias(key), F.col("own.first_id").alias(first_id))
    names = [*docs.columns, key]

    def sign(batches):
        for batch in batches:
            for i, j, raw, at in tokens.chunks(batch.column("text"), 1 << 20):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, tokens.as_signed(class_keys(*shingle_sets(raw, at)))], names)

    rows = small_batches(docs).mapInArrow(sign, T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())]))
    rows = rows.join(kept, (rows[key] == kept[key]) & rows["doc_id"].eqNullSafe(kept[first_id]), "left_semi")
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row)
    return rows.groupBy(key).agg(one).select(f"{row}.*")


#: op8's rows by an exact join on shared n-grams.
ORACLE_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
c AS MATERIALIZED (SELECT s, min(doc_id) AS copy_class, count(*) AS n_copies FROM g GROUP BY s),
u AS MATERIALIZED (SELECT copy_class AS k, len(s) AS n, unnest(s) AS x FROM c),
p AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.x = b.x AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
r(k, root) AS (SELECT copy_class, copy_class FROM c UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.k),
m AS (SELECT k, min(root) AS class_id FROM r GROUP BY 1), l AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT doc_id, class_id, copy_class, n_copies, coalesce(l.n, 0) AS n_links FROM g JOIN c USING (s) JOIN m ON m.k = copy_class LEFT JOIN l ON l.a = copy_class"""
