"""Secret scans with DataFrame functions only: base patterns, and character Markov models for what they miss.

Two first-order models over 66 characters are trained from labelled samples: random strings (digests of a counter in
base64, base32-like and hexadecimal spelling) and ordinary identifiers (words of a bounded sample of the texts, alone,
capitalised, in capitals and joined as identifiers are). A token outside the base spans is a secret if its
log-likelihood ratio beats the odds of a million to one. The model is a table of 66 x 66 whole hundredths of a nat.

Nulls: a null text is an empty one, without spans; a null doc_id is a row like any other. Texts of any length are scanned whole.
Overlaps: matches of a kind never overlap; Markov spans never overlap base spans; of spans with one start the kind listed first comes
first. Repeated rows are scanned alike. Empty table: an empty result, and a model of random strings against nothing. Columns of the
input stay; new ones get other names where they would clash.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh, sampled

# The kinds' patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SIZE = len(ALPHABET)
#: Matches that are handled together where there are many in a text.
BLOCK = 256
#: Hundredths of a nat: the natural logarithm of a million to one.
LEAST_RATIO = round(100 * log(1e6))


def _code(word: Column | str, i: Column | int) -> Column:
    """The place of the i-th character in the alphabet, from 0; -1 if it has none."""
    return F.instr(F.lit(ALPHABET), F.substring(word, i, 1)) - 1


def labelled_samples(docs: DataFrame, max_docs: int = 400, random_strings: int = 3000) -> DataFrame:
    """word, label (random or ordinary). Ordinary words come from about max_docs documents, chosen by a hash of doc_id."""
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    random = spark.range(random_strings).select(
        F.explode(F.array(F.regexp_replace(F.base64(digest), "=", ""), F.translate(F.upper(F.hex(digest)), "0189", "XYZW"), F.upper(F.regexp_replace(F.base64(digest), "[=+/]", "")), F.lower(F.hex(digest)))).alias("word"), F.lit("random").alias("label")
    )
    some = sampled(docs.where("text is not null"), "doc_id", max_docs, docs.count())
    plain = F.regexp_replace(F.regexp_replace("text", ASSIGN, "\n"), f"{ACCESS}|{HEX}", "\n")  # what the base finds is not ordinary
    words = F.regexp_extract_all(plain, F.lit("[A-Za-z][A-Za-z0-9]{2,}"), F.lit(0))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))  # a word and the next
    follows = some.select(words.alias("w")).select(F.inline(pairs.cast("array<struct<a:string,b:string>>")))
    split = follows.groupBy("a").agg(F.max(F.coalesce("b", "a")).alias("b"), (F.xxhash64("a") % 100).alias("i"))  # each word once
    b = F.col("b")
    spelled = F.array(F.col("a"), F.initcap("a"), F.upper("a"), F.concat_ws("_", "a", b), F.concat_ws("-", "a", b), F.concat_ws("/", "a", b), F.concat(F.col("a"), F.initcap(b)), F.upper(F.concat_ws("_", "a", b)), F.concat(F.col("a"), F.abs("i").cast("string")))
    return random.unionByName(split.select(F.explode(spelled).alias("word"), F.lit("ordinary").alias("label")))


def _parts(word: Column, size: int) -> Column:
    """Blocks of size + 1 characters that share one with the next, so that each pair of neighbours is in one block: a character is found from
    its block's start, not from the word's."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(word) - 2) / size).cast("int"))
    return F.transform(blocks, lambda k: F.substring(word, k * size + 1, F.lit(size + 1)))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[int]:
    """Hundredths of a nat for each pair of characters: log P(random) - log P(ordinary) of the second after the first. The driver gets
    at most 2 * SIZE * SIZE counts."""
    parts = F.flatten(F.transform(_parts(F.col("word"), BLOCK * BLOCK), lambda part: _parts(part, BLOCK)))
    pairs = samples.where("length(word) > 1").select("label", F.explode(parts).alias("word"))
    pairs = pairs.select("label", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    pairs = pairs.groupBy("label", F.expr("substring(word, i, 2)").alias("pair")).count()  # at most 2 * SIZE * SIZE rows: ASCII only
    counts = pairs.select("label", _code("pair", 1).alias("first"), _code("pair", 2).alias("second"), "count").where("first >= 0 and second >= 0").collect()
    logs = {}
    for label in ("random", "ordinary"):
        table = [[smoothing] * SIZE for _ in range(SIZE)]
        for r in counts:
            if r["label"] == label:
                table[r["first"]][r["second"]] += r["count"]
        logs[label] = [log(x / sum(row)) for row in table for x in row]
    return [round(100 * (x - y)) for x, y in zip(logs["random"], logs["ordinary"], strict=True)]


def _cut(values: Column) -> Column:
    """An array as an array of blocks."""
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<int>>"))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of whole numbers, op over those before it, from 0 on. It works in blocks, so that what is copied
    grows as the power 1.5 of the length, not as its square."""
    zero, grow = F.array(F.lit(0)), lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x))
    blocks = _cut(values)
    tops = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), op))
    inside = lambda b, c: F.slice(F.aggregate(b, F.array(c), grow), F.lit(1), F.size(b))
    return F.flatten(F.zip_with(blocks, F.slice(F.aggregate(tops, zero, grow), F.lit(1), F.size(blocks)), inside))


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches as structs (start, kind, end, word), in code points; word is the whole match."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    gaps = F.transform(F.slice(between, F.lit(1), F.size(found)), F.length)
    steps = F.zip_with(gaps, found, lambda gap, word: gap + F.length(word))
    starts = F.zip_with(running(steps, lambda a, b: a + b), gaps, lambda a, b: a + b)
    every = F.zip_with(starts, found, lambda at, word: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(word)).alias("end"), word.alias("word")))
    return F.when(F.rlike(text, F.lit(pattern)), every).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,word:string>>"))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def _outside(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span. Where there are many of both, tokens are held only against the spans of their own block."""
    apart = lambda spans: lambda x: ~F.exists(spans, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / BLOCK).cast("int")), lambda k: F.slice(tokens, k * BLOCK + 1, F.lit(BLOCK)))
    near = lambda b: F.filter(base, lambda y: (y["start"] < F.element_at(b, -1)["end"]) & (F.element_at(b, 1)["start"] < y["end"]))
    kept = F.transform(F.transform(blocks, lambda b: F.struct(b.alias("own"), near(b).alias("near"))), lambda z: F.filter(z["own"], apart(z["near"])))
    return F.when(F.size(base) == 0, tokens).when(F.size(tokens) <= BLOCK, F.filter(tokens, apart(base))).otherwise(F.flatten(kept))


def scan(docs: DataFrame, model: list[int]) -> DataFrame:
    """docs with two more columns, base and spans (see names): arrays of (start, kind, end) by start, then kind (a place in KINDS)."""
    base, spans = names(docs)
    body, assign, access, hexes, tokens = fresh(docs.withColumns({base: F.lit(0), spans: F.lit(0)}), "body", "assign", "access", "hexes", "tokens")
    held = docs.withColumn(body, F.coalesce(F.col("text"), F.lit("")))
    values = F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))
    found = held.withColumns({assign: _spans(F.col(body), ASSIGN, 0), access: _spans(F.col(body), ACCESS, 1), hexes: _spans(F.col(body), HEX, 2), tokens: _spans(F.col(body), CANDIDATE, 3)})
    long_enough = F.when(F.size(assign) > 0, F.filter(assign, lambda x, i: F.length(F.get(values, i)) >= ASSIGN_LEAST)).otherwise(F.col(assign))
    based = found.withColumn(base, F.array_sort(F.concat(_bare(long_enough), _bare(F.col(access)), _bare(F.col(hexes)))))
    table = F.split(F.lit(" ".join(map(str, model))), " ").cast("array<int>")  # folded to a constant
    near = lambda word: F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), F.lit(0), lambda acc, i: acc + F.get(table, _code(word, i) * SIZE + _code(word, i + 1)))
    summed = lambda parts, value: F.aggregate(parts, F.lit(0), lambda acc, part: acc + value(part))
    ratio = lambda word: summed(_parts(word, BLOCK * BLOCK), lambda part: summed(_parts(part, BLOCK), near))
    beyond = _bare(F.filter(_outside(F.col(tokens), F.col(base)), lambda x: ratio(x["word"]) >= LEAST_RATIO))
    every = F.when(F.size(tokens) > 0, F.array_sort(F.concat(F.col(base), beyond))).otherwise(F.col(base))
    return based.withColumn(spans, every).drop(body, assign, access, hexes, tokens)


def names(docs: DataFrame) -> tuple[str, str]:
    """What scan calls its columns: base and spans, or as storage.fresh spells them where docs has such columns."""
    base, spans = fresh(docs, "base", "spans")
    return base, spans


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[int], mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans in text replaced by mark."""
    found, spans = scan(docs, model), F.col(names(docs)[1])
    text = F.col("text")
    behind = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))  # the end of all before
    gaps = F.filter(F.zip_with(spans, behind, lambda x, a: F.struct(a.alias("a"), x["start"].alias("b"))), lambda g: g["a"] <= g["b"])
    # pieces are cut from stretches of BLOCK gaps, so that long texts are not walked through once a gap
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / BLOCK).cast("int")), lambda k: F.slice(gaps, k * BLOCK + 1, F.lit(BLOCK)))
    stretch = lambda b: F.struct(b.alias("own"), F.substring(text, F.element_at(b, 1)["a"] + 1, F.element_at(b, -1)["b"] - F.element_at(b, 1)["a"]).alias("t"))
    piece = lambda z: F.transform(z["own"], lambda g: F.concat(F.substring(z["t"], g["a"] - F.element_at(z["own"], 1)["a"] + 1, g["b"] - g["a"]), F.lit(mark)))
    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    clean = F.concat(F.array_join(F.flatten(F.transform(F.transform(blocks, stretch), piece)), ""), F.substring(text, last + 1, F.length(text)))
    return found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text)).select(*docs.columns)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(docs)))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, null and empty texts and repeated rows as they are, with all their columns.
    n_chars, if there is one, follows the text. An empty table gives an empty one."""
    out = redact(docs, train(labelled_samples(docs)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out
