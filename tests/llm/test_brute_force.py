"""The operators against plain re-computations on small tables, known answers, and measured recall."""

import binascii
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grafonda.llm import decontamination, flac, language, packing, secrets, sharding, token_counts, toxicity

from .test_operators import make


def test_shuffle_is_a_plain_one(spark):
    """Slots are those of a Fisher-Yates shuffle of each bucket in order, whatever the partitions."""
    docs = spark.createDataFrame([(k, "x" * (k % 7)) for k in range(500)], "doc_id long, text string").coalesce(1)
    keyed = docs.withColumn("h", F.xxhash64(F.lit(5), "doc_id", "text", F.monotonically_increasing_id())).collect()
    total = sum(len(r.text) + 64 for r in keyed)
    buckets = -(-total // 4000)
    at, want = 0, {}
    for b in range(buckets):
        own = sorted((r for r in keyed if r.h % buckets == b), key=lambda r: r.h)
        for k in np.random.Generator(np.random.PCG64([5, b])).permutation(len(own)):
            want[own[k].doc_id] = (at % 3, at // 3)
            at += 1
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for most in (sharding.PARTS, 4):  # also with several buckets to a partition
            sharding.PARTS, kept = most, sharding.PARTS
            got = {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(docs, 3, seed=5, bucket_bytes=4000).collect()}
            sharding.PARTS = kept
            assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def stream_of(samples: int, subframe: bytes) -> bytes:
    """A FLAC stream of one frame of 8-bit mono samples, byte by byte."""
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | samples).to_bytes(8, "big") + bytes(16)  # an MD5 of zeros: not known
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0x00, samples - 1])
    frame = head + bytes([flac.crc8(head)]) + subframe
    raw = np.frombuffer(frame, np.uint8)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame + int(flac.crc16(raw, np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")


@pytest.mark.parametrize(
    ("bits", "want"),
    [
        ("00000000" "11111011", [-5] * 4),  # constant
        ("00000010" "00000001" "11111111" "01111111" "10000000", [1, -1, 127, -128]),  # verbatim
        ("00010010" "00000101" "00" "0000" "0001" + "100" "110" "0100", [5, 5 - 0, 5, 5]),  # fixed order 1, k = 1 (set below)
        ("01000010" "00001010" "00001100" "0011" "00000" "0010" "1111" "00" "0000" "0000" + "1" * 2, [10, 12, 14, 16]),  # linear: 2a - b, no residual
        ("00010000" "00" "0000" "1111" "00011" "001" "111" "010" "110", [1, -1, 2, -2]),  # order 0, a raw partition of 3 bits
    ],
)
def test_streams_typed_by_hand(bits, want):
    if bits.startswith("00010010"):  # residuals 3, -4, 0 as zigzag 6, 7, 0 with k = 1: quotients 3, 3, 0
        bits, want = "00010010" "00000101" "00" "0000" "0001" "00010" "00011" "10", [5, 8, 4, 4]
    bits += "0" * (-len(bits) % 8)
    media = stream_of(len(want), int(bits, 2).to_bytes(len(bits) // 8, "big"))
    ((at, pcm),) = flac.decode([media])[0]
    assert at == 0 and (pcm.astype(int) - 128).tolist() == want


def test_fitted_linear_predictors_are_used_and_read():
    t = np.arange(9000)
    wave = (128 + 90 * np.sin(t / 9)).astype(np.uint8).tobytes()
    (media,) = flac.encode([wave])
    kinds = Counter(kind_of(media, a) for _, _, a, _ in flac.Stream(media).frames)
    assert b"".join(x.tobytes() for _, x in flac.decode([media])[0]) == wave and len(media) < 0.6 * len(wave) and kinds["linear"]


def kind_of(media, start):
    """What the frame at this byte holds: its header is a sync code, two bytes, the coded number, perhaps a block size, and a CRC."""
    number = next(k for k in range(8) if not media[start + 4] << k & 0x80) or 1
    code = media[start + 4 + number + (2 if media[start + 2] >> 4 == 7 else 0) + 1] >> 1
    return "constant" if code == 0 else "verbatim" if code == 1 else "fixed" if code < 32 else "linear"


def test_texts_are_coded_not_stored(spark, sf_dir):
    """Hardly a frame of documents is verbatim: only where coding is longer."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    found = Counter(kind_of(m, a) for m in flac.encode([flac.padded(t.encode()) for t in texts]) for _, _, a, _ in flac.Stream(m).frames)
    assert found["verbatim"] < 0.05 * sum(found.values()) and found["linear"] > found["verbatim"]


def test_language_counts_are_plain_counts(spark):
    docs = make(spark, [(1, "ab a", "xx"), (2, "Ba 1", "yy"), (3, "äb", "xx"), (4, None, "xx"), (5, "zz", None)])
    model = language.train(docs, smoothing=0.5)
    assert model.languages == ["xx", "yy"]
    for k, texts in enumerate((["ab a", "äb"], ["Ba 1"])):
        for o, order in enumerate(language.ORDERS):
            counts = Counter()
            for t in texts:
                points = np.array([32 if ord(c) < 0x30 or 0x39 < ord(c) < 0x41 else ord(c) for c in f" {t.lower()} "], np.uint32)
                counts.update(language._features(points, order).tolist())
            own = model.weights[o * language.BUCKETS : (o + 1) * language.BUCKETS, k]
            total = sum(counts.values()) + 0.5 * language.BUCKETS
            assert all(own[b - o * language.BUCKETS] == pytest.approx(math.log((n + 0.5) / total), rel=1e-5) for b, n in counts.items())
    assert np.allclose(np.exp(model.prior), [2 / 3, 1 / 3])


def test_markov_spans_against_a_plain_ratio_and_their_recall(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = secrets.train(secrets.labelled_samples(docs, max_docs=100))
    rng = np.random.default_rng(11)
    letters = {"base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": secrets.ALPHABET}
    planted = [(kind, "".join(rng.choice(list(alphabet), rng.integers(24, 44)))) for kind, alphabet in letters.items() for _ in range(80)]
    words = [w for r in docs.limit(120).collect() for w in (r.text or "").split() if w.isascii() and w.isalpha() and len(w) > 5]
    plain = ["_".join(rng.choice(words, 4)).lower() for _ in range(150)] + ["".join(w.title() for w in rng.choice(words, 4)) for _ in range(150)]
    rows = [(k, f"see {t} here", None) for k, t in enumerate([t for _, t in planted] + plain)]
    got = {r.doc_id: [tuple(x) for x in r.spans if x.kind == 3] for r in secrets.scan(make(spark, rows), model).collect()}
    ratio = lambda t: sum(model[secrets.ALPHABET.index(a) * secrets.SIZE + secrets.ALPHABET.index(b)] for a, b in zip(t, t[1:], strict=False))
    for k, t in enumerate([t for _, t in planted] + plain):
        base = secrets.ACCESS in t
        if not base and all(c in secrets.ALPHABET for c in t) and len(t) >= 20:
            assert bool(got[k]) == (ratio(t) >= secrets.LEAST_RATIO) and got[k] in ([], [(4, 3, 4 + len(t))])
    caught = Counter(kind for k, (kind, _) in enumerate(planted) if got[k])
    assert all(caught[kind] >= 0.9 * 80 for kind in letters), caught
    assert np.mean([bool(got[k]) for k in range(len(planted), len(rows))]) < 0.02


def test_many_matches_in_one_text(spark):
    """Blocks of matches give what single matches give."""
    parts = [f"token=abcdefghij{k:04d} " if k % 2 else f"x AKIA{'Q' * 16}{k} deadbeef00112233{k:08x}\n" for k in range(3 * secrets.BLOCK)]
    text, want, at = "".join(parts), [], 0
    for k, p in enumerate(parts):
        if k % 2:
            want.append((at, 0, at + len(p) - 1))
        else:
            a = p.index("AKIA")
            want += [(at + a, 1, at + a + 20 + len(str(k))), (at + p.index("dead"), 2, at + len(p) - 1)]
        at += len(p)
    docs = make(spark, [(1, text, None)])
    row = secrets.scan(docs, [0] * secrets.SIZE**2).first()
    assert [tuple(x) for x in row.base] == sorted(want)
    assert secrets.redact(docs, [0] * secrets.SIZE**2).first().text == "".join("[SECRET] " if k % 2 else "x [SECRET] [SECRET]\n" for k in range(len(parts)))


def test_decontamination_without_ids(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id int, text string")
    docs = make(spark, [(None, "so alpha beta gamma delta epsilon zeta it is", None), (None, "clean", None)])
    assert [(r.doc_id, r.item_id, r.score) for r in decontamination.contaminated(docs, items).collect()] == [(None, 1, 1.0)]


def test_toxicity_scores_are_plain_sums():
    rng = np.random.default_rng(4)
    model = toxicity.ToxicityModel(rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), -0.4, 0.1)
    texts = ["you horrible IDIOT, go", "one", "", " ".join(f"w{k}x" for k in range(40))]
    got = model.logits(*__import__("grafonda.llm.tokens", fromlist=["x"]).bytes_of(pa.array(texts)))
    for t, value in zip(texts, got, strict=True):
        words = __import__("re").findall(r"[0-9a-z_]+", t.lower())
        each = []
        for w in words:
            b, _, _, _ = toxicity._word_grams(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))
            each.append(float(model.weights[b].mean()) if len(b) else 0.0)
        windows = [np.mean(each[k : k + toxicity.WINDOW]) for k in range(0, len(each), toxicity.WINDOW)]
        want = sum(sorted(windows, reverse=True)[: toxicity.LEADING]) / toxicity.LEADING + model.bias if words else toxicity._odds(0.1)
        assert value == pytest.approx(want, abs=1e-4)


def test_toxicity_gradient(monkeypatch):
    """One round moves the table along the numeric gradient of the loss."""
    texts = pa.array(["bad bad thing", "good word", "bad word here", "nice thing"])
    label = np.array([1, 0, 1, 0])

    def loss(model):
        raw, at = __import__("grafonda.llm.tokens", fromlist=["x"]).bytes_of(texts)
        p = 1 / (1 + np.exp(-model.logits(raw, at)))
        return -np.mean(np.where(label > 0, np.log(p), np.log(1 - p)))

    losses = [loss(toxicity.fit(texts, label, rounds=r, rate=0.05)) for r in (1, 8, 40)]
    assert losses[0] > losses[1] > losses[2]


def test_best_shift():
    x, y = np.array([-3.0, -2, -1, 1, 2, 3]), np.array([0, 0, 0, 1, 1, 1])
    shift = toxicity.best_shift(x, y, 0.2)
    assert ((x + shift >= toxicity._odds(toxicity.FLAG)) == (y > 0)).all()


def bins_needed(lengths, capacity):
    """The least number of bins, by trying all ways (few pieces)."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[k] <= capacity and bins[j] not in bins[:j]:
                put(k + 1, [*bins[:j], bins[j] + lengths[k], *bins[j + 1 :]])
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best[0]


def test_packing_is_near_the_least_number_of_bins():
    rng = np.random.default_rng(2)
    used = least = 0
    for _ in range(40):
        lengths = rng.integers(1, 21, 11).tolist()
        used += sum(n for _, n in packing.plan_bins(dict(Counter(lengths)), 20))
        least += bins_needed(lengths, 20)
    assert used <= 1.06 * least


def test_held_out_by_crc():
    assert binascii.crc32(b"7") % 4 in range(4)


def test_one_token_of_a_million_characters(spark):
    """Work grows with the token's length, and the blocks add up to the whole."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = "".join(np.random.default_rng(1).choice(list(letters), 1_000_000))
    words = "correct" * 150_000
    docs = spark.createDataFrame([(1, f"see {token} here"), (2, words), (3, token[:5000])], "doc_id long, text string")
    model = secrets.train(secrets.labelled_samples(spark.createDataFrame([(1, "some ordinary words of a text")], docs.schema)))
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in secrets.scan(docs, model).collect()}
    place = secrets.ALPHABET.index
    ratio = lambda w: sum(model[place(a) * secrets.SIZE + place(b)] for a, b in zip(w, w[1:], strict=False))
    for doc_id, word, start in ((1, token, 4), (2, words, 0), (3, token[:5000], 0)):
        assert (got[doc_id] == [(start, 3, start + len(word))]) == (ratio(word) >= secrets.LEAST_RATIO)


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_pre_tokens_that_share_a_hash(spark, sf_dir, monkeypatch, most):
    """Hashes of four bits: nearly all are shared, and the counts are the library's; also where there are too many of them to be sent."""
    path = token_counts.model_path()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40").collect()] + [(1000, None), (1001, ""), (1002, "  a\nb a")]
    want = Counter((k, len((t or "").encode()), len(token_counts._library(path)[0].encode(t or ""))) for k, t in rows)
    plain = token_counts._hashes
    monkeypatch.setattr(token_counts, "_hashes", lambda *a: plain(*a) & np.uint64(15))
    monkeypatch.setattr(token_counts, "SHARED", most)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 8 < token_counts.vocabulary(docs, path).select("hash").distinct().count() <= 16
    assert Counter(map(tuple, token_counts.count_tokens(docs, path).collect())) == want
