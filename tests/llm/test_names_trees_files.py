"""The name join against every pair, Merkle proofs against a tree built by hand, ORC token files against the library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grafonda.llm import merkle, names, packing, storage, token_files

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def osa(a, b):
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in sorted(set(texts))], "name string")


def pairs_of(left, right, most):
    return {(r, m, d) for r in set(right) for m in set(left) if abs(len(r) - len(m)) <= most and (d := osa(m, r)) <= most}


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_every_pair_of_short_names(spark, most):
    rng = random.Random(most)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(120)]
    got = {tuple(r) for r in names.name_pairs(frame(spark, words[:70]), frame(spark, words[50:]), most).collect()}
    assert got == pairs_of(words[:70], words[50:], most)


def test_edits_across_segments_and_odd_characters(spark):
    left = ["abcdefghijkl", "éàüöß😀日本語x", "x", "xy", "abc", "a b  c", "AbC"]
    right = ["abcedfghijkl", "abcdefhgijlk", "bacdefghikjl", "éàüößb日本語x", "éàüö😀ß日本語x", "y", "yx", "ab", "acb", "ab c", "zzzz"]
    got = [tuple(r) for r in names.name_pairs(frame(spark, left), frame(spark, right)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == pairs_of(left, right, 2)


def test_hot_shards_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", 8)
    rng = random.Random(5)
    left = ["joelma " + "".join(rng.choices("abcd", k=5)) for _ in range(300)]
    right = ["joelma " + "".join(rng.choices("abcd", k=5)) for _ in range(60)]
    ours, theirs = names._grid(names._left_rows(frame(spark, left), 2), names._right_rows(frame(spark, right), 2), 900)
    assert ours.agg(F.max("left_block")).first()[0] > 10 and theirs.agg(F.max("right_block")).first()[0] > 2
    got = [tuple(r) for r in names.name_pairs(frame(spark, left), frame(spark, right)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == pairs_of(left, right, 2)


def test_very_long_names(spark):
    base = "".join(random.Random(1).choices("abcdefgh", k=20_000))
    right = [base[:7] + "z" + base[8:], base[:-2] + base[-1] + base[-2], base + "xyz"]
    got = {(r[0], r[2]) for r in names.name_pairs(frame(spark, [base]), frame(spark, right)).collect()}
    assert got == {(right[0], 1), (right[1], 1 if base[-1] != base[-2] else 0)}


CLIENTS = "client_id long, name string, distance string, n long"
VENDORS = "vendor_id long, name string, length int"


def expected(clients, vendors):
    out = defaultdict(list)
    for v, name in {(v, n) for v, n in vendors if n}:
        h = zlib.crc32(str(v).encode())
        if v is not None and h % 2 == 0 and len(name) >= 2:
            k = h % (len(name) - 1)
            name = name[:k] + name[k + 1] + name[k] + name[k + 2 :]
        name = name.translate(LOWER)
        for c, other in clients:
            if other and (d := osa(other.translate(LOWER), name)) <= 2:
                out[v, d].append(c)
    known = {k: [c for c in v if c is not None] for k, v in out.items()}
    return {(*k, len(out[k]), min(v, default=None), sum(zlib.crc32(str(c).encode()) for c in v)) for k, v in known.items()}


def counted(spark, clients, vendors):
    left = spark.createDataFrame([(c, n, "d", 1) for c, n in clients], CLIENTS)
    right = spark.createDataFrame([(v, n, 1) for v, n in vendors], VENDORS)
    right = right.select("vendor_id", names.lowered(names.misspelt(F.col("name"), F.col("vendor_id"))).alias("name"))
    return [tuple(r) for r in names.join_counts(left, right).drop("name").collect()]


def test_counts_with_nulls_repeats_and_clashing_columns(spark):
    clients = [(1, "Anna Berg"), (2, "anna berg"), (2, "anna berg"), (3, None), (4, ""), (None, "ANNA BERG"), (5, "Ana Berg"), (6, "Änna Berg"), (7, "A")]
    vendors = [(v, n) for v in range(12) for n in ("Anna Berg",)] + [(20, None), (21, ""), (22, "B"), (None, "anna berg"), (0, "Anna Berg")]
    got = counted(spark, clients, vendors)
    assert len(got) == len(set(got)) and set(got) == expected(clients, vendors)
    assert counted(spark, [], vendors) == [] and counted(spark, clients, []) == []


def test_name_join_on_tables(spark, sf_dir):
    from grafonda.llm.queries import QUERIES

    clients = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/clients.parquet").select("client_id", "name").collect()]
    vendors = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/vendors.parquet").select("vendor_id", "name").collect()]
    got = [tuple(r) for r in QUERIES["op11_name_join"](spark, sf_dir).collect()]
    assert got and set(got) == expected(clients, vendors) and len(got) == len(set(got))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def by_hand(rows, fan=8):
    """Multiset of (doc_id, leaf, subroot, root, proof, folded, verified)."""

    def spell(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def build(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + fan])) for k in range(0, len(levels[-1]), fan)])
        return levels

    def sides(levels, k):
        out = []
        for level in levels[:-1]:
            run = k // fan * fan
            out.append(("".join(level[run:k]), "".join(level[k + 1 : run + fan])))
            k //= fan
        return out

    branches = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        other = text.translate(LOWER) if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else text
        both = [sha("".join(map(spell, (doc_id, source, lang, n, t)))) for t in (text, other)]
        branches[lang].append((doc_id is not None, doc_id or 0, both[0], doc_id, both[1]))
    order = sorted(branches, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: build([r[2] for r in sorted(branches[x])]) for x in order}
    top = build([trees[x][-1][0] for x in order])
    out = Counter()
    for place, lang in enumerate(order):
        for k, (_, _, leaf, doc_id, other) in enumerate(sorted(branches[lang])):
            path = sides(trees[lang], k) + sides(top, place)
            node = other
            for a, b in path:
                node = sha(a + node + b)
            out[doc_id, leaf, trees[lang][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]] += 1
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, branch string, rank long, key string"


def manifest_rows(spark, rows, **sizes):
    docs = spark.createDataFrame([(*r, "b", 1, "k") for r in rows], DOCS)
    low = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, names.lowered(F.col("text"))).otherwise(F.col("text"))
    tree, above = merkle.manifest(docs, changed={"text": low}, **sizes)
    return tree, Counter(map(tuple, merkle.prove(tree, above, "long", **sizes).collect()))


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_proofs_by_hand(spark, levels):
    rng = random.Random(levels)
    rows = [(k, "Text Ä " * rng.randint(0, 5) + str(k), "en", "s", k) for k in range(150)] + [(200 + k, "x", "de", None, None) for k in range(9)]
    rows += [(300, "lone", "fr", "s", 4), (None, None, None, None, None), (None, "A", None, "s", 1), (7, "Again", "en", "s", 5), (7, "Again", "en", "s", 5), (401, "", "en", "", 0), (402, "LONG " * 200_000, "=", "s", 1)]
    _, got = manifest_rows(spark, rows, levels=levels)
    assert got == by_hand(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_leaf_no_leaf_and_hot_keys(spark):
    one = [(1, "x", "en", "s", 1)]
    assert manifest_rows(spark, one)[1] == by_hand(one)
    assert manifest_rows(spark, [])[1] == Counter()
    same = [(5, "same", "en", "s", 4)] * 700 + [(k, "other", "en", "s", 5) for k in range(300)]
    tree, got = manifest_rows(spark, same, levels=1)
    assert got == by_hand(same)
    leaves = tree.rounds[0].collect()
    assert sorted(r["rank"] for r in leaves) == list(range(1000)) and len(tree.rounds) == 5


def test_changed_rows_are_found_and_others_stay(spark, sf_dir):
    from grafonda.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op12_merkle_manifest"](spark, sf_dir).collect():
        text = docs[r.doc_id] or ""
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0 or text == text.translate(LOWER))


TOKENS = "doc_id long, text string, part string, at string, ids string"


def library_rows(rows):
    from tokenizers import Tokenizer

    library, at, out = Tokenizer.from_file(packing.tokenizer_path()), 0, []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_round_trip(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "été 日本語 <|endoftext|> it's"), (4, "word " * 50_000), (9, "last one")]
    docs = spark.createDataFrame([(i, t, "p", "a", "x") for i, t in random.Random(3).sample(rows, len(rows))], TOKENS).repartition(3)
    where = storage.shared_path(spark, "token_test")
    token_files.write(docs, where, packing.tokenizer_path())
    assert sorted(map(tuple, token_files.positions(spark, where).collect()), key=lambda r: r[1]) == library_rows(rows)
    storage.discard_at_exit(spark, where)


def test_documents_that_share_an_id(spark):
    rows = [(5, f"text {k % 3}") for k in range(400)] + [(6, "after")]
    where = storage.shared_path(spark, "token_test")
    token_files.write(spark.createDataFrame([(i, t, "p", "a", "x") for i, t in rows], TOKENS).repartition(7), where, packing.tokenizer_path())
    got = sorted(map(tuple, token_files.positions(spark, where).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()] and got[-1][0] == 6
    assert Counter((r[2], r[3]) for r in got) == Counter((r[2], r[3]) for r in library_rows(rows))
    storage.discard_at_exit(spark, where)


def test_no_documents(spark):
    where = storage.shared_path(spark, "token_test")
    token_files.write(spark.createDataFrame([], TOKENS), where, packing.tokenizer_path())
    assert token_files.positions(spark, where).count() == 0


def scanned(df):
    """Rows that the scan handed on."""
    df.collect()

    def walk(node):
        held = node.metrics().get("numOutputRows")
        if node.nodeName().startswith("Scan"):
            return held.get().value()
        return sum(walk(node.children().apply(k)) for k in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_bloom_filter_and_index_leave_groups_out(spark):
    rows = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).coalesce(1)
    where = storage.shared_path(spark, "token_test")
    token_files.write(rows, where, packing.tokenizer_path())
    found = token_files.of_documents(spark, where, [20_000])
    assert [r.doc_id for r in found.collect()] == [20_000]
    assert 0 < scanned(found.select("doc_id")) < 5000  # the index: only groups that may hold it
    absent = [token_files.of_documents(spark, where, [k]).select("doc_id") for k in (10_001, 20_001, 30_001)]
    assert min(map(scanned, absent)) == 0  # the Bloom filter: inside the range, and not there
    assert "ids" not in token_files.part_starts(spark, where)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    storage.discard_at_exit(spark, where)
