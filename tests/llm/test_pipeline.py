import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grafonda.llm import decontamination, jaccard, language, packing, secrets

from .test_operators import LONG, make


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    a = language.stage_language(spark, docs, sf_dir)
    assert a.columns == docs.columns and a.count() > 0.95 * len(before)
    b = jaccard.stage_near_duplicates(spark, docs, sf_dir)
    kept = {r.doc_id for r in b.select("doc_id").collect()}
    assert b.columns == docs.columns and kept == {r.class_id for r in jaccard.join(docs).collect()}
    c = decontamination.stage_decontamination(spark, docs, sf_dir)
    leaks = {r.doc_id for r in decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert c.columns == docs.columns and {r.doc_id for r in c.collect()} == before - leaks and leaks
    d = secrets.stage_secrets(spark, docs, sf_dir)
    assert d.columns == docs.columns and d.count() == len(before)
    assert all(len(r.text) == r.n_chars for r in d.collect())
    e = packing.stage_packing(spark, docs.limit(20), sf_dir)
    assert {r.doc_id for r in e.collect()} == {r.doc_id for r in docs.limit(20).collect()}


def test_run_is_its_stages_by_hand(spark, sf_dir):
    """run() gives the pieces of what each stage, done by its operator's plain result on the rows before, leaves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.identify(docs, language.train_on_labelled(docs))
    rows = found.where("lang_pred <> 'und' and score >= 0.5").select(*docs.columns)
    classes = jaccard.join(rows)
    keep = {r.class_id for r in classes.collect()}
    rows = rows.where(F.col("doc_id").isin(*keep))
    leaks = {r.doc_id for r in decontamination.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    left = {r.doc_id: r.text for r in secrets.stage_secrets(spark, rows.where(~F.col("doc_id").isin(*leaks)), sf_dir).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    out = corpus_pipeline.run(spark, sf_dir).collect()
    by_doc = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, b"")
        by_doc[r.doc_id] += bytes(r.ids)
    assert set(by_doc) == set(left)
    some = sorted(left)[:40]
    for k in some:
        ids = [*library.encode(left[k], add_special_tokens=False).ids, 0]
        assert by_doc[k] == b"".join(x.to_bytes(4, "little") for x in ids)
    taken = {}
    for r in out:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in taken.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


CLASH = ["lang_pred", "base", "spans", "sequence_id", "offset", "shard", "slot", "class", "first_id", "row", "h", "size", "bands"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with the names that operators use."""
    texts = [(0, None, "en"), (1, "", None), (2, "   \n\t", "fr"), (3, LONG, "en"), (4, "the cat sat on the mat and it's there", "en"), (4, "the cat sat on the mat and it's there", "en"), (None, "no id here at all", "de"), (None, None, None), (6, "password = abcdefghijkl0123 for you", "de")]
    return make(spark, texts).withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_tables(spark, sf_dir, clashing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, clashing, sf_dir)
    assert out.columns == clashing.columns and dict(out.dtypes) == dict(clashing.dtypes)
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASH) and all(r.score == "x" for r in rows)
    many = {"language_id": (3, 9), "ngram_jaccard_join": (5, 6), "benchmark_decontamination": (9, 9), "secret_scans": (9, 9)}[name]
    assert many[0] <= len(rows) <= many[1]
    empty = stage(spark, clashing.limit(0), sf_dir)
    assert empty.columns == clashing.columns and empty.count() == 0


def test_last_stage_on_odd_tables(spark, sf_dir, clashing):
    out = packing.stage_packing(spark, clashing, sf_dir).collect()
    assert sum(r.piece == 0 for r in out) == 9 and sum(r.length == 1 for r in out) >= 3
    assert packing.stage_packing(spark, clashing.limit(0), sf_dir).count() == 0


def test_unlabelled_corpora_stay_whole(spark, clashing):
    bare = clashing.withColumn("lang", F.lit(None).cast("string"))
    assert language.stage_language(spark, bare, "").count() == 9


def test_run_on_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
