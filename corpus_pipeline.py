"""A training-data pipeline: each stage reads what the one before wrote, and its decisions take effect.

run() writes every stage but the last to the shared folder, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grafonda.llm import decontamination, jaccard, language, packing, secrets
from grafonda.llm.storage import work_table

#: (name, function of (spark, docs, sf_dir)): all but the last return the columns of documents.
STAGES = [
    ("language_id", language.stage_language),
    ("ngram_jaccard_join", jaccard.stage_near_duplicates),
    ("benchmark_decontamination", decontamination.stage_decontamination),
    ("secret_scans", secrets.stage_secrets),
    ("best_fit_packing", packing.stage_packing),
]

#: Learned models, alignment and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
