"""Queries of this folder's operators, over whole tables with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from . import decontamination, flac, jaccard, language, lm, merkle, names, packing, secrets, sharding, token_counts, token_files, toxicity

QUERIES = {
    "op1_external_shuffle": sharding.op1_external_shuffle,
    "op2_flac_media": flac.op2_flac_media,
    "op3_language_id": language.op3_language_id,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_lm_scoring": lm.op6_lm_scoring,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_name_join": names.op11_name_join,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_token_orc": token_files.op13_token_orc,
}
ORACLES: dict[str, str] = {"op8_ngram_jaccard_join": jaccard.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL}
