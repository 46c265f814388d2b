"""The corpus operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from voxloom.llm import bpe, decontaminate, fingerprint, hard_negatives, lexical_search, licenses, mixing, near_dup, quality, secrets, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_sharding": sharding.op4_sharding,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_license_scans": licenses.op6_license_scans,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_near_dedup": near_dup.op8_near_dedup,
    "op9_bpe": bpe.op9_bpe,
    "op10_mixing": mixing.op10_mixing,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_decontamination": decontaminate.op12_decontamination,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op4_sharding": sharding.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op12_decontamination": decontaminate.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
