"""The registered queries of this subpackage; ORACLES has those that SQL can express."""

from __future__ import annotations

from . import decontaminate, exact_dedup, licences, lm_score, near_dedup, packing, pii, quality, sharding, suffix_dedup

_ALL = {
    "op1_quality_classifier": (quality.op1_quality_classifier, quality.ORACLE_SQL),
    "op2_best_fit_packing": (packing.op2_best_fit_packing, packing.ORACLE_SQL),
    "op3_pii": (pii.op3_pii, pii.ORACLE_SQL),
    "op4_exact_dedup": (exact_dedup.op4_exact_dedup, exact_dedup.ORACLE_SQL),
    "op5_licence_scan": (licences.op5_licence_scan, licences.ORACLE_SQL),
    "op6_suffix_array_dedup": (suffix_dedup.op6_suffix_array_dedup, suffix_dedup.ORACLE_SQL),
    "op7_sharding": (sharding.op7_sharding, sharding.ORACLE_SQL),
    "op8_benchmark_decontamination": (decontaminate.op8_benchmark_decontamination, decontaminate.ORACLE_SQL),
    "op9_minhash_near_dedup": (near_dedup.op9_minhash_near_dedup, near_dedup.ORACLE_SQL),
    "op10_lm_score": (lm_score.op10_lm_score, lm_score.ORACLE_SQL),
}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
