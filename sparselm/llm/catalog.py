"""Registered queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from sparselm.llm import (
    decontaminate,
    embedding_dedup,
    hard_negatives,
    license_scan,
    maxent_lm,
    minhash_dedup,
    packing,
    personal_data,
    quality,
    ranked_search,
    secret_scan,
    suffix_dedup,
    token_counts,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_packing": packing.op4_packing,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality": quality.op8_quality,
    "op9_maxent_lm": maxent_lm.op9_maxent_lm,
    "op10_minhash": minhash_dedup.op10_minhash,
    "op11_personal_data": personal_data.op11_personal_data,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

# the other queries are tested against brute-force versions in tests/llm
ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op12_ranked_search": ranked_search.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
