"""The queries of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

import corpus_pipeline
from tilespark.llm import decontamination, exact_dedup, mixing, near_dedup, passages, pii, quality, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_compact_windows": passages.op1_compact_windows,
    "op2_kernel_quality": quality.op2_kernel_quality,
    "op3_suffix_array_dedup": substring_dedup.op3_suffix_array_dedup,
    "op4_virtual_slots": sharding.op4_virtual_slots,
    "op5_target_mix": mixing.op5_target_mix,
    "op6_containment_search": decontamination.op6_containment_search,
    "op7_ftrl_toxicity": toxicity.op7_ftrl_toxicity,
    "op8_chunk_recipes": exact_dedup.op8_chunk_recipes,
    "op9_hamming_near_dedup": near_dedup.op9_hamming_near_dedup,
    "op10_contextual_pii": pii.op10_contextual_pii,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op5_target_mix": mixing.ORACLE, "op6_containment_search": decontamination.ORACLE, "op8_chunk_recipes": exact_dedup.ORACLE}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
