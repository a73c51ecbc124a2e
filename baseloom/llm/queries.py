"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, licenses, line_dedup, packing, quality_llr, sharding, simhash, token_cache, toxicity, url_lm

QUERIES = {
    "op1_url_filters": url_lm.op1_url_filters,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_sharding": sharding.op5_sharding,
    "op6_simhash": simhash.op6_simhash,
    "op7_token_counts": token_cache.op7_token_counts,
    "op8_packing": packing.op8_packing,
    "op9_quality_rules": quality_llr.op9_quality_rules,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {"op2_line_dedup": line_dedup.OP2_SQL, "op4_decontaminate": decontaminate.OP4_SQL, "op5_sharding": sharding.OP5_SQL}
