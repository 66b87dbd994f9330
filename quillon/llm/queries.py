"""The queries of this subpackage and their SQL. The pipeline registers itself beside them."""

from __future__ import annotations

from . import embeddings, htmltext, lm, mixing, packing, quality, secrets, simhash, suffixes, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_html_extraction": htmltext.op2,
    "op3_lm_scoring": lm.op3,
    "op4_embedding_near_dedup": embeddings.op4,
    "op5_suffix_array_dedup": suffixes.op5,
    "op6_packing": packing.op6,
    "op7_toxicity": toxicity.op7,
    "op8_simhash_near_dedup": simhash.op8,
    "op9_secret_scans": secrets.op9,
    "op10_mixing": mixing.op10,
}
ORACLES = {"op1_quality_rules": quality.SQL, "op3_lm_scoring": lm.SQL, "op10_mixing": mixing.SQL}
