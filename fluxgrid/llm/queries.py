"""The document queries by name, with oracle text where SQL can express them."""

from fluxgrid.llm import align, chunks, decontaminate, jaccard, langid, lm, mixing, overwrite, packing, quality, secrets, substrings, toxicity

QUERIES = {
    "op1_suffix_array_dedup": substrings.op1_suffix_array_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_language_id": langid.op5_language_id,
    "op6_chunk_dedup": chunks.op6_chunk_dedup,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_late_overwrite": overwrite.op12_late_overwrite,
    "op13_best_fit_packing": packing.op13_best_fit_packing,
}
ORACLES = {"op7_mix_sources": mixing.OP7_SQL}
