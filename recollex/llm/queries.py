"""The queries of this subpackage and their DuckDB SQL (where SQL can express them)."""

from recollex.llm import bpe, chat_format, decontaminate, exact_dedup, hard_negatives, language_id, lm_score, near_dedup, packing, periodic_runs, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_lm_score": lm_score.op10_lm_score,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_bpe": bpe.op12_bpe,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
}
