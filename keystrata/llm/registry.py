"""The training-data operators' queries, and the DuckDB equivalents of those that SQL can express."""

from . import ann, chat, decontaminate, jaccard, langid, licenses, packing, quality, tokenids, warc

QUERIES = {
    "op1_jaccard_components": jaccard.op1_jaccard_components,
    "op2_warc_index": warc.op2_warc_index,
    "op3_benchmark_leaks": decontaminate.op3_benchmark_leaks,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_language_id": langid.op5_language_id,
    "op6_token_ids": tokenids.op6_token_ids,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_inner_product_search": ann.op8_inner_product_search,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_chat_snapshots": chat.op10_chat_snapshots,
}
ORACLES = {
    "op1_jaccard_components": jaccard.ORACLE_OP1,
    "op2_warc_index": warc.ORACLE_OP2,
    "op4_license_scan": licenses.ORACLE_OP4,
    "op10_chat_snapshots": chat.ORACLE_OP10,
}
