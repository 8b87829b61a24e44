"""The queries of this subpackage and, where SQL can state them, their oracles."""

from mailweir.llm import bpe, decontaminate, jaccard, quality, sharding, tokenids, topk, urls, warc, wordpiece

QUERIES = {
    "op1_warc_round_trip": warc.op1_warc_round_trip,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_jaccard_components": jaccard.op3_jaccard_components,
    "op4_token_id_files": tokenids.op4_token_id_files,
    "op5_bpe_round_trip": bpe.op5_bpe_round_trip,
    "op6_url_filters": urls.op6_url_filters,
    "op7_token_counts": wordpiece.op7_token_counts,
    "op8_exact_top_k": topk.op8_exact_top_k,
    "op9_histogram_shards": sharding.op9_histogram_shards,
    "op10_quality_classifier": quality.op10_quality_classifier,
}

ORACLES = {
    "op1_warc_round_trip": warc.ORACLE_SQL, "op2_decontamination": decontaminate.ORACLE_SQL, "op3_jaccard_components": jaccard.ORACLE_SQL,
    "op6_url_filters": urls.ORACLE_SQL, "op8_exact_top_k": topk.ORACLE_SQL,
}
