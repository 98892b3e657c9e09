"""The corpus operators' queries and their SQL."""

from talliard.llm import block_dedup, decontaminate, embedding_dedup, jaccard_join, line_dedup, merkle, mixing, oracle, pii, quality, resample, suffix_dedup, token_files, url_filter

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_pii": pii.op4,
    "op5_jaccard_join": jaccard_join.op5,
    "op6_block_dedup": block_dedup.op6,
    "op7_line_dedup": line_dedup.op7,
    "op8_token_files": token_files.op8,
    "op9_url_filters": url_filter.op9,
    "op10_mixing": mixing.op10,
    "op11_importance_resampling": resample.op11,
    "op12_embedding_dedup": embedding_dedup.op12,
    "op13_merkle_manifest": merkle.op13,
}
ORACLE_SQL = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_decontamination": oracle.OP2,
    "op3_suffix_dedup": oracle.OP3,
    "op6_block_dedup": oracle.OP6,
    "op7_line_dedup": oracle.OP7,
    "op9_url_filters": url_filter.OP9_SQL,
    "op11_importance_resampling": oracle.OP11,
    "op12_embedding_dedup": oracle.OP12,
    "op13_merkle_manifest": oracle.OP13,
}
