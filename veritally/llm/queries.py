"""The queries of the operators and their SQL twins."""

from . import decontaminate, html_extract, language_id, merkle, mixing, near_dedup, permutation_index, quality_crf, quality_rules, secret_scan, substring_dedup, toxicity, vector_codes

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_language_id": language_id.query,
    "op3_html_extract": html_extract.query,
    "op4_toxicity": toxicity.query,
    "op5_secret_scan": secret_scan.query,
    "op6_decontaminate": decontaminate.query,
    "op7_quality_rules": quality_rules.query,
    "op8_near_dedup": near_dedup.query,
    "op9_quality_crf": quality_crf.query,
    "op10_mixing": mixing.query,
    "op11_permutation_index": permutation_index.query,
    "op12_vector_codes": vector_codes.query,
    "op13_merkle_manifest": merkle.query,
}
ORACLE = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op5_secret_scan": secret_scan.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_near_dedup": near_dedup.SQL,
    "op10_mixing": mixing.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
