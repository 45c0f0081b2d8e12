"""The queries of this subpackage and their SQL."""

from . import embedding_dedup, language_id, language_model, mixture, ngram_join, packing, pii, quality_rules, substring_dedup, url_rules

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_mixture": mixture.op2_mixture,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_url_rules": url_rules.op4_url_rules,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_language_model": language_model.op6_language_model,
    "op7_pii": pii.op7_pii,
    "op8_packing": packing.op8_packing,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_language_id": language_id.op10_language_id,
}
#: Queries that have no entry are tested against brute force in tests/llm.
ORACLES = {
    "op2_mixture": mixture.OP2_SQL,
    "op4_url_rules": url_rules.OP4_SQL,
}
