"""Registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from tallystone.llm import (
    decontaminate, html_extraction, licenses, line_dedup, packing, prefix_trie, quality_classifier, quality_rules,
    secrets, simhash, suffix_dedup, toxicity, whitening,
)

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_license_scans": licenses.op7_license_scans,
    "op7_license_texts": licenses.op7_license_texts,
    "op8_packing": packing.op8_packing,
    "op9_html_extraction": html_extraction.op9_html_extraction,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_conversation_prefix_trie": prefix_trie.op13_conversation_prefix_trie,
}
ORACLES = {
    "op1_suffix_array_dedup": suffix_dedup.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
    "op6_secret_scans": secrets.OP6_SQL,
    "op7_license_scans": licenses.OP7_SQL,
    "op11_line_dedup": line_dedup.OP11_SQL,
    "op13_conversation_prefix_trie": prefix_trie.OP13_SQL,
}
