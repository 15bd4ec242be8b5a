"""The registered queries opN_<name>, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, decontamination, edit_embedding, filter_audit, language_id, lm_score, packing, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup, url_filter

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_secret_scan": secret_scan.op2,
    "op3_quality_classifier": quality_classifier.op3,
    "op4_quality_rules": quality_rules.op4,
    "op5_substring_dedup": substring_dedup.op5,
    "op6_simhash": simhash.op6,
    "op7_packing": packing.op7,
    "op8_url_filter": url_filter.op8,
    "op9_lm_score": lm_score.op9,
    "op10_decontamination": decontamination.op10,
    "op11_edit_embedding": edit_embedding.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_alignment": alignment.op13,
}

ORACLE_SQL = {
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
