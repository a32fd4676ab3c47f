"""Queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

from tallyline.llm import (
    decontamination, fill_in_middle, language_id, near_dedup, packing, periodic_runs, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, substring_dedup,
    token_files, url_filter,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_token_files": token_files.op10_token_files,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_best_fit_packing": packing.op12_best_fit_packing,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op5_secret_scan": secret_scan.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
}
