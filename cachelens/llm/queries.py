"""Registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from cachelens.llm import decontamination, language_id, licenses, near_dedup, packing, quality_rules, substring_dedup, tool_calls, toxicity, url_filters

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_tool_calls": tool_calls.op7_tool_calls,
    "op8_language_id": language_id.op8_language_id,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_packing": packing.op10_packing,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op3_quality_rules": quality_rules.ORACLE, "op7_tool_calls": tool_calls.ORACLE}
