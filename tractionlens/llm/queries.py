"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tractionlens.llm import chat_format, decontamination, language_id, license_scan, lm_scoring, merkle_manifest, near_dedup, packing, quality_rules, source_divergence, substring_dedup, toxicity, url_filters

_MODULES = (decontamination, toxicity, quality_rules, packing, lm_scoring, language_id, url_filters, chat_format, near_dedup, substring_dedup, license_scan, merkle_manifest, source_divergence)


def queries() -> dict:
    out = {"pipeline": corpus_pipeline.run}
    for module in _MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    for module in _MODULES:
        out |= module.ORACLES
    return out
