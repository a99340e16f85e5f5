"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from buildlens.llm import chat_format, contract, decontaminate, delta_lloyd, fill_middle, html_extract, line_crf, lm_scoring, minhash_dedup, packing, pii, quality_gam, substring_dedup, toxicity

_MODULES = (chat_format, decontaminate, quality_gam, minhash_dedup, line_crf, substring_dedup, pii, packing, lm_scoring, html_extract, delta_lloyd, fill_middle, toxicity, contract)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "oracle_sql", dict)().items()}
