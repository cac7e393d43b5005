"""The queries of this package's operators."""

from __future__ import annotations

from quire.llm import bpe_reuse, collision, collocations, dac_file, divergence, language_id, licenses, mixing, page_blocks, quality_rules, rule_ensemble, simhash, toxicity

MODULES = (licenses, mixing, collision, language_id, bpe_reuse, simhash, quality_rules, rule_ensemble, toxicity, dac_file, collocations, page_blocks, divergence)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
