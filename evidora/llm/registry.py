"""All queries of this folder and their SQL, where SQL can express them."""

from __future__ import annotations

from evidora.llm import chat, classifier, decontaminate, heap_lloyd, line_dedup, packing, pii, quality_rules, simhash, structure_repair, token_counts, url_filter, warc

MODULES = (pii, warc, simhash, packing, classifier, decontaminate, line_dedup, token_counts, chat, quality_rules, heap_lloyd, structure_repair, url_filter)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in getattr(module, "SQL", {}).items()}
