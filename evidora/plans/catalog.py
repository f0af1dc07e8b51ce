"""The catalogue: every query of the library by name, and its SQL for an independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidora.plans import answer_queries, conversation_queries, evaluation_queries, quality_queries, retrieval_queries, run_queries, scenario_queries, spoken_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (text_queries, retrieval_queries, answer_queries, evaluation_queries, quality_queries, conversation_queries, run_queries, spoken_queries, scenario_queries)
QUERIES: dict[str, Query] = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
