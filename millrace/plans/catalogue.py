"""All registered queries of the engine, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import cue_queries, eval_queries, form_queries, grounding_queries, join_queries, layout_queries, log_queries, name_queries, retrieval_queries, rule_queries, series_queries, stream_queries, text_queries

#: Modules that register queries: each has QUERIES (name -> function) and SQL (name -> text).
MODULES = (retrieval_queries, log_queries, eval_queries, series_queries, text_queries, join_queries, rule_queries, cue_queries, stream_queries, form_queries, name_queries, grounding_queries, layout_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
