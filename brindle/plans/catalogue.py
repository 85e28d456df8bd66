"""The library's query modules, in the order the entry point lists them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import language_queries, node_queries, operator_queries, orphan_queries

PARTS = [language_queries, operator_queries, node_queries, orphan_queries]


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return node_queries.QUERIES["funnel_flagship"](spark, root)
