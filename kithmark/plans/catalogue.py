"""All queries outside the llm subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kithmark.plans import linkage_catalogue, skew

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "candidate_lists"

for _part in (skew, linkage_catalogue):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
