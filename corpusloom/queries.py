"""Every query of the engine by name, with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) as the query ``name``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to blocks, sections and chunks, then a fused search."""
    return QUERIES["api1_search"](spark, sf_dir)


from corpusloom.plans import queries_index, queries_pages, queries_search, queries_text  # noqa: E402, F401  each registers its own
