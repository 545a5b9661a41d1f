"""Registry of runnable queries ``(spark, sf_dir) -> DataFrame`` and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn`` under ``name``; ``oracle`` is DuckDB SQL over the base tables."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return wrap


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from tokenmill.plans import (  # noqa: F401
        q_assemble,
        q_scoring,
        q_corpus,
        q_store,
        q_vector,
    )
