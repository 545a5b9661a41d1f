"""Queries of this subpackage, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MODULES = (
    "topk",
    "multi_index",
    "packing",
    "toxicity",
    "quality",
    "substring",
    "ngram_join",
    "suffix",
    "mixing",
    "html_text",
    "whitening",
    "prefix_trie",
    "lm_scoring",
)


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return wrap


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"tokenmill.llm.{module}")
