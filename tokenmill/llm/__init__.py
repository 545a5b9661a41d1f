"""Training-data operators: deduplication, packing, mixing, scoring, search and extraction.

Nothing outside this folder imports it.  ``load_all`` registers one query per
operator in ``QUERIES`` (and DuckDB SQL in ``ORACLE`` where SQL can say it).
"""

from __future__ import annotations

from tokenmill.llm.registry import ORACLE, QUERIES, load_all

__all__ = ["ORACLE", "QUERIES", "load_all"]
