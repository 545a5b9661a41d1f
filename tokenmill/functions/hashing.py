"""Deterministic per-row draws.

Spark retries tasks, so every random choice is a pure function of the row:
``u(salt, key) = first 32 bits of md5("salt:key:seed") / 2**32`` in [0, 1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(text: Column) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of md5(text)."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(salt: str, key, seed: int = 42) -> Column:
    """Deterministic uniform in [0, 1) keyed by (salt, key, seed)."""
    text = F.concat(F.lit(f"{salt}:"), _col(key).cast("string"), F.lit(f":{seed}"))
    return hash32(text) / F.lit(TWO_POW_32)


def uniform_sql(salt: str, key_sql: str, seed: int = 42) -> str:
    """Spark SQL text of :func:`uniform` for use inside ``F.expr``/lambdas."""
    return (
        f"(cast(conv(substr(md5(concat('{salt}:', cast({key_sql} as string), ':{seed}')), 1, 8), 16, 10)"
        f" as bigint) / {TWO_POW_32})"
    )
