"""Numeric helpers with engine-independent results."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)


def round_half_up(x, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` in double arithmetic.

    Spelled out (rather than ``round``) so the same IEEE operations give the
    same digits in any engine; used for reported metrics only.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    y = x.cast("double") * F.lit(scale)
    # beyond 2^52 a double is already integral; floor() would also leave bigint range
    r = F.when(F.abs(y) < F.lit(2.0**52), F.floor(y + F.lit(0.5)).cast("double")).otherwise(y)
    return r / F.lit(scale)


def round_sql(x_sql: str, digits: int) -> str:
    """DuckDB/ANSI text of :func:`round_half_up`."""
    y = f"(({x_sql})::DOUBLE * {float(10**digits)!r})"
    return f"((CASE WHEN abs({y}) < {2.0**52!r} THEN floor({y} + 0.5) ELSE {y} END) / {float(10**digits)!r})"


def round_significant(x, digits: int) -> Column:
    """Round to ``digits`` significant digits via ``%.{digits-1}e`` text, back to double.

    Used to compare ill-conditioned values (e.g. perplexities of 1e20) across
    engines whose summation order differs in the last bits.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.format_string(f"%.{digits - 1}e", x.cast("double")).cast("double")


def round_significant_sql(x_sql: str, digits: int) -> str:
    return f"printf('%.{digits - 1}e', ({x_sql})::DOUBLE)::DOUBLE"
