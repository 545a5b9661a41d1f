"""Array-column expressions shared by the operators.

Digests and runs of whole numbers are Arrow functions (``ragged``), the others
expressions.  Rule followed throughout: a lambda never reads an *outer* array column.
Catalyst's CollapseProject may inline a computed array into the lambda,
which re-evaluates it once per element (quadratic).  Element lookups are
therefore expressed with ``slice``, ``arrays_zip`` and ``zip_with`` on
whole arrays, which stay linear whatever the producer is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions import ragged


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(c) -> Column:
    return F.lit(c) if isinstance(c, int) else _col(c)


def safe_slice(arr, start0, length) -> Column:
    """``arr[start0 : start0 + length]`` with Python clipping semantics (0-based start)."""
    arr, start0, length = _col(arr), _lit(start0), _lit(length)
    avail = F.greatest(F.lit(0), F.least(length, F.size(arr) - start0))
    return F.slice(arr, start0 + 1, avail)


def index_range(n) -> Column:
    """``[0, 1, ..., n-1]``; empty for n <= 0 (``sequence`` would count down)."""
    n = _lit(n)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array_remove(F.array(F.lit(0)), F.lit(0)))


def null_of(arr) -> Column:
    """A null of the element type of ``arr``."""
    return F.get(_col(arr), F.lit(-1))


def zip_rows(arrays: list[Column]) -> Column:
    """Equal-length arrays ``[a0, a1, ...]`` -> ``[[a0[t], a1[t], ...] for t]`` (transpose)."""
    z = F.arrays_zip(*[a.alias(f"c{q}") for q, a in enumerate(arrays)])
    return F.transform(z, lambda s: F.array(*[s[f"c{q}"] for q in range(len(arrays))]))


def digest(arr) -> Column:
    """Order-sensitive checksum ``sum(x * (i + 1))`` of an integer array, or of a matrix row by row."""
    return ragged.column(ragged.digests, "bigint", arr)


def nested_digest(arr2d) -> Column:
    """:func:`digest` of a row-major flattened matrix."""
    return digest(arr2d)


def sized_digest(arr) -> Column:
    """``struct(n, digest)``: size and :func:`digest` in one use of the array."""
    return ragged.column(ragged.sized_digests, "struct<n:int,digest:bigint>", arr)


def _run_flags(arr) -> Column:
    """``[(x, starts_run)]``: element paired with "differs from its predecessor"."""
    arr = _col(arr)
    prev = F.concat(F.array(null_of(arr)), F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0))))
    return F.zip_with(arr, prev, lambda x, p: F.struct(x.alias("x"), (p.isNull() | (x != p)).alias("s")))


def dedupe_consecutive(arr) -> Column:
    """Collapse runs of equal consecutive values (``unique_consecutive``)."""
    arr = _col(arr)
    kept = F.transform(F.filter(_run_flags(arr), lambda s: s["s"]), lambda s: s["x"])
    return F.when(F.size(arr) > 0, kept).otherwise(arr)


def dedupe_units(df, units: str) -> Column:
    """:func:`dedupe_consecutive` of a column of ``df``; whole numbers in one pass over Arrow batches."""
    kind = df.schema[units].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.IntegerType | T.LongType):
        return ragged.column(ragged.deduped, kind.simpleString(), units)
    return dedupe_consecutive(units)


def run_lengths(arr) -> Column:
    """Lengths of the runs collapsed by :func:`dedupe_consecutive`."""
    arr = _col(arr)
    starts = F.filter(F.transform(_run_flags(arr), lambda s, i: F.when(s["s"], i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(arr)))
    lengths = F.zip_with(starts, ends, lambda s, e: e - s)
    return F.when(F.size(arr) > 0, lengths).otherwise(F.array_remove(F.array(F.lit(0)), F.lit(0)))
