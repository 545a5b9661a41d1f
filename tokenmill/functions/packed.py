"""Rows of whole numbers in as few bits as they need, for exchanges and sorts.

A packed row is ``struct<n:int,bits:int,cells:binary,holes:binary>``: ``n``
values of ``bits`` bits each, and where they are null (``holes`` is null in a
row without).  Values stand in groups of 4 up to 16 bits, of 2 up to 32 and
alone beyond, so that a group is whole bytes of one 64-bit word; the last group
of a row is filled up with 0.  Rows that are packed together share their width,
64 bits if a value is negative.  A null row stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenmill.functions import ragged
from tokenmill.functions.workers import trim_memory

KIND = "struct<n:int,bits:int,cells:binary,holes:binary>"
_TYPE = pa.struct([("n", pa.int32()), ("bits", pa.int32()), ("cells", pa.binary()), ("holes", pa.binary())])

#: so many values are packed or unpacked at a time (a row at least)
VALUES = 1 << 18


def _group(bits: int) -> int:
    return 4 if bits <= 16 else 2 if bits <= 32 else 1


def _width(values: np.ndarray) -> int:
    """Bits that hold any of ``values``, such that a group of them is whole bytes."""
    least, most = int(values.min(initial=0)), int(values.max(initial=0))
    bits = 64 if least < 0 else max(1, most.bit_length())
    whole = 8 // _group(bits)
    return -(-bits // whole) * whole


def _filled(n: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows filled up to whole groups, and where among all places their values stand."""
    filled = -(-n // group) * group
    held = np.ones(int(filled.sum()), bool)
    held[ragged.ranges(np.cumsum(filled) - (filled - n), filled - n)] = False
    return filled, held


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = ragged.ends_of(counts).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(cells: pa.Array) -> np.ndarray:
    """The bytes of all rows, one behind another."""
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    data = cells.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]


def _holes(null: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = ragged.ends_of(counts).tolist()
    rows = [null[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return pa.array([np.packbits(r).tobytes() if r.any() else None for r in rows], pa.binary())


def _pack(rows: pa.Array) -> pa.StructArray:
    n, values = ragged.sizes(rows), rows.flatten()
    x = ragged.ints(values)
    bits = _width(x)
    group = _group(bits)
    filled, held = _filled(n, group)
    cells = np.zeros(len(held), np.uint64)
    cells[held] = x.view(np.uint64)
    words = np.zeros(len(cells) // group, np.uint64)
    for i in range(group):
        words |= cells[i::group] << np.uint64(i * bits)
    size = group * bits // 8
    body = words.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :size]
    holes = _holes(ragged.nulls(values), n) if values.null_count else pa.nulls(len(n), pa.binary())
    null = ragged.nulls(rows)
    fields = [pa.array(n, pa.int32()), pa.array(np.full(len(n), bits), pa.int32()), _binary(body, filled // group * size), holes]
    return pa.StructArray.from_arrays(fields, fields=list(_TYPE), mask=pa.array(null) if null.any() else None)


def in_parts(work, counts: np.ndarray, *columns: pa.Array) -> pa.Array:
    """``work`` of Arrow arrays of rows with ``counts`` values, some rows at a time, to packed rows."""
    out = [work(*[c.slice(a, b - a) for c in columns]) for a, b in ragged.parts(counts, VALUES)]
    return pa.concat_arrays(out) if out else pa.array([], _TYPE)


def pack(rows: pa.Array) -> pa.Array:
    """Rows of whole numbers, packed."""
    return in_parts(_pack, ragged.sizes(rows), rows)


def sizes(rows: pa.Array) -> np.ndarray:
    """Values of every packed row; none of a null row."""
    return ragged.ints(rows.flatten()[0])


def _values(n: np.ndarray, bits: int, cells: pa.Array) -> np.ndarray:
    """The values of rows of one width, flat."""
    group = _group(bits)
    size = group * bits // 8
    data = _bytes(cells).reshape(-1, size)
    words = np.zeros((len(data), 8), np.uint8)
    words[:, :size] = data
    words = words.view("<u8").ravel()
    out = np.empty((len(words), group), np.uint64)
    for i in range(group):
        out[:, i] = (words >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)
    return out.ravel().view(np.int64)[_filled(n, group)[1]]


def unpack(rows: pa.Array, kind: pa.DataType | None = None) -> pa.ListArray:
    """Packed rows as rows of whole numbers, longs unless ``kind`` says otherwise."""
    kind = kind or pa.int64()
    counts, widths, cells, holes = rows.flatten()
    n, widths = ragged.ints(counts), ragged.ints(widths)
    held = np.unique(widths[n > 0])
    if len(held) <= 1:
        values = _values(n, int(held[0]), cells) if len(held) else np.zeros(0, np.int64)
    else:  # rows of several widths, which were packed apart
        ends = ragged.ends_of(n)[:-1]
        values = np.empty(int(n.sum()), np.int64)
        for bits in held.tolist():
            mine = np.flatnonzero((widths == bits) & (n > 0))
            values[ragged.ranges(ends[mine], n[mine])] = _values(n[mine], bits, cells.take(pa.array(mine)))
    mask = None
    if holes.null_count < len(holes):
        mask = np.zeros(len(values), bool)
        ends = ragged.ends_of(n)
        for i in np.flatnonzero(~ragged.nulls(holes)).tolist():
            mask[ends[i] : ends[i + 1]] = np.unpackbits(np.frombuffer(holes[i].as_py(), np.uint8))[: n[i]]
    return ragged.lists(n, pa.array(values.astype(kind.to_pandas_dtype(), copy=False), kind, mask=mask), ragged.nulls(rows))


def column(rows) -> Column:
    """A column of arrays of whole numbers, packed."""
    return ragged.column(pack, KIND, rows)


def streamed(rows: Column) -> Column:
    """:func:`column` behind a function of a stream of Arrow batches: run in the same pass, so its arrays never leave the worker."""

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                yield pack(batch)
        finally:
            trim_memory()

    return F.arrow_udf(work, KIND)(rows)


def first(rows: Column, count: Column) -> Column:
    """The first ``count`` values of every packed row, or all where there are fewer; null where either is null."""
    n, bits = F.greatest(F.lit(0), F.least(rows["n"], count)), rows["bits"]
    group = F.when(bits <= 16, 4).when(bits <= 32, 2).otherwise(1)
    size = (F.ceil(n / group) * (group * bits / 8)).cast("int")
    cells = rows["cells"].substr(F.lit(1), size)
    holes = rows["holes"].substr(F.lit(1), F.ceil(n / 8).cast("int"))
    cut = F.struct(n.cast("int").alias("n"), bits.alias("bits"), cells.alias("cells"), holes.alias("holes"))
    return F.when(rows.isNotNull() & count.isNotNull(), cut)
