"""Per-row work on arrays, an Arrow batch at a time: the functions behind the array operators.

Rows are Arrow list arrays; a null row, a null list inside it and a null value
stay null unless said otherwise.  A column function of one array (``column``)
that is applied to another is run in the same pass, so the arrays between
them never leave the worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def column(work, kind: str, *columns) -> Column:
    """``work`` of Arrow arrays as a column of type ``kind``."""
    return F.arrow_udf(work, kind)(*[F.col(c) if isinstance(c, str) else c for c in columns])


def sizes(rows: pa.Array) -> np.ndarray:
    """Values of every row; none of a null row."""
    return pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ends_of(counts: np.ndarray) -> np.ndarray:
    """0 and the running sums of ``counts``."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``counts[i]`` of them, for every i."""
    return np.arange(counts.sum()) + np.repeat(starts - ends_of(counts)[:-1], counts)


def lists(counts: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.ListArray:
    """A list array of ``counts`` values a row, null where ``null`` is true (there are no values there)."""
    mask = pa.array(null) if null is not None and null.any() else None
    return pa.ListArray.from_arrays(pa.array(ends_of(counts), pa.int32()), values, mask=mask)


def nulls(*arrays: pa.Array) -> np.ndarray:
    """Where any of the arrays is null."""
    out = np.zeros(len(arrays[0]), bool)
    for a in arrays:
        if a.null_count:
            out |= a.is_null().to_numpy(zero_copy_only=False)
    return out


def ints(values: pa.Array) -> np.ndarray:
    """Whole numbers as longs, 0 for null."""
    return pc.fill_null(values.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def numbers(values: np.ndarray, like: pa.Array) -> pa.Array:
    """``values`` as longs, null where ``like`` is."""
    return pa.array(values, pa.int64(), mask=nulls(like) if like.null_count else None)


def flattened(rows: pa.Array) -> pa.Array:
    """Rows of lists to rows of their values; a row with a null list is null (as of ``flatten``)."""
    inner, n = rows.flatten(), sizes(rows)
    held, null = sizes(inner), nulls(rows)
    ends = ends_of(n)
    if inner.null_count:
        holes = ends_of(nulls(inner))
        null |= holes[ends[1:]] > holes[ends[:-1]]
        held = np.where(np.repeat(null, n), 0, held)
        inner = inner.filter(pa.array(~np.repeat(null, n)))
    cells = ends_of(held)[ends]
    return lists(np.diff(cells), inner.flatten(), null)


def flat_ints(rows: pa.Array) -> pa.Array:
    """The values of rows of lists as rows of ints."""
    return flattened(rows).cast(pa.list_(pa.int32()))


#: so many values are looked at at a time (a row at least)
VALUES = 1 << 18


def parts(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Rows ``start`` to ``stop`` in order, of at most ``limit`` of ``counts`` together, or one row."""
    ends, start = np.cumsum(np.maximum(counts, 1)), 0
    while start < len(counts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def digests(rows: pa.Array) -> pa.Array:
    """``sum(x * (i + 1))`` of every row, of lists one behind another; 0 for a null row and one that holds a null."""
    out = [_digests(rows.slice(a, b - a), a) for a, b in parts(sizes(rows), VALUES)]
    return pa.concat_arrays(out) if out else pa.array([], pa.int64())


def _digests(rows: pa.Array, start: int) -> pa.Array:
    while pa.types.is_list(rows.type.value_type):
        rows = flattened(rows)
    n, values = sizes(rows), rows.flatten()
    ends, x = ends_of(n), ints(values)
    place = ranges(np.ones(len(n), np.int64), n)
    total = ends_of(x * place)  # a sum that fits is right whatever wraps around before it
    out = total[ends[1:]] - total[ends[:-1]]
    most = int(n.max(initial=0))
    if len(x) and max(-int(x.min()), int(x.max())) * most * (most + 1) // 2 > MOST:
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            whole = sum(v * (k + 1) for k, v in enumerate(x[a:b].tolist()))
            if not LEAST <= whole <= MOST:
                raise OverflowError(f"the digest of row {start + i} exceeds a long")
    if values.null_count:
        holes = ends_of(nulls(values))
        out[holes[ends[1:]] > holes[ends[:-1]]] = 0
    return pa.array(out, pa.int64())


def sized_digests(rows: pa.Array) -> pa.Array:
    """(n, digest) of every row: its size (null of a null row) and its digest."""
    return pa.StructArray.from_arrays([pc.list_value_length(rows).cast(pa.int32()), digests(rows)], ["n", "digest"])


def deduped(rows: pa.Array) -> pa.Array:
    """Runs of equal whole numbers to one; a null behind a value goes, as it differs from nothing."""
    n, values = sizes(rows), rows.flatten()
    x, keep = ints(values), np.ones(len(values), bool)
    keep[1:] = x[1:] != x[:-1]
    if values.null_count:
        held = ~nulls(values)
        keep[1:] = ~held[:-1] | (held[1:] & keep[1:])
    keep[ends_of(n)[:-1][n > 0]] = True
    kept = ends_of(keep)[ends_of(n)]
    return lists(np.diff(kept), values.filter(pa.array(keep)), nulls(rows))


def first_values(rows: pa.Array) -> pa.Array:
    """The first value of every list of a row; null for a null or empty list."""
    inner = rows.flatten()
    held = sizes(inner)
    at = pa.array(ends_of(held)[:-1], pa.int64(), mask=held == 0)
    return lists(sizes(rows), inner.flatten().take(at), nulls(rows))


# --- rows of codes and language-model rows -------------------------------------


def code_rows(keep: int):
    """(flat codebook-major tokens, codebook length, first frame, frames) to ``[frame][code]`` of ``keep`` codebooks."""

    def work(tokens: pa.Array, length: pa.Array, start: pa.Array, frames: pa.Array) -> pa.Array:
        null = nulls(tokens, length, start, frames)
        n = np.where(null, 0, np.maximum(ints(frames), 0))
        first = ends_of(sizes(tokens))[:-1] + ints(start)
        at = ranges(first, n)[:, None] + np.repeat(ints(length), n)[:, None] * np.arange(keep)
        cells = tokens.flatten().take(pa.array(at.ravel()))
        return lists(n, lists(np.full(len(at), keep), cells), null)

    return work


def unit_rows(nspecial: int, eos: int):
    """Units of a row, shifted behind the special ids, and an eos."""

    def work(units: pa.Array) -> pa.Array:
        n, values, null = sizes(units), units.flatten(), nulls(units)
        m = np.where(null, 0, n + 1)
        ends = ends_of(m)[1:][~null] - 1
        cells = pa.concat_arrays([numbers(ints(values) + nspecial, values), pa.array([eos], pa.int64())])
        at = np.full(int(m.sum()), len(values), np.int64)
        body = np.ones(len(at), bool)
        body[ends] = False
        at[body] = np.arange(len(values))
        return lists(m, cells.take(pa.array(at)), null)

    return work


def target_rows(depth: int, codec_dim: int, nspecial: int, eos: int):
    """Codes of ``[frame][code]``, each codebook in a range of its own, and a frame of eos."""

    def work(codes: pa.Array) -> pa.Array:
        n, inner, null = sizes(codes), codes.flatten(), nulls(codes)
        held, values = sizes(inner), inner.flatten()
        book = ranges(np.zeros(len(held), np.int64), held)
        shifted = lists(held, numbers(ints(values) + book * codec_dim + nspecial, values), nulls(inner))
        frames = pa.concat_arrays([shifted, lists(np.array([depth]), pa.array([eos] * depth, pa.int64()))])
        m = np.where(null, 0, n + 1)
        at = np.full(int(m.sum()), len(inner), np.int64)
        body = np.ones(len(at), bool)
        body[ends_of(m)[1:][~null] - 1] = False
        at[body] = np.arange(len(inner))
        return lists(m, frames.take(pa.array(at)), null)

    return work


def tiled_rows(depth: int, pad: int):
    """``[position]`` to ``[position][depth]``, pad behind the first column."""

    def work(source: pa.Array) -> pa.Array:
        values = source.flatten()
        cells = np.full((len(values), depth), pad, np.int64)
        cells[:, 0] = ints(values)
        mask = None
        if values.null_count:
            mask = np.zeros(cells.shape, bool)
            mask[:, 0] = nulls(values)
        flat = pa.array(cells.ravel(), pa.int64(), mask=None if mask is None else mask.ravel())
        return lists(sizes(source), lists(np.full(len(cells), depth), flat), nulls(source))

    return work


def interleaved_rows(depth: int, shift: int, eos: int, pad: int):
    """``[eos, pad..] + source[:-1] + (target[-1] + shift) + (target[:-1] + shift)`` of every row."""

    def work(source: pa.Array, target: pa.Array) -> pa.Array:
        null = nulls(source, target)
        ns, nt = sizes(source), sizes(target)
        if (~null & ((ns == 0) | (nt == 0))).any():
            raise ValueError("a source and a target end with eos: neither is empty")
        s_inner, t_inner = source.flatten(), target.flatten()
        held, values = sizes(t_inner), t_inner.flatten()
        shifted = lists(held, numbers(ints(values) + shift, values), nulls(t_inner))
        first = lists(np.array([depth]), pa.array([eos] + [pad] * (depth - 1), pa.int64()))
        frames = pa.concat_arrays([first, s_inner.cast(pa.list_(pa.int64())), shifted])
        s0 = 1 + ends_of(ns)[:-1]
        t0 = 1 + len(s_inner) + ends_of(nt)[:-1]
        # four pieces a row: the first frame, the source but its last, the target's last, the target but its last
        starts = np.stack([np.zeros(len(ns), np.int64), s0, t0 + nt - 1, t0], axis=1)
        counts = np.stack([np.ones(len(ns), np.int64), ns - 1, np.ones(len(ns), np.int64), nt - 1], axis=1)
        counts[null] = 0
        at = ranges(starts.ravel(), counts.ravel())
        return lists(counts.sum(axis=1), frames.take(pa.array(at)), null)

    return work


def spelled(nspecial: int):
    """Ids to space-joined symbols: special ids and nulls dropped, the symbol of id i is ``str(i - nspecial)``."""

    def work(ids: pa.Array) -> pa.Array:
        n, values = sizes(ids), ids.flatten()
        x = ints(values)
        keep = (x >= nspecial) & ~nulls(values)
        symbols = pa.array(x[keep] - nspecial).cast(pa.string())
        kept = ends_of(keep)[ends_of(n)]
        return pc.binary_join(lists(np.diff(kept), symbols, nulls(ids)), " ")

    return work
