"""Vectorised work on the bytes of whole Arrow text columns.

A *piece* is a run of consecutive rows of one Arrow batch holding a few MB of
text (a single longer text is a piece of its own), so that numpy temporaries
stay bounded whatever the batch size is.  Sequences are hashed with prefix
sums: ``P[i] = sum(v[j] * B**j for j < i)`` modulo 2**64, and the hash of
``[a, b)`` is ``(P[b] - P[a]) * B**-a``, finalised by a mixer.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tokenmill.functions.workers import trim_memory

#: Some dozens of 8-byte temporaries per byte live while a piece is worked on.
PIECE_BYTES = 1 << 19
PIECE_ROWS = 8192
KEPT_POWERS = 1 << 21
TRIM_BYTES = 8 << 20
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
#: Two independent odd bases.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` for ``i <= n``; kept per worker, grown by doubling."""
    got = _POWERS.get(which)
    if got is None or len(got[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        pair = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            done, step = 1, base
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(step)
                step = step * step % (1 << 64)
                done *= 2
            pair.append(out)
        got = (pair[0], pair[1])
        if size > KEPT_POWERS:  # a very long text: not kept
            return got
        _POWERS[which] = got
    return got


#: Caches that an operator keeps in its workers from batch to batch.
_CACHES: dict[str, dict] = {"powers": _POWERS}
_IN_USE = [""]


def keep_in_worker(operator: str, cache: dict) -> dict:
    """Register a cache that lives while its operator is the one that reads texts in this worker."""
    _CACHES[operator] = cache
    return cache


def _enter(operator: str) -> None:
    """Workers outlive stages: when another operator begins, drop what the last one kept."""
    if _IN_USE[0] != operator:
        _IN_USE[0] = operator
        for name, cache in _CACHES.items():
            if name != operator:
                cache.clear()
        gc.collect()
        trim_memory()


class Prefix:
    """Hashes of any ``[a, b)`` of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self._down = _powers(len(values), which)
        self._sum = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sum[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raw = (self._sum[b] - self._sum[a]) * self._down[a]
        return mix(raw ^ ((np.asarray(b) - np.asarray(a)).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all ``k`` consecutive values (empty if there are fewer)."""
        n = len(self._sum) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        raw = self._sum[k:] - self._sum[: n - k + 1]
        raw *= self._down[: n - k + 1]
        raw ^= np.uint64(k * 0xA24BAED4963EE407 % (1 << 64))
        return mix(raw)


def _plain(array) -> pa.Array:
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_string())
    return pc.fill_null(array.cast(pa.large_string()), "")


def pieces(texts, limit: int = PIECE_BYTES, operator: str = "powers") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, bytes, offsets)``; null counts as empty.

    ``operator`` names the cache (see ``keep_in_worker``) that the caller uses.
    """
    _enter(operator)
    texts = _plain(texts)
    n = len(texts)
    if n == 0:
        return
    _, offsets_buffer, data = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, row + PIECE_ROWS, max(row + 1, end))
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    if offsets[n] - offsets[0] >= TRIM_BYTES:
        trim_memory()  # workers live on into other stages


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return _IS_WORD[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each row (with the end)."""
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[offsets <= len(data)]] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edge[:-1]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return Prefix(_BYTE_VALUE[data], which).of(starts, ends)


def byte_prefix(data: np.ndarray, which: int = 0) -> Prefix:
    return Prefix(_BYTE_VALUE[data], which)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def owner(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that holds each position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def runs_of(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    if not len(marks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(marks.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sliding_argmin(order: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the leftmost position of its least 32 high bits.

    Each result depends on the window's own values alone, so equal windows
    choose equal places wherever they stand.
    """
    n = len(order)
    if n < width:
        return np.zeros(0, np.int64)
    blocks = -(-n // width)
    padded = np.empty(blocks * width, np.uint64)
    np.bitwise_and(order, np.uint64(0xFFFFFFFF00000000), out=padded[:n])
    padded[:n] |= np.arange(n, dtype=np.uint64)
    padded[n:] = np.uint64(0xFFFFFFFFFFFFFFFF)
    grid = padded.reshape(blocks, width)
    right = np.empty_like(grid)
    np.minimum.accumulate(grid[:, ::-1], axis=1, out=right[:, ::-1])
    left = np.minimum.accumulate(grid, axis=1, out=grid).ravel()
    least = np.minimum(right.ravel()[: n - width + 1], left[width - 1 : n])
    least &= np.uint64(0xFFFFFFFF)
    return least.view(np.int64)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as the longs that Spark holds."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i] + 0 .. counts[i] - 1`` for all i, one after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift
