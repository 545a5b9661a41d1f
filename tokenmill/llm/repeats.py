"""Super-windows: fixed windows of a sequence, compacted by their minimizers.

A window of ``width`` units (words or bytes) is an edge of the De Bruijn graph
whose nodes are the overlaps of neighbouring windows.  The k-gram of least
hash inside a window, its minimizer, depends on the window alone, so equal
windows share it; the windows of a document that follow each other with one
minimizer form a super-window, a path of the graph that is written as one row
(document, first window, number of windows, minimizer ``h``, content ``ctx``).
A document of n units has about ``2 n / (width - k + 2)`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.workers import trim_memory, trimmed
from tokenmill.llm.words import (
    Prefix,
    byte_prefix,
    mix,
    owner,
    pieces,
    ragged,
    signed,
    sliding_argmin,
    word_bounds,
    word_hashes,
)


PROBES = 6  # per minimizer, at most


@dataclass(frozen=True)
class Windows:
    """What a window is: ``width`` units, minimized over k-grams of ``k`` units."""

    width: int
    k: int
    words: bool

    def sequence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Prefix, np.ndarray]:
        """Hashes over the units of a piece, and the first unit of each row (with the end)."""
        if not self.words:
            return byte_prefix(data), offsets
        starts, ends, first = word_bounds(data, offsets)
        return Prefix(word_hashes(data, starts, ends), 1), first

    def super_windows(self, seq: Prefix, first: np.ndarray):
        """(row, first window in the piece, number of windows, minimizer, content, place of the minimizer)."""
        grams = seq.grams(self.k)
        least = sliding_argmin(grams, self.width - self.k + 1)
        counts = np.maximum(0, np.diff(first) - self.width + 1)
        if not counts.any():
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
        ends = first[:-1] + counts
        start = np.flatnonzero(least[1:] != least[:-1]) + 1
        own = owner(first, start)
        start = start[(start > first[own]) & (start < ends[own])]
        # no window goes on from one row to the next
        start = np.sort(np.concatenate([first[:-1][counts > 0], start]))
        anchor = least[start]
        n = np.minimum(np.append(start[1:], len(least)), ends[owner(first, start)]) - start
        ctx = seq.of(start, start + n - 1 + self.width)
        ctx = mix(ctx ^ ((anchor - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        return owner(first, start), start, n, mix(grams[anchor]), ctx, anchor

    def phrases(self, seq: Prefix, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Hash from each minimizer through the next one of its row; 0 at a row's last."""
        out = np.zeros(len(row), np.uint64)
        more = np.flatnonzero(row[1:] == row[:-1])
        out[more] = seq.of(anchor[more], anchor[more + 1] + self.k) | np.uint64(1)
        return out

    @property
    def step(self) -> int:
        """Windows whose minimizer lies at most this far apart in them share a probe."""
        return -(-(self.width - self.k + 1) // PROBES)

    def probes(self, seq: Prefix, start: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per super-window hashes of what all windows of one step around its minimizer have in common, and their number.

        Equal windows have equal probes, so a probe that occurs once tells of up to ``step`` windows that they do.
        """
        low = (anchor - start - n + 1) // self.step
        counts = (anchor - start) // self.step - low + 1
        q, at = ragged(low, counts), np.repeat(anchor, counts)
        last = np.minimum((q + 1) * self.step - 1, self.width - self.k)
        common = seq.of(at - q * self.step, at - last + self.width)
        return mix(common ^ ((q + 1).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))), counts


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text): fp tells apart repeated ids with other texts."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"), "text")


class Bloom:
    """A bounded set of hashes with false positives (at most ``MOST_SLOTS`` words of 64 bits)."""

    LEAST_SLOTS, MOST_SLOTS = 1 << 14, 1 << 20

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @staticmethod
    def of(df: DataFrame, column: str, rows: int) -> Bloom:
        size = Bloom.LEAST_SLOTS
        while size < Bloom.MOST_SLOTS and size * 5 < rows:
            size *= 2
        h = F.col(column)

        def bit(shift):
            return F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {shift}) & 63 as int))")

        got = (
            df.select((h.bitwiseAND(F.lit(size - 1))).cast("int").alias("slot"), bit(32).bitwiseOR(bit(44)).alias("mask"))
            .groupBy("slot")
            .agg(F.bit_or("mask").alias("mask"))
            .toArrow()
        )
        slots = np.zeros(size, np.int64)
        slots[got.column("slot").to_numpy()] = got.column("mask").to_numpy()
        return Bloom(slots.view(np.uint64))

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        held = self.slots[(h & np.uint64(len(self.slots) - 1)).astype(np.int64)]
        one = np.uint64(1)
        mask = (one << ((h >> np.uint64(32)) & np.uint64(63))) | (one << ((h >> np.uint64(44)) & np.uint64(63)))
        return (held & mask) == mask

    def test(self, column: str):
        """Whether the set may hold the values of a bigint column, as a boolean column."""

        def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for values in batches:
                yield pa.array(self.may_hold(values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            trim_memory()

        return F.arrow_udf(held, "boolean")(F.col(column))


def super_window_rows(docs: DataFrame, spec: Windows, bloom: Bloom | None = None, phrases: bool = False) -> DataFrame:
    """(doc_id, fp, text) to (doc_id, fp, start, n, h, ctx); ``bloom`` leaves out minimizers that it does not hold.

    With ``phrases`` also the minimizer's place, the phrase from it to the next one, and the probes.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps = batch.column("doc_id"), batch.column("fp")
            for row0, _, data, offsets in pieces(batch.column("text")):
                seq, first = spec.sequence(data, offsets)
                row, start, n, h, ctx, anchor = spec.super_windows(seq, first)
                more = [anchor, spec.phrases(seq, row, anchor)] if phrases else []
                if bloom is not None:
                    keep = np.flatnonzero(bloom.may_hold(h))
                    row, start, n, h, ctx, *more = (v[keep] for v in (row, start, n, h, ctx, *more))
                take = pa.array(row + row0)
                extra = []
                if phrases:
                    probes, counts = spec.probes(seq, start, n, more[0])
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    extra = [pa.array((more[0] - first[row]).astype(np.int32)), signed(more[1])]
                    # half of a probe will do: it is compared among stretches of one minimizer
                    extra.append(pa.ListArray.from_arrays(ends, pa.array((probes >> np.uint64(32)).astype(np.uint32).view(np.int32))))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take),
                        fps.take(take),
                        pa.array((start - first[row]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        signed(h),
                        signed(ctx),
                        *extra,
                    ],
                    ["doc_id", "fp", "start", "n", "h", "ctx", *(["anchor", "phrase", "probes"] if phrases else [])],
                )

    schema = f"doc_id {kind}, fp bigint, start int, n int, h bigint, ctx bigint"
    return docs.mapInArrow(trimmed(work), schema + (", anchor int, phrase bigint, probes array<int>" if phrases else ""))


def window_rows(docs: DataFrame, wanted: DataFrame, spec: Windows, carry: tuple[str, ...] = ()) -> DataFrame:
    """Hashes of single windows: (doc_id, h, ctx, wins) for the windows in ``wanted`` (doc_id, fp, start, n, h, ctx).

    Columns of ``wanted`` named in ``carry`` (bigint) are kept.
    """
    kind = dict(docs.dtypes)["doc_id"]
    asked = wanted.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("start", "n", "h", "ctx", *carry)).alias("asked"))
    rows = docs.join(asked, ["doc_id", "fp"]).dropDuplicates(["doc_id", "fp"]).select("doc_id", "text", "asked")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            for row0, end, data, offsets in pieces(batch.column("text")):
                seq, first = spec.sequence(data, offsets)
                part = asked.slice(row0, end - row0)
                items = part.flatten()
                row = np.repeat(np.arange(end - row0), part.value_lengths().to_numpy())
                start, n = (items.field(f).to_numpy().astype(np.int64) for f in ("start", "n"))
                a = ragged(start + first[row], n)
                wins = seq.of(a, a + spec.width)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row + row0)),
                        items.field("h"),
                        items.field("ctx"),
                        pa.ListArray.from_arrays(ends, signed(wins)),
                        *(items.field(c) for c in carry),
                    ],
                    ["doc_id", "h", "ctx", "wins", *carry],
                )

    kept = "".join(f", {c} bigint" for c in carry)
    return rows.mapInArrow(trimmed(work), f"doc_id {kind}, h bigint, ctx bigint, wins array<bigint>{kept}")


def merge_spans(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans, as maximal runs in order."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return a[first], b[np.concatenate([first[1:], [len(a)]]) - 1]
