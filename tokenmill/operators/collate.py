"""Collated training batches: one ragged row per token-budget batch (A4 with W4, P17 and P18).

Batch ids are dense, so a batch's range is known without sampling: batches are
dealt to ``parts`` contiguous ranges of ids by one exchange, sorted inside
(batch, longest source first, key), and one Arrow pass turns the rows of a
batch into flat values with offsets.  Arrays cross the exchange and are sorted
packed (``functions.packed``), and are unpacked some rows at a time.

A collated row holds, for its ``nsentences`` samples in batch order,

* ``keys``, ``src_texts``, ``src_lengths``, ``target_lengths``;
* ``src_tokens``, the interleaved input, flat (position-major, ``depth`` codes
  a position), with ``src_offsets``, the first position of every sample and the end;
* ``target`` (also the previous output tokens) with ``target_offsets``, likewise;
* ``src_labels`` with ``label_offsets``;
* ``ntokens`` (target rows), ``padded_length`` and ``padded_target``, the
  lengths that padding would bring the samples to, and ``n_kept``, the target
  rows with any code that is not pad.

``dense`` gives the padded array of one of them.  A batch has at most
``max_tokens`` tokens and rows, so one row per batch is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import constants as K, packed, ragged
from tokenmill.functions.numeric import round_half_up
from tokenmill.functions.workers import trimmed

SCHEMA = (
    "batch_id bigint, nsentences int, ntokens bigint, depth int, keys array<string>, src_texts array<string>, "
    "src_lengths array<int>, target_lengths array<int>, src_offsets array<int>, src_tokens array<int>, "
    "target_offsets array<int>, target array<int>, label_offsets array<int>, src_labels array<int>, "
    "padded_length int, padded_target int, n_kept bigint"
)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's values start (with the end)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _lists(values, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind) if not isinstance(values, pa.Array) else values)


def _interleaved(labels: pa.Array, target: pa.Array, depth: int) -> pa.Array:
    """P16 and P17 of labels and flat target rows, flat."""
    frames = ragged.sizes(target) // depth
    codes = ragged.lists(np.full(int(frames.sum()), depth), target.flatten())
    interleave = ragged.interleaved_rows(depth, K.SOURCE_DICT_LEN, K.EOS, K.PAD)
    return ragged.flat_ints(interleave(ragged.tiled_rows(depth, K.PAD)(labels), ragged.lists(frames, codes, ragged.nulls(target))))


def collate_table(rows: pa.Table | pa.RecordBatch, depth: int) -> pa.RecordBatch:
    """Whole batches, sorted, to one row each."""
    columns = {n: rows.column(n) for n in rows.schema.names}
    columns = {n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for n, c in columns.items()}
    if "src_text" not in columns:  # texts are cheap to spell where they are used, and are not moved
        columns["src_text"] = ragged.spelled(K.NSPECIAL)(columns["src_labels"])
    if "src_tokens" not in columns:  # nor is the input, which follows from labels and target
        columns["src_tokens"] = _interleaved(columns["src_labels"], columns["target"], depth)
    batch = columns["batch_id"].to_numpy()
    first = np.flatnonzero(np.diff(batch, prepend=batch[0] - 1))
    bounds = np.append(first, len(batch))
    sizes = np.diff(bounds)
    out: dict[str, pa.Array] = {
        "batch_id": pa.array(batch[first], pa.int64()),
        "nsentences": pa.array(sizes, pa.int32()),
        "depth": pa.array(np.full(len(first), depth), pa.int32()),
    }
    for name, source in (("keys", "key"), ("src_texts", "src_text")):
        out[name] = _lists(columns[source].cast(pa.string()), bounds, pa.string())
    lengths = {}
    for name in ("src_length", "target_length"):
        lengths[name] = columns[name].to_numpy().astype(np.int64)
        out[name + "s"] = _lists(lengths[name], bounds, pa.int32())
    group = np.repeat(np.arange(len(first)), sizes)
    # offsets of a batch: one for each of its rows, and its end
    slots = bounds + np.arange(len(bounds))
    row_slot = np.arange(len(batch)) + group
    longest = {}
    for values_name, offsets_name, width in (
        ("src_tokens", "src_offsets", depth), ("target", "target_offsets", depth), ("src_labels", "label_offsets", 1)
    ):
        values, starts = _flat(columns[values_name])
        out[values_name] = _lists(values.astype(np.int32, copy=False), starts[bounds], pa.int32())
        positions = starts // width
        offsets = np.zeros(len(batch) + len(first), np.int64)
        offsets[row_slot + 1] = positions[1:] - positions[bounds[:-1]][group]
        out[offsets_name] = _lists(offsets, slots, pa.int32())
        longest[values_name] = np.maximum.reduceat(np.diff(positions), first)
    out["ntokens"] = pa.array(np.add.reduceat(lengths["target_length"], first), pa.int64())
    out["padded_length"] = pa.array(longest["src_tokens"], pa.int32())
    out["padded_target"] = pa.array(longest["target"], pa.int32())
    codes, starts = _flat(columns["target"])
    kept = np.concatenate([[0], np.cumsum((codes.reshape(-1, depth) != K.PAD).any(axis=1))])
    out["n_kept"] = pa.array(np.diff(kept[starts[bounds] // depth]), pa.int64())
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([out[n] for n in names], names)


def _is_packed(rows: DataFrame, column: str) -> bool:
    return rows.schema[column].dataType.simpleString() == packed.KIND


def _packed_codes(rows: DataFrame, column: str) -> Column:
    """Codes of ``[position][code]``, flat and packed."""
    if _is_packed(rows, column):
        return F.col(column)
    return ragged.column(lambda codes: packed.pack(ragged.flat_ints(codes)), packed.KIND, column)


def _packed_ids(rows: DataFrame, column: str) -> Column:
    return F.col(column) if _is_packed(rows, column) else packed.column(F.col(column).cast("array<int>"))


def _unpacked(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their arrays, of a bounded number of values at a time."""
    for rows in arrow:
        names = [n for n in ("src_tokens", "target", "src_labels") if n in rows.schema.names]
        for start, stop in ragged.parts(sum(packed.sizes(rows.column(n)) for n in names), packed.VALUES):
            part = rows.slice(start, stop - start)
            columns = [packed.unpack(part.column(n), pa.int32()) if n in names else part.column(n) for n in part.schema.names]
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)


def collate(rows: DataFrame, depth: int, batches: int, batch_col: str = "batch_id", key: str = "key", parts: int | None = None) -> DataFrame:
    """Rows with a batch id (``0 .. batches - 1``) to one row per batch.

    Expects ``src_tokens`` and ``target`` ([position][code]), ``src_labels``,
    ``src_length`` and ``target_length``; the arrays may come packed, with codes
    flat.  Rows without ``src_tokens`` get them
    (P17 of labels and target) where they are collated.  ``parts`` ranges of batch ids are
    written in order, one task each, and so can be read in order.
    """
    spark = rows.sparkSession
    parts = max(1, min(batches, parts or int(spark.conf.get("spark.sql.shuffle.partitions"))))

    flat = rows.select(
        F.col(batch_col).cast("bigint").alias("batch_id"),
        F.col(key).cast("string").alias("key"),
        F.col("src_length").cast("int").alias("src_length"),
        F.col("target_length").cast("int").alias("target_length"),
        *[_packed_codes(rows, c).alias(c) for c in ("src_tokens", "target") if c in rows.columns],
        _packed_ids(rows, "src_labels").alias("src_labels"),
    )
    place = F.expr(f"cast(batch_id * {parts} div {max(1, batches)} as int)")
    clustered = flat.repartitionById(parts, place).sortWithinPartitions("batch_id", F.col("src_length").desc(), "key")

    def work(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the batch that is still open
        for rows in _unpacked(arrow):
            ids = rows.column("batch_id").to_numpy()
            last = int(np.searchsorted(ids, ids[-1]))
            if last or (held and held[0].column("batch_id")[0].as_py() != ids[0]):
                whole = pa.Table.from_batches([*held, rows.slice(0, last)])
                if whole.num_rows:
                    yield collate_table(whole, depth)
                held = []
            held.append(rows.slice(last))
        if held:
            yield collate_table(pa.Table.from_batches(held), depth)

    return clustered.mapInArrow(trimmed(work), SCHEMA)


def collated_stats(collated: DataFrame) -> DataFrame:
    """A4: counts, tokens and padding of each batch, from its offsets alone."""
    cells = F.element_at("src_offsets", -1).cast("bigint")
    return collated.select(
        "batch_id",
        F.col("nsentences").cast("bigint").alias("nsentences"),
        "ntokens",
        F.array_max("src_lengths").alias("max_src_length"),
        "padded_length",
        cells.alias("real_cells"),
        round_half_up(1 - cells / (F.col("nsentences") * F.col("padded_length")), 6).alias("padding_ratio"),
    )


def frame_mask(collated: DataFrame) -> DataFrame:
    """P21 counts: frames of the padded target, and those with any code that is not pad."""
    frames = F.col("nsentences").cast("bigint") * F.col("padded_target")
    return collated.select("batch_id", frames.alias("n_frames"), "n_kept")


def kept_frames(collated: DataFrame, pad: int = K.PAD) -> DataFrame:
    """The kept frames of every batch, flattened: ``(batch_id, flat, key, frame, codes)``.

    ``flat`` counts the kept frames of a batch in order (sample, then frame):
    the place of the frame in the masked, flattened target.
    """

    def work(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow:
            depths = rows.column("depth").to_numpy()
            for i in range(rows.num_rows):
                codes = rows.column("target")[i].values.to_numpy(zero_copy_only=False).reshape(-1, int(depths[i]))
                offsets = rows.column("target_offsets")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                kept = np.flatnonzero((codes != pad).any(axis=1))
                sample = np.searchsorted(offsets, kept, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(kept), rows.column("batch_id")[i].as_py(), np.int64)),
                        pa.array(np.arange(len(kept), dtype=np.int64)),
                        rows.column("keys")[i].values.take(pa.array(sample)),
                        pa.array((kept - offsets[sample]).astype(np.int32)),
                        _lists(codes[kept].ravel(), np.arange(len(kept) + 1) * int(depths[i]), pa.int32()),
                    ],
                    ["batch_id", "flat", "key", "frame", "codes"],
                )

    narrow = collated.select("batch_id", "depth", "keys", "target_offsets", "target")
    return narrow.mapInArrow(work, "batch_id bigint, flat bigint, key string, frame int, codes array<int>")


def dense(values, offsets, depth: int = 1, pad: int = K.PAD) -> np.ndarray:
    """The padded array ``[sample][position][code]`` (``[sample][position]`` for depth 1) of one ragged field."""
    offsets = np.asarray(offsets, np.int64)
    lengths = np.diff(offsets)
    out = np.full((len(lengths), int(lengths.max(initial=0)), depth), pad, np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.asarray(values, np.int64).reshape(-1, depth)
    return out[:, :, 0] if depth == 1 else out
