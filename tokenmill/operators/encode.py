"""Encode jobs (D1) with per-row failure quarantine.

An encoder is a factory ``() -> fn`` where ``fn(waveforms, sample_rates)``
returns ``{"tokens": [...]}`` with one ``[L]`` (semantic) or ``[n_q, L]``
(acoustic) array per input.  The factory runs once per task, before the
first batch (the model is loaded once per process, not per row).  All
encoders run on the same Arrow batch, so every stream is produced in one
pass over the clips.  Fixed-length pieces are stacked into rectangular
micro-batches of at most ``micro_batch`` rows; ragged pieces go one by one.
A failing micro-batch is retried row by row, and rows that still fail are
emitted with their error instead of being lost with the batch.  Results leave
a task some MB at a time, so its memory does not grow with an Arrow batch.
"""

from __future__ import annotations

from collections import Counter
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import constants as K

OUT_SCHEMA = "key string, stream string, depth int, len int, tokens array<bigint>, error string"

EncoderFactory = Callable[[], Callable]


#: Results of this many bytes are handed on at once, however many rows an Arrow batch has.
OUT_BYTES = 4 << 20


def _rows_of(stream: str, keys, toks) -> list[tuple]:
    out = []
    for key, t in zip(keys, toks):
        a = np.asarray(t, dtype=np.int64)
        if a.ndim == 1:
            out.append((key, stream, 1, int(a.shape[0]), a, None))
        else:
            out.append((key, stream, int(a.shape[0]), int(a.shape[-1]), a.reshape(-1), None))
    return out


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of scalars and flat int64 arrays as Arrow: arrays are joined once, not boxed."""
    columns = []
    for field, values in zip(schema, zip(*rows)):
        if pa.types.is_list(field.type):
            sizes = [0 if v is None else len(v) for v in values]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *[v for v in values if v is not None]])
            nulls = pa.array([v is None for v in values])
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()), mask=nulls))
        else:
            columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def encode_job(
    pieces: DataFrame,
    encoders: dict[str, EncoderFactory],
    key: str = "chunk_key",
    samples: str = "samples",
    sr: str = "sr",
    is_chunked: str = "is_chunked",
    micro_batch: int = K.ENCODER_MICRO_BATCH,
    paired: tuple[str, str] | None = None,
    carry: list[str] | None = None,
    reason: str | None = None,
) -> DataFrame:
    """D1 + P9: run every encoder over every piece -> ``(key, stream, depth, len, tokens, error)``.

    With ``paired=(semantic, acoustic)`` each piece instead yields one row
    ``(key, len_sem, units, depth, len_ac, tokens, error)``: the pairing join
    (J1) of the two streams becomes a projection, with no shuffle.
    ``carry`` names columns passed through (as strings) to every output row,
    e.g. the clip's split.  ``reason`` names a column that says why a row is
    not to be encoded: such a row gives one row of stream ``decode`` with that
    error (long form only), so one pass yields the tokens and the whole report.
    """
    names = list(encoders)
    if paired and set(names) != set(paired):
        raise ValueError(f"paired={paired} takes exactly these two encoders, not {names}")
    if paired and reason:
        raise ValueError("rows that are not encoded are reported in the long form only")
    carry = list(carry or [])

    types = (PAIRED_TYPES if paired else OUT_TYPES) + [(c, pa.string()) for c in carry]
    arrow = pa.schema(types)

    def encoded(models: dict, batch: pa.RecordBatch, rows: list[int], columns: dict) -> list[tuple]:
        """The long rows of one micro-batch; if an encoder fails on it, row by row."""
        keys = [columns["key"][i] for i in rows]
        waves = [np.asarray(batch.column("samples")[i].values, dtype=np.float32) for i in rows]
        if len(waves) > 1:
            waves = list(np.stack(waves))
        rates = [columns["sr"][i] for i in rows]
        out: list[tuple] = []
        for n in names:
            try:
                out += _rows_of(n, keys, models[n](waves, rates)["tokens"])
            except Exception:
                for k1, w1, r1 in zip(keys, waves, rates):
                    try:
                        out += _rows_of(n, [k1], models[n]([w1], [r1])["tokens"])
                    except Exception as e:  # quarantined, the run continues
                        out.append((k1, n, None, None, None, f"{type(e).__name__}: {e}"))
        return out

    def micro_batches(columns: dict) -> Iterator[list[int]]:
        """Places of the rows that are encoded together, fixed pieces first.

        In the paired form rows that repeat a key of their batch come together
        at the end, as they give one row.
        """
        keys, chunked = columns["key"], columns["is_chunked"]
        kept = [i for i in range(len(keys)) if not reason or columns["__reason"][i] is None]
        times = Counter(keys[i] for i in kept) if paired else {}
        for fixed in (True, False):
            part = [i for i in kept if chunked[i] is fixed and times.get(keys[i], 1) == 1]
            step = micro_batch if fixed else 1
            for s in range(0, len(part), step):
                yield part[s : s + step]
        again: dict = {}
        for i in kept:
            if times.get(keys[i], 1) > 1 and chunked[i] is not None:
                again.setdefault(keys[i], []).append(i)
        for rows in again.values():
            yield sorted(rows, key=lambda i: not chunked[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {n: encoders[n]() for n in names}  # once per task
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "samples"}
            extra = {}
            for i, k in enumerate(columns["key"]):  # of rows that share a key, those to encode come first
                if carry and (k not in extra or (reason and columns["__reason"][extra[k]] is not None and columns["__reason"][i] is None)):
                    extra[k] = i

            def finished(rows: list[tuple]) -> pa.RecordBatch:
                return _record_batch([(*r, *(columns[c][extra[r[0]]] for c in carry)) for r in rows], arrow)

            held: list[tuple] = []
            if reason:
                held += [(k, "decode", None, None, None, r) for k, r in zip(columns["key"], columns["__reason"]) if r is not None]
            size = 0
            for rows in micro_batches(columns):
                if paired and len(rows) > 1 and columns["key"][rows[0]] == columns["key"][rows[1]]:
                    long = [r for i in rows for r in encoded(models, batch, [i], columns)]
                else:
                    long = encoded(models, batch, rows, columns)
                size += sum(r[4].nbytes for r in long if r[4] is not None)
                held += _pair(long, *paired) if paired else long
                if size >= OUT_BYTES:
                    yield finished(held)
                    held, size = [], 0
            if held:
                yield finished(held)

    staged = pieces.select(
        F.col(key).alias("key"),
        F.col(samples).alias("samples"),
        F.col(sr).alias("sr"),
        F.col(is_chunked).alias("is_chunked"),
        *[F.col(c).cast("string").alias(c) for c in carry],
        *([F.col(reason).alias("__reason")] if reason else []),
    )
    schema = (PAIRED_SCHEMA if paired else OUT_SCHEMA) + "".join(f", {c} string" for c in carry)
    return staged.mapInArrow(run, schema)


PAIRED_SCHEMA = "key string, len_sem int, units array<bigint>, depth int, len_ac int, tokens array<bigint>, error string"


OUT_TYPES = [
    ("key", pa.string()), ("stream", pa.string()), ("depth", pa.int32()), ("len", pa.int32()),
    ("tokens", pa.list_(pa.int64())), ("error", pa.string()),
]
PAIRED_TYPES = [
    ("key", pa.string()), ("len_sem", pa.int32()), ("units", pa.list_(pa.int64())), ("depth", pa.int32()),
    ("len_ac", pa.int32()), ("tokens", pa.list_(pa.int64())), ("error", pa.string()),
]


def _pair(long: list[tuple], semantic: str, acoustic: str) -> list[tuple]:
    """Fold the per-stream rows of some pieces into one row per key."""
    rows: dict = {}
    for key, stream, depth, length, tokens, error in long:
        r = rows.setdefault(key, {"key": key, "len_sem": None, "units": None, "depth": None, "len_ac": None, "tokens": None, "error": None})
        if error is not None:
            r["error"] = f"{stream}: {error}" if r["error"] is None else f"{r['error']}; {stream}: {error}"
        elif stream == semantic:
            r["len_sem"], r["units"] = length, tokens
        elif stream == acoustic:
            r["depth"], r["len_ac"], r["tokens"] = depth, length, tokens
    return [tuple(r.values()) for r in rows.values()]


def paired_rows(encoded: DataFrame, semantic: str = "semantic", acoustic: str = "acoustic") -> DataFrame:
    """J1 over the long encode output: both streams of a key side by side.

    Both streams of a piece come from the same task, so partial aggregation
    folds them into one row before the shuffle (one row per key moves, not
    two).  For no shuffle at all, run ``encode_job(..., paired=...)``.
    Output has J1's shape ``(key, len_sem, units, depth, len_ac, tokens)``;
    keys that failed in either stream are left out (see :func:`quarantine`).
    """
    good = encoded.where(F.col("error").isNull())
    s = F.col("stream")
    return (
        good.groupBy("key")
        .agg(
            F.max(F.when(s == semantic, F.col("len"))).alias("len_sem"),
            F.max_by(F.col("tokens"), (s == semantic).cast("int")).alias("units"),
            F.max(F.when(s == acoustic, F.col("depth"))).alias("depth"),
            F.max(F.when(s == acoustic, F.col("len"))).alias("len_ac"),
            F.max_by(F.col("tokens"), (s == acoustic).cast("int")).alias("tokens"),
            F.count_if(s == semantic).alias("__ns"),
            F.count_if(s == acoustic).alias("__na"),
        )
        .where((F.col("__ns") == 1) & (F.col("__na") == 1))
        .drop("__ns", "__na")
    )


def quarantine(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split encode results into good rows and ``(key, stream, error)`` failures."""
    good = encoded.where(F.col("error").isNull()).drop("error")
    bad = encoded.where(F.col("error").isNotNull()).select("key", "stream", "error")
    return good, bad


# ---------------------------------------------------------------- deterministic toy encoders (tests)


def toy_semantic(hop: int = 2) -> EncoderFactory:
    """Unit per ``hop`` samples: a deterministic stand-in for a speech-unit model."""

    def factory():
        def fn(waves, rates):
            toks = []
            for w in waves:
                w = np.asarray(w, dtype=np.float64)
                n = len(w) // hop
                frames = w[: n * hop].reshape(n, hop) if n else np.zeros((0, hop))
                toks.append((np.floor((frames.sum(1) + hop) * 1000.0).astype(np.int64)) % 10000)
            return {"tokens": toks}

        return fn

    return factory


def toy_acoustic(n_q: int = 4, hop: int = 3, fail_when_len_mod: int | None = None) -> EncoderFactory:
    """``n_q`` codebooks per ``hop`` samples; optionally fails on some lengths (for P9)."""

    def factory():
        def fn(waves, rates):
            toks = []
            for w in waves:
                if fail_when_len_mod and len(w) % fail_when_len_mod == 0:
                    raise RuntimeError(f"encoder failed on a clip of {len(w)} samples")
                w = np.asarray(w, dtype=np.float64)
                n = len(w) // hop
                frames = w[: n * hop].reshape(n, hop) if n else np.zeros((0, hop))
                base = np.floor(np.abs(frames.sum(1)) * 997.0).astype(np.int64)
                toks.append(np.stack([(base * (q + 1) + q) % 1024 for q in range(n_q)]) if n else np.zeros((n_q, 0), np.int64))
            return {"tokens": toks}

        return fn

    return factory
