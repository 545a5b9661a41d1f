"""Clip loading (S4) as an Arrow-batched decode job, plus the mono contract (P5).

PCM WAV is decoded with the standard-library ``wave`` module and numpy, one
Arrow batch at a time inside ``mapInPandas``; FLAC and resampling belong to
the user's decoder/encoder and are not built.
"""

from __future__ import annotations

import io
import wave
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_BYTES = 1 << 16  # where a file's data chunk must have begun
OUT_BYTES = 4 << 20  # samples of this size are handed on at once, however many files an Arrow batch has

DECODED_SCHEMA = (
    "key string, sr int, n_channels int, sample_width int, n_samples long, samples array<float>, error string"
)


def _pcm_to_float(raw: bytes, width: int, channels: int) -> np.ndarray:
    if width == 1:
        x = (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128.0) / 128.0
    elif width == 2:
        x = np.frombuffer(raw, dtype="<i2").astype(np.float32) / 32768.0
    elif width == 4:
        x = np.frombuffer(raw, dtype="<i4").astype(np.float32) / 2147483648.0
    else:
        raise ValueError(f"unsupported sample width {width}")
    return x.reshape(-1, channels) if channels > 1 else x


def _decode_batches(batches: Iterator[pd.DataFrame], with_samples: bool) -> Iterator[pd.DataFrame]:
    names = ["key", "sr", "n_channels", "sample_width", "n_samples", "samples", "error"]
    for pdf in batches:
        out, size = [], 0
        for key, content in zip(pdf["key"], pdf["content"]):
            try:
                with wave.open(io.BytesIO(bytes(content)), "rb") as w:
                    ch, width, sr, n = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
                    raw = w.readframes(n) if with_samples else b""
                # mono keeps its samples; multi-channel is kept interleaved for the reject path
                x = _pcm_to_float(raw, width, ch)  # also refuses widths that are not PCM's
                samples = x.reshape(-1) if with_samples else None  # numpy -> Arrow list without Python floats
                out.append((key, sr, ch, width, int(n), samples, None))
                size += 0 if samples is None else samples.nbytes
            except Exception as e:  # a bad file is reported, not fatal
                out.append((key, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            if size >= OUT_BYTES:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        yield pd.DataFrame(out, columns=names)


def decode_wav(df: DataFrame, key: str = "key", content: str = "content", with_samples: bool = True) -> DataFrame:
    """Decode a ``(key, content BINARY)`` frame of WAV files into samples.

    Without samples only a file's first ``HEADER_BYTES`` go to the decoder:
    what it reports then comes from the header alone.
    """
    blob = F.col(content) if with_samples else F.substring(F.col(content), 1, HEADER_BYTES)
    staged = df.select(F.col(key).alias("key"), blob.alias("content"))
    return staged.mapInPandas(lambda it: _decode_batches(it, with_samples), DECODED_SCHEMA)


PIECES_SCHEMA = (
    "key string, sr int, n_channels int, n_samples long, chunk_no long, start long, len long, "
    "is_chunked boolean, chunk_key string, samples array<float>, reason string"
)


def decode_pieces(
    df: DataFrame, chunk_s: int = 30, min_s: int = 1, key: str = "key", content: str = "content", carry: list[str] | None = None
) -> DataFrame:
    """S4 + P5 + P2-P4 fused: decode each file once and emit its kept pieces.

    Mono clips yield one row per piece carrying only that piece's samples
    (``reason`` null); a clip that is too short, not mono or fails to decode yields one
    row with its ``reason`` and no samples, so the reject list is a filter.
    A file without content has the reason that its ``error`` column (if any)
    gives.  ``carry`` names columns passed on, as strings, to every row.
    """
    from tokenmill.operators.chunking import piece_plan

    carry = list(carry or [])
    failed = "error" if "error" in df.columns else None
    cols = [c.split()[0] for c in PIECES_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for found in decode(pdf):
                whole = pd.DataFrame(found, columns=["__row", *cols])
                for c in carry:
                    whole[c] = pdf[c].to_numpy()[whole["__row"].to_numpy(dtype=np.int64)]
                yield whole.drop(columns="__row")

    def decode(pdf: pd.DataFrame) -> Iterator[list[tuple]]:
        """The pieces of a batch's files, some MB of samples at a time."""
        out, size = [], 0
        errors = pdf["__error"] if failed else [None] * len(pdf)
        for row, (k, blob, error) in enumerate(zip(pdf["key"], pdf["content"], errors)):
            for piece in pieces_of(k, blob, error):
                out.append((row, *piece))
                size += 0 if piece[9] is None else piece[9].nbytes
                if size >= OUT_BYTES:
                    yield out
                    out, size = [], 0
        if out:
            yield out

    def pieces_of(k: str, blob, error) -> list[tuple]:
        if error is not None:
            return [(k, None, None, None, None, None, None, None, None, None, error)]
        out = []
        try:
            with wave.open(io.BytesIO(bytes(blob)), "rb") as w:
                ch, width, sr, n = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
                raw = w.readframes(n)
        except Exception as e:
            return [(k, None, None, None, None, None, None, None, None, None, f"decode_error: {e}")]
        if ch != 1:
            return [(k, sr, ch, n, None, None, None, None, None, None, "not_mono")]
        x = _pcm_to_float(raw, width, 1)
        for no, start, ln, chunked in piece_plan(n, sr, chunk_s, min_s):
            if not chunked and ln < min_s * sr:
                out.append((k, sr, ch, n, None, None, None, None, None, None, "too_short"))
                continue
            out.append((k, sr, ch, n, no, start, ln, chunked, f"{k}{no}" if chunked else k, x[start : start + ln], None))
        return out

    more = [F.col(failed).alias("__error")] if failed else []
    staged = df.select(F.col(key).alias("key"), F.col(content).alias("content"), *more, *[F.col(c).cast("string").alias(c) for c in carry])
    return staged.mapInPandas(run, PIECES_SCHEMA + "".join(f", {c} string" for c in carry))


def clip_load(spark: SparkSession, root: str, ext: str = "wav", with_samples: bool = True) -> DataFrame:
    """List and decode clips; the file path is the clip key."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{ext}")
        .load(root)
        .select(F.regexp_replace("path", "^file:", "").alias("key"), "content")
    )
    return decode_wav(files, with_samples=with_samples)


def mono_contract(decoded: DataFrame) -> DataFrame:
    """P5: accept mono clips; every other clip goes to a reject list with its reason.

    The reference squeezes the channel axis only when it is 1, so stereo
    clips were silently lost; here they are reported.
    """
    reason = (
        F.when(F.col("error").isNotNull(), F.lit("decode_error"))
        .when(F.col("n_channels") != 1, F.lit("not_mono"))
        .otherwise(F.lit(None).cast("string"))
    )
    return decoded.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    )


def _le(n: Column, width: int) -> Column:
    """Little-endian bytes of an integer column as a hex string."""
    parts = [F.lpad(F.hex(F.shiftright(n, 8 * i) % 256), 2, "0") for i in range(width)]
    return F.concat(*parts)


def wav_bytes(pcm: Column, sr: Column, channels: Column) -> Column:
    """Build an 8-bit PCM WAV file (44-byte header + data) with built-in functions."""
    n = F.octet_length(pcm).cast("long")
    header = F.concat(
        F.hex(F.lit("RIFF")),
        _le(n + 36, 4),
        F.hex(F.lit("WAVEfmt ")),
        _le(F.lit(16).cast("long"), 4),
        _le(F.lit(1).cast("long"), 2),
        _le(channels.cast("long"), 2),
        _le(sr.cast("long"), 4),
        _le((sr * channels).cast("long"), 4),
        _le(channels.cast("long"), 2),
        _le(F.lit(8).cast("long"), 2),
        F.hex(F.lit("data")),
        _le(n, 4),
    )
    return F.concat(F.unhex(header), pcm)
