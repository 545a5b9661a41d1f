"""Clip chunking and routing: P2 chunk plan, P3 chunk keys, P4 short-clip
filter, P6 fixed/ragged routing, U2 union of both routes.

All per-row expressions plus one ``explode``; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import constants as K
from tokenmill.functions.arrays import safe_slice


def chunk_clips(
    df: DataFrame,
    n: str = "n",
    sr: str = "sr",
    chunk_s: int = K.CHUNK_SECONDS,
    min_s: int = K.MIN_SECONDS,
    samples: str | None = None,
) -> DataFrame:
    """Plan the pieces of each clip: ``chunk_no, start, len, is_chunked``.

    With ``C = chunk_s * sr``: ``n <= C`` gives one unchunked piece; longer
    clips give full pieces and a tail that is dropped when shorter than
    ``min_s`` seconds, else back-aligned to the last ``C`` samples (so it
    overlaps its neighbour), or kept as is when exactly ``C``.  This is the
    plan only (no samples move); :func:`chunk_samples` cuts the audio.
    """
    C = F.col(sr) * chunk_s
    N = F.col(n)
    k = F.floor((N + C - 1) / C).cast("long")
    tail = N - (k - 1) * C
    n_pieces = F.when(N <= C, F.lit(1)).when(tail < F.col(sr) * min_s, k - 1).otherwise(k)
    out = (
        df.withColumn("is_chunked", N > C)
        .withColumn("__k", k)
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(1).cast("long"), n_pieces.cast("long"))))
    )
    start = (
        F.when(~F.col("is_chunked"), F.lit(0).cast("long"))
        .when((F.col("chunk_no") == F.col("__k")) & (tail != C), N - C)
        .otherwise((F.col("chunk_no") - 1) * C)
    )
    out = out.withColumn("start", start.cast("long")).withColumn(
        "len", F.when(F.col("is_chunked"), C).otherwise(N).cast("long")
    )
    if samples:
        # small arrays only: the row (with all samples) is copied per piece
        # before slicing; audio clips go through chunk_samples instead
        out = out.withColumn(samples, safe_slice(samples, F.col("start").cast("int"), F.col("len").cast("int")))
    return out.drop("__k")


def piece_plan(n: int, sr: int, chunk_s: int = K.CHUNK_SECONDS, min_s: int = K.MIN_SECONDS) -> list[tuple[int, int, int, bool]]:
    """``(chunk_no, start, len, is_chunked)`` of one clip - the P2 rule, per row."""
    C = chunk_s * sr
    if n <= C:
        return [(1, 0, n, False)]
    k = -(-n // C)
    tail = n - (k - 1) * C
    out = [(i + 1, i * C, C, True) for i in range(k - 1)]
    if tail >= min_s * sr:
        out.append((k, n - C if tail != C else (k - 1) * C, C, True))
    return out


def chunk_samples(
    clips: DataFrame,
    key: str = "key",
    samples: str = "samples",
    sr: str = "sr",
    chunk_s: int = K.CHUNK_SECONDS,
    min_s: int = K.MIN_SECONDS,
) -> DataFrame:
    """P2-P4 on decoded audio: one row per kept piece with only its own samples.

    An Arrow pass cuts numpy views, so a clip of ``n`` samples emits about
    ``n`` samples in total instead of one full copy per piece.  Output:
    ``key, chunk_no, start, len, is_chunked, chunk_key, sr, samples``.
    """
    import numpy as np
    import pandas as pd

    def cut(batches):
        for pdf in batches:
            rows = []
            for k, x, r in zip(pdf["key"], pdf["samples"], pdf["sr"]):
                x = np.asarray(x, dtype=np.float32)
                for no, start, ln, chunked in piece_plan(len(x), int(r), chunk_s, min_s):
                    if not chunked and ln < min_s * r:
                        continue  # P4: short unchunked clip dropped
                    rows.append((k, no, start, ln, chunked, f"{k}{no}" if chunked else k, int(r), x[start : start + ln]))
            yield pd.DataFrame(rows, columns=["key", "chunk_no", "start", "len", "is_chunked", "chunk_key", "sr", "samples"])

    schema = "key string, chunk_no long, start long, len long, is_chunked boolean, chunk_key string, sr int, samples array<float>"
    staged = clips.select(F.col(key).alias("key"), F.col(samples).alias("samples"), F.col(sr).alias("sr"))
    return staged.mapInPandas(cut, schema)


def chunk_key(path, chunk_no, is_chunked) -> "F.Column":
    """Chunked piece ``i`` (1-based) is ``path || i``; an unchunked clip keeps ``path``."""
    path, chunk_no, is_chunked = F.col(path), F.col(chunk_no), F.col(is_chunked)
    return F.when(is_chunked, F.concat(path, chunk_no.cast("string"))).otherwise(path)


def short_clip_filter(pieces: DataFrame, n: str = "n", sr: str = "sr", min_s: int = K.MIN_SECONDS) -> DataFrame:
    """Flag an unchunked clip shorter than ``min_s`` seconds (``n == sr`` is kept)."""
    return pieces.withColumn("kept", F.col("is_chunked") | (F.col(n) >= F.col(sr) * min_s))


def split_routes(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixed-length (chunked, rectangular) and ragged (unchunked) pieces."""
    return pieces.where(F.col("is_chunked")), pieces.where(~F.col("is_chunked"))


def route_batches(pieces: DataFrame, batch_cols: list[str]) -> DataFrame:
    """Per loader batch and route, the number of pieces and samples.

    A route that is empty in a batch has no row (the reference's ``None``).
    """
    route = F.when(F.col("is_chunked"), "fixed").otherwise("ragged")
    return pieces.withColumn("route", route).groupBy(*batch_cols, "route").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("len").cast("bigint").alias("n_samples")
    )


def chunk_union(fixed: DataFrame, ragged: DataFrame) -> DataFrame:
    """Results of both routes land in one store (bag union)."""
    return fixed.unionByName(ragged)
