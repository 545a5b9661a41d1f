"""Aggregations: runs (A3 long form), store statistics (A1), depth check (A2),
vocabulary sizing (A10).  Batch statistics (A4) live in batching; scoring
aggregates (A5-A9) in scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import constants as K
from tokenmill.operators.ordered import run_starts


def run_length_units(df: DataFrame, group_cols: list[str], pos: str, unit: str) -> DataFrame:
    """A3 long form: collapse consecutive equal units per group.

    Gaps-and-islands without a per-group window: the skew-safe scan tags
    each row with the position its run starts at, and the run aggregate is
    algebraic (count/min) so even a run holding a third of all rows is
    combined map-side.  Output ``(group..., run_start, unit, run_len)``.
    """
    tagged = run_starts(df.select(*group_cols, pos, unit), group_cols, pos, unit, out="run_start")
    # the unit is constant within a run, so it joins the grouping key: a
    # count-only hash aggregate instead of a sort-based min(string)
    return tagged.groupBy(*group_cols, "run_start", unit).agg(F.count(F.lit(1)).alias("run_len"))


def store_stats(store: DataFrame, by=("stream", "split")) -> DataFrame:
    """A1: samples, min/max/total length per store partition (column-pruned scan)."""
    return store.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
        F.sum("len").cast("bigint").alias("total_len"),
    )


def depth_check(store: DataFrame, codec_depth: int = K.CODEC_DEPTH, by=("stream",)) -> DataFrame:
    """A2: stored depth must be uniform and at least ``codec_depth``.

    The reference reads the first record only; every record is checked here.
    """
    return store.groupBy(*by).agg(F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth")).withColumn(
        "ok", (F.col("min_depth") == F.col("max_depth")) & (F.col("min_depth") >= codec_depth)
    )


def assert_depth(store: DataFrame, codec_depth: int = K.CODEC_DEPTH) -> None:
    bad = depth_check(store, codec_depth, by=()).where(~F.col("ok")).first()
    if bad is not None:
        raise ValueError(f"stored acoustic depth {bad['min_depth']}..{bad['max_depth']} < codec_depth={codec_depth} or mixed")


def vocab_sizing(spark, sem: DataFrame, ac: DataFrame, source_symbols: int = K.SOURCE_VOCAB,
                 codec_depth: int = K.CODEC_DEPTH, codec_dim: int = K.CODEC_DIM) -> DataFrame:
    """A10: dictionary sizes (symbols + specials), combined size, and whether the data fits.

    Target symbols are ``codec_depth * codec_dim`` (the configured size is
    overridden when it disagrees); the largest offset code of the kept
    codebooks is read from the acoustic store.
    """
    from tokenmill.operators.joins import target_vocab_size

    n_tgt = target_vocab_size(codec_depth, codec_dim)
    src_size, tgt_size = source_symbols + K.NSPECIAL, n_tgt + K.NSPECIAL
    src_max = sem.select(F.max(F.array_max("units")).alias("m"))
    # the largest code of each codebook, then its offset: no code is offset one by one
    size = F.col("len")
    books = [F.array_max(F.slice("tokens", size * q + 1, size)) + F.lit(q * codec_dim).cast("bigint") for q in range(codec_depth)]
    tgt_max = ac.select(F.max(F.array_max(F.array(*books))).alias("m"))
    combined = src_size + tgt_size
    src = src_max.select(
        F.lit("source").alias("dictionary"), F.lit(source_symbols).cast("bigint").alias("n_symbols"),
        F.lit(src_size).cast("bigint").alias("vocab_size"), F.col("m").cast("bigint").alias("max_seen"),
        (F.col("m") < source_symbols).alias("fits"), F.lit(combined).cast("bigint").alias("combined_size"),
    )
    tgt = tgt_max.select(
        F.lit("target").alias("dictionary"), F.lit(n_tgt).cast("bigint").alias("n_symbols"),
        F.lit(tgt_size).cast("bigint").alias("vocab_size"), F.col("m").cast("bigint").alias("max_seen"),
        (F.col("m") < n_tgt).alias("fits"), F.lit(combined).cast("bigint").alias("combined_size"),
    )
    return src.unionByName(tgt)
