"""Encoder-side feature prep: P7 per-sequence z-score, P8 pad-to-multiple."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def waveform_zscore(arr, eps: float = K.LAYER_NORM_EPS) -> Column:
    """``(x - mean) / sqrt(var_pop + eps)`` over one sequence, no affine.

    Two linear passes with ``aggregate``; the statistics reach the element
    lambda through ``zip_with`` on a repeated struct, never as an outer
    reference (which Catalyst could re-evaluate per element).
    """
    x = F.transform(_c(arr), lambda v: v.cast("double"))
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    centred = F.zip_with(x, F.array_repeat(mean, n), lambda v, m: v - m)
    var = F.aggregate(centred, F.lit(0.0), lambda a, d: a + d * d) / n
    inv = F.lit(1.0) / F.sqrt(var + F.lit(eps))
    return F.zip_with(centred, F.array_repeat(inv, n), lambda d, s: d * s)


def pad_to_multiple(
    df: DataFrame, col: str, batch_col: str, multiple: int = K.PAD_MULTIPLE, pad: int = K.PAD_VALUE
) -> DataFrame:
    """Pad each sequence to its batch's longest length rounded up to ``multiple``.

    Adds ``padded`` and ``padding_mask`` (true = padding); the mask is null
    for a batch where nothing was padded.  Encoder batches are bounded
    (micro-batch size), so the window group is bounded.
    """
    w = Window.partitionBy(batch_col)
    target = (F.ceil(F.max(F.size(col)).over(w) / multiple) * multiple).cast("int")
    staged = df.withColumn("__target", target).withColumn("__npad", F.col("__target") - F.size(col))
    any_pad = F.max("__npad").over(w) > 0
    fill = F.array_repeat(F.lit(pad).cast(df.schema[col].dataType.elementType), F.col("__npad"))
    mask = F.concat(F.array_repeat(F.lit(False), F.size(col)), F.array_repeat(F.lit(True), F.col("__npad")))
    return (
        staged.withColumn("padded", F.concat(F.col(col), fill))
        .withColumn("padding_mask", F.when(any_pad, mask))
        .drop("__target", "__npad")
    )


def pad_rows(df: DataFrame, col: str, key: str = "key", size: int = K.ENCODER_MICRO_BATCH, multiple: int = K.PAD_MULTIPLE, pad: int = K.PAD_VALUE) -> DataFrame:
    """W5 + P8: pad each sequence to the longest of its micro-batch, in order of the (unique) key.

    Micro-batches, their longest lengths and whether any member is padded come
    from (key, length) alone; sequences meet them on their key and are never
    ordered or windowed themselves.
    """
    from tokenmill.operators.batching import micro_batch

    sizes = micro_batch(df.select(key, F.size(col).alias("__n")), key, size)
    w = Window.partitionBy("micro_batch")  # at most ``size`` rows
    target = (F.ceil(F.max("__n").over(w) / multiple) * multiple).cast("int")
    sizes = sizes.withColumn("__target", target)
    sizes = sizes.withColumn("__any", F.max(F.col("__target") - F.col("__n")).over(w) > 0).drop("__n")
    n_pad = F.col("__target") - F.size(col)
    fill = F.array_repeat(F.lit(pad).cast(df.schema[col].dataType.elementType), n_pad)
    mask = F.concat(F.array_repeat(F.lit(False), F.size(col)), F.array_repeat(F.lit(True), n_pad))
    joined = df.join(sizes, key).withColumn("padded", F.concat(F.col(col), fill))
    return joined.withColumn("padding_mask", F.when(F.col("__any"), mask)).drop("__target", "__any")
