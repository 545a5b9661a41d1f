"""Scoring and metrics: label un-offset, position classes, frame masks, local
drop, prediction alignment, masked accuracy, smoothed NLL, log reduction,
weighted meters and top-k sampling.

Score tables are long: ``(pos, class, score)`` with the label ``target`` and
an optional ``keep`` mask per position.  Every per-position group is bounded
by the vocabulary size, so windows partitioned by ``pos`` are safe; log
reductions are algebraic aggregates (map-side combined).
"""

from __future__ import annotations

from decimal import Decimal
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions import constants as K, ragged
from tokenmill.functions.hashing import hash32, uniform
from tokenmill.functions.numeric import LN2, round_half_up, round_significant
from tokenmill.operators.ordered import running_sums


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- P19 - P22


def target_unoffset(target2d, codec_dim: int = K.CODEC_DIM, eos: int = K.EOS) -> Column:
    """Label - q * codec_dim, clipped below at eos (the eos row would go negative)."""
    return F.transform(_c(target2d), lambda r: F.transform(r, lambda x, q: F.greatest(x - q * codec_dim, F.lit(eos))))


def pad_to_batch(df: DataFrame, col: str, batch_col: str, depth: int, pad: int = K.PAD) -> DataFrame:
    """Right-pad a per-row matrix to the longest one in its batch (``pad_sequence``).

    A batch has at most ``max_tokens`` members, so the window group is bounded.
    """
    w = Window.partitionBy(batch_col)
    longest = F.max(F.size(col)).over(w)
    fill = F.array_repeat(F.array_repeat(F.lit(pad).cast("bigint"), depth), (longest - F.size(col)).cast("int"))
    return df.withColumn(col, F.concat(F.col(col), fill))


def position_class_counts(
    df: DataFrame, col: str = "src_tokens", batch_col: str = "batch_id", key: str = "key", shift: int = K.SOURCE_DICT_LEN, pad: int = K.PAD
) -> DataFrame:
    """P20: semantic (tok0 < shift, != pad), acoustic (tok0 >= shift) and pad positions of each row in its padded batch.

    Rows are counted as they are; only counts are moved to find a batch's
    longest row, whose length is the padded length of all.
    """

    def work(rows: pa.Array) -> pa.Array:
        first = ragged.first_values(rows)
        ends, ids = ragged.ends_of(ragged.sizes(first)), first.flatten()
        x, held = ragged.ints(ids), ~ragged.nulls(ids)
        counts = [ragged.ends_of(held & is_one)[ends] for is_one in ((x < shift) & (x != pad), x >= shift)]
        columns = [pa.array(np.diff(c), pa.int64()) for c in counts] + [pa.array(np.diff(ends), pa.int32())]
        mask = pa.array(ragged.nulls(rows))
        return pa.StructArray.from_arrays(columns, ["n_semantic", "n_acoustic", "n"], mask=mask)

    found = ragged.column(work, "struct<n_semantic:bigint,n_acoustic:bigint,n:int>", col)
    counts = df.select(key, batch_col, found.alias("__c")).select(key, batch_col, "__c.n_semantic", "__c.n_acoustic", F.col("__c.n").alias("__n"))
    longest = F.max("__n").over(Window.partitionBy(batch_col))  # a batch has at most max_tokens rows
    return counts.withColumn("n_pad", (longest - F.col("n_semantic") - F.col("n_acoustic")).cast("bigint")).drop("__n")


def frame_mask(df: DataFrame, col: str = "target", batch_col: str = "batch_id", pad: int = K.PAD) -> DataFrame:
    """Frames kept when any codebook differs from pad; counted per batch."""
    kept = F.size(F.filter(col, lambda r: F.exists(r, lambda x: x != pad)))
    return df.groupBy(batch_col).agg(
        F.sum(F.size(col)).cast("bigint").alias("n_frames"), F.sum(kept).cast("bigint").alias("n_kept")
    )


def kept_frames(df: DataFrame, col: str = "target", batch_col: str = "batch_id", key: str = "key", pad: int = K.PAD) -> DataFrame:
    """The kept frames of every batch as rows (batch, key, frame, codes); (key, frame) order flattens a batch."""
    frames = df.select(batch_col, key, F.posexplode(col).alias("frame", "codes"))
    return frames.where(F.exists("codes", lambda x: x != pad))


def local_drop(df: DataFrame, col: str = "target", p: float = 0.0, key: str = "key", seed: int = 42, pad: int = K.PAD) -> DataFrame:
    """Keep ``floor(n * (1 - p) + 1)`` randomly ranked real frames per row.

    Real frames (any codebook != pad) are ranked by ``u("drop", key#t)``, pad
    frames rank last; at least one frame survives.  ``p`` is taken as a
    decimal so the keep count is exact.  Adds ``kept_frames`` (sorted frame
    indices) and ``n_frames``; per-row work over Arrow batches, no shuffle.
    """
    num, den = (1 - Decimal(repr(float(p)))).as_integer_ratio()

    def real(rows: pa.Array) -> pa.Array:
        inner = rows.flatten()
        values = inner.flatten()
        ahead = ragged.ends_of((ragged.ints(values) != pad) & ~ragged.nulls(values))
        at = ragged.ends_of(ragged.sizes(inner))
        return ragged.lists(ragged.sizes(rows), pa.array(ahead[at[1:]] > ahead[at[:-1]]), ragged.nulls(rows))

    def ranked(rows: pa.Array, keys: pa.Array) -> pa.Array:
        n = ragged.sizes(rows)
        flags = rows.flatten().to_numpy(zero_copy_only=False).astype(bool)
        flags &= ~np.repeat(ragged.nulls(keys), n)  # without a key there is no draw
        row, t = np.repeat(np.arange(len(n)), n)[flags], ragged.ranges(np.zeros(len(n), np.int64), n)[flags]
        ends = ragged.ends_of(np.bincount(row, minlength=len(n)))
        frames = [b"%d:%d" % (i, seed) for i in range(int(n.max(initial=0)))]
        draws = bytearray()
        for i, k in enumerate(keys.to_pylist()):
            if ends[i + 1] > ends[i]:
                begin = f"drop:{k}#".encode()
                draws += b"".join([md5(begin + frames[j], usedforsecurity=False).digest()[:4] for j in t[ends[i] : ends[i + 1]].tolist()])
        # by row, draw and frame: the frames of a row are in order already
        order = np.argsort((row.astype(np.uint64) << np.uint64(32)) | np.frombuffer(bytes(draws), ">u4").astype(np.uint64), kind="stable")
        size = np.diff(ends)
        keep_n = np.minimum([int(m) * num // den + 1 for m in size], size).astype(np.int64)
        chosen = np.sort(order[ragged.ranges(ends[:-1], keep_n)])
        return ragged.lists(keep_n, pa.array(t[chosen], pa.int32()), ragged.nulls(rows))

    return (
        df.withColumn("__real", ragged.column(real, "array<boolean>", col))
        .withColumn("kept_frames", ragged.column(ranked, "array<int>", "__real", F.col(key).cast("string")))
        .withColumn("n_frames", F.size("__real"))
        .drop("__real")
    )


# ---------------------------------------------------------------- J6 / A5 / A6


def argmax_predictions(scores: DataFrame, pos: str = "pos", cls: str = "class", score: str = "score") -> DataFrame:
    """Argmax class per position; ties go to the lowest class (torch ``argmax``)."""
    return scores.groupBy(pos).agg(F.max_by(F.col(cls), F.struct(F.col(score), -F.col(cls))).alias("pred"))


def prediction_align(preds: DataFrame, labels: DataFrame, mask: DataFrame | None = None, pos: str = "pos") -> DataFrame:
    """Predictions zipped with labels by position, restricted to masked positions."""
    out = preds.join(labels, pos, "inner")
    if mask is not None:
        out = out.join(mask.select(pos), pos, "left_semi")
    return out


def masked_accuracy(aligned: DataFrame, pred: str = "pred", target: str = "target") -> DataFrame:
    """A5: ``n_correct`` = argmax == target, ``total`` = positions considered."""
    return aligned.agg(
        F.count_if(F.col(pred) == F.col(target)).cast("bigint").alias("n_correct"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
    )


def log_softmax(scores: DataFrame, pos: str = "pos", score: str = "score", temperature: float = 1.0, out: str = "lprob") -> DataFrame:
    """Per-position log-softmax over classes, stable (max-shifted)."""
    w = Window.partitionBy(pos)
    x = F.col(score) / F.lit(float(temperature))
    m = F.max(x).over(w)
    lse = m + F.log(F.sum(F.exp(x - m)).over(w))
    return scores.withColumn(out, x - lse)


def smoothed_nll(
    scores: DataFrame,
    mask: DataFrame | None = None,
    epsilon: float = K.LABEL_SMOOTHING,
    factor: float = 1.0,
    pos: str = "pos",
    cls: str = "class",
    target: str = "target",
) -> DataFrame:
    """``nll`` mean and ``(1 - eps) * nll - eps * mean(log-prob)``, times factor.

    ``scores`` carries the label per row (``target``); a label that is none of
    its position's classes is an error.  The logged loss is divided by
    ``factor`` again, as the reference logs it.
    """
    is_label = F.coalesce(F.col(cls) == F.col(target), F.lit(False))
    lp = log_softmax(scores, pos).withColumn("labelled", F.max(is_label).over(Window.partitionBy(pos)))
    if mask is not None:
        lp = lp.join(mask.select(pos), pos, "left_semi")
    n = F.count_if(F.col(cls) == F.col(target))  # one label row per position
    agg = lp.agg(
        F.when(F.count_if(~F.col("labelled")) > 0, F.raise_error(F.lit("a label is outside the classes"))).otherwise(n).alias("n_positions"),
        (-F.avg(F.when(F.col(cls) == F.col(target), F.col("lprob")))).alias("nll"),
        F.avg("lprob").alias("mean_lprob"),
    )
    nll = F.coalesce(F.col("nll"), F.lit(0.0))
    loss = (nll * (1 - epsilon) - F.coalesce(F.col("mean_lprob"), F.lit(0.0)) * epsilon) if epsilon > 0 else nll
    return agg.select(
        F.col("n_positions").cast("bigint").alias("n_positions"),
        round_half_up(nll, 6).alias("nll_loss"),
        round_half_up(loss * factor / factor, 6).alias("loss"),
    )


# ---------------------------------------------------------------- A7 / A8 / A9


def _log_columns(log: DataFrame):
    totals = [c for c in log.columns if c.startswith("total_")]
    comps = [c for c in log.columns if c.endswith("-loss")]
    return totals, comps


def log_partial_sum(log: DataFrame, by: str = "update", worker: str = "worker") -> DataFrame:
    """Sum worker logs per (update, worker), then per update.

    The logged quantities are sums, so the two-phase result equals a
    one-step sum; Spark's partial aggregation does the same map-side.
    """
    num = [c for c in log.columns if c not in (by, worker)]
    per_worker = log.groupBy(by, worker).agg(*[F.sum(c).alias(c) for c in num])
    return per_worker.groupBy(by).agg(*[F.sum(c).alias(c) for c in num])


def reduce_metrics(log: DataFrame, by: str = "update", worker: str = "worker", ppl_sig_digits: int | None = None) -> DataFrame:
    """Reduce worker logs to metrics, long form ``(update, metric, value)``.

    loss and nll_loss in bits (sum / sample_size / ln 2, 3 decimals); ppl =
    2^loss (2 decimals); ``total_x``/``n_correct_x`` -> ``accuracy_x`` = 100 *
    sum n / sum total when the total is positive; ``x-loss`` -> ``x``.
    ``ppl_sig_digits`` additionally rounds the perplexity to significant
    digits: 2^loss magnifies last-bit summation noise into its integer digits.
    An update whose ``sample_size`` is 0 has no loss, nll_loss and ppl rows.
    """
    totals, comps = _log_columns(log)
    sums = log.groupBy(by).agg(*[F.sum(c).alias(c) for c in log.columns if c not in (by, worker)])
    ss = F.col("sample_size")
    bits = lambda c: F.try_divide(F.col(c), ss) / F.lit(LN2)
    raw = F.pow(F.lit(2.0), bits("loss"))
    ppl = round_half_up(round_significant(raw, ppl_sig_digits) if ppl_sig_digits else raw, 2)
    metrics = [
        F.struct(F.lit("loss").alias("metric"), round_half_up(bits("loss"), 3).alias("value")),
        F.struct(F.lit("nll_loss").alias("metric"), round_half_up(bits("nll_loss"), 3).alias("value")),
        F.struct(F.lit("ppl").alias("metric"), ppl.alias("value")),
    ]
    for t in totals:
        name = t[len("total") :]
        acc = F.when(F.col(t) > 0, round_half_up(100.0 * F.col(f"n_correct{name}") / F.col(t), 3))
        metrics.append(F.struct(F.lit(f"accuracy{name}").alias("metric"), acc.alias("value")))
    for c in comps:
        val = F.when(ss > 0, round_half_up(bits(c), 3)).otherwise(F.lit(0.0))
        metrics.append(F.struct(F.lit(c[:-5]).alias("metric"), val.alias("value")))
    out = sums.select(by, F.explode(F.array(*metrics)).alias("m")).select(by, "m.metric", "m.value")
    return out.where(F.col("value").isNotNull())


def weighted_meter(log: DataFrame, value: str = "loss", weight: str = "sample_size", by: str = "update") -> DataFrame:
    """Running sample-size-weighted average of a logged value, in bits.

    Per update the logs are summed (algebraic), then running sums over the
    update order come from the skew-safe scan - no single-task window.
    """
    per = log.groupBy(by).agg(F.sum(value).alias("__v"), F.sum(weight).alias("__w"))
    run = running_sums(per, [], [F.col(by)], {"__rv": F.col("__v"), "__rw": F.col("__w")})
    return run.select(by, round_half_up(F.col("__rv") / F.col("__rw") / F.lit(LN2), 6).alias(f"{value}_avg"))


# ---------------------------------------------------------------- O2 / O3


def topk_candidates(
    scores: DataFrame,
    k: int,
    temperature: float = 1.0,
    banned: tuple[int, ...] = (K.PAD, K.UNK, K.EOS),
    pos: str = "pos",
    cls: str = "class",
    score: str = "score",
) -> DataFrame:
    """O2: temperature log-softmax per position, banned ids removed, top k kept."""
    lp = log_softmax(scores, pos, score, temperature)
    lp = lp.where(~F.col(cls).isin(list(banned)))
    w = Window.partitionBy(pos).orderBy(F.col("lprob").desc(), F.col(cls))
    return lp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_sample(
    cands: DataFrame,
    codebook: Column | None = None,
    codec_dim: int = K.CODEC_DIM,
    pos: str = "pos",
    cls: str = "class",
    seed: int = 42,
) -> DataFrame:
    """O3: draw one candidate by renormalised probability (inverse CDF).

    ``u("sample", pos)`` is compared with the running probability mass in
    rank order; the id gets the codebook offset ``q * codec_dim``.
    """
    w = Window.partitionBy(pos).orderBy("rank")
    p = F.exp(F.col("lprob"))
    staged = cands.withColumn("__cum", F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "__tot", F.sum(p).over(Window.partitionBy(pos))
    )
    staged = staged.withColumn("__hit", F.col("__cum") / F.col("__tot") > uniform("sample", F.col(pos), seed))
    chosen = staged.where("__hit").groupBy(pos).agg(F.min_by(F.col(cls), F.col("rank")).alias(cls))
    q = codebook if codebook is not None else F.lit(0)
    return chosen.withColumn("token_id", (F.col(cls) + q * codec_dim).cast("bigint"))
