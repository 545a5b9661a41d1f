"""Ordering and batching: W1 length order, W2 token-budget batches, W3
strided shards, W4 in-batch order, W5 micro-batches, A4 batch statistics.

W2 is exact and distributed: after a stable ascending length sort, the greedy
rule (close the open batch when ``(n + 1) * len > max_tokens``) only depends
on how many rows each length has.  The length histogram is bounded by
``max_tokens`` (longer samples are rejected first), so it is collected, scanned
once on the driver into a per-length plan, broadcast, and every row computes
its batch from its rank within its length.  That rank comes from the
skew-safe scan in :mod:`tokenmill.operators.ordered`, because clipping piles
all long clips onto one length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions import constants as K
from tokenmill.functions.hashing import uniform
from tokenmill.functions.numeric import round_half_up
from tokenmill.operators.ordered import global_index, row_number_within
from tokenmill.session import checkpointed


def length_order(
    df: DataFrame, len_col: str = "len_s", key: str = "key", shuffle: bool = True, seed: int = 42, out: str = "order_rank"
) -> DataFrame:
    """Position in (length, random permutation) order; stable on ties.

    The draw ``u("shuffle", key)`` replaces the reference's unseeded
    permutation; ``shuffle=False`` keeps natural (key byte) order.
    """
    staged = df.withColumn("__shuffle", uniform("shuffle", F.col(key), seed)) if shuffle else df
    order = [F.col(len_col)] + ([F.col("__shuffle")] if shuffle else []) + [F.col(key)]
    res = global_index(staged, order, out=out)
    return res.drop("__shuffle") if shuffle else res


def batch_plan(
    hist: list[tuple[int, int]], max_tokens: int = K.MAX_TOKENS, max_sentences: int | None = None
) -> list[tuple[int, int, int, int, int]]:
    """Greedy batching from a length histogram, in two dimensions: tokens and sentences.

    ``hist`` holds ``(length, count)``.  A batch is closed when one more row
    would bring it over ``max_tokens`` (rows times longest row) or over
    ``max_sentences`` rows (by default ``max_tokens``, which only rows of
    length 0 can reach, so no batch is unbounded).  Returns ``(length,
    open_batch, head, first_new, cap)``: the first ``head`` rows of a length
    join the batch that is open when the length starts; the rest fill fresh
    batches of ``cap`` rows numbered from ``first_new``.
    """
    most = max_tokens if max_sentences is None else max_sentences
    if most < 1:
        raise ValueError("a batch holds at least one sentence")
    plan = []
    b, k = -1, 0  # id and fill of the open batch
    for length, count in sorted(hist):
        if length > max_tokens:
            raise ValueError(f"sample of size {length} exceeds max_tokens={max_tokens}")
        cap = min(most, max_tokens // length) if length > 0 else most
        head = min(max(cap - k, 0), count) if k > 0 else 0
        rest = count - head
        plan.append((length, b, head, b + 1, cap))
        if rest > 0:
            n_new = -(-rest // cap)
            b += n_new
            k = rest - (n_new - 1) * cap
        else:
            k += head
    return plan


def token_budget_batches(
    df: DataFrame,
    len_col: str = "len_s",
    key: str = "key",
    max_tokens: int = K.MAX_TOKENS,
    shuffle: bool = True,
    seed: int = 42,
    out: str = "batch_id",
    max_sentences: int | None = None,
) -> DataFrame:
    """Assign every row the id of its batch (0-based), of at most ``max_tokens`` tokens and ``max_sentences`` rows."""
    spark = df.sparkSession
    staged = df.withColumn("__shuffle", uniform("shuffle", F.col(key), seed)) if shuffle else df
    staged = checkpointed(staged)  # read by the histogram and the rank scan
    # valid lengths are 0..max_tokens, so a histogram of more rows than that
    # already proves a violation: the collect is bounded either way
    hist = [(r[0], r[1]) for r in staged.groupBy(len_col).count().limit(max_tokens + 2).collect()]
    over = [ln for ln, _ in hist if ln is not None and ln > max_tokens]
    if over or len(hist) > max_tokens + 1:
        raise ValueError(f"sample of size {max(over) if over else '>' + str(max_tokens)} exceeds max_tokens={max_tokens}")
    plan = batch_plan(hist, max_tokens, max_sentences)
    schema = T.StructType(
        [
            T.StructField(len_col, df.schema[len_col].dataType, False),
            T.StructField("__open", T.LongType(), False),
            T.StructField("__head", T.LongType(), False),
            T.StructField("__first", T.LongType(), False),
            T.StructField("__cap", T.LongType(), False),
        ]
    )
    plan_df = spark.createDataFrame(plan, schema)
    order = ([F.col("__shuffle")] if shuffle else []) + [F.col(key)]
    ranked = row_number_within(staged, [len_col], order, out="__rank", materialized=True)
    rank = F.col("__rank")
    batch = F.when(rank <= F.col("__head"), F.col("__open")).otherwise(
        F.col("__first") + F.floor((rank - F.col("__head") - 1) / F.col("__cap")).cast("long")
    )
    res = ranked.join(F.broadcast(plan_df), len_col, "inner").withColumn(out, batch)
    return res.drop("__open", "__head", "__first", "__cap", "__rank", "__shuffle")


def strided_shard(
    df: DataFrame,
    order_col: str = "path",
    world_size: int = 2,
    batch_size: int = K.LOADER_BATCH,
) -> DataFrame:
    """Row ``i`` (manifest order) -> worker ``i mod W``; batches of B per worker.

    ``idx`` is a global 0-based row index from the skew-safe scan (no single
    task sorts the manifest).  Worker sizes follow ``N div W + (rank < N mod W)``.
    """
    idx = global_index(df, [F.col(order_col)], out="idx")
    return idx.withColumn("worker", (F.col("idx") % world_size).cast("int")).withColumn(
        "batch_no", F.expr(f"(idx div {world_size}) div {batch_size}")
    )


def batch_row_order(df: DataFrame, batch_col: str = "batch_id", len_col: str = "src_length", key: str = "key") -> DataFrame:
    """Rank members of a batch by source length, longest first (key breaks ties).

    A batch holds at most ``max_tokens`` members, rows of length 0 included, so each window group is bounded.
    """
    w = Window.partitionBy(batch_col).orderBy(F.col(len_col).desc(), F.col(key))
    return df.withColumn("rank_in_batch", (F.row_number().over(w) - 1).cast("int"))


def micro_batch(df: DataFrame, order_col: str = "key", size: int = K.ENCODER_MICRO_BATCH, out: str = "micro_batch") -> DataFrame:
    """Consecutive groups of at most ``size`` rows in ``order_col`` order."""
    idx = global_index(df, [F.col(order_col)], out="__idx")
    return idx.withColumn(out, F.floor(F.col("__idx") / size).cast("long")).drop("__idx")


def batch_stats(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """A4: per-batch counts, tokens and padding of assembled rows.

    Expects ``len_s`` (batching size), ``src_length`` (source rows incl. eos),
    ``target_length`` (target rows incl. eos) and ``row_length`` (interleaved
    LM input length).  All aggregates are algebraic (map-side combined).
    """
    agg = df.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("nsentences"),
        F.sum("target_length").cast("bigint").alias("ntokens"),
        F.max("src_length").cast("int").alias("max_src_length"),
        F.max("row_length").cast("int").alias("padded_length"),
        F.sum("row_length").cast("bigint").alias("real_cells"),
        F.max("len_s").cast("int").alias("max_len_s"),
    )
    return agg.withColumn("budget_tokens", (F.col("nsentences") * F.col("max_len_s")).cast("bigint")).withColumn(
        "padding_ratio",
        round_half_up(1 - F.col("real_cells") / (F.col("nsentences") * F.col("padded_length")), 6),
    )
