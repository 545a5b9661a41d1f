"""Token store: partitioned Parquet replacing the per-worker key-value shards.

Layout ``root/stream=<s>/bandwidth=<bw>/split=<split>/`` (S8): the location
the reference derived from (bandwidth, split) becomes Hive partitions, so a
read of one stream/split prunes every other folder.  Each record keeps its
shape beside its tokens (``depth``, ``len``), so the size index is a
column-pruned scan of two int columns.  Files are sorted by ``key`` so a
point read (a pushed-down ``key = ...`` filter) skips row groups by their
min/max statistics.  Re-running a write replaces exactly the partitions it
writes (dynamic partition overwrite, S9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions import constants as K

SEMANTIC = "semantic"
ACOUSTIC = "acoustic"
NO_BANDWIDTH = "na"

STORE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("depth", T.IntegerType(), True),
        T.StructField("len", T.IntegerType(), True),
        T.StructField("tokens", T.ArrayType(T.LongType()), True),
        T.StructField("stream", T.StringType(), True),
        T.StructField("bandwidth", T.StringType(), True),
        T.StructField("split", T.StringType(), True),
    ]
)
PARTITIONS = ["stream", "bandwidth", "split"]

# codebook-per-column layout: up to 32 codebooks (24 kbps) as cb00..cb31
MAX_CODEBOOKS = 32
CODEBOOK_COLUMNS = [f"cb{q:02d}" for q in range(MAX_CODEBOOKS)]
STORE_SCHEMA = T.StructType(
    STORE_SCHEMA.fields[:4]
    + [T.StructField(c, T.ArrayType(T.LongType()), True) for c in CODEBOOK_COLUMNS]
    + STORE_SCHEMA.fields[4:]
)


def store_name(stream: str, bandwidth: float | None = None) -> str:
    """Reference folder name of a stream (kept for export/import tooling)."""
    if stream == SEMANTIC:
        return K.SEMANTIC_STORE
    bw = int(bandwidth) if bandwidth is not None and float(bandwidth).is_integer() else bandwidth
    return K.CODEC_STORE.format(bw=bw)


def _bw(bandwidth) -> str:
    if bandwidth is None:
        return NO_BANDWIDTH
    b = float(bandwidth)
    return str(int(b)) if b.is_integer() else str(b)


def write_token_store(
    df: DataFrame,
    root: str,
    stream: str,
    split=None,
    bandwidth: float | None = None,
    files_per_partition: int | None = None,
    codebook_columns: bool = False,
    max_depth: int | None = None,
    bloom: bool = False,
) -> str:
    """Write ``(key, [depth], len, tokens)`` rows into the store.

    With ``codebook_columns=True`` the flat codebook-major ``tokens`` are
    stored as one column per codebook (``cb00``, ``cb01``, ...), so a reader
    that keeps the first k codebooks reads only k columns (Parquet column
    pruning), e.g. 8 of 16 at 12 kbps.  ``max_depth`` (the codebook count)
    saves the pass that would otherwise find it; a deeper row fails the write.

    ``split`` is a literal split name or the name of a column holding it.
    Only the partitions present in ``df`` are replaced.  Rows are
    clustered by ``key`` within each task (no shuffle unless
    ``files_per_partition`` asks for a range repartition).  ``bloom`` gives
    every row group a Bloom filter on ``key``.
    """
    out = df
    if "depth" not in out.columns:
        out = out.withColumn("depth", F.lit(1))
    depth = F.col("depth").cast("int")
    split_col = F.col(split) if isinstance(split, str) and split in df.columns else F.lit(split or "train")
    toks = F.col("tokens").cast("array<bigint>")
    if codebook_columns:
        depth_max = max_depth if max_depth is not None else (out.agg(F.max("depth")).first()[0] or 0)
        if depth_max > MAX_CODEBOOKS:
            raise ValueError(f"depth {depth_max} exceeds {MAX_CODEBOOKS} codebook columns")
        depth = F.when(depth > depth_max, F.raise_error(F.lit(f"a row is deeper than max_depth {depth_max}"))).otherwise(depth)
        # only the codebook columns are written; readers see tokens = null
        payload = [
            F.when(F.col("depth") > q, F.slice(toks, F.col("len") * q + 1, F.col("len"))).alias(c)
            for q, c in enumerate(CODEBOOK_COLUMNS[:depth_max])
        ]
    else:
        payload = [toks.alias("tokens")]  # codebook columns read back as null
    out = out.select(
        F.col("key").cast("string").alias("key"),
        depth.alias("depth"),
        F.col("len").cast("int").alias("len"),
        *payload,
        F.lit(stream).alias("stream"),
        F.lit(_bw(bandwidth)).alias("bandwidth"),
        split_col.cast("string").alias("split"),
    )
    if files_per_partition:
        out = out.repartitionByRange(files_per_partition, "split", "key")
    writer = out.sortWithinPartitions("split", "key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    writer.partitionBy(*PARTITIONS).parquet(root)
    return root


def read_token_store(
    spark: SparkSession,
    root: str,
    stream: str | None = None,
    split: str | None = None,
    bandwidth: float | None = None,
    keep: int | None = None,
    paths: list[str] | None = None,
) -> DataFrame:
    """Read the store; stream/split/bandwidth filters prune partitions.

    ``paths`` reads these partition folders or files of the store alone.

    ``tokens`` is always the flat codebook-major array.  Rows written with
    codebook columns are reassembled from them; with ``keep`` only the first
    ``keep`` codebook columns are read, so ``tokens`` holds ``keep * len``
    values (what the pairing join would cut to anyway).
    """
    raw = spark.read.schema(STORE_SCHEMA).option("basePath", root).parquet(*(paths or [root]))
    n = keep if keep is not None else MAX_CODEBOOKS
    from_books = F.flatten(F.filter(F.array(*[F.col(c) for c in CODEBOOK_COLUMNS[:n]]), lambda a: a.isNotNull()))
    flat = F.col("tokens") if keep is None else F.slice("tokens", 1, F.col("len") * keep)
    df = raw.select(
        "key", "depth", "len",
        F.coalesce(flat, from_books).alias("tokens"),
        *PARTITIONS,
    )
    if stream is not None:
        df = df.where(F.col("stream") == stream)
    if bandwidth is not None or stream == SEMANTIC:
        df = df.where(F.col("bandwidth") == _bw(bandwidth))
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def point_read(store: DataFrame, key: str) -> DataFrame:
    """Get one record by key (pushed down to the Parquet reader)."""
    return store.where(F.col("key") == key)


def store_layout(store: DataFrame) -> DataFrame:
    """Records and token counts per partition folder."""
    return store.groupBy(*PARTITIONS).agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("len").cast("bigint").alias("total_len")
    )
