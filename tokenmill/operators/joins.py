"""Joins: crop range join (J5), legacy size join (J3), vocabulary lookup.

Pairing (J1/J2) lives in :mod:`tokenmill.operators.assemble`; prediction
alignment (J6) in :mod:`tokenmill.operators.scoring`; nearest-centroid
search (J7/J8) in :mod:`tokenmill.operators.quantize`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions import constants as K

SPECIAL_SYMBOLS = K.SPECIAL_SYMBOLS
MAX_BROADCAST_ROWS = 1 << 20  # windows, or vocabulary symbols, that are brought to every task
SALTS = 16


def crop_range_join(
    ac: DataFrame,
    crops: DataFrame,
    keep: int = K.CODEC_DEPTH,
    max_source: int = K.MAX_SOURCE_POSITIONS,
    max_target: int = K.MAX_TARGET_POSITIONS,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Long-form aligned crop - the acoustic cells inside each window of each key.

    ``ac`` is the flat store; ``crops`` holds ``(key, crop_start)`` in
    semantic frames, any number of windows per key.  Gives ``(key,
    crop_start, q, t, t_out, code)`` for ``ac_start <= t < ac_start +
    max_target`` and the first ``keep`` codebooks.

    Intervals are cut from the arrays, and only then exploded: at most
    ``keep * max_target`` cells per window ever become rows.  Up to
    ``max_broadcast`` windows are brought to the streams, which stay where
    they are; beyond, streams are cut into tiles of ``max_target`` frames that
    cross one exchange as arrays, and a window meets the two tiles it overlaps.
    """
    start = F.expr(f"cast(crop_start * {max_target} div {max_source} as int)")
    windows = crops.select("key", "crop_start", start.alias("ac_start"))
    length = F.col("len")
    if crops.limit(max_broadcast + 1).count() <= max_broadcast:
        joined = ac.select("key", "len", "tokens").join(F.broadcast(windows), "key")
        first = F.greatest(F.col("ac_start"), F.lit(0))
        size = F.greatest(F.lit(0), F.least(F.col("ac_start") + max_target, length) - first)
        cut = [F.slice("tokens", length * q + first + 1, size) for q in range(keep)]
        found = joined.select("key", "crop_start", "ac_start", first.alias("__first"), F.posexplode(F.array(*cut)).alias("q", "__cells"))
    else:
        last = F.greatest(F.lit(0), F.floor((length - 1) / max_target).cast("int"))
        parts = ac.select("key", "len", F.explode(F.sequence(F.lit(0), last)).alias("tile"), "tokens")
        at = F.col("tile") * max_target
        size = F.greatest(F.lit(0), F.least(F.lit(max_target), length - at))
        cut = [F.slice("tokens", length * q + at + 1, size) for q in range(keep)]
        parts = parts.select("key", "tile", size.alias("__n"), F.array(*cut).alias("__books"))
        tile = F.floor(F.col("ac_start") / max_target).cast("int")
        over = windows.withColumn("tile", F.explode(F.array_distinct(F.array(tile, F.floor((F.col("ac_start") + max_target - 1) / max_target).cast("int")))))
        joined = parts.join(over, ["key", "tile"])
        first = F.greatest(F.col("ac_start"), at)
        size = F.greatest(F.lit(0), F.least(F.col("ac_start") + max_target, at + F.col("__n")) - first)
        whole = joined.select(
            "key", "crop_start", "ac_start", first.alias("__first"), (first - at).alias("__skip"), size.alias("__size"),
            F.posexplode("__books").alias("q", "__book"),
        )
        found = whole.withColumn("__cells", F.slice("__book", F.col("__skip") + 1, F.col("__size")))
    cells = found.select("key", "crop_start", "ac_start", "__first", "q", F.posexplode("__cells").alias("__i", "code"))
    t = F.col("__first") + F.col("__i")
    return cells.select("key", "crop_start", "q", t.alias("t"), (t - F.col("ac_start")).alias("t_out"), "code")


def size_join(kv: DataFrame, k: str = "k", size_suffix: str = "_size") -> DataFrame:
    """Re-associate legacy ``key`` records with their ``key_size`` records by name.

    Joining by key (not by position in a sorted scan) is immune to the
    byte-order interleaving of ``k10``/``k10_size``/``k1_size``.
    """
    is_size = F.col(k).endswith(size_suffix)
    data = kv.where(~is_size).select(F.col(k).alias("key"), F.col("len").alias("len"))
    sizes = kv.where(is_size).select(
        F.regexp_replace(F.col(k), f"{size_suffix}$", "").alias("key"), F.col("len").alias("size_len")
    )
    return data.join(sizes, "key", "inner")


def build_vocab(spark: SparkSession, n_symbols: int, nspecial: int = K.NSPECIAL) -> DataFrame:
    """J4 builder: ``symbol str(i) -> id i + nspecial`` plus the special symbols."""
    specials = spark.createDataFrame(list(zip(SPECIAL_SYMBOLS[:nspecial], range(nspecial))), "symbol string, id int")
    body = spark.range(n_symbols).select(F.col("id").cast("string").alias("symbol"), (F.col("id") + nspecial).cast("int").alias("id"))
    return specials.unionByName(body)


def target_vocab_size(codec_depth: int, codec_dim: int, configured: int | None = None) -> int:
    """Target vocabulary is inferred as depth * dim when the configured size disagrees."""
    inferred = codec_depth * codec_dim
    return inferred if configured != inferred else configured


def vocab_lookup(
    df: DataFrame, vocab: DataFrame, symbol: str = "symbol", out: str = "id", max_broadcast: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """J4 on one symbol per row; unknown symbols map to ``unk``.

    A vocabulary of up to ``max_broadcast`` rows is broadcast, a greater one
    joined by a shuffle in which a frequent symbol is spread over ``SALTS`` keys.
    """
    v = vocab.select(F.col("symbol").alias(symbol), F.col("id").alias(out))
    if vocab.limit(max_broadcast + 1).count() <= max_broadcast:
        joined = df.join(F.broadcast(v), symbol, "left")
    else:
        salt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(SALTS))
        salted = v.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        joined = df.withColumn("__salt", salt).join(salted.hint("merge"), [symbol, "__salt"], "left").drop("__salt")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(K.UNK)))


def vocab_lookup_arrays(
    df: DataFrame, vocab: DataFrame, symbols: str = "symbols", key: str = "key", out: str = "ids", max_broadcast: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """J4 on whole arrays of symbols: ``df`` with their ids in ``out``, in order.

    A vocabulary of up to ``max_broadcast`` rows becomes an Arrow dictionary in
    every task, and arrays are looked up by one gather over their flat values:
    no row per symbol, no exchange.  Beyond the bound, symbols are exploded,
    joined by a shuffle and put back together by ``key``, which must be unique
    there.  An unknown or null symbol maps to ``unk``; a null array stays null.
    """
    if vocab.limit(max_broadcast + 1).count() > max_broadcast:
        cells = df.where(F.col(symbols).isNotNull()).select(key, F.posexplode(symbols).alias("__p", "symbol"))
        found = vocab_lookup(cells, vocab, "symbol", "__id", max_broadcast)
        lists = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__p", "__id"))).alias("__ids"))
        ids = F.coalesce(F.transform("__ids", lambda x: x["__id"]), F.array().cast("array<int>"))
        joined = df.join(lists, key, "left")
        return joined.withColumn(out, F.when(F.col(symbols).isNotNull(), ids)).drop("__ids")
    words = vocab.select(F.col("symbol").cast("string").alias("symbol"), F.col("id").cast("int").alias("id")).toArrow()
    known = words.column("symbol").combine_chunks()
    if len(known) != len(known.unique()):
        raise ValueError("a vocabulary's symbols must be distinct")
    # the last place answers for symbols that are not in the dictionary
    ids_of = np.append(words.column("id").to_numpy(), K.UNK).astype(np.int32)
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(symbols)
            flat = lists.flatten()
            at = pc.index_in(flat.cast(known.type), value_set=known).fill_null(len(ids_of) - 1).to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            found = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids_of[at]), mask=lists.is_null()
            )
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), found], [f.name for f in schema.fields])

    return df.mapInArrow(work, schema)
