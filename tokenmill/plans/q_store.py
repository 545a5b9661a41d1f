"""Registered queries for the partitioned token store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.plans import fixtures as fx
from tokenmill.plans.oracle_views import add_view, u, with_views
from tokenmill.plans.registry import query
from tokenmill.session import scratch_path

SPLIT = f"CASE WHEN {u('split', 'key')} > 0.1 THEN 'train' ELSE 'valid' END"

add_view(
    "ox_store",
    ["fx_sem", "fx_ac"],
    f"SELECT 'semantic' AS stream, 'na' AS bandwidth, {SPLIT} AS split, key, 1 AS depth, len, units AS tokens FROM fx_sem "
    f"UNION ALL SELECT 'acoustic', '3', {SPLIT}, key, depth, len, tokens FROM fx_ac",
)


def _dg(x: str) -> str:
    return f"coalesce(list_sum(list_transform({x}, lambda v, i: v * i)), 0)::BIGINT"


def _write_store(spark, sf, root=None):
    from tokenmill.sources.manifest import split_train_valid
    from tokenmill.sources.store import ACOUSTIC, SEMANTIC, write_token_store

    root = root or scratch_path(spark, "store")
    sem = split_train_valid(fx.fx_sem(spark, sf).select("key", "len", F.col("units").alias("tokens")), 0.1, path="key")
    ac = split_train_valid(fx.fx_ac(spark, sf), 0.1, path="key")
    write_token_store(sem, root, SEMANTIC, split="subset")
    write_token_store(ac, root, ACOUSTIC, split="subset", bandwidth=3.0, codebook_columns=True, max_depth=4)
    return root


@query(
    "token_store_write",
    with_views("ox_store") + f"SELECT stream, key, depth, len, {_dg('tokens')} AS digest FROM ox_store",
)
def q_token_store_write(spark, sf):
    from tokenmill.functions.arrays import digest
    from tokenmill.sources.store import read_token_store

    store = read_token_store(spark, _write_store(spark, sf))
    return store.select("stream", "key", "depth", "len", digest("tokens").alias("digest"))


@query(
    "token_store_read",
    with_views("ox_store")
    + f"SELECT key, depth, len, len(tokens)::INT AS n_tokens, {_dg('tokens')} AS digest FROM ox_store WHERE stream = 'acoustic' AND split = 'train'",
)
def q_token_store_read(spark, sf):
    from tokenmill.functions.arrays import digest
    from tokenmill.sources.store import read_token_store

    store = read_token_store(spark, _write_store(spark, sf), stream="acoustic", split="train", bandwidth=3.0)
    return store.select("key", "depth", "len", F.size("tokens").alias("n_tokens"), digest("tokens").alias("digest"))


@query(
    "token_blob_decode",
    with_views("fx_sem") + f"SELECT key, (8 * len)::INT AS n_bytes, 1 AS depth, len, {_dg('units')} AS digest FROM fx_sem",
)
def q_token_blob_decode(spark, sf):
    from tokenmill.functions.arrays import digest
    from tokenmill.sources.blobs import decode_blobs, encode_blobs

    blobs = encode_blobs(fx.fx_sem(spark, sf), tokens="units")
    sizes = blobs.select("key", F.octet_length("blob").alias("n_bytes"))
    back = decode_blobs(blobs)
    return back.join(sizes, "key").select("key", "n_bytes", "depth", "len", digest("tokens").alias("digest"))


@query(
    "store_layout",
    with_views("ox_store")
    + "SELECT stream, bandwidth, split, count(*) AS n_keys, sum(len)::BIGINT AS total_len FROM ox_store GROUP BY ALL",
)
def q_store_layout(spark, sf):
    from tokenmill.sources.store import read_token_store, store_layout

    return store_layout(read_token_store(spark, _write_store(spark, sf)))


@query(
    "store_overwrite",
    with_views("ox_store")
    + "SELECT stream, bandwidth, split, count(*) AS n_keys, "
    "(sum(len) + CASE WHEN stream = 'semantic' AND split = 'valid' THEN 1000 * count(*) ELSE 0 END)::BIGINT AS total_len "
    "FROM ox_store GROUP BY stream, bandwidth, split",
)
def q_store_overwrite(spark, sf):
    from tokenmill.sources.store import SEMANTIC, read_token_store, store_layout, write_token_store

    root = _write_store(spark, sf)
    valid = read_token_store(spark, root, stream=SEMANTIC, split="valid")
    # rewrite one partition from a materialised copy (source and target must not overlap)
    redo = valid.select("key", (F.col("len") + 1000).alias("len"), "tokens").checkpoint(eager=True)
    write_token_store(redo, root, SEMANTIC, split="valid")
    return store_layout(read_token_store(spark, root))


@query(
    "store_stats",
    with_views("ox_store")
    + "SELECT stream, split, count(*) AS n_samples, min(len) AS min_len, max(len) AS max_len, sum(len)::BIGINT AS total_len "
    "FROM ox_store GROUP BY ALL",
)
def q_store_stats(spark, sf):
    from tokenmill.operators.aggregates import store_stats
    from tokenmill.sources.store import read_token_store

    return store_stats(read_token_store(spark, _write_store(spark, sf)))


@query(
    "depth_check",
    with_views("fx_ac") + "SELECT 'acoustic' AS stream, min(depth) AS min_depth, max(depth) AS max_depth, "
    "min(depth) = max(depth) AND min(depth) >= 2 AS ok FROM fx_ac",
)
def q_depth_check(spark, sf):
    from tokenmill.operators.aggregates import depth_check
    from tokenmill.sources.store import read_token_store

    store = read_token_store(spark, _write_store(spark, sf), stream="acoustic")
    return depth_check(store, codec_depth=2)


@query(
    "token_store_read_kept",
    with_views("ox_store")
    + "SELECT key, len, (2 * len)::INT AS n_tokens, "
    "coalesce(list_sum(list_transform(list_slice(tokens, 1, 2 * len), lambda v, i: v * i)), 0)::BIGINT AS digest "
    "FROM ox_store WHERE stream = 'acoustic'",
)
def q_token_store_read_kept(spark, sf):
    """S6 reading the first 2 of 4 codebooks: only two codebook columns are scanned."""
    from tokenmill.functions.arrays import digest
    from tokenmill.sources.store import read_token_store

    store = read_token_store(spark, _write_store(spark, sf), stream="acoustic", bandwidth=3.0, keep=2)
    return store.select("key", "len", F.size("tokens").alias("n_tokens"), digest("tokens").alias("digest"))


def _published(spark, sf):
    """Both streams published together, then the semantic valid split published anew."""
    from tokenmill.sources.manifest import split_train_valid
    from tokenmill.sources.publish import publish_streams, read_published

    root = scratch_path(spark, "published")
    sem = split_train_valid(fx.fx_sem(spark, sf).select("key", "len", F.col("units").alias("tokens")), 0.1, path="key")
    ac = split_train_valid(fx.fx_ac(spark, sf), 0.1, path="key")
    streams = [
        {"df": sem, "stream": "semantic", "split": "subset"},
        {"df": ac, "stream": "acoustic", "split": "subset", "bandwidth": 3.0, "codebook_columns": True, "max_depth": 4},
    ]
    publish_streams(spark, root, streams, files=8)
    valid = read_published(spark, root, "semantic", "valid").select("key", (F.col("len") + 1000).alias("len"), "tokens")
    publish_streams(spark, root, [{"df": valid, "stream": "semantic", "split": "valid"}], files=2)
    return root


@query(
    "publish_streams",
    with_views("ox_store")
    + "SELECT stream, bandwidth, split, key, (len + CASE WHEN stream = 'semantic' AND split = 'valid' THEN 1000 ELSE 0 END)::INT AS len, "
    f"{_dg('tokens')} AS digest FROM ox_store",
)
def q_publish_streams(spark, sf):
    """S9 for several streams: one pointer for both, partitions replaced alone."""
    from tokenmill.functions.arrays import digest
    from tokenmill.sources.publish import read_published

    store = read_published(spark, _published(spark, sf))
    return store.select("stream", "bandwidth", "split", "key", "len", digest("tokens").alias("digest"))


@query(
    "point_read",
    with_views("ox_store")
    + f"SELECT key, depth, len, {_dg('tokens')} AS digest FROM ox_store WHERE stream = 'acoustic' AND key IN ("
    "SELECT min(key) FROM ox_store UNION ALL SELECT max(key) FROM ox_store)",
)
def q_point_read(spark, sf):
    """S6 by key: the least and the greatest key of the corpus, out of the files that may hold them."""
    from tokenmill.functions.arrays import digest
    from tokenmill.sources.publish import point_read_published

    root = _published(spark, sf)
    ends = fx.fx_sem(spark, sf).agg(F.min("key"), F.max("key")).first()
    found = point_read_published(spark, root, list(ends), "acoustic", bandwidth=3.0)
    return found.select("key", "depth", "len", digest("tokens").alias("digest"))
