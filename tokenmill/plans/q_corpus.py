"""Registered queries for manifests, chunking, routing, decoding and encode jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.plans import fixtures as fx
from tokenmill.plans.oracle_views import add_view, u, with_views
from tokenmill.plans.registry import query
from tokenmill.session import scratch_path

add_view("ox_paths", ["fx_manifest"], "SELECT trim(path) AS path FROM fx_manifest")
add_view(
    "ox_pieces",
    ["fx_clips"],
    "SELECT key, n, sr, is_chunked, chunk_no, "
    "CASE WHEN NOT is_chunked THEN 0 WHEN chunk_no = k AND n - (k - 1) * C <> C THEN n - C ELSE (chunk_no - 1) * C END::BIGINT AS start, "
    "CASE WHEN is_chunked THEN C ELSE n END::BIGINT AS len FROM ("
    "SELECT *, unnest(range(1, n_pieces + 1)) AS chunk_no FROM ("
    "SELECT *, CASE WHEN n <= C THEN 1 WHEN n - (k - 1) * C < sr THEN k - 1 ELSE k END AS n_pieces FROM ("
    "SELECT key, n, sr, sr * 30 AS C, (n + sr * 30 - 1) // (sr * 30) AS k, n > sr * 30 AS is_chunked FROM fx_clips)))",
)
add_view(
    "ox_kept",
    ["ox_pieces"],
    "SELECT *, CASE WHEN is_chunked THEN key || chunk_no ELSE key END AS chunk_key FROM ox_pieces WHERE is_chunked OR n >= sr",
)


def _paths(spark, sf):
    return fx.fx_manifest(spark, sf).select(F.trim("path").alias("path"))


@query("manifest_scan")
def q_manifest_scan(spark, sf):
    from tokenmill.sources.manifest import manifest_scan

    return manifest_scan(spark, sf, ext="parquet")


@query(
    "split_train_valid",
    with_views("ox_paths") + f"SELECT path, CASE WHEN {u('split', 'path')} > 0.1 THEN 'train' ELSE 'valid' END AS subset FROM ox_paths",
)
def q_split_train_valid(spark, sf):
    from tokenmill.sources.manifest import split_train_valid

    return split_train_valid(_paths(spark, sf), 0.1)


@query(
    "manifest_write",
    with_views("ox_paths") + f"SELECT path, CASE WHEN {u('split', 'path')} > 0.1 THEN 'train' ELSE 'valid' END AS subset FROM ox_paths",
)
def q_manifest_write(spark, sf):
    from tokenmill.sources.manifest import manifest_read, manifest_write, split_train_valid

    dest = manifest_write(split_train_valid(_paths(spark, sf), 0.1), scratch_path(spark, "manifest"))
    return manifest_read(spark, dest).select("path", "subset")


@query("manifest_read", with_views("ox_paths") + "SELECT path FROM ox_paths")
def q_manifest_read(spark, sf):
    from tokenmill.sources.manifest import manifest_read

    dest = scratch_path(spark, "manifest-raw")
    fx.fx_manifest(spark, sf).write.mode("overwrite").text(dest)  # padded lines, as written by hand
    return manifest_read(spark, dest)


@query(
    "strided_shard",
    with_views("ox_paths")
    + "SELECT path, idx, (idx % 2)::INT AS worker, (idx // 2) // 16 AS batch_no FROM ("
    "SELECT path, (row_number() OVER (ORDER BY path) - 1)::BIGINT AS idx FROM ox_paths)",
)
def q_strided_shard(spark, sf):
    from tokenmill.operators.batching import strided_shard

    return strided_shard(_paths(spark, sf), "path", world_size=2, batch_size=16)


def _pieces(spark, sf):
    from tokenmill.operators.chunking import chunk_clips

    return chunk_clips(fx.fx_clips(spark, sf).select("key", "n", "sr"))


@query(
    "chunk_clips",
    with_views("ox_pieces") + "SELECT key, chunk_no::BIGINT AS chunk_no, start, len, is_chunked FROM ox_pieces",
)
def q_chunk_clips(spark, sf):
    return _pieces(spark, sf).select("key", "chunk_no", "start", "len", "is_chunked")


@query(
    "chunk_key",
    with_views("ox_pieces")
    + "SELECT CASE WHEN is_chunked THEN key || chunk_no ELSE key END AS chunk_key, key AS path, sr FROM ox_pieces",
)
def q_chunk_key(spark, sf):
    from tokenmill.operators.chunking import chunk_key

    return _pieces(spark, sf).select(chunk_key("key", "chunk_no", "is_chunked").alias("chunk_key"), F.col("key").alias("path"), "sr")


@query(
    "short_clip_filter",
    with_views("fx_clips") + "SELECT key, n, n > sr * 30 OR n >= sr AS kept FROM fx_clips",
)
def q_short_clip_filter(spark, sf):
    from tokenmill.operators.chunking import short_clip_filter

    pieces = short_clip_filter(_pieces(spark, sf))
    return pieces.where(F.col("chunk_no") == 1).select("key", "n", "kept")


@query(
    "route_batches",
    with_views("ox_kept")
    + "SELECT worker, batch_no, route, count(*) AS n_items, sum(len)::BIGINT AS n_samples FROM ("
    "SELECT p.*, CASE WHEN is_chunked THEN 'fixed' ELSE 'ragged' END AS route, (s.idx % 2)::INT AS worker, (s.idx // 2) // 16 AS batch_no "
    "FROM ox_kept p JOIN (SELECT key, (row_number() OVER (ORDER BY key) - 1)::BIGINT AS idx FROM fx_clips) s USING (key)) "
    "GROUP BY worker, batch_no, route",
)
def q_route_batches(spark, sf):
    from tokenmill.operators.batching import strided_shard
    from tokenmill.operators.chunking import route_batches, short_clip_filter

    shards = strided_shard(fx.fx_clips(spark, sf).select("key"), "key", world_size=2, batch_size=16)
    pieces = short_clip_filter(_pieces(spark, sf)).where("kept").join(shards.select("key", "worker", "batch_no"), "key")
    return route_batches(pieces, ["worker", "batch_no"])


@query(
    "micro_batch",
    with_views("ox_kept") + "SELECT chunk_key, ((row_number() OVER (ORDER BY chunk_key) - 1) // 128)::BIGINT AS micro_batch FROM ox_kept",
)
def q_micro_batch(spark, sf):
    from tokenmill.operators.batching import micro_batch
    from tokenmill.operators.chunking import chunk_key, short_clip_filter

    pieces = short_clip_filter(_pieces(spark, sf)).where("kept")
    keys = pieces.select(chunk_key("key", "chunk_no", "is_chunked").alias("chunk_key"))
    return micro_batch(keys, "chunk_key", 128)


@query(
    "chunk_union",
    with_views("ox_kept") + "SELECT chunk_key, CASE WHEN is_chunked THEN 'fixed' ELSE 'ragged' END AS route, len FROM ox_kept",
)
def q_chunk_union(spark, sf):
    from tokenmill.operators.chunking import chunk_key, chunk_union, short_clip_filter, split_routes

    pieces = short_clip_filter(_pieces(spark, sf)).where("kept")
    pieces = pieces.select(chunk_key("key", "chunk_no", "is_chunked").alias("chunk_key"), "is_chunked", "len")
    fixed, ragged = split_routes(pieces)
    out = chunk_union(fixed.withColumn("route", F.lit("fixed")), ragged.withColumn("route", F.lit("ragged")))
    return out.select("chunk_key", "route", "len")


# ---------------------------------------------------------------- WAV decode, mono contract, encode jobs


def wav_clips(spark, sf):
    """Documents as 8-bit PCM WAV files (text bytes are the samples, sr 100); doc_id % 7 = 0 is stereo."""
    from tokenmill.sources.audio import wav_bytes

    d = fx.table(spark, sf, "documents")
    ch = F.when(F.col("doc_id") % 7 == 0, F.lit(2)).otherwise(F.lit(1))
    pcm = F.encode("text", "UTF-8")
    # stereo frames need an even byte count: pad with one silent sample
    pcm = F.when((ch == 2) & (F.octet_length(pcm) % 2 == 1), F.concat(pcm, F.unhex(F.lit("80")))).otherwise(pcm)
    key = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".wav")))
    # the documents file has few row groups; spread the (Python-heavy) decode
    # and encode work over the session's width, deterministically by key
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return d.select(key.alias("key"), wav_bytes(pcm, F.lit(100), ch).alias("content")).repartition(width, "key")


add_view(
    "ox_wav",
    [],
    "SELECT concat_ws('/', source, lang, concat(doc_id, '.wav')) AS key, 100 AS sr, "
    "CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS n_channels, "
    "CASE WHEN doc_id % 7 = 0 THEN (octet_length(encode(text)) + 1) // 2 ELSE octet_length(encode(text)) END::BIGINT AS n_samples, text "
    "FROM documents",
)


@query("clip_load", with_views("ox_wav") + "SELECT key, sr, n_channels, n_samples FROM ox_wav")
def q_clip_load(spark, sf):
    from tokenmill.sources.audio import decode_wav

    return decode_wav(wav_clips(spark, sf), with_samples=False).select("key", "sr", "n_channels", "n_samples")


@query(
    "mono_contract",
    with_views("ox_wav")
    + "SELECT key, CASE WHEN n_channels = 1 THEN 'accepted' ELSE 'rejected' END AS status, "
    "CASE WHEN n_channels = 1 THEN NULL ELSE 'not_mono' END AS reason FROM ox_wav",
)
def q_mono_contract(spark, sf):
    from tokenmill.sources.audio import decode_wav, mono_contract

    return mono_contract(decode_wav(wav_clips(spark, sf), with_samples=False)).select("key", "status", "reason")


def _encoded(spark, sf, fail_mod=None):
    from tokenmill.operators.encode import encode_job, toy_acoustic, toy_semantic
    from tokenmill.sources.audio import decode_pieces

    pieces = decode_pieces(wav_clips(spark, sf)).where(F.col("reason").isNull())
    encoders = {"semantic": toy_semantic(2), "acoustic": toy_acoustic(4, 3, fail_when_len_mod=fail_mod)}
    return encode_job(pieces, encoders)


add_view(
    "ox_wpieces",
    ["ox_wav"],
    "SELECT key, n, sr, is_chunked, CASE WHEN is_chunked THEN C ELSE n END::BIGINT AS len, "
    "CASE WHEN is_chunked THEN least((chunk_no - 1) * C, n - C) ELSE 0 END::BIGINT AS start, bytes, "
    "CASE WHEN is_chunked THEN key || chunk_no ELSE key END AS chunk_key FROM ("
    "SELECT *, unnest(range(1, n_pieces + 1)) AS chunk_no FROM ("
    "SELECT *, CASE WHEN n <= C THEN 1 WHEN n - (k - 1) * C < sr THEN k - 1 ELSE k END AS n_pieces FROM ("
    "SELECT key, n_samples AS n, sr, sr * 30 AS C, (n_samples + sr * 30 - 1) // (sr * 30) AS k, n_samples > sr * 30 AS is_chunked, "
    "list_transform(range(0, n_samples), lambda i: ('0x' || h[2 * i + 1] || h[2 * i + 2])::INT) AS bytes "
    "FROM (SELECT *, string_split(hex(encode(text)), '') AS h FROM ox_wav WHERE n_channels = 1)))) WHERE is_chunked OR n >= sr",
)
# what the test encoders make of a piece's samples, in whole numbers
_B = "(CASE WHEN start + {i} < n THEN bytes[start + {i} + 1] ELSE 128 END)"
_UNITS = f"list_transform(range(0, len // 2), lambda t: (({_B.format(i='2 * t')} + {_B.format(i='2 * t + 1')}) * 1000 // 128) % 10000)"
_SUM3 = " + ".join(_B.format(i=f"3 * (j % (len // 3)) + {d}") for d in range(3))
_BASE = f"(abs({_SUM3} - 384) * 997 // 128)"
_CODES4 = f"list_transform(range(0, 4 * (len // 3)), lambda j: ({_BASE} * (j // (len // 3) + 1) + j // (len // 3)) % 1024)"


def _dg(x: str) -> str:
    return f"coalesce(list_sum(list_transform({x}, lambda v, i: v * i)), 0)::BIGINT"


@query(
    "encode_job",
    with_views("ox_wpieces")
    + f"SELECT chunk_key AS key, 'semantic' AS stream, 1 AS depth, (len // 2)::INT AS len, {_dg(_UNITS)} AS digest FROM ox_wpieces UNION ALL "
    f"SELECT chunk_key, 'acoustic', 4, (len // 3)::INT, {_dg(_CODES4)} FROM ox_wpieces",
)
def q_encode_job(spark, sf):
    from tokenmill.functions.arrays import digest

    return _encoded(spark, sf).select("key", "stream", "depth", "len", digest("tokens").alias("digest"))


@query(
    "quarantine_failures",
    with_views("ox_wpieces")
    + "SELECT chunk_key AS key, 'acoustic' AS stream, concat('RuntimeError: encoder failed on a clip of ', len, ' samples') AS error "
    "FROM ox_wpieces WHERE len % 13 = 0",
)
def q_quarantine_failures(spark, sf):
    from tokenmill.operators.encode import quarantine

    good, bad = quarantine(_encoded(spark, sf, fail_mod=13))
    return bad.select("key", "stream", "error")


@query(
    "encode_job_paired",
    with_views("ox_wpieces")
    + f"SELECT chunk_key AS key, (len // 2)::INT AS len_sem, 4 AS depth, (len // 3)::INT AS len_ac, {_dg(_UNITS)} AS units_digest, "
    f"{_dg(_CODES4)} AS tokens_digest FROM ox_wpieces",
)
def q_encode_job_paired(spark, sf):
    """D1 emitting both streams per row: J1 is a projection, no shuffle."""
    from tokenmill.functions.arrays import digest
    from tokenmill.operators.encode import encode_job, toy_acoustic, toy_semantic
    from tokenmill.sources.audio import decode_pieces

    pieces = decode_pieces(wav_clips(spark, sf)).where(F.col("reason").isNull())
    encoders = {"semantic": toy_semantic(2), "acoustic": toy_acoustic(4, 3)}
    out = encode_job(pieces, encoders, paired=("semantic", "acoustic")).where(F.col("error").isNull())
    return out.select("key", "len_sem", "depth", "len_ac", digest("units").alias("units_digest"), digest("tokens").alias("tokens_digest"))
