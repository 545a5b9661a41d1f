"""Sources and sinks: WAV decode on standard-library files, manifests, blobs, store."""

import os
import struct
import tempfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.operators.chunking import chunk_clips, short_clip_filter
from tokenmill.session import scratch_path
from tokenmill.sources.audio import clip_load, mono_contract
from tokenmill.sources.blobs import decode_blobs, encode_blobs
from tokenmill.sources.manifest import manifest_read, manifest_scan, manifest_write, split_train_valid
from tokenmill.sources.store import point_read, read_token_store, write_token_store


def _wav(path, seconds, channels, sr=16000):
    n = int(seconds * sr)
    data = (np.arange(n * channels) % 200 - 100).astype("<i2").tobytes()
    with wave.open(path, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes(data)


def test_wav_decode_mono_contract_and_chunks(spark):
    d = tempfile.mkdtemp(prefix="tm-wav-")
    os.makedirs(os.path.join(d, "sub"))
    specs = {"mono_half.wav": (0.5, 1), "stereo.wav": (2, 2), "sub/m30.wav": (30, 1), "sub/m61.wav": (61, 1)}
    for name, (s, ch) in specs.items():
        _wav(os.path.join(d, name), s, ch)
    dec = mono_contract(clip_load(spark, d))
    rows = {os.path.basename(r.key): r for r in dec.collect()}
    assert rows["stereo.wav"].status == "rejected" and rows["stereo.wav"].reason == "not_mono"
    assert rows["m61.wav"].n_samples == 61 * 16000 and rows["m61.wav"].sr == 16000
    ok = dec.where("status = 'accepted'").select("key", F.col("n_samples").alias("n"), "sr", "samples")
    pieces = short_clip_filter(chunk_clips(ok, samples="samples")).where("kept")
    per = {os.path.basename(r.key): r["count"] for r in pieces.groupBy("key").count().collect()}
    assert per == {"m30.wav": 1, "m61.wav": 3}  # 0.5 s dropped, 61 s tail back-aligned
    listed = manifest_scan(spark, d, ext="wav").count()
    assert listed == 4
    from tokenmill.sources.audio import decode_pieces

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(d).select(F.col("path").alias("key"), "content")
    fused = decode_pieces(files).collect()
    kept = {}
    for r in fused:
        if r.reason is None:
            kept[os.path.basename(r.key)] = kept.get(os.path.basename(r.key), 0) + 1
            assert len(r.samples) == r.len == 30 * 16000
    assert kept == per
    assert {os.path.basename(r.key): r.reason for r in fused if r.reason} == {"stereo.wav": "not_mono", "mono_half.wav": "too_short"}


def test_manifest_round_trip(spark):
    df = spark.createDataFrame([(f"  /a/{i}.flac \t",) for i in range(50)], "path string")
    dest = scratch_path(spark, "t-manifest")
    df.write.text(dest)
    back = manifest_read(spark, dest)
    assert sorted(r.path for r in back.collect()) == sorted(f"/a/{i}.flac" for i in range(50))
    split = split_train_valid(back, 0.3)
    out = manifest_read(spark, manifest_write(split, scratch_path(spark, "t-split")))
    assert out.count() == 50 and set(r.subset for r in out.select("subset").distinct().collect()) <= {"train", "valid"}


def test_blob_round_trip(spark):
    df = spark.createDataFrame([("a", [1, -2, 3 << 40]), ("b", [])], "key string, tokens array<bigint>")
    back = {r.key: list(r.tokens) for r in decode_blobs(encode_blobs(df)).collect()}
    assert back == {"a": [1, -2, 3 << 40], "b": []}
    raw = struct.pack("<3q", 1, -2, 3 << 40)
    assert encode_blobs(df).where("key = 'a'").first().blob == raw


def test_store_overwrite_and_point_read(spark):
    root = scratch_path(spark, "t-store")
    a = spark.createDataFrame([(f"k{i}", 3, [i, i, i]) for i in range(20)], "key string, len int, tokens array<bigint>")
    write_token_store(a, root, "semantic", split="train")
    write_token_store(a.limit(5), root, "semantic", split="valid")
    write_token_store(a.where("key = 'k1'").withColumn("len", F.lit(9)), root, "semantic", split="valid")
    store = read_token_store(spark, root, stream="semantic")
    assert store.where("split = 'train'").count() == 20
    assert [r.len for r in store.where("split = 'valid'").collect()] == [9]  # only that partition replaced
    assert point_read(read_token_store(spark, root), "k7").first().tokens == [7, 7, 7]


def test_tokenize_corpus_end_to_end(spark):
    from tokenmill.operators.assemble import assemble_rows
    from tokenmill.operators.encode import toy_acoustic, toy_semantic
    from tokenmill.plans.flows import load_streams, tokenize_corpus, training_batches

    d = tempfile.mkdtemp(prefix="tm-e1-")
    for name, (sec, ch) in {"a.wav": (2, 1), "b.wav": (40, 1), "s.wav": (1, 2), "t.wav": (0.5, 1)}.items():
        _wav(os.path.join(d, name), sec, ch, sr=300)
    store = scratch_path(spark, "t-e1-store")
    enc = {"semantic": toy_semantic(2), "acoustic": toy_acoustic(4, 3)}
    report = {(os.path.basename(r.key), r.stage, r.reason) for r in tokenize_corpus(spark, d, enc, store, bandwidth=3.0).collect()}
    assert report == {("s.wav", "decode", "not_mono"), ("t.wav", "decode", "too_short")}
    sem, ac = load_streams(spark, store, "train", 3.0, keep=2)
    keys = sorted(os.path.basename(r.key) for r in sem.collect())
    assert keys == ["a.wav", "b.wav1", "b.wav2"]  # 0.5 s dropped; 40 s -> 30 s + back-aligned tail
    row = ac.where(F.col("key").endswith("a.wav")).first()
    assert row.depth == 4 and len(row.tokens) == 2 * row.len == 2 * (600 // 3)
    assert assemble_rows(sem, ac, keep=2).count() == 3
    assert training_batches(sem, ac).count() >= 1


def test_tokenize_corpus_valid_split_keeps_clips_whole(spark):
    from tokenmill.operators.encode import toy_acoustic, toy_semantic
    from tokenmill.plans.flows import tokenize_corpus
    from tokenmill.sources.store import read_token_store

    d = tempfile.mkdtemp(prefix="tm-e1s-")
    for i in range(12):
        _wav(os.path.join(d, f"c{i}.wav"), 40, 1, sr=100)  # two chunks each
    store = scratch_path(spark, "t-e1s-store")
    enc = {"semantic": toy_semantic(2), "acoustic": toy_acoustic(2, 3)}
    tokenize_corpus(spark, d, enc, store, bandwidth=1.5, valid_percent=0.5)
    rows = read_token_store(spark, store, stream="semantic").select("key", "split").collect()
    by_clip = {}
    for r in rows:
        by_clip.setdefault(os.path.basename(r.key)[:-1], set()).add(r.split)
    assert len(rows) == 24 and all(len(v) == 1 for v in by_clip.values())
    assert {s for v in by_clip.values() for s in v} == {"train", "valid"}


def test_tokens_of_the_files_that_a_manifest_names(spark):
    from tokenmill.operators.encode import toy_acoustic, toy_semantic
    from tokenmill.plans.flows import load_streams, tokenize_corpus

    d = tempfile.mkdtemp(prefix="tm-e1m-")
    for i in range(6):
        _wav(os.path.join(d, f"c{i}.wav"), 2 if i else 0.2, 1, sr=100)
    with open(os.path.join(d, "bad.wav"), "wb") as f:
        f.write(b"not audio")
    named = [(os.path.join(d, f"{n}.wav"), s) for n, s in [("c0", "train"), ("c1", "train"), ("c2", "valid"), ("c3", "train"), ("bad", "train"), ("gone", "train")]]
    rows = spark.createDataFrame(named, "path string, subset string")
    written = manifest_write(rows, scratch_path(spark, "t-e1m-manifest"))
    enc = {"semantic": toy_semantic(2), "acoustic": toy_acoustic(4, 3)}
    for manifest in (rows, written):
        store = scratch_path(spark, "t-e1m-store")
        report = {(os.path.basename(r.key), r.stage): r.reason for r in tokenize_corpus(spark, None, enc, store, bandwidth=3.0, manifest=manifest).collect()}
        assert set(report) == {("c0.wav", "decode"), ("bad.wav", "decode"), ("gone.wav", "decode")}
        assert report[("c0.wav", "decode")] == "too_short"
        assert report[("bad.wav", "decode")].startswith("decode_error") and report[("gone.wav", "decode")].startswith("read_error")
        store_rows = read_token_store(spark, store, stream="acoustic", bandwidth=3.0).collect()
        assert {(os.path.basename(r.key), r.split) for r in store_rows} == {("c1.wav", "train"), ("c2.wav", "valid"), ("c3.wav", "train")}
        # a training split is not read in shards, and not with more codebooks than are stored
        assert load_streams(spark, store, "train", 3.0, keep=4)[0].count() == 2
        with pytest.raises(ValueError, match="depth"):
            load_streams(spark, store, "train", 3.0, keep=8)
        with pytest.raises(ValueError, match="sharded"):
            load_streams(spark, store, "train", 3.0, keep=4, num_shards=2)
    with pytest.raises(ValueError, match="folder, or of a manifest"):
        tokenize_corpus(spark, d, enc, store, manifest=rows)


def test_headers_are_read_without_the_samples(spark):
    from tokenmill.sources.audio import HEADER_BYTES, decode_wav

    d = tempfile.mkdtemp(prefix="tm-head-")
    for name, sec, ch in (("a", 3, 1), ("b", 9, 2), ("c", 0, 1)):
        _wav(os.path.join(d, f"{name}.wav"), sec, ch)
    assert os.path.getsize(os.path.join(d, "b.wav")) > 4 * HEADER_BYTES
    with open(os.path.join(d, "x.wav"), "wb") as f:
        f.write(b"RIFF")
    files = spark.read.format("binaryFile").load(d).select(F.col("path").alias("key"), "content")
    cols = ["key", "sr", "n_channels", "sample_width", "n_samples"]
    whole, heads = decode_wav(files), decode_wav(files, with_samples=False)
    assert sorted(map(tuple, whole.select(*cols).collect()), key=str) == sorted(map(tuple, heads.select(*cols).collect()), key=str)
    assert heads.where("samples is not null").count() == 0 and heads.where("error is not null").count() == 1
