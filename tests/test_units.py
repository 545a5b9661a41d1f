"""Boundary units for chunking, cropping, dedupe, encoding and local drop."""

import pytest
from pyspark.sql import functions as F

from tokenmill.functions.arrays import dedupe_consecutive, run_lengths
from tokenmill.operators.assemble import (
    aligned_crop,
    codebook_truncate,
    lm_interleave,
    source_encode,
    depth_tile,
    target_encode,
)
from tokenmill.operators.chunking import chunk_clips, chunk_key, short_clip_filter
from tokenmill.operators.scoring import local_drop, target_unoffset


def pieces_expected(n, sr=100, chunk_s=30):
    """Reference semantics, written out: split into C-sized pieces, fix up the tail."""
    C = chunk_s * sr
    if n <= C:
        return [(1, 0, n, False)] if n >= sr else []
    k = -(-n // C)
    tail = n - (k - 1) * C
    out = [(i + 1, i * C, C, True) for i in range(k - 1)]
    if tail >= sr:
        out.append((k, n - C if tail != C else (k - 1) * C, C, True))
    return out


@pytest.mark.parametrize("n", [0, 99, 100, 2999, 3000, 3001, 3099, 3100, 5999, 6000, 6001])
def test_chunk_boundaries(spark, n):
    df = spark.createDataFrame([("a.flac", n, 100)], "key string, n long, sr int")
    got = short_clip_filter(chunk_clips(df)).where("kept")
    rows = sorted((r.chunk_no, r.start, r.len, r.is_chunked) for r in got.collect())
    assert rows == pieces_expected(n)
    keys = [r.k for r in got.select(chunk_key("key", "chunk_no", "is_chunked").alias("k")).collect()]
    if rows and rows[0][3]:
        assert sorted(keys) == sorted(f"a.flac{i}" for i in range(1, len(rows) + 1))


@pytest.mark.parametrize("n", [0, 99, 100, 2999, 3000, 3001, 3099, 3100, 5999, 6000, 6001])
def test_chunk_samples_agrees_with_plan(spark, n):
    from tokenmill.operators.chunking import chunk_samples

    df = spark.createDataFrame([("a", 100, [float(i) for i in range(n)])], "key string, sr int, samples array<float>")
    got = sorted((r.chunk_no, r.start, r.len, r.is_chunked, r.samples[0] if r.samples else None) for r in chunk_samples(df).collect())
    assert [g[:4] for g in got] == pieces_expected(n)
    assert all(g[4] == float(g[1]) for g in got)


def test_chunk_samples_are_sliced(spark):
    df = spark.createDataFrame([("a", 250, 10, list(map(float, range(250))))], "key string, n long, sr int, s array<double>")
    got = chunk_clips(df, chunk_s=10, samples="s").orderBy("chunk_no").collect()
    assert [r.s[0] for r in got] == [0.0, 100.0, 150.0]  # last piece back-aligned
    assert all(len(r.s) == 100 for r in got)


@pytest.mark.parametrize("arr", [[], [5], [3, 3, 3], [1, 2, 1, 2], [1, 1, 2, 2, 2, 1]])
def test_dedupe_and_run_lengths(spark, arr):
    df = spark.createDataFrame([(arr,)], "a array<bigint>")
    r = df.select(dedupe_consecutive("a").alias("d"), run_lengths("a").alias("l")).first()
    expect_d, expect_l = [], []
    for x in arr:
        if expect_d and expect_d[-1] == x:
            expect_l[-1] += 1
        else:
            expect_d.append(x)
            expect_l.append(1)
    assert list(r.d) == expect_d and list(r.l) == expect_l
    assert sum(r.l) == len(arr)


@pytest.mark.parametrize("len_s", [1, 650, 651, 1300])
def test_aligned_crop_boundaries(spark, len_s):
    la = len_s * 3 // 2 - 7  # acoustic stream shorter than 1.5 x semantic
    units = list(range(len_s))
    codes = [[t, t + 1] for t in range(max(la, 0))]
    df = spark.createDataFrame([("k", units, codes)], "key string, units array<bigint>, codes array<array<bigint>>")
    r = aligned_crop(df).first()
    start = r.crop_start
    assert 0 <= start <= max(0, len_s - 650)
    if len_s <= 650:
        assert start == 0
    assert list(r.units) == units[start : start + 650]
    a = start * 975 // 650
    assert [list(x) for x in r.codes] == codes[a : a + 975]


def test_encoding_properties(spark):
    L, d = 5, 2
    flat = [q * 100 + t for q in range(4) for t in range(L)]  # 4 stored codebooks
    df = spark.createDataFrame([("k", [7, 7, 9], flat)], "key string, units array<bigint>, tokens array<bigint>")
    r = df.select(
        codebook_truncate("tokens", F.lit(L), d).alias("codes"),
        source_encode("units").alias("src"),
    ).select(
        "codes",
        "src",
        target_encode("codes", d).alias("tgt"),
        depth_tile("src", d).alias("source"),
    ).select("*", lm_interleave("source", "tgt", d).alias("row"), target_unoffset("tgt").alias("labels")).first()
    assert [list(x) for x in r.codes] == [[t, 100 + t] for t in range(L)]
    assert list(r.src) == [11, 11, 13, 2]
    assert len(r.row) == 1 + (len(r.src) - 1) + 1 + L  # 1 + Ls + 1 + La
    assert list(r.row[0]) == [2, 1]
    assert [list(x) for x in r.labels] == [[t + 4, 100 + t + 4] for t in range(L)] + [[2, 2]]  # P19 . P15 = id + nspecial


@pytest.mark.parametrize("p", [0.1, 0.5, 0.999])
@pytest.mark.parametrize("n", [1, 2, 975])
def test_local_drop_counts(spark, p, n):
    frames = [[5, 6]] * n + [[1, 1]] * 3  # three pad frames rank last
    df = spark.createDataFrame([("k", frames)], "key string, target array<array<bigint>>")
    r = local_drop(df, "target", p=p).first()
    from decimal import Decimal

    keep = int((Decimal(n) * (1 - Decimal(str(p))) + 1) // 1)
    assert len(r.kept_frames) == min(n, keep) >= 1
    assert all(t < n for t in r.kept_frames)
