"""Inputs that must fail or be flagged rather than lose rows or tokens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.operators.assemble import codebook_truncate, crop_pair
from tokenmill.operators.encode import encode_job
from tokenmill.operators.quantize import _argmin, nearest_unit
from tokenmill.operators.scoring import local_drop, reduce_metrics, smoothed_nll
from tokenmill.sources.store import write_token_store


def test_row_deeper_than_max_depth_fails_the_write(spark, tmp_path):
    df = spark.createDataFrame([("k", 4, 2, list(range(8)))], "key string, depth int, len int, tokens array<bigint>")
    with pytest.raises(Exception, match="max_depth"):
        write_token_store(df, str(tmp_path / "store"), "acoustic", codebook_columns=True, max_depth=2)


def test_keep_above_stored_depth_fails(spark):
    df = spark.createDataFrame([("k", 2, [1, 2, 3, 4], [5, 6])], "key string, len_ac int, tokens array<bigint>, units array<bigint>")
    with pytest.raises(Exception, match="codebooks"):
        df.select(codebook_truncate("tokens", "len_ac", 4).alias("c")).collect()
    with pytest.raises(Exception, match="codebooks"):
        crop_pair(df, keep=4).collect()
    assert df.select(codebook_truncate("tokens", "len_ac", 2).alias("c")).first().c is not None


def test_frames_above_a_million_are_ranked_by_their_index(spark):
    n = (1 << 20) + 50
    df = spark.range(1).select(F.lit("k").alias("key"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.array(x + 1000)).alias("target"))
    got = local_drop(df, p=0.0).select(F.size("kept_frames").alias("n"), F.element_at("kept_frames", -1).alias("last")).first()
    assert tuple(got) == (n, n - 1)


def test_label_outside_the_classes_fails(spark):
    rows = [(0, 0, 0.1, 0), (0, 1, 0.2, 0), (1, 0, 0.3, 7), (1, 1, 0.4, 7)]
    df = spark.createDataFrame(rows, "pos int, class int, score double, target int")
    with pytest.raises(Exception, match="outside the classes"):
        smoothed_nll(df).collect()
    assert smoothed_nll(df.where("pos = 0")).first().n_positions == 1


def test_update_without_samples_has_no_loss(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 2.0, 0), (2, 0, 2.0, 2.0, 4)], "update int, worker int, loss double, nll_loss double, sample_size int")
    got = {(r["update"], r["metric"]): r["value"] for r in reduce_metrics(df).collect()}
    assert (1, "loss") not in got and got[(2, "loss")] is not None


def test_far_centroids_change_no_unit(spark):
    rng = np.random.default_rng(5)
    near = np.round(rng.normal(size=(40, 64)), 1)
    near[7] = near[3]  # a tie: the lower id is taken
    frames = np.concatenate([near + 1e-9 * rng.normal(size=near.shape), near])
    far = rng.normal(size=(2000, 64)) * 1e6 + 1e7  # 40 + 2,000 centroids: above 65,536 cells
    exact = ((frames[:, None, :] - near[None]) ** 2).sum(-1).argmin(1)
    assert (_argmin(frames, near) == exact).all()
    assert (_argmin(frames, np.concatenate([near, far])) == exact).all()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(frames)], "id long, v array<double>")
    books = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(np.concatenate([near, far]))], "cid int, c array<double>"
    )
    got = {r["id"]: r["unit"] for r in nearest_unit(rows, books).collect()}
    assert [got[i] for i in range(len(frames))] == exact.tolist()


def test_paired_encoding_rejects_a_third_encoder(spark):
    pieces = spark.createDataFrame([("k", [0.0], 16000, False)], "chunk_key string, samples array<float>, sr int, is_chunked boolean")
    with pytest.raises(ValueError, match="exactly these two"):
        encode_job(pieces, {"a": None, "b": None, "c": None}, paired=("a", "b"))


def test_kept_frames_are_the_frames_with_a_code_that_is_not_pad(spark):
    from tokenmill.operators.scoring import frame_mask, kept_frames, pad_to_batch

    rows = [(0, "a", [[5, 6], [1, 7], [1, 1]]), (0, "b", [[8, 1]]), (1, "c", [[1, 1]]), (1, "d", [])]
    df = pad_to_batch(spark.createDataFrame(rows, "batch_id int, key string, target array<array<bigint>>"), "target", "batch_id", 2, pad=1)
    got = sorted((r.batch_id, r.key, r.frame, r.codes) for r in kept_frames(df, pad=1).collect())
    want = [(b, k, t, c) for b, k, frames in rows for t, c in enumerate(frames) if any(x != 1 for x in c)]
    assert got == want == [(0, "a", 0, [5, 6]), (0, "a", 1, [1, 7]), (0, "b", 0, [8, 1])]
    assert {r.batch_id: r.n_kept for r in frame_mask(df, pad=1).collect()} == {0: 3, 1: 0}
