"""Encode-job contract, quarantine, padding masks and shard merge."""

import numpy as np
from pyspark.sql import functions as F

from tokenmill.operators.encode import encode_job, quarantine
from tokenmill.operators.features import pad_to_multiple
from tokenmill.operators.shards import shard_merge


def _pieces(spark, lens, chunked):
    rows = [(f"k{i}", [float(j % 7) for j in range(n)], 100, chunked) for i, n in enumerate(lens)]
    return spark.createDataFrame(rows, "chunk_key string, samples array<float>, sr int, is_chunked boolean")


def test_encoder_loaded_once_per_task_and_failures_isolated(spark):
    def factory():
        calls = {"n": 0}

        def fn(waves, rates):
            calls["n"] += 1
            if any(len(w) == 13 for w in waves):
                raise RuntimeError("bad clip")
            return {"tokens": [np.arange(len(w) // 2) for w in waves]}

        return fn

    # one failing member inside a rectangular micro-batch of equal-length pieces
    pieces = _pieces(spark, [13, 20, 20, 20], chunked=False).unionByName(_pieces(spark, [30] * 5, chunked=True))
    out = encode_job(pieces.coalesce(1), {"semantic": factory})
    good, bad = quarantine(out)
    assert [r.key for r in bad.collect()] == ["k0"]
    assert good.count() == 8
    assert {r.len for r in good.collect()} == {10, 15}


def test_pad_to_multiple_mask(spark):
    df = spark.createDataFrame(
        [("a", 0, [1, 2, 3]), ("b", 0, [1]), ("c", 1, [5, 5]), ("d", 1, [6, 6])],
        "key string, b int, x array<bigint>",
    )
    r = {row.key: row for row in pad_to_multiple(df, "x", "b").collect()}
    assert list(r["a"].padded) == [1, 2, 3, 1] and list(r["b"].padded) == [1, 1, 1, 1]
    assert list(r["b"].padding_mask) == [False, True, True, True]
    assert r["c"].padding_mask is None and r["d"].padding_mask is None  # nothing padded in batch 1


def test_shard_merge_last_writer_wins(spark):
    df = spark.createDataFrame([(0, "x", 1), (3, "x", 4), (1, "y", 2), (2, "x", 3)], "worker int, key string, len int")
    got = {r.key: (r.worker, r.len) for r in shard_merge(df).collect()}
    assert got == {"x": (3, 4), "y": (1, 2)}


def test_unpaired_keys_both_ways(spark):
    from tokenmill.operators.assemble import unpaired_keys

    s = spark.createDataFrame([("a",), ("b",)], "key string")
    a = spark.createDataFrame([("b",), ("c",)], "key string")
    got = sorted((r.key, r.missing_from) for r in unpaired_keys(s, a).collect())
    assert got == [("a", "acoustic"), ("c", "semantic")]


def test_paired_rows_equal_join(spark):
    from tokenmill.operators.assemble import pair_streams
    from tokenmill.operators.encode import paired_rows, toy_acoustic, toy_semantic

    pieces = _pieces(spark, [30, 31, 40, 13], chunked=False)
    enc = encode_job(pieces, {"semantic": toy_semantic(2), "acoustic": toy_acoustic(4, 3, fail_when_len_mod=13)})
    good, _ = quarantine(enc)
    sem = good.where("stream = 'semantic'").select("key", "len", F.col("tokens").alias("units"))
    ac = good.where("stream = 'acoustic'").select("key", "depth", "len", "tokens")
    cols = ["key", "len_sem", "units", "depth", "len_ac", "tokens"]
    joined = sorted(tuple(map(str, r)) for r in pair_streams(sem, ac).select(*cols).collect())
    paired = sorted(tuple(map(str, r)) for r in paired_rows(enc).select(*cols).collect())
    assert paired == joined and len(paired) == 3


def test_paired_encode_needs_no_join(spark):
    from tokenmill.operators.encode import paired_rows, toy_acoustic, toy_semantic

    pieces = _pieces(spark, [30, 31, 40, 13], chunked=False)
    enc = {"semantic": toy_semantic(2), "acoustic": toy_acoustic(4, 3, fail_when_len_mod=13)}
    wide = encode_job(pieces, enc, paired=("semantic", "acoustic"))
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    cols = ["key", "len_sem", "units", "depth", "len_ac", "tokens"]
    got = sorted(tuple(map(str, r)) for r in wide.where("error is null").select(*cols).collect())
    ref = sorted(tuple(map(str, r)) for r in paired_rows(encode_job(pieces, enc)).select(*cols).collect())
    assert got == ref and len(got) == 3
    assert [r.key for r in wide.where("error is not null").collect()] == ["k3"]


def test_score_report_matches_separate_operators(spark):
    from tokenmill.operators.scoring import argmax_predictions, masked_accuracy, prediction_align, smoothed_nll
    from tokenmill.plans import fixtures as fx
    from tokenmill.plans.flows import score_report

    s = fx.fx_scores(spark, "/root/testdata/sf0.001")
    report = {r.metric: r.value for r in score_report(s).collect()}
    labels = s.where("class = 0").select("pos", "target", "keep")
    acc = masked_accuracy(prediction_align(argmax_predictions(s), labels.select("pos", "target"), labels.where("keep"))).first()
    nll = smoothed_nll(s, mask=labels.where("keep"), epsilon=0.1).first()
    assert abs(report["accuracy"] - 100.0 * acc.n_correct / acc.total) < 1e-9
    assert report["nll_loss"] == nll.nll_loss and report["loss"] == nll.loss
