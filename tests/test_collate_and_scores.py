"""Collated batches, array-native scoring, tiled codebooks, published streams and array lookups against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.functions import constants as K
from tokenmill.operators import collate as C
from tokenmill.operators.batching import batch_plan, token_budget_batches
from tokenmill.operators.joins import build_vocab, crop_range_join, vocab_lookup_arrays
from tokenmill.operators.quantize import nearest_unit, residual_codes, residual_codes_tiled
from tokenmill.operators.score_rows import (
    component_metrics,
    logging_output,
    position_scores,
    reduce_metric_maps,
    sample_classes,
    sum_logs,
    to_score_rows,
    top_classes,
)

# ---------------------------------------------------------------- collate


def _samples(rng, n, depth):
    out = []
    for i in range(n):
        labels = [rng.randrange(4, 90) for _ in range(rng.randrange(0, 9))] + [K.EOS]
        target = [[rng.randrange(4, 90) for _ in range(depth)] for _ in range(rng.randrange(0, 7))] + [[K.EOS] * depth]
        src = [[K.EOS] + [K.PAD] * (depth - 1)] + [[x] + [K.PAD] * (depth - 1) for x in labels[:-1]] + target[-1:] + target[:-1]
        out.append((i // 5, f"k{rng.randrange(10**6):06d}-{i}", src, target, labels, len(labels), len(target)))
    return out


COLUMNS = (
    "batch_id bigint, key string, src_tokens array<array<bigint>>, target array<array<bigint>>, src_labels array<bigint>, "
    "src_length int, target_length int"
)


def _padded(rows, depth, pad=K.PAD):
    out = np.full((len(rows), max(len(r) for r in rows), depth), pad)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


@pytest.mark.parametrize(("parts", "arrow"), [(1, 3), (4, 10000), (50, 7)])
def test_collated_arrays_equal_padded_sequences(spark, parts, arrow):
    rng = random.Random(parts)
    samples = _samples(rng, 63, 2)
    df = spark.createDataFrame(samples, COLUMNS).repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
    try:
        got = {r.batch_id: r for r in C.collate(df, 2, 13, parts=parts).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == list(range(13))
    for b, r in got.items():
        mine = sorted((s for s in samples if s[0] == b), key=lambda s: (-s[5], s[1]))
        assert r.keys == [s[1] for s in mine] and r.nsentences == len(mine)
        assert r.src_texts == [" ".join(str(x - 4) for x in s[4] if x >= 4) for s in mine]
        assert r.src_lengths == [s[5] for s in mine] and r.target_lengths == [s[6] for s in mine]
        assert r.ntokens == sum(s[6] for s in mine) == r.n_kept
        for values, offsets, column in ((r.src_tokens, r.src_offsets, 2), (r.target, r.target_offsets, 3)):
            assert (C.dense(values, offsets, 2) == _padded([s[column] for s in mine], 2)).all()
        labels = C.dense(r.src_labels, r.label_offsets)
        assert (labels == _padded([[[x] for x in s[4]] for s in mine], 1)[:, :, 0]).all()
        assert r.padded_length == max(len(s[2]) for s in mine) and r.padded_target == max(s[6] for s in mine)


def test_collated_batches_are_in_order_and_take_one_exchange(spark):
    df = spark.createDataFrame(_samples(random.Random(2), 40, 2), COLUMNS)
    collated = C.collate(df, 2, 8, parts=3)
    places = collated.withColumn("p", F.spark_partition_id()).collect()
    by_part = [(r.p, r.batch_id) for r in places]
    assert by_part == sorted(by_part) and {b: p for p, b in by_part} == {b: b * 3 // 8 for b in range(8)}
    assert collated._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert C.collate(df.where("batch_id < 0"), 2, 0).count() == 0


def test_kept_frames_leave_out_frames_of_pad_alone(spark):
    pad = [K.PAD, K.PAD]
    rows = [(0, "a", [[2, 1]], [[5, 1], pad, [7, 8], pad], [2], 1, 4), (0, "b", [[2, 1]], [pad, [9, 9]], [2], 3, 2), (1, "c", [[2, 1]], [pad], [2], 1, 1)]
    collated = C.collate(spark.createDataFrame(rows, COLUMNS), 2, 2)
    got = sorted((r.batch_id, r.flat, r.key, r.frame, r.codes) for r in C.kept_frames(collated).collect())
    assert got == [(0, 0, "b", 1, [9, 9]), (0, 1, "a", 0, [5, 1]), (0, 2, "a", 2, [7, 8])]
    assert {r.batch_id: (r.n_frames, r.n_kept) for r in C.frame_mask(collated).collect()} == {0: (8, 3), 1: (1, 0)}


# ---------------------------------------------------------------- batches in two dimensions


def _greedy(lengths, max_tokens, most):
    out, batch, n = [], 0, 0
    for x in lengths:
        if n and ((n + 1) * x > max_tokens or n + 1 > most):
            batch, n = batch + 1, 0
        out.append(batch)
        n += 1
    return out


def test_batch_plan_with_a_second_cap_equals_the_sequential_rule():
    rng = random.Random(9)
    for _ in range(300):
        max_tokens, most = rng.randrange(1, 40), rng.choice([None, 1, 2, 5, 100])
        lengths = sorted(rng.choice([0, 0, rng.randrange(0, max_tokens + 1)]) for _ in range(rng.randrange(1, 80)))
        cap = max_tokens if most is None else most
        got = []
        plan = {p[0]: p for p in batch_plan([(x, lengths.count(x)) for x in set(lengths)], max_tokens, most)}
        for x in sorted(set(lengths)):
            _, open_, head, first, size = plan[x]
            got += [open_ if r < head else first + (r - head) // size for r in range(lengths.count(x))]
        want = _greedy(lengths, max_tokens, cap)
        assert got == want
        assert max(want.count(b) for b in set(want)) <= cap


def test_rows_without_tokens_fill_bounded_batches(spark):
    df = spark.range(95).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") < 90, 0).otherwise(3).alias("len_s"))
    sizes = {r.batch_id: r["count"] for r in token_budget_batches(df, max_tokens=20).groupBy("batch_id").count().collect()}
    assert max(sizes.values()) <= 20 and sum(sizes.values()) == 95
    sizes = {r.batch_id: r["count"] for r in token_budget_batches(df, max_tokens=20, max_sentences=7).groupBy("batch_id").count().collect()}
    assert max(sizes.values()) == 7 and sum(sizes.values()) == 95


# ---------------------------------------------------------------- scores


def _score_rows(spark, n=60, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        width = 8 if i % 3 else 5
        x = rng.integers(-3, 4, width).astype(float)  # ties
        rows.append((i, "sem" if i % 3 == 0 else "ac", [float(v) for v in x], int(rng.integers(0, width)), bool(i % 4)))
    rows += [(n, "ac", None, 0, True), (n + 1, "ac", [], 0, True), (n + 2, "ac", [1.0, 2.0], 99, False), (n + 3, "off", [1.0, 0.0], 0, False)]
    return rows, spark.createDataFrame(rows, "pos bigint, component string, scores array<double>, target int, keep boolean")


def _expected_components(rows, epsilon, factors):
    out = {}
    for _, c, x, t, keep in rows:
        o = out.setdefault(c, [0, 0, 0.0, 0.0])
        if not keep or not x:
            continue
        lse = math.log(sum(math.exp(v) for v in x))
        o[0] += x.index(max(x)) == t
        o[1] += 1
        o[2] += lse - x[t]
        o[3] += sum(x) / len(x) - lse
    res = {}
    for c, (right, n, nll, mean) in out.items():
        nll, mean = (nll / n, mean / n) if n else (0.0, 0.0)
        res[c] = (right, n, nll, nll * (1 - epsilon) - mean * epsilon, factors.get(c, 1.0))
    res["total"] = (
        sum(r[0] for r in res.values()), sum(r[1] for r in res.values()), sum(r[2] for r in res.values()),
        sum(r[3] * r[4] for r in res.values()), None,
    )
    return res


def test_components_and_total_in_one_pass(spark):
    rows, df = _score_rows(spark)
    got = component_metrics(df, factors={"sem": 0.25}, epsilon=0.1)
    want = _expected_components(rows, 0.1, {"sem": 0.25})
    assert {r.component for r in got.collect()} == set(want) == {"ac", "sem", "off", "total"}
    for r in got.collect():
        right, n, nll, loss, factor = want[r.component]
        assert (r.n_correct, r.total, r.factor) == (right, n, factor)
        assert abs(r.nll_loss - nll) < 1e-12 and abs(r.loss - loss) < 1e-12
    again = component_metrics(df, factors={"sem": 0.25}, epsilon=0.1)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and plan.count("Generate") == 1  # the total's few rows


def test_labels_outside_the_classes_fail_under_the_mask_only(spark):
    _, df = _score_rows(spark)
    assert position_scores(df, mask="keep").count() == 64
    with pytest.raises(Exception, match="outside the classes"):
        position_scores(df).collect()


def test_logs_of_workers_with_different_components(spark):
    rows, df = _score_rows(spark)
    df = df.withColumn("update", F.col("pos") % 2).withColumn("worker", F.col("pos") % 5).where("component <> 'off'")
    metrics = component_metrics(df.where("worker <> 1 OR component = 'ac'"), by=["update", "worker"], factors={"sem": 2.0})
    logs = logging_output(metrics, ["update", "worker"])
    summed = {r.update: r.log for r in sum_logs(logs, ["update"]).collect()}
    each = logs.collect()
    for update, log in summed.items():
        mine = [r.log for r in each if r.update == update]
        assert set(log) == set().union(*mine)
        for k, v in log.items():
            assert abs(v - sum(m.get(k, 0.0) for m in mine)) < 1e-9
    found = {(r.update, r.metric): r.value for r in reduce_metric_maps(logs).collect()}
    for update, log in summed.items():
        n = log["sample_size"]
        assert found[(update, "loss")] == pytest.approx(log["loss"] / n / math.log(2), abs=6e-4)
        assert found[(update, "sem")] == pytest.approx(log["sem-loss"] / n / math.log(2), abs=6e-4)
        assert found[(update, "accuracy_ac")] == pytest.approx(100 * log["n_correct_ac"] / log["total_ac"], abs=6e-4)
    none = spark.createDataFrame([(0, {"loss": 1.0, "x-loss": 2.0, "sample_size": 0.0})], "update bigint, log map<string,double>")
    assert [(r.metric, r.value) for r in reduce_metric_maps(none).collect()] == [("x", 0.0)]


def test_top_classes_equal_the_long_form_without_exchange(spark):
    from tokenmill.operators.scoring import topk_candidates, topk_sample

    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 12)]) for i in range(80)] + [(80, [1.0, 2.0, 3.0, 4.0]), (81, None)]
    df = spark.createDataFrame(rows, "pos bigint, scores array<double>")
    long = df.select("pos", F.posexplode("scores").alias("class", "score"))
    for k in (1, 3, 50):
        want = topk_candidates(long, k, 0.7)
        key = lambda r: (r.pos, r.rank)
        a, b = sorted(top_classes(df, k, 0.7).collect(), key=key), sorted(want.collect(), key=key)
        assert [(r.pos, r["class"], r.rank) for r in a] == [(r.pos, r["class"], r.rank) for r in b]
        assert max(abs(x.lprob - y.lprob) for x, y in zip(a, b)) < 1e-12
        drawn = sample_classes(df, k, 0.7, codebook=F.col("pos") % 2)
        want = topk_sample(want, codebook=F.col("pos") % 2)
        assert sorted((r.pos, r["class"], r.token_id) for r in drawn.collect()) == sorted((r.pos, r["class"], r.token_id) for r in want.collect())
        for frame in (top_classes(df, k), drawn):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Generate" not in plan and "Window" not in plan


def test_long_scores_become_rows(spark):
    _, df = _score_rows(spark)
    some = df.where("size(scores) > 0")
    back = to_score_rows(some.select("pos", F.posexplode("scores").alias("class", "score"), "target"))
    assert sorted((r.pos, r.scores, r.target) for r in back.collect()) == sorted((r.pos, r.scores, r.target) for r in some.collect())
    gap = spark.createDataFrame([(0, 0, 1.0), (0, 2, 1.0)], "pos bigint, class int, score double")
    with pytest.raises(Exception, match="gaps"):
        to_score_rows(gap).collect()


# ---------------------------------------------------------------- codebooks


def test_tiled_codebooks_equal_broadcast_ones(spark):
    rng = np.random.default_rng(7)
    books = [(q, c, [float(v) for v in rng.integers(-4, 5, 3)]) for q in range(3) for c in range(37)]  # many ties
    frames = [(i % 190, [float(v) for v in rng.integers(-6, 7, 3)]) for i in range(200)]  # ids repeat
    b = spark.createDataFrame(books, "q int, cid int, c array<double>")
    f = spark.createDataFrame(frames, "id bigint, v array<double>")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(residual_codes(f, b, 3))
    assert rows(residual_codes_tiled(f, b, 3, tile_cells=21, block_rows=30)) == want
    assert rows(residual_codes(f, b, 3, max_cells=10)) == want
    one = b.where("q = 0")
    assert rows(nearest_unit(f, one, max_cells=10)) == rows(nearest_unit(f, one))
    with pytest.raises(ValueError, match="missing"):
        residual_codes_tiled(f, b.where("q < 2"), 3)
    with pytest.raises(ValueError, match="0..K-1"):
        nearest_unit(f, one.where("cid <> 3"), max_cells=10)


# ---------------------------------------------------------------- crops and vocabularies


def test_windows_are_cut_before_cells_become_rows(spark):
    rng = random.Random(3)
    streams, crops = [], []
    for i in range(40):
        n = rng.choice([0, 1, 5, 17, 40])
        streams.append((f"k{i}", 3, n, [rng.randrange(1000) for _ in range(3 * n)]))
        crops += [(f"k{i}", s) for s in rng.sample(range(0, 30), rng.randrange(0, 4))]
    ac = spark.createDataFrame(streams, "key string, depth int, len int, tokens array<bigint>")
    windows = spark.createDataFrame([*crops, ("absent", 1)], "key string, crop_start int")
    want = []
    for key, _, n, tokens in streams:
        for k, start in crops:
            a = start * 9 // 6
            if k == key:
                want += [(key, start, q, t, t - a, tokens[q * n + t]) for q in range(2) for t in range(a, min(n, a + 9))]
    for bound in (1000, 3):
        got = crop_range_join(ac, windows, keep=2, max_source=6, max_target=9, max_broadcast=bound)
        assert sorted((r.key, r.crop_start, r.q, r.t, r.t_out, r.code) for r in got.collect()) == sorted(want)


def test_array_lookup_gathers_or_shuffles_to_the_same_ids(spark):
    rows = [(1, ["0", "7", "x", None, "</s>"]), (2, []), (3, None), (4, ["9"] * 50)]
    df = spark.createDataFrame(rows, "key bigint, symbols array<string>")
    vocab = build_vocab(spark, 10)
    gathered = vocab_lookup_arrays(df, vocab)
    assert "Exchange" not in gathered._jdf.queryExecution().executedPlan().toString()
    want = {1: [4, 11, K.UNK, K.UNK, K.EOS], 2: [], 3: None, 4: [13] * 50}
    assert {r.key: r.ids for r in gathered.collect()} == want
    assert {r.key: r.ids for r in vocab_lookup_arrays(df, vocab, max_broadcast=5).collect()} == want


def test_equal_workers_have_an_order(spark):
    from tokenmill.operators.shards import shard_merge

    rows = [(1, "a", 5), (1, "a", 9), (0, "a", 99), (2, "b", 1)]
    got = {tuple(r) for i in range(4) for r in shard_merge(spark.createDataFrame(rows[i:] + rows[:i], "worker int, key string, len int")).collect()}
    assert got == {("a", 1, 9), ("b", 2, 1)}


# ---------------------------------------------------------------- published streams


def _streams(spark, n, shift=0):
    sem = spark.range(n).select(F.format_string("k%05d", "id").alias("key"), F.lit(2).alias("len"), F.array(F.col("id") + shift, F.lit(1)).alias("tokens"))
    ac = sem.withColumn("depth", F.lit(1))
    return [{"df": sem, "stream": "semantic", "split": "train"}, {"df": ac, "stream": "acoustic", "split": "train", "bandwidth": 6.0}]


def _first(df):
    return {r.stream: (r.n, r.m) for r in df.groupBy("stream").agg(F.count("*").alias("n"), F.min(F.get("tokens", F.lit(0))).alias("m")).collect()}


def test_a_failed_publication_changes_nothing(spark, tmp_path):
    from tokenmill.sources.publish import publish_streams, read_published

    root = str(tmp_path / "store")
    assert read_published(spark, root).count() == 0
    publish_streams(spark, root, _streams(spark, 100), files=4)
    assert _first(read_published(spark, root)) == {"semantic": (100, 0), "acoustic": (100, 0)}
    broken = _streams(spark, 50, shift=1000)
    broken[1]["df"] = broken[1]["df"].withColumn("len", F.when(F.col("key") == "k00033", F.raise_error(F.lit("lost"))).otherwise(F.col("len")))
    with pytest.raises(Exception, match="lost"):
        publish_streams(spark, root, broken, files=4)
    # the first of the two streams was written in full, and is not seen
    assert _first(read_published(spark, root)) == {"semantic": (100, 0), "acoustic": (100, 0)}
    publish_streams(spark, root, _streams(spark, 50, shift=1000), files=4)
    assert _first(read_published(spark, root)) == {"semantic": (50, 1000), "acoustic": (50, 1000)}
    # one stream alone replaces its own folders
    publish_streams(spark, root, _streams(spark, 7, shift=5)[:1], files=1)
    assert _first(read_published(spark, root)) == {"semantic": (7, 5), "acoustic": (50, 1000)}
    assert read_published(spark, root, stream="acoustic", bandwidth=6.0).count() == 50


def test_a_point_read_opens_one_file(spark, tmp_path):
    from tokenmill.sources.publish import point_read_published, publish_streams, read_published

    root = str(tmp_path / "store")
    publish_streams(spark, root, _streams(spark, 2000), files=16)
    assert len(read_published(spark, root, stream="semantic").inputFiles()) == 16
    got = point_read_published(spark, root, ["k01234"], "semantic", "train")
    assert len(got.inputFiles()) == 1 and [list(r.tokens) for r in got.collect()] == [[1234, 1]]
    two = point_read_published(spark, root, ["k00003", "k01999", "zz", "a"], "acoustic", bandwidth=6.0)
    assert len(two.inputFiles()) == 2 and sorted(r.key for r in two.collect()) == ["k00003", "k01999"]
    assert point_read_published(spark, root, ["zz"], "semantic").count() == 0
    import pyarrow.parquet as pq

    path = got.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert pq.ParquetFile(path).metadata.num_rows < 400
