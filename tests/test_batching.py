"""W2 histogram plan = sequential greedy; W3 worker sizes; W2 rejects over-budget lengths."""

import random

import pytest
from pyspark.sql import functions as F

from tokenmill.operators.batching import batch_plan, strided_shard, token_budget_batches


def greedy(lengths, max_tokens):
    """Sequential rule on ascending lengths: close when (n + 1) * len > max_tokens."""
    out, b, k = [], -1, 0
    for ln in sorted(lengths):
        if k == 0 or (k + 1) * ln > max_tokens:
            b, k = b + 1, 1
        else:
            k += 1
        out.append(b)
    return out


def from_plan(lengths, max_tokens):
    hist = {}
    for ln in lengths:
        hist[ln] = hist.get(ln, 0) + 1
    plan = {p[0]: p for p in batch_plan(list(hist.items()), max_tokens)}
    out, seen = [], {}
    for ln in sorted(lengths):
        seen[ln] = seen.get(ln, 0) + 1
        _, open_b, head, first, cap = plan[ln]
        j = seen[ln]
        out.append(open_b if j <= head else first + (j - head - 1) // cap)
    return out


@pytest.mark.parametrize("seed", range(200))
def test_histogram_plan_equals_greedy(seed):
    rnd = random.Random(seed)
    max_tokens = rnd.choice([10, 50, 6500])
    n = rnd.randint(1, 300)
    lengths = [rnd.randint(1, min(max_tokens, rnd.choice([3, 40, 650]))) for _ in range(n)]
    assert from_plan(lengths, max_tokens) == greedy(lengths, max_tokens)


def test_edge_histograms():
    assert from_plan([5] * 20, 20) == greedy([5] * 20, 20)
    assert from_plan(list(range(1, 30)), 60) == greedy(list(range(1, 30)), 60)
    assert from_plan([650] * 30, 6500) == greedy([650] * 30, 6500)


def test_over_budget_is_rejected(spark):
    df = spark.createDataFrame([("a", 10), ("b", 7000)], "key string, len_s int")
    with pytest.raises(ValueError):
        token_budget_batches(df, max_tokens=6500)


def test_token_budget_batches_distributed(spark):
    rnd = random.Random(1)
    rows = [(f"k{i}", 650 if i % 3 == 0 else rnd.randint(1, 650)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, len_s int")
    got = token_budget_batches(df, shuffle=False).select("key", "len_s", "batch_id").collect()
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    expect = dict(zip([r[0] for r in order], greedy([r[1] for r in order], 6500)))
    assert {r.key: r.batch_id for r in got} == expect


@pytest.mark.parametrize("n,w", [(8, 4), (9, 4), (11, 4), (3, 4)])
def test_strided_shard_sizes(spark, n, w):
    df = spark.createDataFrame([(f"p{i:03d}",) for i in range(n)], "path string")
    got = strided_shard(df, "path", world_size=w, batch_size=2).groupBy("worker").count().collect()
    sizes = {r.worker: r["count"] for r in got}
    for rank in range(w):
        assert sizes.get(rank, 0) == n // w + int(rank < n % w)
