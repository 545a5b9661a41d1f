"""Physical-plan properties: pruning, pushdown, bounded broadcasts."""

from pyspark.sql import functions as F

from tokenmill.operators.assemble import pair_streams
from tokenmill.session import scratch_path
from tokenmill.sources.store import point_read, read_token_store, write_token_store


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _store(spark):
    root = scratch_path(spark, "t-plan-store")
    rows = [(f"k{i:04d}", 4, [i] * 4) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, len int, tokens array<bigint>")
    write_token_store(df, root, "semantic", split="train")
    write_token_store(df.withColumn("depth", F.lit(2)), root, "acoustic", split="train", bandwidth=1.5)
    return root


def test_size_only_pairing_prunes_token_arrays(spark):
    root = _store(spark)
    sem = read_token_store(spark, root, stream="semantic")
    ac = read_token_store(spark, root, stream="acoustic", bandwidth=1.5)
    plan = _plan(pair_streams(sem, ac, with_tokens=False))
    assert "tokens" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "PartitionFilters" in plan


def test_point_read_is_pushed_down(spark):
    root = _store(spark)
    q = point_read(read_token_store(spark, root, stream="semantic", split="train"), "k0042")
    plan = _plan(q)
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,k0042)]" in plan
    assert q.first().tokens == [42] * 4


def test_codebooks_cut_before_the_join(spark):
    root = scratch_path(spark, "t-plan-keep")
    sem = spark.createDataFrame([(f"k{i}", 2, [i, i]) for i in range(20)], "key string, len int, tokens array<bigint>")
    ac = spark.createDataFrame(
        [(f"k{i}", 2, 2, [i, i, i + 1000, i + 1000]) for i in range(20)], "key string, depth int, len int, tokens array<bigint>"
    )
    write_token_store(sem, root, "semantic", split="train")
    write_token_store(ac, root, "acoustic", split="train", bandwidth=1.5)
    s = read_token_store(spark, root, stream="semantic").withColumn("units", F.col("tokens"))
    a = read_token_store(spark, root, stream="acoustic", bandwidth=1.5)
    row = pair_streams(s, a, keep=1).where("key = 'k7'").first()
    assert row.tokens == [7, 7] and row.depth == 2


def test_codebook_columns_prune_unread_codebooks(spark):
    root = scratch_path(spark, "t-plan-books")
    L, depth = 3, 4
    rows = [(f"k{i}", depth, L, [q * 100 + i * 10 + t for q in range(depth) for t in range(L)]) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, depth int, len int, tokens array<bigint>")
    write_token_store(df, root, "acoustic", split="train", bandwidth=3.0, codebook_columns=True)
    write_token_store(df, root, "acoustic", split="valid", bandwidth=3.0)  # flat layout beside it
    full = {r.key: list(r.tokens) for r in read_token_store(spark, root, stream="acoustic", split="train").collect()}
    assert full == {k: t for k, _, _, t in rows}
    kept = read_token_store(spark, root, stream="acoustic", keep=2)
    plan = _plan(kept)
    schema = plan.split("ReadSchema: ")[1].split("\n")[0] if "ReadSchema: " in plan else ""
    got = {(r.key, r.split): list(r.tokens) for r in kept.collect()}
    for k, _, _, t in rows:
        assert got[(k, "train")] == t[: 2 * L] and got[(k, "valid")] == t[: 2 * L]
    fmt = kept._jdf.queryExecution().executedPlan().toString()
    assert "cb02" not in fmt and "cb01" in fmt
