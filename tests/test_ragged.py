"""Array work over Arrow batches: equal to plain Python on odd rows, and no lambda over array elements left in the plans."""

import random
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tokenmill.functions.arrays import dedupe_consecutive, dedupe_units, digest, sized_digest
from tokenmill.operators.assemble import assemble_rows, codebook_truncate, depth_tile, detokenize, lm_interleave, source_encode, target_encode
from tokenmill.operators.scoring import local_drop, position_class_counts

ARRAYS = [None, [], [5], [None], [3, None, None, 3], [1, 1, None, 1, 2, 2], [7, 7, 9], [-4, 2**31 - 1], [None, 4, 4]]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_digest_dedupe_and_symbols_of_odd_rows(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ARRAYS)], "i int, a array<bigint>").repartition(2)
    got = df.select("i", digest("a").alias("d"), sized_digest("a").alias("s"), dedupe_units(df, "a").alias("u"),
                    dedupe_consecutive("a").alias("v"), detokenize("a").alias("t")).orderBy("i").collect()
    for r in got:
        a = ARRAYS[r.i]
        whole = a is not None and None not in a
        assert r.d == r.s.digest == (sum(x * (k + 1) for k, x in enumerate(a)) if whole else 0)
        assert r.s.n == (None if a is None else len(a))
        assert r.u == r.v  # the column expression and the Arrow function agree
        assert r.t == (None if a is None else " ".join(str(x - 4) for x in a if x is not None and x >= 4))
    with pytest.raises(Exception, match="exceeds a long"):
        spark.createDataFrame([([2**62, 2**62],)], "a array<bigint>").select(digest("a")).collect()


def test_rows_of_odd_units_and_codes(spark):
    rows = [
        (0, [7, 7, 9], [1, 2, 3, 4, 5, 6], 3), (1, [], [], 0), (2, None, [1, 2], 1), (3, [4], None, 0), (4, [1, None], [8, None, 9, 1], 2), (5, [3], [1, 2], None)
    ]
    df = spark.createDataFrame(rows, "i int, u array<bigint>, t array<bigint>, n int").repartition(2)
    made = df.withColumn("codes", codebook_truncate("t", "n", 2)).withColumn("src", source_encode("u"))
    made = made.withColumn("tgt", target_encode("codes", 2)).withColumn("source", depth_tile("src", 2))
    made = made.withColumn("row", lm_interleave("source", "tgt", 2))

    def plus(x, y):
        return None if x is None else x + y

    for r in made.collect():
        i, u, t, n = rows[r.i]
        codes = None if t is None or n is None else [[t[k], t[n + k]] for k in range(n)]
        src = None if u is None else [plus(x, 4) for x in u] + [2]
        tgt = None if codes is None else [[plus(a, 4), plus(b, 1028)] for a, b in codes] + [[2, 2]]
        assert (r.codes, r.src, r.tgt) == (codes, src, tgt)
        assert r.source == (None if src is None else [[x, 1] for x in src])
        if src is None or tgt is None:
            assert r.row is None
        else:
            shifted = [[plus(a, 10004), plus(b, 10004)] for a, b in tgt]
            assert r.row == [[2, 1]] + [[x, 1] for x in src[:-1]] + shifted[-1:] + shifted[:-1]


def _streams(spark):
    rng = random.Random(3)
    sem, ac = [("null", None, None)], [("null", 4, None, None)]
    for i, n in enumerate([0, 1, 2, 30, 650, 651, 1500]):
        la = n * 3 // 2
        sem.append((f"k{i}", n, [rng.choice([5, 6, 7]) for _ in range(n)]))
        ac.append((f"k{i}", 4, la, [rng.randrange(1024) for _ in range(4 * la)]))
    return (spark.createDataFrame(sem, "key string, len int, units array<bigint>"),
            spark.createDataFrame(ac, "key string, depth int, len int, tokens array<bigint>"))


def test_assembled_rows_are_their_operators_and_meet_ids_before_they_are_made(spark):
    sem, ac = _streams(spark)
    ids = sem.select("key", F.length("key").alias("batch_id"))
    rows = assemble_rows(sem, ac, keep=2, ids=ids)
    again = rows.select(
        "*", target_encode("codes", 2).alias("t"), depth_tile(source_encode("units"), 2).alias("s"),
        F.size("source").alias("ns"), F.size("target").alias("nt"),
    ).select("*", lm_interleave("s", "t", 2).alias("r"))
    got = again.collect()
    assert len(got) == 8 and sum(r.src_tokens is not None for r in got) == 7
    for r in got:
        assert (r.target, r.source, r.src_tokens, r.src_length, r.target_length) == (r.t, r.s, r.r, r.ns, r.nt)
    # the join with ids lies below the step that makes the rows, and no lambda is left in it
    plan = _plan(rows.select("key", "batch_id", digest("src_tokens")))
    assert plan.index("ArrowEvalPython") < plan.index("Join") and "lambda" not in plan
    counts = position_class_counts(rows)
    assert "lambda" not in _plan(counts)
    for r in counts.join(rows.select("key", "src_tokens"), "key").collect():
        if r.src_tokens is not None:
            first = [c[0] for c in r.src_tokens]
            assert (r.n_semantic, r.n_acoustic) == (sum(x < 10004 and x != 1 for x in first), sum(x >= 10004 for x in first))


def test_local_drop_ranks_by_the_draws(spark):
    frames = [[5, 6], [1, 1], None, [1, None], [1, 9], [], [None, 2]] * 9
    df = spark.createDataFrame([("ké", frames), (None, frames), ("e", []), ("n", None)], "key string, target array<array<bigint>>")
    kept = local_drop(df, "target", p=0.3)
    assert "lambda" not in _plan(kept.select("kept_frames"))
    got = {r.key: (r.kept_frames, r.n_frames) for r in kept.collect()}
    real = [t for t, f in enumerate(frames) if f and any(x not in (None, 1) for x in f)]
    draws = sorted(real, key=lambda t: (md5(f"drop:ké#{t}:42".encode()).hexdigest()[:8], t))
    assert got["ké"] == (sorted(draws[: len(real) * 7 // 10 + 1]), len(frames))
    assert got[None] == ([], len(frames)) and got["e"] == ([], 0) and got["n"][0] is None


def test_collated_input_is_made_behind_the_exchange(spark):
    from tokenmill.operators.collate import collate
    from tokenmill.plans.flows import collated_batches

    sem, ac = (df.where("key <> 'null'") for df in _streams(spark))
    ids = sem.select("key", (F.col("len") % 2).cast("bigint").alias("batch_id"))
    rows = assemble_rows(sem, ac, keep=2, ids=ids)
    moved, made = collate(rows, 2, 2).collect(), collate(rows.drop("src_tokens"), 2, 2).collect()
    assert sorted(moved) == sorted(made) and len(made) == 2
    plan = _plan(collated_batches(sem, ac, keep=2))
    assert "lambda" not in plan and "src_tokens" not in plan[plan.index("MapInArrow") :].split("\n", 1)[1]
