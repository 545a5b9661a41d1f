"""Packed rows are the rows they were made from, and are what the exchanges of collated batches move."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tokenmill.functions import packed, ragged
from tokenmill.operators.assemble import assemble_rows
from tokenmill.operators.collate import collate, kept_frames
from tokenmill.plans import fixtures as fx
from tokenmill.plans.flows import collated_batches


def _rows(rng, low, high):
    def value():
        return rng.choice([None, 0, low, high, rng.randint(low, high)])

    return [rng.choice([None, [], [rng.randint(low, high) for _ in range(rng.randrange(1, 9))], [value() for _ in range(5)]]) for _ in range(30)]


def test_packed_rows_hold_their_values(monkeypatch):
    rng = random.Random(5)
    for bits in (1, 2, 3, 10, 12, 16, 17, 20, 32, 33, 48, 62, 63):
        for low in (0, -3, -(1 << bits)):
            monkeypatch.setattr(packed, "VALUES", rng.choice([1, 20, 1 << 18]))
            rows = pa.array([[7], *_rows(rng, low, (1 << bits) - 1)], pa.list_(pa.int64())).slice(1)
            made = packed.pack(rows)
            assert packed.unpack(made).equals(rows) and packed.unpack(made.slice(4, 9)).equals(rows.slice(4, 9))
            assert packed.sizes(made).tolist() == ragged.sizes(rows).tolist()
    apart = pa.concat_arrays([packed.pack(pa.array([x], pa.list_(pa.int64()))) for x in ([1, 2, 3], [1 << 40], [], [-1, 5], None, [900] * 7)])
    assert packed.unpack(apart).to_pylist() == [[1, 2, 3], [1 << 40], [], [-1, 5], None, [900] * 7]
    codes = ragged.lists(np.full(100, 1000), pa.array(np.random.default_rng(0).integers(0, 1024, 100_000)))
    assert packed.pack(codes).nbytes < 1.3 * 100_000


def test_the_first_values_of_packed_rows(spark):
    rng = random.Random(6)
    rows = [(i, a, rng.choice([None, 0, 1, 2, 3, 4, 5, 7, 20])) for i, (low, high) in enumerate([(0, 900), (0, 1 << 20), (-4, 4)]) for a in _rows(rng, low, high)]
    df = spark.createDataFrame(rows, "i int, a array<bigint>, n int").repartition(4, "i")
    cut = df.withColumn("p", packed.column("a")).withColumn("p", packed.first(F.col("p"), F.col("n")))
    assert cut.schema["p"].dataType.simpleString() == packed.KIND
    unpacked = ragged.column(lambda p: packed.unpack(p), "array<bigint>", "p").alias("got")
    for r in cut.select("a", "n", unpacked).collect():
        assert r.got == (None if r.a is None or r.n is None else r.a[: r.n])


def _clips(spark, folder, files):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 9, 40, 900]))), rng.choice("ab"), "s") for i in range(120)]
    rows += rows[:5]  # a key may repeat
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    df.repartition(files).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _exchanged(df):
    """The schemas of all shuffles in the plan of ``df``."""
    found, nodes = [], [df._jdf.queryExecution().executedPlan().initialPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            found.append(node.schema().catalogString())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_collated_batches_move_packed_arrays_and_no_texts(spark, tmp_path):
    sf = _clips(spark, tmp_path, 2 * spark.sparkContext.defaultParallelism)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}
    for k in names:
        spark.conf.set(k, "1k")
    try:
        batches = collated_batches(fx.fx_sem(spark, sf, spread=False), fx.fx_ac(spark, sf, spread=False), keep=2)
        moved = _exchanged(batches)
        got = {r.batch_id: r for r in batches.collect()}
        frames = sorted(tuple(r) for r in kept_frames(batches).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert any("cells:binary" in s for s in moved)
    assert not any("array<" in s or "text:" in s for s in moved), moved
    # few files are spread as before, and give the same batches
    assert any("text:" in s for s in _exchanged(fx.fx_sem(spark, _clips(spark, tmp_path / "one", 1), spread=False)))
    sem, ac = fx.fx_sem(spark, sf), fx.fx_ac(spark, sf)
    again = collated_batches(sem, ac, keep=2)
    assert {r.batch_id: r for r in again.collect()} == got
    assert sum(r.nsentences for r in got.values()) == sum(len(r.keys) for r in got.values())
    assert len(frames) == sum(r.ntokens for r in got.values())


def test_kept_frames_are_the_targets_of_their_batches(spark, tmp_path):
    from tokenmill.operators.assemble import target_encode
    from tokenmill.plans.q_assemble import q_kept_frames

    sf = _clips(spark, tmp_path, 2)
    frames = q_kept_frames(spark, sf)
    moved = [s for s in _exchanged(frames) if "text:" not in s]  # two files are spread as texts
    assert any("cells:binary" in s for s in moved) and not any("array<" in s for s in moved), moved
    rows = assemble_rows(fx.fx_sem(spark, sf), fx.fx_ac(spark, sf), keep=2).select("key", target_encode("codes", 2).alias("target")).collect()
    targets = {r.key: r.target for r in rows}
    got = frames.collect()
    assert {(r.key, r.frame, r.code0, r.code1) for r in got} == {(k, f, *codes) for k, t in targets.items() for f, codes in enumerate(t)}
    places = {}
    for r in got:
        places.setdefault(r.batch_id, []).append(r.flat)
    assert all(sorted(x) == list(range(len(x))) for x in places.values())


def test_packed_rows_collate_as_arrays_do(spark):
    rows = [("a", [7, 7, 9], [1, 2, 3, 4, 5, 6], 3, 0), ("b", [4], [8, 9], 1, 0), ("c", [5, 6], [1, 2, 3, 4, 5, 6, 7, 8], 2, 1), ("d", [1, 70_000], [1, 2, 3, 4, 5, 6], 3, 1)]
    df = spark.createDataFrame(rows, "key string, units array<bigint>, tokens array<bigint>, n int, batch_id bigint").repartition(3)
    sem = df.select("key", F.size("units").alias("len"), "units")
    ac = df.select("key", F.lit(2).alias("depth"), F.col("n").alias("len"), "tokens")
    ids = df.select("key", "batch_id")
    arrays = collate(assemble_rows(sem, ac, keep=2, ids=ids), 2, 2)
    made = collate(assemble_rows(sem, ac, keep=2, ids=ids, pack=True), 2, 2)
    assert sorted(made.collect()) == sorted(arrays.collect()) and made.count() == 2


def test_too_few_codebooks_are_an_error_in_packed_rows(spark):
    import pytest

    sem = spark.createDataFrame([("a", 2, [1, 2])], "key string, len int, units array<bigint>")
    ac = spark.createDataFrame([("a", 1, 3, [1, 2, 3])], "key string, depth int, len int, tokens array<bigint>")
    with pytest.raises(Exception, match="fewer than 2 codebooks"):
        assemble_rows(sem, ac, keep=2, pack=True).select("target").collect()


def test_digests_of_many_values_are_made_in_parts(monkeypatch):
    seen = []
    work = ragged._digests
    monkeypatch.setattr(ragged, "VALUES", 100)
    monkeypatch.setattr(ragged, "_digests", lambda rows, start: seen.append(len(rows.flatten())) or work(rows, start))
    rows = [[(i * k) % 97 for k in range(30)] for i in range(40)] + [list(range(250)), None, []]
    got = ragged.digests(pa.array(rows, pa.list_(pa.int64())))
    assert got.to_pylist() == [sum(x * (k + 1) for k, x in enumerate(r or [])) for r in rows]
    assert max(seen) == 250 and sorted(seen)[-2] <= 100
