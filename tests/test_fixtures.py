"""Units and tokens of the fixtures, made in Arrow batches, against their plain definitions."""

import contextlib
import hashlib
import io

import pyarrow as pa

from tokenmill.plans import fixtures as fx

TEXTS = ["a b a", None, "", " x  y ", "é b", "one", "b " * 40]


def _units(text):
    return None if text is None else [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 10000 for w in text.split(" ")]


def _tokens(units):
    if units is None:
        return None
    return [(units[t * 2 // 3] * (c + 1) + t * 7 + c * 13) % 1024 for c in range(4) for t in range(len(units) * 3 // 2)]


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().lower()


def test_units_and_tokens_follow_their_definition():
    texts = pa.array(TEXTS, pa.string())
    for part in (texts, texts.slice(1), texts.slice(2, 3), texts.slice(0, 0)):
        units = fx._word_units(part)
        assert units.to_pylist() == [_units(t) for t in part.to_pylist()]
        assert fx._book_tokens(units).to_pylist() == [_tokens(u) for u in units.to_pylist()]
    rows = pa.array([[1, 2, 3], None, [], [5], [7, 8]], pa.list_(pa.int64()))
    assert fx._book_tokens(rows.slice(1, 4)).to_pylist() == [_tokens(u) for u in rows.to_pylist()[1:]]


def test_slices_are_bounded_and_keep_every_row():
    rows = pa.array([[0] * n for n in (3, 3, 9, 0, 1, 1, 2)], pa.list_(pa.int64()))
    parts = list(fx._slices(iter([rows, rows.slice(0, 0)]), lambda b: b.value_lengths().to_numpy(), 6))
    assert [len(p) for p in parts] == [2, 1, 4, 0]
    assert [r for p in parts for r in p.to_pylist()] == rows.to_pylist()


def test_streams_are_made_in_batches_and_only_where_read(spark, tmp_path):
    rows = [(i, t, None if t is None else len(t), "en", "web") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    streams = fx.fx_ac(spark, str(tmp_path))
    plan = _plan(streams)
    assert "arrowevalpython" in plan and "lambdafunction" not in plan
    assert "arrowevalpython" not in _plan(streams.select("key", "len"))
    sem = {r.key: r.units for r in fx.fx_sem(spark, str(tmp_path)).collect()}
    ac = {r.key: r.tokens for r in streams.collect()}
    for i, t in enumerate(TEXTS):
        assert sem[f"web/en/{i}.flac"] == _units(t) and ac[f"web/en/{i}.flac"] == _tokens(_units(t))


def test_largest_offset_code_of_every_codebook(spark):
    from tokenmill.operators.aggregates import vocab_sizing

    sem = spark.createDataFrame([("a", [1, 9])], "key string, units array<bigint>")
    rows = [("a", 2, [5, 900, 1, 2, 7]), ("b", 3, [1000, 3, 4]), ("c", 0, []), ("d", None, None), ("e", 1, [None, 6])]
    for codes, most in ((rows, 2 * 1024 + 7), (rows[1:4], 1000), (rows[2:4], None), (rows[4:], 1024 + 6)):
        ac = spark.createDataFrame(codes, "key string, len int, tokens array<bigint>")
        sizes = vocab_sizing(spark, sem, ac, codec_depth=8, codec_dim=1024)
        assert {r.dictionary: r.max_seen for r in sizes.collect()} == {"source": 9, "target": most}
        assert "lambdafunction" not in _plan(sizes)
