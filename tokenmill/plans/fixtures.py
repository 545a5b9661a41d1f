"""Test-scale stand-ins derived from the given tables (see FIXTURES.md).

A document is a clip, a character is a sample (``sr`` = 100) and a word is
one semantic frame.  Every view is a pure Spark plan over the parquet tables,
so its size grows with the scale factor.  The DuckDB twins live in
:mod:`tokenmill.plans.oracle_views`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: a task turns so many words into units at a time, and so many units into tokens
WORDS, UNITS = 1 << 20, 1 << 18


def _slices(batches: Iterator[pa.Array], size, limit: int) -> Iterator[pa.Array]:
    """The rows of ``batches`` in order, in slices of at most ``limit`` by ``size(batch)``, or of one row."""
    for rows in batches:
        ends = np.cumsum(np.maximum(size(rows), 1))
        start = 0
        while start < len(rows):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield rows.slice(start, stop - start)
            start = stop
        if not len(rows):
            yield rows


def _word_units(texts: pa.Array) -> pa.Array:
    """Units of every text: the first 32 bits of the md5 of each word (split at every space), mod 10,000."""
    words = pc.split_pattern(texts, " ")
    coded = words.flatten().dictionary_encode()
    units = [int.from_bytes(hashlib.md5(w, usedforsecurity=False).digest()[:4], "big") % 10000 for w in coded.dictionary.cast(pa.binary()).to_pylist()]
    values = np.array(units, np.int64)[coded.indices.to_numpy()]
    return _like(texts, pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), values)


def _like(rows: pa.Array, sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list array of ``sizes`` values a row, null where ``rows`` is."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    mask = pc.is_null(rows) if rows.null_count else None
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()), mask=mask)


def _book_tokens(rows: pa.Array) -> pa.Array:
    """The four codebooks of every row of units, flat and codebook-major."""
    n = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    units = rows.flatten().to_numpy(zero_copy_only=False)
    frames = n * 3 // 2
    first = np.cumsum(frames) - frames  # of a row among all frames; a book of a row starts at 4 * first + book * frames
    t = np.arange(frames.sum()) - np.repeat(first, frames)
    unit = units[np.repeat(np.cumsum(n) - n, frames) + t * 2 // 3]
    place, step = np.repeat(4 * first, frames) + t, np.repeat(frames, frames)
    tokens = np.empty(4 * len(t), np.int64)
    for c in range(4):
        tokens[place + c * step] = (unit * (c + 1) + t * 7 + c * 13) % 1024
    return _like(rows, 4 * frames, tokens)


def _units_udf():
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # some four bytes a word
        for texts in _slices(batches, lambda b: pc.fill_null(pc.binary_length(b), 0).to_numpy(zero_copy_only=False) // 4, WORDS):
            yield _word_units(texts)

    return F.arrow_udf(work, "array<bigint>")


def _tokens_udf():
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in _slices(batches, lambda b: pc.fill_null(pc.list_value_length(b), 0).to_numpy(zero_copy_only=False), UNITS):
            yield _book_tokens(rows)

    return F.arrow_udf(work, "array<bigint>")


def fx_manifest(spark, sf_dir) -> DataFrame:
    return spark.sql("SELECT concat('  ', url, ' ') AS path FROM {p}", p=table(spark, sf_dir, "pages"))


def fx_clips(spark, sf_dir, spread: bool = True) -> DataFrame:
    """Clips hash-partitioned by ``key`` at the session's shuffle width.

    The given documents file has only a few row groups; spreading it lets the
    per-row array work use every core.  Without ``spread`` texts are shuffled
    only where their files have fewer partitions than there are cores.
    """
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # n_words is computed before the exchange: size-only plans prune the text
    docs = table(spark, sf_dir, "documents")
    clips = spark.sql(
        "SELECT doc_id, concat_ws('/', source, lang, concat(cast(doc_id as string), '.flac')) AS key, "
        "n_chars AS n, 100 AS sr, text, size(split(text, ' ', -1)) AS n_words FROM {d}",
        d=docs,
    )
    if not spread and docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return clips
    return clips.repartition(width, "key")


def fx_sem0(spark, sf_dir, spread: bool = True) -> DataFrame:
    # len = size(units) = number of words; spelled from the split so a size-only
    # read (column pruning) never computes the per-word hashes
    clips = fx_clips(spark, sf_dir, spread)
    return clips.select("doc_id", "key", F.col("n_words").cast("int").alias("len"), _units_udf()("text").alias("units"))


def fx_sem(spark, sf_dir, spread: bool = True) -> DataFrame:
    return fx_sem0(spark, sf_dir, spread)


def fx_sem_gaps(spark, sf_dir) -> DataFrame:
    """Semantic streams with missing keys, for the pairing queries only."""
    return fx_sem(spark, sf_dir).where("doc_id % 29 <> 0")


def fx_ac(spark, sf_dir, spread: bool = True) -> DataFrame:
    """Acoustic streams of all clips."""
    return fx_ac_all(spark, sf_dir, spread).drop("doc_id")


def fx_ac_all(spark, sf_dir, spread: bool = True) -> DataFrame:
    """Acoustic stand-in: 4 codebooks of ``la = len * 3 div 2`` frames, flat codebook-major.

    Frame ``t`` of codebook ``c`` is ``(units[t * 2 div 3] * (c + 1) + t * 7 + c * 13) % 1024``.
    One pass over Arrow batches computes the books of a row from its units.
    """
    return fx_sem0(spark, sf_dir, spread).select(
        "doc_id", "key", F.lit(4).alias("depth"), F.expr("cast(len * 3 div 2 as int)").alias("len"), _tokens_udf()("units").alias("tokens")
    )


def fx_ac_gaps(spark, sf_dir) -> DataFrame:
    """Acoustic streams with other missing keys, for the pairing queries only."""
    return fx_ac_all(spark, sf_dir).where("doc_id % 31 <> 0").drop("doc_id")


def fx_shards(spark, sf_dir) -> DataFrame:
    sem = fx_sem(spark, sf_dir)
    return spark.sql(
        "SELECT cast(doc_id % 4 as int) AS worker, key, len FROM {s} UNION ALL "
        "SELECT cast((doc_id + 1) % 4 as int), key, len + 1 FROM {s} WHERE doc_id % 17 = 0",
        s=sem,
    )


def fx_runs(spark, sf_dir) -> DataFrame:
    """Per-user event stream with a 1-based position (skew-safe row number)."""
    from tokenmill.operators.ordered import row_number_within

    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("unit"))
    ranked = row_number_within(ev, ["user_id"], ["ts", "event_id"], out="pos")
    return ranked.select("user_id", F.col("pos").cast("bigint").alias("pos"), "unit")


def fx_frames(spark, sf_dir) -> DataFrame:
    return spark.sql("SELECT vec_id AS id, embedding AS v FROM {e}", e=table(spark, sf_dir, "embeddings"))


def fx_books(spark, sf_dir) -> DataFrame:
    return spark.sql(
        "SELECT cast(vec_id div 16 as int) AS q, cast(vec_id % 16 as int) AS cid, embedding AS c "
        "FROM {e} WHERE vec_id < 64",
        e=table(spark, sf_dir, "embeddings"),
    )


def fx_scores(spark, sf_dir) -> DataFrame:
    return spark.sql(
        "SELECT vec_id AS pos, cast(class as int) AS class, cast(score as double) AS score, label AS target, "
        "vec_id % 5 <> 0 AS keep FROM (SELECT vec_id, label, posexplode(embedding) AS (class, score) FROM {e})",
        e=table(spark, sf_dir, "embeddings"),
    )


def fx_score_rows(spark, sf_dir) -> DataFrame:
    """The scores of ``fx_scores`` as they are stored: one array per position."""
    return spark.sql(
        "SELECT vec_id AS pos, cast(embedding as array<double>) AS scores, label AS target, vec_id % 5 <> 0 AS keep FROM {e}",
        e=table(spark, sf_dir, "embeddings"),
    )


def fx_components(spark, sf_dir) -> DataFrame:
    """Two model outputs per position, of 64 and of 32 classes, each with its labels and mask; worker 2 has one."""
    return spark.sql(
        "SELECT pos, cast(pos % 7 as bigint) AS update, cast(pos % 3 as int) AS worker, c.component, c.scores, c.target, c.keep "
        "FROM (SELECT pos, explode(array("
        "named_struct('component', 'word_ins_acoustic', 'scores', scores, 'target', target, 'keep', keep), "
        "named_struct('component', 'word_ins_semantic', 'scores', slice(scores, 1, 32), 'target', target % 32, 'keep', pos % 4 <> 0))) AS c "
        "FROM {s}) WHERE c.component = 'word_ins_acoustic' OR pos % 3 <> 2",
        s=fx_score_rows(spark, sf_dir),
    )


def fx_log(spark, sf_dir) -> DataFrame:
    return spark.sql(
        "SELECT l_linenumber AS worker, l_orderkey AS update, l_extendedprice / 1000 AS loss, "
        "l_extendedprice * (1 - l_discount) / 1000 AS nll_loss, 1 AS sample_size, "
        "cast(l_quantity as bigint) AS ntokens, cast(floor(l_quantity * l_discount) as bigint) AS n_correct_acoustic, "
        "cast(l_quantity as bigint) AS total_acoustic FROM {l}",
        l=table(spark, sf_dir, "lineitem"),
    )


def fx_kv(spark, sf_dir) -> DataFrame:
    """Legacy key-value records: ``key‖i`` token entries and ``key‖i_size`` size entries."""
    return spark.sql(
        "SELECT concat(key, cast(i as string), s) AS k, cast(len + i as int) AS len FROM {s} "
        "LATERAL VIEW explode(sequence(1, 12)) a AS i LATERAL VIEW explode(array('', '_size')) b AS s",
        s=fx_sem(spark, sf_dir).select("key", "len"),
    )
