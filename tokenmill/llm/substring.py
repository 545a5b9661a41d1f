"""Substring deduplication over words by De Bruijn compaction.

Windows of 50 consecutive words are the edges of a De Bruijn graph (its nodes
are their overlaps).  Each document's path through the graph is written in
compacted form, as super-windows (see ``repeats``): runs of windows with one
minimizer ``h``.  A minimizer that all its documents pass in one and the same
content ``ctx`` lies on a nonbranching path: all windows of that stretch have
the same documents, and one aggregation per minimizer compacts them.  Only
where a repeated minimizer has several contents does the graph branch; there
each distinct content is opened once into its single windows, whose least
document is found by a join on the window.  Coordinates (document, first word)
then turn repeated stretches into spans, and spans that touch into one.

A word is removed if a window over it also starts in a document with a smaller
id; windows are judged on the input.  Hot passages cost one row per document
and stretch, summed before the shuffle.

Defined results: null text has no words; documents shorter than a window lose
nothing; a document's own repeats and rows with the same doc_id do not count
as earlier; rows with a null doc_id are kept whole and count for nobody;
repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import cut, table
from tokenmill.llm.registry import query
from tokenmill.llm.repeats import Bloom, Windows, keyed, merge_spans, super_window_rows, window_rows
from tokenmill.llm.words import pieces, ragged, word_bounds

WIDTH, K = 50, 10


def repeated_spans(docs: DataFrame, spec: Windows) -> DataFrame:
    """(doc_id, fp, spans array<struct<a, b>>) in units, for documents with windows of an earlier document."""
    docs = docs.where("doc_id is not null")
    nodes = cut(
        super_window_rows(docs, spec)
        .groupBy("h")
        .agg(
            F.min("doc_id").alias("least"),
            F.max("doc_id").alias("most"),
            F.min("ctx").alias("c0"),
            F.max("ctx").alias("c1"),
        )
        .where("least < most")
        .select("h", "least", (F.col("c0") != F.col("c1")).alias("branches"))
    )
    bloom = Bloom.of(nodes, "h", nodes.count())
    paths = cut(super_window_rows(docs, spec, bloom).join(nodes, "h"))
    # branching minimizers: every distinct content once, opened into windows at its first place
    contents = cut(
        paths.where("branches").groupBy("h", "ctx").agg(F.min(F.struct("doc_id", "fp", "start", "n")).alias("at"))
    )
    opened = window_rows(docs, contents.select("at.*", "h", "ctx"), spec)
    single = cut(
        opened.select(F.xxhash64("h", "ctx").alias("place"), F.col("doc_id").alias("own"), "h", F.posexplode("wins").alias("j", "win"))
        .select("place", "own", F.xxhash64("h", "win").alias("win"), F.col("j").cast("smallint").alias("j"))
    )
    shared = single.groupBy("win").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least < most")
    told = single.join(shared, "win").where("least < own").groupBy("place").agg(F.collect_list("j").alias("hit"))
    split = (
        paths.where("branches")
        .join(contents.select("h", "ctx", F.col("at.doc_id").alias("own")), ["h", "ctx"])
        .select("doc_id", "fp", "start", "n", "own", F.xxhash64("h", "ctx").alias("place"))
    )
    whole = paths.where("not branches and least < doc_id").select("doc_id", "fp", "start", "n")
    whole = whole.unionByName(split.where("own < doc_id").select("doc_id", "fp", "start", "n"))
    spans = whole.select(
        "doc_id", "fp", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + spec.width).alias("b")
    ).unionByName(
        split.where("own = doc_id")
        .join(told, "place")
        .select("doc_id", "fp", "start", F.explode("hit").alias("j"))
        .select(
            "doc_id", "fp", (F.col("start") + F.col("j")).alias("a"), (F.col("start") + F.col("j") + spec.width).alias("b")
        )
    )
    return spans.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (doc_id, fp, ...) with their spans, null where there are none."""
    return docs.join(spans, ["doc_id", "fp"], "left")


def span_arrays(column, row: int) -> tuple[np.ndarray, np.ndarray]:
    item = column[row]
    if not item.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = item.values
    return merge_spans(values.field("a").to_numpy().astype(np.int64), values.field("b").to_numpy().astype(np.int64))


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Per row its next ``counts`` words, joined by one space."""
    lengths = ends - starts + 1
    flat = np.append(data, 32)[ragged(starts, lengths)].astype(np.uint8)
    stops = np.cumsum(lengths) - 1
    flat[stops] = 32
    last = np.cumsum(counts)[counts > 0] - 1  # no space after a row's last word
    flat = np.delete(flat, stops[last])
    sizes = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
    bounds = sizes - np.concatenate([[0], np.cumsum(counts > 0)])
    return pa.Array.from_buffers(
        pa.large_string(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]
    )


def substring_dedup(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc_id, text) to (doc_id, kept, n_words, n_removed, spans): the kept words joined by one space."""
    rows = keyed(docs)
    spans = repeated_spans(rows, Windows(width, min(k, width), True))
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("spans")
            for row0, end, data, offsets in pieces(batch.column("text")):
                starts, ends, first = word_bounds(data, offsets)
                removed, where = [], []
                gone = np.zeros(len(starts), bool)
                for i in range(end - row0):
                    a, b = span_arrays(column, row0 + i)
                    lo = int(first[i])
                    for x, y in zip(a.tolist(), b.tolist()):
                        gone[lo + x : lo + y] = True
                    removed.append(int((b - a).sum()))
                    where.append([{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist())])
                words = np.diff(first)
                kept = joined_words(data, starts[~gone], ends[~gone], words - np.array(removed, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row0, end - row0),
                        kept.cast(pa.string()),
                        pa.array(words, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(where, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    ],
                    ["doc_id", "kept", "n_words", "n_removed", "spans"],
                )

    return with_spans(rows, spans).select("doc_id", "text", "spans").mapInArrow(
        work, f"doc_id {kind}, kept string, n_words bigint, n_removed bigint, spans array<struct<a:int,b:int>>"
    )


@query("op1_substring")
def op1_substring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

