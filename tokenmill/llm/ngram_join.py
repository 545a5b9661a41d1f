"""Near-duplicate documents: an exact n-gram Jaccard join on token-combination prefixes.

A document's set holds its distinct word n-grams.  N-grams are ordered by how
frequent they are (classes from one fixed-size table of counts over all
documents) and then by hash; two sets that are similar enough share an n-gram
among the first ``n - need + 1``, and two among one more.  Rare n-grams of
that extended prefix are indexed singly, frequent ones as pairs.  Long
prefixes of frequent n-grams (pairs would grow with the square) are indexed
singly instead, and meet the others in their single n-grams too, so no pair
of documents is lost.

Documents with equal sets are one class and enter once.  Inside a bucket the
classes are first tried against its least and its greatest member; what these
links join needs no further pairs, so a bucket of copies costs a star.  Only
members of a bucket that are still apart are then tried pairwise, if the
parities of their n-grams in ``64 * SKETCH_LONGS`` cells allow a link: cells
that differ are at most as many as n-grams that differ, at any set size.
Candidates pass a bitmap bound (which never rejects a link) and are verified
on whole sets; components come from the links.

Defined results: null or empty text has an empty set and links with nothing;
fewer words than an n-gram are one n-gram; a null doc_id links with nothing
and gets a null component; repeated rows are copies; rows that share a doc_id
with other texts are documents of their own, and a component is named by its
least doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.workers import trimmed
from tokenmill.llm.common import connected_components, cut, table
from tokenmill.llm.registry import query
from tokenmill.llm.repeats import Bloom
from tokenmill.llm.words import Prefix, lower_ascii, mix, pieces, ragged, signed, word_bounds, word_hashes

COUNTERS = 1 << 18
CHUNK = 1 << 12
TOKEN_BITS = 50
MOST_PAIRED = 12
STARS = 2
SKETCH_LONGS = 8
BITMAP = (64, 1 << 16)


def token_sets(texts, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield ``(first row, tokens, row of each token, set sizes)``; tokens are distinct and sorted in a row."""
    for row0, end, data, offsets in pieces(texts):
        low = lower_ascii(data)
        starts, ends, first = word_bounds(low, offsets)
        words = Prefix(word_hashes(low, starts, ends), 1)
        n = np.diff(first)
        counts = np.where(n >= gram, n - gram + 1, n > 0)
        a = ragged(first[:-1], counts)
        row = np.repeat(np.arange(end - row0), counts)
        h = words.of(a, np.minimum(a + gram, first[row + 1]))
        shift = np.uint64(64 - TOKEN_BITS)
        key = np.sort((row.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (h >> shift))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        row = (key >> np.uint64(TOKEN_BITS)).astype(np.int64)
        yield row0, key & np.uint64((1 << TOKEN_BITS) - 1), row, np.bincount(row, minlength=end - row0)


def token_counts(docs: DataFrame, gram: int) -> np.ndarray:
    """Counts of all n-grams of all documents in ``COUNTERS`` hashed counters (a table of fixed size)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, tokens, _, _ in token_sets(batch.column("text"), gram):
                total += np.bincount((tokens & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        salt = TaskContext.get().partitionId() % 64
        chunks = COUNTERS // CHUNK
        flat = pa.FixedSizeListArray.from_arrays(pa.array(total), CHUNK).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(chunks, dtype=np.int32)), pa.array(np.full(chunks, salt, np.int32)), flat], ["chunk", "salt", "v"]
        )

    def add(key, rows):
        v = np.zeros(CHUNK, np.int64)
        for c in rows.column("v").chunks:
            v += np.asarray(c.flatten()).reshape(-1, CHUNK).sum(axis=0)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([v.tolist()], pa.list_(pa.int64()))})

    parts = docs.select("text").mapInArrow(trimmed(work), "chunk int, salt int, v array<bigint>")
    once = parts.groupBy("chunk", "salt").applyInArrow(add, "chunk int, v array<bigint>")
    out = np.zeros((COUNTERS // CHUNK, CHUNK), np.int64)
    got = once.groupBy("chunk").applyInArrow(add, "chunk int, v array<bigint>").toArrow()  # COUNTERS numbers at any input
    for chunk, v in zip(got.column("chunk").to_pylist(), got.column("v").combine_chunks()):
        out[chunk] = v.values.to_numpy()
    return out.ravel()


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 for counters near the mean, then one class for each doubling of what a counter has above it."""
    mean = max(1.0, float(np.median(counts)))
    excess = (counts - mean) / (4 * np.sqrt(mean) + 4)
    return np.where(excess < 1, 0, 1 + np.floor(np.log2(np.maximum(excess, 1)))).clip(0, 31).astype(np.uint8)


def signatures(docs: DataFrame, gram: int, num: int, den: int, classes: np.ndarray) -> DataFrame:
    """(doc_id, rk, text) to (doc_id, rk, n, fp, rare array, common array, bitmap, sketch array)."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row0, tokens, row, n in token_sets(batch.column("text"), gram):
                rows = len(n)
                begin = np.cumsum(n) - n
                sums = np.zeros(rows + 1, np.uint64)
                np.add.at(sums, row, mix(tokens + np.uint64(0x51ED27)))
                fp = mix(sums[:rows] ^ (n.astype(np.uint64) << np.uint64(20)))
                cls = classes[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.argsort((row.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (cls.astype(np.uint64) << np.uint64(45)) | (tokens >> np.uint64(5)))
                need = -(-num * n // den)
                prefix = np.where(n > 1, np.minimum(n, n - need + 2), 0)
                at = order[ragged(begin, prefix)]
                chosen, rare = tokens[at], cls[at] == 0
                place = np.repeat(np.arange(rows), prefix)
                lists = []
                for part in (rare, ~rare):
                    ends = np.concatenate([[0], np.cumsum(np.bincount(place[part], minlength=rows))]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(ends, signed(chosen[part])))
                bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), *BITMAP)
                base = np.cumsum(bits) - bits
                flags = np.zeros(int(bits.sum()), np.uint8)
                flags[base[row] + ((tokens >> np.uint64(18)).astype(np.int64) & (bits[row] - 1))] = 1
                packed = np.packbits(flags, bitorder="little")
                bounds = np.concatenate([base, [len(flags)]]).astype(np.int64) // 8
                maps = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
                cells = 64 * SKETCH_LONGS
                cell = (mix(tokens ^ np.uint64(0x3C6EF372)) & np.uint64(cells - 1)).astype(np.int64)
                odd = (np.bincount(row * cells + cell, minlength=rows * cells) & 1).astype(np.uint8)
                sketch = pa.FixedSizeListArray.from_arrays(
                    pa.array(np.packbits(odd, bitorder="little").view(np.int64)), SKETCH_LONGS
                ).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row0, rows),
                        batch.column("rk").slice(row0, rows),
                        pa.array(n.astype(np.int64)),
                        signed(fp),
                        *lists,
                        maps.cast(pa.binary()),
                        sketch,
                    ],
                    ["doc_id", "rk", "n", "fp", "rare", "common", "bitmap", "sketch"],
                )

    return docs.mapInArrow(
        trimmed(work),
        f"doc_id {kind}, rk bigint, n bigint, fp bigint, rare array<bigint>, common array<bigint>, bitmap binary, sketch array<bigint>",
    )


def index_rows(classes: DataFrame, bloom: Bloom | None = None) -> DataFrame:
    """(fp, n, rare, common) to (key, fp, n, kind, pos): rare n-grams, pairs of frequent ones, and frequent ones singly.

    ``kind`` 0 meets all in its bucket, 1 is a frequent n-gram of a paired
    class and 2 one of a class that is not paired; ``pos`` is the place of the
    (first) n-gram in the class's order.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys, rows, kinds, places = [], [], [], []
                for i, (rare, common) in enumerate(zip(part.column("rare"), part.column("common"))):
                    r, c = rare.values.to_numpy().view(np.uint64), common.values.to_numpy().view(np.uint64)
                    at_common = len(r) + np.arange(len(c))
                    place = [np.arange(len(r)), at_common]
                    found = [mix(r), mix(c ^ np.uint64(0xA5A5A5A5A5A5A5A5))]
                    paired = len(c) <= MOST_PAIRED
                    if paired and len(c) > 1:
                        x, y = np.triu_indices(len(c), 1)
                        lo, hi = np.minimum(c[x], c[y]), np.maximum(c[x], c[y])
                        found.append(mix(mix(lo + np.uint64(77)) ^ hi))
                        place.append(at_common[x])
                    kind = np.repeat([0, 1 if paired else 2, 0], [len(r), len(c), len(found[2]) if len(found) > 2 else 0])
                    keys.append(np.concatenate(found))
                    rows.append(np.full(len(kind), i))
                    kinds.append(kind)
                    places.append(np.concatenate(place))
                key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                kind = np.concatenate(kinds) if kinds else np.zeros(0, np.int64)
                pos = np.concatenate(places) if places else np.zeros(0, np.int64)
                if bloom is not None:
                    keep = bloom.may_hold(key)
                    key, row, kind, pos = key[keep], row[keep], kind[keep], pos[keep]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(key),
                        part.column("fp").take(take),
                        part.column("n").take(take),
                        pa.array(kind.astype(np.int32)),
                        pa.array(pos.astype(np.int32)),
                    ],
                    ["key", "fp", "n", "kind", "pos"],
                )

    return classes.select("fp", "n", "rare", "common").mapInArrow(trimmed(work), "key bigint, fp bigint, n bigint, kind int, pos int")


def _bitmap_bound(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Leave out pairs whose bitmaps differ in more places than the sets of a link can."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("nx").to_numpy() + batch.column("ny").to_numpy()
            most = n * (den - num) // (den + num)
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("bx").to_pylist(), batch.column("by").to_pylist())):
                a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
                while len(a) > len(b):
                    a = a[: len(a) // 2] | a[len(a) // 2 :]
                while len(b) > len(a):
                    b = b[: len(b) // 2] | b[len(b) // 2 :]
                keep[i] = int(np.bitwise_count(a ^ b).sum()) <= most[i]
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    return pairs.select("x", "y", "nx", "ny", "bx", "by").mapInArrow(trimmed(work), "x bigint, y bigint")


def token_arrays(docs: DataFrame, wanted: DataFrame, gram: int) -> DataFrame:
    """Whole sets, (fp, tokens), of the classes in ``wanted`` (fp, rk); the text is not shuffled."""
    bloom = Bloom.of(wanted, "rk", wanted.count())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = bloom.may_hold(batch.column("rk").to_numpy().view(np.uint64))
            part = batch.filter(pa.array(keep))
            for row0, tokens, _, n in token_sets(part.column("text"), gram):
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rk").slice(row0, len(n)), pa.ListArray.from_arrays(ends, signed(tokens))], ["rk", "tokens"]
                )

    found = docs.select("rk", "text").mapInArrow(trimmed(work), "rk bigint, tokens array<bigint>")
    return found.join(wanted, "rk").dropDuplicates(["fp"]).select("fp", "tokens")


class _Links:
    """Candidate pairs to verified links."""

    def __init__(self, docs, classes, gram, num, den):
        self.docs, self.classes, self.gram, self.num, self.den = docs, classes, gram, num, den

    def of(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``pairs`` (x, y distinct classes, x < y) to (tried pairs, links)."""
        side = self.classes.select("fp", "n", "bitmap")
        pairs = cut(pairs.select("x", "y").distinct())
        x = side.select(F.col("fp").alias("x"), F.col("n").alias("nx"), F.col("bitmap").alias("bx"))
        y = side.select(F.col("fp").alias("y"), F.col("n").alias("ny"), F.col("bitmap").alias("by"))
        near = cut(_bitmap_bound(pairs.join(x, "x").join(y, "y"), self.num, self.den))
        if near.isEmpty():
            return pairs, near
        ids = near.select(F.col("x").alias("fp")).unionByName(near.select(F.col("y").alias("fp"))).distinct()
        sets = cut(token_arrays(self.docs, cut(self.classes.join(ids, "fp").select("fp", "rk")), self.gram))
        sx, sy = sets.toDF("x", "tx"), sets.toDF("y", "ty")
        both = F.size(F.array_intersect("tx", "ty"))
        union = F.size("tx") + F.size("ty") - both
        links = near.join(sx, "x").join(sy, "y").where(both * self.den >= union * self.num).select("x", "y")
        return pairs, cut(links)


def _pairs(a, b):
    return F.least(a, b).alias("x"), F.greatest(a, b).alias("y")


def similar_documents(docs: DataFrame, gram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, text) to (doc_id, rk, n_shingles, component_id, component); links where den * intersection >= num * union.

    ``component`` is the component's own key (its least class), null where a row links with nothing.
    """
    rows = docs.select(
        "doc_id", F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("rk"), "text"
    )
    classes_of = frequency_classes(token_counts(rows, gram))
    marks = cut(signatures(rows, gram, num, den, classes_of))
    members = marks.select("doc_id", "rk", "n", "fp")
    known = marks.where("doc_id is not null and n > 0")
    classes = cut(
        known.groupBy("fp").agg(
            F.min("doc_id").alias("least"),
            F.first("n").alias("n"),
            F.min("rk").alias("rk"),
            F.first("rare").alias("rare"),
            F.first("common").alias("common"),
            F.first("bitmap").alias("bitmap"),
            F.first("sketch").alias("sketch"),
        )
    )
    # buckets with more than one class; buckets with the same classes are one bucket
    buckets = cut(
        index_rows(classes)
        .groupBy("key")
        .agg(
            F.count("*").alias("members"),
            F.min("fp").alias("lo"),
            F.max("fp").alias("hi"),
            F.bit_xor(F.xxhash64("fp")).alias("who"),
            F.sum(F.shiftright(F.xxhash64("fp", F.lit(1)), 30)).alias("sum"),
        )
        .where("lo < hi")
    )
    # buckets of the same classes are one bucket, which keeps each class's least place
    same = buckets.groupBy("members", "lo", "hi", "who", "sum").agg(F.min("key").alias("bucket"))
    buckets = cut(buckets.join(same, ["members", "lo", "hi", "who", "sum"]).select("key", "bucket"))
    bloom = Bloom.of(buckets, "key", buckets.count())
    entries = cut(
        index_rows(classes, bloom)
        .join(buckets, "key")
        .groupBy("bucket", "fp")
        .agg(F.first("n").alias("n"), F.min("kind").alias("kind"), F.min("pos").alias("pos"))
        .withColumnRenamed("bucket", "key")
    )
    found = _Links(rows, classes, gram, num, den)
    # What both have from their first shared n-gram on is enough for a link; a link passes this in the
    # bucket of its first shared n-gram (or pair of them).  Two paired classes meet in pairs.
    close = (F.least(F.col("n") - F.col("pos"), F.col("np") - F.col("pp")) * (num + den) >= (F.col("n") + F.col("np")) * num) & (
        (F.col("kind") == 0) | (F.col("kp") == 0) | (F.col("kind") + F.col("kp") > 2)
    )
    other = entries.select("key", F.col("fp").alias("p"), F.col("n").alias("np"), F.col("pos").alias("pp"), F.col("kind").alias("kp"))

    def with_component(df: DataFrame, column: str, name: str) -> DataFrame:
        named = group.select(F.col("node").alias(column), F.col("c").alias("_c"))
        return df.join(named, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")

    def joined(group, links):
        edges = links if group is None else links.unionByName(group.select(F.col("node").alias("x"), F.col("c").alias("y")))
        return connected_components(edges, "x", "y").withColumnRenamed("component", "c")

    def still_apart(rows: DataFrame) -> DataFrame:
        mixed = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
        return rows.join(mixed, "key")

    tried = group = None
    for turn in range(STARS):
        # a star in every bucket whose members are apart: around another member each time
        rows = entries if group is None else still_apart(with_component(entries, "fp", "c"))
        centre = rows.groupBy("key").agg(F.min_by("fp", F.struct("pos", F.xxhash64("fp", F.lit(turn)))).alias("p"))
        stars = rows.join(centre.join(other, ["key", "p"]), "key").where((F.col("fp") != F.col("p")) & close)
        stars = stars.select(*_pairs("fp", "p")).distinct()
        more, links = found.of(stars if tried is None else stars.join(tried, ["x", "y"], "left_anti"))
        tried = more if tried is None else tried.unionByName(more)
        if group is None or not links.isEmpty():
            group = joined(group, links)
    left = still_apart(with_component(entries, "fp", "c")).join(classes.select("fp", "sketch"), "fp")
    left = cut(left.select("key", "fp", "n", "pos", "kind", "c", "sketch"))
    right = left.toDF("key", "p", "np", "pp", "kp", "cp", "other")
    differ = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("other")[i])) for i in range(SKETCH_LONGS)), F.lit(0))
    alike = differ * (num + den) <= (F.col("n") + F.col("np")) * (den - num)
    rest = left.join(right, "key").where((F.col("fp") < F.col("p")) & (F.col("c") != F.col("cp")) & close & alike)
    _, links = found.of(rest.select(*_pairs("fp", "p")).distinct().join(tried, ["x", "y"], "left_anti"))
    if not links.isEmpty():
        group = joined(group, links)
    least = with_component(classes.select("fp", "least"), "fp", "c")
    named = least.join(least.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("fp", "component_id", "c")
    joins = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return members.join(named, "fp", "left").select(
        "doc_id",
        "rk",
        F.col("n").alias("n_shingles"),
        F.when(joins, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(joins, F.col("c")).alias("component"),
    )


@query("op5_ngram_join")
def op5_ngram_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_documents(docs, gram=4, num=85).select("doc_id", "n_shingles", "component_id")
