"""Best-fit packing of tokenized documents with a grouping genetic algorithm.

Documents become pieces of at most one sequence; full pieces are bins by
themselves.  The others are dealt into regions of a bounded number of pieces,
and each region is packed by islands: a grouping GA whose genes are whole
bins.  Crossover injects the well-filled bins of one parent into the other,
bins that hold a piece twice are dissolved, and displaced pieces go to the
best-fitting bin.  After each epoch an island's elites migrate to the next
island of the region (rows that change their key).  Bins that stay below a
fill are dissolved and their pieces dealt again into fewer regions, until one
region is left, so a region's last bins do not add up over regions.

Defined results: a null or empty text is one piece that holds only the closing
id; repeated rows are documents of their own; empty input gives empty output.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.common import cut, table
from tokenmill.llm.registry import query
from tokenmill.llm.words import keep_in_worker, lower_ascii, pieces, ragged, word_bounds, word_bytes

CAPACITY = 2048
REGION = 3000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 120
POPULATION = 12
ELITES = 2
#: Bins below this share of the capacity are dissolved and packed again with those of other regions.
SETTLED = 0.995
ROUNDS = 4
CACHE_WORDS = 350_000
CALL_TEXTS = 4
#: A piece's distinct words are looked up one by one, so larger pieces cost less; few temporaries live per byte.
TOKEN_BYTES = 3 << 20


# --- tokens -------------------------------------------------------------------

_TOKENIZERS: dict[str, list] = keep_in_worker("tokenizers", {})
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def _tokenizer(path: str) -> list:
    """The tokenizer and two generations of encoded words (old ones go when the newer fills up)."""
    got = _TOKENIZERS.get(path)
    if got is None:
        from tokenizers import Tokenizer

        # tasks are the parallel units; threads of a worker would each keep memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        got = _TOKENIZERS[path] = [Tokenizer.from_file(path), {}, {}]
    return got


def _without_stops(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut closing stops off words that end in a letter: (starts, ends) of the parts, and which words were cut.

    The vocabulary's pre-tokenizer splits there anyway, and far fewer
    distinct words are left.
    """
    at = ends.copy()
    for _ in range(4):
        at = at - ((at - starts > 1) & _STOP[low[at - 1]])
    last, before = low[at - 1], low[np.maximum(at - 2, starts)]
    letter = _LETTER[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (at - starts > 1))
    cut = (at < ends) & letter
    place = np.arange(len(starts)) + np.cumsum(cut) - cut
    a, b = np.empty(len(starts) + int(cut.sum()), np.int64), np.empty(len(starts) + int(cut.sum()), np.int64)
    a[place], b[place] = starts, np.where(cut, at, ends)
    a[place[cut] + 1], b[place[cut] + 1] = at[cut], ends[cut]
    return a, b, cut


def _lowered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case, but for words that hold ``<|``.

    The tokenizer looks for its special tokens in the text as it stands and
    lower-cases only what is left: ``<|EndOfText|>`` is none of them.
    """
    low = lower_ascii(data)
    opens = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    if len(opens):
        starts, ends, _ = word_bounds(data, offsets)
        held = np.unique(np.searchsorted(starts, opens, side="right") - 1)
        held = held[held >= 0]
        at = ragged(starts[held], (ends - starts)[held])
        low[at] = data[at]
    return low


def _encode_words(tok, words: list[str]) -> Iterator[tuple[str, bytes]]:
    """Ids of single words, a thousand to a text and a few texts to a call, so that few encodings live at a time."""
    groups = [words[i : i + 1000] for i in range(0, len(words), 1000)]
    for first in range(0, len(groups), CALL_TEXTS):
        some = groups[first : first + CALL_TEXTS]
        for group, coded in zip(some, tok.encode_batch(some, is_pretokenized=True, add_special_tokens=False)):
            raw = np.array(coded.ids, np.uint32).tobytes()
            places = np.array(coded.word_ids, np.float64)  # in order of words
            at = (4 * np.searchsorted(places, np.arange(len(group) + 1))).tolist()
            for i, word in enumerate(group):
                yield word, raw[at[i] : at[i + 1]]


def token_ids(texts, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, ids, offsets)`` of runs of rows.

    The vocabulary is of lower case and its pre-tokenizer never joins text
    across white space, so each distinct word is encoded once and kept.
    """
    for row, _, data, offsets in pieces(texts, TOKEN_BYTES, "tokenizers"):
        state = _tokenizer(path)
        tok = state[0]
        low = _lowered(data, offsets)
        starts, ends, first = word_bounds(low, offsets)
        ahead_cut = np.zeros(len(starts) + 1, np.int64)
        if len(starts):
            starts, ends, cut_words = _without_stops(low, starts, ends)
            np.cumsum(cut_words, out=ahead_cut[1:])
        first = first + ahead_cut[first]
        lengths = ends - starts
        bounds = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=bounds[1:])
        flat = low[word_bytes(low)]  # words are all bytes that do not separate, in order
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new, old = state[1], state[2]
        if len(new) > CACHE_WORDS:
            state[2] = old = new
            state[1] = new = {}
        missing = []
        for w in distinct:
            if w not in new:
                got = old.get(w)
                if got is None:
                    missing.append(w)
                else:
                    new[w] = got
        new.update(_encode_words(tok, missing))
        parts = [new[w] for w in distinct]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(parts), np.uint32)
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pool[ragged(begin[which], sizes[which])] if len(which) else pool[:0]
        ahead = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes[which], out=ahead[1:])
        yield row, ids, ahead[first]


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) to (doc_id, piece, start, length, ids_crc32); id 0 closes a document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for row, ids, offsets in token_ids(batch.column("text"), path):
                ids = np.insert(ids, offsets[1:], 0).astype("<u4")  # one closing id after each document
                offsets = offsets + np.arange(len(offsets))
                rows, number, start, length, crc = [], [], [], [], []
                for i in range(len(offsets) - 1):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    for k, at in enumerate(range(a, b, capacity)):
                        end = min(b, at + capacity)
                        rows.append(row + i)
                        number.append(k)
                        start.append(at - a)
                        length.append(end - at)
                        crc.append(zlib.crc32(ids[at:end].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.take(pa.array(rows, pa.int64())),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


# --- grouping genetic algorithm ------------------------------------------------


def best_fit(order: list[int], sizes: list[int], genes: np.ndarray, rooms: list[int]) -> None:
    """Put pieces, in this order, where the least room is left; ``genes`` and ``rooms`` grow in place."""
    free = sorted((room, b) for b, room in enumerate(rooms) if room)
    for i in order:
        s = sizes[i]
        k = bisect_left(free, (s, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            room, b = CAPACITY, len(rooms)
            rooms.append(room)
        genes[i] = b
        rooms[b] = room - s
        if room - s:
            insort(free, (room - s, b))


def _value(genes: np.ndarray, sizes: np.ndarray) -> float:
    """Fewer bins first, then fuller ones (mean of squared fills, below 1)."""
    fills = np.bincount(genes, sizes) / CAPACITY
    return float((fills**2).mean()) - len(fills)


def _child(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, rng) -> np.ndarray:
    """Inject whole well-filled bins of ``one`` into ``other``.

    Bins of ``other`` that share a piece with them, and a few of its emptiest
    bins, are dissolved; their other pieces go to the best-fitting bins.
    """
    fills, others = np.bincount(one, sizes), np.bincount(other, sizes)
    good = np.flatnonzero(fills >= np.median(fills))
    injected = np.zeros(len(fills), bool)
    injected[rng.choice(good, max(1, len(good) // 2), replace=False)] = True
    placed = injected[one]
    dissolved = np.zeros(len(others), bool)
    dissolved[other[placed]] = True
    worst = np.argsort(others, kind="stable")[: max(2, len(others) // 20)]
    dissolved[rng.choice(worst, max(1, len(worst) // 2), replace=False)] = True
    kept = ~dissolved[other] & ~placed
    genes = np.full(len(sizes), -1, np.int64)
    genes[placed] = one[placed]
    genes[kept] = len(fills) + other[kept]
    done = genes >= 0
    _, genes[done] = np.unique(genes[done], return_inverse=True)
    rooms = (CAPACITY - np.bincount(genes[done], sizes[done])).astype(np.int64).tolist()
    displaced = np.flatnonzero(~done)
    best_fit(displaced[np.argsort(-sizes[displaced], kind="stable")].tolist(), sizes.tolist(), genes, rooms)
    return genes


def evolve(sizes: np.ndarray, population: list[np.ndarray], seed: int, generations: int = GENERATIONS) -> list[np.ndarray]:
    """One epoch of an island; the population comes back best first.

    Stops early when the bound ``ceil(sum / capacity)`` is reached.
    """
    rng = np.random.default_rng(seed)
    n, least = len(sizes), -(-int(sizes.sum()) // CAPACITY)
    ranked = [(_value(g, sizes), k, g) for k, g in enumerate(population)]
    made = len(ranked)
    while made < POPULATION and not any(-v < least + 1 for v, _, _ in ranked):
        noise = sizes * (1 + 0.02 * made * rng.random(n))
        genes = np.zeros(n, np.int64)
        best_fit(np.argsort(-noise, kind="stable").tolist(), sizes.tolist(), genes, [])
        ranked.append((_value(genes, sizes), made, genes))
        made += 1
    ranked.sort(key=lambda x: (-x[0], x[1]))
    for _ in range(generations):
        if -ranked[0][0] < least + 1:  # the value is minus the bins plus a fraction
            break
        a, b = rng.choice(len(ranked), 2, replace=len(ranked) < 2)
        child = _child(ranked[a][2], ranked[b][2], sizes, rng)
        ranked.append((_value(child, sizes), made, child))
        made += 1
        ranked = sorted(ranked, key=lambda x: (-x[0], x[1]))[:POPULATION]
    return [g for _, _, g in ranked]


_STATE = "region long, island int, sizes array<int>, genes array<array<int>>"


def _epoch(state: DataFrame, epoch: int) -> DataFrame:
    """Evolve every island from its own and the migrated solutions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                start = [np.array(g, np.int64) for g in row["genes"]]
                # a seed from region, island and epoch: a task that runs again gives the same solutions
                seed = (row["region"] * 1_000_003 + row["island"] * 101 + epoch) % (1 << 31)
                best = evolve(sizes, start, seed)
                yield pa.RecordBatch.from_pylist(
                    [row | {"genes": [g.tolist() for g in best]}],
                    schema=pa.schema(
                        [
                            ("region", pa.int64()),
                            ("island", pa.int32()),
                            ("sizes", pa.list_(pa.int32())),
                            ("genes", pa.list_(pa.list_(pa.int32()))),
                        ]
                    ),
                )

    return state.mapInArrow(work, _STATE)


def _migrate(state: DataFrame, islands: int) -> DataFrame:
    """Each island keeps its solutions and receives the elites of the island before it."""
    elites = state.select(
        "region",
        F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"),
        F.slice("genes", 1, ELITES).alias("guests"),
    )
    return state.join(elites, ["region", "island"], "left").select(
        "region", "island", "sizes", F.concat("genes", F.coalesce("guests", F.expr("array()"))).alias("genes")
    )


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pack_round(items: DataFrame, regions: int, salt: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Pack (key, length) once: settled rows (key, bin, offset) and, unless last, those to pack again."""
    dealt = items.withColumn("region", F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(regions)))
    held = dealt.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("held"))
    islands = F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))
    held = cut(held)
    state = held.select(
        "region",
        islands.alias("island"),
        F.col("held.length").cast("array<int>").alias("sizes"),
        F.array().cast("array<array<int>>").alias("genes"),
    )
    state = state.repartition(max(1, min(regions * ISLANDS, 4 * _width(items))), "region", "island")
    for epoch in range(EPOCHS):
        state = _epoch(state if epoch == 0 else _migrate(state, ISLANDS), epoch)
        if epoch + 1 < EPOCHS:
            state = cut(state)
    first = state.select("region", F.element_at("genes", 1).alias("genes"))
    best = first.withColumn("n", F.array_max("genes")).groupBy("region").agg(F.min_by("genes", F.struct("n", "genes")).alias("genes"))
    solved = held.join(best, "region").select(
        "region", F.explode(F.arrays_zip(F.col("held.key").alias("key"), F.col("held.length").alias("length"), "genes")).alias("x")
    )
    solved = solved.select("region", F.col("x.genes").alias("gene"), F.col("x.key").alias("key"), F.col("x.length").alias("length"))
    inside = Window.partitionBy("region", "gene").orderBy("key")
    bins = solved.withColumn("offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "fill", F.sum("length").over(Window.partitionBy("region", "gene"))
    )
    bins = cut(
        bins.select(
            "key",
            "length",
            "fill",
            F.coalesce("offset", F.lit(0)).alias("offset"),
            F.min("key").over(Window.partitionBy("region", "gene")).alias("bin"),
        )
    )
    if last:
        return bins.select("key", "bin", "offset"), None
    done = F.col("fill") >= int(SETTLED * CAPACITY)
    return bins.where(done).select("key", "bin", "offset"), bins.where(~done).select("key", "length")


def pack(items: DataFrame, region: int = REGION) -> DataFrame:
    """(key long unique, length) to (key, bin, offset); a bin is named by its least key."""
    out = items.where(F.col("length") >= CAPACITY).select("key", F.col("key").alias("bin"), F.lit(0).cast("bigint").alias("offset"))
    rest = items.where(F.col("length") < CAPACITY).select("key", "length")
    for salt in range(ROUNDS):
        n = rest.count()
        if n == 0:
            break
        regions = max(1, -(-n // region))
        last = regions == 1 or salt == ROUNDS - 1
        settled, rest = _pack_round(rest, regions, salt, last)
        out = out.unionByName(settled.withColumn("offset", F.col("offset").cast("bigint")))
        if last:
            break
    return out


def pack_documents(docs: DataFrame, vocabulary: str, region: int = REGION) -> DataFrame:
    """Pieces of ``docs`` with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = cut(tokenized_pieces(docs, vocabulary).withColumn("key", F.monotonically_increasing_id()))
    placed = pack(made.select("key", "length"), region)
    return made.join(placed, "key").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_packing")
def op2_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), default_vocabulary())
