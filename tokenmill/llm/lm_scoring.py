"""Language-model scores of texts by a weighted backoff automaton learned from the corpus.

The model is an n-gram model over lower-cased words and an end token.  Its
states are the n-grams of up to ``order - 1`` tokens seen in training, its arcs
the seen n-grams, with the log probability

    p(w | h) = (1 - g) c(hw) / c(h) + g p(w | h'),        h' = h without its first token,

and a state's failure arc leads to h' with the weight log(g).  The share g of
what a context leaves to shorter ones depends on the order and on c(h), by
halves of a doubling: it is the share of the corpus' tokens that would be new
after a context seen as often, were each left out of the counts once.  At the
root a word seen c times has (c - D) / N, and all unseen words together the
remaining D V / N, with D V the words seen once: the V + 1 events sum to 1.

The automaton grows with the corpus and is never held whole.  Texts are dealt
into blocks by hash.  A block lists the distinct n-grams it holds (by hashed
names, sorted, as differences) with its own training counts; lists meet by
name range, where counts are summed, and each list is answered by the sums in
its order.  So a block gets the states and arcs that its own texts can reach.
All blocks first tally what the shares g are computed from; then each builds
its part of the automaton and walks all its texts from left to right at once:
each carries its state, takes the arc of its next token or falls through
failure arcs, and accumulates weights.  Texts beyond ``PART_BYTES`` are cut
between words into parts that start with the ``order - 1`` tokens before them,
which lead to the same state.  One exchange moves the texts to their blocks,
and all three readings of a block use it.

Words are told apart by 62 bits of hash, so counts of words are exact for any
vocabulary; names of longer n-grams have ``SPARE_BITS`` more bits than the
corpus' bytes take to count, so of each order fewer than one n-gram in
2 ** SPARE_BITS shares its count.

Defined results: a null text is an empty one, whose only token is its end; a
null id is learned from; repeated rows are scored (and learned from) each; an
empty table gives no rows, and without training texts every score is 0 as is
the base; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import row_key, table
from tokenmill.llm.registry import query
from tokenmill.llm.words import lower_ascii, mix, pieces, ragged, word_bounds, word_hashes

ORDER = 3
BLOCK_BYTES = 3 << 20
BIN_BYTES = 6 << 20
PART_BYTES = 1 << 20
PIECE_BYTES = 1 << 20
WALK = 256
SPARE_BITS = 10
WORD_BITS = 62
_MARK = np.uint64(0x5851F42D4C957F2D)  # the token before the first word and after the last
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# ---------------------------------------------------------------- texts into parts and blocks


def _parts(text: bytes, order: int, limit: int) -> Iterator[tuple[int, bool, bool, bytes]]:
    """``(lead words, begins, last, bytes)`` of a long text, cut between words after ``limit`` bytes."""
    data = np.frombuffer(text, np.uint8)
    separators = np.flatnonzero(_SEPARATOR[data])
    at, n, lead, lead_from = 0, len(data), 0, 0
    while True:
        stop = n
        if n - at > limit:
            k = int(np.searchsorted(separators, at + limit))
            stop = int(separators[k]) if k < len(separators) else n
        yield lead, lead < order - 1, stop >= n, text[lead_from:stop]
        if stop >= n:
            return
        # the last words up to the cut lead the next part
        words, back = 0, stop
        while words < order - 1 and back > 0:
            end = back
            while end > 0 and _SEPARATOR[data[end - 1]]:
                end -= 1
            if not end:
                break
            k = int(np.searchsorted(separators, end)) - 1
            back = int(separators[k]) + 1 if k >= 0 else 0
            words += 1
        at, lead, lead_from = stop, words, back


def dealt(docs: DataFrame, held: Column, order: int, blocks: int, limit: int = PART_BYTES) -> DataFrame:
    """Parts of texts with the block that scores them."""
    ready = docs.select("doc_id", row_key().alias("rk"), held.alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(ready.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            source, lead, begins, last, parts, part, cut = [], [], [], [], [], [], []
            if not (sizes > limit).any():
                source = np.arange(batch.num_rows)
                lead, begins, last = np.zeros(len(source), np.int32), np.ones(len(source), bool), np.ones(len(source), bool)
                parts, part, cut = np.ones(len(source), np.int32), np.zeros(len(source), np.int32), texts
            else:
                for i, size in enumerate(sizes):
                    found = [(0, True, True, None)] if size <= limit else list(_parts(texts[i].as_py().encode(), order, limit))
                    for k, (a, b, c, t) in enumerate(found):
                        source.append(i), lead.append(a), begins.append(b), last.append(c), parts.append(len(found))
                        part.append(k), cut.append(texts[i].as_py() if t is None else t.decode())
                cut = pa.array(cut, pa.string())
                source, part = np.array(source), np.array(part, np.int32)
            keys = batch.column("rk").to_numpy(zero_copy_only=False).view(np.uint64)[source]
            # rows of one key are spread too, by their place in the task's input
            name = mix(mix(keys ^ (np.uint64(row) + source.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) + part.astype(np.uint64))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(((name >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)),
                    batch.column("doc_id").take(pa.array(source)),
                    batch.column("rk").take(pa.array(source)),
                    batch.column("held").take(pa.array(source)),
                    pa.array(parts, pa.int32()), pa.array(lead, pa.int32()), pa.array(begins, pa.bool_()),
                    pa.array(last, pa.bool_()), cut.cast(pa.string()),
                ],
                ["block", "doc_id", "rk", "held", "parts", "lead", "begins", "last", "text"],
            )

    return ready.mapInArrow(
        work, f"block int, doc_id {kind}, rk bigint, held boolean, parts int, lead int, begins boolean, last boolean, text string"
    )


# ---------------------------------------------------------------- the n-grams of a block


def name_bits(size: int) -> int:
    """Bits of an n-gram's name in a corpus of ``size`` bytes."""
    return min(WORD_BITS, max(32, size.bit_length() + SPARE_BITS))


class Block:
    """Token positions of a block's parts and the names of the n-grams that end at them."""

    def __init__(self, rows: pa.Table, order: int, bits: int):
        self.order = order
        lead = rows.column("lead").to_numpy().astype(np.int64)
        begins = rows.column("begins").to_numpy(zero_copy_only=False).astype(np.int64)
        last = rows.column("last").to_numpy(zero_copy_only=False).astype(np.int64)
        held = rows.column("held").to_numpy(zero_copy_only=False).astype(bool)
        hashes, counts = [], []
        for _, _, data, offsets in pieces(rows.column("text"), PIECE_BYTES):
            data = lower_ascii(data)
            starts, ends, first = word_bounds(data, offsets)
            hashes.append(word_hashes(data, starts, ends))
            counts.append(np.diff(first))
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        length = begins + n_words + last
        self.start = np.concatenate([[0], np.cumsum(length)])[:-1]
        self.length, self.rows = length, len(length)
        total = int(length.sum())
        token = np.full(total, _MARK)
        token[ragged(self.start + begins, n_words)] = words
        self.row = np.repeat(np.arange(self.rows), length)
        place = np.arange(total) - self.start[self.row]
        #: positions that are scored: not those of a lead or of the mark before a text
        self.first = begins + lead
        self.scored = place >= self.first[self.row]
        self.learned = self.scored & ~held[self.row]
        gram = token
        self.at = [np.arange(total)]  # positions of each order's n-grams
        self.names = [mix(token) >> np.uint64(64 - WORD_BITS)]
        for k in range(2, order + 1):
            at = np.flatnonzero(place >= k - 1)
            grown = np.zeros(total, np.uint64)
            grown[at] = mix(gram[at - 1] * np.uint64(0xD6E8FEB86659FD93) + token[at])
            gram = grown
            self.at.append(at)
            self.names.append(gram[at] >> np.uint64(64 - bits))

    def distinct(self, counted: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each order the sorted distinct names, with their training counts here."""
        out = []
        for names, at in zip(self.names, self.at):
            # the lowest bit says whether the occurrence is learned from
            every = (names << np.uint64(1)) | self.learned[at].astype(np.uint64)
            every.sort()
            learned = every & np.uint64(1) if counted else None
            every >>= np.uint64(1)
            new = np.ones(len(every), bool)
            np.not_equal(every[1:], every[:-1], out=new[1:])
            first = np.flatnonzero(new)
            counts = np.add.reduceat(learned, first).astype(np.int64) if counted and len(first) else np.zeros(0, np.int64)
            out.append((every[first], counts))
        return out

    def number(self) -> int:
        """Number the distinct n-grams, by order and name; returns how many there are."""
        self.gram, levels, ahead = [], [], 0  # by order: the n-gram that ends at a position, -1 where the text is too short
        for k, (known, _) in enumerate(self.distinct(counted=False)):
            ids = np.full(len(self.row), -1, np.int32)
            found = pc.index_in(pa.array(self.names[k]), value_set=pa.array(known)).to_numpy(zero_copy_only=False)
            ids[self.at[k]] = found + ahead
            self.gram.append(ids)
            levels.append(np.full(len(known), k + 1, np.int8))
            ahead += len(known)
        self.level = np.concatenate(levels)
        self.names = []
        return ahead


def pack(values: np.ndarray) -> bytes:
    """Unsigned values as byte planes, without the high planes that are all zero."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + planes.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    width = data[0]
    if width and n:
        out[:, :width] = np.frombuffer(data, np.uint8, n * width, 1).reshape(width, n).T
    return out.view("<u8").reshape(n).astype(np.uint64)


def _bins(names: np.ndarray, bits: int, bins: int) -> np.ndarray:
    """Where each bin of the name space starts in sorted names of ``bits`` bits (with the end)."""
    high = names >> np.uint64(bits - 32)
    return np.searchsorted((high * np.uint64(bins)) >> np.uint64(32), np.arange(bins + 1, dtype=np.uint64))


_LISTS = "bin int, block int, n bigint, low bigint, names binary, counts binary"
_SUMS = "block int, bin int, n bigint, counts binary, tokens bigint, types bigint, once bigint"
_TALLY = "k int, bucket int, total bigint, fresh bigint, types bigint"


def lists_of(order: int, bits: int, bins: int):
    """A block's lists by bin: of order k those from ``(k - 1) * bins``, so bins below ``bins`` are of words."""

    def work(key, rows):
        out = []
        for k, (names, counts) in enumerate(Block(rows, order, bits).distinct(counted=True)):
            cuts = _bins(names, bits if k else WORD_BITS, bins)
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
                x, y = cuts[b], cuts[b + 1]
                out.append((k * bins + int(b), y - x, int(names[x]), pack(np.diff(names[x:y])), pack(counts[x:y])))
        columns = list(zip(*out)) or [[]] * 5
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        bin_, n, low, names, counts = (pa.array(c, t) for c, t in zip(columns, types))
        block = pa.array([key[0].as_py()] * len(out), pa.int32())
        return pa.table({"bin": bin_, "block": block, "n": n, "low": low, "names": names, "counts": counts})

    return work


def sum_lists(bins: int):
    return lambda key, rows: _sum_lists(key, rows, bins)


def _sum_lists(key, rows, bins):
    """The lists of one bin, each answered by the summed counts of its names.

    The first answer of a bin of words also carries how many tokens were
    learned from, how many words these are, and how many of them came once.
    """
    n = rows.column("n").to_numpy()
    ends = np.cumsum(n)
    names = np.empty(int(ends[-1]), np.uint64)
    weight = np.empty(len(names), np.float64)
    low = rows.column("low").to_numpy().astype(np.uint64)
    for i, (size, steps, counts) in enumerate(zip(n, rows.column("names"), rows.column("counts"))):
        a, b = ends[i] - size, ends[i]
        names[a] = low[i]
        names[a + 1 : b] = unpack(steps.as_py(), size - 1)
        np.cumsum(names[a:b], out=names[a:b])
        weight[a:b] = unpack(counts.as_py(), size)
    coded = pa.array(names).dictionary_encode()
    inverse = coded.indices.to_numpy(zero_copy_only=False)
    total = np.bincount(inverse, weight, len(coded.dictionary)).astype(np.int64)
    answers = [pack(total[inverse[b - s : b]]) for s, b in zip(n, ends)]
    sums = [0, 0, 0]
    if key[0].as_py() < bins:
        sums = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum())]
    rest = [0] * (len(n) - 1)
    return pa.table(
        {
            "block": rows.column("block"),
            "bin": rows.column("bin"),
            "n": rows.column("n"),
            "counts": pa.array(answers, pa.binary()),
            **{name: pa.array([v, *rest], pa.int64()) for name, v in zip(("tokens", "types", "once"), sums)},
        }
    )


def _answers(block: Block, sums: pa.Table) -> np.ndarray:
    """The corpus counts of a block's n-grams, as it numbers them."""
    total = block.number()
    lists = sorted((r["bin"], r["n"], r["counts"]) for r in sums.select(["bin", "n", "counts"]).to_pylist() if r["counts"] is not None)
    counts = np.concatenate([unpack(c, n) for _, n, c in lists]).astype(np.int64) if lists else np.zeros(0, np.int64)
    if len(counts) != total:
        raise ValueError("a block's n-grams differ between its readings")
    return counts


# ---------------------------------------------------------------- the model


def buckets(counts: np.ndarray) -> np.ndarray:
    """Counts from 1 by halves of a doubling."""
    return np.floor(2 * np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64)


def tally_block(order: int, bits: int):
    """What the shares are computed from: of each order and bucket of contexts, tokens and those that would be new."""

    def work(key, rows, sums):
        held = [np.zeros(0, np.int64)] * 5
        if rows.num_rows:
            block = Block(rows, order, bits)
            counts = _answers(block, sums)
            own = [int(sums.column(c).to_numpy().sum()) for c in ("tokens", "once", "types")]
            out = [(1, 0, *own)]
            for k in range(2, order + 1):
                at = block.at[k - 1]
                at = at[block.learned[at]]
                context, gram = counts[block.gram[k - 2][at - 1]], counts[block.gram[k - 1][at]]
                seen = context > 1  # besides the token itself
                b = buckets(context[seen] - 1)
                total, fresh = np.bincount(b), np.bincount(b, gram[seen] == 1)
                out += [(k, i, int(total[i]), int(fresh[i]), 0) for i in np.flatnonzero(total)]
            held = list(zip(*out))
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ("k", "bucket", "total", "fresh", "types")
        return pa.table({name: pa.array(c, t) for name, c, t in zip(names, held, types)})

    return work


class Smoothing:
    """What the tallies of the whole corpus say: sizes, the root's discount, and the shares of each order."""

    def __init__(self, tallies: list[dict], order: int):
        self.tokens = self.distinct = once = 0
        self.share = {k: np.full(160, 0.5) for k in range(2, order + 1)}
        for t in tallies:
            if t["k"] == 1:
                self.tokens, once, self.distinct = t["total"], t["fresh"], t["types"]
            else:
                self.share[t["k"]][t["bucket"]] = (t["fresh"] + 0.5) / (t["total"] + 1)
        self.discount = min(0.9, max(once, 0.5) / self.distinct) if self.distinct else 0.0


class Automaton:
    """States and arcs over a block's n-grams; the root is state -1."""

    def __init__(self, block: Block, counts: np.ndarray, smoothing: Smoothing):
        n = len(counts)
        self.counts, self.order, self.level = counts, block.order, block.level
        self.suffix = np.full(n, -1, np.int32)  # where a state's failure arc leads
        context = np.full(n, -1, np.int32)
        for k in range(1, block.order):
            at = block.at[k]
            self.suffix[block.gram[k][at]] = block.gram[k - 1][at]
            context[block.gram[k][at]] = block.gram[k - 1][at - 1]
        tokens, distinct, discount = smoothing.tokens, smoothing.distinct, smoothing.discount
        self.unseen = math.log10(discount * distinct / tokens) if tokens else 0.0
        weight = np.zeros(n)
        one = (self.level == 1) & (counts > 0)
        weight[one] = np.log10((counts[one] - discount) / tokens) if tokens else 0.0
        self.fall = np.zeros(n)
        for k in range(2, block.order + 1):
            arc = np.flatnonzero((self.level == k) & (counts > 0))
            seen = counts[context[arc]]
            share = smoothing.share[k][buckets(seen)]
            weight[arc] = np.log10((1 - share) * counts[arc] / seen + share * 10.0 ** weight[self.suffix[arc]])
            state = np.flatnonzero((self.level == k - 1) & (counts > 0))
            self.fall[state] = np.log10(smoothing.share[k][buckets(counts[state])])
        self.weight = weight

    def walk(self, block: Block) -> np.ndarray:
        """Log probability of each part: all parts (long ones in stretches) step from left to right together."""
        order = self.order
        begin = block.start + block.first
        end = block.start + block.length
        stretches = -(-(end - begin) // WALK)
        row = np.repeat(np.arange(block.rows), stretches)
        a = begin[row] + WALK * (np.arange(len(row)) - np.repeat(np.cumsum(stretches) - stretches, stretches))
        b = np.minimum(a + WALK, end[row])
        # a stretch starts at the root, order - 1 tokens early: they lead to its state
        lead = np.maximum(a - (order - 1), block.start[row])
        by = np.argsort(lead - b, kind="stable")  # longest first: those under way are a prefix
        row, a, b, lead = row[by], a[by], b[by], lead[by]
        under_way = np.searchsorted(lead - b, -np.arange(int((b - lead).max(initial=0))), side="left")
        total = np.zeros(len(row))
        state = np.full(len(row), -1, np.int64)
        grams = np.stack(block.gram)
        for step, m in enumerate(under_way):
            at = lead[:m] + step
            now, gained, left = state[:m].copy(), np.zeros(m), np.arange(m)
            while len(left):
                s = now[left]
                level = np.where(s >= 0, self.level[s], 0)
                arc = grams[level, at[left]]
                taken = (arc >= 0) & (self.counts[arc] > 0)
                got = left[taken]
                gained[got] += self.weight[arc[taken]]
                now[got] = np.where(level[taken] + 1 < order, arc[taken], self.suffix[arc[taken]])
                lost = ~taken & (s < 0)
                gained[left[lost]] += self.unseen
                fall = ~taken & (s >= 0)
                down = left[fall]
                gained[down] += self.fall[s[fall]]
                now[down] = self.suffix[s[fall]]
                left = down
            state[:m] = now
            total[:m] += np.where(at >= a[:m], gained, 0.0)
        return np.bincount(row, total, block.rows)


def score_block(order: int, bits: int):
    def work(key, rows, sums):
        names = ["doc_id", "rk", "held", "parts", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not rows.num_rows:
            schema = rows.schema
            empty = [schema.field("doc_id").type, pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * 3, *[pa.float64()] * 2]
            return pa.table({n: pa.array([], t) for n, t in zip(names, empty)})
        block = Block(rows, order, bits)
        counts = _answers(block, sums)
        smoothing = Smoothing(next(x for x in sums.column("tallies").to_pylist() if x is not None), order)
        score = Automaton(block, counts, smoothing).walk(block)
        at = np.flatnonzero(block.scored)
        c = counts[block.gram[0][at]]
        row = block.row[at]
        base = np.log10((c + 1) / (smoothing.tokens + smoothing.distinct + 1))
        n = block.rows
        return pa.table(
            {
                "doc_id": rows.column("doc_id"), "rk": rows.column("rk"), "held": rows.column("held"),
                "parts": rows.column("parts"),
                "n_tokens": pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                "n_known": pa.array(np.bincount(row, c > 0, n).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, smoothing.tokens, np.int64)),
                "base_score": pa.array(np.bincount(row, base, n)),
                "score": pa.array(score),
            }
        )

    return work


def score_texts(
    docs: DataFrame, held: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES, bin_bytes: int = BIN_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``docs``: (doc_id, text); ``held``: rows not learned from.  One row per row of ``docs``.

    (doc_id, held, n_tokens, n_known, train_tokens, base_score, score); orders 1 to 7.
    """
    if not 1 <= order <= 7:
        raise ValueError("an order of 1 to 7")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, bins = max(1, -(-size // block_bytes)), max(1, -(-size // bin_bytes))
    kind = dict(docs.dtypes)["doc_id"]
    width, bits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 8), name_bits(size)
    # one exchange of the texts, and one of the answers: all readings of a block use them
    placed = dealt(docs, held, order, blocks, part_bytes).repartition(width, "block")
    lists = placed.groupBy("block").applyInArrow(lists_of(order, bits, bins), _LISTS)
    sums = lists.groupBy("bin").applyInArrow(sum_lists(bins), _SUMS)
    # a row of each block's own carries the tallies to it
    own = spark.range(blocks).select(
        F.col("id").cast("int").alias("block"), F.lit(None).cast("int").alias("bin"), F.lit(0).cast("bigint").alias("n"),
        F.lit(None).cast("binary").alias("counts"), *[F.lit(0).cast("bigint").alias(c) for c in ("tokens", "types", "once")],
    )
    answers = sums.unionByName(own).repartition(width, "block")
    tallies = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tally_block(order, bits), _TALLY)
    by = tallies.groupBy("k", "bucket").agg(*[F.sum(c).alias(c) for c in ("total", "fresh", "types")])
    # one row, of at most 160 buckets for each order
    whole = by.agg(F.collect_list(F.struct("k", "bucket", "total", "fresh", "types")).alias("tallies"))
    told = answers.join(F.broadcast(whole)).withColumn("tallies", F.when(F.col("bin").isNull(), F.col("tallies")))
    schema = f"doc_id {kind}, rk bigint, held boolean, parts int, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    found = placed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score_block(order, bits), schema)
    # parts of a text, and repeated rows, meet again
    whole = found.groupBy("doc_id", "rk", "held", "parts").agg(
        F.count("*").alias("rows"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")],
        F.max("train_tokens").alias("train_tokens"),
    )
    copies = (F.col("rows") / F.col("parts")).cast("int")
    each = [(F.col(c) / copies).cast("bigint").alias(c) for c in ("n_tokens", "n_known")]
    each += ["train_tokens", *[(F.col(c) / copies).alias(c) for c in ("base_score", "score")]]
    return whole.select("doc_id", "held", *each, F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


def left_out(folds: int = 7, fold: int = 2) -> Column:
    """Rows whose id's crc32 as text, modulo ``folds``, is ``fold`` (a null id is learned from)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


@query("op13_lm_score")
def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, left_out()).withColumnRenamed("held", "held_out")
