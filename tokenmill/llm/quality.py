"""Quality scores: random-indexing vectors, a two-layer network, calibrated probabilities.

Every word gives three units: its hashed lower-case form, its hashed shape
(runs of upper case, lower case, digits and each mark) and its hashed last
two bytes.  Each unit has a fixed sparse ternary index vector; a unit's word
vector is the sum of the index vectors of the units around it over *all*
documents (counted per task as one matrix of co-occurrences, then summed).
A document pools both kinds of vectors over its whole text, with the shares
of repeated neighbours and of distinct words beside them.

``FIT_ROWS`` bounds the labelled rows that the network is fitted on; a part
of them, kept from the fit, sets the temperature.  Defined results: a null or
empty text pools to zeros and gets the score of that; without labelled rows
of both classes every score is 0; a null doc_id is scored like any other,
never learned from; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import cut, table
from tokenmill.llm.labelled import held_out, sample
from tokenmill.llm.registry import query
from tokenmill.llm.words import Prefix, lower_ascii, mix, pieces, word_bounds, word_hashes

FIT_ROWS = 6_000
WORD_UNITS, SHAPE_UNITS, END_UNITS = 512, 256, 256
UNITS = WORD_UNITS + SHAPE_UNITS + END_UNITS
DIM = 48
NONZERO = 6
WINDOW = 2
HIDDEN = 32
SHARED_COUNTS = 6
SEED = 11


def index_vectors(seed: int = SEED) -> np.ndarray:
    """Sparse ternary vectors, one per unit."""
    rng = np.random.default_rng(seed)
    out = np.zeros((UNITS, DIM), np.float32)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint64)
    kind[:] = 1  # letters, also the bytes of other scripts
    kind[65:91] = 2
    kind[48:58] = 3
    for c in range(33, 127):
        if not chr(c).isalnum():
            kind[c] = c + 10
    return kind


_CLASS = _classes()


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of all words (words x 3), word hashes, first word of each row, word lengths."""
    starts, ends, first = word_bounds(data, offsets)
    hashes = word_hashes(lower_ascii(data), starts, ends)
    kind = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    at = np.concatenate([[0], np.cumsum(change)])
    shape = Prefix(mix(kind[change] * np.uint64(0x9E3779B97F4A7C15))).of(at[starts], at[ends])
    last = data[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = data[np.maximum(ends - 2, starts)].astype(np.uint64) if len(ends) else last
    tail = mix(last * np.uint64(256) + before + np.uint64(1))
    out = np.stack(
        [
            hashes % np.uint64(WORD_UNITS),
            WORD_UNITS + shape % np.uint64(SHAPE_UNITS),
            WORD_UNITS + SHAPE_UNITS + tail % np.uint64(END_UNITS),
        ],
        axis=1,
    ).astype(np.int64)
    return out, hashes, first, ends - starts


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors of all units over all documents: sums of the index vectors of their neighbours."""
    index = index_vectors()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(UNITS * UNITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                unit, _, first, _ = units(data, offsets)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for gap in range(1, WINDOW + 1):
                    same = np.flatnonzero(row[gap:] == row[:-gap])
                    for kind in range(3):
                        counts += np.bincount(unit[same, kind] * UNITS + unit[same + gap, kind], minlength=UNITS * UNITS)
        both = counts.reshape(UNITS, UNITS)
        both = both + both.T
        sums = both.astype(np.float64) @ index  # whole numbers
        seen = np.flatnonzero(both.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(sums[seen].astype(np.int64).tolist(), pa.list_(pa.int64()))],
            ["unit", "v"],
        )

    parts = docs.select("text").mapInArrow(work, "unit int, v array<bigint>")
    sums = parts.groupBy("unit").agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(DIM)])
    out = np.zeros((UNITS, DIM))
    for r in sums.collect():  # at most UNITS rows
        out[r[0]] = r[1:]
    length = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(texts, index: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text: pooled index vectors of each kind of unit, pooled word vectors, and shared counts."""
    out = []
    for _, _, data, offsets in pieces(texts):
        unit, hashes, first, lengths = units(data, offsets)
        rows = len(first) - 1
        n = np.diff(first)
        row = np.repeat(np.arange(rows), n)
        parts = []
        for kind, (a, size) in enumerate(
            ((0, WORD_UNITS), (WORD_UNITS, SHAPE_UNITS), (WORD_UNITS + SHAPE_UNITS, END_UNITS))
        ):
            table = np.bincount(row * size + unit[:, kind] - a, minlength=rows * size).reshape(rows, size)
            share = (table / np.maximum(1, n)[:, None]).astype(np.float32)
            parts += [share @ index[a : a + size], share @ vectors[a : a + size]]
        extra = np.zeros((rows, SHARED_COUNTS), np.float32)
        for gap in (1, 2):
            same = np.zeros(len(row), bool)
            same[gap:] = (row[gap:] == row[:-gap]) & (hashes[gap:] == hashes[:-gap])
            extra[:, gap - 1] = np.bincount(row, same, rows) / np.maximum(1, n)
        order = np.lexsort((hashes, row))
        new = np.ones(len(row), bool)
        new[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        extra[:, 2] = np.bincount(row[order], new, rows) / np.maximum(1, n)
        extra[:, 3] = np.log1p(n) / 10
        extra[:, 4] = np.bincount(row, lengths, rows) / np.maximum(1, n) / 10
        lines = np.bincount(np.searchsorted(offsets, np.flatnonzero(data == 10), side="right") - 1, minlength=rows)[:rows]
        extra[:, 5] = np.log1p(lines) / 5
        out.append(np.hstack([*parts, extra]))
    width = 6 * DIM + SHARED_COUNTS
    return np.concatenate(out).astype(np.float32) if out else np.zeros((0, width), np.float32)


@dataclass
class Network:
    """Two layers over standardised inputs; ``temperature`` divides the logit."""

    centre: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(0, ((x - self.centre) / self.spread).clip(-8, 8) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (self.logit(x) / self.temperature).clip(-60, 60).astype(np.float64)
        return 1 / (1 + np.exp(-z))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - y * z).mean())


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = SEED, epochs: int = 40, rate: float = 3e-3) -> Network:
    """Adam on the log loss; a fifth of the rows is kept for stopping and for the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    kept, used = order[: len(x) // 5], order[len(x) // 5 :]
    if len(kept) < 10:
        kept, used = order, order
    centre, spread = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    net = Network(
        centre, spread, (rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1])).astype(np.float32),
        np.zeros(HIDDEN, np.float32), (rng.standard_normal(HIDDEN) * np.sqrt(1 / HIDDEN)).astype(np.float32), 0.0,
    )
    params = ["w1", "b1", "w2", "b2"]
    first, second = {p: 0.0 for p in params}, {p: 0.0 for p in params}
    step, best, best_loss = 0, None, np.inf
    scaled = ((x - centre) / spread).clip(-8, 8).astype(np.float32)
    for _ in range(epochs):
        mixed = rng.permutation(used)
        for at in range(0, len(mixed), 64):
            rows = mixed[at : at + 64]
            a = scaled[rows]
            hidden = np.maximum(0, a @ net.w1 + net.b1)
            z = hidden @ net.w2 + net.b2
            err = (1 / (1 + np.exp(-z.clip(-60, 60))) - y[rows]) / len(rows)
            back = np.outer(err, net.w2) * (hidden > 0)
            grads = {"w1": a.T @ back + 1e-4 * net.w1, "b1": back.sum(0), "w2": hidden.T @ err + 1e-4 * net.w2, "b2": err.sum()}
            step += 1
            for p in params:
                first[p] = 0.9 * first[p] + 0.1 * grads[p]
                second[p] = 0.999 * second[p] + 0.001 * grads[p] ** 2
                move = (first[p] / (1 - 0.9**step)) / (np.sqrt(second[p] / (1 - 0.999**step)) + 1e-8)
                setattr(net, p, getattr(net, p) - rate * move)
        loss = _loss(net.logit(x[kept]), y[kept])
        if loss < best_loss:
            best, best_loss = {p: np.copy(getattr(net, p)) for p in params}, loss
    for p in params:
        setattr(net, p, best[p] if p != "b2" else float(best[p]))
    z = net.logit(x[kept])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    net.temperature = float(grid[np.argmin([_loss(z / t, y[kept]) for t in grid])])
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, Network | None]:
    """Word vectors over all documents, and the network over the labelled sample."""
    vectors, index = word_vectors(docs), index_vectors()
    chosen = cut(sample(docs, labels, "quality", {1: rows, 0: rows}))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column("text"), index, vectors)
            raw = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), raw], ["doc_id", "y", "x"])

    kind = dict(chosen.dtypes)["doc_id"]
    got = chosen.select("doc_id", "text", "y").mapInArrow(work, f"doc_id {kind}, y int, x binary").collect()
    got.sort(key=lambda r: (str(r.doc_id), r.x))
    y = np.array([r.y for r in got])
    if len(set(y.tolist())) < 2:
        return vectors, None
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got])
    return vectors, fit_network(x, y)


def score_quality(docs: DataFrame, vectors: np.ndarray, net: Network | None, column: str = "quality") -> DataFrame:
    """``docs`` with the probability of good quality in ``column``, from ``text``."""
    index = index_vectors()
    kept = [c for c in docs.columns if c != column]
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c != column] + [f"`{column}` double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if net is None:
                score = np.zeros(batch.num_rows)
            else:
                score = net.probability(pooled(batch.column("text"), index, vectors))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], [*kept, column])

    return docs.select(*kept).mapInArrow(work, schema)


@query("op7_quality")
def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors, net = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, vectors, net, "score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
