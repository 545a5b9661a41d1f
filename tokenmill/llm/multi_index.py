"""Embedding near-duplicates with an inverted multi-index.

Unit vectors are cut in halves, each half has its own codebook, and the pair
of nearest words names a cell of the product grid.  Every vector is stored in
its home cell and visits the first cells of its multi-sequence traversal (the
order of rising distance sums); vectors that meet in a cell are compared in
double precision.  The number of cells visited is the least that finds the
home cell of a neighbour at exactly the threshold cosine for the wanted share
of sampled vectors that the codebooks were not fitted on, so closer pairs are
found with more certainty; there is no upper bound on it but all cells.

Only the codebooks come from a sample (``SAMPLE_ROWS`` rows of a length, least
hash of the id); every vector is indexed and every vector is a query.  Equal vectors
are one class with a weight, so copies never form pairs.  A cell with many
vectors is cut into blocks whose pairs are separate tasks, and tasks return
link counts and the roots of their links, not pairs.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components link with nothing and are their own component;
every vector length has a grid of its own, and vectors of other lengths never
link; repeated rows are copies and link with each other; a null vec_id has
no component of its own (null) and is not kept; empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import connected_components, cut, table
from tokenmill.llm.registry import query
from tokenmill.llm.topk import matrix, usable

SAMPLE_ROWS = 16_384
CELL_ROWS = 16
MAX_WORDS = 1024
TARGET_RECALL = 0.98
HELD_ROWS = 2048
FIRST_VISITS = 256
BLOCK_ROWS = 4096
CHUNK = 512


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(top > 0, top, 1)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def _square_distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1)[None, :]


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from ``k`` sampled rows."""
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _square_distances(x, words).argmin(axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        full = counts > 0
        words[full] = sums[full] / counts[full, None]
    return words


@dataclass
class Grid:
    """Two codebooks and the number of cells that a traversal visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int = 1

    @property
    def half(self) -> int:
        return self.first.shape[1]

    @property
    def dim(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def cells(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` cells of every row's multi-sequence traversal, in order.

        The cell with the i-th and j-th nearest words is never among the
        first ``visits`` unless ``(i + 1) * (j + 1) <= visits``, so a batch
        needs only those sums.
        """
        k1, k2 = len(self.first), len(self.second)
        visits = min(visits, k1 * k2)
        d1, d2 = _square_distances(x[:, : self.half], self.first), _square_distances(x[:, self.half :], self.second)
        o1, o2 = np.argsort(d1, axis=1, kind="stable")[:, :visits], np.argsort(d2, axis=1, kind="stable")[:, :visits]
        pairs = [(i, j) for i in range(min(k1, visits)) for j in range(min(k2, visits // (i + 1)))]
        i, j = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        sums = np.take_along_axis(d1, o1, 1)[:, i] + np.take_along_axis(d2, o2, 1)[:, j]
        best = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        return (o1[:, i] * k2 + o2[:, j])[np.arange(len(x))[:, None], best].astype(np.int32)


def neighbour_ranks(grid: Grid, x: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Per pair the place of the cell in which it meets first in either traversal, ``most`` if not among these."""
    ranks = np.full(len(x), most)
    rows = max(16, 1024 * FIRST_VISITS // most)
    for at in range(0, len(x), rows):
        seen, back = grid.cells(x[at : at + rows], most), grid.cells(near[at : at + rows], most)
        for path, home in ((seen, back[:, :1]), (back, seen[:, :1])):  # either of a pair may visit the other
            hit = path == home
            found = np.where(hit.any(axis=1), hit.argmax(axis=1), most)
            ranks[at : at + rows] = np.minimum(ranks[at : at + rows], found)
    return ranks


def fit_grid(sample: np.ndarray, rows: int, threshold: float, recall: float = TARGET_RECALL, seed: int = 7) -> Grid:
    """Codebooks for about ``CELL_ROWS`` rows a cell and a traversal calibrated on rows kept out of their fit."""
    half = sample.shape[1] // 2
    rng = np.random.default_rng(seed + 2)
    held = min(HELD_ROWS, len(sample) // 4)
    mixed = rng.permutation(len(sample))
    fit, x = sample[mixed[held:]], sample[mixed[:held]] if held else sample
    k = int(min(MAX_WORDS, max(1, np.sqrt(rows / CELL_ROWS)), max(1, len(fit) // 4)))
    grid = Grid(codebook(fit[:, :half], k, seed), codebook(fit[:, half:], k, seed + 1))
    x = np.repeat(x, max(1, HELD_ROWS // len(x)), axis=0)  # a small sample gives several neighbours of each row
    away = rng.standard_normal(x.shape)
    away = unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    near = threshold * x + np.sqrt(1 - threshold * threshold) * away
    wanted = min(len(x) - 1, int(np.ceil(recall * len(x))))
    most = min(FIRST_VISITS, k * k)
    while (rank := np.sort(neighbour_ranks(grid, x, near, most))[wanted]) == most < k * k:
        most = min(2 * most, k * k)
    grid.visits = int(min(most, rank + 1))
    return grid


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of linked rows; labels are the least row of a class."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (nxt := label[label]).tobytes() != label.tobytes():
            label = nxt


def compare_block(cell: int, left: int, right: int, block: pa.Table, threshold: float) -> pa.Table:
    """Links of one cell between two of its blocks: per row the weight linked and the least id of its class here.

    A pair that would also meet in the other row's home cell counts in the
    smaller of the two cells.
    """
    order = np.argsort(block.column("rep").to_numpy(), kind="stable")
    rep = block.column("rep").to_numpy()[order]
    weight = block.column("weight").to_numpy()[order].astype(np.float64)
    home = block.column("home").to_numpy()[order]
    part = block.column("part").to_numpy()[order]
    seen = matrix(block.column("visits")).astype(np.int64)[order]
    x = unit(matrix(block.column("vector"))[order])
    n = len(rep)
    gained, label = np.zeros(n), np.arange(n)
    rows, cols = np.flatnonzero(part == left), np.flatnonzero(part == right)
    for at in range(0, len(rows), CHUNK):
        one = rows[at : at + CHUNK]
        i, j = np.nonzero(x[one] @ x[cols].T >= threshold)
        a, b = one[i], cols[j]
        keep = (home[a] == cell) | (home[b] == cell)
        if left == right:
            keep &= a < b
        a, b = a[keep], b[keep]
        ha, hb = home[a], home[b]
        other = np.where(ha == cell, hb, ha)  # equals cell if both live here
        local = np.where(ha == cell, a, b)
        twice = (other != cell) & (seen[local] == other[:, None]).any(axis=1)
        keep = ~twice | (cell < other)
        a, b = a[keep], b[keep]
        gained += np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        label = _roots(label, a, b)
    hit = gained > 0
    return pa.table(
        {
            "rep": pa.array(rep[hit], pa.int64()),
            "gained": pa.array(gained[hit].astype(np.int64)),
            "root": pa.array(rep[label[hit]], pa.int64()),
        }
    )


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, recall: float = TARGET_RECALL, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``vectors`` (id, vector) to (id, n_links, component_id, kept), one row per input row."""
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), "vector")
    fine = usable("vector") & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull()
    rows = rows.withColumn("vector", F.when(fine, F.col("vector")))
    classes = cut(
        rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    )
    lengths = {r.dim: r.n for r in classes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    links = edges = None
    if lengths:
        grids = {}
        for dim, total in lengths.items():
            if total < 4 * CELL_ROWS:  # one cell
                grids[dim] = Grid(np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))
                continue
            own = classes.where(F.size("vector") == dim)
            sample = own.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("vector").collect()
            grids[dim] = fit_grid(unit(np.array([r.vector for r in sample], float)), total, threshold, recall)
        most = max(grid.visits for grid in grids.values())
        step = max(16, 2048 * FIRST_VISITS // max(FIRST_VISITS, most))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
                for part in (
                    own.slice(at, step)
                    for dim in np.unique(sizes)
                    for own in [batch.filter(pa.array(sizes == dim))]
                    for at in range(0, own.num_rows, step)
                ):
                    x = unit(matrix(pa.chunked_array([part.column("vector")])))
                    cells = grids[x.shape[1]].cells(x, grids[x.shape[1]].visits)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("rep"),
                            part.column("weight"),
                            part.column("vector"),
                            pa.array(np.full(len(x), x.shape[1], np.int32)),
                            pa.array(cells[:, 0].astype(np.int32)),
                            pa.ListArray.from_arrays(
                                np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), pa.array(cells.ravel())
                            ),
                        ],
                        ["rep", "weight", "vector", "dim", "home", "visits"],
                    )

        kind = dict(classes.dtypes)["vector"]
        placed = (
            classes.select("rep", "weight", "vector")
            .mapInArrow(place, f"rep bigint, weight bigint, vector {kind}, dim int, home int, visits array<int>")
        )
        met = placed.withColumn("cell", F.explode("visits"))
        sizes = placed.select("dim", F.explode("visits").alias("cell")).groupBy("dim", "cell").agg(F.count("*").alias("n"))
        parts = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
        met = (
            met.join(sizes.select("dim", "cell", parts.alias("parts")), ["dim", "cell"])
            .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("lo", F.least("part", "other"))
            .withColumn("hi", F.greatest("part", "other"))
            .drop("parts", "other")
        )

        def compare(key, block):
            return compare_block(*(k.as_py() for k in key[1:]), block, threshold)

        found = cut(met.groupBy("dim", "cell", "lo", "hi").applyInArrow(compare, "rep bigint, gained bigint, root bigint"))
        links = found.groupBy("rep").agg(F.sum("gained").alias("gained"))
        edges = found.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst"))
    members = classes.select("vector", "rep", "weight")
    out = rows.where("vector is not null").join(members, "vector").drop("vector")
    if links is not None:
        components = connected_components(edges).select(F.col("node").alias("rep"), "component")
        out = out.join(links, "rep", "left").join(components, "rep", "left")
    else:
        out = out.withColumn("gained", F.lit(0)).withColumn("component", F.lit(None).cast("bigint"))
    out = out.select(
        "id",
        (F.coalesce("gained", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    ).unionByName(
        rows.where("vector is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


@query("op8_multi_index")
def op8_multi_index(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return near_vectors(rows, threshold=0.95).withColumnRenamed("id", "vec_id")
