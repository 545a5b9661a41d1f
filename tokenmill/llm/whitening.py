"""Whitening of embeddings by shifted Cholesky QR.

The fit list (each distinct whole-number vector once) is centred and
orthogonalised in passes: a pass multiplies the centred rows by the inverse of
the upper factor so far (a triangular solve per batch) and sums their Gram
matrix over Spark, a row of the matrix per key; its Cholesky factor, shifted
by a multiple of the rounding error in the first pass and wherever the matrix
is not definite, is composed onto the factor.  When the rows are orthonormal
to rounding, the small factor R satisfies A = QR, and its singular value
decomposition gives the components: right vectors, and squared singular
values over n.  A last pass measures the covariance of the whitened fit rows.

Only matrices of the vector's width reach the driver, at most ``MAX_CELLS``
cells over all widths (an error beyond that).

Defined results: vectors that are null or hold null or non-finite entries
give no rows; an entry x beyond a long is held at its ends, and so is a
deviation; every vector length is a fit of its own; directions without
variance (below ``FLAT`` of the greatest) have no component, so a table of
one distinct vector gives no rows; fewer than ``k`` components are returned
where the rank is lower; repeated rows give repeated results; other columns
are not read.  A component's largest entry is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import table
from tokenmill.llm.registry import query
from tokenmill.llm.topk import usable
from tokenmill.session import scratch_path

MAX_CELLS = 1 << 26
PASSES = 6
GOOD = 1e-11
FLAT = 1e-12
_LONG = np.iinfo(np.int64)
_ROUND = np.finfo(np.float64).eps / 2


@dataclass
class Whitener:
    """Of one vector length: ``n`` fit rows, their sums (exact), components (columns) and their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0


def whole_vectors(rows: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """``rows`` with usable vectors, and ``x``: their entries times ``scale`` as whole numbers."""
    as_long = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c).cast("bigint"))
    return rows.where(usable(vector)).withColumn("x", as_long)


def _matrix(column) -> np.ndarray:
    """Rows of one length as a matrix of longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each vector length the row numbers and the rows."""
    lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        yield int(width), at, _matrix(batch.column("x").take(pa.array(at)))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n``: the whole-number difference is exact, one division rounds."""
    return _times(x, n, sums).astype(np.float64) / n


def _times(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, in longs where they suffice and in Python integers otherwise."""
    most = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    if n * most + max((abs(s) for s in sums), default=0) < 2**63:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sums of squares of ``n * x - sums``, exact, held at the end of a long."""
    off = _times(x, n, sums)
    most = max(abs(int(off.max(initial=0))), abs(int(off.min(initial=0))))
    if off.dtype != object and most * most * max(1, off.shape[1]) < 2**63:
        return (off * off).sum(axis=1)
    exact = (off.astype(object) ** 2).sum(axis=1)
    return np.array([min(int(v), _LONG.max) for v in exact], np.int64)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Of each vector length the number of rows and the exact sums of the dimensions."""

    def work(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for width, _, x in _by_width(batch):
                got = held.setdefault(width, [0, [0] * width])
                got[0] += len(x)
                small = x.size == 0 or max(abs(int(x.max())), abs(int(x.min()))) < 2**31
                part = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
                got[1] = [a + int(b) for a, b in zip(got[1], part)]
        for width, (n, sums) in held.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "width": pa.array([width] * (width + 1), pa.int32()),
                    "i": pa.array(range(-1, width), pa.int32()),
                    # two halves of 2**30, so that the sums of any number of tasks stay exact
                    "high": pa.array([v >> 30 for v in [n, *sums]], pa.decimal128(38, 0)),
                    "low": pa.array([v & (1 << 30) - 1 for v in [n, *sums]], pa.int64()),
                }
            )

    parts = fit.select("x").mapInArrow(work, "width int, i int, high decimal(38,0), low bigint")
    total = parts.groupBy("width", "i").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    out: dict[int, dict[int, int]] = {}
    for r in total.collect():  # a row per dimension
        out.setdefault(r.width, {})[r.i] = (int(r.high) << 30) + int(r.low)
    return {w: (by[-1], [by[i] for i in range(w)]) for w, by in out.items() if w}


def _gram(fit: DataFrame, project: dict[int, tuple[int, list[int], np.ndarray | None, np.ndarray | None]]) -> dict[int, np.ndarray]:
    """Of each vector length the sum of ``q' q`` over all rows.

    ``q`` solves ``q R = x - mean`` for the upper factor R (None: the identity);
    with a matrix beside it, ``q`` is ``(1, (x - mean) times the matrix)``, so
    that the sums of its columns are measured too.
    """

    def work(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in _by_width(batch):
                if width not in project:
                    continue
                n, sums, factor, columns = project[width]
                q = centred(x, n, sums)
                if factor is not None:
                    q = solve_upper(factor, q)
                if columns is not None:
                    q = np.hstack([np.ones((len(q), 1)), q @ columns])
                part = q.T @ q
                held[width] = held[width] + part if width in held else part
        for width, gram in held.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "width": pa.array([width] * len(gram), pa.int32()),
                    "i": pa.array(range(len(gram)), pa.int32()),
                    "row": pa.array(gram.tolist(), pa.list_(pa.float64())),
                }
            )

    def add(key, rows):
        # sorted, so that reruns add in one order
        each = sorted(rows.column("row").to_pylist())
        return pa.table(
            {"width": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()),
             "row": pa.array([np.sum(each, axis=0).tolist()], pa.list_(pa.float64()))}
        )

    kind = "width int, i int, row array<double>"
    parts = fit.select("x").mapInArrow(work, kind)
    # sums of a few hundred tasks at a time, then of these
    some = parts.withColumn("part", F.spark_partition_id() % 64).groupBy("width", "i", "part").applyInArrow(add, kind)
    out: dict[int, dict[int, list]] = {}
    for r in some.groupBy("width", "i").applyInArrow(add, kind).collect():  # a row per dimension
        out.setdefault(r.width, {})[r.i] = r.row
    return {w: np.array([by[i] for i in range(len(by))]) for w, by in out.items()}


def solve_upper(factor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``q`` with ``q @ factor = rows`` for an upper triangular factor: column by column, in blocks."""
    q = np.array(rows, np.float64)
    width, block = len(factor), 32
    for a in range(0, width, block):
        b = min(width, a + block)
        if a:
            q[:, a:b] -= q[:, :a] @ factor[:a, a:b]
        for j in range(a, b):
            if j > a:
                q[:, j] -= q[:, a:j] @ factor[a:j, j]
            q[:, j] /= factor[j, j]
    return q


def cholesky_upper(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of ``gram``, with the shift of the method where asked for or needed."""
    d = len(gram)
    size = max(float(np.linalg.norm(gram, 2)), np.finfo(np.float64).tiny)
    shift = 11 * (n * d + d * (d + 1)) * _ROUND * size
    shift = min(shift, 1e-4 * size)  # at billions of rows the bound of the method is far above the error
    tries = [shift] if shifted else [0.0]
    tries += [shift * 10**i for i in range(1, 12)] if shifted else [4 * d * _ROUND * size * 10**i for i in range(14)]
    for s in tries:
        try:
            return np.linalg.cholesky(gram + s * np.eye(d)).T
        except np.linalg.LinAlgError:
            continue
    raise ValueError("a Gram matrix is not finite")


def fit_whitening(fit: DataFrame, k: int) -> dict[int, Whitener]:
    """Components of every vector length of ``fit`` (``x``: distinct whole-number vectors)."""
    counts = _sums(fit)
    if sum(w * w for w in counts) > MAX_CELLS:
        raise ValueError(f"vectors are wider than whitening holds: over {MAX_CELLS} cells of Gram matrices")
    factors: dict[int, np.ndarray | None] = {w: None for w in counts}
    todo = {w for w, (n, _) in counts.items() if n > 1}
    for step in range(PASSES):
        if not todo:
            break
        grams = _gram(fit, {w: (*counts[w], factors[w], None) for w in todo})
        for w, gram in grams.items():
            gram = (gram + gram.T) / 2
            if not gram.any():
                todo.discard(w)
                continue
            if step and np.abs(gram - np.eye(w)).max() <= GOOD:
                todo.discard(w)
                continue
            upper = cholesky_upper(gram, counts[w][0], shifted=step == 0)
            factors[w] = upper if factors[w] is None else upper @ factors[w]
    fits: dict[int, Whitener] = {}
    for w, factor in factors.items():
        if factor is None:
            continue
        n, sums = counts[w]
        _, sigma, right = np.linalg.svd(factor)
        variances = sigma**2 / n
        held = variances > FLAT * variances[0]
        components = right[held].T[:, :k]
        components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])])
        fits[w] = Whitener(n, sums, components, variances[held][:k], float(variances[held].sum()))
    measured = _gram(fit, {w: (f.n, f.sums, None, f.components / np.sqrt(f.variances)) for w, f in fits.items()}) if fits else {}
    for w, gram in measured.items():
        mean = gram[0, 1:] / gram[0, 0]
        covariance = gram[1:, 1:] / gram[0, 0] - np.outer(mean, mean)
        fits[w].identity_error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return fits


def whiten(rows: DataFrame, vector: str = "embedding", ident: str = "vec_id", k: int = 4, scale: int = 256) -> DataFrame:
    """One row per usable row and component: (id, component, n, deviation, whitened, explained, identity_error)."""
    spark = rows.sparkSession
    ready = whole_vectors(rows.select(F.col(ident).alias("id"), F.col(vector).alias("v")), "v", scale).select("id", "x")
    path = scratch_path(spark, "whitening")
    ready.select("x").distinct().write.parquet(path)
    fits = fit_whitening(spark.read.schema("x array<bigint>").parquet(path), k)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, x in _by_width(batch):
                fit = fits.get(width)
                if fit is None or not fit.components.shape[1]:
                    continue
                count = fit.components.shape[1]
                values = centred(x, fit.n, fit.sums) @ (fit.components / np.sqrt(fit.variances))
                total = len(x) * count
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(np.repeat(at, count))),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(total, fit.n, np.int64)),
                        pa.array(np.repeat(deviations(x, fit.n, fit.sums), count)),
                        pa.array(values.ravel()),
                        pa.array(np.tile(fit.variances / fit.trace, len(x))),
                        pa.array(np.full(total, fit.identity_error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = dict(ready.dtypes)["id"]
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return ready.mapInArrow(work, schema)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")
