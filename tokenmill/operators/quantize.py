"""Nearest-centroid units (J7) and residual codes.

Frames are compared with every centroid - a theta join that would be a
cross join in SQL.  Instead the codebooks, whose size is fixed by the model
(checked against ``max_cells`` before anything is collected), are broadcast
once and each Arrow batch of frames is scored with numpy in blocks of bounded
size: a matrix product shortlists the centroids that rounding leaves in
question, exact squared differences decide between them, at any codebook
size.  Ties go to the lowest centroid id.

Codebooks above the broadcast bound are cut into tiles of centroids.  A block
of frames and a tile meet in one task, which gives each frame's nearest
centroid of that tile; the least (distance, id) over all tiles is an algebraic
minimum.  Residuals are taken where a frame meets the tile of its centroid,
and kept for the next codebook in the shared checkpoint folder.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 16 * 1024 * 1024  # centroid count x dimension broadcast bound (128 MiB of float64; 10k x 1280 fits)
BLOCK_CELLS = 1 << 20  # distances held at a time (8 MiB)
TILE_CELLS = 1 << 22  # cells of a codebook tile (32 MiB)
BLOCK_ROWS = 1 << 14  # frames that meet a tile at a time


def _book_size(books: DataFrame, vec: str) -> tuple[int, int]:
    stats = books.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    return stats["n"] or 0, stats["d"] or 0


def _collect_books(books: DataFrame, cid: str, vec: str, q: str | None) -> dict[int, np.ndarray]:
    """Codebooks as ``{q: float64[K, D]}`` rows ordered by centroid id; callers check their size."""
    cols = [F.col(cid), F.col(vec)] + ([F.col(q)] if q else [])
    rows = books.select(*cols).collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(int(r[q]) if q else 0, []).append((int(r[cid]), np.asarray(r[vec], dtype=np.float64)))
    mats = {}
    for k, items in out.items():
        items.sort(key=lambda t: t[0])
        ids = [i for i, _ in items]
        if ids != list(range(len(ids))):
            raise ValueError("centroid ids must be 0..K-1 within each codebook")
        mats[k] = np.stack([v for _, v in items])
    return mats


def _argmin(V: np.ndarray, C: np.ndarray) -> np.ndarray:
    K, D = C.shape
    cc = (C * C).sum(1)
    rows = max(1, BLOCK_CELLS // max(1, K))
    out = np.empty(len(V), dtype=np.int64)
    for s in range(0, len(V), rows):
        blk = V[s : s + rows]
        vv = (blk * blk).sum(1)[:, None]
        near = vv - 2.0 * (blk @ C.T) + cc[None, :]
        # each distance is off by at most this: sums of D products, rounded
        off = 8.0 * (D + 4) * np.finfo(np.float64).eps * (vv + cc[None, :])
        best = (near + off).min(1)[:, None]
        open_ = near - off <= best
        open_[:, 0] |= ~open_.any(1)  # a frame without finite distances gets unit 0
        out[s : s + rows] = _decide(blk, C, open_)
    return out


def _decide(V: np.ndarray, C: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Per row the first of its open centroids with the least exact distance."""
    row, cid = np.nonzero(open_)
    step = max(1, BLOCK_CELLS // max(1, C.shape[1]))
    parts = [((V[row[s : s + step]] - C[cid[s : s + step]]) ** 2).sum(1) for s in range(0, len(row), step)]
    exact = np.concatenate(parts) if parts else np.zeros(0)
    order = np.lexsort((cid, exact, row))
    first = np.unique(row[order], return_index=True)[1]
    return cid[order][first]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.astype(np.float64, copy=False).reshape(len(column), -1)


def _tiles(book: DataFrame, cid: str, vec: str, blocks: int, tile_rows: int) -> DataFrame:
    """Centroids with the tile they are in, once for every block of frames."""
    return book.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.floor(F.col(cid) / tile_rows).cast("int").alias("tile"),
        F.col(cid).cast("long").alias("cid"),
        F.col(vec).cast("array<double>").alias("c"),
    )


def _nearest_of_tiles(frames: DataFrame, book: DataFrame, cid: str, vec: str, blocks: int, tile_rows: int) -> DataFrame:
    """``(row, code)`` of frames ``(row, block, v)``: the least (distance, centroid id) over all tiles."""
    n, low, high = book.agg(F.count_distinct(cid), F.min(cid), F.max(cid)).first()
    if not n or low != 0 or high != n - 1 or book.count() != n:
        raise ValueError("centroid ids must be 0..K-1 within each codebook")
    tiles = -(-n // tile_rows)
    spread = frames.select("row", "block", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "v")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        ids = right.column("cid").to_numpy()
        order = np.argsort(ids)
        C, V = _matrix(right.column("c"))[order], _matrix(left.column("v"))
        at = _argmin(V, C)
        return pa.table(
            {"row": left.column("row"), "cid": pa.array(ids[order][at]), "dist": pa.array(((V - C[at]) ** 2).sum(1))}
        )

    found = (
        spread.groupBy("block", "tile")
        .cogroup(_tiles(book, cid, vec, blocks, tile_rows).groupBy("block", "tile"))
        .applyInArrow(best, "row bigint, cid bigint, dist double")
    )
    return found.groupBy("row").agg(F.min(F.struct("dist", "cid")).alias("m")).select("row", F.col("m.cid").cast("int").alias("code"))


def _residuals(frames: DataFrame, codes: DataFrame, book: DataFrame, cid: str, vec: str, blocks: int, tile_rows: int) -> DataFrame:
    """Frames less their centroids, where each meets the tile of its own."""
    coded = frames.join(codes, "row").withColumn("tile", F.floor(F.col("code") / tile_rows).cast("int"))

    def less(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            kinds = {"row": pa.int64(), "id": pa.int64(), "block": pa.int32(), "v": pa.list_(pa.float64())}
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        ids = right.column("cid").to_numpy()
        order = np.argsort(ids)
        C = _matrix(right.column("c"))[order][np.searchsorted(ids[order], left.column("code").to_numpy())]
        R = _matrix(left.column("v")) - C
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(R) + 1) * R.shape[1], pa.int32()), pa.array(R.ravel()))
        return pa.table({"row": left.column("row"), "id": left.column("id"), "block": left.column("block"), "v": v})

    return (
        coded.groupBy("block", "tile")
        .cogroup(_tiles(book, cid, vec, blocks, tile_rows).groupBy("block", "tile"))
        .applyInArrow(less, "row bigint, id bigint, block int, v array<double>")
    )


def _dealt(frames: DataFrame, id_col: str, vec: str, block_rows: int) -> tuple[DataFrame, int]:
    """Frames with a row number of their own (ids may repeat) and the block they are in, in the shared folder."""
    staged = frames.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    staged = staged.withColumn("row", F.monotonically_increasing_id()).checkpoint(eager=True)
    blocks = max(1, -(-staged.count() // block_rows))
    return staged.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), blocks


def residual_codes_tiled(
    frames: DataFrame,
    books: DataFrame,
    n_q: int,
    id_col: str = "id",
    vec: str = "v",
    q: str = "q",
    cid: str = "cid",
    cvec: str = "c",
    tile_cells: int = TILE_CELLS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """J8 with codebooks of any size: ``(id, q, code)``, one stage of tiles after the other."""
    left, blocks = _dealt(frames, id_col, vec, block_rows)
    out = None
    for i in range(n_q):
        book = books.where(F.col(q) == i)
        n, d = _book_size(book, cvec)
        if not n:
            raise ValueError(f"codebooks {[i]} are missing")
        tile_rows = max(1, tile_cells // max(1, d))
        codes = _nearest_of_tiles(left, book, cid, cvec, blocks, tile_rows).checkpoint(eager=True)
        found = left.join(codes, "row").select("id", F.lit(i).alias("q"), "code")
        out = found if out is None else out.unionByName(found)
        if i + 1 < n_q:
            left = _residuals(left, codes, book, cid, cvec, blocks, tile_rows).checkpoint(eager=True)
    return out.withColumnRenamed("id", id_col)


def nearest_unit(
    frames: DataFrame,
    centroids: DataFrame,
    id_col: str = "id",
    vec: str = "v",
    cid: str = "cid",
    cvec: str = "c",
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Id of the nearest centroid (squared Euclidean) for every frame.

    A codebook above ``max_cells`` is searched in tiles instead of broadcast.
    """
    spark = frames.sparkSession
    n, d = _book_size(centroids, cvec)
    if n * d > max_cells:
        tiled = residual_codes_tiled(frames, centroids.withColumn("__q", F.lit(0)), 1, id_col, vec, "__q", cid, cvec)
        return tiled.select(id_col, F.col("code").alias("unit"))
    C = _collect_books(centroids, cid, cvec, None)[0]
    bc = spark.sparkContext.broadcast(C)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        C_ = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            V = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
            yield pd.DataFrame({"id": pdf["id"], "unit": _argmin(V, C_).astype(np.int32)})

    staged = frames.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    return staged.mapInPandas(run, "id long, unit int").withColumnRenamed("id", id_col)


def residual_codes(
    frames: DataFrame,
    books: DataFrame,
    n_q: int,
    id_col: str = "id",
    vec: str = "v",
    q: str = "q",
    cid: str = "cid",
    cvec: str = "c",
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Residual vector quantisation, codebook by codebook -> ``(id, q, code)``.

    Residuals are carried in float64 inside the task; only integer codes
    leave it.  Codebooks above ``max_cells`` together are searched in tiles.
    """
    spark = frames.sparkSession
    n, d = _book_size(books.where(F.col(q) < n_q), cvec)
    if n * d > max_cells:
        return residual_codes_tiled(frames, books, n_q, id_col, vec, q, cid, cvec)
    mats = _collect_books(books.where(F.col(q) < n_q), cid, cvec, q)
    missing = [i for i in range(n_q) if i not in mats]
    if missing:
        raise ValueError(f"codebooks {missing} are missing")
    bc = spark.sparkContext.broadcast([mats[i] for i in range(n_q)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Cs = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            R = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
            ids, qs, codes = [], [], []
            for i, C in enumerate(Cs):
                code = _argmin(R, C)
                R = R - C[code]
                ids.append(pdf["id"].to_numpy())
                qs.append(np.full(len(pdf), i, dtype=np.int32))
                codes.append(code.astype(np.int32))
            yield pd.DataFrame({"id": np.concatenate(ids), "q": np.concatenate(qs), "code": np.concatenate(codes)})

    staged = frames.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    return staged.mapInPandas(run, "id long, q int, code int").withColumnRenamed("id", id_col)
