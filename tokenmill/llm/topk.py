"""Exact top-k inner-product search: tiled matrix products and merged top lists.

Rows and queries are dealt into tiles by a hash of their id; a pair of tiles
meets in one task, which multiplies the two matrices, selects each query's
best rows of that tile, and emits only those.  The lists of a query are then
merged in two levels, groups of tiles first.

Integer scores are exact: products run in double precision where every
partial sum is below 2**53, and in Python integers otherwise (a score beyond
a long is held at the end of its range).

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows with a null id; only vectors of the query's length
are its candidates; rows with the same id count as one row when equal, and a
query never meets its own id; a query with fewer candidates returns them all;
empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.common import table
from tokenmill.llm.registry import query

TILE_ROWS = 8192
QUERY_ROWS = 4096
CHUNK = 512
LEAST = np.iinfo(np.int64).min


def usable(vector: str) -> Column:
    """Neither null nor with null or non-finite components."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = len(column)
    flat = np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in column.chunks]) if rows else np.zeros(0)
    return flat.reshape(rows, -1) if rows and len(flat) else np.zeros((rows, 0))


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line the k highest, ties to the smaller column: (line, column) pairs."""
    lines, width = scores.shape
    if width > k:
        least = np.partition(scores, width - k, axis=1)[:, width - k]
        above = scores > least[:, None]
        equal = scores == least[:, None]
        equal &= np.cumsum(equal, axis=1) <= (k - above.sum(axis=1))[:, None]
        return np.nonzero(above | equal)
    return np.nonzero(np.ones_like(scores, bool))


def tile_top(queries: pa.Table, rows: pa.Table, k: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Top lists of one pair of tiles: query ids, row ids, scores."""
    row_ids = rows.column("id").to_numpy()
    order = np.argsort(row_ids, kind="stable")
    row_ids, data = row_ids[order], np.floor(scale * matrix(rows.column("vector")))[order]
    again = np.zeros(len(row_ids), bool)
    again[1:] = (row_ids[1:] == row_ids[:-1]) & (data[1:] == data[:-1]).all(axis=1)
    row_ids, data = row_ids[~again], data[~again]
    query_ids = queries.column("id").to_numpy()
    asked = np.floor(scale * matrix(queries.column("vector")))
    width = data.shape[1]
    bound = float(np.abs(data).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(width, 1)
    for at in range(0, len(query_ids), CHUNK):
        ids, block = query_ids[at : at + CHUNK], asked[at : at + CHUNK]
        if bound < 2.0**53:
            scores = (block @ data.T).astype(np.int64)
        else:
            exact = np.array([[int(x) for x in v] for v in block], object).reshape(len(block), width)
            other = np.array([[int(x) for x in v] for v in data], object).reshape(len(data), width)
            ends = np.iinfo(np.int64)
            scores = np.array(
                [[min(ends.max, max(ends.min + 1, sum(a * b for a, b in zip(x, y)))) for y in other] for x in exact], np.int64
            ).reshape(len(block), len(data))
        scores[ids[:, None] == row_ids[None, :]] = LEAST
        line, col = _best(scores, row_ids, k)
        found = scores[line, col]
        keep = found > LEAST
        yield ids[line[keep]], row_ids[col[keep]], found[keep]


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: int = 256,
    tile_rows: int = TILE_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``rows`` and ``queries``: (id long, vector array); gives (query_id, rank, id, score)."""

    def ready(df):
        return df.where(F.col("id").isNotNull() & usable("vector")).select(
            F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")
        )

    rows, queries = ready(rows), ready(queries)
    counts = rows.agg(F.count("*").alias("n"), F.lit(0).alias("of")).unionByName(
        queries.agg(F.count("*").alias("n"), F.lit(1).alias("of"))
    )
    by = {r.of: r.n for r in counts.collect()}
    tiles, blocks = max(1, -(-by[0] // tile_rows)), max(1, -(-by[1] // query_rows))
    place = F.size("vector").alias("dim")
    left = (
        queries.distinct()
        .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        .withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        .select("block", "tile", place, "id", "vector")
    )
    right = (
        rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select("block", "tile", place, "id", "vector")
    )

    def pair(key, asked, data):
        parts = list(tile_top(asked, data, k, scale)) if asked.num_rows and data.num_rows else []
        cat = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
        return pa.table(
            {
                "query_id": pa.array(cat[0], pa.int64()),
                "tile": pa.array(np.full(len(cat[0]), key[1].as_py(), np.int32)),
                "id": pa.array(cat[1], pa.int64()),
                "score": pa.array(cat[2], pa.int64()),
            }
        )

    keys = ["block", "tile", "dim"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        pair, "query_id bigint, tile int, id bigint, score bigint"
    )
    return merge_top(lists, k)


def merge_top(lists: DataFrame, k: int, fan: int = 64) -> DataFrame:
    """Merge the top lists of tiles, ``fan`` tiles at a time and then all of a query."""
    best = [F.col("score").desc(), F.col("id")]
    part = Window.partitionBy("query_id", F.floor(F.col("tile") / fan)).orderBy(*best)
    once = lists.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    whole = Window.partitionBy("query_id").orderBy(*best)
    return (
        once.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    )


_ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""


@query("op4_topk", _ORACLE)
def op4_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(rows, rows.where(F.col("id") % 50 == 0), k=5, scale=256).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score"
    )
