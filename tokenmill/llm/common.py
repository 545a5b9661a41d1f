"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.session import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    return checkpointed(df)


def row_key(text: str = "text"):
    """A fingerprint of a row's text: it tells apart repeated ids with other texts."""
    return F.coalesce(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(0))


def _flat(edges: DataFrame) -> bool:
    """Whether every node of ``(a, b)`` either hangs below one root or is a root."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    each = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or (up > 0 and down > 0)").count() == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is its least node.

    Alternating large-star and small-star steps: each step only re-hangs
    nodes below smaller neighbours, so a chain of length L takes about log L
    rounds, and every round is one aggregation per node.  Rounds are cut by
    checkpoints in the shared folder and end when all nodes hang below roots.
    """
    cur = cut(
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a <> b").distinct()
    )
    while not _flat(cur):
        # large star: neighbours above a node hang below the least of its neighbourhood
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: neighbours below a node, and itself, hang below the least of them
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        cur = cut(
            joined.select(F.col("b").alias("x"), F.col("m"))
            .unionByName(joined.select(F.col("a").alias("x"), F.col("m")))
            .where("x <> m")
            .select(F.col("x").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
