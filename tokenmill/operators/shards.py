"""Shard merge (U1): union of worker shards, last writer wins per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shard_merge(shards: DataFrame, key: str = "key", worker: str = "worker") -> DataFrame:
    """One record per key, taken from the highest-ranked worker that wrote it.

    Records of equal workers are ordered by their values, column by column,
    so the winner does not depend on the order of arrival.
    The greatest record is an algebraic aggregate: duplicates are resolved map-side,
    so a key written by every worker costs one row per task in the shuffle.
    """
    others = [c for c in shards.columns if c != key]
    ranked = [worker, *[c for c in others if c != worker]]
    rec = F.max(F.struct(*[F.col(c) for c in ranked])).alias("__rec")
    return shards.groupBy(key).agg(rec).select(key, *[F.col(f"__rec.{c}").alias(c) for c in others])
