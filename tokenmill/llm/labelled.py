"""Bounded samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out() -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 5, is 0 (a null id is not held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """(doc_id, text, y): at most ``most[y]`` labelled rows of each class that are not held out.

    The ids come first (least hashes of the id, so any size of table gives a
    fair sample), and only this bounded list of ids is broadcast; repeated
    texts count once.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    chosen = None
    for y, rows in most.items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .withColumn("_t", F.xxhash64("text"))
        .dropDuplicates(["_t", "y"])
        .drop("_t")
    )
