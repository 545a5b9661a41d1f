"""A training-data pipeline over ``documents``: five stages, each one operator of ``tokenmill.llm``.

``STAGES`` lists ``(name, function)``; each function takes (spark, docs, sf_dir)
and returns a DataFrame.  All but the last return the columns of documents.

1. toxicity: documents that score 0.5 or more go.
2. n-gram Jaccard join: one document of each group (the least doc_id) stays,
   five-word shingles, similarity 0.8; one row of repeated rows stays.  Texts
   that share a doc_id are documents of their own, each in its own group.
3. suffix-array dedup: bytes under repeated 400-byte strings go, whole
   characters only; every document stays, an emptied one with empty text.
4. mixing: a document is emitted once for each of its copies in the mix (none
   to three); null sources are a source.
5. best-fit packing: pieces of at most 2048 tokens with their place.

A null text counts as empty; a null doc_id is never a duplicate.  ``n_chars``
is kept in step with the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import cut, table
from tokenmill.llm.mixing import mix_sources
from tokenmill.llm.ngram_join import similar_documents
from tokenmill.llm.packing import default_vocabulary, pack_documents
from tokenmill.llm.suffix import suffix_dedup
from tokenmill.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, "_score").where(F.col("_score") < TOXIC_FROM).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = similar_documents(docs.select("doc_id", "text"), gram=5, num=80, den=100)
    # of each component the row of least doc_id (of several texts under it, of least rk); what links with nothing stays
    rows = found.where("component is not null").groupBy("component", "doc_id", "rk").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "rk", "n")).alias("first")).select("first.rk", "first.n")
    alone = found.where("component is null").select("rk", F.lit(1).cast("bigint").alias("n")).distinct()
    keep = first.unionByName(alone).select(F.col("rk").alias("_rk"), "n")
    rk = F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = docs.withColumn("_rk", rk).join(keep, "_rk")
    once, again = kept.where("n = 1"), kept.where("n > 1").dropDuplicates(["_rk"])
    return once.select(*COLUMNS).unionByName(again.select(*COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(docs.select(*COLUMNS), whole_characters=True)
    text = F.when(F.col("n_removed") >= 0, F.col("kept").cast("string")).alias("text")
    return kept.select("doc_id", text, "lang", "source", F.length(F.col("kept").cast("string")).cast("bigint").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix_sources(docs.select(*COLUMNS)).where("_copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    return mixed.select(*COLUMNS, copies.alias("_copy")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs.select("doc_id", "text"), default_vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicates),
    ("suffix_array", repeated_strings),
    ("mixing", mixing),
    ("packing", packing),
]

#: No SQL: the stages fit a model, iterate and pack; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared checkpoint folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
