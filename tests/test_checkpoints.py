"""Shuffle files of what has been written to the checkpoint folder."""

import glob
import os

from tokenmill.llm.common import cut


def _shuffle_bytes(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/blockmgr-*/**/shuffle_*.data", recursive=True))


def test_shuffles_go_when_a_cut_is_written(spark):
    folders = (os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", "/tmp")).split(",")
    before = sum(map(_shuffle_bytes, folders))
    df = spark.range(200_000).selectExpr("id % 100003 as k", "id").groupBy("k").count()
    got = cut(df)
    assert sum(map(_shuffle_bytes, folders)) <= before
    assert got.count() == 100_003 and df.count() == 100_003
