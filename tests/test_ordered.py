"""Skew-safe scans equal their single-task definitions, whatever the partitioning."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokenmill.operators.ordered import global_index, row_number_within, run_starts, running_sums


def _skewed(n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = 0 if i % 3 == 0 else rnd.randint(1, 40)  # group 0 holds a third of all rows
        rows.append((g, i, rnd.choice("aab"), float(rnd.randint(0, 9))))
    return rows


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_row_number_and_sums_under_skew(spark, parts):
    rows = _skewed()
    df = spark.createDataFrame(rows, "g int, pos int, unit string, v double")
    got = running_sums(df, ["g"], ["pos"], {"rn": None, "cs": F.col("v")}, num_partitions=parts).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "pos", "unit", "v"]).sort_values(["g", "pos"])
    pdf["rn"] = pdf.groupby("g").cumcount() + 1
    pdf["cs"] = pdf.groupby("g")["v"].cumsum()
    m = got.merge(pdf, on=["g", "pos"], suffixes=("", "_x"))
    assert len(m) == len(rows)
    assert (m["rn"] == m["rn_x"]).all()
    assert (m["cs"] - m["cs_x"]).abs().max() < 1e-9


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_global_index_is_partition_independent(spark, parts):
    df = spark.range(0, 2000).select((F.col("id") * 7919 % 2000).alias("k"))
    got = sorted((r.k, r.idx) for r in global_index(df, ["k"], num_partitions=parts).collect())
    assert got == [(k, k) for k in range(2000)]


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_run_starts_match_gaps_and_islands(spark, parts):
    rows = _skewed(2000, seed=3)
    df = spark.createDataFrame(rows, "g int, pos int, unit string, v double").select("g", "pos", "unit")
    got = {(r.g, r.pos): r.run_start for r in run_starts(df, ["g"], "pos", "unit", num_partitions=parts).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "pos", "unit", "v"]).sort_values(["g", "pos"])
    expect = {}
    for g, part in pdf.groupby("g"):
        start, prev = None, object()
        for pos, unit in zip(part["pos"], part["unit"]):
            if unit != prev:
                start = pos
            prev = unit
            expect[(g, pos)] = start
    assert got == expect


def test_row_number_within_single_hot_group(spark):
    df = spark.range(0, 5000).select(F.lit(1).alias("g"), F.col("id").alias("o"))
    got = row_number_within(df, ["g"], ["o"], num_partitions=16)
    assert got.where(F.col("rn") != F.col("o") + 1).count() == 0
