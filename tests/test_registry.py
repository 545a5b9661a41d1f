"""Driver contract: entry() runs, every query runs and matches its DuckDB oracle at sf0.001."""

import pytest

import __spark_entry__ as E
from tests_support import SMALL, compare_query
from tokenmill.plans import registry

registry.load_all()
QUERIES = {name: fn for name, fn in E.queries().items() if name in registry.QUERIES}
ORACLE = {name: sql for name, sql in E.oracle_sql().items() if name in registry.QUERIES}
ROWS_ONLY = {"manifest_scan"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "batch_id" in df.columns


def test_oracle_coverage():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    ok, msg = compare_query(spark, SMALL, name, QUERIES[name], ORACLE.get(name))
    assert ok, msg


@pytest.mark.parametrize("name", ["training_batches", "run_length_units", "weighted_meter", "shard_merge"])
def test_same_result_under_any_partitioning(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for parts in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            results.append(sorted(tuple(r) for r in QUERIES[name](spark, SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]
