import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_compare import compare, duck  # noqa: E402

SMALL = "/root/testdata/sf0.001"
_CON = {}


def compare_query(spark, sf_dir, name, fn, sql):
    con = _CON.get(sf_dir)
    if con is None:
        con = _CON[sf_dir] = duck(sf_dir)
    return compare(spark, sf_dir, name, fn, sql, con)
