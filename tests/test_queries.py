"""Every query with an oracle against DuckDB; every other query runs; the flagship's counts."""

import math

import pytest

import __spark_entry__ as entry
from siltstone.plans.registry import ORACLES, QUERIES
from tests.conftest import DATA


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def test_entry_counts(spark):
    got = {r["status"]: r["docs"] for r in entry.entry(spark).collect()}
    assert got == {"accepted": 176, "duplicate": 10, "contaminated": 3, "reject_short": 10, "reject_repeated_lines": 1}


def test_entry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["w1_funnel_status", "s12_pack_blocks", "w9_pack_ranges", "m5_hash_modulo_split", "w3_stratified_topk"])
def test_partition_count_changes_nothing(spark, name):
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(repr, QUERIES[name](spark, DATA).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]
