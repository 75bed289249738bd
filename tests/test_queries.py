"""Queries against their SQL twins in DuckDB on the smallest tables, and the library without its training-data folder."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from blockloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    if name not in ORACLES:
        assert df.count() > 0
        return
    r = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert plain([tuple(x) for x in df.collect()], df.columns) == plain(r.fetchall(), r.columns)


def test_crc32c_of_names(spark):
    def crc(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    names = spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey", "c_name").collect()
    assert {(r.k, r.crc) for r in QUERIES["fn_crc32c"](spark, DATA).collect()} == {(r.c_custkey, crc(r.c_name.encode())) for r in names}


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_training_data_operators(tmp_path):
    """The folder may be absent."""
    code = "import sys; sys.modules['blockloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [k for k in e.queries() if k.startswith('op1_')]"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
