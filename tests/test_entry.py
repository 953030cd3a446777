"""Driver contract: entry() runs, every key builds on sf0.001, SQL covers the keys."""

import glob
import os

import duckdb

import __spark_entry__ as E

# Tested in tests/llm, by brute force where SQL cannot express them.
HEAVY = {k for k in E.queries() if k.startswith("op") and k[2].isdigit()} | {"pipeline"}
ROWS_ONLY = set()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"date", "total_volume", "baseline", "share"}
    assert df.count() > 0


def test_every_key_has_oracle_sql_or_is_declared_rows_only():
    q, s = E.queries(), E.oracle_sql()
    assert set(q) - set(s) - HEAVY == ROWS_ONLY
    assert set(s) <= set(q)


def test_every_key_has_the_rows_and_columns_of_its_sql_on_the_smallest_sf(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    sql = E.oracle_sql()
    for name, fn in E.queries().items():
        if name in HEAVY:
            continue
        df = fn(spark, sf)
        want = con.execute(f"SELECT * FROM ({sql[name]})")
        assert sorted(df.columns) == sorted(d[0] for d in want.description), name
        assert df.count() == len(want.fetchall()), name


class _FakeContext:
    def __init__(self, master, conf_dir=None):
        self.master, self._conf_dir, self._dir = master, conf_dir, None

    def getCheckpointDir(self):
        return self._dir

    def getConf(self):
        return {"spark.checkpoint.dir": self._conf_dir} if self._conf_dir else {}

    def setCheckpointDir(self, d):
        self._dir = d


class _FakeSession:
    conf = {"spark.sql.warehouse.dir": "file:/shared/warehouse"}

    def __init__(self, sc):
        self.sparkContext = sc


def test_checkpoint_dir_comes_from_the_session_and_is_never_local_on_a_cluster():
    import pytest

    from panelspark.session import ensure_checkpoint_dir
    shared = _FakeContext("yarn", "hdfs://nn/shared/ckpt")
    assert ensure_checkpoint_dir(_FakeSession(shared)) == "hdfs://nn/shared/ckpt"
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(_FakeSession(_FakeContext("spark://host:7077")))
    local = _FakeContext("local[2]")
    assert ensure_checkpoint_dir(_FakeSession(local)).startswith("file:/shared/warehouse/_scratch/")
