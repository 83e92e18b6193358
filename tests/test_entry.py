"""Driver contract, and every query with SQL against DuckDB on the smallest tables."""

import os
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
from tensorloom.catalog import oracle_sql

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_entry(spark, duck):
    assert entry.entry(spark).limit(3).count() == 3


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _table(df):
    plain = df.map(lambda x: tuple(x) if isinstance(x, (list, np.ndarray)) else x)
    return plain[sorted(plain.columns)].sort_values(sorted(plain.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = _table(entry.queries()[name](spark, FOLDER).toPandas()), _table(duck.sql(oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            # Rounding can fall to either side of a tie.
            assert np.allclose(got[c], want[c], rtol=1e-6, atol=1e-6), c
        else:
            assert (got[c] == want[c]).all(), c


def test_streaming(spark, tmp_path):
    from tensorloom.streaming import live_compress, to_memory, windowed_compress

    spark.createDataFrame([(1, 1, 3.0, "2024-01-01 00:00:01"), (1, 1, 7.0, "2024-01-01 00:00:30"), (2, 0, 1.0, "2024-01-01 00:02:00")], "i int, j int, x double, t string").selectExpr("i", "j", "x", "cast(t AS timestamp) AS t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i int, j int, x double, t timestamp").parquet(str(tmp_path / "in"))
    for df, name, want in ((live_compress(stream, ["i", "j"], "x"), "live", 2), (windowed_compress(stream, "t", "1 minute", "5 minutes", ["i", "j"], "x"), "windows", 2)):
        run = to_memory(df, name)
        run.awaitTermination(60)
        assert spark.table(name).count() == want
        assert spark.table(name).where("i0 = 1").first()["v"] == 10
