import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF


def rows(df, *by):
    """Rows as tuples, in order."""
    got = [tuple(r) for r in df.collect()]
    return sorted(got, key=lambda r: tuple((x is not None, str(x)) for x in r)) if not by else got


@pytest.fixture(scope="session")
def oracle(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def same(got, want) -> None:
    """Two pandas frames hold the same rows."""
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (d[cols].astype(object).where(d[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b)
    bad = (a != b).any(axis=1)
    assert not bad.any(), f"{a[bad].head(3)}\n{b[bad].head(3)}"
