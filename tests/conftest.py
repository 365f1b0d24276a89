import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    """A value of either engine in a form that compares and sorts."""
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(map(plain, value))
    if isinstance(value, bytearray):
        return bytes(value)
    return value


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Assert that a query and its SQL give the same rows."""

    def check(build, sql):
        df = build(spark, sf)
        names = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
        found = duck.sql(sql)
        assert sorted(found.columns) == names
        at = [found.columns.index(c) for c in names]
        want = sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)
        assert got == want

    return check
