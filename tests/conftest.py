import os

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


@pytest.fixture
def same(spark, duck, sf):
    """Compares a query with its SQL twin, rows in any order."""

    def rows(pdf):
        pdf = pdf[sorted(pdf.columns)].astype(object)
        return sorted(tuple("null" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))

    def check(query, sql):
        got, want = query(spark, sf).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return check
