import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from provspark.session import local_session

    session = local_session("tests", 8, 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def table(spark):
    """table(schema, *rows) -> DataFrame"""
    def make(schema, *rows):
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return make


@pytest.fixture
def one(spark):
    """one(column, name=value, ...) -> value of a column expression over one row"""
    def run(build, schema, *row):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([tuple(row)], schema)
        cols = [F.col(c) for c in df.columns]
        return df.select(build(*cols).alias("out")).first()[0]

    return run
