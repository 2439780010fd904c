import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opsloom.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="opsloom-tests-"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def make(spark):
    """Rows to a DataFrame: ``make("a int, b string", (1, "x"), ...)``."""

    def build(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build


def rows(df, *columns):
    """Sorted tuples of the result, optionally of some columns only."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def one(df):
    """The only row, as a dict."""
    found = [r.asDict() for r in df.collect()]
    assert len(found) == 1, found
    return found[0]
