import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .appName("eventide-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def series():
    """Series layout with narrow blocks, so that block borders are crossed."""
    from eventide.core.series import Series

    return Series(("k",), "t", 1.0)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def train(spark, times, key="a"):
    return spark.createDataFrame([(key, float(t)) for t in times], "k string, t double")


def signal(spark, times, values, key="a"):
    rows = [
        (key, i, float(t), None if v is None else float(v))
        for i, (t, v) in enumerate(zip(times, values))
    ]
    return spark.createDataFrame(rows, "k string, i bigint, t double, v double")
