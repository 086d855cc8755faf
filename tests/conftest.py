import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodestat import index_series  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    """Ten people with age, income and score."""
    # The golden numbers of the tests belong to them.
    rows = list(
        zip(
            map(float, range(1, 11)),
            [25.0, 30.0, 35.0, 25.0, 40.0, 31.0, 28.0, 33.0, 45.0, 22.0],
            [50000.0, 60000.0, 70000.0, 55000.0, 80000.0, 75000.0, 45000.0, 62000.0, 90000.0, 40000.0],
            [85.5, 90.0, 0.0, 78.5, 0.0, 92.0, 0.0, 88.5, 95.0, 0.0],
        )
    )
    return spark.createDataFrame(rows, "id double, age double, income double, score double")


@pytest.fixture(scope="session")
def gaps(spark):
    """Columns with NULLs, a constant and a group that holds most of the rows."""
    rows = []
    for i in range(400):
        a = None if i % 7 == 0 else math.sin(i) * 50 + i * 0.1
        b = None if i % 5 == 0 else float((i * 37) % 101)
        c = None if i % 3 == 0 else i % 4
        rows.append((i, a, b, c, 2.5, "hot" if i % 3 else f"g{i % 4}"))
    return spark.createDataFrame(rows, "id long, a double, b double, c int, k double, grp string").repartition(5)


def chaotic(n):
    """A plane map that folds and stretches: deterministic, without a linear trace of it."""
    x, y, out = 0.2, 0.1, []
    for _ in range(n):
        x, y = 1 - 1.4 * x * x + y, 0.3 * x
        out.append(x)
    return out


def correlated(n):
    """Noise that remembers 0.6 of its last value."""
    out, last = [], 0.0
    for shock in np.random.default_rng(29).normal(size=n):
        last = 0.6 * last + float(shock)
        out.append(last)
    return out


@pytest.fixture(scope="session")
def series(spark):
    """Build a one-series index from a list; the rows arrive shuffled."""

    def build(values, parts=4):
        df = spark.createDataFrame(list(enumerate(map(float, values))), "t long, v double")
        return index_series(df.repartition(parts), "v", "t")

    return build
