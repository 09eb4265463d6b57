from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__  # noqa: E402, F401  (registers the functions that travel with a job)
from casewell.session import build_session  # noqa: E402


# Started before the test modules are read, since they hold column expressions.
SESSION = build_session(
    "tests",
    "local[4]",
    **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
    },
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def column(spark):
    """Values of an expression over a column of texts, in order."""

    def run(values, expression, dtype="string"):
        rows = list(enumerate(values))
        df = spark.createDataFrame(rows, f"i int, c {dtype}")
        return [r[0] for r in df.orderBy("i").select(expression).collect()]

    return run
