import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from songloom.session import build_session  # noqa: E402

# Started here, as the test modules build columns when they are read.
SESSION = build_session("songloom-tests", "local[4]", **{
    "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of given columns."""
    def value(expression, schema, *row):
        return spark.createDataFrame([row], schema).select(expression).first()[0]
    return value
