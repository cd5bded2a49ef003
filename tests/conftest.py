import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from markloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("markloom-tests", "local[8]", 8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate columns on a single row."""

    def run(*cols):
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return row[0] if len(cols) == 1 else tuple(row)

    return run
