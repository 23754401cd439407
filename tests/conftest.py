import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vacancia.session import build_session
    return build_session("tests", partitions=4)


@pytest.fixture(scope="session")
def values(spark):
    """Values of Column expressions over one literal row."""
    def run(*columns):
        return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())
    return run
