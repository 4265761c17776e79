import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import odd  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return odd.table(spark)


@pytest.fixture(scope="session")
def nothing(spark):
    return odd.table(spark, [])
