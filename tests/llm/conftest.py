import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from corpus_cases import make, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])
