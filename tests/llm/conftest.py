import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import ITEM_ROWS, frame, nasty  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return nasty()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(i, t, 1, "w") for i, t in ITEM_ROWS], "item_id long, text string, window int, word string")
