import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import DOCS, ITEMS, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, terms string")


@pytest.fixture(scope="session")
def labels(spark):
    made = [(i, int(i < 300), 0, "x") for i in (*range(200, 240), *range(300, 320))]
    return spark.createDataFrame([*made, (None, 1, 0, "x"), (201, None, None, None), (7, 1, 0, "x")], "doc_id long, quality int, toxic int, features string")
