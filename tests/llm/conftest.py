import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from tests_llm_helpers import EDGES, SCHEMA, rows_of  # noqa: E402


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, columns with odd names."""
    rows = rows_of(EDGES)
    rows += [rows[4], rows[4]] + [(None, "no id at all", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def make(spark):
    return lambda texts, start=1: spark.createDataFrame(rows_of(texts, start), SCHEMA).repartition(3)
