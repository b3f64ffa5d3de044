from __future__ import annotations

import pytest

from tests.session import build

TEXTS = [None, "", " \n\t", "one", "a b c", "Tide tide\nTIDE", "naïve ▁ café 日本", "x" * 5000, "low tide " * 40]


@pytest.fixture(scope="session")
def spark():
    return build("local[8]")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, a repeated row, a null id, and columns with names that operators use."""
    rows = [(i, t, "fp", 1) for i, t in enumerate(TEXTS)] + [(3, "one", "fp", 1), (None, "one", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
